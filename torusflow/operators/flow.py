"""Permeability by the lattice-Boltzmann method, in two and three dimensions.

A structure is stepped until its own flux has settled, averaged, and then leaves the block,
so what it is computed to doesn't depend on which structures share its block. A solve that
reaches max_steps unsettled has no permeability: its components are null.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame

from .lattice import kernel


#: Cells that are stepped together: enough to outweigh the calls, few enough for a processor's cache.
BLOCK = 1 << 15


@dataclass(frozen=True)
class Rule:
    """When a solve stops, and how long it is averaged.

    Every ``lag`` steps the mean flux since the last look is compared with the one before.
    Settled is a component whose drift is under eps times its size (at least ``floor`` of the
    flux), or under ``sigmas`` standard errors of the two means; ``whole`` compares the
    largest drift with eps times the whole flux instead. ``hold`` looks in a row end it.
    """

    eps: float
    lag: int
    hold: int
    min_steps: int
    max_steps: int
    avg_steps: int
    sample: int = 1
    floor: float = 1e-2
    sigmas: float = 3.0
    whole: bool = False


#: The published runs' rules for structures of 256 * 256 and 80 * 80 * 80 cells.
RULE_2D = Rule(eps=1e-3, lag=5000, hold=3, min_steps=10_000, max_steps=500_000, avg_steps=20_000, sample=50)
RULE_3D = Rule(eps=1e-5, lag=2000, hold=2, min_steps=4000, max_steps=200_000, avg_steps=2000, whole=True)


def scaled(rule: Rule, side: int, full: int) -> Rule:
    """The rule for a smaller structure: times go with the square of the side, as the flow's relaxation does."""
    part = min(1.0, (side / full) ** 2)
    of = lambda steps, least: max(least, round(steps * part))
    return Rule(rule.eps, of(rule.lag, 50), rule.hold, of(rule.min_steps, 100), of(rule.max_steps, 2000), of(rule.avg_steps, 50), min(rule.sample, 5), rule.floor, rule.sigmas, rule.whole)


def velocities(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the square lattice with 9 (the cubic one with 19) velocities, x first: the velocities and their weights."""
    every = [c for c in product((0, 1, -1), repeat=dims) if sum(map(abs, c)) <= 2]
    rest, face, edge = {2: (4 / 9, 1 / 9, 1 / 36), 3: (1 / 3, 1 / 18, 1 / 36)}[dims]
    return np.array(every), np.array([(rest, face, edge)[sum(map(abs, c))] for c in every])


class _Fluid:
    """The populations of a block of structures between half-way bounce-back walls."""

    def __init__(self, wall: np.ndarray, force: np.ndarray, tau: float):
        self.wall, self.force, self.tau = wall, force, tau
        self.c, self.w = velocities(wall.ndim - 1)
        self.back = [int(np.flatnonzero((self.c == -c).all(1))[0]) for c in self.c]
        self.push = [float(3 * w * (c @ force)) for c, w in zip(self.c, self.w)]
        self.f = [np.full(wall.shape, w) for w in self.w]
        self._walls()

    def _walls(self) -> None:
        """By velocity, where the population that arrives would come out of a wall."""
        self.behind = [self._moved(self.wall, c) for c in self.c]

    def moments(self):
        """Density and, as sums in one order whatever the block, momentum by component."""
        rho = sum(self.f)
        return rho, [sum(int(c[a]) * x for c, x in zip(self.c, self.f) if c[a]) for a in range(self.c.shape[1])]

    def step(self) -> None:
        rho, momentum = self.moments()
        u = [3 * m / rho for m in momentum]
        base = 1 - sum(v * v for v in u) / 6
        after: list = [None] * len(self.c)
        for k, c in enumerate(self.c):
            if after[k] is not None:
                continue
            # Opposite velocities share all but the sign of one term.
            along = sum(v if n > 0 else -v for v, n in zip(u, c) if n) if c.any() else 0.0
            even, weight = base + 0.5 * along * along, self.w[k] * rho
            for m, odd in ((k, along), (self.back[k], -along)):
                level = weight * (even + odd + self.push[m] / self.w[m])
                after[m] = level if self.tau == 1 else self.f[m] + (level - self.f[m]) / self.tau + (1 - 1 / self.tau) * self.push[m] * rho
        # What would come out of a wall is what went into it; nothing is read in walls.
        self.f = [np.where(self.wall, self.w[k], np.where(self.behind[k], after[self.back[k]], self._moved(after[k], c))) for k, c in enumerate(self.c)]

    def _moved(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """x is the last axis."""
        return np.roll(x, tuple(int(v) for v in c[::-1]), tuple(range(1, x.ndim))) if c.any() else x

    def flux(self) -> np.ndarray:
        """The mean velocity over whole cells: (structures, components)."""
        rho, momentum = self.moments()
        axes = tuple(range(1, self.wall.ndim))
        return np.stack([np.where(self.wall, 0, m / rho + f / 2).mean(axes) for m, f in zip(momentum, self.force)], 1)

    def keep(self, which: np.ndarray) -> None:
        self.wall, self.f = self.wall[which], [x[which] for x in self.f]
        self._walls()


def solve(wall: np.ndarray, force: np.ndarray, rule: Rule, tau: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flux, steps, settled) of each structure; the flux of an unsettled one is nan."""
    n, dims = len(wall), wall.ndim - 1
    fluid = _Fluid(wall.astype(bool), force, tau)
    flux, steps, settled = np.full((n, dims), np.nan), np.zeros(n, int), np.zeros(n, bool)
    who, hold, ends = np.arange(n), np.zeros(n, int), np.full(n, -1)
    last, last_se = np.full((n, dims), np.nan), np.zeros((n, dims))
    total, squares, taken = np.zeros((n, dims)), np.zeros((n, dims)), np.zeros(n, int)

    def mean_and_error():
        m = total / np.maximum(taken, 1)[:, None]
        spread = np.maximum(squares - taken[:, None] * m * m, 0) / np.maximum(taken - 1, 1)[:, None]
        return m, np.sqrt(spread / np.maximum(taken, 1)[:, None])

    t = 0
    while len(who):
        fluid.step()
        t += 1
        # The rule of the whole flux looks at single steps; its sums serve the averaging alone.
        if t % rule.sample == 0 and (not rule.whole or (ends >= 0).any()):
            q = fluid.flux()
            total, squares, taken = total + q, squares + q * q, taken + 1
        if t % rule.lag == 0:
            m, error = mean_and_error()
            if rule.whole:
                m, error = fluid.flux(), np.zeros_like(error)
            drift, whole = np.abs(m - last), np.sqrt((m * m).sum(1))
            if rule.whole:
                good = drift.max(1) < rule.eps * whole
            else:
                bound = np.maximum(rule.eps * np.maximum(np.abs(m), rule.floor * whole[:, None]), rule.sigmas * np.sqrt(error**2 + last_se**2))
                good = (drift < bound).all(1)
            # Nothing flows in a structure without a way through: settled when it is still.
            good |= (whole < 1e-15) & (drift.max(1) < 1e-15)
            looking = ends < 0
            hold = np.where(looking & good & (t >= rule.min_steps), hold + 1, 0)
            new = looking & (hold >= rule.hold)
            ends[new] = t + rule.avg_steps
            last, last_se = m, error
            clear = looking  # those being averaged keep their sums, but for the new ones
            total[clear], squares[clear], taken[clear] = 0, 0, 0
        out = (ends == t) | ((ends < 0) & (t >= rule.max_steps))
        if out.any():
            m, _ = mean_and_error()
            done = out & (ends == t)
            now = fluid.flux()
            flux[who[done]] = np.where(taken[done][:, None] > 0, m[done], now[done])
            steps[who[out]], settled[who[done]] = t, True
            keep = ~out
            fluid.keep(keep)
            who, hold, ends, last, last_se, total, squares, taken = (x[keep] for x in (who, hold, ends, last, last_se, total, squares, taken))
    return flux, steps, settled


def tensor(packed: DataFrame, dims: int, *, force: float = 1e-5, tau: float = 1.0, rule: Rule | None = None) -> DataFrame:
    """A row a structure and component: K_ij from the solve along j, its steps, and whether it settled (else k is null)."""
    full, base = (256, RULE_2D) if dims == 2 else (80, RULE_3D)
    mu = (tau - 0.5) / 3

    def work(ids, g):
        own = rule or scaled(base, g.shape[1], full)
        rows = []
        for j in range(dims):
            flux, steps, settled = solve(g, force * np.eye(dims)[j], own, tau)
            rows += [(ids, np.full(len(ids), i), np.full(len(ids), j), mu * flux[:, i] / force, steps, settled.astype(int)) for i in range(dims)]
        return tuple(np.concatenate(c) for c in zip(*rows))

    return kernel(packed, dims, work, "sid long, i int, j int, k double, steps int, settled int", BLOCK)


def permeability(packed: DataFrame, **how) -> DataFrame:
    """2D: K in a row, its symmetric off-diagonal, reciprocity residual and convergence flags."""
    from pyspark.sql import functions as F

    rows = tensor(packed, 2, **how)
    pick = lambda i, j, c="k": F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col(c)))
    out = rows.groupBy("sid").agg(pick(0, 0).alias("k_xx"), pick(0, 1).alias("k_xy"), pick(1, 0).alias("k_yx"), pick(1, 1).alias("k_yy"), pick(0, 0, "settled").alias("conv_fx"), pick(1, 1, "settled").alias("conv_fy"))
    trace = F.abs(F.col("k_xx") + F.col("k_yy"))
    return out.withColumns({"k_off": (F.col("k_xy") + F.col("k_yx")) / 2, "recip": F.abs(F.col("k_xy") - F.col("k_yx")) / F.nullif(trace, F.lit(0.0))})
