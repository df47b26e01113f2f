"""Kernels over 3D periodic structures, a structure a row; blocks have axes (number, z, y, x)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .lattice import DIRS3 as DIRS
from .lattice import OFF, distance, fabric_of, kernel, rounded, spread


def moved(g: np.ndarray, dx: int, dy: int, dz: int) -> np.ndarray:
    """The value at (x + dx, y + dy, z + dz) of each cell."""
    return np.roll(g, (-dz, -dy, -dx), (1, 2, 3))


def cells(ids, g):
    n, d, h, w = g.shape
    z, y, x = np.mgrid[0:d, 0:h, 0:w]
    return (np.repeat(ids, d * h * w), *(np.tile(a.ravel(), n) for a in (x, y, z)))


def profile(packed: DataFrame) -> DataFrame:
    """Mean solid by lattice plane for the nine directions."""

    def work(ids, g):
        n = g.shape[1]
        z, y, x = np.mgrid[0:n, 0:n, 0:n]
        flat, rows = g.reshape(len(ids), -1).astype(float), []
        for a, b, c in DIRS:
            plane = ((a * x + b * y + c * z) % n).ravel()
            which = (np.arange(len(ids))[:, None] * n + plane[None, :]).ravel()
            rows.append(np.bincount(which, flat.ravel(), len(ids) * n).reshape(-1, n) / (n * n))
        out = np.stack(rows, 1)
        d, p = np.meshgrid(np.arange(9), np.arange(n), indexing="ij")
        return spread(ids, 9 * n), np.tile(d.ravel(), len(ids)), np.tile(p.ravel(), len(ids)), rounded(out.ravel(), 6)

    return kernel(packed, 3, work, "sid long, dir int, plane int, profile double")


def two_point(packed: DataFrame) -> DataFrame:
    """S2 along the nine directions, to a lag of half the side over the length of the step."""

    def work(ids, g):
        g = g.astype(float)
        sid, direction, lag, value = [], [], [], []
        for k, d in enumerate(DIRS):
            for r in range(int(np.floor(g.shape[1] / (2 * np.linalg.norm(d)))) + 1):
                sid.append(ids)
                direction += [k] * len(ids)
                lag += [r] * len(ids)
                value.append((g * moved(g, *(r * c for c in d))).mean((1, 2, 3)))
        return np.concatenate(sid), direction, lag, rounded(np.concatenate(value), 6)

    return kernel(packed, 3, work, "sid long, dir int, lag int, s2 double")


def fabric_components(packed: DataFrame) -> DataFrame:
    """The six components of the mean of n n^T over interface cells."""
    return kernel(packed, 3, lambda ids, g: (ids, *(rounded(v, 5) for v in fabric_of(g))), "sid long, fxx double, fyy double, fzz double, fxy double, fxz double, fyz double")


def throat_iso(packed: DataFrame, cap: float = 4.0, phase: int = 0) -> DataFrame:
    def work(ids, g):
        f = np.where(g == phase, 1 - np.minimum(distance(g, phase, cap), cap) / cap, OFF)
        return (*cells(ids, g), rounded(f.ravel(), 6))

    return kernel(packed, 3, work, "sid long, x int, y int, z int, iso double")


def _by_direction(ids, g, fields) -> tuple:
    """Cells with a column for each direction's field."""
    return (*cells(ids, g), *(rounded(f.ravel(), 6) for f in fields))


def _named(prefix: str) -> str:
    return "sid long, x int, y int, z int, " + ", ".join(f"{prefix}{k} double" for k in range(len(DIRS)))


def throat_dir(packed: DataFrame, cap: float = 4.0, horizon: int = 3, phase: int = 0) -> DataFrame:
    """As throat_iso of the least distance on a walk both ways along each of the nine directions, until it leaves the phase."""

    def work(ids, g):
        d, inside = distance(g, phase, cap), g == phase
        fields = []
        for hkl in DIRS:
            unit, least = np.array(hkl) / np.linalg.norm(hkl), d.copy()
            for way in (1, -1):
                alive = inside.copy()
                for step in range(1, horizon + 1):
                    to = np.floor(way * step * unit + 0.5).astype(int).tolist()
                    alive &= moved(inside, *to)
                    least = np.where(alive, np.minimum(least, moved(d, *to)), least)
            fields.append(np.where(inside, 1 - np.minimum(least, cap) / cap, OFF))
        return _by_direction(ids, g, fields)

    return kernel(packed, 3, work, _named("d"))


def local_axis(packed: DataFrame, radius: int = 2, phase: int = 1) -> DataFrame:
    """Of the phase's cells in a ball: one minus |v.d| for the longest axis v and for the shortest
    one, a row a cell and direction; 1.25 outside the phase, 1 with under four cells."""
    ball = [o for o in np.ndindex(*[2 * radius + 1] * 3) if sum((c - radius) ** 2 for c in o) <= radius * radius]
    ball = [tuple(c - radius for c in o) for o in ball]

    def work(ids, g):
        inside = (g == phase).astype(np.float64)
        n, first, second = np.zeros(g.shape), [np.zeros(g.shape) for _ in range(3)], {(a, b): np.zeros(g.shape) for a in range(3) for b in range(a, 3)}
        for o in ball:
            here = moved(inside, *o)
            n += here
            for a in range(3):
                first[a] += o[a] * here
                for b in range(a, 3):
                    second[a, b] += o[a] * o[b] * here
        pore = inside > 0
        some = np.maximum(n[pore], 1)
        moment = np.empty((int(pore.sum()), 3, 3))
        for (a, b), v in second.items():
            moment[:, a, b] = moment[:, b, a] = v[pore] / some - first[a][pore] * first[b][pore] / some**2
        axes = np.linalg.eigh(moment)[1]
        few = n[pore] < 4
        columns = []
        for pick in (2, 0):
            for hkl in DIRS:
                dot = 1 - np.abs(axes[:, :, pick] @ (np.array(hkl) / np.linalg.norm(hkl)))
                full = np.full(g.shape, OFF)
                full[pore] = np.where(few, 1.0, dot)
                columns.append(full)
        return (*cells(ids, g), *(rounded(c.ravel(), 5) for c in columns))

    names = [f"{p}{k} double" for p in ("long", "short") for k in range(len(DIRS))]
    return kernel(packed, 3, work, "sid long, x int, y int, z int, " + ", ".join(names))


def cone(d: tuple[int, int, int], radius: float, height: float) -> list[tuple[int, int, int]]:
    """Offsets (dx, dy, dz) of the double cone along d, the apex left out."""
    unit = np.array(d, float) / np.linalg.norm(d)
    reach = int(np.ceil(height + radius)) + 1
    grid = np.stack(np.meshgrid(*[np.arange(-reach, reach + 1)] * 3, indexing="ij"), -1).reshape(-1, 3)
    along = np.abs(grid @ unit)
    across = np.sqrt(np.maximum((grid * grid).sum(1) - along * along, 0))
    inside = (along <= height + 1e-9) & (across <= radius * along / height + 1e-9) & grid.any(1)
    return [tuple(int(c) for c in row) for row in grid[inside]]


def cone_occupancy(packed: DataFrame, radius: float = 2, height: float = 3, phase: int = 1) -> DataFrame:
    """One minus the part of the cone along each of the nine directions that is in the phase, for cells of the phase; 1.25 elsewhere."""
    stencils = [cone(d, radius, height) for d in DIRS]

    def work(ids, g):
        inside = (g == phase).astype(float)
        return _by_direction(ids, g, [np.where(inside > 0, 1 - sum(moved(inside, *o) for o in s) / len(s), OFF) for s in stencils])

    return kernel(packed, 3, work, _named("c"))


def euler_profile(packed: DataFrame, cap: float = 4.0, grid: int = 6) -> DataFrame:
    """Euler characteristic of the closed cells with throat value at most k / grid."""

    def work(ids, g):
        f = np.round(np.where(g == 0, 1 - np.minimum(distance(g, 0, cap), cap) / cap, OFF), 9)
        out = []
        for k in range(grid + 1):
            on, chi = f <= k / grid + 1e-12, 0
            for pick in range(8):  # the axes along which a face is thin
                face = on.copy()
                for axis in range(3):
                    if pick >> axis & 1:
                        face |= np.roll(face, 1, axis + 1)
                chi = chi + (-1) ** (3 - bin(pick).count("1")) * face.sum((1, 2, 3))
            out.append(chi)
        return spread(ids, grid + 1), np.tile(np.arange(grid + 1), len(ids)), np.stack(out, 1).ravel()

    return kernel(packed, 3, work, "sid long, k int, chi long")
