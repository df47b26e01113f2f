"""Random periodic structures, each from its own seed, so results don't depend on how rows are dealt."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .lattice import CELLS, rounded, shared
from .topology import spans

#: Ranges of the axis ratio by stratum; the stratum is the id modulo three.
STRATA = (("iso", 1.0, 1.0), ("mod", 1.5, 2.5), ("strong", 2.5, 4.0))


def directions(rng, count: int, dims: int) -> np.ndarray:
    """Even unit vectors: an angle in the plane, a height and an angle in space."""
    turn = rng.uniform(0.0, 2.0 * np.pi, count)
    if dims == 2:
        return np.stack([np.cos(turn), np.sin(turn)], 1)
    height = rng.uniform(-1.0, 1.0, count)
    flat = np.sqrt(1 - height**2)
    return np.stack([flat * np.cos(turn), flat * np.sin(turn), height], 1)


def rotation(rng, dims: int) -> np.ndarray:
    """An even random rotation; in space from three even numbers by Shoemake's quaternion."""
    if dims == 2:
        psi = rng.uniform(0.0, np.pi)
        return np.array([[np.cos(psi), -np.sin(psi)], [np.sin(psi), np.cos(psi)]])
    a, b, c = rng.uniform(size=3)
    x, y = np.sqrt(1 - a) * np.array([np.sin(2 * np.pi * b), np.cos(2 * np.pi * b)])
    z, w = np.sqrt(a) * np.array([np.sin(2 * np.pi * c), np.cos(2 * np.pi * c)])
    v = np.array([x, y, z])
    cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) * (w * w - v @ v) + 2 * np.outer(v, v) + 2 * w * cross


def wavevectors(rng, count: int, k0: float, dk: float, frame: np.ndarray, squash: np.ndarray) -> np.ndarray:
    """Whole-number wave vectors of a band, squashed in a frame; zero ones drop out, so there may be fewer."""
    size = rng.uniform(max(0.5, k0 - dk), k0 + dk, count)
    q = np.rint(size[:, None] * directions(rng, count, len(frame)) @ (frame @ np.diag(squash) @ frame.T).T).astype(int)
    return q[q.any(1)]


def summed(q: np.ndarray, phase: np.ndarray, n: int) -> np.ndarray:
    """The sum of cosines; components are x first, axes of the result x last."""
    # A wave is a product of one along each axis, so all waves are summed by one product of matrices.
    turns = np.exp(2j * np.pi / n * np.arange(n))
    *outer, last = (turns[np.outer(v, np.arange(n)) % n] for v in q.T[::-1])
    waves = np.exp(1j * np.asarray(phase))[:, None]
    for along in outer:
        waves = (waves[:, :, None] * along[:, None]).reshape(len(q), waves.shape[1] * n)
    total = waves.real.T @ last.real - waves.imag.T @ last.imag
    return total.reshape([n] * q.shape[1])


def field(q: np.ndarray, phase: np.ndarray, n: int) -> np.ndarray:
    """The sum of cosines, scaled to unit variance."""
    return np.sqrt(2 / max(len(q), 1)) * summed(q, phase, n)


def fields(waves: DataFrame, n: int, digits: int) -> DataFrame:
    """(sid, x, y, field) of (sid, scale, qx, qy, phase), the last three arrays of one number a wave: scale times the sum
    of cosines on n by n cells, rounded; null without waves. Equal ones of an Arrow batch are computed once."""
    kind = waves.schema["sid"].dataType.simpleString()
    step = max(1, CELLS // n**2)

    def run(batches):
        y, x = np.indices((n, n), dtype=np.int32).reshape(2, -1)
        for batch in batches:
            ids, scale = batch.column(0), batch.column(1).to_numpy()
            each = batch.column(2).value_lengths().to_numpy()
            ends = np.cumsum(each)
            qx, qy, phase = (batch.column(c).flatten().to_numpy() for c in (2, 3, 4))
            own = [(s, *(v[b - k : b] for v in (qx, qy, phase))) for s, k, b in zip(scale, each, ends)]
            known: dict[tuple, int] = {}
            same = np.array([known.setdefault((s, *(v.tobytes() for v in w)), len(known)) for s, *w in own])
            first = np.unique(same, return_index=True)[1]
            for at in range(0, len(first), step):
                take = [own[i] for i in first[at : at + step]]
                f = np.stack([s * summed(np.stack([a, b], 1), p, n) if len(a) else np.full((n, n), np.nan) for s, a, b, p in take])
                places = np.repeat(np.arange(len(take)), n * n)
                made = pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.tile(x, len(take))), pa.array(np.tile(y, len(take))), pa.array(rounded(f.ravel(), digits), from_pandas=True)], ["sid", "x", "y", "field"])
                mine = np.flatnonzero((same >= at) & (same < at + len(take)))
                yield from shared(made, same[mine] - at, ids.take(pa.array(mine)))

    return waves.select("sid", "scale", "qx", "qy", "phase").mapInArrow(run, f"sid {kind}, x int, y int, field double")


def drawn(rng, stratum: tuple, n: int, dims: int):
    """(aniso, solid) of one attempt."""
    _, low, high = stratum
    frame = rotation(rng, dims)
    a = rng.uniform(low, high)
    b = rng.uniform(1.0, a) if dims == 3 else 1.0
    squash = np.array([1 / a, a]) if dims == 2 else np.array([1 / a, 1 / b, 1.0]) * (a * b) ** (1 / 3)  # keeps the volume
    porosity = rng.uniform(0.5, 0.8)
    q = wavevectors(rng, 40, 4.0, 1.0, frame, squash)
    f = field(q, rng.uniform(0.0, np.pi, len(q)), n)
    return float(a), (f > np.quantile(f, porosity)).astype(np.int8)


def made(samples: list[int], *, n: int, dims: int, seed: int, attempts: int) -> list[tuple]:
    """(stratum, aniso, porosity, tries, grid) of each sample: fields are drawn until the pore
    spans every axis, or the attempts are used up; then the grid is null. What spans is told for all at once."""
    rngs = [np.random.default_rng([seed, s]) for s in samples]
    out = [(STRATA[s % 3][0], None, None, attempts, None) for s in samples]
    left = list(range(len(samples)))
    for tries in range(1, attempts + 1):
        if not left:
            break
        fields = [drawn(rngs[i], STRATA[samples[i] % 3], n, dims) for i in left]
        through = spans(np.stack([solid for _, solid in fields]) == 0).all(1)
        for i, (a, solid) in zip(np.array(left)[through].tolist(), (f for f, ok in zip(fields, through) if ok)):
            out[i] = out[i][0], a, float(1 - solid.mean()), tries, solid.ravel()
        left = [i for i, ok in zip(left, through) if not ok]
    return out


def structure(sample: int, **how) -> tuple:
    """One sample of ``made``, its grid as a list."""
    *told, grid = made([sample], **how)[0]
    return *told, None if grid is None else grid.tolist()


def structures(ids: DataFrame, *, id_col: str = "sample_id", n: int = 64, dims: int = 2, seed: int = 0, attempts: int = 50) -> DataFrame:
    """(sid, stratum, aniso, porosity, tries, grid) for each id; grid is null where no attempt spanned."""
    kinds = [("sid", pa.int64()), ("stratum", pa.string()), ("aniso", pa.float64()), ("porosity", pa.float64()), ("tries", pa.int32()), ("grid", pa.list_(pa.int8()))]

    def work(batches):
        for batch in batches:
            sids = batch.column(0).to_pylist()
            step = max(1, CELLS // n**dims)
            for at in range(0, len(sids), step):
                some = sids[at : at + step]
                rows = [(i, *r) for i, r in zip(some, made(some, n=n, dims=dims, seed=seed, attempts=attempts))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [c for c, _ in kinds])

    return ids.selectExpr(f"cast({id_col} as bigint) as sid").where("sid is not null").mapInArrow(work, "sid long, stratum string, aniso double, porosity double, tries int, grid array<tinyint>")
