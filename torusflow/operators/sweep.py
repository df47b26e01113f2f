"""How the settings of persistence images score: how many axes the images span, and how well features tell them.

All settings share one pass over the structures: a task turns a structure's bars into the
image of every setting and adds up the products of (1, features, pixels) by setting,
dimension and fold. Ranks, main axes and cross-validated fits follow from those sums alone.
Equal structures add the same, so a table of them can be told as different ones and their numbers (``lone``).
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import stepped
from .lattice import DEALT
from .models import _errors, _ridge
from .sums import added

#: The settings of the sweep; a range is (births, lengths) for each dimension.
WEIGHTS = ("const", "linear")
BANDWIDTHS = (1.0, 0.25, 0.125, 0.05, 0.025)
RANGES = {
    "shared 1.25": (((0.0, 1.25), (0.0, 1.25)), ((0.0, 1.25), (0.0, 1.25))),
    "perdim": (((0.0, 1.25), (0.0, 1.25)), ((0.0, 1.0), (0.0, 0.10))),
    "perdim tight": (((0.0, 1.0), (0.0, 1.25)), ((0.0, 1.0), (0.0, 0.10))),
}
#: Structures whose images are made at once.
BLOCK = 1000


def settings(sides: tuple[int, ...] = (10, 20)) -> list[tuple[int, str, str, float]]:
    """(side, weight, range, bandwidth) of every cell of the sweep."""
    return list(product(sides, WEIGHTS, RANGES, BANDWIDTHS))


def images(count: np.ndarray, birth: np.ndarray, length: np.ndarray, side: int, bandwidth: float) -> Callable[[str, tuple, tuple], np.ndarray]:
    """Of structures with so many bars each, one after the other: a function of (weight, births, lengths) that gives
    their images, a row each: weighted Gaussians at (birth, length), at the centres of the pixels.

    Structures of as many bars are one product; the Gaussians along an axis are kept for the settings that share them.
    """
    start, groups, known = np.cumsum(count) - count, [], {}
    for k in np.unique(count[count > 0]):
        own = np.flatnonzero(count == k)
        groups.append((own, start[own][:, None] + np.arange(k)))

    def bell(which: str, v: np.ndarray, r: tuple) -> np.ndarray:
        if (which, r) not in known:
            centre = r[0] + (np.arange(side) + 0.5) * (r[1] - r[0]) / side
            known[which, r] = np.exp(-((v[:, None] - centre) ** 2) / (2 * bandwidth**2))
        return known[which, r]

    def made(weight: str, births: tuple, lengths: tuple) -> np.ndarray:
        a, b, out = bell("birth", birth, births), bell("length", length, lengths), np.zeros((len(count), side * side))
        if weight == "linear":
            a = a * length[:, None]
        for own, bars in groups:
            out[own] = (a[bars].transpose(0, 2, 1) @ b[bars]).reshape(len(own), -1)
        return out / (2 * np.pi * bandwidth**2)

    return made


def scored(sums: list[np.ndarray], features: int, axes: int = 3, most: int = 60, share: float = 0.99, penalty: float = 1.0) -> tuple[int | None, float | None, float | None]:
    """(rank, first axis's share, r2) from the sums of products of (1, features, pixels) by fold.

    rank: main axes of the standardised pixels up to the share of the variance that the first
    ``most`` have; r2: mean over the first axes of ridge fits of the features, out of fold.
    Pixels that vary by less than 1e-7 of their mean, or 1e-150, count as constant.
    """
    whole = sum(sums)
    n, p = whole[0, 0], features
    q = len(whole) - 1 - p
    if n < 2:
        return None, None, None
    mean = whole[0, 1 + p :] / n
    cov = whole[1 + p :, 1 + p :] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    still = scale <= np.maximum(1e-7 * np.abs(mean), 1e-150)
    scale[still] = np.inf
    value, turn = np.linalg.eigh(cov / np.outer(scale, scale))
    value, turn = np.maximum(value[::-1], 0), turn[:, ::-1] / scale[:, None]
    if q - still.sum() < axes or value.sum() <= 0:
        return None, None, None
    kept = np.cumsum(value[: int(min(most, q, n - 1))]) / value.sum()
    rank = int(np.searchsorted(kept, share)) + 1
    move = np.zeros((len(whole), 1 + p + axes))  # (1, features, pixels) to (1, features, axes)
    move[: 1 + p, : 1 + p] = np.eye(1 + p)
    move[1 + p :, 1 + p :] = turn[:, :axes]
    small = [move.T @ m @ move for m in sums]
    total, error = sum(small), np.zeros(axes)
    for m in small:
        if 0 < m[0, 0] < n:
            error += _errors(m, axes, *_ridge(total - m, axes, penalty))[0]
    spread = np.diag(total)[1 + p :] - total[0, 1 + p :] ** 2 / n
    return rank, float(value[0] / value.sum()), float(np.mean(1 - error / spread))


def _times(folds: int) -> list:
    """Whether an id is in each fold, as 0 or 1."""
    fold = F.pmod(F.xxhash64("sid", F.lit("fold")), F.lit(folds))
    return [(fold == f).cast("long") for f in range(folds)]


def lone(packed: DataFrame, folds: int = 4) -> DataFrame:
    """(sid, grid, times): each different structure of (sid, grid) once, with a number of its own, and how many ids of
    each fold have it. A structure without an id or a grid is left out."""
    rows = packed.where("sid is not null and grid is not null").groupBy("grid").agg(*[F.sum(t).alias(f"__{f}") for f, t in enumerate(_times(folds))])
    rows = rows.select(F.monotonically_increasing_id().alias("sid"), "grid", F.array(*[f"__{f}" for f in range(folds)]).alias("times"))
    rows, _ = stepped(rows, "structures")  # or their numbers would change when they are made again
    # In turn and to a number of tasks of its own, as a few structures that are much work would be put together.
    return rows.repartition(DEALT * packed.sparkSession.sparkContext.defaultParallelism)


def sweep(bars: DataFrame, features: DataFrame, *, sides: tuple[int, ...] = (10, 20), folds: int = 4) -> DataFrame:
    """A row a setting: weight, bandwidth, range, side, then rank, share and r2 of the images in dimensions 0 and 1.

    bars: (sid, dim, birth, death); features: (sid, x), all of one length. A structure without
    bars has empty images; one without features takes no part. Where features have ``times``, a structure
    stands for so many of each fold; else for itself, in the fold of its id.
    """
    spark, cells = features.sparkSession, settings(sides)
    features, _ = stepped(features, "features")  # read for their length, and again
    first = features.select("x").first()
    kinds = "weight string, bandwidth double, range string, side int, " + ", ".join(f"h{d}_rank int, h{d}_share double, h{d}_r2 double" for d in (0, 1))
    if first is None:
        return spark.createDataFrame([], kinds)
    p = len(first["x"])
    # The bars of one structure are few, but those of all are many more than their estimate tells: the join is merged.
    own = bars.where("dim in (0, 1)").groupBy("sid").agg(F.collect_list(F.struct("dim", "birth", "death")).alias("bars"))
    times = F.col("times") if "times" in features.columns else F.array(*_times(folds))
    rows = features.join(own.hint("merge"), "sid", "left").select("x", "bars", times.alias("times"))
    shared: dict[tuple[int, float], list[tuple[int, str, str]]] = {}
    for i, (side, weight, name, bandwidth) in enumerate(cells):
        shared.setdefault((side, bandwidth), []).append((i, weight, name))

    def work(batches):
        total: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x, times = (c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in (batch.column(0), batch.column(2)))
                known, fixed = batch.column(1).flatten(), np.concatenate([np.ones((len(x), 1)), x], 1)
                dims, births, deaths = (pc.struct_field(known, c).to_numpy(zero_copy_only=False) for c in ("dim", "birth", "death"))
                place = np.repeat(np.arange(len(x)), pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
                for dim in (0, 1):
                    own = dims == dim
                    bars = np.bincount(place[own], minlength=len(x)), births[own], deaths[own] - births[own]
                    for (side, bandwidth), settled in shared.items():
                        made = images(*bars, side, bandwidth)
                        for i, weight, name in settled:
                            z = np.concatenate([fixed, made(weight, *RANGES[name][dim])], 1)
                            for f in range(folds):
                                part, n = z[times[:, f] > 0], times[times[:, f] > 0, f]
                                if len(n):
                                    total[i, dim, f] = total.get((i, dim, f), 0) + part.T @ (part * n[:, None])
        for key, m in total.items():
            yield pa.RecordBatch.from_pydict({c: pa.array([v], pa.int32()) for c, v in zip(("cell", "dim", "fold"), key)} | {"sums": pa.array([m.tobytes()], pa.binary())})

    sums = added(rows.mapInArrow(work, "cell int, dim int, fold int, sums binary"), ["cell", "dim", "fold"])

    def solve(table: pa.Table) -> pa.Table:
        ordered = sorted(zip(table.column("fold").to_pylist(), table.column("sums").to_pylist()))
        size = int(round((len(ordered[0][1]) / 8) ** 0.5))
        rank, share, r2 = scored([np.frombuffer(m).reshape(size, size) for _, m in ordered], p)
        return pa.table({"cell": table.column("cell")[:1], "dim": table.column("dim")[:1], "rank": pa.array([rank], pa.int32()), "share": pa.array([share], pa.float64()), "r2": pa.array([r2], pa.float64())})

    solved = sums.groupBy("cell", "dim").applyInArrow(solve, "cell int, dim int, rank int, share double, r2 double")
    named = spark.createDataFrame([(i, w, b, n, s) for i, (s, w, n, b) in enumerate(cells)], "cell int, weight string, bandwidth double, range string, side int")
    of = lambda d, c: F.max(F.when(F.col("dim") == d, F.col(c))).alias(f"h{d}_{c}")
    wide = solved.groupBy("cell").agg(*[of(d, c) for d in (0, 1) for c in ("rank", "share", "r2")])
    return named.join(wide, "cell").drop("cell")
