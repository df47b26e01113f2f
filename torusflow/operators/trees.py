"""Boosted trees grown by Spark over all rows.

Trees are oblivious: a level has one split, of one feature, for all its leaves. A level is
one job. Its tasks add up, per leaf, feature and bin, the number of rows and the sums of
what is left of the targets; these histograms are added in a shuffle by model and block of
features, and each block reports its best split alone. What comes to the driver is a row a
model and block, whatever the number of rows, and no row is left out or sampled.

All models (a fold left out, a target alone or all at once) grow in the same jobs. What the
trees of a model have predicted so far is written with the rows every ``every`` rounds, and
trees since then are applied anew.

A model stops once its error on a hashed share of its training rows, which it isn't fitted
on, hasn't fallen for ``wait`` rounds, and keeps the trees up to its best one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import forgotten, stepped

#: Features of a block of a histogram; bins must fit a byte.
WIDTH = 16
#: Gains closer than this, relative to the largest, are ties: the first feature and cut count.
TIE = 1e-9


@dataclass
class Tree:
    splits: list[tuple[int, int]] = field(default_factory=list)
    values: np.ndarray | None = None

    def leaves(self, place: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(place), np.int64)
        for feature, cut in self.splits:
            at = at * 2 + (place[:, feature] > cut)
        return at


@dataclass
class Model:
    fold: int
    targets: list[int]
    mean: np.ndarray
    joint: bool = False
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    best: int = 0
    done: bool = False

    def predict(self, place: np.ndarray, trees: list[Tree] | None = None) -> np.ndarray:
        out = np.zeros((len(place), len(self.targets))) if trees is not None else np.tile(self.mean, (len(place), 1))
        for tree in self.trees[: self.best] if trees is None else trees:
            out += tree.values[tree.leaves(place)]
        return out


def bin_edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Per feature the values to cut at: all but the largest where there are at most ``bins`` distinct ones, else quantiles."""
    at = [float(i / bins) for i in range(1, bins)]
    long = rows.select(F.posexplode("x").alias("j", "v"))
    got = long.groupBy("j").agg(F.percentile_approx("v", at, 10_000).alias("q"), F.approx_count_distinct("v").alias("d")).collect()
    edges = {r["j"]: np.unique(r["q"]) for r in got}
    few = [r["j"] for r in got if r["d"] <= 2 * bins]  # the count is rough
    if few:
        values: dict[int, list] = {}
        for r in long.where(F.col("j").isin(few)).distinct().collect():
            values.setdefault(r["j"], []).append(r["v"])
        edges |= {j: np.unique(v)[:-1] for j, v in values.items() if len(v) <= bins}
    return [edges[j] for j in sorted(edges)]


def _matrix(column, kind=np.float64) -> np.ndarray:
    """Rows of numbers out of a column of bytes."""
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    return flat.reshape(len(column), -1)


def _columns(models: list[Model]) -> list[slice]:
    ends = np.cumsum([len(m.targets) for m in models])
    return [slice(int(e) - len(m.targets), int(e)) for e, m in zip(ends, models)]


KIND = "fold int, held boolean, place binary, y binary, pred binary"


def _binned(rows: DataFrame, edges: list[np.ndarray], models: list[Model], hold: float) -> DataFrame:
    start = np.concatenate([m.mean for m in models]) if models else np.zeros(0)

    def work(batches):
        for batch in batches:
            x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in (2, 3))
            place = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], 1).astype(np.uint8)
            first = [start.tobytes()] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in place], pa.binary()), pa.array([r.tobytes() for r in np.ascontiguousarray(y)], pa.binary()), pa.array(first, pa.binary())], ["fold", "held", "place", "y", "pred"])

    held = F.pmod(F.xxhash64("sample_id", F.lit("held")), F.lit(1 << 20)) < int(hold * (1 << 20))
    return rows.select(F.col("fold").cast("int").alias("fold"), held.alias("held"), "x", "y").mapInArrow(work, KIND)


def _moved(state: DataFrame, models: list[Model], since: int) -> DataFrame:
    """The rows with the trees since a round added to what was predicted."""
    columns = _columns(models)

    def work(batches):
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            place, pred = _matrix(column["place"], np.uint8), _matrix(column["pred"]).copy()
            for m, c in zip(models, columns):
                pred[:, c] += m.predict(place, m.trees[since:])
            rows = pa.array([r.tobytes() for r in pred], pa.binary())
            yield pa.RecordBatch.from_arrays([rows if n == "pred" else a for n, a in column.items()], list(column))

    return state.mapInArrow(work, KIND)


def histograms(state: DataFrame, models: list[Model], growing: dict[int, Tree], since: int, bins: int) -> DataFrame:
    """(m, block, sums): each task's histograms of the models that grow; block -1 has the error on the rows held back."""
    columns = _columns(models)

    def work(batches):
        total: dict[int, np.ndarray] = {}
        error = {m: np.zeros(2) for m in growing}
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            fold, held = column["fold"].to_numpy(), column["held"].to_numpy(zero_copy_only=False)
            place, y, pred = _matrix(column["place"], np.uint8), _matrix(column["y"]), _matrix(column["pred"])
            p = place.shape[1]
            wide = -(-p // WIDTH) * WIDTH
            spots = place.astype(np.int64) + np.arange(p) * bins
            for m, tree in growing.items():
                model = models[m]
                left = y[:, model.targets] - pred[:, columns[m]] - model.predict(place, model.trees[since:])
                mine = fold != model.fold
                if not tree.splits:
                    out = left[mine & held]
                    error[m] += [np.square(out).sum(), len(out)]
                use = np.flatnonzero(mine & ~held)
                leaves = 1 << len(tree.splits)
                at = (tree.leaves(place[use])[:, None] * (wide * bins) + spots[use]).ravel()
                size = leaves * wide * bins
                sums = [np.bincount(at, minlength=size)] + [np.bincount(at, np.repeat(t, p), size) for t in left[use].T]
                total[m] = total.get(m, 0) + np.stack(sums).reshape(len(sums), leaves, wide, bins)
        for m, sums in total.items():
            for b in range(0, sums.shape[2], WIDTH):
                yield _row(m, b // WIDTH, sums[:, :, b : b + WIDTH])
            if not growing[m].splits:
                yield _row(m, -1, error[m])

    return state.mapInArrow(work, "m int, block int, sums binary")


def _row(m: int, block: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([block], pa.int32()), pa.array([np.ascontiguousarray(sums, np.float64).tobytes()], pa.binary())], ["m", "block", "sums"])


def best_cut(sums: np.ndarray, known: np.ndarray, ridge: float) -> tuple[float, int, int] | None:
    """(gain, feature, cut) of a block's histograms (count and sums, leaves, features, bins); None without a cut."""
    below = sums.cumsum(3)
    every = below[:, :, :, -1:]
    gain = np.zeros(sums.shape[2:])
    for part in (below, every - below):
        gain += (np.square(part[1:]) / np.maximum(part[0] + ridge, 1e-12)).sum((0, 1))
    gain = np.where(known, gain, -np.inf)
    most = gain.max()
    if not np.isfinite(most):
        return None
    feature, cut = divmod(int(np.flatnonzero(gain.ravel() >= most - TIE * abs(most))[0]), sums.shape[3])
    return float(gain[feature, cut]), feature, cut


def splits(parts: DataFrame, models: list[Model], growing: dict[int, Tree], edges: list[np.ndarray], bins: int, ridge: float) -> DataFrame:
    """(m, block, gain, feature, cut, below, every): each block's best split, with the counts and sums of each leaf on its left and in all."""
    wide = -(-len(edges) // WIDTH) * WIDTH
    known = np.zeros((wide, bins), bool)
    for j, e in enumerate(edges):
        known[j, : len(e)] = True

    def chosen(m: int, block: int, flat: np.ndarray):
        if block < 0:
            return m, block, None, None, None, flat.tobytes(), None
        sums = flat.reshape(1 + len(models[m].targets), 1 << len(growing[m].splits), WIDTH, bins)
        best = best_cut(sums, known[block * WIDTH : (block + 1) * WIDTH], ridge)
        if best is None:
            return None
        gain, feature, cut = best
        own = sums[:, :, feature]
        return m, block, gain, block * WIDTH + feature, cut, own[:, :, : cut + 1].sum(2).tobytes(), own.sum(2).tobytes()

    def work(batches):
        key, total, out = None, None, []
        for batch in batches:  # in order of the keys
            for m, block, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (m, block) != key:
                    out += [chosen(*key, total)] if key else []
                    key, total = (m, block), 0
                total = total + np.frombuffer(data)
        out += [chosen(*key, total)] if key else []
        out = [r for r in out if r]
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["m", "block", "gain", "feature", "cut", "below", "every"])

    return parts.repartition("m", "block").sortWithinPartitions("m", "block").mapInArrow(work, "m int, block int, gain double, feature int, cut int, below binary, every binary")


def grown(rows: DataFrame, *, targets: int, folds: list[int], joint: bool = True, rounds: int, depth: int, rate: float, bins: int = 32, ridge: float = 3.0, hold: float = 0.15, wait: int = 50, every: int = 10) -> tuple[list[Model], list[np.ndarray]]:
    """Models of each fold left out and each target alone, and with ``joint`` all at once, and the edges of the bins. rows: (sample_id, x, y, fold)."""
    spark = rows.sparkSession
    if not 2 <= bins <= 256:
        raise ValueError("bins must fit a byte")
    edges = bin_edges(rows, bins)
    held = F.pmod(F.xxhash64("sample_id", F.lit("held")), F.lit(1 << 20)) < int(hold * (1 << 20))
    means = rows.where(~held).groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(F.col("y")[t]).alias(f"y{t}") for t in range(targets)]).collect()
    models = []
    for f in folds:
        n = sum(r["n"] for r in means if r["fold"] != f)
        for own, whole in [([t], False) for t in range(targets)] + ([(list(range(targets)), True)] if joint else []):
            mean = np.array([sum(r[f"y{t}"] for r in means if r["fold"] != f) / n if n else 0.0 for t in own])
            models.append(Model(f, own, mean, whole, done=not n))
    state, path = stepped(_binned(rows, edges, models, hold), "binned")
    since = 0
    for k in range(rounds + 1):
        growing = {m: Tree() for m, model in enumerate(models) if not model.done}
        if not growing:
            break
        sums = {}
        for level in range(depth if k < rounds else 1):
            got = splits(histograms(state, models, growing, since, bins), models, growing, edges, bins, ridge).collect()
            for r in got:
                if r["block"] < 0:
                    _judged(models[r["m"]], *np.frombuffer(r["below"]), k, wait)
            growing = {m: tree for m, tree in growing.items() if not models[m].done}
            best = {}
            for r in sorted((r for r in got if r["block"] >= 0), key=lambda r: (r["m"], r["block"])):
                if r["m"] in growing and (r["m"] not in best or r["gain"] > best[r["m"]]["gain"] * (1 + TIE)):
                    best[r["m"]] = r
            if k == rounds or not best:
                break
            for m, r in best.items():
                growing[m].splits.append((r["feature"], r["cut"]))
                below, whole = (np.frombuffer(r[c]).reshape(1 + len(models[m].targets), -1) for c in ("below", "every"))
                sums[m] = np.stack([below, whole - below], 2).reshape(len(below), -1)
        if k == rounds:
            break
        for m, tree in growing.items():
            if m not in sums:  # nothing to cut at
                models[m].done = True
                continue
            tree.values = rate * (sums[m][1:] / np.maximum(sums[m][0] + ridge, 1e-12)).T
            models[m].trees.append(tree)
            if not wait:
                models[m].best = k + 1
        if (k + 1) % every == 0 and k + 1 < rounds:
            moved, new = stepped(_moved(state, models, since), "boosted")
            forgotten(spark, path)
            state, path, since = moved, new, k + 1
    forgotten(spark, path)
    return models, edges


def _judged(model: Model, error: float, n: float, k: int, wait: int) -> None:
    """Takes note of the error after k trees; a model without rows held back keeps all its trees."""
    if not wait:
        return
    if not n:
        model.best = k
        return
    model.errors.append(error)
    if k == 0 or error < model.errors[model.best]:
        model.best = k
    elif k - model.best >= wait:
        model.done = True


def predicted(rows: DataFrame, models: list[Model], edges: list[np.ndarray]) -> DataFrame:
    """(mode, target, fold, truth, prediction) of every row by the models that its fold was left out of."""
    def work(batches):
        for batch in batches:
            fold = batch.column(0).to_numpy()
            x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in (1, 2))
            place = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], 1)
            for m in models:
                own = np.flatnonzero(fold == m.fold)
                if len(own):
                    out = m.predict(place[own])
                    for i, t in enumerate(m.targets):
                        yield pa.RecordBatch.from_pydict({"mode": ["joint" if m.joint else "single"] * len(own), "target_no": pa.array([t] * len(own), pa.int32()), "fold": pa.array(fold[own], pa.int32()), "target": y[own, t], "prediction": out[:, i]})

    return rows.select(F.col("fold").cast("int").alias("fold"), "x", "y").mapInArrow(work, "mode string, target_no int, fold int, target double, prediction double")
