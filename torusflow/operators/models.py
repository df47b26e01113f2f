"""Cross-validated models of targets by feature vectors.

Sums of products, trees, metrics and predictions run over all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees


def arrays(embeddings: DataFrame, folds: int = 5) -> DataFrame:
    """(sample_id, x, y, fold): features and targets as arrays; null and non-finite vectors are left out."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col("label").isNotNull())
    y = F.array(F.col("label").cast("double"), (F.col("label") % 3).cast("double"))
    return rows.select(F.col("vec_id").alias("sample_id"), v.alias("x"), y.alias("y"), F.pmod(F.xxhash64("vec_id"), F.lit(folds)).cast("int").alias("fold"))


def vectors(embeddings: DataFrame) -> DataFrame:
    """(sample_id, features) for Spark's own models."""
    return arrays(embeddings).select("sample_id", array_to_vector("x").alias("features"))


def scores(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """n, r2, mae and mse by keys of (target, prediction); r2 is null where the target doesn't vary."""
    error = F.col("target") - F.col("prediction")
    sst = F.var_pop("target") * F.count("*")
    return predicted.groupBy(*keys).agg(F.count("*").alias("n"), (1 - F.sum(error * error) / F.nullif(sst, F.lit(0.0))).alias("r2"), F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"))


# -- boosted trees ---------------------------------------------------------------------


def boosted(rows: DataFrame, *, rounds: int = 1500, depth: int = 6, rate: float = 0.05, folds: int = 5, joint: bool = True, **how) -> DataFrame:
    """(mode, target, fold, n, r2, mae, mse) of trees for each target alone (single) and for all at once (joint).

    A fold's models are grown on all rows of the other folds and predict all rows of the fold.
    how: bins, ridge, hold, wait and every of ``trees.grown``.
    """
    first = rows.select("y").first()
    if first is None:
        return rows.sparkSession.createDataFrame([], "mode string, target int, fold int, n long, r2 double, mae double, mse double")
    models, edges = trees.grown(rows, targets=len(first["y"]), folds=list(range(folds)), joint=joint, rounds=rounds, depth=depth, rate=rate, **how)
    return scores(trees.predicted(rows, models, edges), ["mode", "target_no", "fold"]).withColumnRenamed("target_no", "target")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# -- linear models ---------------------------------------------------------------------


def products(rows: DataFrame) -> dict[int, np.ndarray]:
    """By fold the sums of products of (1, x, y) with itself: all that linear models need of the rows, in one pass.

    What comes to the driver grows with the squared number of columns, not with the rows.
    """

    def work(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, x, y = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)), _matrix(batch.column(2))
            z = np.concatenate([np.ones((len(x), 1)), x, y], 1)
            for f in np.unique(fold):
                own = z[fold == f]
                total[int(f)] = total.get(int(f), 0) + own.T @ own
        for f, m in total.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array([f] * m.size, pa.int32()), "k": np.arange(m.size), "v": m.ravel()})

    sums = rows.select("fold", "x", "y").mapInArrow(work, "fold int, k long, v double").groupBy("fold", "k").agg(F.sum("v").alias("v")).collect()
    out: dict[int, dict[int, float]] = {}
    for r in sums:
        out.setdefault(r["fold"], {})[r["k"]] = r["v"]
    return {f: np.array([m[k] for k in range(len(m))]).reshape(int(round(len(m) ** 0.5)), -1) for f, m in sorted(out.items())}


def _ridge(m: np.ndarray, targets: int, penalty: float, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets, of standardised columns, from sums of products."""
    n, p = m[0, 0], len(m) - 1 - targets
    mean = m[0, 1:] / n
    centred = m[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(centred)[:p] / n, 0))
    scale[scale < 1e-12] = 1.0
    a, b = centred[:p, :p] / np.outer(scale, scale), centred[:p, p:] / scale[:, None]
    if use is not None:
        a, b = a * np.outer(use, use), b * use[:, None]
    w = np.linalg.solve(a + penalty * np.eye(p), b) / scale[:, None]
    return w, mean[p:] - mean[:p] @ w


def _errors(m: np.ndarray, targets: int, w: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared errors and squared deviations of each target over the rows behind sums of products."""
    p = len(m) - 1 - targets
    full = np.concatenate([offset[None], w, -np.eye(targets)])
    sse = np.einsum("ij,ik,kj->j", full, m, full)
    n, sums = m[0, 0], m[0, 1 + p :]
    return np.maximum(sse, 0), np.maximum(np.diag(m)[1 + p :] - sums**2 / n, 0)


def ridge(rows: DataFrame, penalties=tuple(float(p) for p in np.logspace(-3, 4, 15)), targets: int = 2) -> DataFrame:
    """(fold, penalty, n, r2, mse): each fold's variance-weighted r2 over the targets and its mean
    squared error, at the penalty with the best mean r2 over folds. All penalties and folds take one pass over the rows."""
    sums = products(rows)
    whole = sum(sums.values()) if sums else None
    found = {}
    for penalty in penalties:
        for f, m in sums.items():
            if whole[0, 0] - m[0, 0] < 1:
                continue
            sse, sst = _errors(m, targets, *_ridge(whole - m, targets, penalty))
            found[penalty, f] = int(m[0, 0]), float(1 - sse.sum() / sst.sum()) if sst.sum() > 0 else None, float(sse.sum() / m[0, 0] / targets)
    mean = {p: np.mean([v[1] for (q, _), v in found.items() if q == p and v[1] is not None] or [-np.inf]) for p in penalties}
    best = max(penalties, key=lambda p: (mean[p], -p))
    out = [(f, p, *v) for (p, f), v in found.items() if p == best]
    return rows.sparkSession.createDataFrame(out, "fold int, penalty double, n long, r2 double, mse double")


def predictability(rows: DataFrame, ks=(1, 2, 5, 10, 20), penalty: float = 1.0, targets: int = 2) -> DataFrame:
    """(k, explained, r2): how much of the variance the first k main axes have, and the mean
    variance-weighted r2 over folds of a ridge model of these axes alone."""
    sums = products(rows)
    if not sums:
        return rows.sparkSession.createDataFrame([], "k int, explained double, r2 double")
    whole = sum(sums.values())
    n, p = whole[0, 0], len(whole) - 1 - targets
    mean = whole[0, 1 : 1 + p] / n
    cov = whole[1 : 1 + p, 1 : 1 + p] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-24))
    value, axes = np.linalg.eigh(cov / np.outer(scale, scale))
    value, axes = value[::-1], axes[:, ::-1] / scale[:, None]
    out = []
    for k in (k for k in ks if k <= p):
        turn = np.zeros((len(whole), 1 + k + targets))  # (1, x, y) to (1, axes, y)
        turn[0, 0] = 1.0
        turn[1 : 1 + p, 1 : 1 + k] = axes[:, :k]
        turn[1 + p :, 1 + k :] = np.eye(targets)
        r2 = []
        for m in sums.values():
            if whole[0, 0] - m[0, 0] < 1:
                continue
            sse, sst = _errors(turn.T @ m @ turn, targets, *_ridge(turn.T @ (whole - m) @ turn, targets, penalty))
            if sst.sum() > 0:  # a fold whose targets don't vary has no r2
                r2.append(float(1 - sse.sum() / sst.sum()))
        out.append((k, float(value[:k].sum() / value.sum()) if value.sum() > 0 else None, float(np.mean(r2)) if r2 else None))
    return rows.sparkSession.createDataFrame(out, "k int, explained double, r2 double")


# -- main axes -------------------------------------------------------------------------


def _width(rows: DataFrame) -> int:
    """How many features the rows have; 0 without rows."""
    first = rows.select("features").first()
    return len(first[0]) if first else 0


def spectrum(rows: DataFrame, k: int) -> DataFrame:
    """(component, ratio, total): the variance shares of the standardised features' main axes; none without rows."""
    size = _width(rows)
    if not size:
        return rows.sparkSession.createDataFrame([], "component int, ratio double, total double")
    k = min(k, size)
    scaled = StandardScaler(inputCol="features", outputCol="z", withMean=True).fit(rows).transform(rows)
    ratio = np.asarray(PCA(k=k, inputCol="z", outputCol="pcs").fit(scaled).explainedVariance)
    return rows.sparkSession.createDataFrame([(i + 1, float(r), float(t)) for i, (r, t) in enumerate(zip(ratio, np.cumsum(ratio)))], "component int, ratio double, total double")


def effective_rank(rows: DataFrame, k: int, share: float = 0.99) -> DataFrame:
    """How many axes reach the share of the variance."""
    return spectrum(rows, k).where(F.col("total") >= share - 1e-12).agg(F.min("component").alias("rank"))


def components(rows: DataFrame, k: int | None = None, train: int | None = None) -> DataFrame:
    """(sample_id, components): the first K main axes of each row, K = min(k, features, training rows - 1)."""
    size, n = _width(rows), train or rows.count()
    k = min(k or size, size, n - 1)
    if k < 1:  # no rows, or a single one, have no axes
        return rows.select("sample_id", F.array().cast("array<double>").alias("components"))
    scaled = StandardScaler(inputCol="features", outputCol="z", withMean=True).fit(rows).transform(rows)
    return PCA(k=k, inputCol="z", outputCol="pcs").fit(scaled).transform(scaled).select("sample_id", vector_to_array("pcs").alias("components"))
