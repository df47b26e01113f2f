"""Quality classifier: Naive Bayes support vectors (operator 4).

Indicators of hashed n-grams (of bytes, and of which words repeat the one before) are scaled by the log-count ratio of the two classes
and, per text, to unit length; dual coordinate descent fits a linear hinge-loss model;
a logistic curve on held-back margins, weighted to the classes' true shares, turns
margins into scores.

Edge cases: null and empty texts have the single indicator of a blank n-gram and get a
score like any text; without labelled rows of both classes the score is the share of
class 1 among the labelled rows (0.5 if there is none); texts with both labels count with
both, and equal texts get equal scores; extra columns are ignored;
repeated rows give repeated results; ids that are null get a score too. Texts are read
whole, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .sample import held_out, labelled, remainder

#: Lengths of byte n-grams, of n-grams of repeats, bits of a hash, bytes at a time.
ORDERS, REPEATS, BITS, CHUNK = (2, 3, 4), (1, 2, 3, 4), 16, 1 << 20


def indicators(doc: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of a text in bytes: of its bytes, and of the sequence that
    tells for each word whether it repeats the word before."""
    seen = np.zeros(1 << BITS, bool)
    for at in range(0, max(1, len(doc)), CHUNK):
        for order in ORDERS:
            seen[kernel.grams(doc[at : at + CHUNK + order - 1], order, BITS)] = True
    w = kernel.words(doc)
    same = (w[1:] == w[:-1]).astype(np.uint64)
    for order in REPEATS:
        if len(same) >= order:
            code = sum(same[j : len(same) - order + 1 + j] << np.uint64(j) for j in range(order)) + np.uint64(1000 * order)
            seen[(kernel.mix(np.unique(code)) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    """weight: of an indicator in the margin; square: its squared scale; curve: slope and offset."""

    weight: np.ndarray = field(repr=False)
    square: np.ndarray = field(repr=False)
    curve: tuple[float, float]

    def margin(self, found: np.ndarray) -> float:
        norm = np.sqrt(self.square[found].sum(dtype=np.float64))
        return float(self.weight[found].sum(dtype=np.float64) / norm) if norm > 0 else 0.0

    def score(self, doc: np.ndarray) -> float:
        return float(kernel.sigmoid(self.curve[0] * self.margin(indicators(doc)) + self.curve[1]))


def dual_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, rounds: int, rng) -> np.ndarray:
    """Weights of the hinge-loss model, one dual variable at a time; x: unit vectors as (places, values)."""
    w, alpha = np.zeros(size), np.zeros(len(x))
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x)):
            at, value = x[i]
            gradient = y[i] * (w[at] @ value) - 1
            new = min(max(alpha[i] - gradient, 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * value
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve, by Newton steps with a slight pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = kernel.sigmoid(a * margin + b)
        g = weight * (p - y)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * margin).sum() + 1e-2 * (a - 1), g.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-2, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(texts: list[str], labels: list[int], share: float, *, smooth: float = 1.0, cost: float = 1.0, rounds: int = 30, seed: int = 3) -> Model:
    """share: of class 1 among all labelled rows."""
    size, y = 1 << BITS, np.array(labels)
    if len(set(labels)) < 2:
        edge = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(size), np.zeros(size), (0.0, float(np.log(edge / (1 - edge)))))
    found = [indicators(doc).astype(np.int32) for doc in kernel.documents(pa.array(texts, pa.string()))]
    rng = np.random.default_rng(seed)
    back = rng.random(len(y)) < 0.25
    if len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        back[:] = False
    fit = np.flatnonzero(~back)
    p, q = np.full(size, smooth), np.full(size, smooth)
    for i in fit:
        (p if y[i] else q)[found[i]] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(p + q) < 2 * smooth + 3] = 0  # too rare to tell
    x = []
    for i in fit:
        v = ratio[found[i]]
        x.append((found[i], v / max(np.sqrt(v @ v), 1e-12)))
    sign = 2.0 * y[fit] - 1
    counts = np.array([(sign < 0).sum(), (sign > 0).sum()])
    w = dual_descent(x, sign, size, cost * len(fit) / (2 * counts[(sign > 0).astype(int)]), rounds, rng)
    model = Model((ratio * w).astype(np.float32), np.square(ratio).astype(np.float32), (1.0, 0.0))
    held = np.flatnonzero(back) if back.any() else fit
    margin = np.array([model.margin(found[i]) for i in held])
    here = y[held].mean()
    model.curve = logistic(margin, y[held], np.where(y[held] == 1, share / here, (1 - share) / (1 - here)))
    return model


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2500) -> Model:
    """Fits on about per_class labelled texts of each class at most, read whole."""
    rows = labels.where(F.col(label_col).isin(0, 1))
    texts, y, share = sampled(docs, rows, id_col, text_col, label_col, per_class)
    return train(texts, y, share)


def sampled(docs, rows, id_col, text_col, label_col, per_class):
    """Texts, labels and the share of label 1 among all rows. The two tables' ids may be of any one type."""
    spark = docs.sparkSession
    totals = rows.agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    keys = [(k, int(v)) for k, v in labelled(rows, id_col, label_col, per_class)]
    if not keys:
        return [], [], 0.5 if totals is None else totals
    # At most two times per_class rows: safe to broadcast.
    small = spark.createDataFrame(keys, f"k {rows.schema[id_col].dataType.simpleString()}, y int").distinct()
    got = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(small), "k").select("k", "t", "y").collect()
    got.sort(key=lambda r: (r["k"], r["y"], r["t"]))
    return [r["t"] for r in got], [r["y"] for r in got], float(totals)


def score(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.3, lower: bool = False) -> DataFrame:
    """Per row: the id, the columns to keep, score, and predicted (score at the threshold or above)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), *[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    fields = rows.schema.fields[:-1]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int"
    names = [*(f.name for f in fields), "score", "predicted"]

    def work(batches):
        m = shared.value
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            scores = [m.score(doc) for doc in (kernel.lowered(text) if lower else kernel.documents(text))]
            columns = [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(work, out)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    model = fit(docs, labels)
    return score(docs.withColumn("held_out", held_out("doc_id", 5, 0)), model, keep=("held_out",))
