"""Language identification with error-correcting output codes (operator 1).

Each language has a codeword of bits. One binary classifier for each bit, over hashed
byte n-grams of the lower-cased text, predicts that bit. Loss-weighted decoding takes the
language whose codeword costs the least logistic loss, each bit weighed for each language
by how often its classifier is right on that language's training texts, and flags a text
as ambiguous when the runner-up is nearly as near.

Edge cases: a text that is null or has no letter is ``und`` with score 0; without any
labelled row all texts are ``und``; with one language every text with a letter gets it;
equal losses go to the language that sorts first; input columns that are named like an
output are ignored unless kept; repeated rows give repeated results; texts that occur
under two languages are fitted under both. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .sample import SPAN, held_out, spread

ORDERS, BITS, CHUNK = (1, 2, 3), 13, 1 << 20
UNKNOWN = "und"


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 for each of n languages: all splits for up to 7, else the best of some random codes."""
    if n <= 1:
        return np.ones((n, 0), np.float32)
    if n <= 7:
        columns = range(1, 1 << (n - 1))
        return np.array([[1 if i == 0 or not c >> (i - 1) & 1 else -1 for c in columns] for i in range(n)], np.float32)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, int(np.ceil(10 * np.log2(n)))))
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class Model:
    """languages in order, their codewords, and for each bit the weights of hashed n-grams."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    #: Of each bit for each language; the mean over a language's bits is 1.
    trust: np.ndarray

    def margins(self, doc: np.ndarray) -> np.ndarray:
        """Of a lower-cased text in bytes: the output of each bit's classifier."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for at in range(0, max(1, len(doc)), CHUNK):
            for order in ORDERS:
                # The overlap keeps n-grams across chunks; a chunk shorter than n is padded once.
                part = doc[at : at + CHUNK + order - 1]
                if at and len(part) < order:
                    continue
                h = kernel.grams(part, order, BITS)
                total += self.weights[h].sum(0)
                n += len(h)
        return total / max(n, 1) + self.bias

    def decode(self, margins: np.ndarray) -> tuple[int, float, float]:
        """The nearest codeword's row, its share of the likelihood, and the lead over the next."""
        if len(self.languages) == 1:
            return 0, 1.0, 1.0
        losses = (self.trust * np.logaddexp(0, -self.code * margins)).sum(1)
        share = np.exp(losses.min() - losses)
        share /= share.sum()
        best = int(np.argmin(losses))
        rest = np.delete(share, best)
        return best, float(share[best]), float(share[best] - rest.max())


def _train(texts: list[str], langs: list[str], rounds: int = 120) -> Model:
    languages = sorted(set(langs))
    code = codewords(len(languages))
    x = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, doc in enumerate(kernel.lowered(pa.array(texts, pa.string()))):
        n = 0
        for order in ORDERS:
            h = kernel.grams(doc, order, BITS)
            x[i] += np.bincount(h, minlength=1 << BITS)
            n += len(h)
        x[i] /= n
    rank = {y: i for i, y in enumerate(languages)}
    y = code[[rank[v] for v in langs]]
    scale = np.float32(1) / (x.std(0) + np.float32(1e-4))
    x *= scale
    mean = x.mean(0)
    x -= mean
    w, b = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    step = np.float32(0.5 / (1 + np.square(x).sum(1).max() / 4))
    for _ in range(rounds):
        g = -y * kernel.sigmoid(-(y * (x @ w + b))).astype(np.float32)
        w -= step * (x.T @ g + np.float32(1e-3) * w)
        b -= np.float32(0.5) * g.mean(0)
    right = y * (x @ w + b) > 0
    own = np.array([rank[v] for v in langs])
    trust = np.array([right[own == i].mean(0) for i in range(len(languages))])
    trust = (trust + 1e-6) / (trust + 1e-6).mean(1, keepdims=True) if code.shape[1] else trust
    w = w * scale[:, None]
    return Model(languages, code, w, b - (mean / scale) @ w, trust)


def fit(rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_rows: int = 2000, max_languages: int = 500) -> Model:
    """Fits on about max_rows texts, dealt evenly over the languages (four texts each at least).

    Both bounds are parameters of the fit only; prediction reads whole texts. Sampling goes
    by a hash of the text. More languages than max_languages are refused: the column would
    not hold languages then.
    """
    rows = rows.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("y")).where("y is not null and t <> ''")
    found = rows.groupBy("y").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not found:
        return Model([], np.ones((0, 0), np.float32), np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32), np.zeros((0, 0)))
    each = max(4, max_rows // len(found))
    rate = F.lit(0)
    for r in found:
        rate = F.when(F.col("y") == r["y"], F.lit(int(min(1.0, (1.2 * each + 30) / r["n"]) * SPAN))).otherwise(rate)
    got = rows.withColumn("h", spread("t")).where(F.col("h") < rate).dropDuplicates(["t", "y"]).collect()
    got.sort(key=lambda r: (r["y"], r["h"], r["t"]))
    texts, langs, seen = [], [], {}
    for r in got:
        seen[r["y"]] = seen.get(r["y"], 0) + 1
        if seen[r["y"]] <= each:
            texts.append(r["t"])
            langs.append(r["y"])
    return _train(texts, langs)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False, ambiguous_below: float = 0.05) -> DataFrame:
    """Per row: the id, the columns to keep, lang_pred, score, margin and ambiguous."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col), *[F.col(c) for c in keep], has_letter.alias("__letter"), F.col(text_col).alias("__text"))
    kept = len(keep) + 1
    names = [f.name for f in rows.schema.fields[:kept]]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:kept])
    out += ", `__text` string" * with_text + ", lang_pred string, score double, margin double, ambiguous boolean"

    def work(batches):
        m = shared.value
        for batch in batches:
            letters = batch.column(kept).to_pylist()
            lang, score, margin = [], [], []
            for has, doc in zip(letters, kernel.lowered(batch.column(kept + 1))):
                if not has or not m.languages:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    margin.append(0.0)
                    continue
                best, p, lead = m.decode(m.margins(doc))
                lang.append(m.languages[best])
                score.append(p)
                margin.append(lead)
            columns = [*batch.columns[:kept], *([batch.column(kept + 1)] * with_text), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([x < ambiguous_below for x in margin], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *(["__text"] * with_text), "lang_pred", "score", "margin", "ambiguous"])

    return rows.mapInArrow(work, out)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "text", "lang", held_out("doc_id", 3, 1).alias("held_out"))
    model = fit(docs.where("not held_out"))
    return predict(docs, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "margin", "ambiguous")
