"""Audit of how filters act together, by packed bitmaps (operator 13).

Five filters are decided once for every document. The decisions are turned into bitsets, a
run of a task's rows at a time: one bit a document for each filter and each label, rows of a
part side by side. A document is removed at a step if its filter fails it and no filter
before does, so all orders are told by the subsets of filters that come before: per subset
the bits of its filters are joined by OR, and AND-NOT with popcount counts what a filter
would remove after them. These counts (parts * 80 rows a run) are summed by Spark, and the
120 orders pick theirs from the 32 subsets.

Copies: the smallest id of each distinct text (by a hash of 128 bits) is found by one
aggregation, and a document passes if the smallest id of its text is its own. That join is on
the text's hash and the id together, so a text that a third of all documents share is
spread over all tasks.

Edge cases: null texts are empty; rows that repeat id and text are each as good as the other
(neither has a smaller id); a row without an id has no smaller one and is nobody's smaller
one; a document whose labels table has several rows is good or toxic if any says so, one
without a row is neither; a null part is the empty string; texts are read whole; extra
columns are ignored; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
UPPER, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: The bit of the filter that needs the whole table, and of the labels.
COPY, GOOD, TOXIC = 16, 32, 64


def failed(text: str) -> int:
    """The bits of A to D that a text fails."""
    data = text.encode()
    words = data.split()  # at ASCII white space
    few = len(words) < 200
    same = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(data) - len(data.translate(None, UPPER))) > 3 * len(text)
    marked = len(data.translate(None, MARKS)) < len(data)
    return few | same << 1 | loud << 2 | marked << 3


def decided(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, bits) of every document: failed filters, then GOOD and TOXIC."""

    def work(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode()) for t in texts), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array([failed(t) for t in texts], pa.int32())], ["id", "part", "high", "low", "bits"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    rows = written(given.mapInArrow(work, "id long, part string, high long, low long, bits int"), "decided")
    named = rows.where("id is not null")
    first = named.groupBy("high", "low").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), *(F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in ("quality", "toxic"))).where("id is not null")
    marks = marks.groupBy("id").agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    bit = lambda c, value: F.when(c, value).otherwise(0)
    named = named.join(first, ["high", "low", "id"], "left").join(marks, "id", "left")
    named = named.select("part", (F.col("bits") + bit(F.col("first").isNull(), COPY) + bit(F.col("good"), GOOD) + bit(F.col("toxic"), TOXIC)).alias("bits"))
    return named.unionByName(rows.where("id is null").select("part", "bits"))


def bitmaps(rows: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, n, fails, good, toxic): bitsets over runs of a task's rows; fails has one for each filter."""
    count = filters

    def work(batches):
        for batch in batches:
            code = batch.column(0).dictionary_encode()
            part, bits = code.indices.to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(part, kind="stable")
            part, bits = part[order], bits[order]
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(1, int)
            out = []
            for a, b in zip(edges[:-1], edges[1:]):
                sets = [np.packbits(bits[a:b] >> i & 1).tobytes() for i in range(count + 2)]
                out.append((code.dictionary[int(part[a])].as_py(), int(b - a), sets[:count], sets[count], sets[count + 1]))
            kinds = (pa.string(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["part", "n", "fails", "good", "toxic"])

    return rows.mapInArrow(work, "part string, n long, fails array<binary>, good binary, toxic binary")


def _words(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(-len(data) % 8), np.uint64)


def counted(fails: list[np.ndarray], good: np.ndarray, toxic: np.ndarray, n: int) -> list[tuple]:
    """(subset, filter, counts) for every subset of filters and every filter outside it."""
    pop = lambda x: int(np.bitwise_count(x).sum())
    either = [np.zeros_like(good)]
    for subset in range(1, 1 << len(fails)):
        low = (subset & -subset).bit_length() - 1
        either.append(either[subset & (subset - 1)] | fails[low])
    gone, whole, every = [pop(x) for x in either], [pop(x) for x in fails], len(either) - 1
    out = []
    for subset, before in enumerate(either):
        for f, own in enumerate(fails):
            if not subset >> f & 1:
                lost = own & ~before
                removed = pop(lost)
                only = gone[every] - gone[every ^ 1 << f]
                out.append((subset, f, n - gone[subset | 1 << f], removed, whole[f] - removed, only, pop(lost & good), pop(lost & toxic)))
    return out


def audit(index: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step: COUNTS and shapley, from ``bitmaps``."""
    spark, m = index.sparkSession, len(filters)

    def work(batches):
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            out = []
            for part, n, fails, good, toxic in zip(*(column[c].to_pylist() for c in ("part", "n", "fails", "good", "toxic"))):
                out += [(part, *r) for r in counted([_words(x) for x in fails], _words(good), _words(toxic), n)]
            kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * len(COUNTS))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["part", "subset", "filter", *COUNTS])

    cells = index.mapInArrow(work, "part string, subset int, filter int, " + ", ".join(f"{c} long" for c in COUNTS))
    sums = cells.groupBy("part", "subset", "filter").agg(*(F.sum(c).alias(c) for c in COUNTS))
    steps = []
    for order in permutations(range(m)):
        name, subset = "".join(filters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            steps.append((subset, f, name, step, factorial(step - 1) * factorial(m - step)))
            subset |= 1 << f
    steps = spark.createDataFrame(steps, "subset int, filter int, filter_order string, step int, orders long")
    # A filter comes after a subset in so many orders; of a part it has half of all subsets.
    weight = steps.select("subset", "filter", "orders").distinct()
    told = sums.join(F.broadcast(weight), ["subset", "filter"]).withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "filter")))
    return told.drop("orders").join(F.broadcast(steps), ["subset", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(bitmaps(decided(docs, labels)))


ORACLE = """
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM docs
), marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT d.doc_id, part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    CAST(len(w) < 200 AS INTEGER) AS a, CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER) AS b,
    CAST(100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text) AS INTEGER) AS c,
    CAST(length(translate(text, '#$%&*|', '')) < length(text) AS INTEGER) AS d, CAST(coalesce(d.doc_id > least, false) AS INTEGER) AS e
  FROM words d LEFT JOIN marks m ON m.doc_id = d.doc_id
), groups AS (
  SELECT part, good, toxic, a, b, c, d, e, a + 2 * b + 4 * c + 8 * d + 16 * e AS bits, count(*) AS n FROM fails GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS v
), orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, l.v AS own,
    coalesce((SELECT sum(v) FROM letters b WHERE contains(substr(filter_order, 1, step - 1), b.l)), 0) AS before
  FROM orders, range(1, 6) s(step), letters l WHERE l.l = substr(filter_order, step, 1)
), counts AS (
  SELECT part, filter_order, step, own,
    CAST(coalesce(sum(n) FILTER (WHERE bits & CAST(before AS INTEGER) = 0 AND bits & own = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE bits & CAST(before AS INTEGER) = 0 AND bits & own > 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE bits & CAST(before AS INTEGER) > 0 AND bits & own > 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE bits = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (WHERE bits & CAST(before AS INTEGER) = 0 AND bits & own > 0 AND good = 1), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (WHERE bits & CAST(before AS INTEGER) = 0 AND bits & own > 0 AND toxic = 1), 0) AS BIGINT) AS toxic_lost
  FROM groups, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counts
"""
