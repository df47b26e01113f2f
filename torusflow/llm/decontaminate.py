"""Benchmark decontamination by SimHash windows (operator 10, built-in functions only).

A document is compared with every benchmark item through windows of the item's own
number of words. Similarity is that of multisets of five-word shingles, shared count by
count of the union, at ``SIMILAR`` or more.

1. One pass over the documents hashes words and shingles and keeps a document only if,
   within the length of the longest item, as many of its shingles pass a Bloom filter of
   all items' shingles as the shortest item needs. A window below that bound can't reach
   the similarity, so nothing is lost.
2. In the distinct texts kept, windows of each size that items have start at shingles
   which occur in items of that size: a window that starts elsewhere can be moved to the
   next such shingle without losing one. Windows with too few of them for the similarity
   are left out, by an exact bound. Which item it could be is left open here.
3. Each window gets a 64-bit SimHash. Fingerprints are cut into four blocks of 16 bits.
   Two fingerprints within RADIUS = 11 differ by at most two bits in one of the blocks
   at least (four blocks with three would be twelve), so an item is filed under every
   value within two bits of its blocks, 137 a block, and a window looks up its own four.
   That meets every item within the radius, and 4 * 137 / 65536 = 0.8 % of random ones.
4. The exact similarity of shingle counts decides.
5. Windows beyond the radius have an exact way of their own. At similarity 0.8
   fingerprints differ by 9.7 bits on average with a standard deviation of 2.9, so the
   radius alone would lose about a third of the windows right at the threshold (the test
   measures it). A window at the similarity must share one of the item's n - need + 1
   rarest shingles (need: the least shared count); pairs that meet in one of these and lie
   beyond the radius are verified as well.

Edge cases: null reads as empty; items without a word are left out; items with fewer
than five words are one shingle; a document shorter than an item is one window; repeated
rows of one document count once, and rows that repeat an id with other words each have
their windows, of which the best counts; a null id is a document of its own kind and is
reported as null; items that repeat an item_id are each compared, and the best counts; of
windows with equal similarity the earliest that begins with such a shingle (or ends the
document) is reported; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

SIMILAR, SHINGLE = 0.8, 5
#: Blocks of a fingerprint, bits of a block, and bits that a block may differ by.
BLOCKS, WIDTH, FLIPS = 4, 16, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Up to so many rows a lookup table is broadcast (some 100 MB); beyond, the join is left to Spark.
BROADCAST = 1_000_000
#: Copies of a lookup table's entries where it isn't broadcast.
SALT = 16
#: Bits of the Bloom filter: 128 to 256 a shingle, at least 2**14 and at most 2**27 (16 MB).
BLOOM = (14, 27)


def hashed(text: Column) -> Column:
    """A hash of each word; words are runs of letters and digits, in lower case."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))


def grams(words: str, k: int) -> Column:
    """A hash of each k consecutive words of a column of hashed words."""
    h = F.col(words)
    every = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
    return F.slice(every, F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(0)))


def once(column: Column) -> Column:
    """The value as a column that is made once: a plain one would be made anew wherever it is used."""
    return F.explode(F.array(column))


def fingerprint(shingles: Column, wide: bool) -> Column:
    """The SimHash: each bit is the majority of the shingles' bits.

    Four counters of 16 bits (two of 32, if windows are that long) share a long; shifted
    shingles are masked and added, so 16 (32) sums count all 64 bits.
    """
    lane = 32 if wide else 16
    mask = sum(1 << s for s in range(0, 64, lane))
    n = F.size(shingles)

    def lane_sum(i: int) -> Column:
        return F.aggregate(shingles, F.lit(0).cast("bigint"), lambda a, x: a + F.shiftrightunsigned(x, i).bitwiseAND(F.lit(mask)))

    sums = [lane_sum(i) for i in range(lane)]
    out = F.lit(0).cast("bigint")
    for i, total in enumerate(sums):
        for at in range(0, 64, lane):
            count = F.shiftrightunsigned(total, at).bitwiseAND(F.lit((1 << lane) - 1))
            bit = np.uint64(1 << (i + at)).astype(np.int64).item()
            out = out.bitwiseOR(F.when(count * 2 > n, F.lit(bit)).otherwise(F.lit(0).cast("bigint")))
    return out


def blocks(print_: Column) -> Column:
    """The fingerprint's blocks as (block, value)."""
    parts = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(print_, i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int").alias("value")) for i in range(BLOCKS)]
    return F.array(*parts)


def masks() -> list[int]:
    """All patterns of up to FLIPS bits of a block."""
    return [sum(1 << b for b in bits) for k in range(FLIPS + 1) for bits in combinations(range(WIDTH), k)]


def bloom(shingles: DataFrame, bits: int) -> DataFrame:
    """One row with a Bloom filter of 2**bits bits (two for each shingle s) as an array of longs."""
    words = 1 << (bits - 6)
    spots = shingles.select(F.explode(F.array(*[_spot(F.col("s"), i, bits) for i in range(2)])).alias("p"))
    part = spots.groupBy(F.shiftrightunsigned("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    every = shingles.sparkSession.range(words).withColumnRenamed("id", "word").join(part, "word", "left")
    cells = F.array_sort(F.collect_list(F.struct("word", F.coalesce("v", F.lit(0).cast("long")).alias("v"))))
    return every.agg(F.transform(cells, lambda c: c["v"]).alias("filter"))


def _spot(shingle: Column, i: int, bits: int) -> Column:
    return F.shiftrightunsigned(shingle, i * 32).bitwiseAND(F.lit((1 << bits) - 1))


def _passes(table: str, bits: int):
    def test(x):
        both = None
        for i in range(2):
            p = _spot(x, i, bits)
            bit = F.getbit(F.get(F.col(table), F.shiftrightunsigned(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
            both = bit if both is None else both & bit
        return both

    return test


def _small(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def _looked_up(many: DataFrame, table: DataFrame, on: list[str], by: str, rows: int, most: int) -> DataFrame:
    """The join with a lookup table by shingle: broadcast up to ``most`` rows; beyond, each shingle's rows are dealt by
    the column ``by`` to SALT copies of its entry, so that a shingle of every document is no hot key."""
    if rows <= most:
        return many.join(F.broadcast(table), on)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(salted, [*on, "__salt"]).drop("__salt")


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similar: float = SIMILAR, broadcast: int = BROADCAST, report: bool = False) -> DataFrame:
    """A row for each document and item with a window at the similarity: id, item_id, start (in words), similarity, distance.

    broadcast: the largest lookup table, in rows, that is broadcast. report: also the
    column ``way``, ``blocks`` or ``rarest``, that tells how the reported window was found.
    """
    every = benchmark.select(F.col(item_col).alias("item_id"), hashed(F.col(item_text_col)).alias("h")).where(F.size("h") > 0)
    every = every.withColumns({"k": F.least(F.size("h"), F.lit(SHINGLE)), "u": F.xxhash64("item_id", "h")}).dropDuplicates(["item_id", "u"])
    sizes = [r["k"] for r in every.select("k").distinct().collect()]  # five at most
    if not sizes:
        kinds = [docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()]
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {kinds[0]}, item_id {kinds[1]}, start long, similarity double, distance int" + ", way string" * report)
    pick = lambda h: F.when(F.col("k") == sizes[0], grams(h, sizes[0])) if len(sizes) == 1 else F.coalesce(*[F.when(F.col("k") == k, grams(h, k)) for k in sizes])
    items = written(every.select("item_id", "u", "k", once(pick("h")).alias("g")).withColumn("n", F.size("g")), "items")
    counts = written(items.select("item_id", "u", "k", "n", F.explode("g").alias("s")).groupBy("item_id", "u", "k", "n", "s").agg(F.count("*").cast("int").alias("c")), "counts")
    spans = {r["k"]: (max(ceil(similar * r["low"] - 1e-9), 1), r["high"]) for r in items.groupBy("k").agg(F.min("n").alias("low"), F.max("n").alias("high")).collect()}
    rows, longest, many = counts.agg(F.count("*"), F.max("n"), F.count_distinct("item_id", "u")).first()
    bits = min(max(int(rows).bit_length() + 7, BLOOM[0]), BLOOM[1])

    # One pass over the documents, all lengths of shingles at once.
    table = bloom(counts.select("s"), bits).scalar()
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("x1"), F.xxhash64(F.lit(1), text_col).alias("x2"), once(hashed(F.col(text_col))).alias("h"))
    parts = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(x).alias(c) for c, x in zip(("least", "most"), spans[k])], grams("h", k).alias("g")) for k in sizes])
    kept = kept.select("id", "x1", "x2", F.inline(parts)).withColumn("filter", table)
    passes = _passes("filter", bits)
    hits = F.filter(F.transform("g", lambda x, i: F.when(passes(x), i)), lambda i: i.isNotNull())
    kept = kept.withColumn("hits", once(hits)).where(F.exists(F.transform("hits", lambda p, i: F.get("hits", i + F.col("least") - 1) - p), lambda d: F.coalesce(d < F.col("most"), F.lit(False))))
    kept = written(kept.select("id", "x1", "x2", "k", "g"), "documents")
    texts = written(kept.drop("id").dropDuplicates(["x1", "x2", "k"]), "texts")

    # Windows: of each size that an item with the shingle has.
    sized = counts.select("k", "n", "s").distinct()
    places = texts.select("x1", "x2", "k", F.size("g").alias("size"), F.posexplode("g").alias("at", "s"))
    places = _looked_up(places, sized, ["k", "s"], "x1", rows, broadcast)
    spots = places.groupBy("x1", "x2", "k", "size", "n").agg(F.sort_array(F.collect_list("at")).alias("at"))
    # o shared of n and m shingles: o / (n + m - o) >= similar, where the window has m = least(n, size).
    m = F.least("n", "size")
    need = F.ceil((F.col("n") + m) * (similar / (1 + similar)) - 1e-9).cast("int")
    spots = spots.withColumns({"m": m, "need": need}).where("size(at) >= need")
    last = F.col("size") - F.col("m")
    inside = F.filter(F.col("at"), lambda p, i: (p <= last) & F.coalesce(F.get(F.col("at"), i + F.col("need") - 1) < p + F.col("m"), F.lit(False)))
    at_end = F.when(F.size(F.filter("at", lambda p: p >= last)) >= F.col("need"), F.array(last)).otherwise(F.array().cast("array<int>"))
    starts = spots.select("x1", "x2", "k", F.explode(F.array_union(inside, at_end)).alias("start"), "n", "m")
    windows = starts.join(texts, ["x1", "x2", "k"]).select("x1", "x2", "k", "start", "n", "m", once(F.slice("g", F.col("start") + 1, F.col("m"))).alias("w"))
    wide = longest > 65_535
    windows = windows.select("x1", "x2", "k", "start", "n", "m", F.xxhash64("w", F.lit(1)).alias("w1"), F.xxhash64("w", F.lit(2)).alias("w2"), fingerprint(F.col("w"), wide).alias("print"))
    windows = written(windows, "windows")

    # Windows with the same shingles are looked up once; one of them stands for all.
    contents = windows.groupBy("w1", "w2", "k", "n", "m", "print").agg(F.min(F.struct("x1", "x2", "start")).alias("o"))
    contents = written(contents.select("*", "o.x1", "o.x2", "o.start").drop("o"), "contents")
    goal = items.select("item_id", "u", "k", "n", fingerprint(F.col("g"), wide).alias("goal"))
    filed = goal.select("*", F.inline(blocks(F.col("goal")))).withColumn("value", F.explode(F.transform(F.array(*[F.lit(x) for x in masks()]), lambda x: F.col("value").bitwiseXOR(x))))
    asked = contents.select("w1", "w2", "k", "n", "print", F.inline(blocks(F.col("print"))))
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("goal"))).alias("distance")
    found = asked.join(_small(filed, many * BLOCKS * len(masks()), broadcast), ["k", "n", "block", "value"])
    near = found.select("w1", "w2", "k", "n", "item_id", "u", apart, F.lit("blocks").alias("way")).where(F.col("distance") <= RADIUS).distinct()

    # Beyond the radius: by the rarest shingles of an item, one of which must be shared.
    often = counts.groupBy("s").agg(F.count("*").alias("items"))
    ranked = counts.join(often, "s").groupBy("item_id", "u", "k", "n").agg(F.array_sort(F.collect_list(F.struct("items", "s", "c"))).alias("r"))
    # The window has at least similar * n shingles, so a document's end can't lower need below this.
    floor = F.ceil(F.col("n") * similar - 1e-9)
    before = lambda i: F.aggregate(F.slice("r", F.lit(1), i), F.lit(0), lambda a, x: a + x["c"])
    prefix = ranked.select("item_id", "u", "k", "n", F.explode(F.filter(F.slice("r", F.lit(1), (F.col("n") - floor + 1).cast("int")), lambda x, i: before(i) <= F.col("n") - floor)).alias("r")).select("item_id", "u", "k", "n", "r.s")
    # Shingles of the windows with their counts, made once for both uses: runs of the sorted window.
    runs = contents.join(texts, ["x1", "x2", "k"]).select("w1", "w2", "k", "n", "m", "print", once(F.sort_array(F.slice("g", F.col("start") + 1, F.col("m")))).alias("w"))
    runs = runs.withColumn("e", once(F.filter(F.transform("w", lambda x, i: F.when(~F.get("w", i + 1).eqNullSafe(x), i)), lambda i: i.isNotNull())))
    counted = F.transform("e", lambda p, i: F.struct(F.get("w", p).alias("s"), (p - F.coalesce(F.get("e", i - 1), F.lit(-1))).alias("d")))
    shared = written(runs.select("w1", "w2", "k", "n", "m", "print", F.inline(counted)), "shared")
    met = _looked_up(shared.select("w1", "w2", "k", "n", "print", "s"), prefix, ["k", "n", "s"], "w1", rows, broadcast).select("w1", "w2", "k", "n", "print", "item_id", "u").distinct()
    goals = _small(goal.select("u", "item_id", "goal"), many, broadcast)
    far = met.join(goals, ["u", "item_id"]).select("w1", "w2", "k", "n", "item_id", "u", apart, F.lit("rarest").alias("way")).where(F.col("distance") > RADIUS)
    pairs = near.unionByName(far)

    exact = _looked_up(pairs.join(shared.drop("print"), ["w1", "w2", "k", "n"]), counts.drop("n", "item_id", "k"), ["u", "s"], "w1", rows, broadcast)
    exact = exact.groupBy("w1", "w2", "k", "n", "m", "item_id", "u", "distance", "way").agg(F.sum(F.least("c", "d")).alias("o"))
    exact = exact.withColumn("similarity", F.col("o") / (F.col("n") + F.col("m") - F.col("o"))).where(F.col("similarity") >= similar - 1e-12)
    found = windows.select("x1", "x2", "k", "start", "n", "w1", "w2").join(exact.select("w1", "w2", "k", "n", "item_id", "similarity", "distance", "way"), ["w1", "w2", "k", "n"])
    score = F.max(F.struct("similarity", (-F.col("start")).alias("back"), (-F.col("distance")).alias("near"), "way")).alias("b")
    found = found.groupBy("x1", "x2", "item_id").agg(score)
    named = kept.select("id", "x1", "x2").distinct().join(found, ["x1", "x2"])
    best = named.groupBy("id", "item_id").agg(F.max("b").alias("b"))
    out = best.select(F.col("id").alias(id_col), "item_id", (-F.col("b.back")).cast("long").alias("start"), F.col("b.similarity").alias("similarity"), (-F.col("b.near")).alias("distance"), F.col("b.way").alias("way"))
    return out if report else out.drop("way")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
