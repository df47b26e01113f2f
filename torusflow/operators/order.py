"""Ranks, splits and samples over whole tables without gathering a table or a stratum in one task.

Rows are dealt to buckets that follow the order; a rank is the number of rows in the
buckets before (a small table of counts) plus the rank within the bucket.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.steps import forgotten, stepped
from . import splits

#: Buckets of an order by hash (a power of 16) and of one by value.
HASHED, RANGES = 4096, 256
#: Rows whose numpy-exact folds one task draws at once, at 5 bytes a row; beyond it the draws are replayed in pieces.
ALONE = 1 << 24
#: Rows whose draws go to the tasks as one row, or leave a task as one batch.
PIECE = 1 << 16
#: Strata whose sizes are told to every row as literals; beyond it their turns are ranked instead.
FEW = 64
#: How close percentile_approx comes: to one in ACCURACY of the rows.
ACCURACY = 10_000


def digest(key: str, seed: int) -> Column:
    """An even random order that any engine can repeat: the md5 of the id and the seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def hash_bucket(hashed: Column, down: bool = False) -> Column:
    b = F.conv(F.substring(hashed, 1, 3), 16, 10).cast("int")
    # Rows without an id come first, and last where the order falls.
    return F.coalesce(HASHED - 1 - b, F.lit(HASHED)) if down else F.coalesce(b, F.lit(-1))


def value_bucket(df: DataFrame, key: str) -> Column:
    """Buckets of about equal size by approximate quantiles, which are fixed here and now."""
    edges = df.approxQuantile(key, [i / RANGES for i in range(1, RANGES)], 0.001)
    cut = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    return F.size(F.filter(cut, lambda e: e <= F.col(key)))


def ranked(df: DataFrame, by: list[str], order: list[Column], bucket: Column, name: str = "rn") -> DataFrame:
    """The rows with their rank (from 1) within ``by``, where null is a value like any other; bucket must not fall as the order rises."""
    keys = [*by, "__bucket"]
    rows = df.withColumn("__bucket", bucket)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    found = rows.withColumn(name, inside).join(base, same).withColumn(name, (F.col(name) + F.col("__base")).cast("long"))
    return found.drop("__bucket", "__base", *[f"__of_{k}" for k in keys])


def strata_counts(df: DataFrame, stratum: str) -> DataFrame:
    """(stratum, n)."""
    return df.groupBy(stratum).agg(F.count("*").alias("n"))


def in_turn(sizes: list[tuple], stratum: str, rn: str) -> Column:
    """The place (from 1) of a row when strata are dealt from in turn, null last: rn is its rank within its own.

    sizes: (stratum, rows) of every stratum.
    """
    place = F.lit(0).cast("long")
    for name, n in sizes:
        # A stratum that sorts after the row's own has had one turn less.
        late = F.col(stratum) < F.lit(name) if name is not None else F.col(stratum).isNotNull()
        late = F.coalesce(late, F.lit(False))
        place = place + F.least(F.lit(n), F.col(rn) - F.when(late, 1).otherwise(0))
    return place


def dealt(df: DataFrame, key: str, stratum: str, order: list[Column], bucket: Column, few: int = FEW) -> DataFrame:
    """(key, stratum, place): strata dealt from in turn, each in the order given; null is a stratum of its own, the last.

    The sizes of up to ``few`` strata come to the driver. With more, rows are ranked by turn and
    stratum, in buckets of turns, so that the work a row doesn't grow with the strata.
    """
    rows = ranked(df.select(key, stratum), [stratum], order, bucket)
    sizes = [(r[0], r[1]) for r in strata_counts(df, stratum).limit(few + 1).collect()]
    if len(sizes) <= few:
        return rows.select(key, stratum, in_turn(sizes, stratum, "rn").cast("long").alias("place"))
    turns = strata_counts(df, stratum).agg(F.max("n")).scalar()
    turn = F.floor((F.col("rn") - 1) * HASHED / F.col("__turns")).cast("int")
    return ranked(rows.withColumn("__turns", turns), [], [F.col("rn"), F.col(stratum).asc_nulls_last()], turn, "place").select(key, stratum, "place")


def quantiles(df: DataFrame, value: str, probabilities: list[float], by: list[str] = []) -> DataFrame:
    """(by, n, q): exact quantiles of each group's values that aren't null, between neighbours by
    straight line; NaN comes after all numbers.

    Two passes: the first finds by a sketch a bracket around each rank that is sure to hold it,
    the second counts what lies below and ranks the distinct values inside, eight in ACCURACY
    of the group's rows at most and its ties (all rows of a group of up to ACCURACY). No task holds a column.
    """
    key = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    rows = df.where(F.col(value).isNotNull()).select(key.alias("__g"), F.col(value).cast("double").alias("__v"))
    off = 4 / ACCURACY
    low, high = ([min(max(p + d, 0.0), 1.0) for p in probabilities] for d in (-off, off))
    edges = lambda ps: F.percentile_approx("__v", [float(p) for p in ps], ACCURACY)
    groups = rows.groupBy("__g").agg(F.count("*").alias("n"), edges(low).alias("low"), edges(high).alias("high"))
    bound = lambda side, i, end, p: F.when((F.col("n") > ACCURACY) & F.lit(p != end), F.col(side)[i]).alias(side)
    ends = [F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), bound("low", i, 0.0, low[i]), bound("high", i, 1.0, high[i])) for i, p in enumerate(probabilities)]
    asked = groups.select(F.col("__g").alias("__of"), "n", F.array(*ends).alias("__e"))
    met = rows.join(asked, F.col("__g").eqNullSafe(F.col("__of"))).select("__g", "n", "__v", F.explode("__e").alias("e"))
    met = met.where(F.col("e.high").isNull() | (F.col("__v") <= F.col("e.high")))
    inside = F.when(F.col("e.low").isNull() | (F.col("__v") >= F.col("e.low")), F.col("__v"))
    counts = met.groupBy("__g", "n", F.col("e.i").alias("i"), F.col("e.p").alias("p"), inside.alias("__v")).agg(F.count("*").alias("c"))
    order = Window.partitionBy("__g", "i").orderBy(F.col("__v").asc_nulls_first())
    at = F.col("p") * (F.col("n") - 1)
    upto = counts.withColumn("c", F.sum("c").over(order))
    pick = lambda rank: F.min(F.when(F.col("__v").isNotNull() & (F.col("c") > rank), F.col("__v")))
    found = upto.groupBy("__g", "n", "i", "p").agg(pick(F.floor(at)).alias("a"), pick(F.ceil(at)).alias("b"))
    part = at - F.floor(at)
    between = F.when(part == 0, F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part)
    out = found.select("__g", "n", "i", between.alias("q")).groupBy("__g", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda t: t["q"]).alias("q"))
    return out.select(*[F.col(f"__g.{c}").alias(c) for c in by], "n", "q")


def interleaved(df: DataFrame, key: str = "sample_id", stratum: str = "stratum") -> DataFrame:
    """Strata in turn, each by id."""
    return dealt(df, key, stratum, [F.col(key)], value_bucket(df, key))


def nested(df: DataFrame, seed: int, key: str = "sample_id", stratum: str = "stratum") -> DataFrame:
    """Strata in turn, each shuffled: every prefix is balanced."""
    h = digest(key, seed)
    return dealt(df, key, stratum, [h.desc(), F.col(key)], hash_bucket(h, down=True))


def golden(df: DataFrame, total: int, seed: int, key: str = "sample_id", stratum: str = "stratum") -> DataFrame:
    """(key, stratum, split): of each stratum its half-even share of ``total`` held out."""
    h = digest(key, seed)
    rows = ranked(df.select(key, stratum), [stratum], [h, F.col(key)], hash_bucket(h))
    sizes = strata_counts(df, stratum)
    rows = rows.join(sizes.withColumnRenamed(stratum, "__of"), F.col(stratum).eqNullSafe(F.col("__of"))).withColumn("__every", sizes.agg(F.sum("n")).scalar())
    share = F.bround(F.lit(float(total)) * F.col("n") / F.col("__every"), 0)
    return rows.select(key, stratum, F.when(F.col("rn") <= share, "golden").otherwise("pool").alias("split"))


def folds(df: DataFrame, k: int, seed: int, key: str = "sample_id") -> DataFrame:
    """(key, fold): shuffled rows dealt to k folds."""
    h = digest(key, seed)
    return ranked(df.select(key), [], [h, F.col(key)], hash_bucket(h)).select(key, ((F.col("rn") - 1) % k).cast("int").alias("fold"))


def group_folds(df: DataFrame, key: str = "sample_id", group: str = "stratum") -> DataFrame:
    """(key, fold): one group left out at a time, in order of the groups; rows without one are the last group."""
    names = df.agg(F.array_sort(F.collect_set(group))).scalar()
    at = F.coalesce(F.array_position("__names", F.col(group)) - 1, F.size("__names"))
    return df.select(key, group).withColumn("__names", names).select(key, at.cast("int").alias("fold"))


def matched(df: DataFrame, seed: int, part: int = 2, key: str = "sample_id", stratum: str = "stratum") -> DataFrame:
    """(key, stratum): from each stratum as many random rows, without replacement, as the smallest has by ``part``."""
    h = digest(key, seed)
    rows = ranked(df.select(key, stratum), [stratum], [h, F.col(key)], hash_bucket(h)).withColumn("__least", strata_counts(df, stratum).agg(F.min("n")).scalar())
    return rows.where(F.col("rn") <= F.col("__least") / part).select(key, stratum)


def sliced(df: DataFrame, first: int, last: int, key: str = "sample_id", stratum: str = "stratum") -> DataFrame:
    """(key, rn): the rows from first (not itself) to last of each stratum by id."""
    return ranked(df.select(key, stratum), [stratum], [F.col(key)], value_bucket(df, key)).where((F.col("rn") > first) & (F.col("rn") <= last)).select(key, "rn")


def exact_golden(df: DataFrame, total: int, seed: int, key: str = "sample_id", stratum: str = "stratum", most: int | None = None) -> DataFrame:
    """(key, stratum, split) as numpy's generator draws it, so that published splits can be repeated.

    The draw is over places in the order of ids and takes the strata's sizes alone; the places held out go to the tasks
    in pieces of bytes. With ``most`` it raises beyond so many rows.
    """
    rows = df.select(key, stratum)
    counts = strata_counts(rows, stratum)
    sizes = [(r[0], r[1]) for r in (counts if most is None else counts.limit(most + 1)).collect()]
    if most is not None and sum(n for _, n in sizes) > most:
        raise ValueError(f"more than {most} ids: use golden")
    kind = rows.schema[stratum].dataType.simpleString()
    pieces = [(name, np.sort(at[i : i + PIECE]).tobytes()) for name, at in splits.places(sizes, total, seed) for i in range(0, len(at), PIECE)]

    def spread(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                at = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(at), i))), pa.array(at + 1)], ["__of", "__at"])

    # A piece is many rows for its size, so it must not decide for a broadcast.
    held = df.sparkSession.createDataFrame(pieces, f"g {kind}, data binary").mapInArrow(spread, f"__of {kind}, __at long").hint("merge")
    found = ranked(rows, [stratum], [F.col(key)], value_bucket(rows, key)).join(held, F.col(stratum).eqNullSafe(F.col("__of")) & (F.col("rn") == F.col("__at")), "left")
    return found.select(key, stratum, F.when(F.col("__at").isNotNull(), "golden").otherwise("pool").alias("split"))


def swapped(spark: SparkSession, n: int, seed: int, words: int = splits.PIECE) -> DataFrame:
    """(row, mate) of each swap of numpy's shuffle of n rows, the last of row 0 with itself.

    The driver runs through the draws and keeps the generator's state once a piece of so many words; the tasks replay the pieces.
    """

    def replay(batches):
        for batch in batches:
            for state in batch.to_pylist():
                for rows, mates, _ in splits.replayed(state["row"], state["key"], state["pos"], words):
                    yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(mates)], ["row", "mate"])

    states = list(splits.pieces(n, seed, words))
    dealt_out = spark.createDataFrame(spark.sparkContext.parallelize(states, max(1, len(states))), "row long, key binary, pos int")
    return dealt_out.mapInArrow(replay, "row long, mate long").unionByName(spark.range(min(n, 1)).selectExpr("id as row", "id as mate"))


def shuffled(spark: SparkSession, n: int, seed: int, words: int = splits.PIECE) -> DataFrame:
    """(row, place), both from 0: where numpy's shuffle of n rows puts each, found by joins, so that no task holds the rows.

    Rows are swapped from the last to the first, each with a mate that isn't above it, and stay. What a row gets is what its
    mate then holds: the mate itself, or what the least row above it with that mate held when it was swapped. What a row holds
    when it is swapped goes the same way, so rows hang in chains that rise, about log2(n) long at most; they are followed by doubling.
    """
    least_first = Window.partitionBy("mate").orderBy("row")
    swaps, _ = stepped(swapped(spark, n, seed, words).select("row", "mate", F.lead("row").over(least_first).alias("above"), F.row_number().over(least_first).alias("turn")), "swaps")
    # What a row holds comes from the least row above it that has it as mate.
    up = F.when(F.col("row") > F.col("mate"), F.col("row")).otherwise(F.col("above"))
    chains, path = stepped(swaps.where("turn = 1").select(F.col("mate").alias("at"), up.alias("up"), F.lit(True).alias("open")).where("up is not null"), "chains")
    while not chains.where("open").isEmpty():
        # A step's size on disk says little about its rows, so it must not decide for a broadcast.
        after = chains.select(F.col("at").alias("up"), F.col("up").alias("next"), F.col("open").alias("more")).hint("merge")
        longer = chains.where("open").join(after, "up", "left").select("at", F.coalesce("next", "up").alias("up"), F.coalesce("more", F.lit(False)).alias("open"))
        written, done = stepped(longer.unionByName(chains.where("not open")), "chains")
        forgotten(spark, path)
        chains, path = written, done
    own = swaps.where("above is null").select(F.col("mate").alias("row"), F.col("row").alias("place"))
    met = swaps.where("above is not null").select(F.col("above").alias("at"), F.col("row").alias("place")).join(chains.select("at", "up").hint("merge"), "at", "left")
    return own.unionByName(met.select(F.coalesce("up", "at").alias("row"), "place"))


def exact_folds(df: DataFrame, k: int, seed: int, key: str = "sample_id", most: int | None = None) -> DataFrame:
    """(key, fold) as numpy's shuffle of the rows in order of id cuts them; with ``most`` it raises beyond so many rows.

    Up to ALONE rows are drawn by one task.
    """
    rows, spark = df.select(key), df.sparkSession
    n = rows.count()
    if most is not None and n > most:
        raise ValueError(f"more than {most} ids: use folds")

    def alone(batches):
        for _ in batches:
            fold = splits.folds(n, k, seed).astype(np.int32)
            for at in range(0, n, PIECE):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, min(at + PIECE, n)) + 1), pa.array(fold[at : at + PIECE])], ["__at", "fold"])

    if n <= ALONE:
        told = spark.range(1, numPartitions=1).mapInArrow(alone, "__at long, fold int")
    else:
        place, short, longer = F.col("place"), n // k, n % k  # so many folds have a row more
        fold = F.when(place < longer * (short + 1), F.floor(place / (short + 1))).otherwise(longer + F.floor((place - longer * (short + 1)) / max(short, 1)))
        told = shuffled(spark, n, seed).select((F.col("row") + 1).alias("__at"), fold.cast("int").alias("fold"))
    return ranked(rows, [], [F.col(key)], value_bucket(rows, key)).join(told.hint("merge"), F.col("rn") == F.col("__at")).select(key, "fold")
