"""Which wanted results have arrived, as a stream and as a batch, from the same code.

Wanted ids and arrivals come as one table of rows; a group an id tells its state, so a
stream holds one row for each id that is wanted or stray, however many files it came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("complete", "incomplete", "missing", "stray")


def marked(wanted: DataFrame, arrivals: DataFrame, group: str = "stratum") -> DataFrame:
    """wanted (sample_id, group) and arrivals (sample_id, valid, at), batch or stream both, as rows of one kind."""
    w = wanted.select("sample_id", F.lit(True).alias("wanted"), F.col(group).cast("string").alias("grp"), F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("timestamp").alias("at"))
    a = arrivals.select("sample_id", F.lit(False).alias("wanted"), F.lit(None).cast("string").alias("grp"), F.coalesce("valid", F.lit(False)).alias("valid"), F.col("at").cast("timestamp").alias("at"))
    return w.unionByName(a)


def states(rows: DataFrame) -> DataFrame:
    """(sample_id, grp, state, at): complete has a valid arrival (the first of them at ``at``), incomplete
    only invalid ones, missing none; a stray has arrived but isn't wanted. Rows without an id don't count."""
    one = rows.where("sample_id is not null").groupBy("sample_id").agg(F.max("wanted").alias("wanted"), F.max("grp").alias("grp"), F.max("valid").alias("valid"), F.min(F.when(F.col("valid"), F.col("at"))).alias("at"))
    state = F.when(~F.col("wanted"), "stray").when(F.col("valid").isNull(), "missing").when(F.col("valid"), "complete").otherwise("incomplete")
    return one.select("sample_id", "grp", state.alias("state"), "at")


def report(found: DataFrame) -> DataFrame:
    """(grp, n, complete, incomplete, missing, stray) of ``states``."""
    return found.groupBy("grp").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in STATES])


def rates(found: DataFrame, now: Column | None = None, hours: tuple[int, ...] = (1, 6)) -> DataFrame:
    """(hours, solved, rate, left, eta_hours): what became complete in the hours before now (else before
    the latest arrival), per hour, and how long the rest takes at that rate; null where nothing came."""
    end = found.agg(F.max("at")).scalar() if now is None else now
    rows = found.withColumn("__end", end)
    aged = (F.unix_micros("__end") - F.unix_micros("at")) / 3.6e9
    counts = rows.agg(F.count(F.when(F.col("state").isin("incomplete", "missing"), 1)).alias("left"), *[F.count(F.when((F.col("state") == "complete") & (aged >= 0) & (aged < h), 1)).alias(f"h{h}") for h in hours])
    each = counts.select("left", F.explode(F.array(*[F.struct(F.lit(h).alias("hours"), F.col(f"h{h}").alias("solved")) for h in hours])).alias("r")).select("left", "r.*")
    rate = F.col("solved") / F.col("hours")
    return each.select("hours", "solved", F.round(rate, 6).alias("rate"), "left", F.round(F.col("left") / F.nullif(rate, F.lit(0.0)), 6).alias("eta_hours"))


def tracked(rows: DataFrame, path: str, checkpoint: str):
    """Starts a stream that keeps the states of ``marked`` rows: changed ids of an epoch go to a folder
    of that epoch under path, so an epoch that is run again replaces its own rows."""

    def write(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return states(rows).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of every id that a stream has written."""
    rows = spark.read.schema("sample_id long, grp string, state string, at timestamp, epoch long").parquet(path)
    last = rows.groupBy("sample_id").agg(F.max_by(F.struct("grp", "state", "at"), "epoch").alias("s"))
    return last.select("sample_id", "s.*")
