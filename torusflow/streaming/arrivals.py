"""Labels that arrive file by file, as a structured stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files that land under a path."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def hourly_rate(events: DataFrame, *, id_col: str = "event_id", kind_col: str = "event_type", at_col: str = "ts", value_col: str = "value", late: str = "2 hours") -> DataFrame:
    """Complete results by kind and hour: repeats count once, non-finite values don't; later rows are dropped.

    State is bounded by the watermark.
    """
    at = F.col(at_col).cast("timestamp")
    fine = F.col(value_col).isNotNull() & ~F.isnan(value_col) & (F.abs(value_col) < float("inf"))
    rows = events.withColumn("at", at).where(fine).withWatermark("at", late).dropDuplicatesWithinWatermark([id_col])
    return rows.groupBy(F.window("at", "1 hour").alias("hour"), kind_col).agg(F.count("*").alias("n")).select(F.col("hour.start").alias("hour"), kind_col, "n")
