"""Tables between the steps of a query, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def step_path(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir; only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="torusflow-"))
        base = _local[0]
    path = f"{base.rstrip('/')}/torusflow/{what}-{uuid.uuid4().hex}"
    fs, place = _place(spark, path)
    fs.deleteOnExit(place)
    return path


def stepped(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The rows written as Parquet and read again, and their path: lineage is cut, lost executors lose nothing."""
    path = step_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forgotten(spark: SparkSession, path: str) -> None:
    """Deletes a step that has no reader left."""
    fs, place = _place(spark, path)
    fs.delete(place, True)


def stream_source(spark: SparkSession, folder: str, name: str) -> str:
    """A path that a file stream can watch for a table: its folder, or a pattern that its single file meets."""
    fs, place = _place(spark, f"{folder}/{name}.parquet")
    return f"{folder}/{name}.parquet" if fs.getFileStatus(place).isDirectory() else f"{folder}/{name}.parque[t]"
