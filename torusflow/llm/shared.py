"""Places for tables between steps, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir, deleted when the application ends.

    Where that is unset, a folder of this machine serves a local master, as in tests; a
    cluster is refused, as its executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own.setdefault("base", tempfile.mkdtemp(prefix="torusflow-"))
    path = f"{base.rstrip('/')}/torusflow/{what}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows, written as Parquet and read again: computed once, and safe from lost executors."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
