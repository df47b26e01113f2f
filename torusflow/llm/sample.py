"""Bounded, repeatable samples of labelled rows for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 30


def remainder(column: str, modulus: int):
    """crc32 of the value as text, modulo the modulus."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def held_out(column: str, modulus: int, value: int):
    """Whether the remainder is the value; false for null, which has none."""
    return F.coalesce(remainder(column, modulus) == value, F.lit(False))


def spread(*columns) -> F.Column:
    """A repeatable pseudo-random integer in [0, SPAN)."""
    return F.pmod(F.xxhash64(*columns, F.lit("sample")), F.lit(SPAN))


def labelled(rows: DataFrame, key: str, label: str, per_class: int) -> list:
    """About per_class rows (key, label) of each class at most, the same ones each time.

    Counting covers all rows; then only the rows whose hash falls below a rate come to
    the driver. per_class times the number of classes, plus a tenth and 50 rows a class,
    bounds what is collected in expectation; the surplus is cut in order of the hash.
    """
    rows = rows.select(F.col(key).alias("k"), F.col(label).cast("string").alias("y")).where("k is not null and y is not null")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    rate = F.lit(0)
    for y, n in counts.items():
        rate = F.when(F.col("y") == y, F.lit(int(min(1.0, (1.1 * per_class + 50) / n) * SPAN))).otherwise(rate)
    got = rows.withColumn("h", spread("k")).where(F.col("h") < rate).collect()
    got.sort(key=lambda r: (r["y"], r["h"], r["k"]))
    out, seen = [], {}
    for r in got:
        seen[r["y"]] = seen.get(r["y"], 0) + 1
        if seen[r["y"]] <= per_class:
            out.append((r["k"], r["y"]))
    return out
