"""Small SQL functions of the studies, as column expressions and by name in SQL."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def direction_tag(a: Column, b: Column, c: Column) -> Column:
    """a1_-1_0 of a lattice direction."""
    return F.concat(F.lit("a"), F.concat_ws("_", *[v.cast("string") for v in (a, b, c)]))


def tag_order(tag: Column) -> Column:
    """What tags are sorted by: plain angles by number first, then directions by name."""
    number = F.regexp_extract(tag, r"^a?(-?[0-9]+)$", 1)
    return F.struct((number == "").alias("named"), number.try_cast("int").alias("angle"), tag.alias("tag"))


def slit_permeability(aperture: Column, height: Column) -> Column:
    """The sum of (z + 1/2) (h - z - 1/2) over the h open cells of a slit, over two heights."""
    h = aperture.cast("double")
    return (h * h * h / 6 + h / 12) / (2 * height)


def smeared(bandwidth: Column, low: Column, high: Column) -> Column:
    """Whether a Gaussian of the bandwidth is wider than a third of the range."""
    return bandwidth > (high - low) / 3


#: name: (SQL parameters, SQL body), registered as functions of the session.
SQL = {
    "direction_tag": ("a INT, b INT, c INT", "concat('a', concat_ws('_', CAST(a AS STRING), CAST(b AS STRING), CAST(c AS STRING)))", "STRING"),
    "kozeny_carman": ("porosity DOUBLE, surface DOUBLE", "power(porosity, 3) / nullif(surface * surface, 0)", "DOUBLE"),
    "slit_permeability": ("h DOUBLE, n DOUBLE", "(h * h * h / 6 + h / 12) / (2 * n)", "DOUBLE"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions of SQL known to the session, and returns their names."""
    for name, (parameters, body, kind) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(SQL)
