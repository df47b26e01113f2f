"""What follows from velocities on the cells of structures: fluxes, residuals, statistics and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the length that fluxes are measured in, in cells.
BLOCK = 4

_speed2 = lambda: F.col("u") * F.col("u") + F.col("v") * F.col("v")


def fluxes(velocity: DataFrame) -> DataFrame:
    """(sid, qx, qy) of (sid, x, y, u, v): the sums of both components over the side's length and BLOCK squared.

    Sides are told by the largest x and y, so solid cells must be there too, at rest.
    """
    side = lambda c: (F.max(c) + 1) * (BLOCK * BLOCK)
    return velocity.groupBy("sid").agg((F.sum("u") / side("x")).alias("qx"), (F.sum("v") / side("y")).alias("qy"))


def change(both: DataFrame) -> DataFrame:
    """(sid, residual) of cells that hold a field (u, v) and the one before (u0, v0): the root of the squared change over
    the squares; 10 for a field at rest. A null is at rest.

    One sum by structure, so cells that are dealt by structure stay where they are.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    moved = (zero("u") - zero("u0")) ** 2 + (zero("v") - zero("v0")) ** 2
    sums = both.groupBy("sid").agg(F.sum(moved).alias("moved"), F.coalesce(F.sum(_speed2()), F.lit(0.0)).alias("whole"))
    return sums.select("sid", F.when(F.col("whole") > 0, F.sqrt(F.col("moved") / F.col("whole"))).otherwise(10.0).alias("residual"))


def residual(now: DataFrame, before: DataFrame) -> DataFrame:
    """``change`` of two tables of (sid, x, y, u, v), a row a cell, whose cells are joined.

    A cell that only one of the fields has is at rest in the other. Where one table holds both fields, ``change`` needs no join.
    """
    old = before.select("sid", "x", "y", F.col("u").alias("u0"), F.col("v").alias("v0"))
    return change(now.select("sid", "x", "y", "u", "v").join(old, ["sid", "x", "y"], "full"))


def statistics(velocity: DataFrame) -> DataFrame:
    """Per structure (sid, x, y, solid, u, v): tortuosity (all speed over all flow along x),
    participation (the share of the pore that would carry the energy evenly), effective porosity
    (cells that move), specific surface (sides between pore and solid by cells) and the flux through
    the middle column. Null where nothing flows."""
    e = _speed2()
    # All is told within a structure, so its cells are dealt once; a cell looks at the one before it along x and along
    # y, and at the far end of its line where it lies on the seam. A missing cell has no sides.
    whole = Window.partitionBy("sid")
    rows = velocity.select("sid", "x", "y", "solid", "u", "v", (F.max("x").over(whole) + 1).alias("__nx"), (F.max("y").over(whole) + 1).alias("__ny"))
    sides = []
    for c, across in (("x", "y"), ("y", "x")):
        line, end = Window.partitionBy("sid", across), F.col(f"__n{c}") - 1
        inner = F.when(F.lag(c).over(line.orderBy(c)) == F.col(c) - 1, F.lag("solid").over(line.orderBy(c)))
        before = F.when(F.col(c) == 0, F.max(F.when(F.col(c) == end, F.col("solid"))).over(line)).otherwise(inner)
        rows = rows.withColumn(f"__by_{c}", before)
        sides.append(F.count(F.when(F.col("solid") + F.col(f"__by_{c}") == 1, 1)))
    rows = rows.groupBy("sid").agg(
        F.count("*").alias("cells"), F.sum(F.sqrt(e)).alias("speed"), F.sum("u").alias("along"), F.sum(e).alias("e1"), F.sum(e * e).alias("e2"),
        F.count(F.when(F.col("solid") == 0, 1)).alias("pores"), F.count(F.when(e > 0, 1)).alias("moving"), (sides[0] + sides[1]).alias("faces"),
        (F.sum(F.when(F.col("x") == F.floor(F.col("__nx") / 2), F.col("u"))) / (BLOCK * BLOCK)).alias("column_flux"),
    )
    nz = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))
    return rows.select(
        "sid", (F.col("speed") / nz("along")).alias("tortuosity"), (F.col("e1") * F.col("e1") / (nz("pores") * nz("e2"))).alias("participation"),
        (F.col("moving") / F.col("cells")).alias("effective_porosity"), (F.col("faces") / F.col("cells")).alias("specific_surface"), "column_flux",
    )


def consistency(velocity: DataFrame, labels: DataFrame) -> DataFrame:
    """(sid, moving_solid, worst, qx, qy, off_x, off_y): solid cells that move and the largest component
    there, the fluxes of the field, and how far they lie from the labels' (sid, qx, qy), relative to
    those; null without a label."""
    bad = (F.col("solid") == 1) & ((F.col("u") != 0) | (F.col("v") != 0))
    own = velocity.groupBy("sid").agg(F.count(F.when(bad, 1)).alias("moving_solid"), F.coalesce(F.max(F.when(F.col("solid") == 1, F.greatest(F.abs("u"), F.abs("v")))), F.lit(0.0)).alias("worst"))
    told = labels.select("sid", F.col("qx").alias("__x"), F.col("qy").alias("__y"))
    rows = own.join(fluxes(velocity), "sid").join(told, "sid", "left")
    off = lambda q, t: F.abs(F.col(q) - F.col(t)) / F.greatest(F.abs(t), F.lit(1e-30))
    return rows.select("sid", "moving_solid", "worst", "qx", "qy", F.when(F.col("__x").isNotNull(), off("qx", "__x")).alias("off_x"), F.when(F.col("__y").isNotNull(), off("qy", "__y")).alias("off_y"))
