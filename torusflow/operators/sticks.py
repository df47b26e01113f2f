"""Networks of sticks on a periodic grid: orientations, raster, junctions, their blobs and plugs.

Every number that is drawn is a hash of the ids that it belongs to, so a network is the same
on any layout and in any engine. All steps are columns, joins and groups over (sid, x, y).
"""

from __future__ import annotations

from functools import reduce
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import stepped
from .lattice import CELLS, labels_of

#: Draws of the rejection method; at most one in 10**18 orientations needs more and gets the mean.
TRIES = 40


def uniform(*seed) -> Column:
    """An even number between 0 and 1, both left out, by the md5 of the seed's parts."""
    text = F.concat_ws(":", *[(s if isinstance(s, Column) else F.lit(s)).cast("string") for s in seed])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def von_mises(mean: Column, kappa: Column, *seed) -> Column:
    """An angle about the mean with concentration kappa (even around the circle below 1e-4).

    Rejection from a wrapped Cauchy envelope: the first of TRIES hashed draws that is accepted.
    """
    named = lambda **parts: F.struct(*[v.alias(n) for n, v in parts.items()])
    # Each step is a pass over an array, so what it finds is made once however often the next one uses it.
    given = F.array(named(k=F.greatest(kappa, F.lit(1e-4))))
    given = F.transform(given, lambda g: named(k=g["k"], tau=1 + F.sqrt(1 + 4 * g["k"] * g["k"])))
    given = F.transform(given, lambda g: named(k=g["k"], rho=(g["tau"] - F.sqrt(2 * g["tau"])) / (2 * g["k"])))
    given = F.transform(given, lambda g: named(k=g["k"], r=(1 + g["rho"] * g["rho"]) / (2 * g["rho"])))

    def turns(g: Column) -> Column:
        # Most first draws are accepted, so later ones are made only where all before were refused.
        return F.coalesce(*[accepted(g, low, min(2 * low, TRIES) if low else 1) for low in (0, 1, 2, 4, 8, 16, 32)])

    def accepted(g: Column, low: int, high: int) -> Column:
        tries = F.sequence(F.lit(low), F.lit(high - 1))
        drawn = F.transform(tries, lambda t: named(z=F.cos(pi * uniform(*seed, t, "z")), u=uniform(*seed, t, "u"), side=uniform(*seed, t, "s")))
        drawn = F.transform(drawn, lambda d: named(f=(1 + g["r"] * d["z"]) / (g["r"] + d["z"]), u=d["u"], side=d["side"]))
        drawn = F.transform(drawn, lambda d: named(c=g["k"] * (g["r"] - d["f"]), f=d["f"], u=d["u"], side=d["side"]))
        return F.get(F.filter(drawn, lambda d: (d["c"] * (2 - d["c"]) > d["u"]) | (F.ln(d["c"] / d["u"]) + 1 - d["c"] >= 0)), 0)

    first = F.transform(F.transform(given, turns), lambda d: F.when(d["side"] < 0.5, -1).otherwise(1) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d["f"]))))
    return mean + F.when(kappa < 1e-4, 2 * pi * uniform(*seed, "even") - pi).otherwise(F.coalesce(F.get(first, 0), F.lit(0.0)))


def sticks(networks: DataFrame, size: int, seed: int = 0, length: float = 20.0, width: float = 3.0) -> DataFrame:
    """(sid, seg, cx, cy, theta, length, width) of networks (sid, psi, kappa, porosity).

    Orientations are drawn on the doubled angle, as a stick has no direction. The number of
    sticks is what would fill 1 - porosity of the grid if they overlapped at random.
    """
    count = F.greatest(F.lit(4), F.round(-F.ln(F.greatest(F.lit(1e-3), 1 - F.col("porosity"))) * (size * size / (length * max(width, 1.0)))).cast("int"))
    rows = networks.select("sid", "psi", "kappa", F.explode(F.sequence(F.lit(0), count - 1)).alias("seg"))
    own = (F.lit(seed), F.col("sid"), F.col("seg"))
    even = lambda low, high, name: low + (high - low) * uniform(*own, name)
    wide = F.greatest(F.lit(2), F.least(F.lit(9), F.round(width * even(0.6, 1.4, "w")).cast("int")))
    return rows.select("sid", "seg", even(0.0, float(size), "x").alias("cx"), even(0.0, float(size), "y").alias("cy"), (von_mises(2 * F.col("psi"), F.col("kappa"), *own) / 2).alias("theta"), (length * even(0.5, 1.5, "l")).alias("length"), wide.alias("width"))


def raster(lines: DataFrame, size: int) -> DataFrame:
    """(sid, seg, width, x, y): the cells of each stick, a step of at most half a cell apart."""
    n = F.greatest(F.lit(2), F.ceil(F.col("length") * 2).cast("int"))
    at = F.col("length") * (F.col("i") / (F.col("n") - 1) - 0.5)
    rows = lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    place = lambda c, f: F.pmod(F.floor(F.col(c) + at * f("theta")), F.lit(size)).cast("int")
    return rows.select("sid", "seg", "width", place("cx", F.cos).alias("x"), place("cy", F.sin).alias("y")).distinct()


def dilated(cells: DataFrame, radius: Column, size: int, most: float = 4.5, by: tuple = ("sid",)) -> DataFrame:
    """(by, x, y): the cells within the radius (at most ``most``) of those given, around the torus."""
    reach = int(-(-most // 1))
    disc = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a * a + b * b <= most * most])
    rows = cells.withColumn("d", F.explode(F.filter(disc, lambda d: d["dx"] * d["dx"] + d["dy"] * d["dy"] <= radius * radius)))
    return rows.select(*by, *[F.pmod(F.col(c) + F.col(f"d.d{c}"), F.lit(size)).cast("int").alias(c) for c in "xy"]).distinct()


def junctions(cells: DataFrame, size: int) -> DataFrame:
    """(sid, x, y): cells within one step of two or more distinct sticks (sid, seg, x, y)."""
    # Columns of their own, so that networks dealt by sid stay where they are.
    wide = dilated(cells, F.lit(1.0), size, 1.0, ("sid", "seg"))
    return wide.groupBy("sid", "x", "y").agg(F.count("*").alias("n")).where("n >= 2").select("sid", "x", "y")


def blobs(cells: DataFrame, size: int) -> DataFrame:
    """(sid, x, y, blob): connected cells, by sides and around the torus; a blob's name is its least y * size + x.

    No blob leaves its network, so a network's cells are put together and labelled as a block."""
    kind = cells.schema["sid"].dataType.simpleString()
    nets = cells.groupBy("sid").agg(F.collect_list((F.col("y") * size + F.col("x")).cast("int")).alias("at"))
    step = max(1, CELLS // size**2)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                on = np.zeros((batch.num_rows, size * size), bool)
                at = batch.column(1)
                on[np.repeat(np.arange(len(on)), at.value_lengths().to_numpy()), at.flatten().to_numpy()] = True
                names = labels_of(on.reshape(-1, size, size), True).reshape(on.shape) - 1
                net, place = np.nonzero(on)
                x, y, blob = place % size, place // size, names[net, place] - net * size * size
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(net)), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(blob, pa.int64())], ["sid", "x", "y", "blob"])

    return nets.mapInArrow(run, f"sid {kind}, x int, y int, blob long")


def centres(labelled: DataFrame, size: int) -> DataFrame:
    """(sid, blob, cells, x, y): the circular mean of each blob, so that one on the seam stays there; halves go up."""
    turn = 2 * pi / size
    mean = lambda c: F.atan2(F.avg(F.sin(turn * F.col(c))), F.avg(F.cos(turn * F.col(c)))) / turn
    near = lambda c: F.pmod(F.floor(mean(c) + 0.5 + 1e-6), F.lit(size)).cast("int")
    return labelled.groupBy("sid", "blob").agg(F.count("*").alias("cells"), near("x").alias("x"), near("y").alias("y"))


def chosen(found: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Of each network's blobs (sid, blob, ...) a hashed share, to the nearest whole number (half-even)."""
    mine = Window.partitionBy("sid")
    rank = F.row_number().over(mine.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sid").cast("string"), F.col("blob").cast("string"))), "blob"))
    rows = found.withColumn("rn", rank).withColumn("of", F.count("*").over(mine))
    return rows.where(F.col("rn") <= F.bround(F.col("of") * share, 0)).drop("rn", "of")


def plugged(pore: DataFrame, joints: DataFrame, share: float, radius: float, size: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The pore (sid, x, y) without discs of solid at a share of the junctions' blobs, and per
    network (sid, n_junctions, n_blocked, pore_cells, left_cells)."""
    # Cells are many for their bytes on disk: their joins are merged, whatever size is estimated.
    found, _ = stepped(centres(blobs(joints.join(pore.hint("merge"), ["sid", "x", "y"], "left_semi"), size), size), "blobs")
    picked = chosen(found, share, seed)
    discs = dilated(picked, F.lit(float(radius)), size, radius)
    left = pore.join(discs.hint("merge"), ["sid", "x", "y"], "left_anti")
    names = ("n_junctions", "n_blocked", "pore_cells", "left_cells")
    marked = [df.select("sid", *[F.lit(int(n == name)).alias(n) for n in names]) for name, df in zip(names, (found, picked, pore, left))]
    report = reduce(DataFrame.unionByName, marked).groupBy("sid").agg(*[F.sum(n).alias(n) for n in names])
    return left, report
