"""When a series of fluxes has settled: drift of block means within their own noise, several blocks in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settled(flux: DataFrame, *, lag: int = 20, sample: int = 1, eps: float = 1e-4, floor: float = 0.05, sigmas: float = 2.0, hold: int = 3, least: int = 0, average: int = 100) -> DataFrame:
    """Per series: converged, stop (its step), n, qx, qy, se_qx, se_qy: the mean of the samples of
    up to ``average`` steps after the stop, with standard errors.

    flux: (sid, step from 1, qx, qy). Every sample-th step counts, in blocks of lag steps. A block
    passes if both components' means differ from the block before by less than the larger of
    eps times the component (or ``floor`` of the whole flux, if that is larger) and sigmas
    standard errors of the difference; from step ``least`` on. After ``hold`` passes in a row the
    series has settled; one that never has ends with its last whole block. Steps that aren't
    there leave their block with fewer samples; blocks of fewer than two samples are no blocks.
    A series without any sample after its stop has its last sample alone, without errors. Null
    and non-finite fluxes are no samples.
    """
    if lag < 2 * sample:
        raise ValueError("a block needs two samples at least")
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    q = flux.select("sid", "step", F.col("qx").cast("double").alias("qx"), F.col("qy").cast("double").alias("qy")).where((F.col("step") % sample == 0) & fine("qx") & fine("qy"))
    end = (F.floor((F.col("step") - 1) / lag) + 1) * lag
    error = lambda c: F.sqrt(F.var_samp(c) / F.count(c))
    blocks = q.groupBy("sid", end.alias("end")).agg(F.count("*").alias("n"), F.max("step").alias("seen"), *[f(c).alias(f"{p}_{c}") for c in ("qx", "qy") for p, f in (("m", F.avg), ("e", error))])
    whole = blocks.where((F.col("n") >= 2) & (F.col("seen") > F.col("end") - sample))
    order = Window.partitionBy("sid").orderBy("end")
    size = F.sqrt(F.col("m_qx") ** 2 + F.col("m_qy") ** 2)
    near = lambda c: F.abs(F.col(f"m_{c}") - F.lag(f"m_{c}").over(order)) < F.greatest(eps * F.greatest(F.abs(f"m_{c}"), floor * size), sigmas * F.sqrt(F.col(f"e_{c}") ** 2 + F.lag(f"e_{c}").over(order) ** 2))
    judged = whole.withColumn("passed", F.coalesce(near("qx") & near("qy") & (F.col("end") >= least), F.lit(False)))
    # Passes since the last failure.
    failures = judged.withColumn("island", F.sum(F.when(F.col("passed"), 0).otherwise(1)).over(order))
    runs = failures.withColumn("run", F.sum(F.when(F.col("passed"), 1).otherwise(0)).over(Window.partitionBy("sid", "island").orderBy("end")))
    stops = runs.groupBy("sid").agg(F.min(F.when(F.col("run") >= hold, F.col("end"))).alias("at"), F.max("end").alias("last"))
    stops = stops.select("sid", F.col("at").isNotNull().cast("int").alias("converged"), F.coalesce("at", "last").cast("long").alias("stop"))
    rows = q.join(stops, "sid")
    inside = (F.col("step") > F.col("stop")) & (F.col("step") <= F.col("stop") + average)
    last = lambda c: F.max_by(F.when(F.col("step") <= F.col("stop"), F.col(c)), F.when(F.col("step") <= F.col("stop"), F.col("step")))
    own = lambda c: F.when(inside, F.col(c))
    out = rows.groupBy("sid", "converged", "stop").agg(F.count(own("qx")).alias("n"), *[e for c in ("qx", "qy") for e in (F.coalesce(F.avg(own(c)), last(c)).alias(c), F.coalesce(F.sqrt(F.var_samp(own(c)) / F.count(own(c))), F.lit(0.0)).alias(f"se_{c}"))])
    return out.select("sid", "converged", "stop", F.greatest("n", F.lit(1)).alias("n"), "qx", "qy", "se_qx", "se_qy")
