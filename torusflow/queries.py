"""The engine's own queries by name, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import flow
from .operators import generate as G
from .operators import lattice as L
from .operators import lattice3 as L3
from .operators import models as M
from .operators import order
from .operators import persistence as P
from .operators import rocks, surface, sweep, symmetry
from .operators import topology as T
from .plans import flood_sql, frames, lattice_sql, relational, views
from .sources import steps
from .streaming import arrivals, audit


def _parts(spark, sf_dir: str) -> DataFrame:
    """What structures are made of, dealt over all cores: a structure is far more work than these two numbers."""
    return views.parts(spark, sf_dir).select("p_partkey", "p_size")


def _on2(work):
    return lambda spark, sf_dir: work(L.lattice2(_parts(spark, sf_dir)))


def _on3(work):
    return lambda spark, sf_dir: work(L.lattice3(_parts(spark, sf_dir)))


def _once(work):
    """Work that is dear by the structure and makes few rows of it."""
    return lambda packed: L.once(packed, work)


def _resampled(packed: DataFrame) -> DataFrame:
    return L.resampled(L.porosity_profile(packed), 7, keys=("sid", "dir"))


def _generated(dims: int, n: int, work):
    """What a kernel makes of generated structures: hosts of another size than the packed ones."""

    def run(spark, sf_dir):
        made = G.structures(_parts(spark, sf_dir), id_col="p_partkey", n=n, dims=dims)
        return work(made.where("grid is not null"))

    return run


def _correlated(packed: DataFrame) -> DataFrame:
    """How the counts go with the porosity, over all structures."""
    por = packed.select("sid", (1 - F.aggregate("grid", F.lit(0), lambda a, x: a + x) / F.size("grid")).alias("porosity"))
    rows = T.component_counts(packed).join(por, "sid")
    pick = ("largest", "n_pore", "n_solid", "euler")
    return rows.agg(*[F.round(F.corr(c, "porosity"), 4).alias(c) for c in pick]).unpivot([], list(pick), "feature", "r")


def _exact(work):
    return lambda spark, sf_dir: work(views.query("SELECT * FROM structures")(spark, sf_dir))


KERNELS = {
    "dsc1_porosity_profile": _on2(L.porosity_profile),
    "dsc2_two_point": _on2(L.two_point),
    "dsc3_fabric_2d": _on2(L.fabric2),
    "dsc4_fabric_3d": _on3(L.fabric3),
    "dsc5_fabric_profile": _on3(L.fabric_profile),
    "dsc6_resampled": _on2(_resampled),
    "dsc9_wedge_occupancy": _on2(L.wedge_occupancy),
    "dsc10_local_axis": _on2(L.local_axis),
    "dsc11_void_occupancy": _on2(lambda packed: L.wedge_occupancy(packed, phase=0)),
    "dsc12_distance": _on2(L.periodic_distance),
    "dsc13_throat_iso": _on2(L.throat_iso),
    "dsc14_throat_dir": _on2(L.throat_dir),
    "dsc15_euler_profile": _on2(L.euler_profile),
    "dsc16_persistence": _on2(P.persistence),
    "dsc17_image_of_bars": _on2(lambda packed: P.image(P.persistence(packed))),
    "top1_percolation": _on2(T.percolates),
    "top2_clusters": _on2(T.cluster_features),
    "top3_tortuosity": _on2(_once(T.tortuosity)),
    "top3_connectivity": _on2(_once(T.connectivity)),
    "top4_slab_tortuosity": _on2(T.slab_tortuosity),
    "top5_components": _on2(T.component_counts),
    "top5_correlations": _on2(_correlated),
    "top6_windings": _on2(_once(T.winding)),
    "top7_critical_radius": _on2(_once(T.critical_radius)),
    "lbm1_permeability": _on2(_once(flow.permeability)),
    "dsc19_kozeny_carman": _on3(surface.kozeny_carman),
    "dsc1_porosity_profile_3d": _on3(L3.profile),
    "dsc2_two_point_3d": _on3(L3.two_point),
    "dsc4_fabric_components": _on3(L3.fabric_components),
    "dsc9_cone_occupancy": _on3(L3.cone_occupancy),
    "dsc10_local_axis_3d": _on3(L3.local_axis),
    "dsc13_throat_iso_3d": _on3(L3.throat_iso),
    "dsc14_throat_dir_3d": _on3(L3.throat_dir),
    "dsc15_euler_profile_3d": _on3(L3.euler_profile),
    "dsc16_persistence_3d": _on3(_once(lambda packed: P.persistence(packed, 3, 4.0))),
    "top1_percolation_3d": _on3(_once(lambda packed: T.percolates(packed, 3))),
    "top5_components_3d": _on3(lambda packed: T.component_counts(packed, 3)),
    "top6_windings_3d": _on3(_once(lambda packed: T.winding(packed, 3))),
    "top7_critical_radius_3d": _on3(_once(lambda packed: T.critical_radius(packed, 3))),
    "lbm2_permeability_3d": _on3(_once(lambda packed: flow.tensor(packed, 3))),
    "gen5_structures": lambda spark, sf_dir: G.structures(_parts(spark, sf_dir), id_col="p_partkey", n=32),
    "gen16_structures_3d": lambda spark, sf_dir: G.structures(_parts(spark, sf_dir), id_col="p_partkey", n=12, dims=3),
    "dsc1_profile_of_generated": _generated(2, 32, L.porosity_profile),
    "dsc5_fabric_of_generated_3d": _generated(3, 12, L.fabric_profile),
    "gen9_cube_metrics": _on3(_once(rocks.metrics)),
    "ten7_symmetric_tensors": lambda spark, sf_dir: symmetry.tensors(views.query("SELECT * FROM perm")(spark, sf_dir)),
    "ten7_symmetric_grids": _on3(symmetry.grids),
    "win2_golden_numpy": _exact(lambda s: order.exact_golden(s, 999, 12345)),
    "win4_kfold_numpy": _exact(lambda s: order.exact_folds(s, 5, 0)),
}


def _model(work, made=M.vectors):
    return lambda spark, sf_dir: work(made(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


MODELS = {
    # Fewer and larger steps than the published 1500 of 0.05: each level of a round is a job.
    "sta9_boosted_trees": _model(lambda rows: M.boosted(rows, rounds=16, rate=0.3, wait=5), M.arrays),
    "sta10_ridge": _model(M.ridge, M.arrays),
    "sta11_pca_spectrum": _model(lambda rows: M.spectrum(rows, 20)),
    "sta11_predictability": _model(M.predictability, M.arrays),
    "sta12_effective_rank": _model(lambda rows: M.effective_rank(rows, 64)),
    "sta14_pca_components": _model(lambda rows: M.components(rows, 5)),
}

def _swept(spark, sf_dir: str) -> DataFrame:
    """Images of the structures' bars in every setting, told by porosity and two-point correlations."""
    packed = sweep.lone(L.lattice2(_parts(spark, sf_dir)))
    features = packed.select("sid", "times").join(L.correlated(packed).hint("merge"), "sid")
    return sweep.sweep(P.persistence(packed), features, sides=(4, 8))


def _streamed_audit(spark, sf_dir: str) -> DataFrame:
    """Orders as wanted results and their lines as arrivals, replayed through the stream."""
    table = lambda name: spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).option("recursiveFileLookup", "true").parquet(steps.stream_source(spark, sf_dir, name))
    wanted = table("orders").where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("sample_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 4).cast("string")).alias("stratum"))
    lines = table("lineitem").where("l_orderkey % 40 <> 0").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_linestatus") == "F").alias("valid"), F.col("l_shipdate").cast("timestamp").alias("at"))
    place = steps.step_path(spark, "audit")
    audit.tracked(audit.marked(wanted, lines), f"{place}/states", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return audit.report(audit.current(spark, f"{place}/states"))


def _streamed_rate(spark, sf_dir: str) -> DataFrame:
    """Events replayed through the stream; each epoch writes all counts, the last one has them."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    place = steps.step_path(spark, "rate")
    rows = arrivals.hourly_rate(arrivals.arrivals(spark, steps.stream_source(spark, sf_dir, "events"), schema))

    def write(counts: DataFrame, epoch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{place}/rows")

    rows.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("hour timestamp, event_type string, n long").parquet(f"{place}/rows")
    return found.select("event_type", F.floor(F.unix_timestamp("hour") / 3600).cast("long").alias("hour"), "n")


KERNELS |= {"stream_hourly_rate": _streamed_rate, "sta13_sweep": _swept, "drv3_streamed_audit": _streamed_audit}

QUERIES = {name: views.query(sql) for name, sql in relational.SQL.items()} | KERNELS | MODELS | frames.FRAMES
ORACLES = {name: views.statement(sql, 1) for name, sql in (relational.SQL | lattice_sql.SQL | flood_sql.SQL).items()}
