"""What keeps queries within the memory of a driver and a task as their tables grow."""

from collections.abc import Sequence

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from torusflow import queries as q
from torusflow.operators import fields, generate, graph, lattice, order, splits, surface, topology
from torusflow.plans import views

from . import compare
from .conftest import SF


def bytes_of(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shown(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("host", ["lattice2", "lattice3", "velocity", "stickcells"])
def test_hosts_are_as_large_as_they_are(spark, host):
    rows = views.query(f"SELECT * FROM {host}")(spark, SF)
    assert bytes_of(rows) >= 8 * rows.count()  # else they are taken for small enough to broadcast


def test_pore_statistics_neither_broadcast_nor_shuffle_cells(spark):
    plan = shown(q.QUERIES["lbm6_pore_statistics"](spark, SF))
    assert "HashedRelationBroadcastMode" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_the_change_of_a_field_neither_joins_nor_shuffles_cells(spark):
    plan = shown(q.QUERIES["lbm5_field_residual"](spark, SF))
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(p_partkey") == 1 and "SortMergeJoin" not in plan and "HashJoin" not in plan


def test_the_change_of_a_field_of_odd_parts(spark, tmp_path):
    parts = [(1, 7), (2, 1), (2, 4), (2, 4), (3, None), (-5, 2), (None, 4), (2**40, 1)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(q.ORACLES["lbm5_field_residual"])
    got = q.QUERIES["lbm5_field_residual"](spark, str(tmp_path))
    assert compare.spark_rows(got) == (sorted(want.columns), compare.rows(want.columns, want.fetchall()))


def test_the_change_between_two_tables(spark):
    rng, now, before, want = np.random.default_rng(1), [], [], {}
    for sid in range(6):
        moved = whole = 0.0
        for x in range(4):
            for y in range(3):
                new, old = rng.normal(size=2) * (sid != 4), rng.normal(size=2)
                here, there = map(int, rng.random(2) < (0.7, 0.6 if sid < 5 else 0.0))
                now += [(sid, x, y, *map(float, new))] * here
                before += [(sid, x, y, *map(float, old))] * there
                moved += np.sum((new * here - old * there) ** 2)
                whole += np.sum((new * here) ** 2)
        want[sid] = np.sqrt(moved / whole) if whole else 10.0
    now, before = (spark.createDataFrame(rows, "sid long, x int, y int, u double, v double").repartition(3) for rows in (now, before))
    got = {r["sid"]: r["residual"] for r in fields.residual(now, before).collect()}
    assert got.keys() == want.keys() and want[4] == 10.0 and want[5] == 1.0 and all(abs(got[s] - want[s]) < 1e-12 for s in want)


@pytest.mark.parametrize("nx, ny", [(1, 4), (2, 3), (5, 2), (6, 7)])
def test_sides_around_the_torus(spark, nx, ny):
    solid = np.random.default_rng(nx).integers(0, 2, (ny, nx))
    gone = (ny - 1, 0) if nx > 2 else None
    rows = [(1, x, y, int(solid[y, x]), 0.5, 0.0) for y in range(ny) for x in range(nx) if (y, x) != gone]
    faces = sum(
        1 for _, x, y, s, *_ in rows for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))
        if s == 1 and ((y + dy) % ny, (x + dx) % nx) != gone and solid[(y + dy) % ny, (x + dx) % nx] == 0
    )
    r = fields.statistics(spark.createDataFrame(rows, "sid long, x int, y int, solid int, u double, v double")).first()
    assert abs(r["specific_surface"] - faces / len(rows)) < 1e-12
    assert abs(r["column_flux"] - 0.5 * sum(1 for _, x, *_ in rows if x == nx // 2) / 16) < 1e-12


@pytest.mark.parametrize("name", ["snk6_tiling", "gen14_pilot_cubes", "dsc19_face_area", "gen6_von_mises_sticks", "gen2_cosine_field", "gen6_stick_raster", "gen7_junctions"])
def test_structures_are_dealt_over_the_cores(spark, name):
    assert "hashpartitioning(p_partkey" in shown(q.QUERIES[name](spark, SF))


def test_tasks_grow_with_the_parts(spark, monkeypatch):
    monkeypatch.setattr(views, "STRUCTURES", 10)
    assert views.parts(spark, SF).rdd.getNumPartitions() == 20


def test_quantiles_do_not_broadcast_cells(spark):
    assert "HashedRelationBroadcastMode" not in shown(q.QUERIES["gen3_quantile_threshold"](spark, "/root/testdata/sf0.1"))


def test_cells_of_thresholds_are_no_rows(spark):
    plan = shown(q.QUERIES["gen3_quantile_threshold"](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1 and "percentile" not in plan  # the parts are dealt


@pytest.mark.parametrize("p, n", [(0.0, 3), (0.45, 4), (0.5, 5), (1.0, 2), (0.3, 1)])
def test_quantiles_of_fields(spark, p, n):
    parts = [(1, 7), (2, 1), (2, None), (2, 3), (2**40 + 3, 1), (-5, 2), (None, 4), (None, 5)]
    value = lambda x, y, key: np.fmod(3 * x + y + x * y * key, 11)
    got = lattice.field_quantile(spark.createDataFrame(parts, "p_partkey long, p_size int").repartition(3), p, value, n).collect()
    assert len(got) == 5
    for r in got:
        times = sum(k == r["sid"] for k, _ in parts)
        cells = [value(x, y, r["sid"] or 0) for x in range(n) for y in range(n)] * times
        assert r["n"] == len(cells) and (r["q"] is None if r["sid"] is None else abs(r["q"] - np.quantile(cells, p)) < 1e-12)


def test_cells_of_cosine_fields_are_not_grouped(spark):
    plan = shown(q.QUERIES["gen2_cosine_field"](spark, SF)).lower()
    assert plan.count("exchange hashpartitioning") == 1 and "cos(" not in plan  # the parts are dealt


def test_cosine_fields_of_odd_parts(spark, tmp_path):
    parts = [(1, 7), (101, 7), (2, 1), (2, None), (2, 2), (-8, -3), (9, None), (None, 4), (2**40, 1)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").repartition(2).write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["sid"], r["x"], r["y"]): r["field"] for r in q.QUERIES["gen2_cosine_field"](spark, str(tmp_path)).collect()}
    keys = {p for p, _ in parts if p is not None}
    assert len(got) == 256 * len(keys)
    for key in keys:
        sizes = [s for p, s in parts if p == key]
        for x, y in ((0, 0), (3, 5), (15, 1)):
            waves = [(np.fmod(key + m, 5) + 1, np.fmod(s + 2 * m, 4), np.fmod(key * 7 + m * 13, 100) / 100 * np.pi) for s in sizes if s is not None for m in range(4)]
            want = len(sizes) * np.sqrt(0.5) * sum(np.cos(2 * np.pi * (a * x + b * y) / 16 + p) for a, b, p in waves)
            assert got[key, x, y] is None if not waves else abs(got[key, x, y] - want) < 1e-5


def test_fields_of_waves(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(1 + i % 3), *[rng.integers(-5, 6, i % 4).tolist() for _ in range(2)], rng.uniform(0, 3, i % 4).tolist()) for i in range(24)]
    rows += [(100 + i, *rows[3][1:]) for i in range(300)]
    got = {(r["sid"], r["x"], r["y"]): r["field"] for r in generate.fields(spark.createDataFrame(rows, "sid long, scale double, qx array<long>, qy array<long>, phase array<double>").coalesce(1), 20, 6).collect()}
    assert len(got) == 400 * len(rows)
    for sid, scale, qx, qy, phase in rows:
        for x, y in ((0, 0), (3, 5), (19, 1)):
            want = scale * sum(np.cos(2 * np.pi * (a * x + b * y) / 20 + p) for a, b, p in zip(qx, qy, phase))
            assert got[sid, x, y] is None if not qx else abs(got[sid, x, y] - want) < 1e-6


def test_plugs_do_not_broadcast_cells(spark):
    plan = shown(q.QUERIES["gen7_plugged"](spark, SF))
    assert "HashedRelationBroadcastMode" not in plan and "SortMergeJoin" in plan


def test_stars_do_not_broadcast_neighbours(spark):
    rows = spark.range(50).selectExpr("id + 1 as high", "id as low")
    assert "BroadcastHashJoin" not in shown(graph._hung(rows, True)) + shown(graph._hung(rows, False))


def test_exact_splits_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(order, "PIECE", 64)
    monkeypatch.setattr(type(spark.range(1)), "collect", counted(type(spark.range(1)).collect))
    n = 15000
    df = spark.range(n).selectExpr("(id * 7919) % 15000 as sample_id").selectExpr("sample_id", "case sample_id % 5 when 0 then 'b' when 1 then null else 'a' end as stratum")
    got = order.exact_golden(df, 4000, 7)  # over one in 50 of each stratum
    folds = order.exact_folds(df, 7, 3)
    assert counted.rows <= 3  # the strata's sizes, and no id
    monkeypatch.undo()
    rng, ids, want = np.random.default_rng(7), np.arange(n), set()
    for own in (ids[ids % 5 > 1], ids[ids % 5 == 0], ids[ids % 5 == 1]):
        want |= set(rng.choice(own, size=int(np.rint(4000 * len(own) / n)), replace=False).tolist())
    assert {r["sample_id"] for r in got.where("split = 'golden'").collect()} == want and got.count() == n
    shuffled = np.arange(n)
    np.random.RandomState(3).shuffle(shuffled)
    assert {(r["sample_id"], r["fold"]) for r in folds.collect()} == {(int(i), f) for f, part in enumerate(np.array_split(shuffled, 7)) for i in part}


@pytest.mark.parametrize("n, k, seed", [(1, 3, 0), (2, 5, 1), (7, 10, 2), (3000, 7, 3)])
def test_folds_beyond_one_task(spark, monkeypatch, n, k, seed):
    monkeypatch.setattr(order, "ALONE", 0)
    monkeypatch.setattr(splits, "folds", None)  # no draw over all rows
    got = order.exact_folds(spark.range(n).selectExpr("id * 3 - 5 as sample_id").repartition(3), k, seed).collect()
    shuffled = np.arange(n)
    np.random.RandomState(seed).shuffle(shuffled)
    assert sorted((r["sample_id"], r["fold"]) for r in got) == sorted((int(i) * 3 - 5, f) for f, part in enumerate(np.array_split(shuffled, k)) for i in part)


def test_shuffles_are_joined_from_many_pieces(spark):
    shuffled = np.arange(2000)
    np.random.RandomState(9).shuffle(shuffled)
    assert len(list(splits.pieces(2000, 9, 256))) > 5
    assert [r["row"] for r in order.shuffled(spark, 2000, 9, 256).orderBy("place").collect()] == shuffled.tolist()


def test_exact_golden_is_told_only_what_is_held_out(spark, monkeypatch):
    monkeypatch.setattr(order.splits, "places", lambda sizes, total, seed: [(name, np.array([n - 1])) for name, n in sizes])
    got = order.exact_golden(spark.range(900).selectExpr("id as sample_id", "id % 3 as stratum"), 3, 0)
    assert {r["sample_id"] for r in got.where("split = 'golden'").collect()} == {897, 898, 899} and got.count() == 900


@pytest.mark.parametrize("n", [1, 40, 70000, 2**32 + 50])
def test_replayed_swaps_equal_numpy(n):
    seen = Swapped(n)
    try:
        np.random.RandomState(5).shuffle(seen)
    except StopIteration:
        pass
    got = [(i, j) for state in (splits.pieces(n, 5) if n < 1 << 20 else [next(splits.pieces(n, 5))]) for rows, mates, _ in splits.replayed(*state) for i, j in zip(rows.tolist(), mates.tolist())]
    assert got[: Swapped.MOST] == seen.pairs and len(seen.pairs) == min(n - 1, Swapped.MOST)


class Swapped(Sequence):
    """A sequence of any length that only tells which rows are swapped, up to a number of swaps."""

    MOST = 200_000

    def __init__(self, n):
        self.n, self.read, self.pairs, self.sets = n, [], [], 0

    def __len__(self):
        return self.n

    def __getitem__(self, i):
        self.read.append(i)
        return i

    def __setitem__(self, i, value):
        self.sets += 1
        if self.sets % 2 == 0:
            self.pairs.append((max(self.read), min(self.read)))
            self.read = []
            if len(self.pairs) == self.MOST:
                raise StopIteration


def counted(collect):
    def run(self):
        found = collect(self)
        counted.rows = max(counted.rows, len(found))
        return found

    counted.rows = 0
    return run


def test_equal_structures_are_computed_once(spark):
    rows = [(i, [int(i % 3 == k) for k in range(9)]) for i in range(600)] + [(1000 + i, [i % 2] * 16) for i in range(4)] + [(2000, None)]
    packed = spark.createDataFrame(rows, "sid long, grid array<int>").selectExpr("sid", "transform(grid, g -> cast(g as tinyint)) as grid").coalesce(1)

    def work(ids, block):  # as many rows as a structure's first cell says, and one; what it was computed with
        n = block[:, 0, 0] + 1
        return np.repeat(ids, n)[::-1], np.full(n.sum(), len(ids)), np.repeat(block.reshape(len(ids), -1).argmax(1), n)[::-1]

    got = sorted(map(tuple, lattice.kernel(packed, 2, work, "sid long, mates long, at long").collect()))
    want = [(i, 3, i % 3) for i in range(600) for _ in range(1 + (i % 3 == 0))] + [(1000 + i, 2, 0) for i in range(4) for _ in range(1 + i % 2)]
    assert got == sorted(want)
    assert [r for r in lattice.kernel(packed, 2, lambda ids, g: ([], [], []), "sid long, mates long, at long").collect()] == []


def test_the_sweep_merges_bars_with_features(spark):
    assert "SortMergeJoin [sid" in shown(q.QUERIES["sta13_sweep"](spark, SF))


def test_the_sweep_makes_images_once_for_a_structure(spark, monkeypatch):
    told, whole = [], q.sweep.sweep
    monkeypatch.setattr(q.sweep, "sweep", lambda bars, features, **how: told.append((bars, features)) or whole(bars, features, **how))
    q.QUERIES["sta13_sweep"](spark, SF)
    ((bars, features),) = told
    parts = spark.read.parquet(f"{SF}/part.parquet")
    different = lattice.lattice2(parts).select("grid").distinct().count()
    rows = features.collect()
    assert len(rows) == different < parts.count() == sum(sum(r["times"]) for r in rows)
    assert bars.select("sid").distinct().join(features, "sid", "left_anti").count() == 0


ONCE = ("lbm2_permeability_3d", "top3_tortuosity", "top3_connectivity", "top7_critical_radius", "top7_critical_radius_3d", "dsc16_persistence_3d", "top1_percolation_3d", "gen9_cube_metrics", "top6_windings", "top6_windings_3d")


@pytest.mark.parametrize("name", ONCE)
def test_dear_work_is_done_once_for_a_structure(spark, name):
    plan = shown(q.QUERIES[name](spark, SF))
    assert "SortMergeJoin [mark" in plan and "RoundRobinPartitioning(" in plan
    assert "isnotnull(coalesce" not in plan  # a null check of cells would be pushed to where the parts are read


def test_structures_of_a_table_are_computed_once(spark):
    rows = [(i, [int(i % 3 == k) for k in range(9)]) for i in range(600)] + [(7, [1] * 16), (8, None)]
    packed = spark.createDataFrame(rows, "sid long, grid array<int>").selectExpr("sid", "transform(grid, g -> cast(g as tinyint)) as grid").repartition(7)
    seen = spark.sparkContext.accumulator(0)

    def work(ids, block):
        seen.add(len(ids))
        return np.repeat(ids, 2), np.repeat(block.reshape(len(ids), -1).argmax(1), 2)

    got = sorted(map(tuple, lattice.once(packed, lambda p: lattice.kernel(p, 2, work, "sid long, at long")).collect()))
    assert got == sorted([(i, i % 3) for i in range(600)] * 2 + [(7, 0)] * 2) and seen.value == 4


@pytest.mark.parametrize("dims, n, top, tens", [(2, 5, lambda x, y, z, p: 5 * x + 3 * y + x * y * p, 3), (3, 4, lambda x, y, z, p: 5 * x + 3 * y + 7 * z + x * y * p + y * z, 4)])
def test_hosts_equal_their_rule(spark, dims, n, top, tens):
    parts = [(1, 7), (2**40 + 3, 1), (-5, 2), (9, -400), (4, None), (None, 4)]
    rows = (lattice.lattice2 if dims == 2 else lattice.lattice3)(spark.createDataFrame(parts, "p_partkey long, p_size int"), n).collect()
    for (p, s), r in zip(parts, sorted(rows, key=lambda r: [q for q, _ in parts].index(r["sid"]))):
        cells = [(x, y, z) for z in range(n if dims == 3 else 1) for y in range(n) for x in range(n)]
        want = [0 if p is None or s is None else int(np.fmod(top(*c, p) + s, 10) < tens) for c in cells]
        assert r["sid"] == p and r["grid"] == want


@pytest.mark.parametrize("dims, n", [(2, 1), (2, 3), (2, 7), (3, 2), (3, 4)])
def test_spans_equal_labels_of_the_tiling(dims, n):
    on = np.random.default_rng(n).random((60, *[n] * dims)) < np.linspace(0, 1, 60).reshape(-1, *[1] * dims)
    _, ends = topology._crossings(on)
    assert topology.spans(on).tolist() == [[bool(e) for e in one] for one in ends]


@pytest.mark.parametrize("dims, n", [(2, 9), (3, 6)])
def test_fields_are_sums_of_cosines(dims, n):
    rng = np.random.default_rng(dims)
    wave, phase = rng.integers(-5, 6, (7, dims)), rng.uniform(0, np.pi, 7)
    at = np.meshgrid(*[np.arange(n)] * dims, indexing="ij")[::-1]
    want = np.sqrt(2 / 7) * sum(np.cos(2 * np.pi / n * sum(c * a for c, a in zip(v, at)) + p) for v, p in zip(wave, phase))
    assert np.abs(generate.field(wave, phase, n) - want).max() < 1e-12 and not generate.field(wave[:0], phase[:0], n).any()


def test_samples_are_the_same_together_and_alone(spark):
    how = dict(n=8, dims=2, seed=3, attempts=4)
    told = lambda rows: [(*r[:4], None if r[4] is None else list(r[4])) for r in rows]
    assert told(generate.made(list(range(40)), **how)) == told([generate.structure(i, **how) for i in range(40)])


def test_faces_are_counted_in_blocks(spark):
    plan = q.QUERIES["dsc19_face_area"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # no pass over a grid cell by cell
    rng, rows = np.random.default_rng(5), []
    for n in (1, 2, 3, 3, 4):
        rows.append((len(rows) if len(rows) != 2 else None, rng.integers(0, 2, n**3).tolist()))
    packed = spark.createDataFrame(rows, "sid long, grid array<int>").selectExpr("sid", "transform(grid, g -> cast(g as tinyint)) as grid")
    got = {r["sid"]: tuple(r)[1:] for r in surface.face_counts(packed).collect()}
    for sid, grid in rows:
        n = round(len(grid) ** (1 / 3))
        at = lambda x, y, z: grid[(z % n * n + y % n) * n + x % n]
        cells = [(x, y, z) for x in range(n) for y in range(n) for z in range(n)]
        faces = sum(at(x, y, z) != at(x + a, y + b, z + c) for x, y, z in cells for a, b, c in ((1, 0, 0), (0, 1, 0), (0, 0, 1)))
        assert got[sid] == (n**3, faces, sum(grid))


@pytest.mark.parametrize("name", ["dsc10_local_axis_3d", "dsc5_fabric_profile"])
def test_kernels_get_their_hosts_in_blocks(spark, name):
    plan = shown(q.QUERIES[name](spark, SF))
    assert plan.count("MapInArrow") == 2 and "lambda" not in plan and plan.count("Exchange") == plan.count("Exchange hashpartitioning(p_partkey") == 1


@pytest.mark.parametrize("name", ["dsc10_local_axis_3d", "dsc5_fabric_profile"])
def test_what_equal_structures_make_becomes_rows_in_spark(spark, name):
    plan = shown(q.QUERIES[name](spark, SF))
    assert "Generate explode(sid" in plan and "Generate posexplode(" in plan


def test_columns_are_gathered_by_structure():
    made = pa.RecordBatch.from_arrays([pa.array([2, 0, 2, 0]), pa.array([5, None, 7, 8])], ["sid", "v"])  # none of structure 1
    got = lattice.gathered(made, np.array([1, 2, 0, 2]), pa.array(["a", None, "c", "d"]))
    assert [c.to_pylist() for c in got] == [[["c"], ["a"], [None, "d"]], [[None, 8], [], [5, 7]]]


def test_blobs_are_labelled_without_rounds_over_the_table(spark):
    plan = shown(q.QUERIES["gen7_blobs"](spark, SF))
    assert "FileScan parquet [sid" not in plan and plan.count("Exchange hashpartitioning") == 2  # no step is written; the parts are dealt, and the centres' sums


def test_orientations_draw_no_more_than_they_need(spark):
    plan = q.QUERIES["gen6_von_mises_sticks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 39" not in plan


def test_code_of_symmetric_tensors_is_small(spark):
    plan = q.QUERIES["ten7_symmetric_tensors"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan
