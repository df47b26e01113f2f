import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from torusflow.operators import splits
from torusflow.sources import files


def digest(ids):
    import hashlib

    return hashlib.sha256(",".join(map(str, sorted(ids.tolist()))).encode()).hexdigest()


def test_raw_round_trip(spark, tmp_path):
    g = np.random.default_rng(0).integers(0, 2, (5, 7, 11)).astype(np.uint8)
    assert (files.decode_raw(files.encode_raw(g)) == g).all()
    (tmp_path / "sample_000012.raw").write_bytes(files.encode_raw(g))
    row = files.read_raw(spark, str(tmp_path)).first()
    assert (row["sample_id"], row["nx"], row["ny"], row["nz"]) == (12, 11, 7, 5) and list(row["grid"]) == g.ravel().tolist()
    with pytest.raises(ValueError):
        files.decode_raw(files.encode_raw(g)[:-1])
    with pytest.raises(ValueError):
        files.encode_raw(g + 1)


def test_pgm_and_velocity_and_features(spark, tmp_path):
    (tmp_path / "000003.pgm").write_bytes(b"P5\n3 2\n255\n" + bytes([0, 9, 0, 255, 0, 1]))
    assert list(files.read_pgm(spark, str(tmp_path)).first()["grid"]) == [1, 0, 1, 0, 1, 0]
    v = np.arange(24, dtype="<f4").reshape(2, 2, 2, 3)
    (tmp_path / "000004.vel").write_bytes(np.array([2, 2, 2, 3], "<i4").tobytes() + v.tobytes())
    got = {(r["x"], r["y"], r["z"]): (r["u"], r["v"], r["w"]) for r in files.read_velocity(spark, str(tmp_path)).collect()}
    assert got[1, 0, 1] == tuple(v[1, 0, 1].tolist())
    (tmp_path / "ecp" / "a0").mkdir(parents=True)
    np.save(tmp_path / "ecp" / "a0" / "sample_000005.npy", np.array([1.5, 2.5]))
    r = files.read_features(spark, str(tmp_path)).first()
    assert (r["kind"], r["tag"], r["sample_id"], list(r["values"])) == ("ecp", "a0", 5, [1.5, 2.5])


def test_results_and_metrics(spark, tmp_path):
    for run in ("tree/a", "tree/b/c"):
        (tmp_path / run).mkdir(parents=True)
        (tmp_path / run / "results.csv").write_text("group,target,mode,r2_mean\nall,k_xx,,0.5\n")
    got = sorted((r["kind"], r["run"], r["mode"]) for r in files.read_results(spark, str(tmp_path), "`group` string, target string, mode string, r2_mean double").collect())
    assert got == [("tree", "a", "single"), ("tree", "b/c", "single")]
    (tmp_path / "metrics.json").write_text(json.dumps({"kind": "tree", "experiments": [{"group": "all", "target": "k", "folds": [{"fold": 0, "n_test": 5, "r2": 0.5, "mae": 1.0, "mse": 2.0}]}]}))
    assert files.read_metrics(spark, str(tmp_path / "metrics.json")).first()["r2"] == 0.5


def test_vtk_is_big_endian_x_fastest():
    g = np.arange(6, dtype=float).reshape(1, 2, 3)
    assert np.frombuffer(files.vtk({"s": g})[-25:-1], ">f4").tolist() == [0, 1, 2, 3, 4, 5]


def test_golden_split_matches_the_known_hash(spark):
    ids = np.arange(5000)
    stratum = np.array(["iso", "mod", "strong"])[ids % 3]
    held = splits.golden(ids, stratum, 1000, 12345)
    assert len(held) == 999 and digest(held) == "2609c9efa1f31d1e608c33e089f7ef9bb70bb5f578eeb920af6eb8babec8fb14"
    split = spark.createDataFrame([(int(i), "golden") for i in held], "sample_id long, split string")
    assert files.verified_split(split, digest(held)).count() == 999
    with pytest.raises(ValueError):
        files.verified_split(split.where("sample_id > 10"), digest(held))


def test_orders_and_p():
    ids = np.arange(30)
    order = splits.nested_order(ids, np.array(["a", "b", "c"])[ids % 3], 1)
    assert sorted(order) == list(range(30)) and [i % 3 for i in order[:6]] == [0, 1, 2, 0, 1, 2]
    assert sorted(np.bincount(splits.folds(23, 5, 0))) == [4, 4, 5, 5, 5]
    assert abs(splits.paired_p(2.776445, 4) - 0.05) < 1e-5 and abs(splits.paired_p(3.182446, 3) - 0.05) < 1e-5
    assert abs(splits.paired_p(12.7062, 1) - 0.05) < 1e-5 and abs(splits.paired_p(4.302653, 2) - 0.05) < 1e-5


def test_fields_as_vtk(spark, tmp_path):
    kinds = "sample_id long, nx int, ny int, nz int, fields map<string,array<double>>, flow array<struct<u:double,v:double,w:double>>"
    solid, dist = [0.0, 1.0, 0.0, 0.0, 1.0, 1.0], [float(i) for i in range(6)]
    flow = [(3.0 * i, 4.0 * i, 0.0) for i in range(6)]
    df = spark.createDataFrame([(5, 3, 2, 1, {"solid": solid, "dist": dist}, flow), (6, 3, 2, 1, {"solid": solid}, None)], kinds)
    files.write_vtk(df, str(tmp_path / "v"), tiles=2)
    got = {r["sample_id"]: bytes(r["content"]) for r in spark.read.parquet(str(tmp_path / "v")).collect()}
    assert b"DIMENSIONS 6 4 2" in got[5] and got[5].index(b"SCALARS dist") < got[5].index(b"SCALARS solid") < got[5].index(b"VECTORS velocity") < got[5].index(b"SCALARS magnitude")
    body = got[5][got[5].index(b"SCALARS magnitude float 1\nLOOKUP_TABLE default\n") + len(b"SCALARS magnitude float 1\nLOOKUP_TABLE default\n") :][: 48 * 4]
    tiled = np.tile((5.0 * np.arange(6)).reshape(1, 2, 3), (2, 2, 2))
    assert (np.frombuffer(body, ">f4").reshape(2, 4, 6) == tiled).all()
    assert b"velocity" not in got[6] and got[6].count(b"SCALARS") == 1


def test_text_velocities(spark, tmp_path):
    (tmp_path / "000007.fx.dat").write_text("\n".join(f"{x + 10 * y} -{x}.5" for y in range(2) for x in range(3)) + "\n")
    got = {(r["x"], r["y"]): (r["sample_id"], r["u"], r["v"]) for r in files.read_velocity_dat(spark, str(tmp_path), 3, 2).collect()}
    assert got == {(x, y): (7, x + 10.0 * y, -x - 0.5) for x in range(3) for y in range(2)}
    with pytest.raises(Exception, match="not 8 rows"):
        files.read_velocity_dat(spark, str(tmp_path), 4, 2).collect()


def test_stream_counts_once(spark, tmp_path):
    from torusflow.streaming.arrivals import arrivals, hourly_rate

    from .conftest import SF

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events.limit(50)).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = hourly_rate(arrivals(spark, str(tmp_path / "in"), events.schema))
    q = out.writeStream.outputMode("complete").format("memory").queryName("rate").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    total = spark.sql("select sum(n) from rate").first()[0]
    q.stop()
    assert total == events.where("value is not null and not isnan(value)").count()


def test_plain_images_rocks_and_typed_tables(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "000001.ppm").write_text("P3\n# made\n3 2\n255\n" + " ".join(f"{r} 9 9" for r in (0, 5, 0, 0, 1, 1)))
    (tmp_path / "g" / "000002.dat").write_text("0 1\n1 0\n")
    got = {r["sample_id"]: (r["nx"], r["ny"], list(r["grid"])) for r in files.read_text_grids(spark, str(tmp_path / "g")).collect()}
    assert got == {1: (3, 2, [1, 0, 1, 1, 0, 0]), 2: (2, 2, [0, 1, 1, 0])}
    (tmp_path / "r").mkdir()
    rock = np.random.default_rng(0).integers(0, 2, (4, 4, 4)).astype(np.uint8)
    (tmp_path / "r" / "tiny_2um.raw").write_bytes(rock.tobytes())
    rows = files.read_rocks(spark, str(tmp_path / "r"), {"tiny": (4, 2.0)}).collect()
    assert [bytes(r["plane"]) for r in sorted(rows, key=lambda r: r["z"])] == [rock[z].tobytes() for z in range(4)] and rows[0]["voxel_um"] == 2.0
    assert len(files.ROCKS) == 12
    with pytest.raises(Exception, match="no volume"):
        files.read_rocks(spark, str(tmp_path / "r"), {"tiny": (5, 2.0)}).collect()
    (tmp_path / "a.csv").write_text("sample_id,k\n1,0.5\n")
    (tmp_path / "b.csv").write_text("sample_id,k\n2,x\n")
    assert files.read_table(spark, str(tmp_path / "a.csv"), "sample_id long, k double", ("k",)).first()["k"] == 0.5
    assert files.read_union(spark, [str(tmp_path / "a.csv")] * 2, "sample_id long, k double").count() == 2
    with pytest.raises(Exception):
        files.read_table(spark, str(tmp_path / "b.csv"), "sample_id long, k double").collect()
    with pytest.raises(ValueError):
        files.read_table(spark, str(tmp_path / "a.csv"), "sample_id long, k double", ("other",))


def test_complete_labels(spark):
    rows = spark.createDataFrame([(1, 1.0, 1), (2, float("nan"), 1), (3, None, 1), (4, float("inf"), 1), (5, 2.0, None)], "id long, k double, conv int")
    assert [r["id"] for r in files.complete(rows, ("k", "conv")).collect()] == [1]
    assert files.complete(rows, ("k", "absent")).count() == 0


def test_tables_are_published_whole(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "labels.csv")
    df = spark.createDataFrame([(1, 0.5), (2, 0.25)], "sample_id long, k double")
    ids = lambda: sorted(r["sample_id"] for r in files.read_published(spark, place, df.schema).collect())
    versions = lambda: len([p for p in (tmp_path / "labels.csv").iterdir() if p.is_dir()])

    def refuse(*_):
        raise ValueError("not these")

    with pytest.raises(ValueError, match="not these"):
        files.published(df, place, refuse)
    with pytest.raises(FileNotFoundError):
        ids()
    assert files.published(df, place).count() == 2 and ids() == [1, 2]
    with pytest.raises(ValueError, match="not these"):
        files.published(df.limit(1), place, refuse)
    assert ids() == [1, 2] and versions() == 1
    # The swap fails before it is done, or just after: the old table or the new one, never none or half.
    swap = files._swapped
    monkeypatch.setattr(files, "_swapped", refuse)
    with pytest.raises(ValueError):
        files.published(df.where("sample_id = 2"), place)
    assert ids() == [1, 2] and versions() == 1

    def late(*a):
        swap(*a)
        raise OSError("the store went away")

    monkeypatch.setattr(files, "_swapped", late)
    with pytest.raises(OSError):
        files.published(df.where("sample_id = 2"), place)
    assert ids() == [2]
    monkeypatch.setattr(files, "_swapped", swap)
    for i in range(3):
        files.published(df.withColumn("sample_id", F.lit(10 + i).cast("long")).limit(1), place)
        assert ids() == [10 + i] and versions() == 2
    # A table may be published from its own last version.
    files.published(files.read_published(spark, place, df.schema).withColumn("k", F.lit(1.5)), place)
    assert files.read_published(spark, place, df.schema).first()["k"] == 1.5


def test_runs_are_written_and_read_back(spark, tmp_path):
    schema = "`group` string, target string, mode string, n_features long, seconds double, fold int, n_test int, r2 double, mae double, mse double"
    rows = [(g, "k_xx", "single", 7, 1.5, f, 10, 0.5 + f / 10, 1.0, 2.0) for g in ("all", "fab") for f in range(3)]
    files.write_run(spark.createDataFrame(rows, schema), str(tmp_path / "run"), kind="tree", arguments={"seed": 3, "n_rows": 30, "folds": 3})
    got = files.read_metrics(spark, f"{tmp_path}/run/metrics.json").collect()
    assert sorted((r["group"], r["fold"], round(r["r2"], 6)) for r in got) == sorted((r[0], r[5], round(r[7], 6)) for r in rows) and got[0]["seed"] == 3
    assert files.read_metrics(spark, f"{tmp_path}/run/metrics.json:fab").count() == 3
    with pytest.raises(ValueError):
        files.read_metrics(spark, f"{tmp_path}/run/metrics.json:none")
    results = files.read_table(spark, f"{tmp_path}/run/results.csv", "`group` string, target string, mode string, n_features long, r2_mean double, r2_std double, mae_mean double, mae_std double, mse_mean double, mse_std double, n long, seconds double").collect()
    assert [(r["group"], round(r["r2_mean"], 6), round(r["r2_std"], 6), r["n"]) for r in results] == [("all", 0.6, 0.1, 30), ("fab", 0.6, 0.1, 30)]


def test_raw_table(spark, tmp_path):
    g = np.random.default_rng(0).integers(0, 2, (2, 3, 4)).astype(np.uint8)
    df = spark.createDataFrame([(12, 4, 3, 2, g.ravel().tolist())], "sample_id long, nx int, ny int, nz int, grid array<tinyint>")
    files.write_raw(df, str(tmp_path / "out"))
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert r["name"] == "sample_000012.raw" and (files.decode_raw(bytes(r["content"])) == g).all()


def test_late_rows_of_a_stream_are_dropped(spark, tmp_path):
    """Two batches: a repeat of the first counts once, a row before the watermark doesn't count."""
    from datetime import datetime

    from torusflow.streaming.arrivals import arrivals, hourly_rate

    schema = "event_id long, event_type string, ts timestamp, value double"
    at = lambda h, m=0: datetime(2020, 1, 1, h, m)
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write([(1, "a", at(8), 1.0), (2, "a", at(12), 1.0), (3, "a", at(12), float("nan"))])
    out = hourly_rate(arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema))
    q = out.writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    write([(2, "a", at(12), 1.0), (4, "a", at(9), 1.0), (5, "a", at(12, 30), 1.0)])
    q.processAllAvailable()
    write([(6, "a", at(20), 1.0)])
    q.processAllAvailable()
    write([(7, "a", at(21), 1.0)])
    q.processAllAvailable()
    got = {r["hour"].hour: r["n"] for r in spark.sql("select * from late").collect()}
    q.stop()
    assert got[8] == 1 and got[12] == 2 and 9 not in got
