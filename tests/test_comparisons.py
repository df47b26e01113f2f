"""Comparison of runs behind its gate, named groups of features, and connectivity columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from torusflow.operators import splits, tables, topology


def test_p_of_students_t(spark):
    rows = [(float(t), df) for t in (0.0, 0.3, -2.1, 12.7062, 60.0) for df in (1, 2, 3, 4, 5, 9, 10, 40, 101)]
    for r in spark.createDataFrame(rows, "t double, df int").select("t", "df", tables.student_p(F.col("t"), F.col("df")).alias("p")).collect():
        assert abs(r["p"] - splits.paired_p(r["t"], r["df"])) < 1e-9, r
    got = spark.createDataFrame([(12.7062, 1), (4.302653, 2), (2.776445, 4), (2.570582, 5)], "t double, df int").select(tables.student_p(F.col("t"), F.col("df")).alias("p"))
    assert all(abs(r["p"] - 0.05) < 1e-5 for r in got.collect())


def test_runs_of_unlike_folds_are_refused(spark):
    runs = [("k", "base", f, 100, 0.5 + 0.01 * f) for f in range(5)]
    runs += [("k", "better", f, 100, 0.6 + 0.012 * f) for f in range(5)]
    runs += [("k", "rows", f, 100 - (f == 3), 0.9) for f in range(5)] + [("k", "folds", f, 100, 0.9) for f in range(4)]
    runs += [("k", "more", f, 100, 0.9) for f in range(6)] + [("k", "same", f, 100, 0.5 + 0.01 * f) for f in range(5)]
    runs += [("one", "base", 0, 9, 0.1), ("one", "other", 0, 9, 0.2), ("none", "other", 0, 9, 0.2)]
    df = spark.createDataFrame(runs, "target string, grp string, fold int, n_rows long, r2 double")
    got = {(r["target"], r["grp"]): r for r in tables.paired_test(df, "base", ["target"], ["fold"]).collect()}
    assert {k[1]: r["refused"] for k, r in got.items() if k[0] == "k"} == {"better": 0, "rows": 1, "folds": 1, "more": 1, "same": 0}
    d = np.array([0.1 + 0.002 * f for f in range(5)])
    t = d.mean() / (d.std(ddof=1) / np.sqrt(5))
    assert abs(got["k", "better"]["t"] - t) < 1e-6 and abs(got["k", "better"]["p"] - splits.paired_p(t, 4)) < 1e-9
    assert got["k", "same"]["t"] == 0 and got["k", "same"]["p"] == 1
    assert all(got["k", g][c] is None for g in ("rows", "folds", "more") for c in "tp")
    assert got["one", "other"]["refused"] == 0 and got["one", "other"]["t"] is None and got["none", "other"]["refused"] == 1


def test_groups_of_features(spark):
    wide = spark.createDataFrame([tuple(range(7))], "sample_id int, porosity int, por_a0_1 int, fab_xx int, fabdir_a0_1 int, ph_h0_1 int, porous int")
    assert tables.group_columns(wide, "fab") == ["fab_xx"] and tables.group_columns(wide, "porosity") == ["porosity"]
    assert tables.group_columns(wide, "all") == ["por_a0_1", "fab_xx", "fabdir_a0_1", "ph_h0_1"]
    assert len(tables.GROUPS) == 26
    with pytest.raises(ValueError, match="no group"):
        tables.group_columns(wide, "everything")
    narrow = spark.createDataFrame([(1, "fab"), (2, "ph"), (3, "zz")], "id int, kind string")
    assert sorted((r["id"], r["grp"]) for r in tables.group_rows(narrow, ["all", "tda", "kc"]).collect()) == [(1, "all"), (2, "all"), (2, "tda")]
    with pytest.raises(ValueError):
        tables.group_rows(narrow, ["all", "nothing"])


def test_connectivity_has_all_columns(spark):
    n = 8
    y, x = np.mgrid[0:n, 0:n]
    grids = [np.where(y < 3, 0, 1), np.ones((n, n), int), np.zeros((n, n), int)]
    rows = spark.createDataFrame([(i, g.ravel().tolist()) for i, g in enumerate(grids)], "sid long, grid array<tinyint>")
    got = {r["sid"]: r for r in topology.connectivity(rows).collect()}
    assert len(got[0]) == 19 and list(got[0].asDict())[1:3] == ["conn_beta0_pore", "conn_backbone_x"]
    assert got[0]["conn_tort_x"] == 1 and got[0]["conn_tort_y"] is None and got[0]["conn_tort_mean"] == 1 and got[0]["conn_tort_aniso"] is None
    assert got[1]["conn_beta0_pore"] == 0 and got[1]["conn_tort_mean"] is None
    assert got[2]["conn_tort_aniso"] == 0 and got[2]["conn_tort_off"] == 0 and got[2]["conn_largest_frac"] == 1
