"""Stopping of series, scored sweeps and audits of arrivals, against plain versions."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from torusflow.operators import lattice, persistence, series, sweep
from torusflow.streaming import audit


def plain_stop(q, lag, sample, eps, floor, sigmas, hold, least, average):
    """The rule step by step, as a solver applies it; q: {step: (qx, qy)}."""
    last, held, stop = None, 0, None
    for end in range(lag, max(q) + 1, lag):
        own = np.array([q[s] for s in range(end - lag + 1, end + 1) if s % sample == 0])
        m, e = own.mean(0), own.std(0, ddof=1) / np.sqrt(len(own))
        if last is not None:
            size = np.hypot(*m)
            tol = [max(eps * max(abs(m[i]), floor * size), sigmas * np.hypot(e[i], last[1][i])) for i in (0, 1)]
            held = held + 1 if end >= least and all(abs(m[i] - last[0][i]) < tol[i] for i in (0, 1)) else 0
        last, done = (m, e), end
        if held >= hold:
            stop = end
            break
    at = stop if stop else done
    rest = np.array([q[s] for s in range(at + 1, at + average + 1) if s in q and s % sample == 0])
    if not len(rest):
        return int(stop is not None), at, 1, *q[at], 0.0, 0.0
    error = rest.std(0, ddof=1) / np.sqrt(len(rest)) if len(rest) > 1 else np.zeros(2)
    return int(stop is not None), at, len(rest), *rest.mean(0), *error


@pytest.mark.parametrize("how", [dict(lag=20, sample=1, eps=1e-4, floor=0.05, sigmas=2.0, hold=3, least=0, average=100), dict(lag=30, sample=5, eps=0.02, floor=0.1, sigmas=0.0, hold=2, least=150, average=60)])
def test_series_stop_as_the_solver_does(spark, how):
    rng, rows, want = np.random.default_rng(3), [], {}
    for sid, (steps, noise) in enumerate([(700, 0.5), (700, 5.0), (300, 0.0), (90, 1.0), (640, 0.05)]):
        q = {s: (float(100 + 900 * np.exp(-s / 60) + noise * rng.normal()), float(-3 + 50 * np.exp(-s / 40) + noise * rng.normal())) for s in range(1, steps + 1)}
        want[sid] = plain_stop(q, **how)
        rows += [(sid, s, *v) for s, v in q.items()]
    rows += [(9, s, None, 1.0) for s in range(60)]
    got = series.settled(spark.createDataFrame(rows, "sid long, step long, qx double, qy double").repartition(4), **how)
    got = {r["sid"]: tuple(r)[1:] for r in got.collect()}
    assert set(got) == set(want)
    for sid in want:
        np.testing.assert_allclose(got[sid], want[sid], rtol=1e-9, atol=1e-12)
    assert {w[0] for w in want.values()} == {0, 1}
    with pytest.raises(ValueError):
        series.settled(spark.createDataFrame(rows, "sid long, step long, qx double, qy double"), lag=1)


def test_sweep_equals_fits_of_each_cell(spark):
    rng, folds = np.random.default_rng(8), 4
    n, p = 70, 3
    x = rng.normal(size=(n, p))
    bars = {i: [(int(d), *(b := sorted((rng.uniform(0, 1, 2) + 0.1 * x[i, 0]).tolist()))) for d in rng.integers(0, 2, rng.integers(0, 9))] for i in range(n)}
    rows = spark.createDataFrame([(i, *b) for i, own in bars.items() for b in own], "sid long, dim int, birth double, death double").repartition(3)
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sid long, x array<double>").repartition(2)
    fold = {r["sid"]: r["f"] for r in features.select("sid", F.pmod(F.xxhash64("sid", F.lit("fold")), F.lit(folds)).alias("f")).collect()}
    fold = np.array([fold[i] for i in range(n)])
    got = {(r["side"], r["weight"], r["range"], r["bandwidth"]): r for r in sweep.sweep(rows, features, sides=(3, 5)).collect()}
    assert len(got) == 60
    for side, weight, name, bandwidth in [(3, "const", "shared 1.25", 0.25), (5, "linear", "perdim", 0.125), (5, "const", "perdim tight", 1.0)]:
        r = got[side, weight, name, bandwidth]
        for dim in (0, 1):
            images = []
            for i in range(n):
                image = np.zeros((side, side))
                (b0, b1), (l0, l1) = sweep.RANGES[name][dim]
                for d, birth, death in bars[i]:
                    if d == dim:
                        for a in range(side):
                            for b in range(side):
                                far = (birth - b0 - (a + 0.5) * (b1 - b0) / side) ** 2 + (death - birth - l0 - (b + 0.5) * (l1 - l0) / side) ** 2
                                image[a, b] += (death - birth if weight == "linear" else 1.0) * np.exp(-far / (2 * bandwidth**2)) / (2 * np.pi * bandwidth**2)
                images.append(image.ravel())
            y = np.array(images)
            y = (y - y.mean(0)) / y.std(0)
            u, s, vt = np.linalg.svd(y, full_matrices=False)
            share = s**2 / (s**2).sum()
            assert r[f"h{dim}_rank"] == int(np.searchsorted(np.cumsum(share), 0.99)) + 1 and abs(r[f"h{dim}_share"] - share[0]) < 1e-6
            z, error = y @ vt[:3].T, np.zeros(3)
            for f in range(folds):
                tr, te = fold != f, fold == f
                mu, sd = x[tr].mean(0), x[tr].std(0)
                a = (x[tr] - mu) / sd
                w = np.linalg.solve(a.T @ a + np.eye(p), a.T @ (z[tr] - z[tr].mean(0)))
                error += ((z[te] - ((x[te] - mu) / sd @ w + z[tr].mean(0))) ** 2).sum(0)
            assert abs(r[f"h{dim}_r2"] - np.mean(1 - error / (z**2).sum(0))) < 1e-6
    assert sweep.sweep(rows, features.limit(0)).count() == 0
    bare = sweep.sweep(rows.limit(0), features, sides=(2,)).collect()
    assert len(bare) == 30 and {r["h0_rank"] for r in bare} == {None}


def test_sweep_of_different_structures_and_their_numbers(spark):
    rng = np.random.default_rng(4)
    grids = (rng.random((60, 64)) < rng.uniform(0.2, 0.6, (60, 1))).astype(int).tolist()
    rows = [(i, grids[i % 60 if i < 120 else i % 7]) for i in range(200)] + [(1000, None), (7, grids[3])]
    packed = spark.createDataFrame(rows, "sid long, grid array<int>").selectExpr("sid", "transform(grid, g -> cast(g as tinyint)) as grid").repartition(5)
    found = sweep.lone(packed.unionByName(packed.limit(1).selectExpr("cast(null as bigint) as sid", "grid")), 3).persist()
    assert found.count() == 60 == found.select("sid").distinct().count() and sum(sum(r["times"]) for r in found.collect()) == 201
    key = lambda r: (r["side"], r["weight"], r["range"], r["bandwidth"])
    alone = packed.selectExpr("xxhash64(sid, grid) as sid", "sid as id", "grid").where("grid is not null")  # id 7 is two structures
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(3))
    times = alone.select("sid", F.array(*[(fold == f).cast("long") for f in range(3)]).alias("times"))
    want = sweep.sweep(persistence.persistence(alone.select("sid", "grid")), times.join(lattice.correlated(alone.select("sid", "grid")), "sid"), sides=(3,), folds=3)
    got = sweep.sweep(persistence.persistence(found), found.select("sid", "times").join(lattice.correlated(found), "sid"), sides=(3,), folds=3)
    want, got = ({key(r): r for r in rows.where("bandwidth between 0.1 and 0.3").collect()} for rows in (want, got))
    assert len(got) == 12 and got.keys() == want.keys()
    for k, r in got.items():
        assert r["h0_rank"] == want[k]["h0_rank"] and r["h1_rank"] == want[k]["h1_rank"]
        told = ("h0_share", "h0_r2", "h1_share")  # images of so few bars of dimension 1 have no third axis to fit
        np.testing.assert_allclose([r[c] for c in told], [want[k][c] for c in told], rtol=1e-5)


def test_features_are_porosity_and_correlations(spark):
    rng = np.random.default_rng(6)
    grids = {i: (rng.random((n, n)) < 0.4).astype(int) for i, n in enumerate((4, 5, 4, 7))}
    packed = spark.createDataFrame([(i, g.ravel().tolist()) for i, g in grids.items()], "sid long, grid array<int>").selectExpr("sid", "transform(grid, g -> cast(g as tinyint)) as grid")
    got = {r["sid"]: r["x"] for r in lattice.correlated(packed).collect()}
    pairs = {(r["sid"], r["dir"], r["lag"]): r["s2"] for r in lattice.two_point(packed).collect()}
    assert set(got) == set(grids)
    for i, g in grids.items():
        np.testing.assert_allclose(got[i], [1 - g.mean()] + [pairs[i, d, lag] for d in range(4) for lag in range(len(g) // 2 + 1)], atol=1e-12)


@pytest.mark.parametrize("weight", ["const", "linear"])
def test_images_of_structures_of_any_number_of_bars(weight):
    rng, count = np.random.default_rng(2), np.array([0, 3, 1, 3, 0, 7, 1])
    birth, length = rng.random((2, count.sum()))
    got = sweep.images(count, birth, length, 3, 0.25)(weight, (0.0, 1.25), (0.0, 1.0))
    place = np.repeat(np.arange(len(count)), count)
    for s in range(len(count)):
        for a in range(3):
            for b in range(3):
                far = (birth - (a + 0.5) * 1.25 / 3) ** 2 + (length - (b + 0.5) / 3) ** 2
                want = np.sum((place == s) * (length if weight == "linear" else 1.0) * np.exp(-far / 0.125)) / (2 * np.pi * 0.0625)
                assert abs(got[s, 3 * a + b] - want) < 1e-12


def test_states_by_stream_equal_the_batch(spark, tmp_path):
    start = datetime(2026, 1, 1)
    wanted = [(i, "ab"[i % 2]) for i in range(40)]
    arrivals = [(i, i % 3 > 0, start + timedelta(minutes=7 * i)) for i in range(0, 50, 2)]
    arrivals += [(0, True, start + timedelta(hours=5)), (2, True, start + timedelta(hours=9)), (6, None, start), (None, True, start), (2, False, start)]
    schemas = {"wanted": "sample_id long, stratum string", "arrivals": "sample_id long, valid boolean, at timestamp"}
    w, a = spark.createDataFrame(wanted, schemas["wanted"]), spark.createDataFrame(arrivals, schemas["arrivals"])
    w.write.parquet(f"{tmp_path}/wanted")
    streams = {k: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{k}") for k, s in schemas.items() if k == "wanted"}
    (tmp_path / "arrivals").mkdir()
    streams["arrivals"] = spark.readStream.schema(schemas["arrivals"]).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/arrivals")
    rows = audit.marked(streams["wanted"], streams["arrivals"])
    run = lambda: audit.tracked(rows, f"{tmp_path}/states", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    for part in range(3):  # files come one after the other, the stream is stopped and started anew
        spark.createDataFrame(arrivals[part::3], schemas["arrivals"]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/arrivals")
        query = run()
        query.awaitTermination()
    found, batch = audit.current(spark, f"{tmp_path}/states"), audit.states(audit.marked(w, a))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)
    state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert state == len({i for i, _ in wanted} | {i for i, *_ in arrivals if i is not None})
    report = {r["grp"]: r for r in audit.report(found).collect()}
    assert report[None]["stray"] == 5 and sum(r["missing"] for r in report.values()) == 20 and report["a"]["incomplete"] == 6
    # Valid ones came every 7 minutes up to the last hour, and the repair at the end of the ninth hour.
    now = F.lit(start + timedelta(hours=9)).cast("timestamp")
    rates = {r["hours"]: r for r in audit.rates(found, now).collect()}
    solved = [r["at"] for r in batch.where("state = 'complete'").collect()]
    for h in (1, 6):
        n = sum(timedelta(0) <= start + timedelta(hours=9) - t < timedelta(hours=h) for t in solved)
        assert rates[h]["solved"] == n and rates[h]["left"] == 26
        assert rates[h]["eta_hours"] == (round(26 * h / n, 6) if n else None)
