"""Orders, splits and quantiles with null strata, many strata, ties and empty tables."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from torusflow.operators import order, tables


def strata(rows, key):
    out = defaultdict(list)
    for i, s in rows:
        out[s].append(i)
    return {s: sorted(ids, key=key) for s, ids in sorted(out.items(), key=lambda t: (t[0] is None, t[0] or ""))}


def in_turn(groups):
    out, turn = {}, 0
    while any(len(ids) > turn for ids in groups.values()):
        for ids in groups.values():
            if len(ids) > turn:
                out[ids[turn]] = len(out) + 1
        turn += 1
    return out


def md5(i, seed):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    names = ["b", "a", None, "c"]
    return [(i, names[i % 7 % 4]) for i in range(400)] + [(1000 + i, "d") for i in range(3)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "sample_id long, stratum string")


def test_null_strata_stay_in_every_order(table, rows):
    by_id, shuffled = strata(rows, lambda i: i), strata(rows, lambda i: (md5(i, 3), -i))
    got = {r["sample_id"]: r["place"] for r in order.interleaved(table).collect()}
    assert got == in_turn(by_id)
    got = {r["sample_id"]: r["place"] for r in order.nested(table, 3).collect()}
    assert got == in_turn({s: ids[::-1] for s, ids in shuffled.items()})
    held = {r["sample_id"] for r in order.golden(table, 40, 3).where("split = 'golden'").collect()}
    assert held == {i for ids in shuffled.values() for i in ids[: round(40 * len(ids) / len(rows))]}
    assert order.golden(table, 40, 3).count() == len(rows)
    least = min(map(len, by_id.values()))
    assert {r["sample_id"] for r in order.matched(table, 3).collect()} == {i for ids in shuffled.values() for i in ids[: least // 2]}
    got = {(r["sample_id"], r["rn"]) for r in order.sliced(table, 10, 60).collect()}
    assert got == {(i, n) for ids in by_id.values() for n, i in enumerate(ids, 1) if 10 < n <= 60}
    folds = {r["sample_id"]: r["fold"] for r in order.group_folds(table).collect()}
    assert all(folds[i] == ["a", "b", "c", "d", None].index(s) for i, s in rows)


def test_many_strata_are_dealt_alike(table, rows, spark):
    key, place = F.col("sample_id"), in_turn(strata(rows, lambda i: i))
    ranked = order.dealt(table, "sample_id", "stratum", [key], order.value_bucket(table, "sample_id"), few=2)
    assert {r["sample_id"]: r["place"] for r in ranked.collect()} == place
    many = [(i, f"s{i % 170:03d}" if i % 11 else None) for i in range(2000)]
    got = order.interleaved(spark.createDataFrame(many, "sample_id long, stratum string"))
    assert {r["sample_id"]: r["place"] for r in got.collect()} == in_turn(strata(many, lambda i: i))


def test_rows_without_an_id_and_empty_tables(spark):
    some = spark.createDataFrame([(1, "a"), (None, "a"), (3, None)], "sample_id long, stratum string")
    assert sorted(r["place"] for r in order.nested(some, 1).collect()) == [1, 2, 3]
    assert sorted(r["place"] for r in order.interleaved(some).collect()) == [1, 2, 3]
    none = some.where("sample_id > 9")
    for f in (order.interleaved, lambda d: order.nested(d, 1), lambda d: order.golden(d, 9, 1), lambda d: order.matched(d, 1), lambda d: order.sliced(d, 0, 9), lambda d: order.folds(d, 5, 0)):
        assert f(none).count() == 0


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "few"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(1)
    n = 6 if kind == "few" else 30_000
    value = {"normal": rng.normal(size=n), "ties": np.where(rng.random(n) < 0.4, 1.5, rng.integers(0, 9, n)), "heavy": np.exp(20 * rng.normal(size=n)), "few": rng.normal(size=n)}[kind]
    group = rng.choice(["a", "b", "x"], n, p=[0.8, 0.19, 0.01])
    data = [(None if g == "x" else str(g), float(v)) for g, v in zip(group, value)] + [("a", None), ("only null", None), ("one", 4.25)]
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = order.quantiles(spark.createDataFrame(data, "g string, v double").repartition(5), "v", probabilities, ["g"])
    want = {g: np.quantile([v for h, v in data if h == g and v is not None], probabilities) for g in {g for g, v in data if v is not None}}
    got = {r["g"]: r["q"] for r in got.collect()}
    assert set(got) == set(want)
    for g, q in want.items():
        np.testing.assert_allclose(got[g], q, rtol=1e-12)


def test_quantiles_of_nothing_and_whole_tables(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert order.quantiles(df, "v", [0.5, 0.25]).first()["q"] == [5.0, 2.5]
    assert order.quantiles(df.where("v > 99"), "v", [0.5]).count() == 0
    assert {r["band"]: r["count"] for r in tables.quantile_bands(df, "v").groupBy("band").count().collect()} == {"low": 3, "mid": 5, "high": 3}
    assert tables.quantile_bands(df.where("v > 99"), "v").count() == 0


def test_no_plan_sorts_a_column_in_one_buffer(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "cast(id AS double) AS v")
    plan = tables.described(df, "g", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "percentile_approx(" in plan


def test_digests_of_ids(spark):
    from hashlib import sha256

    from torusflow.operators.digests import id_digests

    rng = np.random.default_rng(3)
    rows = [(str(g) if g else None, int(i)) for g, i in zip(rng.integers(0, 4, 3000), rng.integers(0, 900, 3000))] + [("hot", 7)] * 500 + [("hot", i) for i in range(5, 9)] + [("1", None), ("none", None)]
    df = spark.createDataFrame(rows, "grp string, sample_id long").withColumn("n", F.lit("x")).repartition(5)
    want = {}
    for g, i in rows:
        if i is not None:
            want.setdefault(g, []).append(i)
    text = lambda ids: sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    whole = lambda ids: (len(ids), min(ids), max(ids), len(set(ids)), text(ids))
    for piece in (1, 7, 1024):
        got = id_digests(df, ["grp"], piece=piece).collect()
        assert {r["grp"]: tuple(r)[1:] for r in got} == {g: whole(ids) for g, ids in want.items()} and len(got) == len(want)
    every = [i for _, i in rows if i is not None]
    assert tuple(id_digests(df, [], piece=9).first()) == whole(every)
    assert id_digests(df.limit(0), ["grp"]).count() == id_digests(df.limit(0), []).count() == 0
    assert [f.dataType.simpleString() for f in id_digests(df, ["grp"]).schema] == ["string", "bigint", "bigint", "bigint", "bigint", "string"]
