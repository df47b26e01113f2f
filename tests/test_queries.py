"""Every query with SQL agrees with DuckDB on the smallest tables; the others run."""

import numpy as np
import pytest

from torusflow import queries as q

from .compare import oracle, spark_rows
from .conftest import SF


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_agrees(spark, name):
    assert spark_rows(q.QUERIES[name](spark, SF)) == oracle(SF, q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(q.KERNELS) - set(q.ORACLES)))
def test_runs(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_models(spark):
    ranks = q.QUERIES["sta12_effective_rank"](spark, SF).first()["rank"]
    assert 1 <= ranks <= 64
    total = [r["total"] for r in q.QUERIES["sta11_pca_spectrum"](spark, SF).collect()]
    assert all(b >= a for a, b in zip(total, total[1:]))


def test_models_have_the_published_settings():
    import inspect

    from torusflow.operators import models as m

    how = {k: v.default for k, v in inspect.signature(m.boosted).parameters.items()}
    assert (how["rounds"], how["depth"], how["rate"]) == (1500, 6, 0.05)
    assert len(inspect.signature(m.ridge).parameters["penalties"].default) == 15


def model_rows(spark, n=300, p=6):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, p))
    y = np.stack([2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=n), np.where(x[:, 2] > 0, 1.0, -1.0) * x[:, 3]], 1)
    fold = np.arange(n) % 5
    rows = [(i, a.tolist(), b.tolist(), int(f)) for i, (a, b, f) in enumerate(zip(x, y, fold))]
    return x, y, fold, spark.createDataFrame(rows, "sample_id long, x array<double>, y array<double>, fold int")


def test_trees_learn_and_joint_ones_too(spark):
    from torusflow.operators import models as m

    x, y, fold, df = model_rows(spark)
    got = {(r["mode"], r["target"], r["fold"]): r for r in m.boosted(df, rounds=30, depth=4, rate=0.3, wait=10).collect()}
    assert len(got) == 20 and sum(r["n"] for k, r in got.items() if k[:2] == ("joint", 0)) == 300
    for mode in ("single", "joint"):
        assert np.mean([got[mode, 0, f]["r2"] for f in range(5)]) > 0.8 and np.mean([got[mode, 1, f]["r2"] for f in range(5)]) > 0.4
    assert m.boosted(df.limit(0)).count() == 0


def test_ridge_equals_the_normal_equations(spark):
    from torusflow.operators import models as m

    x, y, fold, df = model_rows(spark)
    got = {r["fold"]: r for r in m.ridge(df, penalties=(0.5,)).collect()}
    for f in range(5):
        a, b = x[fold != f], y[fold != f]
        mu, sd = a.mean(0), a.std(0)
        z = (a - mu) / sd
        w = np.linalg.solve(z.T @ z + 0.5 * np.eye(6), z.T @ (b - b.mean(0)))
        e = y[fold == f] - ((x[fold == f] - mu) / sd @ w + b.mean(0))
        want = 1 - (e**2).sum() / ((y[fold == f] - y[fold == f].mean(0)) ** 2).sum()
        assert abs(got[f]["r2"] - want) < 1e-9 and abs(got[f]["mse"] - (e**2).mean()) < 1e-9
    screen = m.predictability(df, ks=(1, 6)).collect()
    assert screen[1]["explained"] > 0.999999 and screen[0]["explained"] < 1 and screen[1]["r2"] > screen[0]["r2"]


def test_components_are_as_many_as_there_can_be(spark):
    from torusflow.operators import models as m

    few = m.vectors(spark.createDataFrame([(i, [float(i), float(i * i), 1.0 + i % 2], i % 2) for i in range(3)], "vec_id long, embedding array<float>, label int"))
    assert len(m.components(few, 10).first()["components"]) == 2
