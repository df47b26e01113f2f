"""Trees grown by Spark against trees grown by trying every cut of every feature."""

import numpy as np
import pytest

from torusflow.operators import models, trees


def exhaustive(x, y, rounds, depth, rate, ridge):
    """Oblivious boosted trees: at each level every (feature, value) is tried on the rows themselves."""
    mean = y.mean(0)
    pred, out = np.tile(mean, (len(x), 1)), []
    for _ in range(rounds):
        leaf, chosen = np.zeros(len(x), int), []
        left = y - pred
        for _ in range(depth):
            tried = []
            for j in range(x.shape[1]):
                for cut in np.unique(x[:, j])[:-1]:
                    gain, sides = 0.0, leaf * 2 + (x[:, j] > cut)
                    for v in np.unique(sides):
                        gain += (left[sides == v].sum(0) ** 2).sum() / ((sides == v).sum() + ridge)
                    tried.append((gain, j, cut))
            most = max(t[0] for t in tried)
            _, j, cut = min((t for t in tried if t[0] >= most * (1 - 1e-9)), key=lambda t: t[1:])
            chosen.append((j, cut))
            leaf = leaf * 2 + (x[:, j] > cut)
        values = np.stack([rate * left[leaf == v].sum(0) / ((leaf == v).sum() + ridge) for v in range(1 << depth)])
        out.append((chosen, values))
        pred = pred + values[leaf]
    return mean, out, pred


def table(spark, x, y, fold, parts=3):
    rows = [(i, a.tolist(), b.tolist(), int(f)) for i, (a, b, f) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, "sample_id long, x array<double>, y array<double>, fold int").repartition(parts)


@pytest.mark.parametrize("every,parts", [(2, 3), (10, 1)])
def test_equal_to_exhaustive_trees(spark, every, parts):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 20, (90, 19)).astype(float)  # more features than a block has
    y = np.stack([x[:, 0] * 0.5 + rng.normal(size=90), np.where(x[:, 17] > 9, 3.0, 0.0) + rng.normal(size=90)], 1)
    fold = np.arange(90) % 3
    got, edges = trees.grown(table(spark, x, y, fold, parts), targets=2, folds=[0, 1, 2], rounds=5, depth=3, rate=0.4, bins=32, ridge=1.0, hold=0.0, wait=0, every=every)
    assert len(got) == 9
    for m in got:
        use = fold != m.fold
        mean, want, pred = exhaustive(x[use], y[use][:, m.targets], 5, 3, 0.4, 1.0)
        np.testing.assert_allclose(m.mean, mean)
        assert [[(j, edges[j][c]) for j, c in t.splits] for t in m.trees] == [chosen for chosen, _ in want]
        for tree, (_, values) in zip(m.trees, want):
            np.testing.assert_allclose(tree.values, values, atol=1e-9)
        place = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        np.testing.assert_allclose(m.predict(place[use]), pred, atol=1e-9)


def test_all_rows_count_whatever_their_id(spark):
    """A step that only the last ids show is found, so no prefix of ids is fitted on."""
    n = 4000
    x, fold = np.stack([np.arange(n) % 2, np.arange(n)], 1).astype(float), np.zeros(n) + 1
    y = (np.arange(n) >= n - 200)[:, None] * 10.0
    got, edges = trees.grown(table(spark, x, y, fold), targets=1, folds=[0], joint=False, rounds=1, depth=1, rate=1.0, hold=0.0, wait=0)
    (j, cut) = got[0].trees[0].splits[0]
    assert j == 1 and n - 400 <= edges[1][cut] <= n - 100
    place = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    counts = np.bincount(got[0].trees[0].leaves(place), minlength=2)
    assert counts.sum() == n


def test_early_stop_keeps_the_best_round(spark):
    rng = np.random.default_rng(5)
    x, fold = rng.normal(size=(400, 3)), np.arange(400) % 2
    noise = rng.normal(size=(400, 1))
    got, _ = trees.grown(table(spark, x, noise, fold), targets=1, folds=[0, 1], joint=False, rounds=20, depth=3, rate=0.5, hold=0.3, wait=3)
    for m in got:
        assert m.best == int(np.argmin(m.errors)) and len(m.trees) <= m.best + 4 < 20
    signal = 5 * x[:, :1]
    kept, _ = trees.grown(table(spark, x, signal, fold), targets=1, folds=[0, 1], joint=False, rounds=6, depth=3, rate=0.3, hold=0.3, wait=3)
    assert all(m.best == 6 and m.errors[-1] < 0.2 * m.errors[0] for m in kept)


def test_constant_features_ties_and_lone_folds(spark):
    x, y, fold = np.ones((12, 2)), np.arange(12.0)[:, None], np.arange(12) % 2
    out = models.boosted(table(spark, x, y, fold), rounds=3, depth=2, folds=2)
    assert sorted((r["mode"], r["fold"], r["n"]) for r in out.collect()) == [(m, f, 6) for m in ("joint", "single") for f in (0, 1)]
    lone = models.boosted(table(spark, np.arange(8.0)[:, None], np.arange(8.0)[:, None], np.zeros(8)), rounds=2, depth=2, folds=1, joint=False).collect()
    assert [r["n"] for r in lone] == [8]  # nothing to learn from: the model says 0
    assert models.boosted(table(spark, x, y, fold).limit(0)).count() == 0


def test_main_axes_and_screens_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    rows = models.vectors(none)
    assert models.spectrum(rows, 20).count() == 0 and models.components(rows, 5).count() == 0
    assert models.effective_rank(rows, 64).collect()[0]["rank"] is None
    assert models.predictability(models.arrays(none)).count() == 0 and models.ridge(models.arrays(none)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 3)], "vec_id long, embedding array<float>, label int")
    assert models.components(models.vectors(one), 5).first()["components"] == []
    still = spark.createDataFrame([(i, [float(i), 1.0], 3) for i in range(40)], "vec_id long, embedding array<float>, label int")
    assert {r["r2"] for r in models.predictability(models.arrays(still), ks=(1, 2)).collect()} == {None}
