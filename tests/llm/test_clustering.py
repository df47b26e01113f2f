"""Centroid clustering against plain Lloyd rounds."""

import hashlib

import numpy as np
import pytest

from torusflow.llm import clustering, queries

from ..compare import oracle, spark_rows

SF = "/root/testdata/sf0.001"


def plain(rows, size, k, rounds, scale=64):
    """Rounds on all rows, every distance computed; rows: (id, vector)."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    points = np.array([[int(np.floor(scale * x)) for x in v] for _, v in kept], dtype=object).reshape(-1, size)
    cents = [list(p) for p in points[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        which = [nearest(p)[1] for p in points]
        for c in set(which):
            mine = points[[i for i, w in enumerate(which) if w == c]]
            cents[c] = [int(s) // len(mine) for s in mine.sum(0)]
    last = [nearest(p) for p in points]
    inertia = {c: sum(d for d, n in last if n == c) for _, c in last}
    total = sum(inertia.values())
    return sorted(((i, c, d, inertia[c], total, tuple(cents[c])) for (i, _), (d, c) in zip(kept, last)), key=repr)


def mine(spark, rows, size, k, rounds=3):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, tree int").repartition(3)
    got = clustering.cluster(df, size=size, k=k, rounds=rounds)
    return sorted(((r["id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in got.collect()), key=repr)


def test_cover_tree_covers_separates_and_nests():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (9, 5))
    points = np.unique(centres[rng.integers(0, 9, 700)] + rng.integers(-20, 20, (700, 5)), axis=0)
    tree = clustering.CoverTree(points, 4)
    assert sorted(tree.order) == list(range(len(points))) and (tree.points == points[tree.order]).all()
    nodes, level, last = np.zeros(1, np.int64), 0, None
    while True:
        assert np.array_equal(np.concatenate([np.arange(tree.first[v], tree.last[v]) for v in nodes]), np.arange(len(points)))
        for v in nodes:
            away = np.sqrt(((tree.points[tree.first[v] : tree.last[v]] - tree.points[tree.centre[v]]) ** 2).sum(1))
            assert tree.first[v] <= tree.centre[v] < tree.last[v] and np.isclose(away.max(), tree.radius[v])
        centres = set(tree.centre[nodes].tolist())
        assert last is None or last < centres
        last = centres
        if level == tree.depth - 1:
            break
        nodes, _ = tree.below(nodes, level)
        level += 1
    c = tree.points[sorted(last)]
    gaps = np.sqrt(((c[:, None] - c) ** 2).sum(2))[np.triu_indices(len(c), 1)]
    away = min(np.sqrt(((c - p) ** 2).sum(1)).min() for p in tree.points)
    assert len(c) > 100 and away == 0 and gaps.min() > 0
    assert max(np.sqrt(((c - p) ** 2).sum(1)).min() for p in tree.points) <= gaps.min() + 1e-9


def test_nodes_are_pruned_and_results_exact():
    rng = np.random.default_rng(2)
    centres = rng.integers(-2000, 2000, (8, 6))
    points = np.unique(centres[rng.integers(0, 8, 3000)] + rng.integers(-30, 30, (3000, 6)), axis=0)
    tree = clustering.CoverTree(points)
    cents = clustering.Centroids(np.concatenate([centres, centres[:2], rng.integers(-2000, 2000, (40, 6))]))
    nodes, _, leaves, _ = clustering.settle(tree, cents)
    assert (tree.last[nodes] - tree.first[nodes]).sum() > 0.9 * len(points) and len(nodes) < 200 and len(leaves) < 500
    which, best = clustering.assigned(tree, cents)
    d = ((tree.points[:, None] - cents.table) ** 2).sum(2)
    assert (which == d.argmin(1)).all() and (best == d.min(1)).all()


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_plain_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.standard_normal(4) / 8).tolist() if seed else (rng.integers(-2, 3, 4) / 64).tolist()) for i in rng.permutation(300)]
    rows += [(i, rows[0][1]) for i in range(1000, 1200)]  # one very common vector
    rows += [(7, [0.5, 0.5, 0.5, 0.5]), (7, [0.25, 0.5, 0.5, 0.5]), (7, [0.25, 0.5, 0.5, 0.5]), (None, [0.1, 0.2, 0.3, 0.4])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0, float("nan"), 0.0, 0.0]), (2004, [float("inf"), 0.0, 0.0, 0.0]), (2005, [None, 0.0, 0.0, 0.0]), (2006, [0.0] * 4)]
    assert mine(spark, rows, 4, 6) == plain(rows, 4, 6, 3)
    assert mine(spark, rows, 4, 40, 1) == plain(rows, 4, 40, 1)


def test_few_equal_and_no_vectors(spark):
    same = [(i, [0.5, -0.5]) for i in range(9)]
    assert mine(spark, same, 2, 4) == plain(same, 2, 4, 3)
    few = [(1, [0.5, -0.5]), (2, [0.01, 3.0]), (None, [9.0, 9.0])]
    assert mine(spark, few, 2, 16) == plain(few, 2, 16, 3)
    assert mine(spark, [(1, None)], 2, 16) == []
    with pytest.raises(Exception, match="beyond"):
        mine(spark, [(1, [1e9, 0.0])], 2, 2)


def test_large_components_stay_exact():
    rng = np.random.default_rng(3)
    points = np.unique(rng.integers(-clustering.LIMIT, clustering.LIMIT, (400, 64)), axis=0)
    cents = clustering.Centroids(points[::37].copy())
    which, best = clustering.assigned(clustering.CoverTree(points, 8), cents)
    assert (best[which >= 0] >= 0).all() and (which >= 0).all()
    got = {tuple(p): (w, b) for p, w, b in zip(clustering.CoverTree(points, 8).points.tolist(), which.tolist(), best.tolist())}
    for p in points[:40].tolist():
        want = min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(cents.table.tolist()))
        assert got[tuple(p)] == (want[1], want[0])


def test_query_equals_sql(spark):
    assert spark_rows(queries.QUERIES["op11_centroid_clusters"](spark, SF)) == oracle(SF, queries.ORACLES["op11_centroid_clusters"])
