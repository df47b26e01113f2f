"""Properties of the kernels on small grids, checked on the numpy functions themselves."""

import heapq
from functools import reduce
from operator import xor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from torusflow.operators import flow
from torusflow.operators import generate as G
from torusflow.operators import lattice as L
from torusflow.operators import lattice3 as L3
from torusflow.operators import persistence as P
from torusflow.operators import topology as T

grids = arrays(np.int8, (1, 8, 8), elements=st.integers(0, 1))


def brute_distance(g, phase, cap):
    n, h, w = g.shape
    out = np.full(g.shape, float(cap))
    for k in range(n):
        ys, xs = np.nonzero(g[k] != phase)
        for y in range(h):
            for x in range(w):
                for b, a in zip(ys, xs):
                    dy, dx = abs(y - b), abs(x - a)
                    out[k, y, x] = min(out[k, y, x], np.hypot(min(dy, h - dy), min(dx, w - dx)))
    return out


@given(grids)
@settings(max_examples=25, deadline=None)
def test_distance_is_the_brute_one(g):
    assert np.allclose(L.distance(g, 0, 6), np.minimum(brute_distance(g, 0, 6), 6))


@given(grids, st.integers(0, 7), st.integers(0, 7))
@settings(max_examples=25, deadline=None)
def test_shift_moves_the_field(g, dx, dy):
    assert np.allclose(L.throat_field(np.roll(g, (dy, dx), (1, 2)), 4), np.roll(L.throat_field(g, 4), (dy, dx), (1, 2)))


@given(grids)
@settings(max_examples=25, deadline=None)
def test_labels_join_exactly_neighbours(g):
    on = g == 0
    lab = L.labels_of(on, True)[0]
    for y in range(8):
        for x in range(8):
            for dy, dx in ((0, 1), (1, 0)):
                a, b = lab[y, x], lab[(y + dy) % 8, (x + dx) % 8]
                assert not (a and b) or a == b
    for name in np.unique(lab[lab > 0]):  # one component a label
        cells = {tuple(c) for c in np.argwhere(lab == name)}
        reach, todo = set(), [next(iter(cells))]
        while todo:
            y, x = todo.pop()
            if (y, x) in cells and (y, x) not in reach:
                reach.add((y, x))
                todo += [((y + 1) % 8, x), ((y - 1) % 8, x), (y, (x + 1) % 8), (y, (x - 1) % 8)]
        assert reach == cells


def test_wedge_counts_and_symmetry():
    for theta in (0, 45, 90, 135):
        s = set(L.wedge(theta, 3, 6))
        assert {(-a, -b) for a, b in s} == s
    assert len(L.wedge(0, 3, 6)) == len(L.wedge(90, 3, 6)) == 48


def test_kernels_of_any_side(spark):
    """Structures of several sizes in one table, each by its own; wrong grids raise, null ones are left out."""
    rng = np.random.default_rng(0)
    grids2 = [(n, rng.integers(0, 2, (n, n)).astype(int)) for n in (8, 16, 32, 16)]
    df = spark.createDataFrame([(i, g.ravel().tolist()) for i, (_, g) in enumerate(grids2)] + [(9, None)], "sid long, grid array<tinyint>").repartition(1)
    s2 = {(r["sid"], r["dir"], r["lag"]): r["s2"] for r in L.two_point(df).collect()}
    profile = {(r["sid"], r["dir"], r["plane"]): r["profile"] for r in L.porosity_profile(df).collect()}
    for i, (n, g) in enumerate(grids2):
        for k, (dx, dy) in enumerate(L.DIRS):
            for lag in range(n // 2 + 1):
                assert abs(s2[i, k, lag] - (g * np.roll(g, (-dy * lag, -dx * lag), (0, 1))).mean()) < 1e-6
            y, x = np.mgrid[0:n, 0:n]
            assert all(abs(profile[i, k, p] - g[(dx * x + dy * y) % n == p].mean()) < 1e-6 for p in range(n))
    assert len(s2) == sum(4 * (n // 2 + 1) for n, _ in grids2)
    assert L.two_point(df.limit(0)).count() == 0
    bad = spark.createDataFrame([(2, [0, 1])], "sid long, grid array<tinyint>")
    for work in (L.two_point, L.porosity_profile, T.cluster_features):
        with pytest.raises(Exception, match="square"):
            work(bad).collect()


@given(arrays(np.int8, (2, 6, 6, 6), elements=st.integers(0, 1)))
@settings(max_examples=10, deadline=None)
def test_distance_in_space(g):
    got = L.distance(g, 0, 3)
    at = np.argwhere(g != 0)
    for k, z, y, x in np.argwhere(g == 0)[:40]:
        d = np.abs(at[at[:, 0] == k][:, 1:] - (z, y, x))
        want = np.sqrt((np.minimum(d, 6 - d) ** 2).sum(1)).min(initial=3.0)
        assert abs(got[k, z, y, x] - min(want, 3.0)) < 1e-12


def test_eigenvalues_in_closed_form():
    m = np.random.default_rng(1).normal(size=(50, 3, 3))
    m = m + m.transpose(0, 2, 1)
    m[0] = np.eye(3) * 2
    got = np.stack(L.eigenvalues3(m[:, 0, 0], m[:, 1, 1], m[:, 2, 2], m[:, 0, 1], m[:, 0, 2], m[:, 1, 2]), 1)
    assert np.allclose(got, np.linalg.eigvalsh(m)[:, ::-1], atol=1e-7)


# -- topology --------------------------------------------------------------------------


def test_lattices_of_turns():
    assert T.spans_turn(T.echelon([(2, 0), (3, 0)], 2), (1, 0))
    assert not T.spans_turn(T.echelon([(2, 0)], 2), (1, 0))
    assert T.spans_turn(T.echelon([(1, 1), (0, 2)], 2), (1, -1))
    assert not T.spans_turn(T.echelon([(1, 1)], 2), (1, 0)) and not T.spans_turn([], (0, 1)) and T.spans_turn([], (0, 0))
    assert T.spans_turn(T.echelon([(1, 1, 0), (0, 1, 1), (1, 0, 1)], 3), (2, 0, 0)) and not T.spans_turn(T.echelon([(1, 1, 0), (0, 1, 1), (1, 0, 1)], 3), (1, 0, 0))


def unrolled_turns(on, corners, far=3):
    """Of each cell: the turns, up to some periods, that a walk over the unrolled cells can make."""
    h, w = on.shape
    sides = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    out = {}
    for y, x in np.argwhere(on):
        seen, todo = {(y, x)}, [(y, x)]
        while todo:
            cy, cx = todo.pop()
            for a, b in sides:
                n = cy + a, cx + b
                if n not in seen and on[n[0] % h, n[1] % w] and abs(n[0] - y) <= far * h and abs(n[1] - x) <= far * w:
                    seen.add(n)
                    todo.append(n)
        out[y, x] = {((a - y) // h, (b - x) // w) for a, b in seen if (a - y) % h == 0 and (b - x) % w == 0}
    return out


@given(arrays(np.int8, (6, 6), elements=st.sampled_from([0, 0, 1])), st.booleans())
@settings(max_examples=25, deadline=None)
def test_windings_equal_unrolled_walks(g, corners):
    on = g == 0
    cover = T.cover_of(on, corners)
    for (y, x), turns in unrolled_turns(on, corners).items():
        root, _ = cover.find(int(y) * 6 + int(x))
        basis = cover.basis.get(root, [])
        assert all(T.spans_turn(basis, t) for t in turns)
        # Within one period and with room to walk, what the lattice has the walk finds.
        assert {t for t in [(0, 1), (1, 0), (1, 1), (1, -1)] if t in turns} <= {t for t in [(0, 1), (1, 0), (1, 1), (1, -1)] if T.spans_turn(basis, t)}
        if not basis:
            assert turns == {(0, 0)}


def structures_of(spark, *grids_):
    return spark.createDataFrame([(i, np.asarray(g).ravel().tolist()) for i, g in enumerate(grids_)], "sid long, grid array<tinyint>")


def test_channels_wind_along_their_own_direction(spark):
    n = 12
    y, x = np.mgrid[0:n, 0:n]
    along_x, along_y, diagonal = (np.where(b, 0, 1) for b in (y < 3, x < 3, (y - x) % n < 3))
    got = {r["sid"]: (r["basis"], r["along"], r["windings"]) for r in T.winding(structures_of(spark, along_x, along_y, diagonal, np.ones((n, n), int), np.zeros((n, n), int))).collect()}
    assert got == {0: ("1,0", "0", 1), 1: ("0,1", "2", 1), 2: ("1,1", "1", 1), 4: ("1,0;0,1", "0,1,2,3", 2)}
    flat = {(r["sid"], r["dir"]): r for r in T.critical_radius(structures_of(spark, along_x)).collect()}
    assert flat[0, 0]["radius"] == 2.0 and flat[0, 2]["radius"] == 0.0 and abs(flat[0, 0]["katz_thompson"] - 4 / 16) < 1e-6
    z, y, x = np.mgrid[0:8, 0:8, 0:8]
    tube = np.where((z < 3) & ((x - y) % 8 < 3), 0, 1)
    got = T.winding(structures_of(spark, tube), 3).collect()
    assert [(r["basis"], r["along"]) for r in got] == [("1,1,0", "3")]
    perc = T.percolates(structures_of(spark, np.where(z < 3, 0, 1)), 3).first()
    assert (perc["perc_x"], perc["perc_y"], perc["perc_z"]) == (1, 1, 0)


def shortest(on, start, goal, far):
    h, w = on.shape
    best, todo = {start: 0.0}, [(0.0, start)]
    while todo:
        d, (y, x) = heapq.heappop(todo)
        if (y, x) == goal:
            return d
        if d > best[y, x]:
            continue
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                n = y + a, x + b
                if (a or b) and on[n[0] % h, n[1] % w] and abs(n[0]) <= far and abs(n[1]) <= far and d + np.hypot(a, b) < best.get(n, np.inf) - 1e-12:
                    best[n] = d + np.hypot(a, b)
                    heapq.heappush(todo, (best[n], n))
    return np.nan


def test_tortuosity_equals_walks_of_any_length(spark):
    rng = np.random.default_rng(3)
    n = 8
    made = [(rng.random((n, n)) < 0.45).astype(int) for _ in range(12)]
    # A spiral way that leaves the three by three tile before it closes.
    made.append(np.array([[0 if (y - 3 * x) % n in (0, 1) else 1 for x in range(n)] for y in range(n)]))
    got = {(r["sid"], r["dir"]): (r["mean"], r["least"]) for r in T.tortuosity(structures_of(spark, *made)).collect()}
    for i, g in enumerate(made):
        on = g == 0
        anchors = [(a, b) for a in (0, n // 2) for b in (0, n // 2) if on[a, b]] or [tuple(int(v) for v in p) for p in np.argwhere(on)[:1]]
        for k, (dx, dy) in enumerate(L.DIRS):
            ways = [shortest(on, a, (a[0] + dy * n, a[1] + dx * n), 7 * n) / (np.hypot(dx, dy) * n) for a in anchors]
            ways = [v for v in ways if v == v]
            want = (np.mean(ways), min(ways)) if ways else (None, None)
            assert got[i, k] == (None, None) if not ways else np.allclose(got[i, k], want, atol=2e-6), (i, k)


def test_slab_and_counts(spark):
    n = 10
    straight = np.ones((n, n), int)
    straight[4] = 0
    wrap = np.ones((n, n), int)  # goes out at the top and comes in at the bottom
    wrap[0, :5] = wrap[9, 5:] = 0
    got = {r["sid"]: r for r in T.slab_tortuosity(structures_of(spark, straight, wrap, np.ones((n, n), int))).collect()}
    assert got[0]["tort_x"] == 1.0 and got[0]["tort_y"] is None and got[2]["tort_x"] is None
    assert abs(got[1]["tort_x"] - (8 + np.sqrt(2)) / 9) < 1e-6
    counts = {r["sid"]: (r["n_pore"], r["largest"], r["n_solid"], r["euler"]) for r in T.component_counts(structures_of(spark, straight, wrap, np.ones((n, n), int))).collect()}
    assert counts == {0: (1, 1.0, 2, -1), 1: (2, 0.5, 1, 1), 2: (0, None, 1, -1)}


def test_tortuosity_falls_back_to_the_first_pore_cell(spark):
    channel = np.ones((16, 16), np.int8)
    channel[3] = 0  # no anchor is pore
    rows = [(1, channel.ravel().tolist()), (2, [1] * 256), (3, [0] * 256)]
    got = {(r["sid"], r["dir"]): r["mean"] for r in T.tortuosity(spark.createDataFrame(rows, "sid long, grid array<tinyint>")).collect()}
    assert got == {(1, 0): 1.0} | {(1, d): None for d in (1, 2, 3)} | {(2, d): None for d in range(4)} | {(3, d): 1.0 for d in range(4)}


# -- persistence -----------------------------------------------------------------------


def rank2(rows):
    """The rank of a matrix of bits, rows as whole numbers."""
    basis = {}
    for r in rows:
        while r:
            top = r.bit_length()
            if top not in basis:
                basis[top] = r
                break
            r ^= basis[top]
    return len(basis)


@pytest.mark.parametrize("shape", [(5, 5), (3, 3, 3)])
def test_bars_equal_ranks_of_boundaries(shape):
    """At every level, the bars alive and the classes that never die are the Betti numbers."""
    rng = np.random.default_rng(4)
    dims = len(shape)
    for _ in range(3):
        f = rng.integers(0, 5, shape).astype(float)
        found, cells = P.bars(f), P.complex_of(f)

        def betti(level):
            on = [np.flatnonzero(v <= level) for v, _ in cells]
            ranks = [0] + [rank2([reduce(xor, [1 << int(c) for c in cells[d][1][i]]) for i in on[d]]) for d in range(1, dims + 1)] + [0]
            return [len(on[d]) - ranks[d] - ranks[d + 1] for d in range(dims + 1)]

        whole = betti(5)
        assert whole == {2: [1, 2, 1], 3: [1, 3, 3, 1]}[dims]
        for level in range(5):
            alive = [sum(k == d and b <= level < e for k, b, e in found) for d in range(dims + 1)]
            endless = [b - a for a, b in zip(alive, betti(level))]
            # What never dies only grows with the level, up to the torus's own classes.
            assert all(0 <= e <= w for e, w in zip(endless, whole))
        assert endless == whole


def reduced(f):
    """Bars by plain reduction of all boundary columns, whatever they close."""
    cells, out = P.complex_of(f), []
    ranks = [np.argsort(np.argsort(v, kind="stable"), kind="stable") for v, _ in cells]
    for d in range(1, len(cells)):
        value, faces = cells[d]
        lows = {}
        for cell in np.argsort(value, kind="stable").tolist():
            column = set()
            for r in ranks[d - 1][faces[cell]].tolist():
                column ^= {r}
            while column and max(column) in lows:
                column = column ^ lows[max(column)]
            if column:
                lows[max(column)] = column
                birth = float(np.sort(cells[d - 1][0])[max(column)])
                if value[cell] > birth:
                    out.append((d - 1, birth, float(value[cell])))
    return sorted(out)


@pytest.mark.parametrize("shape", [(1, 4), (2, 2), (2, 5), (6, 7), (2, 3, 2), (4, 3, 4), (1, 3, 2)])
def test_bars_equal_plain_reduction(shape):
    rng = np.random.default_rng(5)
    for levels in (1, 2, 4, 1000):
        f = rng.integers(0, levels, (3, *shape)).astype(float)
        at, *found = P.outer_bars(f)
        outer = list(zip(at.tolist(), *(c.tolist() for c in found)))
        for i, one in enumerate(f):
            want = reduced(one)
            assert sorted(P.bars(one)) == want
            assert sorted(bar for k, *bar in outer if k == i) == [list(b) for b in want if b[0] in (0, len(shape) - 1)]


def test_image_of_bars(spark):
    bars_ = spark.createDataFrame([(1, 0, 0.25, 0.5), (1, 0, 0.25, 0.5), (1, 1, 0.0, 1.0)], "sid long, dim int, birth double, death double")
    for name, weight in (("constant", lambda p: 1), ("linear", lambda p: p), ("quadratic", lambda p: p * p)):
        got = {(r["dim"], r["i"], r["j"]): r["value"] for r in P.image(bars_, weight=name, side=3, bandwidth=0.2).collect()}
        g = lambda b, p, i, j: weight(p) * np.exp(-((b - i / 2) ** 2 + (p - j / 2) ** 2) / 0.08) / (2 * np.pi * 0.04)
        assert all(abs(got[0, i, j] - 2 * g(0.25, 0.25, i, j)) < 1e-4 and abs(got[1, i, j] - g(0.0, 1.0, i, j)) < 1e-4 for i in range(3) for j in range(3))


# -- flow ------------------------------------------------------------------------------


def test_slit_flow_is_analytic_and_of_second_order():
    rule = flow.Rule(1e-8, 200, 2, 400, 40_000, 50, 5)
    errors = []
    for h, n in ((5, 8), (10, 16)):
        g = np.ones((1, n, 4), np.int8)
        g[0, :h] = 0
        q, _, ok = flow.solve(g, np.array([1e-6, 0.0]), rule)
        errors.append(q[0, 0] / 1e-6 / 6 / (h**3 / 12 / n) - 1)
        assert ok.all() and abs(q[0, 1]) < 1e-12
    assert abs(errors[0] - 0.04) < 1e-4 and abs(errors[0] / errors[1] - 4) < 0.01
    g = np.ones((1, 8, 4, 4), np.int8)
    g[0, :6] = 0  # normal to z
    q, _, ok = flow.solve(g, np.array([1e-6, 0, 0]), rule)
    assert ok.all() and abs(q[0, 0] / 1e-6 / 6 / (6**3 / 12 / 8) - 1) < 0.03 and np.abs(q[0, 1:]).max() < 1e-12


def test_flow_does_not_depend_on_block_mates(spark):
    rng = np.random.default_rng(5)
    g = (rng.random((6, 12, 12)) < 0.3).astype(np.int8)
    g[0] = 0
    g[0, :4] = 1
    rule = flow.Rule(1e-4, 50, 2, 100, 3000, 20, 5)
    all_q, all_t, all_ok = flow.solve(g, np.array([1e-5, 0.0]), rule)
    for k in range(6):
        q, t, ok = flow.solve(g[k : k + 1], np.array([1e-5, 0.0]), rule)
        assert np.array_equal(q[0], all_q[k], equal_nan=True) and t[0] == all_t[k] and ok[0] == all_ok[k]


def test_unsettled_flow_is_null(spark):
    rows = flow.tensor(structures_of(spark, np.where(np.mgrid[0:12, 0:12][0] < 9, 0, 1)), 2, rule=flow.Rule(1e-9, 10, 2, 20, 40, 10)).collect()
    along = [r for r in rows if (r["i"], r["j"]) == (0, 0)][0]
    assert along["settled"] == 0 and along["k"] is None and along["steps"] == 40


def test_velocities():
    for dims, count in ((2, 9), (3, 19)):
        c, w = flow.velocities(dims)
        assert len(c) == count and abs(w.sum() - 1) < 1e-12 and np.allclose(np.einsum("k,ka,kb->ab", w, c, c), np.eye(dims) / 3)


# -- generators ------------------------------------------------------------------------


@pytest.mark.parametrize("dims, n", [(2, 32), (3, 10)])
def test_generated_structures(spark, dims, n):
    for sample in (0, 1, 2):
        one, again = (G.structure(sample, n=n, dims=dims, seed=0, attempts=50) for _ in range(2))
        name, low, high = G.STRATA[sample % 3]
        solid = np.array(one[4]).reshape([n] * dims)
        assert one == again and one[0] == name and low <= one[1] <= high and 0.45 < one[2] < 0.85
        assert all(T._crossings(solid[None] == 0)[1][0])
    rng = np.random.default_rng(1)
    r = G.rotation(rng, dims)
    assert np.allclose(r @ r.T, np.eye(dims)) and abs(np.linalg.det(r) - 1) < 1e-9
    q = G.wavevectors(rng, 400, 4.0, 1.0, np.eye(dims), np.ones(dims))
    assert q.any(1).all() and 2 < np.linalg.norm(q, axis=1).min() and np.linalg.norm(q, axis=1).max() < 6
    f = G.field(np.array([[1] + [0] * (dims - 1)]), np.zeros(1), 8)
    assert np.allclose(f, np.sqrt(2) * np.cos(2 * np.pi * np.arange(8) / 8))  # along x, the last axis
    ids = spark.createDataFrame([(0,), (None,)], "sample_id long")
    assert G.structures(ids, n=8, dims=dims).count() == 1


def test_three_dimensional_stencils():
    cone = set(L3.cone((1, 0, 0), 2, 3))
    assert {tuple(-c for c in o) for o in cone} == cone


def test_axes_in_space(spark):
    z, y, x = np.mgrid[0:8, 0:8, 0:8]
    rod = np.where((z == 3) & (y == 3), 1, 0)  # along x
    got = {(r["x"], r["y"], r["z"]): r for r in L3.local_axis(structures_of(spark, rod)).collect()}
    assert got[4, 3, 3]["long0"] == 0.0 and got[4, 3, 3]["long1"] == 1.0 and got[0, 0, 0]["long0"] == L.OFF
    thin = {(r["x"], r["y"], r["z"]): r for r in L3.throat_dir(structures_of(spark, np.where(z < 4, 0, 1)), cap=2.0).collect()}
    iso = {(r["x"], r["y"], r["z"]): r["iso"] for r in L3.throat_iso(structures_of(spark, np.where(z < 4, 0, 1)), cap=2.0).collect()}
    assert thin[2, 2, 1]["d0"] == iso[2, 2, 1] == 0.0 and thin[2, 2, 1]["d2"] == 0.5 and thin[0, 0, 6]["d0"] == L.OFF
