"""Gates, reports and orders over tables, and the symmetries, on small rows with results written down."""

import numpy as np
import pytest

from torusflow.operators import flow, order, rocks, splits, symmetry
from torusflow.operators import tables as T


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


PART = "sample_id long, stratum string, porosity double, ecp_a0_0 double, ecp_a0_1 double"


def test_part_gates(spark):
    structures = table(spark, [(i, "iso", 0.5) for i in range(6)], "sample_id long, stratum string, porosity double")
    head = table(spark, [(i, "iso", 0.5, float(i), 1.0) for i in range(3)], PART)
    tail = [(i, "iso", 0.5, float(i), 1.0) for i in range(3, 6)]
    good = T.merged([head, table(spark, tail[::-1], PART)], structures).collect()
    assert [r["sample_id"] for r in good] == list(range(6))
    wrong = {
        "columns": table(spark, tail, PART).withColumnRenamed("ecp_a0_1", "ecp_a0_2"),
        "moved": table(spark, tail, PART).select("sample_id", "stratum", "porosity", "ecp_a0_1", "ecp_a0_0"),
        "missing": table(spark, tail[:2], PART),
        "overlap": table(spark, [*tail, (0, "iso", 0.5, 0.0, 1.0)], PART),
        "repeated": table(spark, [*tail, tail[0]], PART),
        "stray": table(spark, [*tail, (9, "iso", 0.5, 0.0, 1.0)], PART),
        "metadata": table(spark, [*tail[:2], (5, "iso", 0.5 + 1e-6, 5.0, 1.0)], PART),
        "stratum": table(spark, [*tail[:2], (5, "mod", 0.5, 5.0, 1.0)], PART),
        "values": table(spark, [*tail[:2], (5, "iso", 0.5, float("nan"), 1.0)], PART),
        "empty": table(spark, [], PART),
    }
    for name, part in wrong.items():
        with pytest.raises(ValueError, match=name):
            T.merged([head, part], structures)
    with pytest.raises(ValueError):
        T.read_part(head.drop("sample_id"))


def test_targets_and_columns():
    assert T.expanded_targets(["tensor", "k_xx", "extra"], {"tensor": ["k_xx", "k_yy"]}, ["k_xx", "k_yy", "extra"]) == ["k_xx", "k_yy", "extra"]
    with pytest.raises(ValueError, match="k_zz"):
        T.expanded_targets(["k_zz"], {}, ["k_xx"])


def test_reports(spark):
    rows = table(spark, [("b", 1.0), ("a", 0.5), ("c", None)], "grp string, r2 double")
    assert T.markdown(rows.orderBy("grp")) == "| grp | r2 |\n|-|-|\n| a | 0.5000 |\n| b | 1.0000 |\n| c |  |"
    with pytest.raises(ValueError):
        T.markdown(rows, limit=2)
    got = [(r["grp"], r["place"]) for r in T.ordered_report(rows, "grp", ["c"], "r2").orderBy("place").collect()]
    assert got == [("c", 1), ("a", 2), ("b", 3)]
    zero = {(r["a"], r["b"]): r["n"] for r in T.zero_filled(table(spark, [("x", 1), ("x", 1), ("y", 2)], "a string, b int"), "a", "b").collect()}
    assert zero == {("x", 1): 2, ("x", 2): 0, ("y", 1): 0, ("y", 2): 1}
    bands = {r["v"]: r["band"] for r in T.banded(table(spark, [(0.3,), (0.4,), (0.7,)], "v double"), "v", [(0.3, 0.4, "low"), (0.4, 0.7, "high")]).collect()}
    assert bands == {0.3: "low", 0.4: "high"}


def test_sizes_that_reach_a_goal(spark):
    runs = table(spark, [("k", g, n, v) for g, vs in {"soon": (0.6, 0.7, 0.8), "mid": (0.2, 0.6, 0.7), "never": (0.1, 0.2, 0.3)}.items() for n, v in zip((100, 200, 400), vs)], "target string, grp string, size int, r2 double")
    got = {r["grp"]: r["reached"] for r in T.reached(runs, 0.5).collect()}
    assert got == {"soon": "<=100", "never": ">400", "mid": str(round(np.exp(np.log(100) + 0.75 * np.log(2))))}


def test_scores(spark):
    rng = np.random.default_rng(0)
    truth, pred = rng.normal(1e6, 3, 200), rng.normal(1e6, 3, 200)
    rows = [(0, float(a), float(b)) for a, b in zip(truth, pred)] + [(0, 1.0, float("nan")), (1, 2.0, 2.0)]
    got = {r["fold"]: r for r in T.fold_metrics(table(spark, rows, "fold int, truth double, pred double"), ["fold"]).collect()}
    assert abs(got[0]["r2"] - (1 - ((truth - pred) ** 2).sum() / ((truth - truth.mean()) ** 2).sum())) < 1e-5 and got[0]["n"] == 200
    assert got[1]["r2"] is None and got[1]["mae"] == 0
    pairs = table(spark, [("g", d) for d in (1.0, 2.0, 4.0)] + [("flat", 1.0), ("flat", 1.0)], "grp string, d double")
    t = {r["grp"]: r["t"] for r in T.paired_t(pairs, ["grp"]).collect()}
    assert t["flat"] == 0 and abs(t["g"] - np.mean([1, 2, 4]) / (np.std([1, 2, 4], ddof=1) / np.sqrt(3))) < 1e-4
    scaled = T.scaled_target(table(spark, [(i, float(i)) for i in range(5)], "sample_id long, k double"), T.F.col("sample_id") < 4, "k")
    back = {r["sample_id"]: r["z"] for r in T.unscaled(scaled, 1.5, float(np.std([0, 1, 2, 3]))).collect()}
    assert all(abs(v - k) < 1e-4 for k, v in back.items())


@pytest.mark.parametrize("key", [lambda i: i, lambda i: i * i * 1000, lambda i: 10**12 * (i % 2) + i])
def test_ranks_over_buckets(spark, key):
    """Ranks by buckets are those of one sorted list, whatever the ids look like."""
    rows = [(key(i), "abc"[i % 3] if i % 7 else "a") for i in range(700)]
    df = table(spark, rows, "sample_id long, stratum string").repartition(7)
    want, seen = [], {}
    for i, s in sorted(rows):
        seen[s] = seen.get(s, 0) + 1
        want.append((seen[s], s, i))
    places = {i: n for n, (_, _, i) in enumerate(sorted(want), 1)}
    assert {r["sample_id"]: r["place"] for r in order.interleaved(df).collect()} == places
    got = sorted((r["place"], r["stratum"]) for r in order.nested(df, 3).collect())
    assert [p for p, _ in got] == list(range(1, 701)) and [s for _, s in got] == [s for _, s, _ in sorted(want)]
    folds = [r["fold"] for r in order.folds(df, 5, 0).collect()]
    assert [folds.count(f) for f in range(5)] == [140] * 5
    assert {r["rn"] for r in order.sliced(df, 10, 60).collect()} == set(range(11, 61))
    assert order.interleaved(df.limit(0)).count() == 0


def test_numpy_exact_splits(spark):
    ids = np.random.default_rng(0).permutation(300)
    df = table(spark, [(int(i), "xyz"[i % 3]) for i in ids], "sample_id long, stratum string")
    held = {r["sample_id"] for r in order.exact_golden(df, 60, 1).where("split = 'golden'").collect()}
    assert held == set(splits.golden(np.arange(300), np.array(["x", "y", "z"])[np.arange(300) % 3], 60, 1).tolist())
    assert {r["sample_id"]: r["fold"] for r in order.exact_folds(df, 5, 2).collect()} == dict(enumerate(splits.folds(300, 5, 2).tolist()))
    with pytest.raises(ValueError):
        order.exact_folds(df, 5, 2, most=10)


@pytest.mark.parametrize("dims, count", [(2, 8), (3, 48)])
def test_symmetries_of_tensor_and_structure_agree(spark, dims, count):
    """The permeability of a turned structure is the turned permeability."""
    ms = symmetry.signed_permutations(dims)
    assert len(ms) == count and np.array_equal(ms[0], np.eye(dims)) and all(abs(round(np.linalg.det(m))) == 1 for m in ms)
    n = 8 if dims == 2 else 5
    g = (np.random.default_rng(2).random([n] * dims) < 0.25).astype(int)
    df = spark.createDataFrame([(1, g.ravel().tolist())], "sid long, grid array<tinyint>")
    turned = symmetry.grids(df, dims)
    assert symmetry.incomplete_families(turned, dims).count() == 0 and symmetry.incomplete_families(turned.where("g <> 3"), dims).count() == 1
    made = {r["g"]: np.array(r["grid"]).reshape([n] * dims) for r in turned.collect()}
    rule = flow.Rule(1e-9, 50, 2, 100, 5000, 10, 5)

    def tensor(x):
        return np.stack([flow.solve(x[None], 1e-6 * np.eye(dims)[j], rule)[0][0] for j in range(dims)], 1) / 6e-6

    base, axes = tensor(g), "xyz"[:dims]
    perm = spark.createDataFrame([(1, *base.ravel().tolist())], "sample_id long, " + ", ".join(f"k_{a}{b} double" for a in axes for b in axes))
    want = {r["g"]: np.array([[r[f"k_{a}{b}"] for b in axes] for a in axes]) for r in symmetry.tensors(perm, dims).collect()}
    for k in (range(count) if dims == 2 else (0, 1, 7, 20, 33, 47)):
        assert np.allclose(want[k], ms[k] @ base @ ms[k].T)
        assert np.allclose(tensor(made[k]), want[k], atol=1e-6), k


def test_rock_cubes(spark):
    n, side = 40, 9
    rng = np.random.default_rng(3)
    rock = (rng.random((n, n, n)) < 0.3).astype(np.uint8)
    planes = spark.createDataFrame([("r", n, z, bytearray(rock[z].tobytes())) for z in range(n)], "rock string, n long, z long, plane binary")
    plain = (1, "r", 20.0, 20.0, 20.0, 1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0)
    quarter = (2, "r", 20.0, 20.0, 20.0, 1.0, 0.0, 2.0, 1.0, float(np.cos(np.pi / 4)), 0.0, 0.0, float(np.sin(np.pi / 4)))
    out = (3, "r", 2.0, 20.0, 20.0, 1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0)
    grown = (4, "r", 20.0, 20.0, 20.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0)
    design = spark.createDataFrame([plain, quarter, out, grown], "sid long, rock string, cx double, cy double, cz double, scale double, grow double, a double, b double, qw double, qx double, qy double, qz double")
    got = {r["sid"]: r["grid"] for r in rocks.cubes(planes, design, side).collect()}
    cut = rock[16:25, 16:25, 16:25]
    assert (np.array(got[1]).reshape([side] * 3) == cut).all() and got[3] is None
    assert (np.array(got[4]).reshape([side] * 3) <= cut).all() and sum(got[4]) < sum(got[1])  # grow widens pores
    # Stretched by 2 along the turned first axis, y, and narrower across: neighbours along y are more alike.
    g = np.array(got[2]).reshape([side] * 3)
    alike = [(np.diff(g, axis=a) == 0).mean() for a in (2, 1, 0)]
    assert alike[1] > alike[0] and alike[1] > alike[2]
    f = rocks.signed_distance(cut, 4)
    for z, y, x in [(0, 0, 0), (4, 4, 4), (8, 3, 1)]:
        other = np.argwhere(cut != cut[z, y, x])
        d = min(4.0, np.sqrt(((other - (z, y, x)) ** 2).sum(1)).min() - 0.5)
        assert abs(abs(f[z, y, x]) - d) < 1e-12 and (f[z, y, x] > 0) == (cut[z, y, x] == 0)
    m = rocks.metrics(spark.createDataFrame([(1, got[1])], "sid long, grid array<tinyint>")).first()
    assert abs(m["porosity"] - (1 - cut.mean())) < 1e-6 and m["dt_p10"] <= m["dt_p50"] <= m["dt_p90"] and 0 < m["largest"] <= 1


def test_grown_planes_chords_and_axes(spark):
    n, side = 32, 11
    rock = np.zeros((n, n, n), np.uint8)
    rock[:, :, 14:18] = 1  # a plate of four cells across x
    planes = spark.createDataFrame([("r", n, z, bytearray(rock[z].tobytes())) for z in range(n)], "rock string, n long, z long, plane binary")
    fields = "sid long, rock string, cx double, cy double, cz double, scale double, grow double, a double, b double, qw double, qx double, qy double, qz double"
    design = spark.createDataFrame([(i, "r", 15.0, 15.0, 15.0, 1.0, g, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0) for i, g in enumerate((-1.0, 0.0, 1.0, 0.4, 0.6))], fields)
    got = {r["sid"]: np.array(r["grid"]).reshape([side] * 3) for r in rocks.cubes(planes, design, side).collect()}
    # One cell on each side comes off or on; less than half a cell changes nothing, more takes the outer cells.
    assert [int(got[i][5, 5].sum()) for i in range(5)] == [6, 4, 2, 4, 2]
    assert all((got[i] == got[i][5, 5]).all() for i in range(5))
    # Twice as wide along x, and as before across: the plate of four has eight cells.
    wide = spark.createDataFrame([(1, "r", 15.5, 15.0, 15.0, 1.0, 0.0, 2.0, 1.0, 1.0, 0.0, 0.0, 0.0)], fields)
    assert int(np.array(rocks.cubes(planes, wide, 12).first()["grid"]).reshape([12] * 3)[5, 5].sum()) == 8
    # A pilot's cubes can be cut out: turned evenly, inside the rock, alike on any layout.
    volumes = spark.createDataFrame([("r", n)], "rock string, n long")
    pilots = rocks.pilot(volumes, [1.0], [0.0, 0.25], 3, side=9, seed=4)
    rows = pilots.collect()
    assert len(rows) == 30 and len({r["sid"] for r in rows}) == 30 and rows[0]["tag"].startswith("s1.0_g0.00_a1.0_b1.0_r")
    assert all(abs(r["qw"] ** 2 + r["qx"] ** 2 + r["qy"] ** 2 + r["qz"] ** 2 - 1) < 1e-12 for r in rows)
    assert all(r["grid"] is not None for r in rocks.cubes(planes, pilots, 9).collect())
    with pytest.raises(Exception, match="fit"):
        rocks.pilot(volumes, [9.0], [0.0], 1, side=9).collect()
    pore = np.array([[[1, 1, 0, 1, 0, 0, 1, 1]]], bool)
    assert rocks.mean_chord(pore, 2) == 5 / 3 and rocks.mean_chord(pore, 1) == 1.0 and np.isnan(rocks.mean_chord(~pore & pore, 0))
    # Balls stretched threefold along a tilted axis show it.
    axis = np.array([2.0, 1.0, -1.0]) / np.sqrt(6)
    rng, at = np.random.default_rng(7), np.stack(np.mgrid[:40, :40, :40][::-1], -1).reshape(-1, 3)
    solid = np.zeros(len(at), bool)
    for c in rng.uniform(0, 40, (60, 3)):
        d = at - c
        along = d @ axis
        solid |= (along / 3) ** 2 + ((d**2).sum(1) - along**2) <= 9
    cube = solid.reshape(40, 40, 40).astype(np.int8)
    m = rocks.metrics(spark.createDataFrame([(1, cube.ravel().tolist())], "sid long, grid array<tinyint>")).first()
    found = np.array([m["axis_x"], m["axis_y"], m["axis_z"]])
    assert np.degrees(np.arccos(min(1.0, abs(found @ axis)))) < 5


def test_functions_by_expression_and_by_name(spark):
    from torusflow import functions as Fn

    assert Fn.register(spark) == list(Fn.SQL)
    row = spark.sql("SELECT direction_tag(1, -1, 0) AS tag, kozeny_carman(0.5D, 0.25D) AS kc, slit_permeability(5D, 16D) AS k").first()
    exact = sum((z + 0.5) * (5 - z - 0.5) for z in range(5)) / 32
    assert row["tag"] == "a1_-1_0" and row["kc"] == 2.0 and abs(row["k"] - exact) < 1e-12
    rows = spark.createDataFrame([(t,) for t in ("a1_-1_0", "a135", "a45", "a0", "a1_0_0")], "tag string")
    assert [r["tag"] for r in rows.orderBy(Fn.tag_order(T.F.col("tag"))).collect()] == ["a0", "a45", "a135", "a1_-1_0", "a1_0_0"]
    one = spark.range(1).select(Fn.slit_permeability(T.F.lit(5), T.F.lit(16)).alias("k"), Fn.direction_tag(*[T.F.lit(v) for v in (1, 0, -1)]).alias("t"), Fn.smeared(T.F.lit(0.5), T.F.lit(0.0), T.F.lit(1.0)).alias("s")).first()
    assert abs(one["k"] - exact) < 1e-12 and one["t"] == "a1_0_-1" and one["s"]
