"""Sticks, junctions, blobs across the seam and plugs against plain versions."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from torusflow.operators import graph, sticks


def test_components_equal_search(spark):
    rng = np.random.default_rng(0)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 400, (230, 2))]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 90)] + [(7, 7), (9000, 9000), (1000, 1000)]
    got = {r["id"]: r["root"] for r in graph.components(spark.createDataFrame([*edges, *edges[:5], (None, 3)], "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        if start not in want:
            todo = [start]
            while todo:
                at = todo.pop()
                if at not in want:
                    want[at] = start
                    todo += near[at]
    assert got == want
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def flood(cells, size):
    """Blobs of one network by search around the torus."""
    left, out = set(cells), []
    while left:
        todo, blob = [min(left, key=lambda c: c[1] * size + c[0])], set()
        while todo:
            x, y = todo.pop()
            if (x, y) in left:
                left.remove((x, y))
                blob.add((x, y))
                todo += [((x + 1) % size, y), ((x - 1) % size, y), (x, (y + 1) % size), (x, (y - 1) % size)]
        out.append(blob)
    return out


@pytest.mark.parametrize("size", [5, 16])
def test_blobs_and_centres_across_seams(spark, size):
    rng = np.random.default_rng(size)
    nets = {sid: {(int(x), int(y)) for y, x in np.argwhere(rng.random((size, size)) < p)} for sid, p in ((1, 0.3), (2, 0.55), (3, 0.05), (2**40, 1.0))}
    nets[4] = {(0, 0), (size - 1, 0), (0, size - 1)}  # one blob over the corner
    rows = [(s, x, y) for s, cells in nets.items() for x, y in cells]
    labelled = sticks.blobs(spark.createDataFrame(rows, "sid long, x int, y int"), size)
    got = defaultdict(set)
    for r in labelled.collect():
        got[r["sid"], r["blob"]].add((r["x"], r["y"]))
    want = {(s, min(y * size + x for x, y in blob)): blob for s, cells in nets.items() for blob in flood(cells, size)}
    assert got == want
    seam = sticks.centres(labelled.where("sid = 4"), size).collect()
    assert len(seam) == 1 and {seam[0]["x"], seam[0]["y"]} <= {0, size - 1} and seam[0]["cells"] == 3


def test_plugs_take_their_share(spark):
    size = 24
    pore = {(x, y) for x in range(size) for y in range(size) if x % 6 < 2 or y % 6 < 2}
    joints = {(x, y) for x, y in pore if x % 6 < 2 and y % 6 < 2}
    table = lambda cells: spark.createDataFrame([(9, x, y) for x, y in cells], "sid long, x int, y int")
    left, report = sticks.plugged(table(pore), table(joints), 0.4, 2.0, size, seed=3)
    r = report.first()
    names = sorted((min(y * size + x for x, y in b) for b in flood(joints, size)), key=lambda b: hashlib.md5(f"3:9:{b}".encode()).hexdigest())
    assert r["n_junctions"] == 16 and r["n_blocked"] == 6 and r["pore_cells"] == len(pore)
    # A blob of 2 x 2 cells has its mean between them, and halves go up.
    discs = {((b % size + 1 + dx) % size, (b // size + 1 + dy) % size) for b in names[:6] for dx in range(-2, 3) for dy in range(-2, 3) if dx * dx + dy * dy <= 4}
    assert {(q["x"], q["y"]) for q in left.collect()} == pore - discs and r["left_cells"] == len(pore - discs)
    none = sticks.plugged(table(pore), table(set()), 0.4, 2.0, size)[1].first()
    assert (none["n_junctions"], none["n_blocked"], none["left_cells"]) == (0, 0, len(pore))


@pytest.mark.parametrize("kappa", [0.0, 0.5, 2.0, 12.0, 200.0])
def test_von_mises_has_its_mean_and_concentration(spark, kappa):
    n, mean = 6000, 2.5
    rows = spark.range(n).select(sticks.von_mises(F.lit(mean), F.lit(kappa), F.col("id"), F.lit("t")).alias("a"))
    z = np.exp(1j * np.array([r["a"] for r in rows.repartition(3).collect()]))
    grid = np.linspace(-np.pi, np.pi, 20001)[:-1]
    weight = np.exp(kappa * (np.cos(grid) - 1))
    length, square = (weight * np.cos(grid)).sum() / weight.sum(), (weight * np.cos(grid) ** 2).sum() / weight.sum()
    turned = (z * np.exp(-1j * mean)).mean()
    assert abs(turned.real - length) < 5 * np.sqrt((square - length**2) / n) + 1e-9
    assert abs(turned.imag) < 5 * np.sqrt((1 - square) / n) + 1e-9


def test_raster_and_junctions_equal_plain_ones(spark):
    size = 32
    nets = spark.createDataFrame([(i, 0.3 * i, k, p) for i, (k, p) in enumerate([(0.0, 0.2), (3.0, 0.4), (12.0, 0.3)])], "sid long, psi double, kappa double, porosity double")
    lines = sticks.sticks(nets, size, 5)
    rows = lines.collect()
    assert len(rows) == sum(max(4, round(-np.log(1 - p) * size * size / 60)) for p in (0.2, 0.4, 0.3)) and {r["width"] for r in rows} <= set(range(2, 10))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sticks.sticks(nets.repartition(3), size, 5).collect()))
    cells, near = defaultdict(set), defaultdict(lambda: defaultdict(int))
    for r in rows:
        n = max(2, int(np.ceil(2 * r["length"])))
        for i in range(n):
            t = r["length"] * (i / (n - 1) - 0.5)
            cells[r["sid"], r["seg"]].add((int(np.floor(r["cx"] + t * np.cos(r["theta"]))) % size, int(np.floor(r["cy"] + t * np.sin(r["theta"]))) % size))
    for (s, _), own in cells.items():
        for c in {((x + a) % size, (y + b) % size) for x, y in own for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))}:
            near[s][c] += 1
    drawn = sticks.raster(lines, size)
    assert {(r["sid"], r["seg"], r["x"], r["y"]) for r in drawn.collect()} == {(*k, *c) for k, own in cells.items() for c in own}
    assert {(r["sid"], r["x"], r["y"]) for r in sticks.junctions(drawn, size).collect()} == {(s, *c) for s, own in near.items() for c, n in own.items() if n > 1}
    assert sticks.junctions(drawn.where("sid > 9"), size).count() == 0
