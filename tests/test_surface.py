"""The mesh surface: plates, a ball, tilted plates, and closed meshes."""

import numpy as np
import pytest

from torusflow.operators import surface


def of(spark, solids):
    rows = [(i, s.astype(int).ravel().tolist()) for i, s in enumerate(solids)]
    got = surface.kozeny_carman(spark.createDataFrame(rows, "sid long, grid array<tinyint>"))
    return [r.asDict() for r in sorted(got.collect(), key=lambda r: r["sid"])]


def test_plates_ball_and_tilted_plates(spark):
    z, y, x = np.mgrid[:40, :40, :40]
    ball = (x - 20) ** 2 + (y - 20) ** 2 + (z - 20) ** 2 <= 144
    plates, round_, tilted, mirrored, none = of(spark, [x % 10 < 4, ball, (x + y) % 8 < 3, (x - y) % 8 < 3, x < 0])
    assert abs(plates["s_mesh"] - 0.2) < 1e-9 and abs(plates["s_face"] - 0.2) < 1e-9
    assert plates["t_xx"] == 0 and plates["t_yy"] == plates["t_zz"] > 0 and plates["t_xy"] == plates["t_xz"] == plates["t_yz"] == 0
    assert abs(round_["s_mesh"] * 64000 / (4 * np.pi * 144) - 1) < 0.08
    each = [round_[f"t_{c}"] for c in ("xx", "yy", "zz")]
    assert max(each) - min(each) < 0.02 * each[0] and abs(round_["t_xy"]) < 0.02 * each[0]
    assert tilted["t_xy"] < 0 < mirrored["t_xy"] and abs(tilted["t_xy"] + mirrored["t_xy"]) < 1e-9
    assert none["k"] is None and none["t_xx"] is None and none["s_mesh"] == 0 and none["phi"] == 1


def test_every_case_is_a_closed_set_of_loops_and_turns_with_the_cube():
    for case in range(256):
        edges = [e for loop in surface.loops(case) for e in loop]
        assert len(edges) == len(set(edges)) and all((case >> a & 1) != (case >> b & 1) for a, b in edges)
        cut = sum((case >> a & 1) != (case >> b & 1) for a in range(8) for b in range(a) if (a ^ b) in (1, 2, 4))
        assert len(edges) == cut and all(len(loop) >= 3 for loop in surface.loops(case))


@pytest.mark.parametrize("seed", [0, 1])
def test_meshes_close_around_the_torus(seed):
    """Each piece of a face between two cubes is met from both, so every triangle edge inside a face occurs twice."""
    g = np.random.default_rng(seed).random((4, 5, 6)) < 0.5
    met: dict = {}
    size = np.array(g.shape[::-1])
    for cell, case in np.ndenumerate(surface.case_of(g)):
        at = np.array(cell[::-1])
        for loop in surface.loops(int(case)):
            points = [tuple((at * 2 + np.array(surface.CORNERS[a]) + surface.CORNERS[b]) % (2 * size)) for a, b in loop]
            for p, q in zip(points, points[1:] + points[:1]):
                key = tuple(sorted((p, q)))
                met[key] = met.get(key, 0) + 1
    assert met and all(n % 2 == 0 for n in met.values())
