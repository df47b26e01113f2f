"""The surface between solid and pore as a mesh, and what Kozeny and Carman make of it.

Eight neighbouring cells are the corners of a cube, their phases a case out of 256. The
mesh of a case follows from a rule: an edge between unlike corners is cut in its middle, a
face joins its cuts in pairs (around each solid corner where all four edges are cut, so
that both cubes at a face agree), and the pairs close to loops, each a fan of triangles. A
structure's surface is then the sum of what its cases have.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
from pyspark.sql import DataFrame

from .lattice import kernel, rounded

#: Corners of a cube by bit: x + 2 y + 4 z.
CORNERS = [tuple(c >> a & 1 for a in range(3)) for c in range(8)]
#: Components of a symmetric tensor in order.
PAIRS = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]


def faces() -> list[list[int]]:
    """The four corners of each face, going around."""
    out = []
    for axis, side in product(range(3), (0, 1)):
        u, v = (a for a in range(3) if a != axis)
        out.append([(side << axis) | (a << u) | (b << v) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    return out


def loops(case: int) -> list[list[tuple[int, int]]]:
    """The closed loops of cut edges of a case; an edge is its two corners."""
    solid = [case >> c & 1 for c in range(8)]
    joined: dict[tuple, list] = {}
    for around in faces():
        edges = [tuple(sorted((around[i], around[(i + 1) % 4]))) for i in range(4)]
        cut = [solid[a] != solid[b] for a, b in edges]
        if sum(cut) == 2:
            pairs = [[e for e, c in zip(edges, cut) if c]]
        elif sum(cut) == 4:
            pairs = [[edges[i - 1], edges[i]] for i in range(4) if solid[around[i]]]
        else:
            pairs = []
        for a, b in pairs:
            joined.setdefault(a, []).append(b)
            joined.setdefault(b, []).append(a)
    out, seen = [], set()
    for start in sorted(joined):
        if start in seen:
            continue
        loop, at = [], start
        while at not in seen:
            seen.add(at)
            loop.append(at)
            at = next((n for n in joined[at] if n not in seen), start)
        out.append(loop)
    return out


@lru_cache
def cases() -> np.ndarray:
    """Per case the area of its triangles and the six sums of area times products of the normal."""
    out = np.zeros((256, 7))
    for case in range(256):
        for loop in loops(case):
            points = [(np.array(CORNERS[a], float) + CORNERS[b]) / 2 for a, b in loop]
            for p, q in zip(points[1:], points[2:]):
                cross = np.cross(p - points[0], q - points[0])
                twice = np.linalg.norm(cross)
                if twice > 0:
                    n = cross / twice
                    out[case] += twice / 2 * np.array([1.0, *(n[i] * n[j] for i, j in PAIRS)])
    return out


def case_of(solid: np.ndarray) -> np.ndarray:
    """The case at each cell of [..., z, y, x] blocks: the cell and those after it along x, y and z, around the torus."""
    out = np.zeros(solid.shape, np.int64)
    for bit, (x, y, z) in enumerate(CORNERS):
        out |= np.roll(solid.astype(np.int64), (-z, -y, -x), (-3, -2, -1)) << bit
    return out


def face_counts(packed: DataFrame) -> DataFrame:
    """(sid, cells, faces, solid): the faces between unlike cells around the torus, and the solid cells."""

    def work(ids, g):
        each = lambda on: np.count_nonzero(on.reshape(len(ids), -1), axis=1)
        return ids, np.full(len(ids), g[0].size), sum(each(g != np.roll(g, -1, axis)) for axis in (1, 2, 3)), each(g != 0)

    return kernel(packed, 3, work, "sid long, cells long, faces long, solid long")


def kozeny_carman(packed: DataFrame) -> DataFrame:
    """Per structure: porosity, surface of the mesh and of cell faces by volume, phi^3 / S^2 and
    its logarithm, and the tensor 1.5 (phi^3 / S^2) (1 - F), F the area's mean product of normals.
    Null where there is no surface."""

    def work(ids, g):
        solid = g != 0
        n, cells = len(ids), solid[0].size
        counts = np.stack([np.bincount(c, minlength=256) for c in case_of(solid).reshape(n, -1)])
        sums = counts @ cases()
        square = sum((solid != np.roll(solid, 1, axis)).reshape(n, -1).sum(1) for axis in (1, 2, 3)) / cells
        phi = 1 - solid.reshape(n, -1).mean(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            surface = sums[:, 0] / cells
            k = np.where(surface > 0, phi**3 / surface**2, np.nan)
            tensor = [1.5 * k * ((i == j) - sums[:, 1 + m] / sums[:, 0]) for m, (i, j) in enumerate(PAIRS)]
            log = np.log(k)
        return ids, *(rounded(c, 6) for c in (phi, surface, square, k, log, *tensor))

    names = ", ".join(f"t_{'xyz'[i]}{'xyz'[j]} double" for i, j in PAIRS)
    return kernel(packed, 3, work, f"sid long, phi double, s_mesh double, s_face double, k double, log_k double, {names}")
