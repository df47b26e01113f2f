"""Clusters, windings and shortest paths of the pore phase, in two and three dimensions."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import DIRS, DIRS3, distance, kernel, labels_of, roots, rounded, spread


def _directions(dims: int):
    return DIRS if dims == 2 else DIRS3


def _crossings(on: np.ndarray) -> tuple[np.ndarray, list[list[set]]]:
    """Labels on the tiling three times along each axis, and for each structure and axis x, y(, z) the labels that span it."""
    dims = on.ndim - 1
    lab = labels_of(np.tile(on, (1, *[3] * dims)), False)
    out = []
    for one in lab:
        ends = []
        for axis in range(dims - 1, -1, -1):  # x is the last axis
            a, b = np.take(one, 0, axis), np.take(one, -1, axis)
            ends.append(set(np.intersect1d(a[a > 0], b[b > 0]).tolist()))
        out.append(ends)
    return lab, out


def spans(on: np.ndarray) -> np.ndarray:
    """[structure, axis x, y(, z)]: whether a cluster spans the tiling three times along each axis. Clusters within
    a cell are labelled once; tiles are joined by the labels that meet at their seams."""
    dims, lab = on.ndim - 1, labels_of(on, False)
    names, place = np.unique(lab, return_inverse=True)
    place, k = place.reshape(lab.shape), len(names)
    owner = np.zeros(k, int)
    owner[place] = np.arange(len(on)).reshape(-1, *[1] * dims)
    tiles = np.arange(3**dims).reshape([3] * dims)
    ends, edges = [], []
    for axis in range(dims):
        first, last = (np.take(place, q, axis + 1).ravel() for q in (0, -1))
        ends.append([np.unique(q[names[q] > 0]) for q in (first, last)])
        met = (names[first] > 0) & (names[last] > 0)
        a, b = np.unique(np.stack([last[met], first[met]]), axis=1)
        here, there = (np.take(tiles, q, axis).ravel()[:, None] * k for q in ((0, 1), (1, 2)))
        edges.append(((here + a).ravel(), (there + b).ravel()))
    root = roots(3**dims * k, *(np.concatenate(x) for x in zip(*edges)))
    out = np.zeros((len(on), dims), bool)
    for axis, (first, last) in enumerate(ends):
        a, b = (root[(np.take(tiles, q, axis).ravel()[:, None] * k + own).ravel()] for q, own in ((0, first), (2, last)))
        out[owner[np.intersect1d(a, b) % k], dims - 1 - axis] = True
    return out


def percolates(packed: DataFrame, dims: int = 2) -> DataFrame:
    """Whether some pore cluster spans the tiling along each axis."""

    def work(ids, g):
        return (ids, *spans(g == 0).astype(int).T)

    return kernel(packed, dims, work, "sid long, perc_x int, perc_y int" + ", perc_z int" * (dims == 3))


def cluster_features(packed: DataFrame) -> DataFrame:
    """Clusters of pore on a three by three tiling: how many, how much of the pore spans along x and y, the largest."""

    def work(ids, g):
        n, h, w = g.shape
        lab, ends = _crossings(g == 0)
        rows = []
        for one, (along_x, along_y) in zip(lab, ends):
            middle = one[h : 2 * h, w : 2 * w]
            names, counts = np.unique(middle[middle > 0], return_counts=True)
            if not len(names):
                rows.append((0,) + (np.nan,) * 6)
                continue
            total = counts.sum()
            in_x, in_y = np.isin(names, list(along_x)), np.isin(names, list(along_y))
            fx, fy = counts[in_x].sum() / total, counts[in_y].sum() / total
            rows.append((len(names), fx, fy, counts[in_x & in_y].sum() / total, fx - fy, 1 - counts[in_x | in_y].sum() / total, counts.max() / total))
        columns = list(zip(*rows))
        return (ids, columns[0], *(rounded(np.array(c, float), 6) for c in columns[1:]))

    return kernel(packed, 2, work, "sid long, clusters long, backbone_x double, backbone_y double, backbone_iso double, backbone_aniso double, dead double, largest double")


def component_counts(packed: DataFrame, dims: int = 2) -> DataFrame:
    """Components of pore and of solid inside the cell (no wrap), the largest pore component's
    share of the pore, and pore components less solid ones. No pore at all: a share of null."""

    def work(ids, g):
        rows = []
        pores, solids = labels_of(g == 0, False), labels_of(g != 0, False)
        for p, s in zip(pores, solids):
            _, sizes = np.unique(p[p > 0], return_counts=True)
            walls = len(np.unique(s[s > 0]))
            rows.append((len(sizes), sizes.max() / sizes.sum() if len(sizes) else np.nan, walls, len(sizes) - walls))
        n_pore, largest, n_solid, euler = zip(*rows)
        return ids, n_pore, rounded(np.array(largest, float), 6), n_solid, euler

    return kernel(packed, dims, work, "sid long, n_pore long, largest double, n_solid long, euler long")


# -- windings --------------------------------------------------------------------------


def echelon(rows: list[tuple[int, ...]], dims: int) -> list[tuple[int, ...]]:
    """A basis in echelon form of the lattice that whole multiples of the rows span."""
    rows, out = [list(r) for r in rows if any(r)], []
    for axis in range(dims):
        while sum(r[axis] != 0 for r in rows) > 1:
            lead = min((r for r in rows if r[axis]), key=lambda r: abs(r[axis]))
            for r in rows:
                if r is not lead and r[axis]:
                    q = r[axis] // lead[axis]
                    r[:] = [a - q * b for a, b in zip(r, lead)]
        lead = next((r for r in rows if r[axis]), None)
        if lead:
            rows.remove(lead)
            out.append(tuple(lead) if lead[axis] > 0 else tuple(-v for v in lead))
    return out


def spans_turn(basis: list[tuple[int, ...]], turn: tuple[int, ...]) -> bool:
    """Whether the turn is in the lattice of an echelon basis."""
    left = list(turn)
    for row in basis:
        axis = next(i for i, v in enumerate(row) if v)
        q = left[axis] // row[axis]
        left = [a - q * b for a, b in zip(left, row)]
    return not any(left)


class Cover:
    """Clusters on the torus as they are joined cell by cell, each with the lattice of its windings.

    A weighted union-find: ``height`` holds by how many periods a cell lies off its parent in
    the unrolled cluster. A join within one cluster that doesn't add up is a winding.
    """

    def __init__(self, cells: int, dims: int):
        self.dims, self.parent, self.size = dims, list(range(cells)), [1] * cells
        self.height = np.zeros((cells, dims), np.int64)
        self.basis: dict[int, list[tuple[int, ...]]] = {}

    def find(self, cell: int) -> tuple[int, np.ndarray]:
        """The cluster's root and the cell's periods off it; paths are halved on the way."""
        off = np.zeros(self.dims, np.int64)
        while (up := self.parent[cell]) != cell:
            if self.parent[up] != up:
                self.height[cell] += self.height[up]
                self.parent[cell] = self.parent[up]
            off += self.height[cell]
            cell = self.parent[cell]
        return cell, off

    def join(self, a: int, b: int, wrap: tuple[int, ...]) -> None:
        """b is a's neighbour, across so many periods."""
        (root_a, off_a), (root_b, off_b) = self.find(a), self.find(b)
        gap = off_a + wrap - off_b  # of b's root off a's
        if root_a == root_b:
            if gap.any():
                self.basis[root_a] = echelon([*self.basis.get(root_a, ()), tuple(gap.tolist())], self.dims)
            return
        if self.size[root_a] < self.size[root_b]:
            root_a, root_b, gap = root_b, root_a, -gap
        self.parent[root_b], self.height[root_b] = root_a, gap
        self.size[root_a] += self.size[root_b]
        held = self.basis.pop(root_b, None)
        if held:
            self.basis[root_a] = echelon([*self.basis.get(root_a, ()), *held], self.dims)


def _steps(dims: int, corners: bool):
    """Offsets in array order to the neighbours by face, or by corner as well; one of each opposite pair."""
    every = [d for d in product((-1, 0, 1), repeat=dims) if any(d)]
    return [d for d in every if d > tuple(-v for v in d) and (corners or sum(map(abs, d)) == 1)]


def cover_of(on: np.ndarray, corners: bool = False) -> Cover:
    """The clusters of one structure. Windings are in array order, y before x."""
    shape, dims = np.array(on.shape), on.ndim
    cover = Cover(on.size, dims)
    at = np.argwhere(on)
    number = lambda p: np.ravel_multi_index(tuple(p.T), on.shape)
    for d in _steps(dims, corners):
        to = at + d
        wrap, to = to // shape, to % shape
        both = on[tuple(to.T)]
        for a, b, w in zip(number(at[both]).tolist(), number(to[both]).tolist(), wrap[both].tolist()):
            cover.join(a, b, tuple(w))
    return cover


def winding(packed: DataFrame, dims: int = 2) -> DataFrame:
    """Each pore cluster that winds around the torus: its cells, the rank of its windings, an
    echelon basis of them (x first, rows by ';'), and the directions that it winds along."""

    def work(ids, g):
        rows = []
        for i, one in zip(ids.tolist(), g == 0):
            cover = cover_of(one)
            found = sorted((-cover.size[r], r, b) for r, b in cover.basis.items())
            for place, (size, _, basis) in enumerate(found):
                turned = echelon([row[::-1] for row in basis], dims)
                along = [k for k, d in enumerate(_directions(dims)) if spans_turn(turned, d)]
                rows.append((i, place, -size, len(turned), ";".join(",".join(map(str, r)) for r in turned), ",".join(map(str, along))))
        return tuple(zip(*rows)) if rows else ([],) * 6

    return kernel(packed, dims, work, "sid long, rank int, cells long, windings int, basis string, along string")


def critical_radius(packed: DataFrame, dims: int = 2, cap: float | None = None) -> DataFrame:
    """The largest radius at which the wider pore still winds along each direction, its square
    times the squared porosity, and what share of the pore that cluster has. Zero where none winds.

    Distances are followed up to half the diagonal of the torus, which none exceeds, or up to a
    cap; a structure with a pore as wide as a cap of less than that is an error, since radii
    beyond it would be understated. One without any solid has no radius (null).
    """
    turns = [d[::-1] for d in _directions(dims)]
    sides = [s for d in _steps(dims, False) for s in (d, tuple(-v for v in d))]

    def one(pore: np.ndarray, wide: np.ndarray):
        shape = np.array(pore.shape)
        at = np.argwhere(pore)
        radius = wide[pore]
        order = np.argsort(-radius, kind="stable")
        on, cover, found, k = np.zeros(pore.shape, bool), Cover(pore.size, dims), {}, 0
        while k < len(order) and len(found) < len(turns):
            level = radius[order[k]]
            while k < len(order) and radius[order[k]] == level:
                cell = at[order[k]]
                on[tuple(cell)] = True
                here = int(np.ravel_multi_index(tuple(cell), pore.shape))
                for d in sides:
                    to = cell + d
                    wrap, to = to // shape, tuple(to % shape)
                    if on[to]:
                        cover.join(here, int(np.ravel_multi_index(to, pore.shape)), tuple(wrap.tolist()))
                k += 1
            for q, turn in enumerate(turns):
                if q not in found:
                    sizes = [cover.size[r] for r, b in cover.basis.items() if spans_turn(b, turn)]
                    if sizes:
                        found[q] = float(level), max(sizes) / len(at)
        return found

    def work(ids, g):
        most = float(np.sqrt(dims) * (g.shape[1] // 2 + 1))
        bare = (g == 0).reshape(len(g), -1).all(1)
        wide = np.where(g == 0, distance(g, 0, min(cap or most, most)), 0)
        if cap is not None and cap < most and (wide[~bare] >= cap).any():
            raise ValueError(f"a pore is as wide as the cap of {cap}")
        rows = []
        for i, pore, w, free in zip(ids.tolist(), g == 0, wide, bare):
            if free:
                rows += [(i, q, None, None, None) for q in range(len(turns))]
                continue
            found, phi = one(pore, w), pore.mean()
            for q in range(len(turns)):
                r, s = found.get(q, (0.0, 0.0))
                rows.append((i, q, round(r, 6), round(r * r * phi * phi, 6), round(s, 6)))
        return tuple(zip(*rows))

    return kernel(packed, dims, work, "sid long, dir int, radius double, katz_thompson double, share double")


# -- shortest paths --------------------------------------------------------------------


def _reached(pore: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Lengths of the shortest pore paths from cells with a start value, over all neighbours by face, edge and corner."""
    dims = pore.ndim - 1
    sides = [(d, float(np.sqrt(sum(map(abs, d))))) for d in product((-1, 0, 1), repeat=dims) if any(d)]
    far, size = np.where(pore, start, np.inf), pore.shape[1:]
    while True:
        edge = np.pad(far, ((0, 0), *[(1, 1)] * dims), constant_values=np.inf)
        new = far
        for d, step in sides:
            new = np.minimum(new, edge[(slice(None), *(slice(1 + a, 1 + a + s) for a, s in zip(d, size)))] + step)
        new = np.where(pore, new, np.inf)
        if (new == far).all():
            return far
        far = new


def tortuosity(packed: DataFrame, dims: int = 2) -> DataFrame:
    """Shortest pore path that winds once along each direction over the straight length: mean and least over the anchors.

    Anchors are the corners of the half cell; where all are solid, the first pore cell. The
    structure is tiled as often as a shorter path could need: tiles grow until none that
    leaves them could be shorter, or the windings tell that there is no path.
    """
    directions = [d[::-1] for d in _directions(dims)]

    def work(ids, g):
        n, shape = len(g), np.array(g.shape[1:])
        pores = g == 0
        out = np.full((2, n, len(directions)), np.nan)
        for k in range(n):
            halves = [tuple(int(v) for v in np.array(a) * shape // 2) for a in product((0, 1), repeat=dims)]
            anchors = [a for a in halves[:4] if pores[k][a]] or [tuple(p) for p in np.argwhere(pores[k])[:1]]
            if not anchors:
                continue
            cover = cover_of(pores[k], corners=True)
            ways = np.full((len(anchors), len(directions)), np.nan)
            for s, anchor in enumerate(anchors):
                root, _ = cover.find(int(np.ravel_multi_index(anchor, g.shape[1:])))
                open_ = {q for q, turn in enumerate(directions) if spans_turn(cover.basis.get(root, []), turn)}
                around = 1
                while open_:
                    tile = np.tile(pores[k], [2 * around + 1] * dims)[None]
                    here = np.array(anchor) + around * shape
                    start = np.full(tile.shape, np.inf)
                    start[(0, *here)] = 0
                    far = _reached(tile, start)[0]
                    for q in sorted(open_):
                        goal = here + np.array(directions[q]) * shape
                        # A path that leaves the tile goes to an edge and back at least.
                        leave = min(min(here[a] + goal[a] + 2, 2 * tile.shape[a + 1] - here[a] - goal[a]) for a in range(dims))
                        if far[tuple(goal)] <= leave:
                            ways[s, q] = far[tuple(goal)] / np.linalg.norm(np.array(directions[q]) * shape)
                            open_.discard(q)
                    around += 1
            seen = np.isfinite(ways)
            some = seen.any(0)
            out[0, k, some] = np.where(seen, ways, 0).sum(0)[some] / seen.sum(0)[some]
            out[1, k, some] = np.where(seen, ways, np.inf).min(0)[some]
        d = len(directions)
        return spread(ids, d), np.tile(np.arange(d), n), rounded(out[0].ravel(), 6), rounded(out[1].ravel(), 6)

    return kernel(packed, dims, work, "sid long, dir int, mean double, least double")


def connectivity(packed: DataFrame) -> DataFrame:
    """The 18 connectivity features of a structure: of its clusters, the mean and least tortuosity along x, y and
    both diagonals, the contrasts of x and y and of the diagonals, and the mean of those that exist."""
    names = {"x": 0, "y": 2, "d1": 1, "d2": 3}
    at = lambda c, k: F.max(F.when(F.col("dir") == k, F.col(c)))
    ways = tortuosity(packed).groupBy("sid").agg(*[at("mean", k).alias(f"tort_{d}") for d, k in names.items()], *[at("least", k).alias(f"tortmin_{d}") for d, k in names.items()], F.round(F.avg("mean"), 6).alias("tort_mean"))
    gap = lambda a, b: (F.round(F.col(f"tort_{a}") - F.col(f"tort_{b}"), 6) + F.lit(0.0))
    ways = ways.withColumns({"tort_aniso": gap("x", "y"), "tort_off": gap("d1", "d2")})
    own = cluster_features(packed).withColumnsRenamed({"clusters": "beta0_pore", "dead": "dead_frac", "largest": "largest_frac"})
    order = ["beta0_pore", "backbone_x", "backbone_y", "backbone_iso", "backbone_aniso", "dead_frac", "largest_frac"]
    order += [f"tort_{d}" for d in names] + [f"tortmin_{d}" for d in names] + ["tort_aniso", "tort_off", "tort_mean"]
    return own.join(ways, "sid").select("sid", *[F.col(c).alias(f"conn_{c}") for c in order])


def slab_tortuosity(packed: DataFrame) -> DataFrame:
    """Shortest pore path from one face to the opposite one over the straight length, along x and
    y, in a slab that is tiled three times across; null where nothing crosses. tort_aniso is their difference."""

    def work(ids, g):
        ways = []
        for axis in (2, 1):
            pore = np.tile(g == 0, [1, 3, 1] if axis == 2 else [1, 1, 3])
            start = np.full(pore.shape, np.inf)
            start[(slice(None),) * axis + (0,)] = 0
            end = np.take(_reached(pore, start), -1, axis).min(1)
            ways.append(np.where(np.isfinite(end), end, np.nan) / (g.shape[axis] - 1))
        return ids, rounded(ways[0], 6), rounded(ways[1], 6), rounded(ways[0] - ways[1], 6)

    return kernel(packed, 2, work, "sid long, tort_x double, tort_y double, tort_aniso double")
