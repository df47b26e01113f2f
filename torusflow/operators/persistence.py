"""Persistence of the throat field on the torus: finite bars of sublevel sets of closed cells."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import kernel, rounded
from .lattice import throat_field as _field


def complex_of(f: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By dimension the cells' values and boundaries (numbers of cells a dimension lower).

    A cell of the periodic complex is a place and the axes along which it extends; it
    appears with the first top cell that it bounds.
    """
    dims, shape = f.ndim, f.shape
    kinds = sorted(product((0, 1), repeat=dims), key=lambda k: (sum(k), k))
    value, number, count = {}, {}, [0] * (dims + 1)
    for kind in kinds:
        v = f
        for axis in range(dims):
            if not kind[axis]:  # thin: between the cell here and the one before
                v = np.minimum(v, np.roll(v, 1, axis))
        value[kind] = v
        number[kind] = count[sum(kind)] + np.arange(f.size).reshape(shape)
        count[sum(kind)] += f.size
    out = []
    for d in range(dims + 1):
        own = [k for k in kinds if sum(k) == d]
        faces = []
        for kind in own:
            columns = []
            for axis in range(dims):
                if kind[axis]:
                    thin = number[tuple(0 if a == axis else k for a, k in enumerate(kind))]
                    columns += [thin.ravel(), np.roll(thin, -1, axis).ravel()]
            faces.append(np.stack(columns, 1) if columns else np.zeros((f.size, 0), int))
        out.append((np.concatenate([value[k].ravel() for k in own]), np.concatenate(faces)))
    return out


def merges(rank: np.ndarray, shifts: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How the cells of periodic blocks [structure, ...] come together, as (structure, first, last) of each part that ends.

    rank: the order in which cells appear, all different. Parts of cells that are neighbours by
    ``shifts`` (each way) merge as soon as both are there; the one with the later first cell ends.
    Cells first go to the basin down which they lead: within it nothing ever ends later than it begins.
    """
    axes, size = tuple(range(1, rank.ndim)), rank.size
    low = rank
    for s in shifts:
        for way in (1, -1):
            low = np.minimum(low, np.roll(rank, [way * a for a in s], axes))
    cell = np.empty(size, np.int64)
    cell[rank.ravel()] = np.arange(size)
    basin = cell[low.ravel()]
    while (basin[basin] != basin).any():
        basin = basin[basin]
    basin = rank.ravel()[basin].reshape(rank.shape)  # by the rank of its first cell
    pairs, times = [], []
    for s in shifts:
        other = np.roll(basin, s, axes)
        apart = basin != other
        a, b = basin[apart], other[apart]
        pairs.append(np.minimum(a, b) * size + np.maximum(a, b))
        times.append(np.maximum(rank, np.roll(rank, s, axes))[apart])
    pair, time = np.concatenate(pairs), np.concatenate(times)
    order = np.lexsort((time, pair))
    pair, time = pair[order], time[order]
    first = np.ones(len(pair), bool)
    first[1:] = pair[1:] != pair[:-1]
    pair, time = pair[first], time[first]
    order = np.argsort(time, kind="stable")
    above: dict[int, int] = {}
    ended = []
    for a, b, t in zip((pair // size)[order].tolist(), (pair % size)[order].tolist(), time[order].tolist()):
        while a in above:
            up = above[a]
            if up in above:
                above[a] = above[up]
            a = up
        while b in above:
            up = above[b]
            if up in above:
                above[b] = above[up]
            b = up
        if a != b:
            a, b = min(a, b), max(a, b)
            above[b] = a
            ended.append((b, t))
    found = np.array(ended, np.int64).reshape(-1, 2)
    return cell[found[:, 0]] // (size // len(rank)), found[:, 0], found[:, 1]


def neighbours(dims: int, corners: bool) -> list[tuple[int, ...]]:
    """Half of the shifts to neighbours by face, or by face, edge and corner."""
    every = [d for d in product((-1, 0, 1), repeat=dims) if any(d) and (corners or sum(map(abs, d)) == 1)]
    return [d for d in every if d > tuple(-a for a in d)]


def outer_bars(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(structure, dimension, birth, death) of the bars of dimension 0 and of the one below the top, for blocks of structures.

    Closed cells touch by corners. By duality a class below the top is a part of the open cells
    yet to come, met by faces and looked at from the end: it begins when it parts from a part that
    lasts longer, and ends with its last cell.
    """
    dims, flat, out = f.ndim - 1, f.ravel(), []
    for dim, corners, up in ((0, True, True), (dims - 1, False, False)):
        order = np.argsort(flat if up else -flat, kind="stable")
        rank = np.empty(f.size, np.int64)
        rank[order] = np.arange(f.size)
        at, first, last = merges(rank.reshape(f.shape), neighbours(dims, corners))
        birth, death = flat[order[first if up else last]], flat[order[last if up else first]]
        lasting = death > birth
        out.append((at[lasting], np.full(lasting.sum(), dim), birth[lasting], death[lasting]))
    return tuple(map(np.concatenate, zip(*out)))


def spanning(a: np.ndarray, b: np.ndarray, rank: np.ndarray, nodes: int) -> np.ndarray:
    """Whether each link (a, b) is in the spanning forest of least ranks: every part takes its least link, all at once."""
    part, held = np.arange(nodes), np.zeros(len(a), bool)
    link = np.empty(len(a), np.int64)
    link[rank] = np.arange(len(a))
    while True:
        x, y = part[a], part[b]
        open_ = x != y
        if not open_.any():
            return held
        least = np.full(nodes, len(a))
        np.minimum.at(least, x[open_], rank[open_])
        np.minimum.at(least, y[open_], rank[open_])
        own = np.flatnonzero(least < len(a))
        took = link[least[own]]
        held[took] = True
        to = np.arange(nodes)
        to[own] = np.where(x[took] == own, y[took], x[took])
        both = (to[to] == np.arange(nodes)) & (np.arange(nodes) < to)
        to[both] = np.flatnonzero(both)
        while (to[to] != to).any():
            to = to[to]
        part = to[part]


def inner_bars(f: np.ndarray) -> list[tuple[int, float, float]]:
    """(1, birth, death) of a structure in space, by reduction of the boundaries of faces.

    Faces that close a top cell (the tree that joins top cells last to first) need no reduction, and
    edges that join parts (the tree of the corners) never begin a class and are left out of the columns.
    """
    (corners, _), (edge_value, edge_ends), (face_value, face_edges), (top_value, top_faces) = complex_of(f)

    def ranked(value):
        place = np.empty(len(value), np.int64)
        place[np.argsort(value, kind="stable")] = np.arange(len(value))
        return place

    edge_rank, face_rank = ranked(edge_value), ranked(face_value)
    joins = spanning(edge_ends[:, 0], edge_ends[:, 1], edge_rank, len(corners))
    sides = np.argsort(top_faces.ravel(), kind="stable").reshape(-1, 2) // top_faces.shape[1]  # the two top cells of each face
    closes = spanning(sides[:, 0], sides[:, 1], len(face_value) - 1 - face_rank, len(top_value))
    order = np.argsort(face_rank)
    order = order[~closes[order]]
    ranks, kept = edge_rank[face_edges[order]].tolist(), ~joins[face_edges[order]]
    value_at = np.sort(edge_value, kind="stable")
    low_of: dict[int, set[int]] = {}
    out = []
    for cell, four, keep in zip(order.tolist(), ranks, kept.tolist()):
        column: set[int] = set()
        for r, k in zip(four, keep):
            if k:
                column ^= {r}
        while column and (low := max(column)) in low_of:
            column ^= low_of[low]
        if column:
            low_of[low] = column
            if face_value[cell] > value_at[low]:
                out.append((1, float(value_at[low]), float(face_value[cell])))
    return out


def bars(f: np.ndarray) -> list[tuple[int, float, float]]:
    """(dimension, birth, death) of all finite bars of positive length of one structure."""
    _, *found = outer_bars(f[None])
    return list(zip(*(c.tolist() for c in found))) + (inner_bars(f) if f.ndim == 3 else [])


def persistence(packed: DataFrame, dims: int = 2, cap: float = 10.0) -> DataFrame:
    """The finite bars of the throat field: in dimensions 0 and 1, and 2 for 3D structures."""

    def work(ids, g):
        f = rounded(_field(g, cap), 6)
        at, *found = outer_bars(f)
        if dims == 2:
            return ids[at], *found
        inner = [(i, *bar) for i, one in zip(ids.tolist(), f) for bar in inner_bars(one)]
        return tuple(np.concatenate(c) for c in zip((ids[at], *found), zip(*inner))) if inner else (ids[at], *found)

    return kernel(packed, dims, work, "sid long, dim int, birth double, death double")


WEIGHTS = {"constant": lambda p: F.lit(1.0), "linear": lambda p: p, "quadratic": lambda p: p * p}


def image(found: DataFrame, *, weight: str = "linear", bandwidth: float = 0.125, side: int = 8, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(sid, dim, i, j, value): a Gaussian of the bandwidth at each bar's (birth, length), by the
    weight of its length, summed at side by side pixels over low to high.

    Bars are counted first where they are equal, so what meets the pixels is distinct bars.
    """
    step = (high - low) / (side - 1)
    lone = found.groupBy("sid", "dim", "birth", "death").agg(F.count("*").alias("times")).withColumn("length", F.col("death") - F.col("birth"))
    at = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    px = lone.withColumn("i", at).withColumn("j", at)
    apart = (F.col("birth") - (low + F.col("i") * step)) ** 2 + (F.col("length") - (low + F.col("j") * step)) ** 2
    value = F.col("times") * WEIGHTS[weight](F.col("length")) * F.exp(-apart / (2 * bandwidth**2)) / (2 * np.pi * bandwidth**2)
    return px.groupBy("sid", "dim", "i", "j").agg(F.round(F.sum(value), 5).alias("value"))
