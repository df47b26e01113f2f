"""The symmetries of square and cube on structures and their tensors."""

from __future__ import annotations

from itertools import permutations, product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import kernel


def signed_permutations(dims: int) -> list[np.ndarray]:
    """All of them (8 in the plane, 48 in space), the identity first."""
    every = [np.diag(signs) @ np.eye(dims, dtype=int)[list(p)] for p in permutations(range(dims)) for signs in product((1, -1), repeat=dims)]
    return sorted(every, key=lambda m: (not np.array_equal(m, np.eye(dims)), m.tolist()))


def tensors(perm: DataFrame, dims: int = 3, key: str = "sample_id") -> DataFrame:
    """(key, g, k_ab...): P K P^T for every symmetry g; columns k_xx, k_xy, ... as far as dims goes."""
    axes = "xyz"[:dims]

    ms, pairs = signed_permutations(dims), [(i, j) for i in range(dims) for j in range(dims)]
    axis = [[int(np.flatnonzero(row)[0]) for row in m] for m in ms]

    def one(i: int, j: int):
        """The component by tables over g of where it comes from and its sign: code that doesn't grow with the symmetries."""
        of = F.array(*[F.lit(dims * at[i] + at[j]) for at in axis])
        sign = F.array(*[F.lit(float(m[i, at[i]] * m[j, at[j]])) for m, at in zip(ms, axis)])
        return (F.get("__k", F.get(of, F.col("g"))) * F.get(sign, F.col("g")) + F.lit(0.0)).alias(f"k_{axes[i]}{axes[j]}")  # no negative zero

    rows = perm.select(key, F.array(*[F.col(f"k_{axes[i]}{axes[j]}").cast("double") for i, j in pairs]).alias("__k"))
    rows = rows.select(key, "__k", F.explode(F.sequence(F.lit(0), F.lit(len(ms) - 1))).alias("g"))
    return rows.select(key, "g", *[one(i, j) for i, j in pairs])


def grids(packed: DataFrame, dims: int = 3) -> DataFrame:
    """(sid, g, grid): the structure under every symmetry g, so that its tensor is the one of ``tensors``."""

    def turned(block: np.ndarray, m: np.ndarray) -> np.ndarray:
        # Axes of a block are z, y, x; the matrix has x first.
        from_axis = [int(np.flatnonzero(m[dims - 1 - k])[0]) for k in range(dims)]
        out = block.transpose(0, *(dims - a for a in from_axis))
        flips = tuple(k + 1 for k in range(dims) if m[dims - 1 - k].sum() < 0)
        return np.flip(out, flips) if flips else out

    ms = signed_permutations(dims)

    def work(ids, g):
        made = np.stack([turned(g, m).reshape(len(ids), -1) for m in ms], 1)
        return np.repeat(ids, len(ms)), np.tile(np.arange(len(ms)), len(ids)), made.reshape(len(ids) * len(ms), -1)

    return kernel(packed, dims, work, "sid long, g int, grid array<tinyint>")


def incomplete_families(rows: DataFrame, dims: int = 3, key: str = "sid") -> DataFrame:
    """(key, n): structures that lack some of their symmetries, or have one twice."""
    full = len(signed_permutations(dims))
    found = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("g").alias("d"))
    return found.where((F.col("n") != full) | (F.col("d") != full)).select(key, "n")
