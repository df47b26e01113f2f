"""Approximate nearest neighbours by collision counting (operator 7).

Every vector is projected on some random lines, orthonormal in sets of as many as there
are dimensions; each line keeps the projections in a sorted array. A query opens a window
around its own projection on every line and widens all windows together (virtual
rehashing: each round the width grows, by COARSE at first, and by less as the share that
ends a query comes near). A vector that has been inside the
windows of a share of the lines has its true distance computed. A query ends when its k
nearest are nearer than what the windows would have brought in by now, or when a share of
the block was verified, or all of it.

The index is built in blocks: vectors are dealt to blocks of a bounded size by a hash,
every block holds its own sorted arrays, and every query visits every block once. Each
block gives its k best and these are merged, so memory in a task is one block, and no
vector is left out of the index. A task serves up to QUERIES queries, so of n vectors and
n / 100 queries n * n / 1,600,000 copies of vectors and as many of queries move.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows without an id; vectors of each dimension are searched among themselves
(there is no distance between dimensions); a query's own row (its id and vector, however
often repeated) is no neighbour, but other rows of its id are; an id with several rows is
one neighbour, at the distance of its nearest row, and one query, whose distances are
those of its nearest row; ties go to the smaller id; fewer than k candidates give fewer
rows; extra columns are ignored; no queries or no vectors give an empty result.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, and queries that a task serves.
BLOCK, QUERIES = 16_384, 16_384
#: The most and the least that windows grow by from round to round, and distinct dimensions that a table may have.
COARSE, LEAST, DIMENSIONS = 1.05, 1.004, 10_000


def lines(size: int, count: int, seed: int = 5) -> np.ndarray:
    """Unit lines as columns, orthonormal in sets of size."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-count // size))], 1)[:, :count]


class Block:
    """Sorted projections of some vectors on every line."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, count: int):
        # Copies of a row are dealt to the same block; one of them is enough.
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        keep, runs = np.ones(len(ids), bool), np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1, append=ids[-1:] + 1))
        long = np.diff(runs) > 1
        for a, b in zip(runs[:-1][long], runs[1:][long]):
            keep[a:b] = False
            keep[a + np.unique(vectors[a:b], axis=0, return_index=True)[1]] = True
        self.ids, self.vectors = ids, vectors = ids[keep], vectors[keep]
        #: Whether an id has several rows still.
        self.several = bool((ids[1:] == ids[:-1]).any())
        self.lines = lines(vectors.shape[1], count)
        projected = vectors @ self.lines
        n = len(ids)
        order = np.argsort(projected, axis=0, kind="stable")
        rows = np.take_along_axis(projected, order, 0).T
        #: Lines lie one after the other, each lifted above the last, so that one binary search serves all.
        self.lift = np.arange(count) * (2.0 * (np.abs(projected).max(initial=1.0) + 1.0) * 4)
        self.low = np.arange(count) * n
        self.sorted = (rows + self.lift[:, None]).ravel()
        self.order = order.T.ravel()
        #: Half the width of the first windows: about that of half the vectors on a line.
        self.width = max(1.2 * float(np.median(np.abs(rows - np.median(rows, axis=1)[:, None]))), 1e-9) if n else 1.0

    def search(self, query_id: int, query: np.ndarray, k: int, share: float, most: float, nearer: float = 0.8) -> tuple[list[tuple[float, int]], int]:
        """The k nearest found as (distance, id), and how many vectors were verified.

        share: of the lines on which a vector must collide; most: of the block, beyond which
        a query ends at the close of the round.
        """
        n, count = len(self.ids), len(self.lift)
        limit = self.lift[1] / 4 if count > 1 else np.inf
        own = np.clip((self.lines * query[:, None]).sum(0), -limit, limit) + self.lift
        threshold, need = int(np.ceil(share * count)), max(4 * k, int(np.ceil(most * n)))
        # Differences on a unit line are normal with a deviation of distance / sqrt(dimensions), so
        # at half width w a vector at distance w * reach reaches the threshold half the time.
        reach = np.sqrt(self.vectors.shape[1]) / NormalDist().inv_cdf((1 + share) / 2)
        hits, done, best = np.zeros(n, np.int64), np.zeros(n, bool), []
        last = (0.0, 0)
        left = np.clip(np.searchsorted(self.sorted, own), self.low, self.low + n)
        right, radius, verified = left.copy(), self.width, 0
        while True:
            a = np.minimum(np.clip(np.searchsorted(self.sorted, own - radius, "left"), self.low, self.low + n), left)
            b = np.maximum(np.clip(np.searchsorted(self.sorted, own + radius, "right"), self.low, self.low + n), right)
            edges = zip(a.tolist(), left.tolist(), right.tolist(), b.tolist())
            hits += np.bincount(np.concatenate([x for w, x0, x1, z in edges for x in (self.order[w:x0], self.order[x1:z])]), minlength=n)
            left, right = a, b
            found = np.flatnonzero((hits >= threshold) & ~done)
            if len(found):
                done[found] = True
                verified += len(found)
                distance, ids = np.sqrt(np.square(self.vectors[found] - query).sum(1)), self.ids[found]
                other = (ids != query_id) | (self.vectors[found] != query).any(1)
                distance, ids = distance[other], ids[other]
                if self.several:
                    order = np.lexsort((distance, ids))
                    order = order[np.diff(ids[order], prepend=ids[order][:1] - 1) != 0]
                    ids, distance = ids[order], distance[order]
                if len(ids) > 4 * k:  # only the nearest can enter; ties at the edge stay
                    keep = distance <= np.partition(distance, k)[k]
                    ids, distance = ids[keep], distance[keep]
                best = sorted([*best, *zip(distance.tolist(), ids.tolist())])
                if self.several:
                    best = sorted((d, i) for i, d in dict((i, d) for d, i in reversed(best)).items())
                best = best[:k]
            # At nearer (0.8) of its typical width a vector at the k-th distance has long collided.
            if verified == n or len(best) == k and (verified >= need or best[-1][0] <= nearer * radius * reach):
                return best, verified
            # Counts rise as a power of the width: aim at the share from the last two, or take a full step.
            step = COARSE
            if verified > 1:
                power = np.log(verified / last[1]) / np.log(radius / last[0]) if 1 < last[1] < verified else 20.0
                step = min(max((1.05 * need / verified) ** (1 / max(power, 1.0)), LEAST), COARSE)
            last = radius, verified
            radius *= step


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, count: int = 128, share: float = 0.86, most: float = 0.04, nearer: float = 0.8, block: int = BLOCK) -> DataFrame:
    """Per query its k nearest found: query_id, rank, vec_id, score (the distance in double
    precision), verified (the vectors whose distance was computed for the query)."""
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vec_col).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("d")).where(F.col("id").isNotNull() & v.isNotNull() & fine)

    base, asked = usable(vectors), usable(queries)
    counted = base.groupBy("d").agg(F.count("*").alias("n")).join(asked.groupBy("d").agg(F.count("*").alias("q")), "d").orderBy("d").limit(DIMENSIONS + 1).collect()
    if len(counted) > DIMENSIONS:
        raise ValueError(f"more than {DIMENSIONS} dimensions")
    if not counted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    # Parts, of a block and a group of queries each, are numbered through all dimensions.
    table, parts = [], 0
    for r in counted:
        blocks, groups = -(-r["n"] // block), -(-r["q"] // QUERIES)
        table.append((r["d"], blocks, groups, parts))
        parts += blocks * groups
    table = F.broadcast(spark.createDataFrame(table, "d int, blocks int, groups int, first int"))
    of = lambda what, seed: F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.col(what)).cast("int")
    every = lambda what: F.explode(F.sequence(F.lit(0), F.col(what) - 1))
    rows = base.join(table, "d").select("*", of("blocks", "b").alias("b"), every("groups").alias("g"), F.lit(False).alias("asks"))
    visits = asked.join(table, "d").select("*", of("groups", "g").alias("g"), every("blocks").alias("b"), F.lit(True).alias("asks"))
    both = rows.unionByName(visits).select((F.col("first") + F.col("b") * F.col("groups") + F.col("g")).alias("part"), "id", "v", "asks")
    both = both.repartition(4 * parts, "part").sortWithinPartitions("part", "asks", "id")

    def work(batches):
        part_now, held, built, seen = None, [], None, set()
        for batch in batches:
            part, ids, asks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("part", "id", "asks"))
            v = batch.column(batch.schema.get_field_index("v"))
            flat, at = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))])
            out = []
            for p in np.unique(part):  # in order: parts come one after the other, each of one dimension
                if p != part_now:
                    part_now, held, built, seen = p, [], None, set()
                mine = np.flatnonzero(part == p)
                own = flat[at[mine[0]] : at[mine[-1] + 1]].reshape(len(mine), -1)
                has, wants = ~asks[mine], asks[mine]
                if has.any():
                    held.append((ids[mine[has]], own[has]))
                if not wants.any() or not held:
                    continue
                if built is None:
                    built = Block(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), count)
                    held = held[:1]
                for i in np.flatnonzero(wants):
                    query, vector = int(ids[mine[i]]), own[i]
                    if (query, vector.tobytes()) in seen:  # copies come to the same part
                        continue
                    seen.add((query, vector.tobytes()))
                    best, verified = built.search(query, vector, k, share, most, nearer)
                    out += [(query, found, d, 0) for d, found in best] + [(query, None, None, verified)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["query_id", "vec_id", "score", "verified"])

    found = both.mapInArrow(work, "query_id long, vec_id long, score double, verified long").repartition("query_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.sum("verified").alias("verified"))
    # Each distinct row of a query has k rows of each block at most.
    mine = Window.partitionBy("query_id")
    found = found.withColumn("verified", F.sum("verified").over(mine)).where("vec_id is not null")
    found = found.withColumn("rank", F.row_number().over(mine.orderBy("score", "vec_id")))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")


def op7(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
