"""Centroid clustering by dual-tree Lloyd rounds (operator 11).

Vectors become integers, floor(scale * x), and are held in blocks; each block has a cover
tree over its distinct vectors, built once and written to the shared folder. A round sets
up a cover tree over the centroids and walks both trees together, level by level: a pair of
nodes is dropped when the nearest that any centroid of the one can be to any vector of the
other is further than a centroid that is known to be near. A node of vectors with one
centroid left goes to it whole; where leaves of both trees meet, the distances are computed
exactly in integers. Each task adds up its blocks and sends one row a cluster and component.

Blocks are runs of a task's rows, so nothing is shuffled but those sums. The driver holds
the centroids (k times the components), whatever the number of vectors. Results are exact
and therefore the same for every layout, size of block and order of rows.

Edge cases: vectors that are null, of another size, or that hold null or non-finite
components aren't kept; rows that repeat an id are vectors of their own, and where they are
tied as starting centroids the smaller vector comes first; a row without an id is clustered
like any other and starts a centroid only after all that have one; fewer vectors than
centroids give as many centroids as vectors; equal centroids count as their smallest
number, the others stay empty; a component beyond +-LIMIT after scaling is an error, since
distances would not fit a long; extra columns are ignored; no vectors give an empty result.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Rows of a block, distinct vectors of a leaf, the ratio of a level's scale to the next.
BLOCK, LEAF, BASE = 4096, 16, 1.3
#: The largest component: squared distances of up to 64 of them fit a long.
LIMIT = 1 << 27
#: Bytes of centroids that a task may hold.
CENTROIDS = 64 << 20
#: Bounds that floating point can't tell apart count as equal.
SLACK = 1e-9


def spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges in a row, and the range that each is of."""
    size = stop - start
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[of], of


class CoverTree:
    """Cover tree over distinct integer points.

    Points are taken furthest first. Those taken before the distance fell to a level's
    scale are the level's centres: they lie further apart than the scale, and all points
    within it of one of them. A centre hangs below the nearest one of the level above.
    All leaves are on the last level. A node's points are first[node] to last[node].
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        x = points.astype(np.float64)
        norm = np.square(x).sum(1)
        near, owner = np.full(n, np.inf), np.zeros(n, np.int64)
        taken, reach = [], []
        i, most = 0, max(1, n // leaf)
        while True:
            d = np.maximum(norm + norm[i] - 2 * (x @ x[i]), 0)
            closer = d < near
            near[closer], owner[closer] = d[closer], len(taken)
            near[i], owner[i] = -1, len(taken)  # never taken again, even where rounding hides a distance
            taken.append(i)
            i = int(near.argmax())
            reach.append(max(near[i], 0) ** 0.5)  # how far the next one is from all before it
            if near[i] <= 0 or len(taken) >= most:
                break
        taken, reach = np.array(taken), np.array(reach)
        # Levels: the first m of the order, m falling at each scale.
        ends, scale = [1], reach[0]
        while ends[-1] < len(taken):
            scale /= BASE
            ends.append(max(ends[-1], 1 + int((reach[:-1] > scale).sum())))
        ends = [m for j, m in enumerate(ends) if j == 0 or m > ends[j - 1]]
        # Within a level, nodes are in the order of their parents.
        levels, parents = [np.zeros(1, np.int64)], []
        for m in ends[1:]:
            above, own = levels[-1], np.arange(m)
            c, p = x[taken[own]], x[taken[above]]
            d = np.square(c).sum(1)[:, None] + np.square(p).sum(1) - 2 * c @ p.T
            d[above, np.arange(len(above))] = -np.inf
            parent = d.argmin(1)
            order = np.argsort(parent, kind="stable")
            levels.append(own[order])
            parents.append(parent[order])
        place = np.empty(len(taken), np.int64)
        place[levels[-1]] = np.arange(len(taken))
        order = np.argsort(place[owner], kind="stable")
        self.order = order
        self.points = points[order]
        where = np.empty(n, np.int64)
        where[order] = np.arange(n)
        counts = np.bincount(place[owner], minlength=len(taken))
        first, last = [np.cumsum(counts) - counts], [np.cumsum(counts)]
        kid0, kid1 = [np.zeros(len(taken), np.int64)], [np.zeros(len(taken), np.int64)]
        for parent, above in zip(parents[::-1], levels[-2::-1]):
            kids = np.bincount(parent, minlength=len(above))
            kid1.insert(0, np.cumsum(kids))
            kid0.insert(0, np.cumsum(kids) - kids)
            first.insert(0, first[0][kid0[0]])
            last.insert(0, last[0][kid1[0] - 1])
        offset = np.cumsum([0, *map(len, levels)])
        for j in range(len(levels) - 1):
            kid0[j] = kid0[j] + offset[j + 1]
            kid1[j] = kid1[j] + offset[j + 1]
        self.centre = np.concatenate([where[taken[level]] for level in levels])
        self.first, self.last, self.kid0, self.kid1 = map(np.concatenate, (first, last, kid0, kid1))
        self.depth = np.array(len(levels))
        xs, radius = x[order], []
        for j in range(len(levels)):
            a, b = first[j], last[j]
            away = np.sqrt(np.square(xs - xs[np.repeat(self.centre[offset[j] : offset[j + 1]], b - a)]).sum(1))
            radius.append(np.maximum.reduceat(away, a))
        self.radius = np.concatenate(radius)

    def below(self, nodes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes on a level and their parents' places; leaves stand for themselves."""
        if level >= self.depth - 1:
            return nodes, np.arange(len(nodes))
        return spread(self.kid0[nodes], self.kid1[nodes])


FIELDS = ("points", "centre", "first", "last", "kid0", "kid1", "radius", "depth")


def packed(tree: CoverTree, weight: np.ndarray) -> bytes:
    out = io.BytesIO()
    held = {f: getattr(tree, f) for f in FIELDS}
    np.savez(out, weight=weight.astype(np.int32), **{f: v.astype(np.int32) if v.dtype == np.int64 else v for f, v in held.items()})
    return out.getvalue()


def unpacked(data: bytes) -> tuple[CoverTree, np.ndarray]:
    tree = CoverTree.__new__(CoverTree)
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        for f in FIELDS:
            v = held[f]
            setattr(tree, f, v.astype(np.int64) if v.dtype == np.int32 else v)
        return tree, held["weight"].astype(np.int64)


class Centroids:
    """Numbered integer centroids with a cover tree; equal ones count as the smallest number."""

    def __init__(self, table: np.ndarray):
        self.table = table
        distinct, number = np.unique(table, axis=0, return_index=True)
        self.tree = CoverTree(distinct, 1)
        #: The centroid that a leaf of the tree holds.
        self.number = number[self.tree.order]


def settle(tree: CoverTree, cents: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes that go whole to a centroid, and leaves with each centroid that is still possible."""
    other = cents.tree
    x, c = tree.points.astype(np.float64), other.points.astype(np.float64)
    q, r, level = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    whole = [(q[:0], q[:0])]
    last = int(max(tree.depth, other.depth)) - 1
    while True:
        d = np.sqrt(np.square(x[tree.centre[q]] - c[other.centre[r]]).sum(1))
        low, high = d - tree.radius[q] - other.radius[r], d + tree.radius[q]
        best = np.full(len(tree.centre), np.inf)
        np.minimum.at(best, q, high)
        keep = low <= best[q] * (1 + SLACK) + SLACK
        q, r = q[keep], r[keep]
        held = other.last[r] - other.first[r]
        alone = np.bincount(q, held, len(tree.centre))[q] == 1
        whole.append((q[alone], cents.number[other.first[r[alone]]]))
        q, r = q[~alone], r[~alone]
        if level == last or not len(q):
            break
        q, of = tree.below(q, level)
        r, of2 = other.below(r[of], level)
        q, level = q[of2], level + 1
    at, of = spread(other.first[r], other.last[r])
    return *(np.concatenate(part) for part in zip(*whole)), q[of], cents.number[at]


def assigned(tree: CoverTree, cents: Centroids, distances: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Per point its nearest centroid (ties: the smaller number) and squared distance."""
    nodes, whole, leaves, possible = settle(tree, cents)
    which, best = np.full(len(tree.points), -1), np.full(len(tree.points), np.iinfo(np.int64).max)
    rows, of = spread(tree.first[nodes], tree.last[nodes])
    which[rows] = whole[of]
    if distances and len(rows):
        best[rows] = np.square(tree.points[rows] - cents.table[which[rows]]).sum(1)
    for number in np.unique(possible):
        mine = leaves[possible == number]
        rows, _ = spread(tree.first[mine], tree.last[mine])
        gap = tree.points[rows] - cents.table[number]
        d = np.einsum("ij,ij->i", gap, gap)
        nearer = d < best[rows]
        which[rows[nearer]], best[rows[nearer]] = number, d[nearer]
    return which, best


def forest(vectors: DataFrame, *, id_col: str, vec_col: str, size: int, scale: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The kept vectors (id, v), and their blocks: (ids, tree), the ids in the order of the tree's points."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == size) & fine)

    def grow(ids: pa.Array, flat: np.ndarray) -> tuple[pa.Array, bytes]:
        points = integers(flat.reshape(-1, size), scale)
        points, row, weight = np.unique(points, axis=0, return_inverse=True, return_counts=True)
        tree = CoverTree(points)
        where = np.empty(len(points), np.int64)
        where[tree.order] = np.arange(len(points))
        return ids.take(pa.array(np.argsort(where[row.ravel()], kind="stable"))), packed(tree, weight[tree.order])

    def work(batches):
        ids, flat, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if held + part.num_rows > block:
                    yield _rows([grow(pa.concat_arrays(ids), np.concatenate(flat))])
                    ids, flat, held = [], [], 0
                ids.append(part.column(0))
                flat.append(part.column(1).flatten().to_numpy(zero_copy_only=False))
                held += part.num_rows
        if held:
            yield _rows([grow(pa.concat_arrays(ids), np.concatenate(flat))])

    return kept, kept.mapInArrow(work, "ids array<bigint>, tree binary")


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    whole = np.floor(scale * x)
    if (np.abs(whole) > LIMIT).any():
        raise ValueError(f"a component is beyond {LIMIT} after scaling, so distances may not fit a long")
    return whole.astype(np.int64)


def _rows(blocks) -> pa.RecordBatch:
    ids = pa.array([b[0].to_pylist() for b in blocks], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([ids, pa.array([b[1] for b in blocks], pa.binary())], ["ids", "tree"])


def sums(trees: DataFrame, table: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per cluster that isn't empty: the number of its vectors and their sums by component."""
    k, size = table.shape

    def work(batches):
        cents, total, count = Centroids(table), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for data in batch.column(batch.schema.get_field_index("tree")):
                tree, weight = unpacked(data.as_py())
                which, _ = assigned(tree, cents, False)
                for c in np.unique(which):
                    mine = which == c
                    total[c] += (tree.points[mine] * weight[mine, None]).sum(0)
                    count[c] += weight[mine].sum()
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(count[full], pa.int64()), pa.array(total[full].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = trees.select("tree").mapInArrow(work, "cluster int, n bigint, total array<bigint>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    added = parts.select("cluster", "n", F.posexplode("total").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), exact("x").alias("x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in added.collect():  # k times the components, whatever the input
        out.setdefault(r["cluster"], (r["n"], [0] * size))[1][r["pos"]] = int(r["x"])
    return out


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1:") -> DataFrame:
    """Per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid (its components).

    Centroids start as the k kept vectors with the smallest sha256 of seed and id.
    """
    if k * size * 8 > CENTROIDS:
        raise ValueError(f"centroids of more than {CENTROIDS} bytes")
    spark = vectors.sparkSession
    kept, trees = forest(vectors, id_col=id_col, vec_col=vec_col, size=size, scale=scale)
    trees = written(trees, "trees")
    first = kept.orderBy(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(k).select("v").collect()
    out = "id long, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid array<bigint>")
    table = integers(np.array([r["v"] for r in first]), scale)
    for _ in range(rounds):
        for c, (n, total) in sums(trees, table).items():
            table[c] = [x // n for x in total]

    def work(batches):
        cents = Centroids(table)
        for batch in batches:
            for row, data in zip(batch.column(0), batch.column(1)):
                tree, weight = unpacked(data.as_py())
                which, best = (np.repeat(x, weight) for x in assigned(tree, cents))
                yield pa.RecordBatch.from_arrays([row.values, pa.array(which, pa.int32()), pa.array(best, pa.int64())], ["id", "cluster", "distance"])

    rows = written(trees.select("ids", "tree").mapInArrow(work, out), "clusters")
    whole = F.sum(F.col("distance").cast("decimal(20,0)"))
    each = rows.groupBy("cluster").agg(whole.alias("cluster_inertia")).collect()  # k rows at most
    facts = [(r["cluster"], int(r["cluster_inertia"]), sum(int(e["cluster_inertia"]) for e in each), table[r["cluster"]].tolist()) for r in each]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<bigint>")
    return rows.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op11(spark, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _oracle(rounds: int = 3, k: int = 16) -> str:
    """The rounds written out; each has the distances of all vectors to all centroids."""
    nearest = """a{i} AS (
  SELECT row_, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT x.row_, m.c, CAST(sum((x.x - m.x) * (x.x - m.x)) AS BIGINT) AS d FROM x JOIN m{i} m ON m.pos = x.pos GROUP BY x.row_, m.c)
  GROUP BY row_
)"""
    moved = """m{j} AS (
  SELECT m.c, m.pos, coalesce(s.x, m.x) AS x FROM m{i} m LEFT JOIN (
    SELECT a.c, x.pos, CAST((sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM a{i} a JOIN x ON x.row_ = a.row_ GROUP BY a.c, x.pos) s ON s.c = m.c AND s.pos = m.pos
)"""
    steps = ",\n".join(s for i in range(rounds) for s in (nearest.format(i=i), moved.format(i=i, j=i + 1)))
    return f"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, embedding) AS row_
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), x AS (
  SELECT row_, unnest(range(64)) AS pos, unnest(list_transform(v, lambda e: CAST(floor(64 * e) AS BIGINT))) AS x FROM v
), m0 AS (
  SELECT row_ - 1 AS c, pos, x FROM x WHERE row_ <= {k}
),
{steps},
{nearest.format(i=rounds)}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a{rounds} a JOIN v ON v.row_ = a.row_
JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS h FROM m{rounds} GROUP BY c) h ON h.c = a.c
"""


ORACLE = _oracle()
