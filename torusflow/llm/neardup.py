"""Near-duplicates by ProbMinHash, banding and verification (operator 3).

A document is the multiset of its shingles of five words (lower case; all its words if
it has fewer). In ProbMinHash every distinct shingle sends points at the times of a
Poisson process whose rate is its count; each point falls on one of M registers, and a
register keeps the shingle of its earliest point. A shingle whose next point comes later
than the latest register's time stops. Two documents agree on a register with the
probability Jaccard similarity J_P of their counts, which for plain sets of shingles is
the usual Jaccard similarity. ROWS registers make a band; documents that share a band are
candidates, and the exact J_P decides.

Plan. Rows with the same words are one text from the start; a text is named by the
smallest pair (id, hash of the text) among its rows, so ids that repeat with other texts
and rows without an id stay apart. Each band's group is named by its smallest text, its
leader, and every member is compared with the leader exactly. Members that aren't near
their leader are then compared with all members of the group, block by block. A task
holds a bounded number of texts and of shingles, and what leaves it is a spanning forest
of the links it found. So no candidate pair is left undecided, no group is gathered in one
task, groups around their leader cost as much as they have members, and only the members
far from their leader are compared all with all. Components of the forests are the classes.

Edge cases: documents without a word (null, empty, marks only) are classes of their own;
documents with fewer than five words match only equal ones; repeated rows share a class;
rows that repeat an id with other words are texts of their own; a row without an id takes
part like any other, its class has the smallest id in it, null if there is none; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import written

M, ROWS = 128, 4
BANDS = M // ROWS
SIMILAR = 0.8
#: Texts and shingles of a block; of two blocks a task holds the shared weights in full.
BLOCK, WEIGHT = 256, 1_000_000
#: Shingles in at most FEW texts are paired one by one; others in products of CHUNK at a time.
FEW, CHUNK = 16, 2048
#: Names of texts that may be broadcast (16 bytes each, some 150 MB as a hash table).
BROADCAST = 3_000_000
#: Neighbours beyond which a name is joined by broadcast.
HOT = 256
#: Shares of a key that may be hot, and the id that stands for none.
SALTS, NO_ID = 16, (1 << 63) - 1


def weighted(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a lower-cased text in bytes, in order, and their counts."""
    return np.unique(kernel.shingles(kernel.words(doc)), return_counts=True)


def signature(shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The shingle that each register keeps."""
    best = np.full(M, np.inf)
    kept = np.zeros(M, np.uint64)
    weight = count.astype(np.float64)
    at, step = np.zeros(len(shingle)), 0
    live = np.arange(len(shingle))
    points = M * (np.log(M) + 2)
    while len(live):
        several = int(min(64, max(1, points // len(live) // 2)))
        rounds = np.arange(step, step + several, dtype=np.uint64)
        drawn = kernel.mix(shingle[live][:, None] + (rounds + np.uint64(1)) * kernel.BASE)
        gap = -np.log((drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight[live][:, None]
        gap[:, 0] += at[live]
        times = np.cumsum(gap, axis=1)
        register = (kernel.mix(drawn) % np.uint64(M)).astype(np.int64).ravel()
        flat = times.ravel()
        np.minimum.at(best, register, flat)
        won = np.flatnonzero(flat == best[register])
        kept[register[won]] = shingle[live][won // several]
        at[live] = times[:, -1]
        live = live[times[:, -1] < best.max()]
        step += several
    return kept


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard similarity of two weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # Of shared d: 1 / sum of max(x' / x, y' / y); x' / x wins where x' / y' is the larger.
    above = np.cumsum(x[::-1])[::-1]
    below = np.cumsum(y) - y
    ratio = x / y
    first = np.searchsorted(ratio, ratio, "left")
    return float((1.0 / ((above[first] + only_x) / x + (below[first] + only_y) / y)).sum())


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x, text): the id, NO_ID if null, and a hash of the text as it stands."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("x"), F.col(text_col).alias("text"))


def sketch(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, x, hi and lo (a 128-bit key of its words), size (distinct shingles; null without a word), bands."""
    rows = keyed(docs, id_col, text_col)

    def work(batches):
        seed = [kernel.mix(np.array([s], np.uint64))[0] for s in (11, 12)]
        place = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * kernel.BASE
        for batch in batches:
            keys, size, bands = [], [], []
            for row, doc in enumerate(kernel.lowered(batch.column(2))):
                words = kernel.words(doc)
                alone = not len(words)
                if alone:  # a key of its own, so that such rows don't meet
                    words = np.array([batch.column(c)[row].as_py() for c in (0, 1)], np.int64).view(np.uint64)
                numbered = words + np.arange(len(words), dtype=np.uint64) * kernel.BASE
                keys.append([np.add.reduce(kernel.mix(numbered ^ s)) for s in seed])
                if alone:
                    size.append(None)
                    bands.append(None)
                    continue
                found = np.unique(kernel.shingles(words), return_counts=True)
                kept = signature(*found).reshape(BANDS, ROWS)
                band = place.copy()
                for r in range(ROWS):
                    band = kernel.mix(band + kept[:, r])
                size.append(len(found[0]))
                bands.append(band.view(np.int64))
            two = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x", "hi", "lo", "size", "bands"])

    return rows.mapInArrow(work, "id long, x long, hi long, lo long, size long, bands array<long>")


def shared_weight(docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each two documents the weight in the first of the shingles that both have."""
    n = len(docs)
    total = np.zeros((n, n), np.float32)
    code = np.concatenate([d[0] for d in docs])
    if not len(code):
        return total
    row = np.repeat(np.arange(n), [len(d[0]) for d in docs])
    weight = np.concatenate([d[1] for d in docs]).astype(np.float32)
    order = np.argsort(code, kind="stable")
    code, row, weight = code[order], row[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    times = np.diff(np.append(first, len(code)))
    column = np.repeat(np.arange(len(first)), times)
    np.add.at(total, (row, row), weight)
    rare = (times > 1) & (times <= FEW)
    use = np.flatnonzero(rare[column])
    c, r, w = column[use], row[use], weight[use]
    for step in range(1, FEW):  # pairs of entries so far apart in the same column
        if step >= len(c) or not (same := np.flatnonzero(c[step:] == c[:-step])).size:
            break
        np.add.at(total, (r[same], r[same + step]), w[same])
        np.add.at(total, (r[same + step], r[same]), w[same + step])
    common = np.flatnonzero(times > FEW)
    for at in range(0, len(common), CHUNK):
        part = common[at : at + CHUNK]
        place = np.full(len(first), -1)
        place[part] = np.arange(len(part))
        use = np.flatnonzero(place[column] >= 0)
        have, heavy = np.zeros((n, len(part)), np.float32), np.zeros((n, len(part)), np.float32)
        have[row[use], place[column[use]]] = 1
        heavy[row[use], place[column[use]]] = weight[use]
        product = heavy @ have.T
        np.fill_diagonal(product, 0)
        total += product
    return total


def forest(docs: list[tuple[np.ndarray, np.ndarray]], similar: float) -> np.ndarray:
    """For each document the first one that links of at least this similarity lead to."""
    n = len(docs)
    both = shared_weight(docs)
    size = np.array([d[1].sum() for d in docs], np.float32)
    flat = np.array([bool((d[1] == 1).all()) for d in docs])
    # Between plain sets J_P is the Jaccard similarity, a fraction of whole numbers.
    near = both >= np.float64(similar) * (size[:, None].astype(np.float64) + size[None, :] - both) - 1e-6
    near &= flat[:, None] & flat[None, :]
    label = np.arange(n)

    def settle():
        while True:
            low = np.where(near, label[None, :], n).min(1)
            new = np.minimum(label, low)
            new = new[new]
            if (new == label).all():
                return
            label[:] = new

    settle()
    # Else J_P is at most the shared part of either's weight.
    part = both / np.maximum(size[:, None], 1)
    may = np.triu((part >= similar - 1e-5) & (part.T >= similar - 1e-5) & ~(flat[:, None] & flat[None, :]), 1)
    for i, j in zip(*np.nonzero(may)):
        if label[i] != label[j] and similarity(docs[i], docs[j]) >= similar - 1e-12:
            near[i, j] = near[j, i] = True
            low = min(label[i], label[j])
            label[(label == label[i]) | (label == label[j])] = low
    return label


NODE = "struct<id:bigint,x:bigint>"


def _arrow_nodes(column) -> np.ndarray:
    """Names of texts as rows of two numbers."""
    parts = column.combine_chunks().flatten()
    return np.stack([p.to_numpy(zero_copy_only=False).astype(np.int64) for p in parts], 1).reshape(-1, 2)


def _node_array(rows: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(rows[:, 0].copy(), pa.int64()), pa.array(rows[:, 1].copy(), pa.int64())], ["id", "x"])


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by, F.lit("salt")), F.lit(SALTS)))


def _every_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))


def _sizes(members: DataFrame, out: str) -> DataFrame:
    """(name, out): as many blocks as hold BLOCK texts and WEIGHT shingles each."""
    return members.groupBy("name").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / WEIGHT)).cast("int").alias(out))


def _block(blocks: str, by: str) -> F.Column:
    return F.pmod(F.xxhash64(by, F.lit("block")), F.col(blocks)).cast("int")


def _to_leaders(members: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """(name, t, size, blocks, near) of every member but the leader; members: (name, t, size, blocks)."""
    rows = members.withColumn("block", _block("blocks", "t"))
    others = rows.where("name <> t").select("name", "block", "t", "size", "blocks")
    leaders = rows.where("name = t").select("name", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "t", "size", "blocks")
    full = others.unionByName(leaders).join(texts, "t")

    def work(table: pa.Table) -> pa.Table:
        names, own = _arrow_nodes(table.column("name")), _arrow_nodes(table.column("t"))
        lead = (names == own).all(1)
        docs = [weighted(doc) for doc in kernel.lowered(table.column("text"))]
        head = docs[int(np.flatnonzero(lead)[0])]
        rest = np.flatnonzero(~lead)
        near = [similarity(head, docs[i]) >= similar - 1e-12 for i in rest]
        return table.select(["name", "t", "size", "blocks"]).take(pa.array(rest)).append_column("near", pa.array(near, pa.bool_()))

    return full.groupBy("name", "block").applyInArrow(work, f"name {NODE}, t {NODE}, size long, blocks int, near boolean")


def _all_with_all(left: DataFrame, members: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) that span what each of left (name, t, size, blocks) is near to among the members (name, t, blocks) of its name."""
    groups = _sizes(left, "lefts")
    held = _salted(left, "t").join(_every_salt(groups), ["name", "salt"])
    both = _salted(members, "t").join(_every_salt(groups), ["name", "salt"])
    # A task has the left texts of block i and the members of block j.
    i = held.select("name", _block("lefts", "t").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "t")
    j = both.select("name", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), _block("blocks", "t").alias("j"), "t")
    full = i.unionByName(j).distinct().join(texts, "t")

    def work(table: pa.Table) -> pa.Table:
        own = _arrow_nodes(table.column("t"))
        order = np.lexsort((own[:, 1], own[:, 0]))
        docs = [weighted(doc) for doc in kernel.lowered(table.column("text"))]
        label = forest([docs[k] for k in order], similar)
        own = own[order]
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": _node_array(own[label[linked]]), "b": _node_array(own[linked])})

    return full.groupBy("name", "i", "j").applyInArrow(work, f"a {NODE}, b {NODE}")


def compared(members: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) that span the similar texts under each name; members: (name, t, size); texts: (t, text)."""
    # Names of more than one block are few; the others need no join.
    large = _every_salt(_sizes(members, "n").where("n > 1"))
    members = _salted(members, "t").join(large, ["name", "salt"], "left").select("name", "t", "size", F.coalesce("n", F.lit(1)).alias("blocks"))
    members = written(members, "blocks")
    first = written(_to_leaders(members, texts, similar), "first")
    links = first.where("near").select(F.col("name").alias("a"), F.col("t").alias("b"))
    left = first.where("not near").drop("near")
    return links.unionByName(_all_with_all(left, members, texts, similar))


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows (u, v) with m, the least neighbour of u; least: (u, m, c), c neighbours each.

    Names with more than HOT neighbours (at most one in HOT of the edges) are joined by
    broadcast, so that a large star isn't gathered in one task.
    """
    least = written(least, "least")
    hot = least.where(F.col("c") > HOT)
    if not 0 < hot.count() <= BROADCAST:
        return rows.join(least.drop("c"), "u")
    cold = rows.join(F.broadcast(hot.select("u")), "u", "left_anti").join(least.where(F.col("c") <= HOT).drop("c"), "u")
    return cold.unionByName(rows.join(F.broadcast(hot.drop("c")), "u"))


def components(edges: DataFrame) -> DataFrame:
    """(id, class): the smallest name that can be reached, for every one with an edge (a, b).

    Alternating large and small stars; edges are written between rounds.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(edges):
        two = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = two.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).withColumn("m", F.least("u", "m"))
        large = _with_least(two.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        moved = _with_least(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class"))


def _stars(edges: DataFrame) -> bool:
    """Whether each id points to one smaller id that points nowhere."""
    ends = edges.select(F.col("u").alias("id"), "v").unionByName(edges.select(F.col("v").alias("id"), F.lit(None).cast(edges.schema["v"].dataType).alias("v")))
    seen = ends.groupBy("id").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("out"), F.count("*").alias("all"))
    return seen.where("low <> high or out > 0 and all > out").isEmpty()


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, broadcast: int = BROADCAST) -> DataFrame:
    """Per row: id, class_id (the smallest id of its class), text_id (the smallest with the
    same words), and x, class_x: the hashes of its own text and of the class's first one.

    broadcast: up to so many names the filter of the texts compared is a broadcast join,
    beyond it a shuffled one.
    """
    rows = written(sketch(docs, id_col=id_col, text_col=text_col), "sketch")
    t = F.struct("id", "x")
    # Copies of a text have equal sketches, so any one serves.
    texts = rows.groupBy("hi", "lo").agg(F.min(t).alias("t"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    texts = written(texts, "texts")
    banded = texts.select("t", "size", F.explode("bands").alias("band"))
    groups = banded.groupBy("band").agg(F.min("t").alias("name"), F.max("t").alias("last")).where("name < last").drop("last")
    members = _salted(banded, "t").join(_every_salt(groups), ["band", "salt"]).select("name", "t", "size")
    members = written(members.distinct(), "members")
    # Only the texts compared need to move.
    needed = written(members.select("t.id", "t.x").distinct(), "needed")
    needed = F.broadcast(needed) if needed.count() <= broadcast else needed
    body = keyed(docs, id_col, text_col).join(needed, ["id", "x"], "left_semi").dropDuplicates(["id", "x"])
    body = written(body.select(t.alias("t"), "text"), "bodies")
    edges = written(compared(members, body, similar).distinct(), "links")
    found = components(edges)
    named = texts.select("hi", "lo", "t").join(found.withColumnRenamed("id", "t"), "t", "left").select("hi", "lo", "t", F.coalesce("class", "t").alias("class"))
    out = rows.select("id", "x", "hi", "lo").join(named, ["hi", "lo"])
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(known("id").alias("id"), known("class.id").alias("class_id"), known("t.id").alias("text_id"), "x", F.col("class.x").alias("class_x"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select(F.col("id").alias("doc_id"), "class_id", "text_id")
