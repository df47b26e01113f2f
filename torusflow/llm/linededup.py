"""Dropping of lines that many documents share (operator 12).

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at
least min_chars code points go by a hash of 128 bits. One aggregation over all documents
counts the documents of each distinct key and finds the largest id that holds it. The keys
found in at least min_docs documents, the only ones that can be dropped, are dealt to shards
by their hash; every shard becomes a minimal perfect hash (bit arrays, each key where it
alone hashes to) over an array of fingerprints (64 further bits of the hash), one of counts
and one of the ids that keep the line. Documents then probe the arrays by arithmetic alone:
no line is joined to another, and no text moves.

Where all shards take at most broadcast bytes, each task holds them. Beyond that the hashes of
a document's lines go to their shard instead, dealt over SALTS copies of it so that a line
that is everywhere doesn't end in one task, and the positions to drop come back by document.
Both ways give the same rows. A wrong drop needs two keys that agree in 128 bits.

Edge cases: each row is a document, also where ids or whole rows repeat; a null id counts as
smaller than any other; null and empty texts are one empty line; a document all of whose
lines go keeps the empty text; texts are read whole, whatever their length; extra columns
are ignored unless asked for; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: White space that is stripped.
SPACE = b" \t\n\x0b\x0c\r"
#: Keys of a shard, bytes of all shards that each task may hold, copies of a shard beyond that.
SHARD, BROADCAST, SALTS = 1 << 16, 48 << 20, 64
NO_ID = -(1 << 63)
#: Bits of a level of the perfect hash for each key that is left.
GAMMA = 2.0


def mixed(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """Another hash of the key for each level."""
    with np.errstate(over="ignore"):
        x = high + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32)) ^ low) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Gives n distinct keys of two hashes each the numbers 0 to n - 1.

    A level has GAMMA bits a key that is left; a bit is set where one key alone lands, and
    the others go on to the next level. A key's number is the count of bits set before its own.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.start = np.cumsum(sizes) - sizes
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def over(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(high):
            size = 64 * max(1, int(np.ceil(GAMMA * len(high) / 64)))
            at = (mixed(high, low, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[at]
            high, low = high[left], low[left]
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def number(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The numbers of keys; -1 or any number for a key that isn't one of the set."""
        out, left = np.full(len(high), -1, np.int64), np.arange(len(high))
        for level, size in enumerate(self.sizes):
            at = (mixed(high[left], low[left], level) % np.uint64(size)).astype(np.int64) + self.start[level]
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.before[at[hit] >> 6] + below
            left = left[~hit]
            if not len(left):
                break
        return out


FIELDS = ("sizes", "bits", "prints", "counts", "keepers")


class Shard:
    """A perfect hash with its arrays: fingerprints, counts, and the ids that keep a line."""

    def __init__(self, hashed: PerfectHash, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.hashed, self.prints, self.counts, self.keepers = hashed, prints, counts, keepers

    @classmethod
    def over(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        hashed = PerfectHash.over(high, low)
        order = np.argsort(hashed.number(high, low))
        return cls(hashed, low[order], counts[order].astype(np.int32), keepers[order])

    def look(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per key its count (0 if it isn't of the set) and the id that keeps it."""
        at = self.hashed.number(high, low)
        if not len(self.prints):
            return np.zeros(len(at), np.int32), np.full(len(at), NO_ID)
        held = (at >= 0) & (self.prints[at] == low)
        return np.where(held, self.counts[at], 0), np.where(held, self.keepers[at], NO_ID)

    def drops(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a document of the id loses the line."""
        count, keeper = self.look(high, low)
        return (count > 0) & (ids != keeper)

    def row(self) -> tuple:
        return tuple(x.tobytes() for x in (self.hashed.sizes, self.hashed.bits, self.prints, self.counts, self.keepers))

    @classmethod
    def of(cls, sizes: bytes, bits: bytes, prints: bytes, counts: bytes, keepers: bytes) -> Shard:
        return cls(PerfectHash(np.frombuffer(sizes, np.int64), np.frombuffer(bits, np.uint64)), np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.int32), np.frombuffer(keepers, np.int64))


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return ((high >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def keys(text: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """(number of the line, key) of the lines whose keys are long enough."""
    out = []
    for i, line in enumerate(text.lower().split(b"\n")):
        if len(line) >= min_chars:  # no more code points than bytes
            key = line.strip(SPACE)
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                out.append((i, key))
    return out


def hashed(texts: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every long enough line: both halves of its hash, its text's place and its own number."""
    found = [keys(t, min_chars) for t in texts]
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for own in found for _, k in own), ">u8").astype(np.uint64).reshape(-1, 2)
    rows = np.repeat(np.arange(len(texts)), [len(own) for own in found])
    return both[:, 0].copy(), both[:, 1].copy(), rows, np.array([i for own in found for i, _ in own], np.int32)


def _texts(column) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _named(id_col: str, text_col: str) -> list[F.Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text")]


def recurring(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(high, low, n, keeper): the keys found in at least min_docs documents, and the largest id of each."""

    def work(batches):
        for batch in batches:
            high, low, rows, _ = hashed(_texts(batch.column(1)), min_chars)
            # A document counts once for each of its lines.
            order = np.lexsort((low, high, rows))
            same = np.zeros(len(order), bool)
            same[1:] = np.logical_and.reduce([np.diff(x[order]) == 0 for x in (rows, high, low)])
            once = order[~same]
            yield pa.RecordBatch.from_arrays([_signed(high[once]), _signed(low[once]), batch.column(0).take(pa.array(rows[once]))], ["high", "low", "id"])

    lines = docs.select(*_named(id_col, text_col)).mapInArrow(work, "high long, low long, id long")
    return lines.groupBy("high", "low").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)


def index(found: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int]:
    """(shard, its arrays) over the rows of ``recurring``, and the number of shards."""
    found = written(found, "recurring")
    shards = max(1, -(-found.count() // shard))

    def build(table: pa.Table) -> pa.Table:
        high, low, n, keeper = (table.column(c).to_numpy() for c in ("high", "low", "n", "keeper"))
        arrays = Shard.over(high.view(np.uint64), low.view(np.uint64), n, keeper).row()
        return pa.table([table.column("shard").slice(0, 1), *(pa.array([x], pa.binary()) for x in arrays)], ["shard", *FIELDS])

    dealt = found.withColumn("shard", F.pmod(F.shiftrightunsigned("high", 32), F.lit(shards)))
    return written(dealt.groupBy("shard").applyInArrow(build, "shard long, " + ", ".join(f"{f} binary" for f in FIELDS)), "shards"), shards


def in_every_task(found: DataFrame, shards: int, min_chars: int):
    """The lines to drop of a batch, by arrays that each task holds."""
    held = found.sparkSession.sparkContext.broadcast({r["shard"]: tuple(r[f] for f in FIELDS) for r in found.collect()})  # checked by the caller

    def start():
        parts = {s: Shard.of(*map(bytes, arrays)) for s, arrays in held.value.items()}

        def gone(column: dict, texts: list[bytes]):
            high, low, rows, lines = hashed(texts, min_chars)
            ids, shard, out = column["id"].to_numpy()[rows], shard_of(high, shards), np.zeros(len(rows), bool)
            for s in np.unique(shard):
                if s in parts:
                    mine = np.flatnonzero(shard == s)
                    out[mine] = parts[s].drops(high[mine], low[mine], ids[mine])
            return rows[out], lines[out]

        return gone

    return start


def by_shard(docs: DataFrame, found: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """(id, x, gone): the lines that each of docs (id, text, x) loses, sought in the shards' own tasks.

    A task reads the arrays of a shard first and then its lines, one batch after the other.
    """

    def ask(batches):
        for batch in batches:
            high, low, rows, lines = hashed(_texts(batch.column(1)), min_chars)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(high, shards)), _signed(high), _signed(low), batch.column(0).take(at), batch.column(2).take(at), pa.array(lines)], ["shard", "high", "low", "id", "x", "line"])

    asked = docs.select("id", "text", "x").mapInArrow(ask, "shard long, high long, low long, id long, x long, line int")
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("id", "x", "line"), F.lit(SALTS))).withColumn("asks", F.lit(True))
    arrays = found.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))).withColumn("asks", F.lit(False))
    both = arrays.unionByName(asked, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "asks")

    def look(batches):
        now, arrays = None, None
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            shard, asks = column["shard"].to_numpy(), column["asks"].to_numpy(zero_copy_only=False)
            high, low, ids = (column[c].fill_null(0).to_numpy() for c in ("high", "low", "id"))
            gone = np.zeros(len(shard), bool)
            for s in np.unique(shard):
                if s != now:
                    first = np.flatnonzero((shard == s) & ~asks)
                    now, arrays = s, Shard.of(*(column[f][int(first[0])].as_py() for f in FIELDS)) if len(first) else None
                if arrays is not None:
                    mine = np.flatnonzero((shard == s) & asks)
                    gone[mine] = arrays.drops(high[mine].view(np.uint64), low[mine].view(np.uint64), ids[mine])
            yield pa.RecordBatch.from_arrays([column[c].filter(pa.array(gone)) for c in ("id", "x", "line")], ["id", "x", "line"])

    return both.mapInArrow(look, "id long, x long, line int").groupBy("id", "x").agg(F.collect_set("line").alias("gone"))


def drop(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), min_chars: int = 40, min_docs: int = 5, broadcast: int = BROADCAST, shard: int = SHARD) -> DataFrame:
    """Per document: id, keep, n_lines (before), n_dropped, text (what stays)."""
    found, shards = index(recurring(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs), shard)
    given = docs.select(*_named(id_col, text_col), F.struct(F.col(id_col).alias("id"), *keep).alias("kept"))
    size = found.select(F.sum(sum(F.length(f) for f in FIELDS))).first()[0] or 0
    if size <= broadcast:
        start = in_every_task(found, shards, min_chars)
    else:
        given = given.withColumn("x", F.xxhash64("text"))
        given = given.join(by_shard(given, found, shards, min_chars), ["id", "x"], "left")

        def start():
            def gone(column: dict, texts: list[bytes]):
                lines = [own or [] for own in column["gone"].to_pylist()]
                return np.repeat(np.arange(len(lines)), [len(own) for own in lines]), np.array([i for own in lines for i in own], np.int32)

            return gone

    def work(batches):
        gone = start()
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            texts = _texts(column["text"])
            lost: dict[int, set] = {}
            for row, line in zip(*(x.tolist() for x in gone(column, texts))):
                lost.setdefault(row, set()).add(line)
            total = [t.count(b"\n") + 1 for t in texts]
            for row, own in lost.items():
                texts[row] = b"\n".join(line for i, line in enumerate(texts[row].split(b"\n")) if i not in own)
            dropped = [len(lost.get(row, ())) for row in range(len(texts))]
            yield pa.RecordBatch.from_arrays([column["kept"], pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array([t.decode() for t in texts], pa.string())], ["kept", "n_lines", "n_dropped", "text"])

    out = given.mapInArrow(work, f"kept {given.schema['kept'].dataType.simpleString()}, n_lines long, n_dropped long, text string")
    return out.select("kept.*", "n_lines", "n_dropped", "text")


def op12(spark, sf_dir: str) -> DataFrame:
    kept = drop(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS row_, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT row_, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT row_) >= 5
), judged AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id IS DISTINCT FROM o.keeper AS gone FROM keyed k LEFT JOIN often o ON o.key = k.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row_
"""
