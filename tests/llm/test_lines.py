"""Line dedup against a plain version."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from torusflow.llm import linededup, queries

from ..compare import oracle, spark_rows

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, chars=40, docs=5):
    held = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    small = lambda i: -(1 << 63) if i is None else i
    for n, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                held[key(line)].add(n)
    keeper = {k: max(small(rows[n][0]) for n in own) for k, own in held.items() if len(own) >= docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in keeper or keeper[key(x)] == small(i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def sample(seed):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "ÉTÉ", "été", "gamma", "DELTA", "😀", "x", "İstanbul"]
    pool = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 12))) for _ in range(60)] + ["a" * 39, "b" * 40, "é" * 39, "é" * 40, "😀" * 39 + "z"]
    space = ["", " ", "\t ", "\r", "\x0b", "\x0c", "\u00a0", "\x1f"]
    rows = []
    for i in range(300):
        lines = [rnd.choice(space) + (x.upper() if rnd.random() < 0.2 else x) + rnd.choice(space) for x in rnd.choices(pool, k=rnd.randint(0, 9))]
        if rnd.random() < 0.4:
            lines.append("A line that is found in every third document or more often")
        rows.append((rnd.choice([i, i, i, 7, None]), "\n".join(lines)))
    rows += [(1, None), (2, ""), (3, "\n\n"), (None, None), (9, "same line of forty characters and some more\n" * 50)]
    rows += [(i, "only this one line of over forty characters here") for i in (500, 501, 502, 503, 504, 504)]
    rows.append((600, "\n".join(f"a long document with many lines, this is number {n % 30000}" for n in range(60000))))
    rows += [(601 + i, f"a long document with many lines, this is number {i % 2}") for i in range(9)]
    return rows


@pytest.mark.parametrize("seed,broadcast,shard", [(0, 1 << 26, 1 << 16), (0, 0, 1 << 16), (1, 0, 7), (1, 1 << 26, 7)])
def test_equals_plain(spark, seed, broadcast, shard):
    rows = sample(seed)
    df = spark.createDataFrame([(i, t, 1, "x", 3) for i, t in rows], "doc_id long, text string, n int, high string, gone int").repartition(5)
    got = linededup.drop(df, keep=("high",), broadcast=broadcast, shard=shard)
    assert got.columns == ["id", "high", "n_lines", "n_dropped", "text"]
    assert sorted(((r["id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=repr) == plain(rows)


def test_empty_table_and_no_recurring_line(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.drop(empty).count() == 0 and linededup.drop(empty, broadcast=-1).count() == 0
    one = spark.createDataFrame([(1, "x" * 50)], "doc_id long, text string")
    for bound in (1 << 20, -1):
        assert [tuple(r) for r in linededup.drop(one, broadcast=bound).collect()] == [(1, 1, 0, "x" * 50)]


def test_perfect_hash_is_minimal_and_foreign_keys_miss():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 1000, 20000):
        high, low = rng.integers(0, 1 << 63, (2, n)).astype(np.uint64)
        if n > 2:
            high[1] = high[0]  # half of the hash may agree
        shard = linededup.Shard.of(*linededup.Shard.over(high, low, np.arange(n) + 5, -np.arange(n)).row())
        assert sorted(shard.hashed.number(high, low)) == list(range(n))
        count, keeper = shard.look(high, low)
        assert (count == np.arange(n) + 5).all() and (keeper == -np.arange(n)).all()
        other = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
        assert (shard.look(*other)[0] == 0).all()
        assert not n or shard.hashed.bits.nbytes * 8 < 6 * n + 2000


def test_query_equals_sql(spark):
    assert spark_rows(queries.QUERIES["op12_line_dedup"](spark, SF)) == oracle(SF, queries.ORACLES["op12_line_dedup"])


def test_query_digest_is_of_the_text_kept(spark, tmp_path):
    rows = [(i, f"line number {i}\nthis line of more than forty characters is in all of them") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["kept_sha256"] for r in linededup.op12(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256((t if i == 5 else t.split("\n")[0]).encode()).hexdigest() for i, t in rows}
