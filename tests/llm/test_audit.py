"""The filter audit against a plain version."""

import random
import re
from itertools import permutations

import pytest

from torusflow.llm import filteraudit, queries

from ..compare import oracle, spark_rows

SF = "/root/testdata/sf0.001"


def plain(docs, labels):
    """docs: (id, lang, text); labels: (id, quality, toxic). Every order is applied document by document."""
    rows, least = [], {}
    for i, _, text in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, lang, text in docs:
        t = text or ""
        w = re.findall("[^\\x20\\x09-\\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        mine = [x for x in labels if x[0] == i and i is not None]
        rows.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left, seen = [r for r in rows if r[0] == part], [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(r[1][f] for r in seen) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in seen),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                )
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def mine(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "y") for r in docs], "doc_id long, lang string, text string, bits int, part string").repartition(3)
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filteraudit.audit(filteraudit.bitmaps(filteraudit.decided(d, m)))
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in got.collect()}


def sample(seed, n=260):
    rnd = random.Random(seed)
    words = ["Red", "blue", "GREEN", "ö", "日本", "a#b", "50%", "x"] + [f"w{i}" for i in range(300)]
    texts = [rnd.choice([" ", "\n", "\t\x0b", "\u00a0 "]).join(rnd.choices(words[: rnd.choice([8, 40, 308])][rnd.choice([0, 3]) :], k=rnd.choice([0, 3, 199, 200, 201, 500]))) for _ in range(60)]
    docs = [(rnd.choice([i, i, i, 5, None]), rnd.choice(["en", "de", "", None]), rnd.choice([*texts, *texts[:2] * 20, None, ""])) for i in range(n)]
    docs += [(1000, "en", "a" * 3_000_000), (1001, "en", "word " * 400_000), (1001, "en", "word " * 400_000), (1002, "en", "word " * 400_000)]
    return docs, [(rnd.choice([i, 5, None]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(200)]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_plain(spark, seed):
    docs, labels = sample(seed)
    got = mine(spark, docs, labels)
    assert got == plain(docs, labels) and len(got) == 600 * len({d[1] or "" for d in docs})


def test_hand_counted(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(1, "en", long), (2, "en", long), (3, "en", "Short #1"), (4, "en", None)]
    got = mine(spark, docs, [(3, 1, 0), (2, 0, 1)])
    assert got["en", "ABCDE", 1] == (2, 2, 0, 1, 1, 0, 120 + 40)  # the third fails A, C and D
    assert got["en", "ABCDE", 5] == (1, 1, 0, 1, 0, 1, 120)
    assert got["en", "DABCE", 2][:6] == (2, 1, 1, 1, 0, 0)
    # Each document is removed once in each order, by one filter or another.
    assert sum(got["en", "ABCDE", s][6] for s in range(1, 6)) == 120 * 3


def test_empty_tables(spark):
    assert mine(spark, [], []) == {} and len(mine(spark, [(1, None, None)], [])) == 600


def test_many_copies_and_many_parts(spark):
    docs = [(i, f"l{i % 90}", "one text that a third of all rows share" if i % 3 else f"text {i}") for i in range(3000)]
    got = mine(spark, docs, [])
    assert len(got) == 600 * 90
    assert sum(v[1] for k, v in got.items() if k[1] == "EABCD" and k[2] == 1) == 1999


def test_query_equals_sql(spark):
    assert spark_rows(queries.QUERIES["op13_filter_audit"](spark, SF)) == oracle(SF, queries.ORACLES["op13_filter_audit"])
