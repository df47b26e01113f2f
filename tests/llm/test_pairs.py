"""Near-duplicates, decontamination, neighbours and the pipeline against plain versions."""

import collections
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from torusflow.llm import decontaminate, kernel, neardup, neighbours

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def grams(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def jp(a, b):
    """The definition, term by term."""
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in a if d in b)


def byte_words(t):
    """As the kernel has them: runs of ASCII letters and digits and of all other characters above ASCII."""
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())


def plain_classes(docs, similar=0.8):
    bags = {}
    for i, t in docs:
        w = byte_words(t)
        bags[i] = collections.Counter(grams(w, min(5, len(w)))) if w else None
    ids = [i for i, _ in docs]
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if bags[i] and bags[j] and set(bags[i]) & set(bags[j]) and jp(bags[i], bags[j]) >= similar - 1e-9:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in ids}


@given(st.dictionaries(st.integers(0, 8), st.integers(1, 4), min_size=1), st.dictionaries(st.integers(0, 8), st.integers(1, 4), min_size=1))
@settings(max_examples=200, deadline=None)
def test_similarity_is_the_definition(a, b):
    as_arrays = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))
    assert abs(neardup.similarity(as_arrays(a), as_arrays(b)) - jp(a, b)) < 1e-9


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = kernel.mix(np.arange(1, 400, dtype=np.uint64))
    hits, want = [], []
    for _ in range(30):
        a, b = (np.sort(rng.choice(pool, 200, replace=False)) for _ in range(2))
        ca, cb = rng.integers(1, 3, 200), rng.integers(1, 3, 200)
        hits.append((neardup.signature(a, ca) == neardup.signature(b, cb)).mean())
        want.append(neardup.similarity((a, ca), (b, cb)))
    assert abs(np.mean(hits) - np.mean(want)) < 0.03


@given(st.lists(st.dictionaries(st.integers(0, 60), st.integers(1, 3), min_size=1, max_size=30), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_shared_weights(bags):
    docs = [(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)])) for d in bags]
    got = neardup.shared_weight(docs)
    for i, a in enumerate(bags):
        for j, b in enumerate(bags):
            assert got[i, j] == sum(v for k, v in a.items() if k in b)


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(300)]
    docs, n = [], 0
    for _ in range(25):
        base = rng.choice(vocabulary, int(rng.integers(6, 120))).tolist()
        for _ in range(int(rng.integers(1, 8))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = "edit" + str(rng.integers(1000))
            docs.append((n, " ".join(copy) + ("!" if n % 2 else " ")))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, "... !!"), (n + 3, "one two"), (n + 4, "One, TWO"), (n + 5, "one"), (n + 6, "same " * 5000), (n + 7, "same " * 5000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, class_id string")
    got = {r["id"]: r["class_id"] for r in neardup.classes(df.repartition(5)).collect()}
    assert got == plain_classes(docs)


@pytest.mark.parametrize("broadcast", [0, neardup.BROADCAST])
def test_blocks_lose_nothing(spark, monkeypatch, broadcast):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    base = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(30)]
    got = {r["id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string"), broadcast=broadcast).collect()}
    assert got == plain_classes(docs) and len(set(got.values())) == 1


def test_links_away_from_the_leader(spark, monkeypatch):
    """A chain: neighbours are near, most members are not near the group's first text."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    words_ = [f"w{i}" for i in range(160)]
    docs = [(i, " ".join(words_[3 * i : 3 * i + 80])) for i in range(20)]
    got = {r["id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_classes(docs) and len(set(got.values())) == 1


def test_texts_of_a_repeated_id_keep_their_links(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    docs = [(7, a), (7, b), (8, b + " x"), (9, a + " x"), (None, a + " y")]
    got = {(r["id"], r["x"]): (r["class_id"], r["class_x"]) for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    of = {(i, t): got[i, x] for (i, t), x in zip(docs, [r[0] for r in spark.createDataFrame(docs, "i long, t string").selectExpr("xxhash64(t)").collect()])}
    assert of[8, b + " x"] == of[7, b] != of[7, a] == of[9, a + " x"] == of[None, a + " y"]


def test_a_text_of_several_megabytes(spark):
    long_ = " ".join(f"w{i % 7919}x{i % 13}" for i in range(400_000))
    docs = [(1, long_), (2, long_ + " end"), (3, "short text of six plain words")]
    got = {r["id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_classes_of_nothing(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r["id"] or -1, r["class_id"] or -1) for r in neardup.classes(odd).collect()) == [(-1, -1), (-1, 7), (7, 7), (7, 7)]


def plain_matches(docs, items, similar=0.8):
    out, best = {}, {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            iw = words(it)
            if not iw:
                continue
            k = min(5, len(iw))
            a, g = collections.Counter(grams(iw, k)), grams(w, k)
            n = sum(a.values())
            for s in range(max(1, len(g) - n + 1)) if g else ():
                b = collections.Counter(g[s : s + n])
                o = sum((a & b).values())
                j = o / (n + sum(b.values()) - o)
                begins = g[s] in a or s == max(0, len(g) - n)  # what the report promises of its window
                best[d, i] = max(best.get((d, i), 0), j)
                if begins and j >= similar - 1e-12 and j > out.get((d, i), (0, 0))[0] + 1e-12:
                    out[d, i] = j, s
    # No window at all is more similar than the best of those.
    assert {k: j for k, j in best.items() if j >= similar - 1e-12} == {k: j for k, (j, _) in out.items()}
    return out


@pytest.mark.parametrize("broadcast", [0, decontaminate.BROADCAST])
def test_decontamination_equals_brute_force(spark, broadcast):
    rng = np.random.default_rng(2)
    v = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(v, int(rng.integers(3, 60))))) for i in range(20)] + [(20, None), (21, "ab ab ab ab ab ab ab ab ab"), (22, "solo")]
    docs = []
    for n in range(60):
        w = rng.choice(v, int(rng.integers(0, 150))).tolist()
        passage = words(items[int(rng.integers(len(items)))][1])
        for _ in range(int(rng.integers(0, 3))):
            if passage:
                passage[int(rng.integers(len(passage)))] = "edit"
        at = int(rng.integers(len(w) + 1))
        docs.append((n, " ".join(w[:at] + passage + w[at:])))
    docs += [(60, None), (61, ""), (62, "Solo!"), (63, items[0][1]), (63, items[0][1])]
    got = decontaminate.matches(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int"), spark.createDataFrame(items, "item_id long, text string"), broadcast=broadcast).collect()
    want = plain_matches(docs, items)
    assert {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start"]) for r in got} == {k: (round(j, 9), s) for k, (j, s) in want.items()}
    assert len(got) == len(want) > 20


def test_blocks_select_and_the_rest_is_found(spark):
    """The index meets every fingerprint within the radius and under 1 % of random ones; what lies beyond isn't lost."""
    rng = np.random.default_rng(6)
    flips = set(decontaminate.masks())
    meets = lambda a, b: any((a >> s & 0xFFFF) ^ (b >> s & 0xFFFF) in flips for s in range(0, 64, 16))
    draw = lambda: int(rng.integers(0, 1 << 64, dtype=np.uint64))
    assert sum(meets(draw(), draw()) for _ in range(20_000)) < 200
    for _ in range(500):
        a, d = draw(), int(rng.integers(0, decontaminate.RADIUS + 1))
        assert meets(a, a ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    v = [f"t{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choice(v, 60))) for i in range(60)]
    docs = []
    for i, t in items:  # one changed word in the middle: 51 of 61 shingles, similarity 0.836
        w = t.split()
        w[30] = "edit"
        docs += [(2 * i, " ".join(w)), (2 * i + 1, "before " + t + " after")]
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), report=True).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(2 * i + j, i) for i, _ in items for j in (0, 1)}
    ways = collections.Counter((r["doc_id"] % 2, r["way"]) for r in got)
    assert ways[1, "blocks"] == 60 and ways[0, "blocks"] >= 30  # the recall of the radius at this similarity, and the rest:
    assert ways[0, "blocks"] + ways[0, "rarest"] == 60 and all((r["distance"] <= decontaminate.RADIUS) == (r["way"] == "blocks") for r in got)


def test_decontamination_of_long_texts(spark):
    rng = np.random.default_rng(7)
    v = [f"t{i}" for i in range(9000)]
    item = " ".join(rng.choice(v, 50))
    text = " ".join([*rng.choice(v, 200_000), item, *rng.choice(v, 200_000)])
    got = decontaminate.matches(spark.createDataFrame([(1, text), (None, text), (2, text[:900_000])], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"], r["start"]) for r in got) == [(-1, 5, 200_000), (1, 5, 200_000)]


def test_decontamination_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.matches(docs, items).count() == decontaminate.matches(one, items).count() == 0
    assert decontaminate.matches(docs, one.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 24))
    rows = [(int(i), x.tolist(), "c") for i, x in enumerate(v)]
    rows += [(5000, None, "c"), (5100, [0.0] * 24, "c"), (5200, [float("nan")] * 24, "c"), (5300, [1.0, 2.0], "c"), (0, v[0].tolist(), "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, df.where("vec_id % 100 = 0"), block=600).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == set(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(np.square(v - v[q]).sum(1))
        best = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        hits += len(set(best) & {f[0] for f in found})
        assert all(abs(d[i] - s) < 1e-12 for i, s, _ in found)
    assert hits / (10 * len(got)) >= 0.9
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (100, 200, 300)")
    assert neighbours.search(few, few.where("vec_id = 100")).count() == 2


def test_repeated_rows_leave_room_for_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 8))
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(0, v[0].tolist())] * 20 + [(7, v[0].tolist()), (9, v[3].tolist()), (9, v[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = df.where("vec_id in (0, 3, 9)")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, asks, most=1.0, nearer=0.0, block=150).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    assert set(got) == {0, 3, 9}
    for q, found in got.items():
        near = {}
        for _, x in (r for r in rows if r[0] == q):
            for i, y in rows:
                if (i, y) != (q, x):
                    near[i] = min(near.get(i, np.inf), float(np.linalg.norm(np.array(x) - y)))
        assert found == [(i, round(d, 9)) for d, i in sorted((d, i) for i, d in near.items())[:10]]


def test_neighbours_of_the_query_by_brute_force(spark):
    """The registered query on its table: recall, order, distances, and how much was verified."""
    sf = "/root/testdata/sf0.1"
    ids, vecs = zip(*[(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()])
    ids, vecs = np.array(ids), np.array(vecs, np.float64)
    got = collections.defaultdict(list)
    for r in neighbours.op7(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["verified"]))
    hits, share = [], []
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(np.square(vecs - vecs[q]).sum(1))
        best = [i for i in np.lexsort((ids, d)) if i != q][:10]
        found = got.pop(int(ids[q]))
        assert [(s, v) for v, s, _ in found] == sorted((s, v) for v, s, _ in found) and len(found) == 10
        at = {int(i): x for i, x in zip(ids, d)}
        assert all(abs(at[v] - s) < 1e-12 for v, s, _ in found)
        hits.append(len({v for v, _, _ in found} & {int(ids[i]) for i in best}) / 10)
        share.append(found[0][2] / len(ids))
    print("recall", np.mean(hits), "verified", np.mean(share))
    assert not got and np.mean(hits) >= 0.9 and np.mean(share) < 0.06


def test_neighbours_of_every_dimension(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3 + 5 * (i % 2)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, df.where("vec_id in (0, 1)"), k=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q in (0, 1):
        d = sorted((float(np.linalg.norm(np.array(v) - rows[q][1])), i) for i, v in rows if i != q and i % 2 == q)
        assert got[q] == [i for _, i in d[:4]]


def test_neighbours_at_equal_distances(spark):
    rows = [(100, [0.0, 0.5])] + [(i, [float(np.cos(i * np.pi / 2)), float(np.round(np.sin(i * np.pi / 2))) + 0.5]) for i in range(8)]
    rows = [(i, [round(x) if j == 0 else y for j, (x, y) in enumerate([(v[0], v[0]), (v[1], v[1])])]) for i, v in rows]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in neighbours.search(df, df.where("vec_id = 100"), k=3).orderBy("rank").collect()]
    assert got == [(0, 1.0), (1, 1.0), (2, 1.0)]


def test_pipeline_against_a_plain_one(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = pipeline.language_id(spark, docs, SF)
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    classes = plain_classes(sorted(texts.items()))
    kept = {i for i in texts if classes[i] == i}
    assert {r["doc_id"] for r in pipeline.near_duplicates(spark, first, SF).collect()} == kept
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in plain_matches([(i, texts[i]) for i in kept], items)}
    out = pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == kept - leaks
    assert all(r["round_trip"] for r in out)


def test_decontamination_without_ids(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    leak = " ".join(f"word{i}" for i in range(30))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, leak), (None, "clean text"), (None, None), (5, "x " + leak), (5, "other words"), (6, "fine")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in pipeline.decontamination(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(None, "clean text"), (None, None), (5, "other words"), (6, "fine")], key=str)


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, class_id string")


def test_stage_of_near_duplicates_keeps_one_row_of_each_class(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    rows = [(None, a), (None, a), (7, a + " x"), (7, a + " x"), (7, b), (8, b + " y"), (None, None), (9, "..."), (10, "..."), (None, "alone and of six words here"), (6, "other text"), (6, "second other")]
    got = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, rows_of(spark, rows), "").collect()]
    assert sorted(got, key=str) == sorted([(7, a + " x"), (7, b), (None, None), (9, "..."), (10, "..."), (None, "alone and of six words here"), (6, "other text"), (6, "second other")], key=str)


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, None), (None, ""), (7, "the mail is a@b.cd and the phone +1 (017) 555-7713"), (7, "the mail is a@b.cd and the phone +1 (017) 555-7713"), (8, "word " * 100_000)]
    none = rows_of(spark, rows).limit(0)
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).columns == list(pipeline.COLUMNS) and stage(spark, none, str(tmp_path)).count() == 0, name
    assert pipeline.tokens(spark, none, "").count() == 0
    odd = rows_of(spark, rows)
    assert sorted(r["doc_id"] for r in pipeline.language_id(spark, odd, "").collect()) == [7, 7, 8]
    assert pipeline.decontamination(spark, odd, str(tmp_path)).count() == 5
    clean = [(r["doc_id"], r["text"], r["n_chars"]) for r in pipeline.personal_data(spark, odd, "").collect()]
    text = "the mail is <EMAIL> and the phone <PHONE>"
    assert sorted(clean, key=str) == sorted([(1, None, None), (None, "", 0), (7, text, len(text)), (7, text, len(text)), (8, "word " * 100_000, 500_000)], key=str)
    assert sorted(r["n_tokens"] for r in pipeline.tokens(spark, odd, "").collect())[:2] == [1, 1]


def test_personal_data_stage_equals_plain_redaction(spark):
    """Of the base kinds, on the documents: nothing that the plain patterns confirm is left."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from .test_records import plain_spans

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pipeline.personal_data(spark, docs, SF).collect():
        assert not plain_spans(r["text"]) and (r["text"] == before[r["doc_id"]]) >= (not re.search("[@0-9]", before[r["doc_id"]] or ""))
