"""Language, quality and toxicity: held-out accuracy and edge cases."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from torusflow.llm import kernel, language, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "123 456 !!"), (4, "x" * 200_000), (4, "x" * 200_000), (None, "the cat")]


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    n1, n0 = label.sum(), (1 - label).sum()
    return (order[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = language.op1(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in ODD], "doc_id long, text string, lang_pred string")
    model = language._train(["the cat and the dog"] * 4 + ["der hund und die katze"] * 4, ["en"] * 4 + ["de"] * 4)
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predict(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "en")} <= got and language.predict(docs, model).count() == len(ODD)
    none = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}
    one = language._train(["the cat"] * 3, ["en"] * 3)
    assert {r["lang_pred"] for r in language.predict(docs, one).collect()} == {"und", "en"}


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 30])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= (1 if n == 2 else 2)


def test_chunks_do_not_change_margins(monkeypatch):
    model = language._train(["the cat and the dog"] * 4 + ["der hund und die katze"] * 4, ["en"] * 4 + ["de"] * 4)
    doc = np.frombuffer(b"the cat und die katze and so on " * 20, np.uint8)
    whole = model.margins(doc)
    monkeypatch.setattr(language, "CHUNK", 64)
    assert np.allclose(whole, model.margins(doc))


def held_out(spark, op, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").dropna(subset=[label])
    rows = op(spark, SF).join(labels, "doc_id").where("held_out").select("score", label, "predicted").collect()
    return np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])


def test_quality_held_out(spark):
    assert auc(*held_out(spark, quality.op4, "quality")) > 0.97


def test_toxicity_held_out(spark):
    assert auc(*held_out(spark, toxicity.op6, "toxic")) > 0.95


def test_scores_on_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in ODD], "doc_id long, text string, score double")
    for model, lower in ((quality.train(["good text here"] * 9 + ["### !!!"] * 9, [1] * 9 + [0] * 9, 0.5), False), (toxicity.train(["good text"] * 9 + ["bad idiot"] * 9, [0] * 9 + [1] * 9, 0.5), True), (quality.train([], [], 0.5), False)):
        rows = quality.score(docs, model, lower=lower).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert quality.score(docs.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    x = [(np.array([0, 1, 2]), v / np.linalg.norm(v)) for v in np.c_[rng.normal(size=(60, 2)), np.ones(60)]]
    y = np.where([v[0] > v[1] for _, v in x], 1.0, -1.0)
    w = quality.dual_descent(x, y, 3, np.full(60, 10.0), 200, rng)
    assert np.mean([np.sign(w[a] @ v) == s for (a, v), s in zip(x, y)]) > 0.95


def test_counterfactuals_quiet_identity_terms():
    texts = ["the muslim people are idiots"] * 20 + ["the christian people sing"] * 20 + ["idiots shout"] * 10 + ["people sing songs"] * 10
    labels = [1] * 20 + [0] * 20 + [1] * 10 + [0] * 10
    gaps = []
    for strength in (0.0, 50.0):
        m = toxicity.train(texts, labels, 0.5, counterfactual=strength, clear=1.0)
        a, b = (m.logit(doc) for doc in kernel.lowered(pa.array(["the muslim people sing", "the christian people sing"])))
        gaps.append(abs(a - b))
    assert gaps[1] < gaps[0] / 3


# -- plain versions: whole numbers, dictionaries and floats, no arrays -------------------

U32, U64 = (1 << 32) - 1, (1 << 64) - 1


def plain_grams(doc, n, bits):
    doc = doc + b" " * max(0, n - len(doc))
    for i in range(len(doc) - n + 1):
        code = sum(doc[i + j] << 8 * j for j in range(n)) + n
        code = (code & U32) * 2654435761 & U32
        code ^= code >> 15
        yield (code * 0x85EBCA6B & U32) >> (32 - bits)


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & U64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & U64
    return x ^ x >> 31


def plain_words(doc):
    out, word = [], []
    for b in [*doc, 32]:
        if b >= 128 or chr(b).isalnum():
            word.append(b)
        elif word:
            out.append(word)
            word = []
    return out


def plain_hash(word, more=0):
    return plain_mix((sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word)) + more) & U64)


def logistic(z):
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def texts_of(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def test_language_equals_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    m = language.fit(docs)
    weights, bits = m.weights.tolist(), m.weights.shape[1]
    texts = texts_of(spark)
    for r in language.predict(docs, m).collect():
        text = texts[r["doc_id"]].lower()
        if not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und"
            continue
        total, n = [0.0] * bits, 0
        for order in (1, 2, 3):
            for g in plain_grams(text.encode(), order, language.BITS):
                total = [a + b for a, b in zip(total, weights[g])]
                n += 1
        margins = [t / n + float(b) for t, b in zip(total, m.bias)]
        loss = {lang: sum(float(t) * math.log1p(math.exp(-float(c) * z)) for t, c, z in zip(m.trust[i], m.code[i], margins)) for i, lang in enumerate(m.languages)}
        best = min(loss, key=lambda k: (loss[k], k))
        share = {k: math.exp(loss[best] - v) for k, v in loss.items()}
        assert r["lang_pred"] == best and abs(r["score"] - share[best] / sum(share.values())) < 1e-5


def test_bits_are_weighted_by_their_record():
    """A bit that is wrong about a language counts less for it."""
    m = language._train(["the cat and the dog sat"] * 5 + ["der hund und die katze"] * 5 + ["le chat et le chien"] * 5, ["en"] * 5 + ["de"] * 5 + ["fr"] * 5)
    assert m.trust.shape == m.code.shape and np.allclose(m.trust.mean(1), 1)
    odd = m.code[0] * 2.0
    odd[0] = -3.0 * m.code[0, 0]  # one bit speaks against the first language, all others for it
    sure = []
    for trust in (0.1, 0.3, 0.6):
        m.trust = np.ones_like(m.trust)
        m.trust[0, 0] = trust
        best, score, _ = m.decode(odd)
        sure.append(score if best == 0 else 0.0)
    assert sure[0] > sure[1] > sure[2]


def test_quality_equals_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    m = quality.fit(docs.select("doc_id", "text"), labels)
    weight, square = m.weight.tolist(), m.square.tolist()
    texts = texts_of(spark)
    for r in quality.score(docs.select("doc_id", "text"), m).collect():
        doc = texts[r["doc_id"]].encode()
        seen = {g for n in (2, 3, 4) for g in plain_grams(doc, n, quality.BITS)}
        words = [bytes(w) for w in plain_words(doc)]
        same = [int(a == b) for a, b in zip(words, words[1:])]
        for n in (1, 2, 3, 4):
            for i in range(len(same) - n + 1):
                seen.add(plain_mix(sum(same[i + j] << j for j in range(n)) + 1000 * n) >> (64 - quality.BITS))
        norm = math.sqrt(sum(square[g] for g in seen))
        margin = sum(weight[g] for g in seen) / norm if norm else 0.0
        want = logistic(m.curve[0] * margin + m.curve[1])
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == (r["score"] >= 0.3)


def test_toxicity_equals_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(docs.select("doc_id", "text"), labels)
    weight = {i: w for i, w in enumerate(m.weight.tolist()) if w}
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = texts_of(spark)
    for r in quality.score(small, m, threshold=0.7, lower=True).collect():
        seen = set()
        for w in plain_words(texts[r["doc_id"]].lower().encode()):
            seen |= {plain_hash(w)} | {plain_hash(w[:n], n) for n in toxicity.HEADS if len(w) > n}
        want = logistic(sum(weight.get(g, 0.0) for g in {g >> (64 - toxicity.BITS) for g in seen}) + m.offset)
        assert abs(r["score"] - want) < 1e-6


def test_counterfactuals_exist_in_the_labelled_texts(spark):
    """The penalty has sentences to work on, and a term and its swap end closer together with it than without."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts, y, share = quality.sampled(docs.select("doc_id", "text"), labels.where("toxic in (0, 1)"), "doc_id", "text", "toxic", 3000)
    pairs = toxicity.changes(texts)
    assert sum(n for *_, n in pairs) > 100
    gaps = []
    for strength in (0.0, 1.0):
        m = toxicity.train(texts, y, share, counterfactual=strength)
        gaps.append(sum(n * abs(sum(m.weight[f] for f in gone) - sum(m.weight[f] for f in come)) for gone, come, n in pairs))
    assert gaps[1] < gaps[0]
    kinds = {"he": [("he", "she")], "she": [("he", "she")]}
    assert toxicity.counterfactuals("he said she left", kinds, re.compile(r"\b(?:he|she)\b")) == ["she said he left"]


def test_tied_and_contradictory_labels(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(0, 1, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    for model, lower in ((quality.fit(docs, labels), False), (toxicity.fit(docs, labels), True)):
        got = {r["score"] for r in quality.score(docs, model, lower=lower).collect()}
        assert len(got) == 1 and 0.3 < next(iter(got)) < 0.7


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([(f"d{i}", "good text " * 3 if i % 2 else "### !!!") for i in range(40)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)], "doc_id string, quality int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert all((r["score"] > 0.5) == (int(r["doc_id"][1:]) % 2 == 1) for r in rows)


def test_held_out_is_never_null(spark, tmp_path):
    spark.createDataFrame([(None, "the cat sat", "en"), (1, "der hund", "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for op in (language.op1, quality.op4, toxicity.op6):
        assert {r["held_out"] for r in op(spark, str(tmp_path)).collect()} <= {True, False}


def test_long_documents_are_hashed_in_parts(monkeypatch):
    doc = np.frombuffer((b"some words and " + b"x" * 50 + b" more, ") * 40, np.uint8)
    whole = kernel.words(doc)
    monkeypatch.setattr(kernel, "PART", 64)
    assert (kernel.words(doc) == whole).all() and set(kernel.words(doc, (4, 6)).tolist()) == set(kernel._words(doc, (4, 6)).tolist())
