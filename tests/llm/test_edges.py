"""Very long texts, empty tables and rows without an id, through the queries and stages themselves."""

import random

import corpus_pipeline
from torusflow.llm import language, preference, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, n, words):
    return " ".join(rnd.choices(words, k=n))


def corpus(spark, place):
    rnd = random.Random(5)
    tongues = {"en": ["the", "river", "and", "house", "with", "under"], "de": ["der", "fluss", "und", "haus", "mit", "unter"]}
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "de"
        rows.append((i, prose(rnd, 30, tongues[lang]) + (" idiots" if i % 5 == 0 else ""), lang, "web", 0))
    long = prose(rnd, 600_000, tongues["en"])
    rows += [(1000, long, None, "web", len(long)), (1001, long, None, "web", len(long)), (1002, "", None, "web", 0), (1003, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{place}/documents.parquet")
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return long


def test_texts_of_megabytes_through_the_classifiers(spark, tmp_path):
    long = corpus(spark, tmp_path)
    assert len(long) > 2_500_000
    found = {r["doc_id"]: r for r in language.op1(spark, str(tmp_path)).collect()}
    assert len(found) == 84 and found[1000]["lang_pred"] == "en" and found[1003]["lang_pred"] == found[1002]["lang_pred"] == "und"
    for op in (quality.op4, toxicity.op6):
        got = {r["doc_id"]: r for r in op(spark, str(tmp_path)).collect()}
        assert len(got) == 84 and all(0 <= r["score"] <= 1 for r in got.values())
        assert got[1000]["score"] == got[1001]["score"] and got[1002]["score"] == got[1003]["score"]


def test_preferences_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for op in (preference.op8, preference.op8_all):
        assert op(spark, str(tmp_path)).collect() == []


def test_stages_take_long_texts_and_rows_without_an_id(spark, tmp_path):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    long = prose(rnd, 300_000, words)
    near = long.replace(" w17 ", " other ", 3)
    short = [prose(rnd, 40, words) for _ in range(5)]
    mail = "write to someone@example.org please"
    rows = [(None, long, "en", "a", 1), (4, near, "en", "a", 1), (None, short[0], "en", "a", 1), (7, short[1], None, None, 1), (8, short[2], "en", "a", None), (None, short[0], "en", "a", 1), (9, f"{long} {mail}", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["text"]) > 1000) for r in kept) == [(False, 4, True), (False, 7, False), (False, 8, False), (True, 0, False)]
    clean = {r["doc_id"]: r for r in corpus_pipeline.personal_data(spark, docs.where("doc_id is not null"), str(tmp_path)).collect()}
    assert clean[9]["text"].endswith("write to <EMAIL> please") and clean[9]["n_chars"] == len(clean[9]["text"]) and clean[4]["text"] == near
    done = corpus_pipeline.tokens(spark, spark.createDataFrame([(None, "a b", "en", "a", 3), (None, None, None, None, None), (5, long[:200_000], "en", "a", 1)], DOCS), str(tmp_path)).collect()
    assert len(done) == 3 and all(r["round_trip"] for r in done) and sum(r["doc_id"] is None for r in done) == 2
