"""The corpus pipeline: language ID, near-dedup, decontamination, PII, tokenisation.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; ``run`` writes
each stage's rows as Parquet in the shared folder and reads them again as the next one's.

A row is known by its id and its text together: rows that share an id but not a text, and
rows without an id, are documents of their own in every stage. Columns beyond those of
``documents`` are dropped at the first stage that meets them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torusflow.llm import decontaminate, language, neardup, pieces, pii
from torusflow.llm.sample import held_out
from torusflow.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without a letter and those whose two nearest languages are as good as equal.

    Null and empty texts have no letter and go, texts of any length are read whole; repeated
    rows are decided alike; rows with a null id or lang are decided by their text; without
    any row that has a lang nothing can be told and all go; an empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    model = language.fit(docs.where(~held_out("doc_id", 3, 1)))
    kept = language.predict(docs, model, keep=("lang", "source", "n_chars"), with_text=True, ambiguous_below=0.02)
    kept = kept.where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous"))
    return kept.select("doc_id", F.col("__text").alias("text"), "lang", "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near copies one row: that of the smallest id, then of the smallest hash of its text.

    A row without an id comes after all with one. Of rows that repeat both id and text one
    stays. Texts without a word (null, empty, marks only) are near to nothing; each such row
    stays unless it repeats another. An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(neardup.NO_ID)).alias("k"), F.xxhash64("text").alias("x")]
    classes = neardup.classes(docs).select(F.coalesce("id", F.lit(neardup.NO_ID)).alias("k"), "x", F.coalesce("class_id", F.lit(neardup.NO_ID)).alias("ck"), "class_x")
    rows = written(classes.groupBy("k", "x").agg(F.min(F.struct("ck", "class_x")).alias("c"), F.count("*").alias("n")), "classes")
    others = rows.where("k <> c.ck or x <> c.class_x").select("k", "x")
    kept = docs.select("*", *key).join(others, ["k", "x"], "left_anti")
    again = rows.where("n > 1 and k = c.ck and x = c.class_x").select("k", "x")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    once = kept.join(again, ["k", "x"], "left_semi").dropDuplicates(["k", "x"])
    return kept.join(again, ["k", "x"], "left_anti").unionByName(once).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a passage of the benchmark.

    A row is judged by its own text, so a clean text stays whatever else its id has, and a
    null id is no hindrance; null and empty texts are clean; repeated rows are judged alike;
    texts are read whole; without benchmark items all stay; an empty table stays empty.
    """
    docs = docs.select(*COLUMNS).withColumn("key", F.xxhash64("doc_id", "text"))
    found = decontaminate.matches(docs.select(F.col("key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts kinds in place of personal data; n_chars follows the text. All rows stay.

    A null text stays null and its n_chars becomes null; repeated rows and null ids are
    treated like any others; texts are read whole; an empty table stays empty.
    """
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left; a text that didn't come back the same would show in round_trip.

    A null text is the empty one; repeated rows and null ids give a row each; texts are read
    whole; an empty table gives an empty result.
    """
    rows = docs.withColumn("text_sha256", F.sha2(F.coalesce(F.replace("text", F.lit("▁"), F.lit(" ")), F.lit("")), 256))
    done = pieces.encode(rows, pieces.model_path(), keep=("lang", "source", "text_sha256"))
    return done.withColumn("round_trip", F.col("decoded_sha256") == F.col("text_sha256")).drop("text_sha256")


STAGES = [
    ("language ID", language_id),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("SentencePiece", tokens),
]

#: SQL can't express language ID or the encoder; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
