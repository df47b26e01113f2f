"""Preference formatting: one prompt, two masked completions (operator 8).

Of a chosen and a rejected conversation the longest common prefix of turns is rendered
once, as the prompt; what remains of each is a completion. Only what the assistant says
is trained on: the masks list its spans in code points of prompt plus completion.

Edge cases: turns are ordered by number, then role, then text, so repeated numbers have a
defined order; a null role or text is empty; rows with a null pair or turn are left out;
equal conversations give empty completions; a conversation without turns on one side
gives no row; completions without an assistant's turn have an empty mask, and
``trainable`` is false then; extra columns are ignored; an empty table gives an empty
result. A conversation is one row of the output and is gathered as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: A rendered turn is OPEN, role, AFTER, text, CLOSE.
OPEN, AFTER, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turns(df: DataFrame, name: str) -> DataFrame:
    rows = df.select("pair_id", F.struct(F.col("turn").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    rows = rows.where("pair_id is not null and t.n is not null")
    return rows.groupBy("pair_id").agg(F.array_sort(F.collect_list("t")).alias(name))


def _render(turns) -> F.Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(AFTER), t["text"], F.lit(CLOSE))), "")


def _mask(turns, before) -> F.Column:
    """The spans of the assistant's text and end mark, as start:end joined by commas."""
    start = F.struct(before.cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, t):
        body = acc["at"] + F.length(t["role"]) + len(OPEN) + len(AFTER)
        end = body + F.length(t["text"]) + len(CLOSE)
        span = F.concat_ws(":", body.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Of two tables (pair_id, turn, role, text): a row for each pair that both have."""
    return formatted(_turns(chosen, "c").join(_turns(rejected, "r"), "pair_id"))


def formatted(both: DataFrame) -> DataFrame:
    """The same of the turns of both conversations, in order, as arrays: (pair_id, c, r)."""
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    both = both.withColumn("k", F.when(first > 0, first - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda a: F.slice(a, F.col("k") + 1, F.greatest(F.size(a) - F.col("k"), F.lit(0)))
    both = both.select("pair_id", "k", _render(F.slice("c", 1, F.col("k"))).alias("prompt"), rest("c").alias("c"), rest("r").alias("r"))
    out = both.select(
        "pair_id", F.col("k").cast("long").alias("prompt_turns"), "prompt", _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"),
        _mask(F.col("c"), F.length("prompt")).alias("chosen_mask"), _mask(F.col("r"), F.length("prompt")).alias("rejected_mask"),
    )
    return out.withColumn("trainable", (F.col("chosen_mask") != "") & (F.col("rejected_mask") != ""))


def _answers(rows: DataFrame) -> DataFrame:
    """Of each conversation with an answer: conv_id, the turns before its last answer, its turn (end) and text (answer)."""
    turns = _turns(rows.withColumnRenamed("conv_id", "pair_id"), "t").withColumnRenamed("pair_id", "conv_id")
    said = F.transform(F.filter("t", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["n"].alias("n"), t["text"].alias("text")))
    turns = turns.withColumn("last", F.array_max(said)).where("last is not null")
    return turns.select("conv_id", F.filter("t", lambda t: t["n"] < F.col("last.n")).alias("head"), F.col("last.n").alias("end"), F.col("last.text").alias("answer"))


def _last(rows: DataFrame) -> DataFrame:
    """(conv_id, answer), without gathering turns."""
    said = rows.where("role = 'assistant' and conv_id is not null and turn is not null")
    return said.groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("m")).select("conv_id", F.col("m.text").alias("answer"))


def _with_other(pairs: DataFrame) -> DataFrame:
    """Formats (conv_id, head, end, answer, other)."""
    side = lambda c: F.concat("head", F.array(F.struct(F.col("end").alias("n"), F.lit("assistant").alias("role"), F.col(c).alias("text"))))
    return formatted(pairs.select(F.col("conv_id").alias("pair_id"), side("answer").alias("c"), side("other").alias("r")))


def op8(spark, sf_dir: str) -> DataFrame:
    """Each conversation up to its last answer is chosen; rejected is the same with the last
    answer of the conversation whose id differs in the lowest bit. Conversations without an
    answer, and those whose partner is absent or has none, give no row: ``op8_all`` has the latter."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    partner = _last(rows).select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("answer").alias("other"))
    return _with_other(_answers(rows).join(partner, "conv_id"))


def neighbour_ids(ids: DataFrame) -> DataFrame:
    """Each conv_id with the next one as other_id; the last takes the one before it.

    The ids are dealt out by range, so no task orders all of them; the driver has two ids a
    range. An id without any other gives no row.
    """
    ranged = written(ids.select("conv_id").repartitionByRange("conv_id").withColumn("part", F.spark_partition_id()), "ranges")
    edges = ranged.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last")).orderBy("part").collect()
    around = [(e["part"], edges[i + 1]["first"] if i + 1 < len(edges) else None, edges[i - 1]["last"] if i else None) for i, e in enumerate(edges)]
    around = ids.sparkSession.createDataFrame(around, "part int, after long, before long")
    order = Window.partitionBy("part").orderBy("conv_id")
    inside = ranged.withColumns({"next": F.lead("conv_id").over(order), "prev": F.lag("conv_id").over(order)})
    other = F.coalesce("next", "after", "prev", "before")
    return inside.join(F.broadcast(around), "part").select("conv_id", other.alias("other_id")).where("other_id is not null")


def op8_all(spark, sf_dir: str) -> DataFrame:
    """As ``op8``, with the answer of the next conversation that has one (for the last, of the one
    before), so every conversation with an answer gives a row whatever its id is. One without an
    answer has nothing to choose and gives none, nor does the only one that has an answer."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    last = _last(rows)
    partner = neighbour_ids(last).join(last.select(F.col("conv_id").alias("other_id"), F.col("answer").alias("other")), "other_id").drop("other_id")
    return _with_other(_answers(rows).join(partner, "conv_id"))


ORACLE = """
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), last_ AS (
  SELECT conv_id, turn AS fin, text AS answer FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS rn
    FROM rows_ WHERE role = 'assistant') WHERE rn = 1
), pairs AS (
  SELECT a.conv_id, a.fin, a.answer, b.answer AS other
  FROM last_ a JOIN last_ b ON b.conv_id = xor(a.conv_id, CAST(1 AS BIGINT))
), head AS (
  SELECT r.conv_id AS pair_id, r.turn, r.role, r.text FROM rows_ r JOIN pairs p USING (conv_id) WHERE r.turn < p.fin
), c AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS pos
  FROM (SELECT * FROM head UNION ALL SELECT conv_id, fin, 'assistant', answer FROM pairs)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS pos
  FROM (SELECT * FROM head UNION ALL SELECT conv_id, fin, 'assistant', other FROM pairs)
), k AS (
  SELECT pair_id, count(*) FILTER (WHERE pos < bad) AS k FROM (
    SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.pos, r.pos) AS pos,
      coalesce(min(CASE WHEN c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text THEN coalesce(c.pos, r.pos) END)
        OVER (PARTITION BY coalesce(c.pair_id, r.pair_id)), 1000000000) AS bad
    FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.pos = r.pos)
  GROUP BY pair_id
), both_ AS (
  SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r
), drawn AS (
  SELECT side, b.pair_id, pos, k.k, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line,
    length(text) + 8 AS body
  FROM both_ b JOIN k ON k.pair_id = b.pair_id
), placed AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY side, pair_id ORDER BY pos) AS fin FROM drawn
)
SELECT pair_id, CAST(any_value(k) AS BIGINT) AS prompt_turns,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 'c' AND pos <= k), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 'c' AND pos > k), '') AS chosen,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 'r' AND pos > k), '') AS rejected,
  coalesce(string_agg((fin - body) || ':' || fin, ',' ORDER BY pos) FILTER (WHERE side = 'c' AND pos > k AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((fin - body) || ':' || fin, ',' ORDER BY pos) FILTER (WHERE side = 'r' AND pos > k AND role = 'assistant'), '') AS rejected_mask,
  bool_or(side = 'c' AND pos > k AND role = 'assistant') AND bool_or(side = 'r' AND pos > k AND role = 'assistant') AS trainable
FROM placed GROUP BY pair_id
"""

#: The same with the next answer in place of the partner's.
ORACLE_ALL = ORACLE.replace(
    """SELECT a.conv_id, a.fin, a.answer, b.answer AS other
  FROM last_ a JOIN last_ b ON b.conv_id = xor(a.conv_id, CAST(1 AS BIGINT))""",
    """SELECT conv_id, fin, answer, coalesce(lead(answer) OVER (ORDER BY conv_id), lag(answer) OVER (ORDER BY conv_id)) AS other
  FROM last_ QUALIFY other IS NOT NULL""",
)
