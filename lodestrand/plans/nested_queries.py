"""Queries over raw tool results: their flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators.nested import flat_tables
from lodestrand.sources.tables import table

KEEP = frozenset(["metadata"])


def _tables(spark: SparkSession, d: str, *only: str) -> dict[str, DataFrame]:
    return flat_tables(table(spark, d, "tool_results"), keep=KEEP, only=frozenset(only) or None)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every non-null step of every turn, through the turn and step tables and the link between them."""
    t = _tables(spark, d, "per_turn_totals", "input_tokens_per_step")
    turns = t["per_turn_totals"].select(F.col("key").alias("turn_key"), F.col("pos").alias("turn_pos"))
    steps = t["input_tokens_per_step"].filter(F.col("value").isNotNull())
    found = steps.join(turns, steps["parent_key"] == turns["turn_key"], "left")
    return found.select(
        F.col("record_key").alias("id"), F.coalesce("turn_pos", F.lit(0)).cast("int").alias("turn_no"), F.col("pos").cast("int").alias("step_no")
    ).distinct()


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d, "record")["record"]
    return t.select(F.col("key").alias("id"), "category", F.col("num_turns").cast("long").alias("num_turns"), F.col("sample_totals_total_tokens").cast("long").alias("total_tokens"), F.col("metrics_success_rate").cast("long").alias("success_rate"))


def p5_metadata(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d, "metadata")["metadata"]
    return t.select("key", F.col("parent_key").alias("id"), "task_id", "context_id", "context_category", "sub_category")


def p5_questions(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d, "questions")["questions"]
    return t.select(F.col("record_key").alias("id"), "key", "parent_key", "pos", "question_id", "question_type", "question_date")


def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns with their keys and parents; measures as numbers, as records differ in their kind."""
    t = _tables(spark, d, "per_turn_totals")["per_turn_totals"]
    number = lambda c: F.col(c).cast("string").try_cast("double").alias(c)
    return t.select(F.col("record_key").alias("id"), "key", "parent_table", "parent_key", "pos", *map(number, ("step_count", "latency_s", "input_tokens", "output_tokens")))


def p5_steps(spark: SparkSession, d: str) -> DataFrame:
    """The steps with their keys and parents; values as text, as records differ in their kind."""
    t = _tables(spark, d, "input_tokens_per_step")["input_tokens_per_step"]
    return t.select("record_key", "key", "parent_table", "parent_key", "pos", F.col("value").cast("string").alias("value"))


def p5_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold no record with an id."""
    return _tables(spark, d)["_rejected"].select("line_no", F.md5("raw").alias("digest"))


QUERIES = {f.__name__: f for f in (p5_found, p5_records, p5_metadata, p5_questions, p5_turns, p5_steps, p5_rejected)}

_READ = """
WITH lines AS (
  SELECT line_no, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM tool_results
), recs AS (
  SELECT line_no, CASE WHEN json_extract_string(j, '$.id') IS NULL AND json_type(j, '$.record') = 'OBJECT' THEN json_extract(j, '$.record') ELSE j END AS r
  FROM lines WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'
), firsts AS (
  SELECT json_extract_string(r, '$.id') AS id, arg_min(r, line_no) AS r
  FROM recs WHERE json_extract_string(r, '$.id') IS NOT NULL GROUP BY 1
), metas AS (
  SELECT id, r, CASE WHEN json_type(r, '$.metadata') = 'VARCHAR' THEN json_extract_string(r, '$.metadata')::JSON ELSE json_extract(r, '$.metadata') END AS m FROM firsts
)
"""
STEPS = (
    _READ
    + """, held AS (
  SELECT id, unnest([id, id || '/metadata:0']) AS held, unnest([json_extract(r, '$.per_turn_totals'), json_extract(m, '$.per_turn_totals')]) AS t FROM metas
), shaped AS (
  SELECT id, held, CASE WHEN json_type(t) = 'VARCHAR' AND json_valid(json_extract_string(t, '$')) THEN json_extract_string(t, '$')::JSON ELSE t END AS t FROM held WHERE t IS NOT NULL
), turns AS (
  SELECT id, held, i AS turn_no, json_extract(t, '$[' || i || ']') AS turn FROM (SELECT id, held, t, unnest(range(json_array_length(t)::BIGINT)) AS i FROM shaped WHERE json_type(t) = 'ARRAY')
  UNION ALL
  SELECT id, held, k::BIGINT, json_extract(t, '$."' || k || '"') FROM (SELECT id, held, t, unnest(json_keys(t)) AS k FROM shaped WHERE json_type(t) = 'OBJECT') WHERE regexp_full_match(k, '[0-9]+')
  UNION ALL
  SELECT id, held, 0, t FROM shaped WHERE json_type(t) = 'OBJECT' AND NOT regexp_full_match(json_keys(t)[1], '[0-9]+')
), steps AS (
  SELECT id, held, turn_no, json_extract(turn, '$.input_tokens_per_step') AS s FROM turns WHERE json_type(turn) = 'OBJECT'
), decoded AS (
  SELECT id, held, turn_no, CASE WHEN json_type(s) = 'VARCHAR' AND json_extract_string(s, '$') LIKE '[%' THEN json_extract_string(s, '$')::JSON ELSE s END AS s FROM steps
), found AS (
  SELECT DISTINCT id, held, turn_no, i, x FROM (
  SELECT id, held, turn_no, i, json_extract(s, '$[' || i || ']') AS x FROM (SELECT id, held, turn_no, s, unnest(range(json_array_length(s)::BIGINT)) AS i FROM decoded WHERE json_type(s) = 'ARRAY')
  UNION ALL SELECT id, held, turn_no, 0, s FROM decoded WHERE json_type(s) NOT IN ('ARRAY', 'NULL')
) WHERE json_type(x) <> 'NULL')"""
)
SQL = {
    "p5_records": _READ
    + """SELECT id, json_extract_string(r, '$.category') AS category, json_extract_string(r, '$.num_turns')::BIGINT AS num_turns,
       json_extract_string(r, '$.sample_totals.total_tokens')::BIGINT AS total_tokens, json_extract_string(r, '$.metrics.success_rate')::BIGINT AS success_rate FROM firsts""",
    "p5_metadata": _READ
    + """SELECT id || '/metadata:0' AS key, id, json_extract_string(m, '$.task_id') AS task_id, json_extract_string(m, '$.context_id') AS context_id,
       json_extract_string(m, '$.context_category') AS context_category, json_extract_string(m, '$.sub_category') AS sub_category FROM metas WHERE json_type(m) = 'OBJECT'""",
    "p5_questions": _READ
    + """SELECT id, id || '/metadata:0' AS parent_key, id || '/metadata:0/questions:' || i AS key, i::INTEGER AS pos, json_extract_string(q, '$.question_id') AS question_id, json_extract_string(q, '$.question_type') AS question_type,
       json_extract_string(q, '$.question_date') AS question_date
       FROM (SELECT id, unnest(range(json_array_length(m, '$.questions')::BIGINT)) AS i, m FROM metas WHERE json_type(m, '$.questions') = 'ARRAY'),
       LATERAL (SELECT json_extract(m, '$.questions[' || i || ']') AS q) WHERE json_type(q) <> 'NULL'""",
    "p5_found": STEPS + " SELECT DISTINCT id, turn_no::INTEGER AS turn_no, i::INTEGER AS step_no FROM found",
    "p5_steps": STEPS + " SELECT id AS record_key, held || '/per_turn_totals:' || turn_no || '/input_tokens_per_step:' || i AS key, 'per_turn_totals' AS parent_table, held || '/per_turn_totals:' || turn_no AS parent_key, i::INTEGER AS pos, json_extract_string(x, '$') AS value FROM found",
    "p5_turns": STEPS + """ SELECT id, held || '/per_turn_totals:' || turn_no AS key, CASE WHEN held = id THEN 'record' ELSE 'metadata' END AS parent_table, held AS parent_key, turn_no::INTEGER AS pos, try_cast(json_extract_string(turn, '$.step_count') AS DOUBLE) AS step_count,
        try_cast(json_extract_string(turn, '$.latency_s') AS DOUBLE) AS latency_s, try_cast(json_extract_string(turn, '$.input_tokens') AS DOUBLE) AS input_tokens, try_cast(json_extract_string(turn, '$.output_tokens') AS DOUBLE) AS output_tokens FROM turns WHERE turn IS NOT NULL AND json_type(turn) <> 'NULL'""",
    "p5_rejected": "WITH l AS (SELECT line_no, raw, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM tool_results) SELECT line_no, md5(raw) AS digest FROM l WHERE j IS NULL OR json_type(j) <> 'OBJECT' OR coalesce(json_extract_string(j, '$.id'), CASE WHEN json_type(j, '$.record') = 'OBJECT' THEN json_extract_string(j, '$.record.id') END) IS NULL",
}
