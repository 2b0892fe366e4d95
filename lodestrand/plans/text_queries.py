"""Queries of the scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.sources.tables import table


def _flows(spark: SparkSession, d: str) -> DataFrame:
    """One row a workflow."""
    return table(spark, d, "workflow_instances").select("workflow_id", "query", "agent_planning", "search_agent_planning").groupBy("workflow_id").agg(
        F.min("query").alias("query"), F.min("agent_planning").alias("pred"), F.min("search_agent_planning").alias("gold")
    )


def f1_normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d).select("workflow_id", X.normalize_answer(F.col("pred")).alias("answer"))


def f2_token_f1(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d).select("workflow_id", F.round(X.token_f1(F.col("pred"), F.col("gold")), 6).alias("f1"))


def f3_set_f1(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d).select("workflow_id", F.round(X.set_f1(F.col("pred"), F.col("gold")), 6).alias("f1"))


def f4_matches(spark: SparkSession, d: str) -> DataFrame:
    p, g = F.col("pred"), F.col("gold")
    return _flows(spark, d).select("workflow_id", X.exact_match(p, g).alias("em"), X.substring_match(p, g).alias("sub_em"))


def f5_max_over_golds(spark: SparkSession, d: str) -> DataFrame:
    golds = F.split("gold", " -> ")
    return _flows(spark, d).select("workflow_id", F.array_max(F.transform(golds, lambda g: X.substring_match(F.col("pred"), g))).alias("best"))


def f6_parse_output(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "inference_records").groupBy("idx").agg(F.min("model_output").alias("o")).select("idx", X.parse_output(F.col("o")).alias("parsed"))


def f14_standardize_string(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d).select("workflow_id", X.standardize_string(F.col("query")).alias("std"))


def f26_token_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n"))


def f27_estimate_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("n"))


def f28_truncate_head_tail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.truncate_head_tail(F.col("text"), 400)).alias("h"))


def f30_signature(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.signature(F.col("source")).alias("sha"), F.md5("text").alias("md5"))


def f31_name_to_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "difficulty_tiers").select(X.name_to_key(F.col("context_category")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def f34_last_user_message(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "inference_records").groupBy("idx").agg(F.min(F.md5(F.coalesce(X.last_user_message(F.col("messages")), F.lit("")))).alias("h"))
    return first


def f41_valid_keys(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "memory_bank").select(F.explode("tags").alias("tag"))
    return tags.groupBy("tag").agg(F.max(X.is_valid_key(F.col("tag"))).alias("ok"))


def f42_is_english(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(X.is_english(F.col("text"))).alias("english"), F.count("*").alias("n"))


def f44_rubrics_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "inference_records").groupBy("idx").agg(F.min(X.rubrics_text(F.col("rubrics"))).alias("rubrics"))


def f47_char_similarity(spark: SparkSession, d: str) -> DataFrame:
    p, g = F.col("pred"), F.col("gold")
    return _flows(spark, d).filter(p.isNotNull() & g.isNotNull()).select("workflow_id", F.round(X.char_dice(p, g), 6).alias("dice"), F.round(X.jaccard(X.bigrams(p), X.bigrams(g)), 6).alias("bigram"))


def pred15_min_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memory_bank").filter(~X.too_short(F.col("content"))).select("memory_id").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        f1_normalize_answer, f2_token_f1, f3_set_f1, f4_matches, f5_max_over_golds, f6_parse_output, f14_standardize_string, f26_token_count, f27_estimate_tokens,
        f28_truncate_head_tail, f30_signature, f31_name_to_key, f34_last_user_message, f41_valid_keys, f42_is_english, f44_rubrics_text, f47_char_similarity, pred15_min_length,
    )
}

_FLOWS = "flows AS (SELECT workflow_id, min(query) AS query, min(agent_planning) AS pred, min(search_agent_planning) AS gold FROM workflow_instances GROUP BY 1)"
_PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def _tok(c: str) -> str:
    return f"list_filter(string_split_regex(coalesce({c}, ''), '\\s+'), lambda w: w <> '')"


def _norm(c: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(translate(lower({c}), {_PUNCT}, ''), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


_COMMON = "coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda y: y = t))))), 0)"
_NORMED = f"WITH {_FLOWS}, n AS (SELECT workflow_id, CASE WHEN pred IS NULL THEN NULL ELSE {_norm('pred')} END AS p, CASE WHEN gold IS NULL THEN NULL ELSE {_norm('gold')} END AS g FROM flows)"
SQL = {
    "f1_normalize_answer": f"WITH {_FLOWS} SELECT workflow_id, {_norm('coalesce(pred, {q})'.format(q=chr(39) * 2))} AS answer FROM flows",
    "f2_token_f1": f"""WITH {_FLOWS}, n AS (SELECT workflow_id, {_norm("coalesce(pred, '')")} AS p, {_norm("coalesce(gold, '')")} AS g FROM flows),
        t AS (SELECT workflow_id, p, g, {_tok('p')} AS a, {_tok('g')} AS b FROM n), c AS (SELECT *, {_COMMON} AS k FROM t)
        SELECT workflow_id, round(CASE WHEN (p IN ('yes','no','noanswer') OR g IN ('yes','no','noanswer')) AND p <> g THEN 0 WHEN k > 0 THEN 2.0 * k / (len(a) + len(b)) ELSE 0 END::DOUBLE, 6) AS f1 FROM c""",
    "f3_set_f1": f"""WITH {_FLOWS}, t AS (SELECT workflow_id, list_distinct({_tok('lower(pred)')}) AS a, list_distinct({_tok('lower(gold)')}) AS b FROM flows),
        c AS (SELECT *, len(list_intersect(a, b)) AS k FROM t) SELECT workflow_id, round(CASE WHEN k > 0 THEN 2.0 * k / (len(a) + len(b)) ELSE 0 END::DOUBLE, 6) AS f1 FROM c""",
    "f4_matches": f"""WITH {_FLOWS}, n AS (SELECT workflow_id, {_norm("coalesce(pred, '')")} AS p, {_norm("coalesce(gold, '')")} AS g FROM flows) SELECT workflow_id, (p = g)::INTEGER AS em, contains(p, g)::INTEGER AS sub_em FROM n""",
    "f6_parse_output": """WITH o AS (SELECT idx, min(model_output) AS o FROM inference_records GROUP BY 1)
        SELECT idx, trim(regexp_replace(trim(CASE WHEN regexp_matches(o, '(?i)answer:') THEN regexp_extract(o, '(?i)answer:([^\\n]*)', 1) ELSE string_split(o, chr(10))[1] END, ' '), '(?i)^answer:', ''), ' ') AS parsed FROM o""",
    "f5_max_over_golds": f"""WITH {_FLOWS}, g AS (SELECT workflow_id, pred, unnest(string_split(gold, ' -> ')) AS g FROM flows), m AS (SELECT workflow_id, max(contains({_norm("coalesce(pred, '')")}, {_norm('g')})::INTEGER) AS best FROM g GROUP BY 1)
        SELECT workflow_id, best FROM flows LEFT JOIN m USING (workflow_id)""",
    "f27_estimate_tokens": """SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, floor(1.5::DOUBLE * c + 1.33::DOUBLE * w + 0.5::DOUBLE * (length(text) - c))) END::BIGINT AS n FROM (
        SELECT doc_id, text, length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')) AS c, len(list_filter(string_split_regex(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda w: regexp_matches(w, '\\p{L}') AND NOT regexp_matches(w, '[一-鿿]'))) AS w FROM documents)""",
    "f42_is_english": "SELECT lang, count(*) FILTER (WHERE coalesce(regexp_full_match(text, '[\\x00-\\x7F]*'), false)) AS english, count(*) AS n FROM documents GROUP BY 1",
    "pred15_min_length": f"""SELECT DISTINCT memory_id FROM memory_bank WHERE content IS NOT NULL AND CASE WHEN regexp_full_match(content, '[\\x00-\\x7F]*') THEN len({_tok('content')}) ELSE length(content) END >= 20""",
    "f14_standardize_string": f"WITH {_FLOWS} SELECT workflow_id, replace(lower(regexp_replace(query, '[ ,./\\-_*^]', '', 'g')), chr(39), '\"') AS std FROM flows",
    "f26_token_count": "SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> ''))::BIGINT AS n FROM documents",
    "f28_truncate_head_tail": "SELECT doc_id, md5(CASE WHEN length(text) <= 400 THEN text ELSE text[1:200] || chr(10) || '...' || chr(10) || text[-200:] END) AS h FROM documents",
    "f30_signature": "SELECT doc_id, sha256(lower(source)) AS sha, md5(text) AS md5 FROM documents",
    "f31_name_to_key": "SELECT lower(regexp_replace(trim(regexp_replace(context_category, '[^A-Za-z0-9_一-鿿 ]', '', 'g'), ' '), ' +', '_', 'g')) AS key, count(*) AS n FROM difficulty_tiers GROUP BY 1",
    "f34_last_user_message": "SELECT idx, min(md5(coalesce(list_filter(messages, lambda m: m.role = 'user')[-1].content, ''))) AS h FROM inference_records GROUP BY 1",
    "f41_valid_keys": "SELECT tag, bool_or(coalesce(regexp_full_match(tag, '[a-z][a-z0-9]*(_[a-z0-9]+)*'), false)) AS ok FROM (SELECT unnest(tags) AS tag FROM memory_bank) GROUP BY 1",
    "f44_rubrics_text": "SELECT idx, min(array_to_string(list_transform(rubrics, lambda x, i: i || '. ' || coalesce(x, '')), chr(10))) AS rubrics FROM inference_records GROUP BY 1",
    "f47_char_similarity": f"""WITH {_FLOWS}, t AS (SELECT workflow_id, list_distinct(string_split(pred, '')) AS a, list_distinct(string_split(gold, '')) AS b,
        list_distinct(list_transform(range(1, length(pred)::BIGINT), lambda i: substr(pred, i, 2))) AS x, list_distinct(list_transform(range(1, length(gold)::BIGINT), lambda i: substr(gold, i, 2))) AS y FROM flows WHERE pred IS NOT NULL AND gold IS NOT NULL)
        SELECT workflow_id, round(coalesce(2.0 * len(list_intersect(a, b)) / nullif(len(a) + len(b), 0), 0)::DOUBLE, 6) AS dice,
        round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0)::DOUBLE, 6) AS bigram FROM t""",
}
