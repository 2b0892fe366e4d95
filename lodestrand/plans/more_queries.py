"""Queries of streams, sources, relational listings, and scalar scores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions import scores as S
from lodestrand.functions import text as X
from lodestrand.operators import filters
from lodestrand.sources import files
from lodestrand.sources.tables import table
from lodestrand.streaming import updates


def x1_stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts by type, from the event files as a stream."""
    schema = table(spark, d, "events").schema
    stream = updates.file_stream(spark, d, schema, "events.parquet")
    return updates.drain(updates.windowed_counts(stream, "ts", ["event_type"], "1 day"), "complete")


def x2_stream_rows(spark: SparkSession, d: str) -> DataFrame:
    stream = updates.file_stream(spark, d, table(spark, d, "events").schema, "events.parquet")
    return updates.drain(stream.select("event_id", "user_id", F.when(F.col("event_type") == "error", "retry").otherwise("done").alias("outcome")))


def x6_quota(spark: SparkSession, d: str) -> DataFrame:
    return updates.quota(table(spark, d, "events"), "user_id", "event_id", 4).select("event_id")


def x9_time_range(spark: SparkSession, d: str) -> DataFrame:
    """The time-range read, over all users: from the first time on, up to but without the second."""
    ts = F.col("ts")
    return table(spark, d, "events").filter((ts >= F.to_timestamp(F.lit("2024-01-08"))) & (ts < F.to_timestamp(F.lit("2024-01-22")))).select("event_id", "user_id", "ts")


def x10_sessions(spark: SparkSession, d: str) -> DataFrame:
    return updates.sessions(table(spark, d, "events"), "user_id", "ts", "12 hours")


def s2_tolerant_lines(spark: SparkSession, d: str) -> DataFrame:
    ok = F.try_parse_json("raw").isNotNull()
    return table(spark, d, "tool_results").groupBy("source_file").agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))


def s7_filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive equality filters; s7_four_filters has all four, and the index."""
    docs = table(spark, d, "documents").filter((F.lower("lang") == "en") & (F.lower(F.trim("source")) == "rulebook"))
    return docs.select("doc_id")


def s9_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """The feature is a sample: 50 documents in the order of a seeded hash."""
    return table(spark, d, "documents").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))).limit(50).select("doc_id")


def s10_log_phases(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    rows = files.phases(e, "user_id", "event_id", "event_type", "signup", "purchase")
    return rows.groupBy("user_id", "phase").agg(F.count("*").alias("n"))


def k4_ranked(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.max(F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal"))).alias("best"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("best"), "s_nationkey")  # a small report
    return per.select(F.row_number().over(w).alias("rank"), "s_nationkey", F.when(F.col("best").isNull(), "N/A").otherwise(F.format_string("%.2f", "best")).alias("best"))


def k14_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    from lodestrand.operators.lifecycle import recover, soft_delete

    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "deleted").alias("status"), F.lit(None).cast("string").alias("record_id"))
    gone = soft_delete(c, F.col("c_custkey") % 6 == 0, "r1")
    return recover(soft_delete(gone, F.col("c_custkey") % 10 == 0, "r2"), "r2").groupBy("status", "record_id").agg(F.count("*").alias("n"))


def pred9_listing(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return rows.filter(F.col("c_name").ilike("%1%") & F.col("c_acctbal").between(0, 5000) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).orderBy("c_custkey").offset(5).limit(25).select("c_custkey", "n_name")


def pred11_access(spark: SparkSession, d: str) -> DataFrame:
    """Nations as readers of their customers. Rich customers are denied and poor ones allowed; nations of one kind may read
    all, of another nothing (each after such a rule of the other kind had its turn for some), of a third have denials only, of a fourth no rules."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("reader"), F.col("c_custkey").alias("id"), "c_acctbal")
    kind = F.col("reader") % 5
    some = c.filter((kind == 0) & (F.col("c_acctbal") < 5000) | kind.isin(0, 4) & (F.col("c_acctbal") > 4000))
    rules = some.select("reader", F.lit(9).alias("pos"), F.when(F.col("c_acctbal") > 4000, "deny").otherwise("allow").alias("effect"), "id")
    rules = rules.unionByName(some.filter("c_acctbal > 4000 and c_acctbal < 5000 and reader % 5 = 0").select("reader", F.lit(8).alias("pos"), F.lit("allow").alias("effect"), "id"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("reader"))
    whole = n.filter("reader % 5 in (1, 2)").select("reader", F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"))
    whole = whole.select("reader", "pos", F.when((F.col("reader") % 5 == 1) == (F.col("pos") == 1), "allow").otherwise("deny").alias("effect"), F.lit(None).cast("long").alias("id"))
    return filters.accessible(rules.unionByName(whole), c.select("reader", "id"))


def pred12_pattern_search(spark: SparkSession, d: str) -> DataFrame:
    hit = F.lit(False)
    for p in ("ledger", "kettle", "token"):
        hit = hit | F.col("text").contains(p)
    return table(spark, d, "documents").filter(hit & F.col("created_at").isNotNull()).orderBy(F.desc("created_at"), "doc_id").limit(40).select("doc_id")


def pred14_prefix_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_totals").filter(F.lower(F.left("context_id", F.lit(6))).isin("ctx-a1", "ctx-b3", "ctx-47")).select("sample_id").distinct()


def pred20_date_range(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.filter((F.col("o_orderdate") >= F.to_timestamp(F.lit("1995-01-01"))) & (F.col("o_orderdate") <= F.to_timestamp(F.lit("1995-03-31")))).select("o_orderkey")


def a13_run_stats(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sample_totals").dropDuplicates(["sample_id"])
    ok = F.col("error").isNull()
    level = F.coalesce("context_category", "memory_type", F.lit("unknown"))
    return s.groupBy(level.alias("level")).agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("errors"), F.sum("total_tokens").alias("tokens"))


def a15_trajectory_features(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "inference_records").groupBy("idx").agg(F.min_by("messages", "ingested_at").alias("m")).filter("m is not null")
    roles = F.transform("m", lambda x: x["role"])
    return r.select("idx", F.size("m").cast("long").alias("steps"), F.size(F.filter(roles, lambda x: x == "assistant")).cast("long").alias("assistant"), F.size(F.array_distinct(roles)).cast("long").alias("roles"))


def a32_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("large"))


def j3_optional_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("v"))
    return c.join(o, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count("v").alias("with_stats"), F.round(F.avg("v"), 4).alias("mean"))


def j10_categories(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_returnflag").distinct()
    p = table(spark, d, "part").join(pairs, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.groupBy("p_partkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"))


def u5_ordered_subsequence(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "workflow_instances").groupBy("workflow_id").agg(F.min("agent_planning").alias("p"))
    return w.filter("p is not null").select("workflow_id", S.ordered_subsequence(F.array(F.lit("the"), F.lit("->"), F.lit("the")), F.split("p", " ")).alias("ok"))


def u7_tag_jaccard(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "memory_bank").groupBy("memory_id").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"))
    a = b.agg(F.min_by("tags", "memory_id").alias("t"))
    return b.withColumn("t", a.scalar()).select("memory_id", F.round(X.jaccard(F.col("tags"), F.col("t")), 6).alias("jaccard"))


def t7_sorted_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(F.array_join(F.array_sort(F.split("text", "\n")), "\n")).alias("h"))


def t8_tail(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 1), F.lit(2)), "\n")).alias("h"))


def t10_two_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_size", "p_partkey").limit(15).select("p_partkey")


def m2_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(S.convert_length(F.col("p_size").cast("double"), "cm", "km"), 9).alias("km"))


def m5_time_decay(spark: SparkSession, d: str) -> DataFrame:
    from lodestrand.operators.lifecycle import time_decay

    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    b = table(spark, d, "memory_bank").groupBy("memory_id").agg(F.max("updated_at").alias("t"))
    return b.select("memory_id", F.round(time_decay(F.date_trunc("second", F.col("t").cast("timestamp")), now, 24.0 * 365), 6).alias("decay"))


def m10_normalised(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(S.l2_normalize(F.col("embedding"))[0], 5).alias("first"))


def m13_success_rate(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "memory_bank").groupBy("memory_id").agg(F.max("usage_count").alias("u"), F.max("success_count").alias("s"))
    return b.select("memory_id", F.round(S.success_rate(F.col("s"), F.col("u")), 6).alias("rate"))


def w6_context_delta(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    prev = F.lag("ctx").over(w)
    e = table(spark, d, "events").withColumn("ctx", F.concat_ws("/", "event_type", F.floor("value").cast("string")))
    return e.select("event_id", F.when(F.coalesce(F.col("ctx").startswith(prev), F.lit(False)), F.expr("substr(ctx, length(lag(ctx) over (partition by user_id order by event_id)) + 1)")).otherwise(F.col("ctx")).alias("delta"))


def d11_bounded_deque(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "memory_bank").filter(F.col("content").isNotNull() & ~F.lower(F.trim("content")).isin("", "none")).select("memory_id", "type", "created_at").distinct()
    w = Window.partitionBy("type").orderBy(F.desc("created_at"), F.desc("memory_id"))
    return b.withColumn("rn", F.row_number().over(w)).filter("rn <= 25").select("memory_id", "type")


def d12_history(spark: SparkSession, d: str) -> DataFrame:
    """The history of every user, in the order of the events."""
    kind = F.when(F.col("event_type") == "signup", "ADD").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return table(spark, d, "events").select("event_id", "user_id", kind.alias("event"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"))


def d18_dedup_status(spark: SparkSession, d: str) -> DataFrame:
    first = Window.partitionBy("source", F.md5("text")).orderBy("doc_id")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.when(F.row_number().over(first) == 1, "active").otherwise("duplicate").alias("status"))


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"[a-z]+\d+_", k)}

_SAM = "WITH sam AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at) AS rn FROM sample_totals) WHERE rn = 1)"
SQL = {
    "x1_stream_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "x2_stream_rows": "SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'retry' ELSE 'done' END AS outcome FROM events",
    "x6_quota": "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 4",
    "x10_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
        SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, k""",
    "s2_tolerant_lines": "SELECT source_file, count(*) FILTER (WHERE coalesce(json_valid(raw), false)) AS good, count(*) FILTER (WHERE NOT coalesce(json_valid(raw), false)) AS bad FROM tool_results GROUP BY 1",
    "s7_filtered_scan": "SELECT doc_id FROM documents WHERE lower(lang) = 'en' AND lower(trim(source, ' ')) = 'rulebook'",
    "s9_seeded_sample": "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id) LIMIT 50",
    "s10_log_phases": """WITH r AS (SELECT user_id, sum((event_type = 'signup')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS o, coalesce(sum((event_type = 'purchase')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM events)
        SELECT user_id, (CASE WHEN o > c THEN o ELSE 0 END)::BIGINT AS phase, count(*) AS n FROM r GROUP BY 1, 2""",
    "k4_ranked": "WITH p AS (SELECT s_nationkey, max(s_acctbal) FILTER (WHERE s_acctbal > 5000) AS best FROM supplier GROUP BY 1) SELECT row_number() OVER (ORDER BY best DESC NULLS LAST, s_nationkey)::INTEGER AS rank, s_nationkey, coalesce(printf('%.2f', best), 'N/A') AS best FROM p",
    "k14_soft_delete": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'deleted' END AS status FROM customer), a AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 AND status IS NULL THEN 'deleted' ELSE status END AS status, CASE WHEN c_custkey % 6 = 0 AND status IS NULL THEN 'r1' END AS record_id FROM c),
        b AS (SELECT CASE WHEN c_custkey % 10 = 0 AND status IS NULL THEN 'activated' ELSE status END AS status, record_id FROM a) SELECT status, record_id, count(*) AS n FROM b GROUP BY 1, 2""",
    "pred9_listing": "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_name ILIKE '%1%' AND c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_custkey LIMIT 25 OFFSET 5",
    "pred11_access": "SELECT c_nationkey AS reader, c_custkey AS id FROM customer WHERE c_nationkey % 5 IN (1, 3) OR (c_nationkey % 5 = 0 AND c_acctbal <= 4000)",
    "pred12_pattern_search": "SELECT doc_id FROM documents WHERE (contains(text, 'ledger') OR contains(text, 'kettle') OR contains(text, 'token')) AND created_at IS NOT NULL ORDER BY created_at DESC, doc_id LIMIT 40",
    "pred14_prefix_key": "SELECT DISTINCT sample_id FROM sample_totals WHERE lower(left(context_id, 6)) IN ('ctx-a1', 'ctx-b3', 'ctx-47')",
    "pred20_date_range": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-03-31'",
    "a13_run_stats": _SAM + " SELECT coalesce(context_category, memory_type, 'unknown') AS level, count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS success, count(*) FILTER (WHERE error IS NOT NULL) AS errors, sum(total_tokens)::BIGINT AS tokens FROM sam GROUP BY 1",
    "a15_trajectory_features": "WITH r AS (SELECT idx, arg_min(messages, ingested_at) AS m FROM inference_records GROUP BY 1) SELECT idx, len(m)::BIGINT AS steps, len(list_filter(m, lambda x: x.role = 'assistant'))::BIGINT AS assistant, len(list_distinct(list_transform(m, lambda x: x.role)))::BIGINT AS roles FROM r WHERE m IS NOT NULL",
    "a32_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS large FROM events GROUP BY 1",
    "j3_optional_stats": "SELECT c_mktsegment, count(*) AS n, count(v) AS with_stats, round(avg(v), 4) AS mean FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON c_custkey = o_custkey GROUP BY 1",
    "j10_categories": "SELECT p_partkey, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS flags FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1",
    "u5_ordered_subsequence": "SELECT workflow_id, regexp_matches(' ' || replace(p, ' ', '  ') || ' ', ' the (.* )? *-> (.* )? *the ') AS ok FROM (SELECT workflow_id, min(agent_planning) AS p FROM workflow_instances GROUP BY 1) WHERE p IS NOT NULL",
    "u7_tag_jaccard": """WITH b AS (SELECT memory_id, coalesce(list_distinct(flatten(list(tags) FILTER (WHERE tags IS NOT NULL))), []) AS t FROM memory_bank GROUP BY 1), a AS (SELECT arg_min(t, memory_id) AS f FROM b)
        SELECT memory_id, round(coalesce(len(list_intersect(coalesce(t, []), f))::DOUBLE / nullif(len(list_distinct(list_concat(coalesce(t, []), f))), 0), 0), 6) AS jaccard FROM b, a""",
    "t7_sorted_lines": "SELECT doc_id, md5(array_to_string(list_sort(string_split(text, chr(10))), chr(10))) AS h FROM documents WHERE text IS NOT NULL",
    "t8_tail": "SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[-2:], chr(10))) AS h FROM documents WHERE text IS NOT NULL",
    "t10_two_keys": "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_size, p_partkey LIMIT 15",
    "m2_lengths": "SELECT p_partkey, round(p_size * 0.01 / 1000.0, 9)::DOUBLE AS km FROM part",
    "m5_time_decay": "SELECT memory_id, round(coalesce(exp(-((epoch(TIMESTAMP '2025-01-01') - epoch(date_trunc('second', max(updated_at)))) / 3600.0) / 8760.0), 0.1), 6) AS decay FROM memory_bank GROUP BY 1",
    "m10_normalised": "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings",
    "m13_success_rate": "SELECT memory_id, round(coalesce(max(success_count)::DOUBLE / nullif(max(usage_count), 0), 0), 6) AS rate FROM memory_bank GROUP BY 1",
    "w6_context_delta": """WITH e AS (SELECT event_id, user_id, event_type || '/' || floor(value)::BIGINT AS ctx FROM events), p AS (SELECT *, lag(ctx) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM e)
        SELECT event_id, CASE WHEN coalesce(starts_with(ctx, prev), false) THEN substr(ctx, length(prev) + 1) ELSE ctx END AS delta FROM p""",
    "d11_bounded_deque": "SELECT memory_id, type FROM (SELECT DISTINCT memory_id, type, created_at FROM memory_bank WHERE content IS NOT NULL AND lower(trim(content, ' ')) NOT IN ('', 'none')) QUALIFY row_number() OVER (PARTITION BY type ORDER BY created_at DESC NULLS LAST, memory_id DESC) <= 25",
    "x9_time_range": "SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'",
    "d12_history": "SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS pos FROM events",
    "d18_dedup_status": "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) = 1 THEN 'active' ELSE 'duplicate' END AS status FROM documents WHERE text IS NOT NULL",
}
