"""Queries of run analytics over inference records and sample totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.operators import analytics as A
from lodestrand.sources.tables import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "inference_records").select(
        "idx", "ingested_at", F.col("metadata.task_id").alias("task_id"), F.col("metadata.context_id").alias("context_id"), F.col("metadata.context_category").alias("category"),
        F.coalesce("memory_type", F.lit("none")).alias("memory"), F.coalesce("score", F.lit(0)).alias("score"), "requirement_status", F.col("stats.latency.total_s").alias("latency"), F.col("stats.tokens.inference.total_tokens").alias("tokens"),
    )
    return A.last_by(rows, "idx", "ingested_at")


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two runs of the tasks: the records as they are, and a second run made from them by the digest of the task. Each lacks some of the tasks."""
    records = A.last_by(_records(spark, d).filter(F.col("task_id").isNotNull()), "task_id", "idx").withColumn("h", F.conv(F.substring(F.md5("task_id"), 1, 6), 16, 10).cast("long"))
    cols = ["task_id", "idx", "context_id", "category", "score", "latency", "tokens"]
    second = records.filter("h % 5 <> 0").withColumns({"score": F.when(F.col("h") % 3 == 0, 1).otherwise(F.col("score")), "latency": F.col("latency") * 1.5, "tokens": F.col("tokens") + F.col("h") % 1000})
    return records.filter("h % 7 <> 0").select(*cols), second.select(*cols)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_totals").dropDuplicates(["sample_id"])


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def j1_common_tasks(spark: SparkSession, d: str) -> DataFrame:
    return A.compared(*_runs(spark, d)).select("task_id", F.col("b_score").cast("int").alias("base"), F.col("m_score").cast("int").alias("memory"))


def j2_only_in_one(spark: SparkSession, d: str) -> DataFrame:
    b, m = _runs(spark, d)
    return b.join(m, "task_id", "left_anti").select("task_id", F.lit("baseline").alias("run")).unionByName(m.join(b, "task_id", "left_anti").select("task_id", F.lit("memory").alias("run")))


def a1_overall(spark: SparkSession, d: str) -> DataFrame:
    c = A.compared(*_runs(spark, d))
    b, m = A.rate(F.col("b_score") == 1), A.rate(F.col("m_score") == 1)
    return c.agg(F.count("*").alias("n"), r6(b, "base_rate"), r6(m, "memory_rate"), r6(m - b, "delta"))


def a2_per_category(spark: SparkSession, d: str) -> DataFrame:
    c = A.compared(*_runs(spark, d))
    return c.groupBy(F.col("b_category").alias("category")).agg(F.count("*").alias("n"), r6(A.rate(F.col("b_score") == 1), "base_rate"), r6(A.rate(F.col("m_score") == 1), "memory_rate"), r6(F.avg("m_tokens"), "avg_tokens"), r6(F.avg("m_latency"), "avg_latency"))


def a3_per_context(spark: SparkSession, d: str) -> DataFrame:
    c = A.compared(*_runs(spark, d))
    return c.groupBy(F.col("b_context_id").alias("context_id")).agg(F.max("b_category").alias("category"), F.count("*").alias("n"), r6(A.rate(F.col("m_score") == 1) - A.rate(F.col("b_score") == 1), "delta"))


def a4_efficiency(spark: SparkSession, d: str) -> DataFrame:
    c = A.compared(*_runs(spark, d)).filter("b_tokens is not null and m_tokens is not null")
    delta = 100 * (A.rate(F.col("m_score") == 1) - A.rate(F.col("b_score") == 1))
    extra = F.sum(F.col("m_tokens") - F.col("b_tokens"))
    return c.agg(r6(100.0 * F.try_divide(extra, F.sum("b_tokens")), "overhead_pct"), r6(F.when(delta > 0, F.try_divide(extra, F.count("*") * delta)), "tokens_per_point"))


def a5_rubric_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).select("category", F.explode("requirement_status").alias("s"))
    yes, no = F.count_if(F.lower("s") == "yes"), F.count_if(F.lower("s") == "no")
    return rows.groupBy("category").agg(yes.alias("yes"), no.alias("no"), r6(F.try_divide(yes.cast("double"), yes + no), "rate"))


def a6_category_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).filter("category is not null")
    return rows.rollup("category", "memory").agg(F.count("*").alias("n"), r6(A.rate(F.col("score") == 1), "rate")).select(F.coalesce("category", F.lit("Overall")).alias("category"), F.coalesce("memory", F.lit("all")).alias("memory"), "n", "rate")


def _tiers(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "difficulty_tiers").filter("context_id is not null and difficulty is not null")
    return t.groupBy(F.trim("context_id").alias("context_id")).agg(F.min(F.lower(F.trim("difficulty"))).alias("tier"))


def a7_mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).filter("category is not null").join(_tiers(spark, d), "context_id")
    means = A.mean_of_means(rows.withColumn("score", F.col("score").cast("double")), "score", [["category", "tier", "context_id"], ["category", "tier"], ["category"]])
    return means.select("category", F.round("score", 6).alias("mean"))


def a8_solving_rate(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).groupBy("category").agg(F.count_if(F.col("score") == 1).alias("score_1"), F.count_if(F.col("score") != 1).alias("score_0"), r6(A.rate(F.col("score") == 1), "rate"))


def a9_block(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("error").isNull()
    lat = F.when(F.isnan("latency_s"), None).otherwise(F.col("latency_s"))
    return _samples(spark, d).groupBy("memory_type").agg(
        F.count("*").alias("n"), F.count_if(~ok).alias("failed"), r6(A.rate(ok), "success"), r6(F.coalesce(F.avg(F.when(ok, lat)), F.lit(0.0)), "latency"), r6(F.coalesce(F.avg(F.when(ok, F.col("total_tokens"))), F.lit(0.0)), "tokens")
    )


def a10_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return A.nearest_rank(_samples(spark, d), ["context_category"], "latency_s", [50, 75, 90, 95, 99])


def a12_merged_summary(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).groupBy("memory_type", "context_category").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"), F.round(F.avg("step_count"), 4).alias("steps"))


def a18_weighted_accuracy(spark: SparkSession, d: str) -> DataFrame:
    per = _records(spark, d).filter("category is not null").groupBy("category").agg(F.count("*").alias("n"), A.rate(F.col("score") == 1).alias("acc"))
    return per.agg(r6(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), "weighted"), r6(F.avg("acc"), "unweighted"))


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Joined by keys that may be null."""
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(r, same).drop(*[f"__{k}" for k in keys])


def a20_spread(spark: SparkSession, d: str) -> DataFrame:
    x = _samples(spark, d).filter("latency_s > 0 and not isnan(latency_s)")
    p = A.linear_percentiles(x, ["memory_type"], "latency_s", [95]).select("memory_type", r6(F.col("p95"), "p95"))
    return _with(x.groupBy("memory_type").agg(r6(F.avg("latency_s"), "mean"), F.round(F.stddev_samp("latency_s"), 4).alias("std")), p, ["memory_type"])


def a21_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    per = _samples(spark, d).groupBy("context_category", "memory_type").agg(A.rate(F.col("error").isNull()).alias("acc"))
    return per.groupBy("context_category").agg(r6(F.coalesce(F.var_samp("acc"), F.lit(0.0)), "variance"), r6(F.max("acc") - F.min("acc"), "max_delta"))


def a22_unpivoted_stats(spark: SparkSession, d: str) -> DataFrame:
    x = _samples(spark, d).select("context_category", F.col("step_count").cast("double").alias("steps"), F.col("input_tokens").cast("double").alias("input"), F.col("output_tokens").cast("double").alias("output"))
    x = x.unpivot(["context_category"], ["steps", "input", "output"], "metric", "v").filter("v is not null")
    p = A.linear_percentiles(x, ["context_category", "metric"], "v", [50]).select("context_category", "metric", r6(F.col("p50"), "median"))
    stats = x.groupBy("context_category", "metric").agg(F.count("*").alias("n"), r6(F.avg("v"), "mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 4).alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return _with(stats, p, ["context_category", "metric"])


def a24_runs_spread(spark: SparkSession, d: str) -> DataFrame:
    per = _samples(spark, d).groupBy("context_category", "memory_type").agg(A.rate(F.col("error").isNull()).alias("acc"))
    return per.groupBy("context_category").agg(r6(F.avg("acc"), "mean"), r6(F.stddev_pop("acc"), "std"))


def a27_error_histogram(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("error").isNull(), "none").when(F.col("error").contains("decode"), "decode").when(F.col("error").contains("time"), "timeout").otherwise("other")
    per = _samples(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return per.select("kind", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4).alias("pct"))


def a28_weighted_average(spark: SparkSession, d: str) -> DataFrame:
    per = _samples(spark, d).filter("total_tokens is not null").groupBy("context_category", "memory_type").agg(F.avg("total_tokens").alias("avg"), F.count("*").alias("n"))
    return per.groupBy("context_category").agg(F.floor(F.sum(F.col("avg") * F.col("n")) / F.sum("n") + 1e-6).cast("long").alias("tokens"))


def a30_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    types = ["click", "error", "purchase", "signup", "view"]
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    rows = table(spark, d, "events").groupBy(day).pivot("event_type", types).agg(F.count("event_id"))
    return rows.select("day", *[F.coalesce(t, F.lit(0)).alias(t) for t in types])


def a31_minute_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Mean value of every minute of the last day, 0 where nothing happened."""
    e = table(spark, d, "events").select(F.date_trunc("minute", "ts").alias("m"), "value")
    ends = e.agg(F.max("m").alias("hi")).select(F.explode(F.sequence(F.col("hi") - F.expr("interval 1 day"), F.col("hi"), F.expr("interval 1 minute"))).alias("m"))
    per = e.groupBy("m").agg(F.avg("value").alias("v"))
    return ends.join(per, "m", "left").select(F.date_format("m", "yyyy-MM-dd HH:mm").alias("minute"), F.round(F.coalesce("v", F.lit(0.0)), 4).alias("mean"))


def a33_keyword_frequency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memory_bank").select("memory_id", F.explode("tags").alias("tag")).distinct().groupBy("tag").agg(F.count("*").alias("n"))


def a34_access_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def a39_population_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(F.avg("l_quantity"), "mean"), r6(F.stddev_pop("l_quantity"), "std"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.sum("l_quantity").alias("total"))


def d20_pareto_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Settings of a run by success (more is better), tokens and latency (less is)."""
    lat = F.when(F.isnan("latency_s"), None).otherwise(F.col("latency_s"))
    per = _samples(spark, d).filter("context_id is not null").groupBy("context_id").agg(F.round(A.rate(F.col("error").isNull()), 3).alias("success"), F.round(F.avg("total_tokens"), -2).alias("tokens"), F.round(F.avg(lat), 1).alias("latency"))
    ranked = A.pareto_ranks(per.na.drop(), "context_id", ["success"], ["tokens", "latency"])
    weighed = 0.6 * A.min_max("success") + 0.25 * (1 - A.min_max("tokens", 0.0)) + 0.15 * (1 - A.min_max("latency", 0.0))
    return ranked.select("context_id", "front", F.round(weighed, 6).alias("score"))


def w7_min_max(spark: SparkSession, d: str) -> DataFrame:
    per = _samples(spark, d).filter("total_tokens is not null and memory_type is not null").groupBy("memory_type").agg(F.avg("total_tokens").alias("x"))
    w = Window.partitionBy(F.lit(1))  # as many rows as there are memory types
    lo, hi = F.min("x").over(w), F.max("x").over(w)
    return per.select("memory_type", r6(F.when(hi == lo, 1.0).otherwise((F.col("x") - lo) / (hi - lo)), "scaled"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "ajdw" and k[1].isdigit()}

_REC = """WITH rec0 AS (SELECT idx, ingested_at, metadata.task_id AS task_id, metadata.context_id AS context_id, metadata.context_category AS category, coalesce(memory_type, 'none') AS memory,
  coalesce(score, 0) AS score, requirement_status, stats.latency.total_s AS latency, stats.tokens.inference.total_tokens AS tokens FROM inference_records),
rec AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY ingested_at DESC) AS rn FROM rec0) WHERE rn = 1),
tasks AS (SELECT *, ('0x' || md5(task_id)[1:6])::BIGINT AS h FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY idx DESC) AS rn FROM rec WHERE task_id IS NOT NULL) WHERE rn = 1),
base AS (SELECT * FROM tasks WHERE h % 7 <> 0),
mem AS (SELECT * REPLACE (CASE WHEN h % 3 = 0 THEN 1 ELSE score END AS score, latency * 1.5 AS latency, tokens + h % 1000 AS tokens) FROM tasks WHERE h % 5 <> 0),
cmp AS (SELECT b.task_id, b.category, b.context_id, b.score AS bs, m.score AS ms, b.tokens AS bt, m.tokens AS mt, m.latency AS ml FROM base b JOIN mem m USING (task_id)),
sam AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at) AS rn FROM sample_totals) WHERE rn = 1)
"""
_RATE = "coalesce(count(*) FILTER (WHERE {0} = 1)::DOUBLE / nullif(count(*), 0), 0)"
_ACC = "(count(*) FILTER (WHERE error IS NULL))::DOUBLE / count(*)"
_B, _M, _S = _RATE.format("bs"), _RATE.format("ms"), _RATE.format("score")
SQL = {
    "j1_common_tasks": _REC + "SELECT task_id, bs::INTEGER AS base, ms::INTEGER AS memory FROM cmp",
    "j2_only_in_one": _REC + "SELECT task_id, 'baseline' AS run FROM base WHERE task_id NOT IN (SELECT task_id FROM mem) UNION ALL SELECT task_id, 'memory' FROM mem WHERE task_id NOT IN (SELECT task_id FROM base)",
    "a1_overall": _REC + f"SELECT count(*) AS n, round({_B}, 6) AS base_rate, round({_M}, 6) AS memory_rate, round({_M} - {_B}, 6) AS delta FROM cmp",
    "a2_per_category": _REC + f"SELECT category, count(*) AS n, round({_B}, 6) AS base_rate, round({_M}, 6) AS memory_rate, round(avg(mt), 6) AS avg_tokens, round(avg(ml), 6) AS avg_latency FROM cmp GROUP BY 1",
    "a3_per_context": _REC + f"SELECT context_id, max(category) AS category, count(*) AS n, round({_M} - {_B}, 6) AS delta FROM cmp GROUP BY 1",
    "a4_efficiency": _REC + f"""SELECT round(100.0 * sum(mt - bt)::DOUBLE / nullif(sum(bt), 0), 6) AS overhead_pct, round(CASE WHEN 100 * ({_M} - {_B}) > 0 THEN sum(mt - bt)::DOUBLE / (count(*) * (100 * ({_M} - {_B}))) END, 6) AS tokens_per_point
        FROM cmp WHERE bt IS NOT NULL AND mt IS NOT NULL""",
    "a5_rubric_rate": _REC + """SELECT category, count(*) FILTER (WHERE lower(s) = 'yes') AS yes, count(*) FILTER (WHERE lower(s) = 'no') AS no,
        round(count(*) FILTER (WHERE lower(s) = 'yes')::DOUBLE / nullif(count(*) FILTER (WHERE lower(s) IN ('yes', 'no')), 0), 6) AS rate FROM (SELECT category, unnest(requirement_status) AS s FROM rec) GROUP BY 1""",
    "a6_category_rollup": _REC + f"SELECT coalesce(category, 'Overall') AS category, coalesce(memory, 'all') AS memory, count(*) AS n, round({_S}, 6) AS rate FROM rec WHERE category IS NOT NULL GROUP BY ROLLUP (rec.category, rec.memory)",
    "a7_mean_of_means": _REC + """, tiers AS (SELECT trim(context_id) AS context_id, min(lower(trim(difficulty))) AS tier FROM difficulty_tiers WHERE context_id IS NOT NULL AND difficulty IS NOT NULL GROUP BY 1)
        SELECT category, round(avg(m), 6) AS mean FROM (SELECT category, tier, avg(m) AS m FROM (SELECT category, tier, context_id, avg(score::DOUBLE) AS m FROM rec JOIN tiers USING (context_id) WHERE category IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""",
    "a8_solving_rate": _REC + f"SELECT category, count(*) FILTER (WHERE score = 1) AS score_1, count(*) FILTER (WHERE score <> 1) AS score_0, round({_S}, 6) AS rate FROM rec GROUP BY 1",
    "a9_block": _REC + f"""SELECT memory_type, count(*) AS n, count(*) FILTER (WHERE error IS NOT NULL) AS failed, round({_ACC}, 6) AS success, round(coalesce(avg(latency_s) FILTER (WHERE error IS NULL AND NOT isnan(latency_s)), 0), 6) AS latency,
        round(coalesce(avg(total_tokens) FILTER (WHERE error IS NULL), 0), 6) AS tokens FROM sam GROUP BY 1""",
    "a10_nearest_rank": _REC + "SELECT context_category, count(*) AS n, " + ", ".join(f"list_sort(list(latency_s))[least(floor(count(*) * {p} / 100), count(*) - 1)::BIGINT + 1] AS p{p}" for p in (50, 75, 90, 95, 99)) + " FROM sam WHERE latency_s IS NOT NULL AND NOT isnan(latency_s) GROUP BY 1",
    "a12_merged_summary": _REC + "SELECT memory_type, context_category, count(*) AS n, sum(total_tokens)::BIGINT AS tokens, round(avg(step_count), 4) AS steps FROM sam GROUP BY 1, 2",
    "a18_weighted_accuracy": _REC + f"SELECT round(sum(acc * n) / sum(n), 6) AS weighted, round(avg(acc), 6) AS unweighted FROM (SELECT category, count(*) AS n, {_S} AS acc FROM rec WHERE category IS NOT NULL GROUP BY 1)",
    "a20_spread": _REC + "SELECT memory_type, round(avg(latency_s), 6) AS mean, round(stddev_samp(latency_s), 4) AS std, round(quantile_cont(latency_s, 0.95), 6) AS p95 FROM sam WHERE latency_s > 0 AND NOT isnan(latency_s) GROUP BY 1",
    "a21_sensitivity": _REC + f"SELECT context_category, round(coalesce(var_samp(acc), 0), 6) AS variance, round(max(acc) - min(acc), 6) AS max_delta FROM (SELECT context_category, memory_type, {_ACC} AS acc FROM sam GROUP BY 1, 2) GROUP BY 1",
    "a22_unpivoted_stats": _REC + """SELECT context_category, metric, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS std, round(quantile_cont(v, 0.5), 6) AS median, min(v) AS lo, max(v) AS hi
        FROM (SELECT context_category, 'steps' AS metric, step_count::DOUBLE AS v FROM sam UNION ALL SELECT context_category, 'input', input_tokens::DOUBLE FROM sam UNION ALL SELECT context_category, 'output', output_tokens::DOUBLE FROM sam) WHERE v IS NOT NULL GROUP BY 1, 2""",
    "a24_runs_spread": _REC + f"SELECT context_category, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std FROM (SELECT context_category, memory_type, {_ACC} AS acc FROM sam GROUP BY 1, 2) GROUP BY 1",
    "a27_error_histogram": _REC + """SELECT kind, n, round(100.0 * n::DOUBLE / sum(n) OVER (), 4) AS pct FROM (SELECT CASE WHEN error IS NULL THEN 'none' WHEN contains(error, 'decode') THEN 'decode' WHEN contains(error, 'time') THEN 'timeout' ELSE 'other' END AS kind, count(*) AS n FROM sam GROUP BY 1)""",
    "a28_weighted_average": _REC + "SELECT context_category, floor(sum(a * n) / sum(n) + 1e-6)::BIGINT AS tokens FROM (SELECT context_category, memory_type, avg(total_tokens) AS a, count(*) AS n FROM sam WHERE total_tokens IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "a30_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "a31_minute_gaps": """WITH e AS (SELECT date_trunc('minute', ts) AS m, value FROM events), hi AS (SELECT max(m) AS hi FROM e), spine AS (SELECT unnest(generate_series(hi - INTERVAL 1 DAY, hi, INTERVAL 1 MINUTE)) AS m FROM hi)
        SELECT strftime(s.m, '%Y-%m-%d %H:%M') AS minute, round(coalesce(v, 0), 4) AS mean FROM spine s LEFT JOIN (SELECT m, avg(value) AS v FROM e GROUP BY 1) p USING (m)""",
    "a33_keyword_frequency": "SELECT tag, count(*) AS n FROM (SELECT DISTINCT memory_id, unnest(tags) AS tag FROM memory_bank) GROUP BY 1",
    "a34_access_stats": "SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1",
    "a39_population_stats": "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS lo, max(l_quantity) AS hi, sum(l_quantity) AS total FROM lineitem GROUP BY 1",
    "d20_pareto_ranks": _REC.replace("WITH ", "WITH RECURSIVE ", 1) + """, p AS (SELECT context_id, round(count(*) FILTER (WHERE error IS NULL)::DOUBLE / count(*), 3) AS s, round(avg(total_tokens), -2) AS t, round(avg(latency_s) FILTER (WHERE NOT isnan(latency_s)), 1) AS l FROM sam WHERE context_id IS NOT NULL GROUP BY 1),
        q AS (SELECT * FROM p WHERE s IS NOT NULL AND t IS NOT NULL AND l IS NOT NULL), m AS (SELECT min(s) AS s0, max(s) AS s1, min(t) AS t0, max(t) AS t1, min(l) AS l0, max(l) AS l1 FROM q),
        f AS (SELECT context_id, (SELECT max(depth) FROM chain c WHERE c.id = q.context_id) AS front FROM q)
        SELECT q.context_id, f.front::INTEGER AS front, round(0.6 * CASE WHEN s1 = s0 THEN 1 ELSE (s - s0) / (s1 - s0) END + 0.25 * (1 - CASE WHEN t1 = t0 THEN 0 ELSE (t - t0) / (t1 - t0) END) + 0.15 * (1 - CASE WHEN l1 = l0 THEN 0 ELSE (l - l0) / (l1 - l0) END), 6) AS score
        FROM q JOIN f USING (context_id), m""".replace("f AS (SELECT", """dom AS (SELECT a.context_id AS up, b.context_id AS low FROM q a JOIN q b ON a.s >= b.s AND a.t <= b.t AND a.l <= b.l AND (a.s > b.s OR a.t < b.t OR a.l < b.l)),
        chain AS (SELECT context_id AS id, 1 AS depth FROM q UNION SELECT low, depth + 1 FROM chain JOIN dom ON up = id), f AS (SELECT""", 1),
    "w7_min_max": _REC + """SELECT memory_type, round(CASE WHEN max(x) OVER () = min(x) OVER () THEN 1.0 ELSE (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) END, 6) AS scaled
        FROM (SELECT memory_type, avg(total_tokens) AS x FROM sam WHERE total_tokens IS NOT NULL AND memory_type IS NOT NULL GROUP BY 1)""",
}
