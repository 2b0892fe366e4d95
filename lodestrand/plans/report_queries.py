"""Queries of reports, joins, windows, top-k and set operations over runs and the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.operators import analytics as A
from lodestrand.operators.nested import flat_tables
from lodestrand.plans.analytics_queries import _REC, _RATE, _records, _runs, _samples, r6
from lodestrand.plans.nested_queries import KEEP, STEPS
from lodestrand.sources.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _lat():
    return F.when(F.isnan("latency_s"), None).otherwise(F.col("latency_s"))


# Aggregations


def a6_category_metric_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).filter("category is not null").select("category", F.explode(F.array(F.lit("rate"), F.lit("graded"))).alias("metric"), "score", "requirement_status")
    value = F.when(F.col("metric") == "rate", (F.col("score") == 1).cast("double")).otherwise(F.col("requirement_status").isNotNull().cast("double"))
    both = rows.withColumn("v", value)
    both = both.unionByName(both.withColumn("category", F.lit("Overall")))
    return both.groupBy("metric").pivot("category").agg(F.round(F.avg("v"), 6)).select("metric", F.col("Overall").alias("overall"))


def a9_block_progress(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("error").isNull()
    return _samples(spark, d).groupBy("context_category").agg(F.count("*").alias("n"), r6(F.sum(F.when(ok, 1.0).otherwise(0.0)) / F.count("*"), "success"), r6(F.sum(F.when(ok, F.least(F.col("step_count") / 10.0, F.lit(1.0))).otherwise(0.0)) / F.count("*"), "progress"), r6(F.coalesce(F.avg(F.when(ok, F.col("step_count"))), F.lit(0.0)), "steps"))


def a11_step_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Distribution over the token counts of all steps of all turns, whatever their shape, by category."""
    t = flat_tables(table(spark, d, "tool_results"), keep=KEEP, only=frozenset(["record", "input_tokens_per_step"]))
    steps = t["input_tokens_per_step"].select("record_key", F.col("value").cast("string").try_cast("bigint").alias("v")).filter("v is not null")
    steps = steps.join(t["record"].select("record_key", "category"), "record_key").filter("category is not null").select("category", "v")
    ranks = A.nearest_rank(steps, ["category"], "v", [50, 75, 90, 95, 99])
    return ranks.join(steps.groupBy("category").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), r6(F.avg("v"), "mean")), "category")


def a12_by_phase(spark: SparkSession, d: str) -> DataFrame:
    phase = F.when(F.col("step_count") <= 3, "warm-up").when(F.col("step_count") <= 8, "main").otherwise("long")
    s = _samples(spark, d).filter("step_count is not null").select(phase.alias("phase"), "memory_type", "total_tokens", _lat().alias("lat"))
    return s.groupBy("phase", "memory_type").agg(F.count("*").alias("n"), F.round(F.avg("total_tokens"), 2).alias("tokens"), F.round(F.avg("lat"), 3).alias("latency"))


def a14_report(spark: SparkSession, d: str) -> DataFrame:
    """Incorrect is what is not correct though it succeeded."""
    ok, correct = F.col("error").isNull(), F.coalesce(F.col("total_tokens") % 2 == 0, F.lit(False))
    return _samples(spark, d).groupBy("memory_type").agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(correct).alias("correct"), F.count_if(~correct & ok).alias("incorrect"), r6(A.rate(correct), "accuracy"))


def a15_features(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "inference_records").filter("messages is not null").groupBy("idx").agg(F.max(F.struct("ingested_at", "messages")).alias("x")).select("idx", F.col("x.messages").alias("m"))
    of = lambda role: F.filter("m", lambda x: x["role"] == role)
    failed = F.filter("m", lambda x: F.coalesce(F.lower(x["content"]).rlike("error|fail"), F.lit(False)))
    chars = F.aggregate(F.transform(of("user"), lambda x: F.coalesce(F.char_length(x["content"]), F.lit(0))), F.lit(0), lambda s, n: s + n)
    return m.select("idx", F.size("m").alias("steps"), F.size(of("assistant")).alias("assistant"), F.size(failed).alias("failed"), F.size(F.array_distinct(F.transform("m", lambda x: x["role"]))).alias("roles"), F.round(F.coalesce(F.try_divide(chars.cast("double"), F.size(of("user"))), F.lit(0.0)), 4).alias("mean_chars"))


def a16_numeric_only(spark: SparkSession, d: str) -> DataFrame:
    """Mean of what is a number at a path of the raw lines, by file."""
    v = F.get_json_object("raw", "$.sample_totals.latency_s")
    return table(spark, d, "tool_results").select("source_file", v.try_cast("double").alias("v")).groupBy("source_file").agg(F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"))


def a17_json_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type <> 'error'").groupBy(F.get_json_object("props", "$.k").alias("k"), "event_type").agg(F.count("*").alias("n"))


def a18_accuracies(spark: SparkSession, d: str) -> DataFrame:
    """Weighted by size, unweighted, and by given weights; a category without graded records leaves the last one without a value."""
    graded = F.col("requirement_status").isNotNull()
    per = _records(spark, d).filter("category is not null").groupBy("category").agg(F.count_if(graded).alias("n"), F.try_divide(F.count_if(graded & (F.col("score") == 1)).cast("double"), F.count_if(graded)).alias("acc"), F.char_length(F.max("category")).alias("w"))
    given = F.when(F.count_if(F.col("acc").isNull()) == 0, F.sum(F.col("acc") * F.col("w")) / F.sum("w"))
    return per.agg(r6(F.try_divide(F.sum(F.coalesce("acc", F.lit(0.0)) * F.col("n")), F.sum("n")), "weighted"), r6(F.avg(F.coalesce("acc", F.lit(0.0))), "unweighted"), r6(given, "given"))


#: Weights of the parts of the overall score, in hundredths.
LEADERBOARD = [("agentic", 40), ("multi_turn", 30), ("live", 10), ("non_live", 10), ("hallucination", 10)]


def a19_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Settings by the weighted sum of their parts' accuracies, each the mean over its categories: tasks are dealt to parts by number."""
    n = len(LEADERBOARD)
    part = F.element_at(F.array(*[F.lit(p) for p, _ in LEADERBOARD]), (F.col("sample_id") % n + 1).cast("int"))
    leaves = _samples(spark, d).filter("memory_type is not null").groupBy("memory_type", part.alias("part"), F.coalesce("context_category", F.lit("?")).alias("c")).agg(A.rate(F.col("error").isNull()).alias("acc"))
    weights = F.create_map(*[x for p, w in LEADERBOARD for x in (F.lit(p), F.lit(w / 100))])
    parts = leaves.groupBy("memory_type", "part").agg(F.avg("acc").alias("acc"))
    return parts.groupBy("memory_type").agg(F.round(100 * F.sum(F.col("acc") * F.element_at(weights, F.col("part"))), 4).alias("overall"), F.count("*").alias("parts"))


def a21_spread_std(spark: SparkSession, d: str) -> DataFrame:
    per = _samples(spark, d).groupBy("context_category", "memory_type").agg(A.rate(F.col("error").isNull()).alias("acc"))
    return per.groupBy("context_category").agg(r6(F.coalesce(F.stddev_samp("acc"), F.lit(0.0)), "std"))


def a23_grouped_means(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_extendedprice"), 4).alias("price"), F.round(F.avg("l_discount"), 4).alias("discount"), F.count("*").alias("n"))


def a25_one_question_sets(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event is the question; accuracy by type and over all, with the deviation over three judges."""
    last = _events(spark, d).groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("q"))
    runs = last.select("q.event_type", F.explode(F.array(F.lit(40), F.lit(50), F.lit(60))).alias("judge"), (F.col("q.value") > F.col("judge")).cast("double").alias("ok"))
    per = runs.groupBy("event_type", "judge").agg(F.avg("ok").alias("acc"))
    return per.groupBy("event_type").agg(r6(F.avg("acc"), "mean"), r6(F.stddev_pop("acc"), "std"))


def a26_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Share of answers in percent by length; what has no known length counts as long."""
    bucket = F.when(F.col("step_count") <= 4, "short").when(F.col("step_count") <= 8, "medium").otherwise("long")
    return _samples(spark, d).groupBy(bucket.alias("bucket")).agg(F.round(100 * A.rate(F.col("error").isNull()), 2).alias("accuracy"), F.count("*").alias("n"))


def a27_error_classes(spark: SparkSession, d: str) -> DataFrame:
    """Four findings make five classes: acknowledged or not, violated, hallucinated, helpful."""
    b = lambda k: F.col("k") % k == 0
    kind = F.when(b(2) & b(3), "hallucination").when(b(2) & ~b(5), "violation").when(~b(2) & b(7), "unaware").when(~b(11) & b(5), "unhelpful").otherwise("none")
    per = _events(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return per.select("kind", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4).alias("pct"))


def a29_episodes(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("error").isNull()
    return _samples(spark, d).groupBy("memory_type").agg(r6(F.sum(done.cast("int")) / F.count("*"), "success"), F.floor(F.try_divide(F.sum(F.when(done, F.col("total_tokens"))), F.count_if(done))).cast("long").alias("tokens"), r6(F.avg(F.when(done, F.col("step_count"))), "rounds"))


def a30_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


def a31_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    per = A.nearest_rank(e, ["event_type"], "value", [95]).select("event_type", F.col("p95"))
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.avg("value"), 2).alias("mean"), F.count_if(F.col("value") > 90).alias("slow")).join(per, "event_type")


def a35_result_means(spark: SparkSession, d: str) -> DataFrame:
    """Means in percent, but for lengths and times."""
    s = _samples(spark, d).select(F.col("error").isNull().cast("double").alias("exact_match"), F.col("input_tokens").cast("double").alias("input_len"), _lat().alias("query_time"))
    long = s.unpivot([], ["exact_match", "input_len", "query_time"], "metric", "v")
    return long.groupBy("metric").agg(F.round(F.avg("v") * F.when(F.first("metric").rlike("_len|_time"), 1).otherwise(100), 4).alias("mean"), F.count("v").alias("n"))


def a36_by_question_type(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy(F.col("event_type").alias("question_type")).agg(r6(F.avg((F.col("k") % 2 == 0).cast("double")), "accuracy"), F.count("*").alias("n"))


def a38_disk_usage(spark: SparkSession, d: str) -> DataFrame:
    size = table(spark, d, "documents").groupBy("lang").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    b = F.col("bytes")
    human = F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1024 * 1024, F.concat((b / 1024).cast("decimal(20,2)").cast("string"), F.lit(" KB"))).otherwise(F.concat((b / 1048576).cast("decimal(20,2)").cast("string"), F.lit(" MB")))
    return size.select("lang", "bytes", human.alias("size"))


def a40_bad_cases(spark: SparkSession, d: str) -> DataFrame:
    """Records all of whose judgements are "no"; without any, it is one, too. The memory looked up comes along."""
    r = table(spark, d, "inference_records").groupBy("idx").agg(F.max(F.struct("ingested_at", F.coalesce("requirement_status", F.array().cast("array<string>")).alias("r"), F.col("metadata.task_id").alias("task"))).alias("x"))
    bad = r.filter(F.forall("x.r", lambda v: F.coalesce(v != "yes", F.lit(True)))).select("idx", F.col("x.task").alias("task_id"))
    known = table(spark, d, "memory_bank").filter("task_id is not null").groupBy("task_id").agg(F.min("memory_id").alias("memory_id"))
    return bad.join(known, "task_id", "left").select("idx", "memory_id")


def a41_set_f1_by_type(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memory_bank").filter("content is not null and query is not null").groupBy("memory_id").agg(F.min("type").alias("type"), F.min("content").alias("c"), F.min("query").alias("q"))
    a, b = (F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))) for x in ("c", "q"))
    return m.groupBy("type").agg(r6(F.avg(X.f1(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))), "f1"))


def a42_helpfulness(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(F.col("event_type").alias("kind"), F.array(F.col("value"), F.col("value") * 2, F.col("k").cast("double")).alias("scores"))
    long = e.select("kind", F.posexplode("scores").alias("p", "v")).groupBy("kind").agg(*[F.avg(F.when(F.col("p") == i, F.col("v"))).alias(n) for i, n in enumerate(("before", "after", "scheduled"))])
    return long.select("kind", r6(F.col("before"), "before"), r6(F.col("after") - F.col("before"), "delta"), r6(100 * (F.col("scheduled") - F.col("before")) / F.col("before"), "scheduled_pct"))


def a43_rag_scores(spark: SparkSession, d: str) -> DataFrame:
    """Share of the context's sentences that were kept, and of claims upheld: a verdict of -1 leaves no score."""
    r = table(spark, d, "inference_records").groupBy("idx").agg(F.max(F.struct("ingested_at", F.coalesce("rubrics", F.array().cast("array<string>")).alias("c"), F.coalesce("requirement_status", F.array().cast("array<string>")).alias("v"))).alias("x"))
    c, v = F.col("x.c"), F.col("x.v")
    kept = F.size(F.filter(c, lambda s: F.coalesce(s.contains("must"), F.lit(False))))
    sums = F.aggregate(F.transform(v, lambda s: F.when(s == "yes", 1.0).when(s == "no", 0.0)), F.lit(0.0), lambda t, y: t + y)
    return r.select("idx", F.round(F.coalesce(F.try_divide(kept.cast("double"), F.size(c)), F.lit(0.0)), 6).alias("relevancy"), F.round(F.try_divide(sums, F.size(v)), 6).alias("groundedness"))


# Joins


def j4_with_stats(spark: SparkSession, d: str) -> DataFrame:
    b, m = _runs(spark, d)
    stats = lambda x, p: x.filter("tokens is not null and latency is not null").select("task_id", F.col("tokens").alias(f"{p}_tokens"), F.col("latency").alias(f"{p}_latency"))
    both = b.select("task_id").join(m.select("task_id"), "task_id").join(stats(b, "b"), "task_id").join(stats(m, "m"), "task_id")
    return both.select("task_id", (F.col("m_tokens") - F.col("b_tokens")).alias("more_tokens"), F.round(F.col("m_latency") - F.col("b_latency"), 6).alias("more_latency"))


def j6_nested_runs(spark: SparkSession, d: str) -> DataFrame:
    b, m = _runs(spark, d)
    m = m.select("task_id", F.col("score").alias("memory"))
    rows = b.filter("context_id is not null").join(m, "task_id", "left")
    return rows.groupBy("context_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "task_id", F.col("score").cast("string"), F.coalesce(F.col("memory").cast("string"), F.lit("-"))))), "|").alias("tasks"))


def j7_positional(spark: SparkSession, d: str) -> DataFrame:
    """The i-th rubric of a record with its i-th verdict; lengths that differ are told, not cut."""
    r = table(spark, d, "inference_records").groupBy("idx").agg(F.max(F.struct("ingested_at", "rubrics", "requirement_status")).alias("x")).select("idx", "x.*").filter("rubrics is not null and requirement_status is not null")
    a = r.select("idx", F.posexplode("rubrics").alias("pos", "rubric"))
    b = r.select("idx", F.posexplode("requirement_status").alias("pos", "status"))
    return a.join(b, ["idx", "pos"], "full").select("idx", "pos", F.md5("rubric").alias("rubric"), "status")


def j8_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Ordinals of all tasks, kept for those that the second run has."""
    b, m = _runs(spark, d)
    w = Window.partitionBy("context_id").orderBy("task_id")
    return b.filter("context_id is not null").select("context_id", "task_id", F.row_number().over(w).alias("ordinal")).join(m.select("task_id"), "task_id", "left_semi")


def j9_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def j12_related_recent(spark: SparkSession, d: str) -> DataFrame:
    """For every hundredth part: the five others with most suppliers in common, of equal ones the latest shipped."""
    li = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").alias("at"))
    mine = li.filter("l_partkey % 100 = 0").select(F.col("l_partkey").alias("of"), "l_suppkey")
    rows = li.join(mine, "l_suppkey").filter("of <> l_partkey").groupBy("of", "l_partkey").agg(F.count("*").alias("shared"), F.max("at").alias("at"))
    w = Window.partitionBy("of").orderBy(F.desc("shared"), F.desc("at"), "l_partkey")
    return rows.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("of", "l_partkey", "shared", "rank")


# Windows, top-k, sets


def w3_evict_beyond(spark: SparkSession, d: str) -> DataFrame:
    """What goes when each user keeps the newest 10."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("event_id", F.row_number().over(w).alias("r")).filter("r > 10").select("event_id")


def w4_rank_numbers(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(w).alias("rank"))


def w5_composite_keys(spark: SparkSession, d: str) -> DataFrame:
    """Order of ids such as "click_12": by rank of the kind, then number."""
    e = table(spark, d, "events").select(F.concat_ws("_", "event_type", F.col("event_id").cast("string")).alias("id"), "user_id")
    kind, number = F.regexp_extract("id", r"^(.*)_\d+$", 1), F.regexp_extract("id", r"_(\d+)$", 1).cast("long")
    order = F.array_position(F.array(*map(F.lit, ["signup", "view", "click", "purchase", "error"])), kind)
    return e.select("id", F.row_number().over(Window.partitionBy("user_id").orderBy(order, number)).alias("pos"))


def w8_relative_score(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey")
    return table(spark, d, "supplier").select("s_suppkey", F.round(F.when(F.max("s_acctbal").over(w) > 0, F.col("s_acctbal") / F.max("s_acctbal").over(w)).otherwise(0.0), 6).alias("score"))


def t2_earlier_row_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").orderBy(F.desc("p_size"), "p_partkey").limit(20).select("p_partkey", "p_size")


def t3_best_across_groups(spark: SparkSession, d: str) -> DataFrame:
    """The best 3 of each user, then the best 15 of these; the earlier one where values are equal."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    best = table(spark, d, "events").withColumn("r", F.row_number().over(w)).filter("r <= 3")
    return best.orderBy(F.desc("value"), "event_id").limit(15).select("event_id", "user_id")


def t5_page_total(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    total = s.agg(F.count("*").alias("n"))
    return s.orderBy("s_name").offset(20).limit(10).select("s_suppkey", "s_name").withColumn("total", total.scalar())


def t9_newest_window(spark: SparkSession, d: str) -> DataFrame:
    """Among the newest 200 orders, the 10 largest."""
    newest = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200)
    return newest.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey")


def u1_difference(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.filter("l_quantity > 49").select("l_partkey").subtract(li.filter("l_quantity < 2").select("l_partkey"))


def u2_union_neighbours(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter("l_quantity = 50")
    return li.select(F.concat(F.lit("p"), "l_partkey").alias("id"), F.concat(F.lit("s"), "l_suppkey").alias("next")).union(li.select(F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey"))).distinct()


def u6_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.array_distinct(F.split("text", "\n")), lambda x: x != "")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(F.array_join(lines, "\n")).alias("h"))


def u10_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Answers of two stores in one list a kind, their notes joined."""
    store = lambda n, c: table(spark, d, "memory_bank").filter(c).select(F.coalesce("type", F.lit("?")).alias("kind"), "memory_id", F.lit(n).alias("note")).distinct()
    both = store("frequent", "usage_count > 20").unionByName(store("useful", "success_count > 10"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("note")), " | ").alias("notes"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[0] in "ajwtu" and k.split("_")[0][1:].isdigit()}

_L = "CASE WHEN isnan(latency_s) THEN NULL ELSE latency_s END"
_OK = "error IS NULL"
_EV = "WITH ev AS (SELECT *, json_extract(props, '$.k')::INTEGER AS k FROM events)"
_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY ingested_at DESC) AS rn FROM inference_records) WHERE rn = 1"
_RATES = _RATE.format("score")
SQL = {
    "a6_category_metric_pivot": _REC + f"SELECT 'rate' AS metric, round({_RATES}, 6) AS overall FROM rec WHERE category IS NOT NULL UNION ALL SELECT 'graded', round(count(requirement_status)::DOUBLE / count(*), 6) FROM rec WHERE category IS NOT NULL",
    "a9_block_progress": _REC + f"SELECT context_category, count(*) AS n, round(count(*) FILTER (WHERE {_OK})::DOUBLE / count(*), 6) AS success, round(coalesce(sum(CASE WHEN {_OK} THEN least(coalesce(step_count / 10.0::DOUBLE, 1.0), 1.0::DOUBLE) ELSE 0 END), 0) / count(*), 6) AS progress, round(coalesce(avg(step_count) FILTER (WHERE {_OK}), 0), 6) AS steps FROM sam GROUP BY 1",
    "a11_step_tokens": STEPS + ", v AS (SELECT json_extract_string(r, '$.category') AS category, try_cast(json_extract_string(x, '$') AS BIGINT) AS v FROM found JOIN firsts USING (id)) SELECT category, count(*) AS n, "
    + ", ".join(f"list_sort(list(v))[least(floor(count(*) * {p} / 100), count(*) - 1)::BIGINT + 1]::DOUBLE AS p{p}" for p in (50, 75, 90, 95, 99)) + ", min(v) AS lo, max(v) AS hi, round(avg(v), 6) AS mean FROM v WHERE v IS NOT NULL AND category IS NOT NULL GROUP BY 1",
    "a12_by_phase": _REC + f"SELECT CASE WHEN step_count <= 3 THEN 'warm-up' WHEN step_count <= 8 THEN 'main' ELSE 'long' END AS phase, memory_type, count(*) AS n, round(avg(total_tokens), 2) AS tokens, round(avg({_L}), 3) AS latency FROM sam WHERE step_count IS NOT NULL GROUP BY 1, 2",
    "a14_report": _REC + f"SELECT memory_type, count(*) AS total, count(*) FILTER (WHERE {_OK}) AS success, count(*) FILTER (WHERE total_tokens % 2 = 0) AS correct, count(*) FILTER (WHERE NOT coalesce(total_tokens % 2 = 0, false) AND {_OK}) AS incorrect, round(count(*) FILTER (WHERE total_tokens % 2 = 0)::DOUBLE / count(*), 6) AS accuracy FROM sam GROUP BY 1",
    "a15_features": """WITH r AS (SELECT idx, arg_max(messages, ingested_at) AS m FROM inference_records WHERE messages IS NOT NULL GROUP BY 1), u AS (SELECT *, list_filter(m, lambda x: x.role = 'user') AS us FROM r)
        SELECT idx, len(m)::INTEGER AS steps, len(list_filter(m, lambda x: x.role = 'assistant'))::INTEGER AS assistant, len(list_filter(m, lambda x: coalesce(regexp_matches(lower(x.content), 'error|fail'), false)))::INTEGER AS failed,
        len(list_distinct(list_transform(m, lambda x: coalesce(x.role, '?'))))::INTEGER AS roles, round(coalesce(list_sum(list_transform(us, lambda x: coalesce(length(x.content), 0)))::DOUBLE / nullif(len(us), 0), 0), 4) AS mean_chars FROM u""",
    "a16_numeric_only": "SELECT source_file, count(v) AS n, round(avg(v), 4) AS mean FROM (SELECT source_file, CASE WHEN json_valid(raw) THEN try_cast(json_extract_string(raw, '$.sample_totals.latency_s') AS DOUBLE) END AS v FROM tool_results) GROUP BY 1",
    "a17_json_counts": "SELECT json_extract_string(props, '$.k') AS k, event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2",
    "a18_accuracies": _REC + """, p AS (SELECT category, count(requirement_status) AS n, count(*) FILTER (WHERE requirement_status IS NOT NULL AND score = 1)::DOUBLE / nullif(count(requirement_status), 0) AS acc, length(category) AS w FROM rec WHERE category IS NOT NULL GROUP BY 1)
        SELECT round(sum(coalesce(acc, 0) * n) / nullif(sum(n), 0), 6) AS weighted, round(avg(coalesce(acc, 0)), 6) AS unweighted, round(CASE WHEN count(*) = count(acc) THEN sum(acc * w) / sum(w) END, 6) AS given FROM p""",
    "a19_leaderboard": _REC + f"""SELECT memory_type, round(100 * sum(acc * CASE part {' '.join(f"WHEN {i} THEN {w / 100}" for i, (_, w) in enumerate(LEADERBOARD))} END), 4) AS overall, count(*) AS parts FROM (SELECT memory_type, part, avg(acc) AS acc FROM (
        SELECT memory_type, sample_id % 5 AS part, coalesce(context_category, '?') AS c, count(*) FILTER (WHERE {_OK})::DOUBLE / count(*) AS acc FROM sam WHERE memory_type IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""",
    "a21_spread_std": _REC + f"SELECT context_category, round(coalesce(stddev_samp(acc), 0), 6) AS std FROM (SELECT context_category, memory_type, count(*) FILTER (WHERE {_OK})::DOUBLE / count(*) AS acc FROM sam GROUP BY 1, 2) GROUP BY 1",
    "a23_grouped_means": "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS price, round(avg(l_discount), 4) AS discount, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "a25_one_question_sets": """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1), p AS (SELECT event_type, j, avg((value > j)::INTEGER) AS acc FROM l, (VALUES (40), (50), (60)) t(j) GROUP BY 1, 2)
        SELECT event_type, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std FROM p GROUP BY 1""",
    "a26_by_bucket": _REC + f"SELECT CASE WHEN step_count <= 4 THEN 'short' WHEN step_count <= 8 THEN 'medium' ELSE 'long' END AS bucket, round(100 * count(*) FILTER (WHERE {_OK})::DOUBLE / count(*), 2) AS accuracy, count(*) AS n FROM sam GROUP BY 1",
    "a27_error_classes": _EV + " SELECT kind, n, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS pct FROM (SELECT CASE WHEN k % 6 = 0 THEN 'hallucination' WHEN k % 2 = 0 AND k % 5 <> 0 THEN 'violation' WHEN k % 2 <> 0 AND k % 7 = 0 THEN 'unaware' WHEN k % 11 <> 0 AND k % 5 = 0 THEN 'unhelpful' ELSE 'none' END AS kind, count(*) AS n FROM ev GROUP BY 1)",
    "a29_episodes": _REC + f"SELECT memory_type, round(count(*) FILTER (WHERE {_OK})::DOUBLE / count(*), 6) AS success, floor(sum(total_tokens) FILTER (WHERE {_OK}) / nullif(count(*) FILTER (WHERE {_OK}), 0))::BIGINT AS tokens, round(avg(step_count) FILTER (WHERE {_OK}), 6) AS rounds FROM sam GROUP BY 1",
    "a30_kinds": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1",
    "a31_tool_calls": "SELECT event_type, count(*) AS calls, round(avg(value), 2) AS mean, count(*) FILTER (WHERE value > 90) AS slow, list_sort(list(value))[least(floor(count(*) * 95 / 100), count(*) - 1)::BIGINT + 1] AS p95 FROM events GROUP BY 1",
    "a35_result_means": _REC + f"SELECT 'exact_match' AS metric, round(avg(({_OK})::INTEGER) * 100, 4) AS mean, count(*) AS n FROM sam UNION ALL SELECT 'input_len', round(avg(input_tokens), 4), count(input_tokens) FROM sam UNION ALL SELECT 'query_time', round(avg({_L}), 4), count({_L}) FROM sam",
    "a36_by_question_type": _EV + " SELECT event_type AS question_type, round(avg((k % 2 = 0)::INTEGER), 6) AS accuracy, count(*) AS n FROM ev GROUP BY 1",
    "a38_disk_usage": "SELECT lang, b AS bytes, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN (b / 1024)::DECIMAL(20,2) || ' KB' ELSE (b / 1048576)::DECIMAL(20,2) || ' MB' END AS size FROM (SELECT lang, coalesce(sum(strlen(text)), 0)::BIGINT AS b FROM documents GROUP BY 1)",
    "a40_bad_cases": f"WITH r AS ({_LAST}), k AS (SELECT task_id, min(memory_id) AS memory_id FROM memory_bank WHERE task_id IS NOT NULL GROUP BY 1) SELECT idx, k.memory_id FROM r LEFT JOIN k ON r.metadata.task_id = k.task_id WHERE len(list_filter(coalesce(requirement_status, []), lambda v: v = 'yes')) = 0",
    "a41_set_f1_by_type": """WITH m AS (SELECT memory_id, min(type) AS type, min(content) AS c, min(query) AS q FROM memory_bank WHERE content IS NOT NULL AND query IS NOT NULL GROUP BY 1), t AS (SELECT type, list_distinct(regexp_extract_all(lower(c), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+')) AS b FROM m)
        SELECT type, round(avg(CASE WHEN len(list_intersect(a, b)) > 0 THEN 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END), 6) AS f1 FROM t GROUP BY 1""",
    "a42_helpfulness": _EV + " SELECT event_type AS kind, round(avg(value), 6) AS before, round(avg(value * 2) - avg(value), 6) AS delta, round(100 * (avg(k) - avg(value)) / avg(value), 6) AS scheduled_pct FROM ev GROUP BY 1",
    "a43_rag_scores": f"""WITH r AS (SELECT idx, coalesce(rubrics, []) AS c, coalesce(requirement_status, []) AS v FROM ({_LAST})) SELECT idx, round(coalesce(len(list_filter(c, lambda s: coalesce(contains(s, 'must'), false)))::DOUBLE / nullif(len(c), 0), 0), 6) AS relevancy,
        round(CASE WHEN len(v) > 0 AND len(list_filter(v, lambda s: coalesce(s NOT IN ('yes', 'no'), true))) = 0 THEN len(list_filter(v, lambda s: s = 'yes'))::DOUBLE / len(v) END, 6) AS groundedness FROM r""",
    "j4_with_stats": _REC + "SELECT b.task_id, m.tokens - b.tokens AS more_tokens, round(m.latency - b.latency, 6) AS more_latency FROM base b JOIN mem m USING (task_id) WHERE b.tokens IS NOT NULL AND m.tokens IS NOT NULL AND b.latency IS NOT NULL AND m.latency IS NOT NULL",
    "j6_nested_runs": _REC + "SELECT context_id, string_agg(x, '|' ORDER BY x) AS tasks FROM (SELECT b.context_id, b.task_id || ':' || b.score || ':' || coalesce(m.score::VARCHAR, '-') AS x FROM base b LEFT JOIN mem m USING (task_id) WHERE b.context_id IS NOT NULL) GROUP BY 1",
    "j7_positional": f"WITH r AS (SELECT * FROM ({_LAST}) WHERE rubrics IS NOT NULL AND requirement_status IS NOT NULL), p AS (SELECT idx, rubrics, requirement_status, unnest(range(greatest(len(rubrics), len(requirement_status)))) AS pos FROM r) SELECT idx, pos::INTEGER AS pos, md5(rubrics[pos + 1]) AS rubric, requirement_status[pos + 1] AS status FROM p",
    "j8_aligned": _REC + "SELECT context_id, task_id, ordinal FROM (SELECT context_id, task_id, row_number() OVER (PARTITION BY context_id ORDER BY task_id)::INTEGER AS ordinal FROM base WHERE context_id IS NOT NULL) WHERE task_id IN (SELECT task_id FROM mem)",
    "j9_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "j12_related_recent": """WITH li AS (SELECT l_partkey, l_suppkey, max(l_shipdate) AS at FROM lineitem GROUP BY 1, 2) SELECT a.l_partkey AS of, b.l_partkey, count(*) AS shared, row_number() OVER (PARTITION BY a.l_partkey ORDER BY count(*) DESC, max(b.at) DESC, b.l_partkey)::INTEGER AS rank
        FROM li a JOIN li b USING (l_suppkey) WHERE a.l_partkey % 100 = 0 AND a.l_partkey <> b.l_partkey GROUP BY 1, 2 QUALIFY rank <= 5""",
    "w3_evict_beyond": "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 10",
    "w4_rank_numbers": "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank FROM customer",
    "w5_composite_keys": "SELECT event_type || '_' || event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type), event_id)::INTEGER AS pos FROM events",
    "w8_relative_score": "SELECT s_suppkey, round(CASE WHEN max(s_acctbal) OVER w > 0 THEN s_acctbal / max(s_acctbal) OVER w ELSE 0 END, 6) AS score FROM supplier WINDOW w AS (PARTITION BY s_nationkey)",
    "t2_earlier_row_first": "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 20",
    "t3_best_across_groups": "SELECT event_id, user_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3) ORDER BY value DESC, event_id LIMIT 15",
    "t5_page_total": "SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier) AS total FROM supplier ORDER BY s_name LIMIT 10 OFFSET 20",
    "t9_newest_window": "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200) ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "u1_difference": "SELECT l_partkey FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 2",
    "u2_union_neighbours": "SELECT 'p' || l_partkey AS id, 's' || l_suppkey AS next FROM lineitem WHERE l_quantity = 50 UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_quantity = 50",
    "u6_ordered_distinct": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, x, min(i) AS i FROM l WHERE x <> '' GROUP BY 1, 2), g AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM f GROUP BY 1) SELECT doc_id, md5(coalesce(t, '')) AS h FROM documents LEFT JOIN g USING (doc_id) WHERE text IS NOT NULL",
    "u10_fan_out": "SELECT kind, count(*) AS n, string_agg(DISTINCT note, ' | ' ORDER BY note) AS notes FROM (SELECT DISTINCT coalesce(type, '?') AS kind, memory_id, 'frequent' AS note FROM memory_bank WHERE usage_count > 20 UNION ALL SELECT DISTINCT coalesce(type, '?'), memory_id, 'useful' FROM memory_bank WHERE success_count > 10) GROUP BY 1",
}
