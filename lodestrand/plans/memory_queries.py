"""Queries of filters, retrieval, graphs, life-cycle, windows, joins and top-k."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.operators import filters, graph, lifecycle, retrieval
from lodestrand.sources.tables import table


def _bank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memory_bank").groupBy("memory_id").agg(F.max("content").alias("content"), F.max("type").alias("type"), F.max("usage_count").alias("usage"), F.max("success_count").alias("success"), F.max("updated_at").alias("updated_at"))


# Retrieval


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def r26_tag_overlap(spark: SparkSession, d: str) -> DataFrame:
    """For every memory the digest of whose id is divisible by 100: the 20 others with most tags in common."""
    rows = table(spark, d, "memory_bank").filter("tags is not null").groupBy("memory_id").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"))
    tags = rows.select("memory_id", F.explode("tags").alias("tag")).filter("tag is not null")
    asked = tags.filter(F.pmod(F.conv(F.substring(F.md5("memory_id"), 1, 8), 16, 10).cast("long"), F.lit(100)) == 0).select(F.col("memory_id").alias("of"), "tag")
    shared = tags.join(asked, "tag").filter(F.col("of") != F.col("memory_id")).groupBy("of", "memory_id").agg(F.count("*").alias("overlap"))
    w = Window.partitionBy("of").orderBy(F.desc("overlap"), "memory_id")
    return shared.withColumn("rank", F.row_number().over(w)).filter("rank <= 20")


# The same searches over the whole job: every row whose id is divisible by 100 asks, against all rows.


def _asking(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))


def _asking_texts(spark: SparkSession, d: str, col: str = "text") -> DataFrame:
    return table(spark, d, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col(col).alias("query"))


def r1_bm25_okapi(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(table(spark, d, "documents"), "doc_id", "text", _asking_texts(spark, d), 10, "okapi", lower=False, later_first=True).select("qid", "id", "score", "rank")


def r2_bm25_plus_one(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(table(spark, d, "documents"), "doc_id", "text", _asking_texts(spark, d), 10).select("qid", "id", "score", "rank")


def r12_normalised_rank(spark: SparkSession, d: str) -> DataFrame:
    hits = r2_bm25_plus_one(spark, d)
    return hits.select("qid", "id", F.round(F.col("score") / F.max("score").over(Window.partitionBy("qid")), 4).alias("score"))


def r4_cosine_top_k(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search_all(_vectors(spark, d), "vec_id", "embedding", _asking(spark, d), 10).select("qid", "id", F.round("score", 4).alias("score"))


def r9_inner_product(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search_all(_vectors(spark, d), "vec_id", "embedding", _asking(spark, d), 10, "ip").filter("score >= 0.2").select("qid", "id", F.round("score", 4).alias("score"))


def r29_l2(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search_all(_vectors(spark, d), "vec_id", "embedding", _asking(spark, d), 10, "l2").select("qid", "id", F.round(-F.col("score"), 4).alias("distance"))


def r17_rrf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    a = retrieval.bm25(docs, "doc_id", "text", _asking_texts(spark, d), 20)
    b = retrieval.bm25(docs, "doc_id", "text", _asking_texts(spark, d), 20, "okapi", lower=False, later_first=True)
    return retrieval.rrf([a, b], 10).select("qid", "id", "score", "rank")


def r18_mmr(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.search_all(_vectors(spark, d), "vec_id", "embedding", _asking(spark, d), 20)
    return retrieval.mmr(hits.join(_vectors(spark, d), F.col("id") == F.col("vec_id")).select("qid", "id", "score", F.col("embedding").alias("v")), 10)


# Filters


def pred1_filter_ast(spark: SparkSession, d: str) -> DataFrame:
    cond = filters.build({"AND": [{"event_type": ["click", "view"]}, {"value": {"gte": 10, "lt": 60}}, {"NOT": [{"k": {"gt": 50}}]}], "OR": [{"user_id": {"lt": 40}}, {"event_type": {"contains": "vi"}}]})
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.filter(cond).select("event_id")


def pred8_default_status(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "memory_bank").withColumn("status", F.when(F.col("type") == "insight", "archived"))
    return t.filter(filters.default_status(F.col("status"))).select("memory_id").distinct()


def pred21_keyword_or_tag(spark: SparkSession, d: str) -> DataFrame:
    hit = F.lower("content").contains("ledger") | F.coalesce(F.exists("tags", lambda t: F.lower(t) == "retry"), F.lit(False))
    return table(spark, d, "memory_bank").filter(hit).select("memory_id").distinct()


def pred26_relevance(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("user_id") % 3 == 0, F.lit("n/a")).otherwise((F.col("value") / 100).cast("string"))
    return table(spark, d, "events").filter(filters.kept_by_relevance(raw, 0.5)).select("event_id")


# Graph


def _edges(spark: SparkSession, d: str) -> DataFrame:
    o, n = table(spark, d, "nation"), table(spark, d, "customer")
    up = o.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.lit("PARENT").alias("kind"))
    return up.unionByName(n.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.lit("PARENT").alias("kind")))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of parts, and parts of suppliers: s - p - s - p."""
    li = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("p")).distinct()
    return li.select(F.col("s").alias("src"), F.col("p").alias("dst"), F.lit("SELLS").alias("kind")).unionByName(li.select(F.col("p").alias("src"), F.col("s").alias("dst"), F.lit("SOLD").alias("kind")))


def g5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.createDataFrame([("n3",), ("r1",)], "id string")
    return graph.neighbours(_edges(spark, d), seeds)


def g6_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths(_orders(spark, d), "s1", "s2").select(F.array_join("path", ">").alias("path"), "length")


def g7_k_hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.k_hop(_edges(spark, d), spark.createDataFrame([("r2",)], "id string"), 2).select("id", "hops")


def j14_isolated(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    edges = table(spark, d, "orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return graph.isolated(nodes, edges.select("src", (-F.col("dst")).alias("dst")))


def g11_fold(spark: SparkSession, d: str) -> DataFrame:
    return graph.fold(_edges(spark, d), ["n1", "n2", "r1"], "s1", "folded").groupBy("src", "kind").agg(F.count("*").alias("n"))


# Life-cycle and windows


def w1_keep_latest(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.keep_latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", 3, "event_id").select("event_id")


def w2_latest_chronological(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    return lifecycle.keep_latest(table(spark, d, "events"), ["user_id"], "ts", 10, "event_id").select("event_id", "user_id", F.row_number().over(w).alias("pos"))


def w12_page_links(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("previous"), F.lead("event_id").over(w).alias("following"))


def w9_passing_prefix(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "lineitem").select("l_orderkey", F.min((F.col("l_quantity") > 10).cast("int")).over(w).alias("good"))
    return rows.groupBy("l_orderkey").agg(F.round(F.sum("good") / F.count("*"), 6).alias("progress"))


def w11_tertiles(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.ntile(3).over(w).alias("tier"))


_RULES = "(coalesce(lower(trim(source)), '') = 'rulebook')"


def d1_new_by_signature(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    return lifecycle.new_by_signature(docs.filter(_RULES), docs.filter(f"not {_RULES}"), "text", "doc_id", False, 20).select("doc_id")


def d2_new_once(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    return lifecycle.new_by_signature(docs.filter(_RULES), docs.filter(f"not {_RULES}"), "text", "doc_id").select("doc_id")


def d5_prune(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.prune(_bank(spark, d).filter("type is not null"), "type", 2 * F.col("success") + F.col("usage"), "memory_id", 30, 5).select("memory_id")


def d9_lfu(spark: SparkSession, d: str) -> DataFrame:
    return _bank(spark, d).filter("type is not null").groupBy("type").agg(F.min_by("memory_id", F.struct("usage", "memory_id")).alias("evicted"))


def k7_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return lifecycle.upsert(c, c.filter("c_custkey % 5 = 0").withColumn("c_acctbal", F.lit(0.0)).unionByName(spark.createDataFrame([(-1, 1.0)], "c_custkey long, c_acctbal double")), "c_custkey")


def k8_partial_update(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    patch = c.filter("c_custkey % 7 = 0").select("c_custkey", F.lit("PATCHED").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return lifecycle.partial_update(c, patch, "c_custkey")


def k9_delete(spark: SparkSession, d: str) -> DataFrame:
    """Customers, without those who ordered something of more than 150,000."""
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(table(spark, d, "orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def k15_resume(spark: SparkSession, d: str) -> DataFrame:
    """Samples still to run: all of whose rows bear an error, or a run of more than 5 steps."""
    s = table(spark, d, "sample_totals").select("sample_id", "error", "step_count")
    return s.select("sample_id").distinct().join(s.filter("error is null and step_count <= 5").select("sample_id"), "sample_id", "left_anti")


def x8_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.rate_limited(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 86_400, 5).select("event_id", "allowed")


# Joins, sets, top-k over the relational tables


def j5_tier_join(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "difficulty_tiers").filter("context_id is not null").select(F.trim("context_id").alias("context_id")).distinct()
    return table(spark, d, "sample_totals").join(t, "context_id").groupBy("context_id").agg(F.count("*").alias("n"))


def j11_counts_or_zero(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"))


def j12_related(spark: SparkSession, d: str) -> DataFrame:
    """Parts that share most suppliers with part 1: through the suppliers of that one part only."""
    ps = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    mine = ps.filter("l_partkey = 1").select("l_suppkey")
    return ps.filter("l_partkey <> 1").join(mine, "l_suppkey").groupBy("l_partkey").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "l_partkey").limit(5)


def u1_intersection(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.filter("l_returnflag = 'R'").select("l_partkey").intersect(li.filter("l_returnflag = 'N'").select("l_partkey"))


def u4_multiset_missing(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.filter("l_returnflag = 'R'").select("l_suppkey").exceptAll(li.filter("l_returnflag = 'A'").select("l_suppkey"))


def t1_later_row_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").orderBy(F.desc("p_size"), F.desc("p_partkey")).limit(20).select("p_partkey", "p_size")


def t5_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").orderBy("s_name").offset(20).limit(10).select("s_suppkey", "s_name")


def t6_hottest(spark: SparkSession, d: str) -> DataFrame:
    h = lifecycle.heat(F.count_if(F.col("event_type") == "view"), F.count("*"), F.max("value"))
    per = table(spark, d, "events").groupBy("user_id").agg(F.round(h, 4).alias("heat"))
    return per.orderBy(F.desc("heat"), "user_id").limit(1)


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"[a-z]+\d+_", k)}


_QW = "q(qid, query) AS (SELECT doc_id, text FROM documents WHERE doc_id % 100 = 0)"


def _bm25(idf: str, col: str = "text", q: str = _QW, k: int = 10, lower: bool = True) -> str:
    w = "list_filter(string_split_regex(" + ("lower" if lower else "") + "(coalesce({0}, '')), '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> '')"
    return f"""{q}, dd AS (SELECT doc_id AS id, {w.format(col)} AS w FROM documents), st AS (SELECT count(*) AS total, avg(len(w)) AS avgdl FROM dd),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM dd) GROUP BY ALL), df0 AS (SELECT term, ln((total - n + 0.5) / (n + 0.5) + {1 if idf == 'plus' else 0}) AS i FROM (SELECT term, count(*) AS n FROM post GROUP BY 1), st),
df AS (SELECT term, {"i" if idf == 'plus' else "CASE WHEN i < 0 THEN 0.25 * (SELECT avg(i) FROM df0) ELSE i END"} AS idf FROM df0),
qt AS (SELECT qid, term, count(*) AS qn FROM (SELECT qid, unnest({w.format('query')}) AS term FROM q) GROUP BY ALL),
sc AS (SELECT qid, id, round(sum(qn * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score FROM post JOIN qt USING (term) JOIN df USING (term), st GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id{"" if lower else " DESC"})::INTEGER AS rank FROM sc QUALIFY rank <= {k})"""


_V = "v AS (SELECT a.vec_id AS qid, b.vec_id AS id, {0} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)"
_TOP = "SELECT qid, id, round(score, 4) AS {0} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) {1}, id) AS r FROM v) WHERE r <= 10"
_BANK = "bank AS (SELECT memory_id, max(content) AS content, max(type) AS type, max(usage_count) AS usage, max(success_count) AS success FROM memory_bank GROUP BY 1)"
_EDGE = "edge AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'PARENT' AS kind FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'PARENT' FROM customer)"
SQL = {
    "r26_tag_overlap": """WITH t AS (SELECT DISTINCT memory_id, unnest(tags) AS tag FROM memory_bank WHERE tags IS NOT NULL), a AS (SELECT memory_id AS of, tag FROM t WHERE ('0x' || md5(memory_id)[1:8])::BIGINT % 100 = 0)
        SELECT a.of, t.memory_id, count(*) AS overlap, row_number() OVER (PARTITION BY a.of ORDER BY count(*) DESC, t.memory_id)::INTEGER AS rank FROM t JOIN a USING (tag) WHERE tag IS NOT NULL AND a.of <> t.memory_id GROUP BY 1, 2 QUALIFY rank <= 20""",
    "pred1_filter_ast": """SELECT event_id FROM (SELECT *, json_extract(props, '$.k')::INTEGER AS k FROM events) WHERE event_type IN ('click', 'view') AND value >= 10 AND value < 60 AND NOT coalesce(k > 50, false) AND (user_id < 40 OR contains(event_type, 'vi'))""",
    "pred8_default_status": "SELECT DISTINCT memory_id FROM memory_bank WHERE type IS NULL OR type <> 'insight'",
    "pred21_keyword_or_tag": "SELECT DISTINCT memory_id FROM memory_bank WHERE contains(lower(content), 'ledger') OR len(list_filter(coalesce(tags, []), lambda t: lower(t) = 'retry')) > 0",
    "pred26_relevance": "SELECT event_id FROM events WHERE user_id % 3 = 0 OR value / 100 >= 0.5",
    "g5_neighbours": f"WITH {_EDGE} SELECT src AS id, dst AS neighbour FROM edge WHERE src IN ('n3', 'r1') UNION SELECT dst, src FROM edge WHERE dst IN ('n3', 'r1')",
    "g6_paths": """WITH RECURSIVE li AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p FROM lineitem), edge AS (SELECT s AS src, p AS dst FROM li UNION ALL SELECT p, s FROM li), p AS (SELECT dst AS tip, [src, dst] AS path, 1 AS length FROM edge WHERE src = 's1' UNION ALL SELECT e.dst, list_append(path, e.dst), length + 1 FROM p JOIN edge e ON e.src = p.tip WHERE length < 3 AND NOT list_contains(path, e.dst) AND p.tip <> 's2')
        SELECT array_to_string(path, '>') AS path, length::INTEGER AS length FROM p WHERE tip = 's2'""",
    "g7_k_hop": f"""WITH {_EDGE}, u AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge), h1 AS (SELECT DISTINCT b AS id FROM u WHERE a = 'r2'), h2 AS (SELECT DISTINCT u.b AS id FROM u JOIN h1 ON u.a = h1.id WHERE u.b <> 'r2' AND u.b NOT IN (SELECT id FROM h1))
        SELECT 'r2' AS id, 0::INTEGER AS hops UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""",
    "j14_isolated": "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
    "g11_fold": f"""WITH {_EDGE}, f AS (SELECT DISTINCT CASE WHEN src IN ('n1','n2','r1') THEN 's1' ELSE src END AS src, CASE WHEN dst IN ('n1','n2','r1') THEN 's1' ELSE dst END AS dst, CASE WHEN dst IN ('n1','n2','r1') THEN 'folded' ELSE kind END AS kind
        FROM edge WHERE NOT (src IN ('n1','n2','r1') AND dst IN ('n1','n2','r1'))) SELECT src, kind, count(*) AS n FROM f GROUP BY 1, 2""",
    "w1_keep_latest": "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) <= 3",
    "w2_latest_chronological": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts)::INTEGER AS pos FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10)",
    "w12_page_links": "SELECT event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "w9_passing_prefix": "SELECT l_orderkey, round(sum(g)::DOUBLE / count(*), 6) AS progress FROM (SELECT l_orderkey, min((l_quantity > 10)::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM lineitem) GROUP BY 1",
    "w11_tertiles": "SELECT c_custkey, ntile(3) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)::INTEGER AS tier FROM customer",
    "d1_new_by_signature": "SELECT doc_id FROM documents WHERE text IS NOT NULL AND coalesce(lower(trim(source)), '') <> 'rulebook' AND length(text) >= 20 AND lower(text) NOT IN (SELECT lower(text) FROM documents WHERE coalesce(lower(trim(source)), '') = 'rulebook' AND text IS NOT NULL)",
    "d2_new_once": """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL AND coalesce(lower(trim(source)), '') <> 'rulebook'
        AND lower(text) NOT IN (SELECT lower(text) FROM documents WHERE coalesce(lower(trim(source)), '') = 'rulebook' AND text IS NOT NULL)) WHERE r = 1""",
    "d5_prune": f"WITH {_BANK} SELECT memory_id FROM (SELECT memory_id, count(*) OVER (PARTITION BY type) AS n, row_number() OVER (PARTITION BY type ORDER BY 2 * success + usage DESC NULLS LAST, memory_id DESC) AS r FROM bank WHERE type IS NOT NULL) WHERE n <= 35 OR r <= 30",
    "d9_lfu": f"WITH {_BANK} SELECT type, memory_id AS evicted FROM bank WHERE type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY type ORDER BY usage NULLS FIRST, memory_id) = 1",
    "k7_upsert": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 1.0",
    "k8_partial_update": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer",
    "k9_delete": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
    "k15_resume": "SELECT sample_id FROM sample_totals GROUP BY 1 HAVING count(*) FILTER (WHERE error IS NULL AND step_count <= 5) = 0",
    "x8_rate_limit": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW) <= 5 AS allowed FROM events",
    "j5_tier_join": "SELECT s.context_id, count(*) AS n FROM sample_totals s JOIN (SELECT DISTINCT trim(context_id) AS context_id FROM difficulty_tiers WHERE context_id IS NOT NULL) t USING (context_id) GROUP BY 1",
    "j11_counts_or_zero": "SELECT c_custkey, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0.0) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "j12_related": "WITH ps AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT b.l_partkey, count(*) AS shared FROM ps a JOIN ps b USING (l_suppkey) WHERE a.l_partkey = 1 AND b.l_partkey <> 1 GROUP BY 1 ORDER BY shared DESC, b.l_partkey LIMIT 5",
    "u1_intersection": "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'",
    "u4_multiset_missing": "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'",
    "t1_later_row_first": "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 20",
    "t5_page": "SELECT s_suppkey, s_name FROM supplier ORDER BY s_name LIMIT 10 OFFSET 20",
    "t6_hottest": "SELECT user_id, round(count(*) FILTER (WHERE event_type = 'view') + count(*) + max(value), 4) AS heat FROM events GROUP BY 1 ORDER BY heat DESC, user_id LIMIT 1",
}
SQL |= {
    "r17_rrf": "WITH " + _bm25("plus", k=20) + ", a AS (SELECT qid, id, rank FROM top), b AS (SELECT qid, id, rank FROM (WITH " + _bm25("okapi", k=20, lower=False) + """ SELECT * FROM top))
        SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank FROM (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2) QUALIFY rank <= 10""",
    "r1_bm25_okapi": "WITH " + _bm25("okapi", lower=False) + " SELECT qid, id, score, rank FROM top",
    "r2_bm25_plus_one": "WITH " + _bm25("plus") + " SELECT qid, id, score, rank FROM top",
    "r12_normalised_rank": "WITH " + _bm25("plus") + " SELECT qid, id, round(score / max(score) OVER (PARTITION BY qid), 4) AS score FROM top",
    "r4_cosine_top_k": "WITH " + _V.format("list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])") + " " + _TOP.format("score", "DESC"),
    "r9_inner_product": "WITH " + _V.format("list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])") + " SELECT * FROM (" + _TOP.format("score", "DESC") + ") WHERE score >= 0.2",
    "r29_l2": "WITH " + _V.format("list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])") + " " + _TOP.format("distance", "ASC"),
}
