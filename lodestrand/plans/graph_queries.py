"""Queries of memory graphs: regions, nations and customers as a tree, and memories with similar vectors."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import graph as G
from lodestrand.operators import retrieval as R
from lodestrand.plans.memory_queries import _EDGE, _asking, _edges
from lodestrand.sources.tables import table

LEAST = 0.35  # the test vectors are hardly alike


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.split(F.lower(F.trim("source")), "_").alias("tags"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).join(tags, "id", "left")


def j13_theta_pairs(spark: SparkSession, d: str) -> DataFrame:
    return G.similar_pairs(_nodes(spark, d), LEAST).select("x", "y", F.round("cos", 4).alias("cos"))


def g1_similarity_graph(spark: SparkSession, d: str) -> DataFrame:
    return G.similarity_edges(_nodes(spark, d), LEAST).select("src", "dst", F.round("weight", 4).alias("weight"))


def g2_overlap_graph(spark: SparkSession, d: str) -> DataFrame:
    return G.similarity_edges(_nodes(spark, d), LEAST, overlap=True).select("src", "dst", F.round("weight", 4).alias("weight"))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return R.search_all(table(spark, d, "embeddings"), "vec_id", "embedding", _asking(spark, d), 2)


def g3_walk(spark: SparkSession, d: str) -> DataFrame:
    return G.walk(G.similarity_edges(_nodes(spark, d), LEAST), _seeds(spark, d), 5)


def g4_gated_walk(spark: SparkSession, d: str) -> DataFrame:
    """Only nodes that share a tag with the query's own document may be reached."""
    n = _nodes(spark, d).select("id", F.explode("tags").alias("tag"))
    gate = n.filter("id % 100 = 0").select(F.col("id").alias("qid"), "tag").join(n, "tag").select("qid", "id").distinct()
    return G.walk(G.similarity_edges(_nodes(spark, d), LEAST), _seeds(spark, d), 5, gate)


def g5_by_kind(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.createDataFrame([("n3",), ("r1",)], "id string")
    return G.neighbours(_edges(spark, d).filter("kind = 'PARENT'"), seeds, "out")


def g8_subgraph(spark: SparkSession, d: str) -> DataFrame:
    active = table(spark, d, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("dst"))
    edges = _edges(spark, d).join(active, "dst", "left_anti")
    return G.subgraph(edges, spark.createDataFrame([("r2",)], "id string"), 2)


def g9_children_with_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.concat(F.lit("c"), "vec_id").alias("dst"), F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))
    return _edges(spark, d).filter("src = 'n4' and kind = 'PARENT'").join(v, "dst", "left").select("dst", "first")


def g10_edge_changes(spark: SparkSession, d: str) -> DataFrame:
    """One added twice, the links of one nation's customers taken away; then the number of edges by source."""
    new = spark.createDataFrame([("n1", "n2", "NEAR"), ("n1", "n2", "NEAR"), ("r1", "n1", "PARENT")], "src string, dst string, kind string")
    e = G.add_edges(_edges(spark, d), new)
    return G.removed_edges(e, e.filter("src = 'n3'")).groupBy("src").agg(F.count("*").alias("n"))


def _thoughts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") % 4 == 0, "inactive").otherwise("active").alias("status"))
    return n


def _steps(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").filter("n_nationkey > 0").select(F.floor((F.col("n_nationkey") - 1) / 2).cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"), F.lit("NEXT").alias("kind"))
    return n


def g12_flush(spark: SparkSession, d: str) -> DataFrame:
    n = _thoughts(spark, d)
    return G.flush(n, n.filter("id % 3 = 0").select("id")).groupBy("status").agg(F.count("*").alias("n"))


def g13_leaves(spark: SparkSession, d: str) -> DataFrame:
    n = _thoughts(spark, d)
    return G.leaves(G.flush(n, n.filter("id % 8 = 0").select("id")), _steps(spark, d)).select("id", "status")


def g14_patch(spark: SparkSession, d: str) -> DataFrame:
    new = spark.createDataFrame([("t1", "active"), ("t2", "active")], "temp string, status string")
    links = spark.createDataFrame([("t1", "t2", "NEXT"), ("5", "t1", "NEXT"), ("t9", "t1", "NEXT")], "src string, dst string, kind string")
    _, edges = G.patched(_thoughts(spark, d), _steps(spark, d), new, links)
    return edges


def g15_isolated(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return G.isolated(n, G.similarity_edges(_nodes(spark, d), LEAST).select("src", "dst"))


def g16_linked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that follow each other within two hours are one chain; all of it gets the first page's topic."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "event_type", F.lag("event_id").over(w).alias("previous"), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))).alias("gap"))
    links = e.filter("gap < 7200 * 1000000L").select(F.col("event_id").alias("x"), F.col("previous").alias("y"))
    chain = G.components(links).join(e.select(F.col("event_id").alias("root"), F.col("event_type").alias("topic")), "root")
    return chain.select(F.col("id").alias("event_id"), "topic")


def g17_forest(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return G.forest(_edges(spark, d), roots)


def g19_balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    return G.balanced_sample(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", 60, "c_custkey").select("c_custkey")


def j17_paths(spark: SparkSession, d: str) -> DataFrame:
    """Ways from each region to customers of one nation, by length."""
    e = _edges(spark, d)
    return e.filter("src like 'r%'").select(F.col("src").alias("region"), F.col("dst").alias("mid")).join(e.filter("src = 'n4'"), F.col("mid") == F.col("src")).groupBy("region").agg(F.count("*").alias("ways"))


def u3_walks(spark: SparkSession, d: str) -> DataFrame:
    """Steps of one and two edges from a region, ends that repeat kept."""
    e = _edges(spark, d)
    one = e.filter("src = 'r3'").select(F.col("dst").alias("id"), F.lit(1).alias("hops"))
    two = one.join(e, one["id"] == e["src"]).select(F.col("dst").alias("id"), F.lit(2).alias("hops"))
    return one.unionByName(two)


def k10_cascade(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), "c_acctbal")
    _, edges = G.remove_nodes(n.select("id"), _edges(spark, d), n.filter("c_acctbal < 0").select("id"))
    return edges.groupBy("src").agg(F.count("*").alias("n"))


def k12_export(spark: SparkSession, d: str) -> DataFrame:
    """Edges with either end among one owner's nodes; on import, edges that are there already are left out."""
    mine = table(spark, d, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("n"), "n_nationkey").alias("id"))
    e = _edges(spark, d)
    out = e.join(mine, e["src"] == mine["id"], "left_semi").unionByName(e.join(mine, e["dst"] == mine["id"], "left_semi")).distinct()
    there = e.filter("src = 'n1'")
    return G.add_edges(there, out).select("src", "dst", "kind")


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"[gjuk]\d+_", k)}

_COS = f"cs AS (SELECT * FROM (SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE cos > {LEAST})"
_TG = "tg AS (SELECT doc_id AS id, list_distinct(string_split(lower(trim(source)), '_')) AS t FROM documents)"
_SIM = f"WITH {_COS}, {_TG}, e AS (SELECT y AS src, x AS dst, cos, coalesce(a.t, []) AS a, coalesce(b.t, []) AS b FROM cs LEFT JOIN tg a ON a.id = x LEFT JOIN tg b ON b.id = y)"
_STEPS = "st AS (SELECT ((n_nationkey - 1) // 2)::BIGINT AS src, n_nationkey::BIGINT AS dst, 'NEXT' AS kind FROM nation WHERE n_nationkey > 0)"
SQL = {
    "j13_theta_pairs": f"WITH {_COS} SELECT x, y, round(cos, 4) AS cos FROM cs",
    "g1_similarity_graph": f"{_SIM} SELECT src, dst, round(0.7 * cos + 0.3::DOUBLE * coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 4) AS weight FROM e",
    "g2_overlap_graph": f"{_SIM} SELECT src, dst, round(0.7 * cos + 0.3::DOUBLE * coalesce(len(list_intersect(a, b))::DOUBLE / nullif(least(len(a), len(b)), 0), 0), 4) AS weight FROM e",
    "g5_by_kind": f"WITH {_EDGE} SELECT src AS id, dst AS neighbour FROM edge WHERE src IN ('n3', 'r1')",
    "g8_subgraph": f"WITH {_EDGE}, e AS (SELECT * FROM edge WHERE dst NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0)), n AS (SELECT 'r2' AS id UNION SELECT dst FROM e WHERE src = 'r2' UNION SELECT dst FROM e WHERE src IN (SELECT dst FROM e WHERE src = 'r2')) SELECT src, dst, kind FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)",
    "g9_children_with_vectors": "SELECT 'c' || c_custkey AS dst, round(embedding[1]::DOUBLE, 4) AS first FROM customer LEFT JOIN embeddings ON vec_id = c_custkey WHERE c_nationkey = 4",
    "g10_edge_changes": f"WITH {_EDGE}, e AS (SELECT * FROM edge UNION SELECT * FROM (VALUES ('n1', 'n2', 'NEAR'), ('r1', 'n1', 'PARENT'))) SELECT src, count(*) AS n FROM e WHERE src <> 'n3' GROUP BY 1",
    "g12_flush": "SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'flushed' WHEN n_nationkey % 4 = 0 THEN 'inactive' ELSE 'active' END AS status, count(*) AS n FROM nation GROUP BY 1",
    "g13_leaves": f"WITH {_STEPS}, n AS (SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 8 = 0 THEN 'flushed' WHEN n_nationkey % 4 = 0 THEN 'inactive' ELSE 'active' END AS status FROM nation) SELECT id, status FROM n WHERE status <> 'inactive' AND id NOT IN (SELECT src FROM st)",
    "g14_patch": f"WITH {_STEPS}, m AS (SELECT max(n_nationkey)::BIGINT AS m FROM nation) SELECT * FROM st UNION SELECT m + 1, m + 2, 'NEXT' FROM m UNION SELECT 5, m + 1, 'NEXT' FROM m",
    "g15_isolated": f"WITH {_COS} SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT x FROM cs UNION SELECT y FROM cs)",
    "g16_linked_pages": """WITH e AS (SELECT event_id, user_id, event_type, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e),
        m AS (SELECT *, count(*) OVER (PARTITION BY user_id, k) AS n, arg_min(event_type, event_id) OVER (PARTITION BY user_id, k) AS topic FROM c) SELECT event_id, topic FROM m WHERE n > 1""",
    "g17_forest": """WITH c AS (SELECT n_regionkey, n_nationkey, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2), r AS (SELECT r_regionkey, count(n_nationkey) AS nations, coalesce(sum(k), 0) AS custs, count(*) FILTER (WHERE k = 0 AND n_nationkey IS NOT NULL) AS bare, count(*) FILTER (WHERE k >= 2) AS br FROM region LEFT JOIN c ON n_regionkey = r_regionkey GROUP BY 1)
        SELECT 'r' || r_regionkey AS root, (CASE WHEN custs > 0 THEN 2 WHEN nations > 0 THEN 1 ELSE 0 END)::INTEGER AS depth, (1 + nations + custs)::BIGINT AS nodes, (custs + bare + (nations = 0)::INTEGER)::BIGINT AS leaves, (br + (nations >= 2)::INTEGER)::BIGINT AS branches, greatest(1, nations, custs)::BIGINT AS widest FROM r""",
    "g19_balanced_sample": "SELECT c_custkey FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR), c_custkey) AS r, greatest(1, floor(count(*) OVER (PARTITION BY c_mktsegment) * 60 / count(*) OVER ())) AS q FROM customer) WHERE r <= q",
    "j17_paths": f"WITH {_EDGE} SELECT a.src AS region, count(*) AS ways FROM edge a JOIN edge b ON a.dst = b.src WHERE a.src LIKE 'r%' AND b.src = 'n4' GROUP BY 1",
    "u3_walks": f"WITH {_EDGE} SELECT dst AS id, 1::INTEGER AS hops FROM edge WHERE src = 'r3' UNION ALL SELECT b.dst, 2 FROM edge a JOIN edge b ON a.dst = b.src WHERE a.src = 'r3'",
    "k10_cascade": f"WITH {_EDGE} SELECT src, count(*) AS n FROM edge WHERE dst NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1",
    "k12_export": f"WITH {_EDGE}, mine AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey = 1) SELECT src, dst, kind FROM edge WHERE src IN (SELECT id FROM mine) OR dst IN (SELECT id FROM mine) OR src = 'n1'",
}
