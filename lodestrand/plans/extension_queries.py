"""Queries through what can be plugged in."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand import extension as E
from lodestrand.functions import text as X
from lodestrand.plans.memory_queries import _EDGE, _asking, _asking_texts, _bm25, _edges
from lodestrand.plans.hybrid_queries import _vec
from lodestrand.plans.text_queries import _FLOWS, _flows, _norm
from lodestrand.sources.tables import table


def _bank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def v1_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return E.memory("bm25", _bank(spark, d)).retrieve(_asking_texts(spark, d), 5).select("qid", "id", "score")


def v2_registry(spark: SparkSession, d: str) -> DataFrame:
    """A memory that took in new texts for every third document finds them no more by the old ones."""
    m = E.memory("bm25", _bank(spark, d)).extract(_bank(spark, d).filter("id % 3 = 0").select("id", F.lit("nothing").alias("text")))
    return m.retrieve(spark.createDataFrame([(0, "nothing")], "qid long, query string"), 1_000_000).select("id").filter("id % 3 = 0")


def v3_usage(spark: SparkSession, d: str) -> DataFrame:
    a = E.RecallAgent(E.WordMemory(_bank(spark, d)), 1)
    a.update(_bank(spark, d).filter("id = 0"))
    a.utilize(_asking_texts(spark, d))
    first, second = a.usage.drain(), a.usage.drain()
    return spark.createDataFrame([("first", *first), ("second", *second)], "drained string, calls int, tokens int")


def v4_provide(spark: SparkSession, d: str) -> DataFrame:
    """The best memory of each asking text that is another text than its own."""
    bank = _bank(spark, d).filter("id % 100 <> 0")
    return E.RecallAgent(E.WordMemory(bank), 1).utilize(_asking_texts(spark, d)).select("qid", F.md5("memory").alias("memory"))


def v5_inject(spark: SparkSession, d: str) -> DataFrame:
    a = E.RecallAgent(E.WordMemory(_bank(spark, d).limit(0)), 1)
    return a.utilize(_asking_texts(spark, d)).select("qid", F.char_length("memory").alias("chars"))


def v6_vector_store(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.create_map(F.lit("text"), F.concat(F.lit("vector "), "vec_id")).alias("payload"))
    s = E.VectorStore(rows).delete(rows.filter("id % 2 = 1").select("id"))
    return s.search(_asking(spark, d), 4, F.col("id") % 100 != 0).select("qid", "id", F.round("score", 4).alias("score"))


def s15_store_contract(spark: SparkSession, d: str) -> DataFrame:
    """Insert, update, delete, get by key words, list and reset."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.create_map(F.lit("text"), F.concat(F.lit("vector "), F.pmod("vec_id", F.lit(7)))).alias("payload"))
    s = E.VectorStore(rows.filter("id < 100")).insert(rows.filter("id >= 50 and id < 200"))
    s = s.update(rows.filter("id < 10").select("id", F.create_map(F.lit("text"), F.lit("patched")).alias("payload"))).delete(rows.filter("id % 10 = 9").select("id"))
    hits = s.keyword_search(spark.createDataFrame([(0, "patched")], "qid long, query string"), 1000).select(F.lit("patched").alias("step"), "id")
    return hits.unionByName(s.list(F.col("payload")["text"] == "vector 3").select(F.lit("listed").alias("step"), "id")).unionByName(s.reset().list().select(F.lit("reset").alias("step"), "id"))


def v7_graph_store(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return E.GraphStore(nodes, _edges(spark, d)).neighbours(nodes.filter("id <> 'r0'"), "out")


def v8_handlers(spark: SparkSession, d: str) -> DataFrame:
    """Handlers in the order of their priorities, each with what it counts."""
    h = E.Handlers()
    h.register("click", lambda m: m.agg(F.count("*").alias("n")), 1)
    h.register("view", lambda m: m.agg(F.count_distinct("user_id").alias("n")), 5)
    h.register("error", lambda m: m.filter("value > 50").agg(F.count("*").alias("n")), 1)
    out = None
    for k, r in enumerate(h.run(table(spark, d, "events").withColumn("label", F.col("event_type")))):
        r = r.select(F.lit(k).alias("turn"), "n")
        out = r if out is None else out.unionByName(r)
    return out


def v9_metric(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d).select("workflow_id", E.best_over_golds(X.exact_match, F.col("pred"), F.split("gold", " -> ")).alias("best"))


def v10_embedder(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by an embedder that is passed in: how many letters e and z a memory's vector counts."""
    v = E.letter_vector(F.col("text"))
    return _bank(spark, d).select("id", v[4].cast("int").alias("e"), v[25].cast("int").alias("z"))


def v11_provided(spark: SparkSession, d: str) -> DataFrame:
    """A memory installed from code: it turns the words' order of a query around and finds the same."""
    name = f"provided{id(spark)}-{len(E._memories)}"
    E.installed(name, "class Provided(WordMemory):\n    def retrieve(self, queries, k):\n        return super().retrieve(queries.withColumn('query', F.array_join(F.reverse(F.split('query', ' ')), ' ')), k)\n")
    return E.memory(name, _bank(spark, d)).retrieve(_asking_texts(spark, d), 3).select("qid", "id", "score")


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"[vs]\d+_", k)}
_OTHER = _bm25("plus", k=1).replace("FROM documents),", "FROM documents WHERE doc_id % 100 <> 0),", 1)
SQL = {
    "v1_retrieve": "WITH " + _bm25("plus", k=5) + " SELECT qid, id, score FROM top",
    "v2_registry": "SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0",
    "v3_usage": "SELECT 'first' AS drained, 2::INTEGER AS calls, 0::INTEGER AS tokens UNION ALL SELECT 'second', 0, 0",
    "v5_inject": "SELECT doc_id AS qid, 0::INTEGER AS chars FROM documents WHERE doc_id % 100 = 0",
    "v6_vector_store": "WITH " + _vec(4, "b.vec_id % 2 = 0 AND b.vec_id % 100 <> 0") + " SELECT qid, id, round(score, 4) AS score FROM sem",
    "s15_store_contract": "SELECT 'patched' AS step, vec_id AS id FROM embeddings WHERE vec_id < 9 UNION ALL SELECT 'listed', vec_id FROM embeddings WHERE vec_id BETWEEN 10 AND 199 AND vec_id % 10 <> 9 AND vec_id % 7 = 3",
    "v7_graph_store": f"WITH {_EDGE} SELECT DISTINCT src AS id, dst AS neighbour FROM edge WHERE src LIKE 'r%' AND src <> 'r0'",
    "v8_handlers": "SELECT 0::INTEGER AS turn, count(DISTINCT user_id) AS n FROM events WHERE event_type = 'view' UNION ALL SELECT 1, count(*) FROM events WHERE event_type = 'click' UNION ALL SELECT 2, count(*) FROM events WHERE event_type = 'error' AND value > 50",
    "v9_metric": f"""WITH {_FLOWS}, g AS (SELECT workflow_id, pred, unnest(string_split(gold, ' -> ')) AS g FROM flows), m AS (SELECT workflow_id, max(({_norm("coalesce(pred, '')")} = {_norm('g')})::INTEGER) AS best FROM g GROUP BY 1) SELECT workflow_id, best FROM flows LEFT JOIN m USING (workflow_id)""",
    "v10_embedder": "SELECT doc_id AS id, length(regexp_replace(lower(coalesce(text, '')), '[^e]', '', 'g'))::INTEGER AS e, length(regexp_replace(lower(coalesce(text, '')), '[^z]', '', 'g'))::INTEGER AS z FROM documents",
    "v11_provided": "WITH " + _bm25("plus", k=3) + " SELECT qid, id, score FROM top",
}
