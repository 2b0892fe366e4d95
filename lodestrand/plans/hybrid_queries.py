"""Queries of hybrid search. Documents and vectors of one number are one memory; every one whose number is divisible by 100 asks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions import scores as S
from lodestrand.operators import hybrid as H
from lodestrand.operators import retrieval as R
from lodestrand.plans.memory_queries import _QW, _asking, _asking_texts, _bm25
from lodestrand.sources.tables import table

NOW = "2025-01-01"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null")


def _bank(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.col("created_at").alias("at")), "id", "left")


def _lexical(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    return R.bm25(table(spark, d, "documents"), "doc_id", "text", _asking_texts(spark, d), k)


def _semantic(spark: SparkSession, d: str, k: int = 50, metric: str = "cosine") -> DataFrame:
    return R.search_all(table(spark, d, "embeddings"), "vec_id", "embedding", _asking(spark, d), k, metric)


def _out(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select("qid", "id", F.round("score", digits).alias("score"))


def r3_bm25_keys(spark: SparkSession, d: str) -> DataFrame:
    """BM25+ over keys: sources, whose ``_`` are spaces."""
    keys = table(spark, d, "documents").select("doc_id", F.replace(F.coalesce("source", F.lit("")), F.lit("_"), F.lit(" ")).alias("key"))
    q = keys.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("key").alias("query"))
    return R.bm25(keys, "doc_id", "key", q, 10, delta=1.0).select("qid", "id", "score", "rank")


def r5_cosine_or_zero(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "workflow_instances").groupBy("workflow_id").agg(F.min(F.struct("query_embedding", "plan_embedding")).alias("x"))
    finite = lambda v: F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < 1e30))
    a, b = F.col("x.query_embedding"), F.col("x.plan_embedding")
    return w.filter(F.coalesce(finite(a) & finite(b), F.lit(False))).select("workflow_id", F.round(R.cosine(a, b), 4).alias("cos"))


def r6_level_weights(spark: SparkSession, d: str) -> DataFrame:
    """A local rerank: cosine times the weight of the memory's level, here its kind of language."""
    hits = _semantic(spark, d, 20).join(_bank(spark, d).select("id", "lang"), "id", "left")
    weight = F.when(F.lower(F.trim("lang")) == "en", 1.0).when(F.col("lang").isNull(), 0.5).otherwise(0.8)
    return _out(R.top_k(hits.select("qid", "id", (F.col("score") * weight).alias("score")), ["qid"], 10))


def r7_filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """1 - cosine distance among English memories, those of at least 0.1."""
    bank = _bank(spark, d).filter(F.lower(F.trim("lang")) == "en").select("id", "v")
    return _out(R.search_all(bank, "id", "v", _asking(spark, d), 10).filter("score >= 0.1"))


def r10_two_levels(spark: SparkSession, d: str) -> DataFrame:
    """The 3 best sessions of each query by the mean vector of their pages, then their pages of at least 0.1."""
    pages = _bank(spark, d).select("id", "v", F.pmod("id", F.lit(25)).alias("session"))
    long = pages.select("session", F.posexplode("v").alias("p", "x")).groupBy("session", "p").agg(F.avg("x").alias("x"))
    means = long.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("v"))
    best = R.search_all(means.select(F.col("session").alias("id"), "v"), "id", "v", _asking(spark, d), 3).select("qid", F.col("id").alias("session"))
    hits = best.join(pages, "session").join(_asking(spark, d).withColumnRenamed("v", "q"), "qid").select("qid", "id", R.cosine(F.col("q"), F.col("v")).alias("score"))
    return _out(hits.filter("round(score, 6) >= 0.1"))


def r11_all_words(spark: SparkSession, d: str) -> DataFrame:
    """Documents with all of the query's words, the closer together the higher: the length of the text is the cover's bound."""
    q = spark.createDataFrame([(0, "agent ledger"), (1, "the threshold")], "qid long, query string")
    docs = _docs(spark, d).select("doc_id", R.words("text").alias("w"))
    rows = docs.join(F.broadcast(q), F.forall(R.words("query"), lambda x: F.array_contains("w", x)))
    each = F.aggregate(F.transform(R.words("query"), lambda x: F.size(F.filter("w", lambda y: y == x)).cast("double") / F.size("w")), F.lit(0.0), lambda s, x: s + x)
    return R.top_k(rows.select("qid", F.col("doc_id").alias("id"), each.alias("score")), ["qid"], 10).select("qid", "id", "score", "rank")


def r13_tfidf(spark: SparkSession, d: str) -> DataFrame:
    hits = H.tfidf(_docs(spark, d), "doc_id", "text", _asking_texts(spark, d), ("the", "and", "of"))
    return _out(R.top_k(hits.filter("qid <> id"), ["qid"], 5))


def r14_hybrid_whole(spark: SparkSession, d: str) -> DataFrame:
    bank = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return _out(H.blended_top(_docs(spark, d), "doc_id", "text", _asking_texts(spark, d), bank, _asking(spark, d), 10))


def r15_hybrid_cut(spark: SparkSession, d: str) -> DataFrame:
    """Each list is cut to 20 first; lexical scores relative to the best."""
    best = F.max("score").over(Window.partitionBy("qid"))
    lexical = _lexical(spark, d, 20).select("qid", "id", (F.col("score") / best).alias("score"))
    return _out(R.top_k(H.blended(lexical, _semantic(spark, d, 20)), ["qid"], 10))


def r16_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.rrf([_lexical(spark, d, 20), _semantic(spark, d, 20)], 10).select("qid", "id", "score", "rank")


def r19_recall_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return H.recall_pipeline(_lexical(spark, d), _semantic(spark, d), _bank(spark, d).select("id", "v", "at"), NOW).select("qid", "id", "score", "rank")


def _sigmoids(spark: SparkSession, d: str, k: int = 60) -> DataFrame:
    n = _asking_texts(spark, d).select("qid", F.size(R.words("query")).alias("words"))
    return _lexical(spark, d, k).join(n, "qid").select("qid", "id", H.bm25_sigmoid(F.col("score"), F.col("words")).alias("score"))


def m9_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    return _out(_sigmoids(spark, d, 10), 6)


def r20_additive(spark: SparkSession, d: str) -> DataFrame:
    return _out(R.additive_fusion(_semantic(spark, d, 60), _sigmoids(spark, d), None, 10))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("context_id is not null").select(F.col("context_id").alias("entity"), F.col("doc_id").alias("id"))


def _asked_entities(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").filter("doc_id % 100 = 0 and context_id is not null").select(F.col("doc_id").alias("qid"), F.col("context_id").alias("entity"))
    return own.withColumn("sim", F.when(F.pmod(F.col("qid") / 100, F.lit(2)) == 0, 1.0).otherwise(0.4))


def r22_entity_boost(spark: SparkSession, d: str) -> DataFrame:
    return _out(H.entity_boost(_entities(spark, d), _asked_entities(spark, d)), 6)


def r21_multi_signal(spark: SparkSession, d: str) -> DataFrame:
    boost = H.entity_boost(_entities(spark, d), _asked_entities(spark, d))
    return _out(R.additive_fusion(_semantic(spark, d, 60), _sigmoids(spark, d), boost, 10))


def r23_keywords(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memory_bank").groupBy("memory_id").agg(F.min("type").alias("type"), F.min("query").alias("query"), F.min("content").alias("content"))
    s = H.keyword_score(F.array(*map(F.lit, ["insight", "agent", "ledger"])), [(F.col("type"), 2.0), (F.col("query"), 1.5), (F.col("content"), 1.0)])
    return m.select("memory_id", s.alias("score")).filter("score > 0")


def r24_metadata_boost(spark: SparkSession, d: str) -> DataFrame:
    hits = _semantic(spark, d, 10).join(_bank(spark, d).select("id", "lang", "source"), "id", "left")
    return _out(H.boosted(hits, [(F.col("lang") == "en", 0.5), (F.lower(F.trim("source")) == "rulebook", 2.0)]))


def r25_paired_sources(spark: SparkSession, d: str) -> DataFrame:
    """Turns in pairs (an even event and the next one of its user), each by the sum of both values; the best 2 pairs of a user."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").withColumn("n", F.row_number().over(w)).withColumn("pair", F.floor((F.col("n") - 1) / 2))
    p = e.groupBy("user_id", "pair").agg(F.round(F.sum("value"), 6).alias("score"), F.min("event_id").alias("id"))
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), "id")
    return p.withColumn("rank", F.row_number().over(best)).filter("rank <= 2").select("user_id", "id", F.round("score", 4).alias("score"), "rank")


def r27_near_existing(spark: SparkSession, d: str) -> DataFrame:
    bank = table(spark, d, "embeddings").filter("vec_id % 100 <> 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return _out(H.near_existing(_asking(spark, d), bank, 0.3, 3))


def r30_reply_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    reply = F.when(k == 0, F.concat(F.lit("Relevance 7 of 10, so "), (F.floor("value") / 100).cast("string"))).when(k == 1, "no idea").when(k == 2, "score: 1.0").otherwise("12 or 0.25?")
    return table(spark, d, "events").select("event_id", H.reply_score(reply).alias("score"))


def r31_bounded_store(spark: SparkSession, d: str) -> DataFrame:
    """A store of the newest 100 entries a context, entries cut to 80 characters."""
    w = Window.partitionBy("context_id").orderBy(F.desc("created_at"), F.desc("doc_id"))
    rows = _docs(spark, d).filter("context_id is not null and created_at is not null").withColumn("r", F.row_number().over(w)).filter("r <= 100")
    return rows.select("doc_id", F.md5(F.left("text", F.lit(80))).alias("entry"))


def r32_spread(spark: SparkSession, d: str) -> DataFrame:
    hits = _semantic(spark, d, 30)
    return H.spread(hits.join(_bank(spark, d).select("id", "v"), "id").select("qid", "id", "score", "v"), 10, 0.4).select("qid", "id", "rank")


def r33_spread_kinds(spark: SparkSession, d: str) -> DataFrame:
    hits = _semantic(spark, d, 30).join(_bank(spark, d).select("id", "v"), "id")
    return H.spread_kinds(hits.select("qid", "id", "score", "v", F.pmod("id", F.lit(2)).cast("int").alias("kind")), 8).select("qid", "id", "rank")


def r34_back_fill(spark: SparkSession, d: str) -> DataFrame:
    hits = _semantic(spark, d, 60).withColumn("kind", F.pmod("id", F.lit(2)))
    return H.back_filled(hits.drop("rank"), 0.3, 3).select("qid", "id", "kind")


def r35_positive_only(spark: SparkSession, d: str) -> DataFrame:
    lexical = H.tfidf(_docs(spark, d), "doc_id", "text", _asking_texts(spark, d))
    n = table(spark, d, "embeddings").count()
    return _out(R.top_k(H.blended(lexical, _semantic(spark, d, n)), ["qid"], 40).filter("score > 0.2"))


def r36_first_maximum(spark: SparkSession, d: str) -> DataFrame:
    bank = table(spark, d, "embeddings").filter("vec_id % 100 <> 0")
    return _out(R.search_all(bank, "vec_id", "embedding", _asking(spark, d), 1))


def r37_cached_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have a vector in the cache, by source; the others drop out."""
    cache = table(spark, d, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").join(cache, "doc_id", "left_semi").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n"))


def r38_two_fields(spark: SparkSession, d: str) -> DataFrame:
    """At least one of two fields must match; as many points as places of the words."""
    m = table(spark, d, "memory_bank").groupBy("memory_id").agg(F.min("query").alias("query"), F.min("content").alias("content"))
    count = lambda c: sum(F.size(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(w), F.lit(0))) for w in ("agent", "ledger"))
    return m.select("memory_id", (count("query") + count("content")).cast("int").alias("score")).filter("score > 0")


def m6_recency(spark: SparkSession, d: str) -> DataFrame:
    age = (F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp("ts")) / 86400.0
    return table(spark, d, "events").select("event_id", F.round(R.recency(F.col("value") / 100, age), 6).alias("score"))


def m7_heat(spark: SparkSession, d: str) -> DataFrame:
    from lodestrand.operators.lifecycle import heat

    per = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("visits"), F.count("*").alias("pages"), F.max("value").alias("recency"))
    return per.select("user_id", F.round(heat(F.col("visits"), F.col("pages"), F.col("recency")), 4).alias("heat"))


def m8_importance(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").select("event_id", F.round(S.importance(F.col("value"), k / 10, F.col("user_id") % 4, (0.5, 0.3, 0.2)), 6).alias("score"))


def j16_batch_search(spark: SparkSession, d: str) -> DataFrame:
    return _out(_semantic(spark, d, 3, "ip"))


def t4_by_distance(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(spark, d, 5, "l2").select("qid", "id", F.round(-F.col("score"), 4).alias("distance"))


def j15_words_to_rows(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the word index back to their rows, of which only those with a language stay."""
    return _lexical(spark, d, 20).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "id").filter("lang is not null").select("qid", "id", "lang")


def j18_linked(spark: SparkSession, d: str) -> DataFrame:
    """Hits, then what they link to (the next two numbers), up to 12 a query."""
    hits = _semantic(spark, d, 4).select("qid", "id", F.col("rank").alias("r"))
    links = hits.select("qid", F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("id"), (F.col("r") + 100).alias("r"))
    links = links.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_semi").select("qid", "id", "r")
    first = hits.unionByName(links).groupBy("qid", "id").agg(F.min("r").alias("r"))
    w = Window.partitionBy("qid").orderBy("r", "id")
    return first.withColumn("rank", F.row_number().over(w)).filter("rank <= 12").select("qid", "id", "rank")


def r8_approximate(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by random projections: what shares a bucket with a query, exactly ranked."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = lambda x, key: x.select(F.col(key).alias("id"), array_to_vector(F.transform("v", lambda y: y.cast("double"))).alias("x"))
    bank = rows(_bank(spark, d).filter("v is not null"), "id")
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=1.0, numHashTables=6, seed=11).fit(bank)
    near = model.approxSimilarityJoin(rows(_asking(spark, d), "qid"), bank, 1.3, "distance")
    hits = near.select(F.col("datasetA.id").alias("qid"), F.col("datasetB.id").alias("id"), (-F.col("distance")).alias("score")).distinct()
    return _out(R.top_k(hits, ["qid"], 5)).select("qid", "id", F.abs("score").alias("distance"))


def r28_cluster_tree(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of vectors by Gaussian mixtures, then clusters of their means: ``level``, ``cluster`` and how many it holds."""
    return H.cluster_tree(_bank(spark, d).filter("v is not null").select("id", "v"), 10).groupBy("level", "cluster").agg(F.count("*").alias("n"))


def f13_vector_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the vectors of prediction and reference, these being input columns: of each document and the next."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(w, "vec_id").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("next")), 4).alias("cos"))


def d15_evolved(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest of every asking memory take on its tag; updates go by id."""
    tag = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower(F.trim("source")).alias("tag"))
    hits = _semantic(spark, d, 5)
    new = hits.join(tag.withColumnRenamed("id", "qid"), "qid").select("id", "tag")
    every = tag.join(hits.select("id").distinct(), "id", "left_semi").unionByName(new).filter("tag is not null")
    return every.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"[rmjtfd]\d+_", k)}


def _vec(k: int, where: str = "true", measure: str = "list_cosine_similarity", name: str = "sem", order: str = "DESC") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT a.vec_id AS qid, b.vec_id AS id, round({measure}(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND {where})
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score {order}, id) <= {k})"""


def _tfidf(stop: str = "") -> str:
    words = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN (" + (stop or "''") + "))"
    return f"""dw AS (SELECT doc_id AS id, {words.format('text')} AS w FROM documents WHERE text IS NOT NULL), post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM dw) GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM dw),
        idf AS (SELECT term, ln((1 + n)::DOUBLE / (1 + count(*))) + 1 AS idf FROM post, n GROUP BY term, n), x AS (SELECT id, term, tf * idf AS x FROM post JOIN idf USING (term)), nx AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM x),
        lex AS (SELECT a.id AS qid, b.id, sum(a.x * b.x) AS score FROM nx a JOIN nx b USING (term) WHERE a.id % 100 = 0 GROUP BY 1, 2)"""


_TOP = "(SELECT * FROM (SELECT qid, id, round(score, 6) AS score FROM {0}) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= {1})"
_BLEND = "bl AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, 0.5 * coalesce(a.score, 0) + 0.5 * coalesce(b.score, 0) AS score FROM {0} a FULL JOIN sem b ON a.qid = b.qid AND a.id = b.id)"
_R4 = "SELECT qid, id, round(score, 4) AS score FROM "
_SIG = "sig AS (SELECT t.qid, t.id, 1 / (1 + exp(-(CASE WHEN n <= 3 THEN 0.7 WHEN n <= 6 THEN 0.6 ELSE 0.5 END) * (score - CASE WHEN n <= 3 THEN 5.0 WHEN n <= 6 THEN 7.0 WHEN n <= 9 THEN 9.0 WHEN n <= 15 THEN 10.0 ELSE 12.0 END)))::DOUBLE AS score FROM top t JOIN (SELECT doc_id AS qid, len(list_filter(string_split_regex(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> '')) AS n FROM documents WHERE doc_id % 100 = 0) USING (qid))"
_KEY = "replace(coalesce(source, ''), '_', ' ')"
_ENT = "boost AS (SELECT a.doc_id AS qid, b.doc_id AS id, 0.5 / (1 + 0.001 * (n - 1) * (n - 1))::DOUBLE AS score FROM documents a JOIN documents b USING (context_id) JOIN (SELECT context_id, count(*) AS n FROM documents GROUP BY 1) USING (context_id) WHERE a.doc_id % 200 = 0)"
SQL = {
    "r3_bm25_keys": "WITH " + _bm25("plus", _KEY, f"q(qid, query) AS (SELECT doc_id, {_KEY} FROM documents WHERE doc_id % 100 = 0)").replace("(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))", "(1.0 + tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))") + " SELECT qid, id, score, rank FROM top",
    "r5_cosine_or_zero": """WITH w AS (SELECT workflow_id, min(query_embedding) AS a, min(plan_embedding) AS b, count(DISTINCT query_embedding) AS n FROM workflow_instances GROUP BY 1) SELECT workflow_id, round(CASE WHEN len(a) = len(b) AND list_inner_product(a::DOUBLE[], a::DOUBLE[]) > 0 AND list_inner_product(b::DOUBLE[], b::DOUBLE[]) > 0 THEN list_inner_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_inner_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_inner_product(b::DOUBLE[], b::DOUBLE[]))) ELSE 0 END, 4) AS cos
        FROM w WHERE len(list_filter(a, lambda x: isnan(x) OR x IS NULL OR abs(x) >= 1e30)) = 0 AND len(list_filter(b, lambda x: isnan(x) OR x IS NULL OR abs(x) >= 1e30)) = 0""",
    "r6_level_weights": "WITH " + _vec(20) + ", w AS (SELECT qid, id, score * CASE WHEN lower(trim(lang)) = 'en' THEN 1.0::DOUBLE WHEN lang IS NULL THEN 0.5 ELSE 0.8 END AS score FROM sem LEFT JOIN documents ON doc_id = id) " + _R4 + _TOP.format("w", 10),
    "r7_filtered_search": "WITH " + _vec(10, "b.vec_id IN (SELECT doc_id FROM documents WHERE lower(trim(lang)) = 'en')") + " " + _R4 + "sem WHERE score >= 0.1",
    "r11_all_words": """WITH q(qid, a, b) AS (VALUES (0::BIGINT, 'agent', 'ledger'), (1, 'the', 'threshold')), d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
        s AS (SELECT qid, id, round((len(list_filter(w, lambda x: x = a)) + len(list_filter(w, lambda x: x = b)))::DOUBLE / len(w), 6) AS score FROM q, d WHERE list_contains(w, a) AND list_contains(w, b)) SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 10""",
    "r13_tfidf": "WITH " + _tfidf("'the', 'and', 'of'") + " " + _R4 + _TOP.format("lex WHERE qid <> id", 5),
    "r14_hybrid_whole": "WITH " + _tfidf() + ", " + _vec(1_000_000) + ", " + _BLEND.format("lex") + " " + _R4 + _TOP.format("bl", 10),
    "r15_hybrid_cut": "WITH " + _bm25("plus", k=20) + ", lx AS (SELECT qid, id, score / max(score) OVER (PARTITION BY qid) AS score FROM top), " + _vec(20) + ", " + _BLEND.format("lx") + " " + _R4 + _TOP.format("bl", 10),
    "r16_rank_fusion": "WITH " + _bm25("plus", k=20) + ", " + _vec(20) + """, u AS (SELECT qid, id, rank FROM top UNION ALL SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) FROM sem)
        SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank FROM (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM u GROUP BY 1, 2) QUALIFY rank <= 10""",
    "m9_sigmoid": "WITH " + _bm25("plus", k=10) + ", " + _SIG + " SELECT qid, id, round(score, 6) AS score FROM sig",
    "r20_additive": "WITH " + _bm25("plus", k=60) + ", " + _SIG + ", " + _vec(60) + ", f AS (SELECT s.qid, s.id, least(1.0, (s.score + coalesce(g.score, 0)) / (1 + CASE WHEN s.qid IN (SELECT qid FROM sig) THEN 1 ELSE 0 END)) AS score FROM sem s LEFT JOIN sig g USING (qid, id) WHERE s.score >= 0.1) " + _R4 + _TOP.format("f", 10),
    "r21_multi_signal": "WITH " + _bm25("plus", k=60) + ", " + _SIG + ", " + _vec(60) + ", " + _ENT + ", f AS (SELECT s.qid, s.id, least(1.0, (s.score + coalesce(g.score, 0) + coalesce(e.score, 0)) / (1 + CASE WHEN s.qid IN (SELECT qid FROM sig) THEN 1 ELSE 0 END + CASE WHEN s.qid IN (SELECT qid FROM boost) THEN 0.5::DOUBLE ELSE 0 END)) AS score FROM sem s LEFT JOIN sig g USING (qid, id) LEFT JOIN boost e USING (qid, id) WHERE s.score >= 0.1) " + _R4 + _TOP.format("f", 10),
    "r22_entity_boost": "WITH " + _ENT + " SELECT qid, id, round(score, 6) AS score FROM boost",
    "r23_keywords": """WITH m AS (SELECT memory_id, lower(coalesce(min(type), '')) AS t, lower(coalesce(min(query), '')) AS q, lower(coalesce(min(content), '')) AS c FROM memory_bank GROUP BY 1), s AS (SELECT memory_id, list_sum(list_transform(['insight', 'agent', 'ledger'], lambda w: CASE WHEN contains(t, w) THEN 2.0 WHEN contains(q, w) THEN 1.5 WHEN contains(c, w) THEN 1.0 ELSE 0 END::DOUBLE)) AS score FROM m) SELECT * FROM s WHERE score > 0""",
    "r24_metadata_boost": "WITH " + _vec(10) + " SELECT qid, id, round(greatest(0, least(1, score * CASE WHEN lang = 'en' THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN lower(trim(source)) = 'rulebook' THEN 3 ELSE 1 END)), 4) AS score FROM sem LEFT JOIN documents ON doc_id = id",
    "r25_paired_sources": """WITH e AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 2 AS pair FROM events), p AS (SELECT user_id, pair, round(sum(value), 6) AS score, min(event_id) AS id FROM e GROUP BY 1, 2)
        SELECT user_id, id, round(score, 4) AS score, row_number() OVER (PARTITION BY user_id ORDER BY p.score DESC, id)::INTEGER AS rank FROM p QUALIFY rank <= 2""",
    "r27_near_existing": "WITH " + _vec(3, "b.vec_id % 100 <> 0") + " " + _R4 + "sem WHERE score >= 0.3",
    "r30_reply_scores": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN floor(value) <= 100 THEN floor(value) / 100 ELSE 0.5 END WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 0.25 END AS score FROM events",
    "r31_bounded_store": "SELECT doc_id, md5(text[1:80]) AS entry FROM documents WHERE text IS NOT NULL AND context_id IS NOT NULL AND created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY context_id ORDER BY created_at DESC, doc_id DESC) <= 100",
    "r34_back_fill": "WITH " + _vec(60) + " SELECT qid, id, id % 2 AS kind FROM sem QUALIFY score >= 0.3 OR row_number() OVER (PARTITION BY qid, id % 2 ORDER BY score DESC, id) <= 3",
    "r35_positive_only": "WITH " + _tfidf() + ", " + _vec(1_000_000) + ", " + _BLEND.format("lex") + " " + _R4 + _TOP.format("bl", 40) + " WHERE score > 0.2",
    "r36_first_maximum": "WITH " + _vec(1, "b.vec_id % 100 <> 0") + " " + _R4 + "sem",
    "r37_cached_vectors": "SELECT lower(trim(source, ' ')) AS source, count(*) AS n FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings) GROUP BY 1",
    "r38_two_fields": """WITH m AS (SELECT memory_id, lower(coalesce(min(query), '')) AS q, lower(coalesce(min(content), '')) AS c FROM memory_bank GROUP BY 1), s AS (SELECT memory_id, len(regexp_extract_all(q, 'agent|ledger')) + len(regexp_extract_all(c, 'agent|ledger')) AS score FROM m) SELECT memory_id, score::INTEGER AS score FROM s WHERE score > 0""",
    "m6_recency": "SELECT event_id, round(value / 100 * (0.3 + 0.7::DOUBLE * pow(0.5, greatest((epoch(TIMESTAMP '2025-01-01') - epoch(date_trunc('second', ts))) / 86400.0, 0) / 14.0)), 6) AS score FROM events",
    "m7_heat": "SELECT user_id, round(count(*) FILTER (WHERE event_type = 'view') + count(*) + max(value), 4) AS heat FROM events GROUP BY 1",
    "m8_importance": "SELECT event_id, round(0.5 * value + 0.3 * least(json_extract(props, '$.k')::DOUBLE / 10 * 0.3, 5) + 0.2 * least(user_id % 4 * 0.2, 2), 6) AS score FROM events",
    "j16_batch_search": "WITH " + _vec(3, measure="list_inner_product") + " " + _R4 + "sem",
    "t4_by_distance": "WITH " + _vec(5, measure="list_distance", order="ASC") + " SELECT qid, id, round(score, 4) AS distance FROM sem",
    "j15_words_to_rows": "WITH " + _bm25("plus", k=20) + " SELECT qid, id, lang FROM top JOIN documents ON doc_id = id WHERE lang IS NOT NULL",
    "f13_vector_similarity": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "d15_evolved": "WITH " + _vec(5) + """, t AS (SELECT doc_id AS id, lower(trim(source, ' ')) AS tag FROM documents), u AS (SELECT s.id, t.tag FROM sem s JOIN t ON t.id = s.qid UNION SELECT id, tag FROM t WHERE id IN (SELECT id FROM sem)) SELECT id, string_agg(tag, ',' ORDER BY tag) AS tags FROM u WHERE tag IS NOT NULL GROUP BY 1""",
    "j18_linked": "WITH " + _vec(4) + """, h AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM sem), l AS (SELECT qid, id + s AS id, r + 100 AS r FROM h, (VALUES (1), (2)) t(s)), u AS (SELECT qid, id, min(r) AS r FROM (SELECT * FROM h UNION ALL SELECT * FROM l WHERE id IN (SELECT vec_id FROM embeddings)) GROUP BY 1, 2)
        SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY r, id)::INTEGER AS rank FROM u QUALIFY rank <= 12""",
}
