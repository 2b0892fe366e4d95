"""Lexical and vector retrieval, fusion and reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators.scan import Block, Weigh, counted_words, top_words
from lodestrand.session import cut

K1, B = 1.5, 0.75
BLOCK = 512


FEW = 500_000  # rows of queries' terms that may go to every task


def words(text: Column | str, lower: bool = True) -> Column:
    """The words between white space, none for a null."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.filter(F.split(F.lower(c) if lower else c, r"\s+"), lambda w: w != "")


def small(df: DataFrame, rows: int, limit: int = FEW) -> DataFrame:
    """With a broadcast hint if it was counted and has ``limit`` rows or fewer."""
    return F.broadcast(df) if rows <= limit else df


def bm25(
    docs: DataFrame, id_: str, text: str, queries: DataFrame, k: int = 10, idf: str = "plus", delta: float = 0.0, lower: bool = True, later_first: bool = False, k1: float = K1, b: float = B
) -> DataFrame:
    """Top k documents of each query: ``qid``, ``id``, ``score``, ``rank``.

    ``queries`` has ``qid`` and ``query``. One pass over the texts counts their words; in another the queries go to every task, block by block, and
    each task sends the best k of its documents only: no pair of query and document is shuffled. Documents with the same id, or none, are one with
    the scores of all; these few are joined instead. A term that a query repeats counts as often. ``idf`` "plus" is ln((N - n + .5) / (n + .5) + 1), never negative;
    "okapi" lacks the 1 and takes a quarter of the mean idf for negative ones. Ties go to the smaller id, or to
    the larger one if ``later_first``. Queries without a hit give no rows, and neither do null texts.
    """
    q = cut(queries.select("qid", F.explode(words("query", lower)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qn")))
    terms = cut(q.select("term").distinct())
    n_t = terms.count()
    only = terms.toArrow()["term"].combine_chunks() if idf != "okapi" and n_t <= FEW else None  # for the mean of "okapi" all words count
    c = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_).alias("id"), (F.lower(c) if lower else c).alias("w"))
    counted = cut(counted_words(rows, only))
    each_id = counted.filter("dl is not null").groupBy("id").agg(F.count("*").alias("n"), F.sum("dl").alias("dl"))
    again = F.col("id").isNull() | (F.col("n") > 1)
    total, length, repeated = each_id.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("dl"), F.lit(0)), F.count_if(again)).first()
    avgdl = length / total if length else 1.0
    df = counted.filter("dl is null").groupBy("term").agg(F.sum("n").alias("n"))
    df = df.withColumn("idf", F.log((total - F.col("n") + 0.5) / (F.col("n") + 0.5) + (1 if idf == "plus" else 0)))
    if idf == "okapi":
        df = cut(df)
        mean = df.agg(F.avg("idf")).first()[0] or 0.0
        df = df.withColumn("idf", F.when(F.col("idf") < 0, 0.25 * mean).otherwise(F.col("idf")))
        df = df.join(small(terms, n_t), "term", "left_semi")
    asked = cut(q.join(df, "term").select("qid", "term", (F.col("qn") * F.col("idf")).alias("y"), "n"))

    def weigh(_: Block) -> Weigh:
        return lambda doc, word, tf, dl, batch: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / avgdl)) + delta

    found = rows
    if repeated:
        ids = small(cut(each_id.filter(again).select(F.col("id").alias("own"))), repeated)
        same = F.col("id").eqNullSafe(F.col("own"))
        rows, found = found.join(ids, same, "left_semi"), found.join(ids, same, "left_anti")
    scored = top_words(found, asked, total, weigh, k, later_first)
    if repeated:
        rows = rows.select("id", words("w", False).alias("w"))
        post = rows.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(small(terms, n_t), "term", "left_semi").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
        tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl)) + delta
        scored = scored.unionByName(post.join(asked, "term").groupBy("qid", "id").agg(F.sum(F.col("y") * tf).alias("score")))
    return cut(top_k(scored, ["qid"], k, later_first=later_first))


def top_k(scored: DataFrame, by: list[str], k: int, digits: int = 6, later_first: bool = False) -> DataFrame:
    """Best k by rounded score, ties to the smaller id, or to the larger one."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("id") if later_first else F.asc("id"))
    return scored.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths, nulls and zero vectors."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def exact_search(bank: DataFrame, id_: str, vector: str, queries: np.ndarray, qids: list, k: int = 10, metric: str = "cosine") -> DataFrame:
    """Top k of each of a bounded set of query vectors (they go to every task), by blocks of the bank:
    each Arrow batch sends at most k candidates a query. ``metric``: cosine, ip or l2 (as a negative distance)."""
    q = np.asarray(queries, np.float64)
    if metric == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def part(batches):
        for b in batches:
            b = b[[v is not None and len(v) == q.shape[1] for v in b["v"]]]
            if not len(b):
                continue
            x, ids = np.stack(b["v"].to_numpy()).astype(np.float64), b["id"].to_numpy()
            if metric == "cosine":
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
            s = q @ x.T if metric != "l2" else -np.sqrt(np.maximum(((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T), 0))
            s = np.round(s, 6)
            for i, row in enumerate(s):
                best = np.lexsort([ids, -row])[:k]
                yield pd.DataFrame({"qid": qids[i], "id": ids[best], "score": row[best]})

    rows = bank.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v")).mapInPandas(part, "qid long, id long, score double")
    return top_k(rows, ["qid"], k)


def search_all(bank: DataFrame, id_: str, vector: str, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """Top k of any number of queries (``qid``, unique, and ``v``): ``exact_search`` by blocks of about ``BLOCK``, of which
    the driver holds one at a time. A query without a vector gives no rows; one meets vectors of its length only."""
    q, out = queries.filter(F.col("v").isNotNull()).select(F.col("qid").cast("long").alias("qid"), "v"), None
    for dim, n in q.groupBy(F.size("v")).count().collect():
        blocks = -(-n // BLOCK)
        for b in range(blocks):
            rows = q.filter((F.size("v") == dim) & (F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)).collect()
            if not rows:
                continue
            hits = exact_search(bank, id_, vector, [r["v"] for r in rows], [r["qid"] for r in rows], k, metric)
            hits = cut(hits) if blocks > 1 else hits
            out = hits if out is None else out.unionByName(hits)
    return out if out is not None else bank.sparkSession.createDataFrame([], "qid long, id long, score double, rank int")


def rrf(lists: list[DataFrame], k: int, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (``qid``, ``id``, ``rank``): the sum of 1 / (c + rank)."""
    union = lists[0].select("qid", "id", "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select("qid", "id", "rank"))
    return top_k(union.groupBy("qid", "id").agg(F.sum(1.0 / (c + F.col("rank"))).alias("score")), ["qid"], k)


def additive_fusion(semantic: DataFrame, lexical: DataFrame, entity: DataFrame | None, k: int, threshold: float = 0.1) -> DataFrame:
    """(semantic + lexical + entity) / the most that could be reached, at most 1; the threshold is on the
    semantic score alone. The divisor is 1, plus 1 if there is any lexical and 0.5 if any entity score."""
    parts = [semantic.select("qid", "id", F.col("score").alias("s")).filter(F.col("s") >= threshold), lexical.select("qid", "id", F.col("score").alias("b"))]
    rows = parts[0].join(parts[1], ["qid", "id"], "left")
    any_b = lexical.groupBy("qid").agg(F.lit(1.0).alias("has_b"))
    rows = rows.join(any_b, "qid", "left")
    if entity is not None:
        rows = rows.join(entity.select("qid", "id", F.col("score").alias("e")), ["qid", "id"], "left").join(entity.groupBy("qid").agg(F.lit(0.5).alias("has_e")), "qid", "left")
    else:
        rows = rows.withColumn("e", F.lit(0.0)).withColumn("has_e", F.lit(0.0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    fused = F.least(F.lit(1.0), (F.col("s") + z("b") + z("e")) / (1.0 + z("has_b") + z("has_e")))
    return top_k(rows.select("qid", "id", fused.alias("score")), ["qid"], k)


def sigmoid(raw: Column, midpoint: float, steepness: float) -> Column:
    return 1.0 / (1.0 + F.exp(-steepness * (raw - midpoint)))


def recency(score: Column, age_days: Column, half_life: float = 14.0) -> Column:
    """The score times 0.3 + 0.7 * 0.5^(age / half life); a negative age is 0."""
    return score * (0.3 + 0.7 * F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life))


def mmr(cands: DataFrame, k: int, lam: float = 0.7) -> DataFrame:
    """Maximal marginal relevance within each query's candidates (``qid``, ``id``, ``score``, ``v``), which
    are few: greedily the best of lam * score - (1 - lam) * the greatest cosine to what was chosen. A missing
    vector is like nothing. Ties go to the earlier score, then the smaller id."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        dim = max((len(v) for v in rows["v"] if v is not None), default=1)
        x = np.stack([np.asarray(v, float) if v is not None and len(v) == dim else np.zeros(dim) for v in rows["v"]])
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        s, near, left, out = rows["score"].to_numpy(float), np.zeros(len(rows)), np.ones(len(rows), bool), []
        while len(out) < min(k, len(rows)):
            gain = np.where(left, lam * s - (1 - lam) * near, -np.inf)
            i = int(gain.argmax())
            out.append(i)
            left[i] = False
            near = np.maximum(near, x @ x[i])
        return pd.DataFrame({"qid": rows["qid"].iloc[out].to_numpy(), "id": rows["id"].iloc[out].to_numpy(), "score": s[out], "rank": range(1, len(out) + 1)})

    return cands.groupBy("qid").applyInPandas(pick, "qid long, id long, score double, rank int")
