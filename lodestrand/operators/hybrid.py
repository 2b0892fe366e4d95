"""Search by several signals: lexical, vector, entities, recency; and choices among ranked candidates.

Scores are tables ``qid``, ``id``, ``score``. Candidates of a query are few (a stated pool each), so what is greedy
runs a query at a time; all that meets the whole bank is joined or aggregated.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.operators import retrieval as R
from lodestrand.operators.scan import Block, Weigh, top_words
from lodestrand.session import cut


KNOWN = 2_000_000  # words that may go to every task


def _runs(column: str, stop: tuple[str, ...] = ()) -> Column:
    runs = F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(runs, lambda w: ~w.isin(*stop)) if stop else runs


def tfidf(docs: DataFrame, id_: str, text: str, queries: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """Cosine of TF-IDF vectors, for all pairs of query and document with a word in common: ``qid``, ``id``, ``score``.

    Words are runs of two or more letters, digits or ``_`` of the lower-case text, without ``stop``. The weight is tf (ln((1 + n) /
    (1 + df)) + 1); vectors have unit length. Words of a query that no document has don't count.
    """
    words = lambda c: _runs(c, stop)
    rows = docs.select(F.col(id_).alias("id"), words(text).alias("w"))
    n = rows.count()
    df = cut(rows.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    df = R.small(df.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf")), df.count())

    def weighed(each: DataFrame, key: str) -> DataFrame:
        w = each.select(key, F.explode("w").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")).join(df, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("x"))
        return w.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key))))

    q = cut(weighed(queries.select("qid", words("query").alias("w")), "qid"))
    q = R.small(q.select("qid", "term", F.col("x").alias("y")), q.count())
    return weighed(rows, "id").join(q, "term").groupBy("qid", "id").agg(F.sum(F.col("x") * F.col("y")).alias("score"))


def blended_top(docs: DataFrame, id_: str, text: str, queries: DataFrame, bank: DataFrame, asking: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """The best k of each query by ``blended`` scores of ``tfidf`` and of the cosine, over all pairs that have a word in common or two vectors of one
    length, none of which is shuffled: ``qid``, ``id``, ``score``, ``rank``. ``bank`` has ``id`` and ``v``, ``asking`` ``qid``, unique, and ``v``.

    Words of two documents or more go to every task, as well as the queries, so that a task has the length of its documents' vectors; of more
    than ``KNOWN`` words the lengths are joined instead.
    """
    rows = docs.select(F.col(id_).cast("long").alias("id"), _runs(text).alias("w"))
    ids = rows.groupBy("id").agg(F.count("*").alias("n"))
    again = F.col("id").isNull() | (F.col("n") > 1)
    n, repeated = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(again)).first()
    idf = lambda df: F.log((1.0 + n) / (1.0 + df)) + 1
    df = cut(rows.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).withColumn("idf", idf(F.col("n"))))
    q = queries.select(F.col("qid").cast("long").alias("qid"), F.explode(_runs("query")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("tf"))
    q = q.join(df, "term").withColumn("x", F.col("tf") * F.col("idf"))
    asked = cut(q.select("qid", "term", (weight * F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("qid")))).alias("y"), "n"))
    if repeated:  # documents with the same id are one
        own = R.small(cut(ids.filter(again).select(F.col("id").alias("own"))), repeated)
        same = F.col("id").eqNullSafe(F.col("own"))
        rows = rows.join(own, same, "left_anti").unionByName(rows.join(own, same, "left_semi").groupBy("id").agg(F.flatten(F.collect_list("w")).alias("w")))
    often, others, weights = df.filter("n > 1"), None, np.zeros(0)
    if often.count() <= KNOWN:
        got = often.select("term", "idf").toArrow()
        others, weights = got["term"].combine_chunks(), got["idf"].to_numpy()
    else:
        each = rows.select("id", F.explode("w").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf")).join(df, "term")
        norms = each.groupBy(F.col("id").alias("own")).agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2)))).alias("norm"))
        rows = rows.join(norms, F.col("id").eqNullSafe(F.col("own")), "left").drop("own")

    def weigh(b: Block) -> Weigh:
        by = [np.log((1.0 + n) / (1.0 + b.n)) + 1]
        if others is not None:
            by.append(weights[pc.invert(pc.is_in(others, value_set=b.words)).to_numpy(zero_copy_only=False)])
        by = np.concatenate([*by, [np.log((1.0 + n) / 2.0) + 1]])  # the last is that of words which one document has

        def of(doc: np.ndarray, word: np.ndarray, tf: np.ndarray, _: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            x = tf * by[word]
            norm = np.sqrt(np.bincount(doc, x * x, len(batch))) if others is not None else batch.column("norm").to_numpy(zero_copy_only=False)
            return x / norm[doc]

        return of

    bank = bank.select(F.col("id").cast("long").alias("id"), "v").filter("v is not null")
    alone = bank.join(rows.select("id"), "id", "left_anti").select("id", F.array().cast("array<string>").alias("w"), *([] if others is not None else [F.lit(None).cast("double").alias("norm")]), "v")
    both = rows.join(R.small(bank, bank.count()), "id", "left").select(*rows.columns, "v").unionByName(alone)
    asking = asking.select(F.col("qid").cast("long").alias("qid"), "v").filter("v is not null")
    return R.top_k(top_words(both, asked, n, weigh, k, others=others, asking=asking, beside=1 - weight), ["qid"], k)


def blended(lexical: DataFrame, semantic: DataFrame, weight: float = 0.5) -> DataFrame:
    """``weight`` times the lexical plus the rest times the semantic score; what one of them lacks is 0."""
    both = lexical.select("qid", "id", F.col("score").alias("a")).join(semantic.select("qid", "id", F.col("score").alias("b")), ["qid", "id"], "full")
    return both.select("qid", "id", (weight * F.coalesce("a", F.lit(0.0)) + (1 - weight) * F.coalesce("b", F.lit(0.0))).alias("score"))


def entity_boost(entities: DataFrame, asked: DataFrame, least: float = 0.5, most: float = 0.5) -> DataFrame:
    """The greatest boost that an entity of a query gives to each of its memories: ``qid``, ``id``, ``score``.

    ``entities`` has ``entity`` and ``id``, ``asked`` has ``qid``, ``entity`` and ``sim``. Similarities below ``least`` count for
    nothing; an entity with n memories gives sim x most / (1 + 0.001 (n - 1)^2).
    """
    size = entities.groupBy("entity").agg(F.count("*").alias("n"))
    near = asked.filter(F.col("sim") >= least).join(size, "entity").select("qid", "entity", (F.col("sim") * most / (1 + 0.001 * (F.col("n") - 1) * (F.col("n") - 1))).alias("b"))
    return entities.join(near, "entity").groupBy("qid", "id").agg(F.max("b").alias("score"))


#: Middle and steepness of the sigmoid for raw lexical scores, by the number of the query's words.
SIGMOIDS = [(3, 5.0, 0.7), (6, 7.0, 0.6), (9, 9.0, 0.5), (15, 10.0, 0.5), (None, 12.0, 0.5)]


def bm25_sigmoid(raw: Column, words: Column) -> Column:
    """A raw lexical score between 0 and 1, by the length of its query."""
    of = lambda k: F.coalesce(*[F.when(words <= row[0], row[k]) for row in SIGMOIDS if row[0]], F.lit(SIGMOIDS[-1][k]))
    return 1.0 / (1.0 + F.exp(-of(2) * (raw - of(1))))


def recall_pipeline(lexical: DataFrame, semantic: DataFrame, bank: DataFrame, now: str, k: int = 10, pool: int = 5, least: float = 0.3, half_life: float = 14.0) -> DataFrame:
    """Lists of ``pool`` x k of both kinds (``rank``) fused by reciprocal ranks, 2 k of them spread by marginal relevance, aged, those
    below ``least`` of the best dropped, and scores given relative to the best: ``qid``, ``id``, ``score``, ``rank``. ``bank`` has ``id``, ``v``, ``at``."""
    fused = R.rrf([lexical.filter(F.col("rank") <= pool * k), semantic.filter(F.col("rank") <= pool * k)], pool * k)
    spread = R.mmr(fused.join(bank.select("id", "v"), "id", "left").select("qid", "id", "score", "v"), 2 * k)
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("at")) / 86400.0
    aged = spread.join(bank.select("id", "at"), "id", "left").select("qid", "id", R.recency(F.col("score"), F.coalesce(age, F.lit(0.0)), half_life).alias("score"))
    best = F.max("score").over(Window.partitionBy("qid"))
    return R.top_k(aged.select("qid", "id", (F.col("score") / best).alias("score")).filter(F.col("score") >= least), ["qid"], k)


def spread(cands: DataFrame, k: int, similar: float = 0.92) -> DataFrame:
    """By falling score, each candidate (``qid``, ``id``, ``score``, ``v``) whose cosine to all that were kept is at most ``similar``, k at most."""

    def pick(x: np.ndarray, score: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in range(len(x)):
            if len(out) < k and (not out or (x[out] @ x[i]).max() <= similar):
                out.append(i)
        return out

    return _picked(cands, pick)


def spread_kinds(cands: DataFrame, k: int, lam: float = 0.8, prefill: int = 2) -> DataFrame:
    """Marginal relevance over two kinds of memories (``kind`` 0 and 1): the best ``prefill`` of each first."""

    def pick(rows: pd.DataFrame, x: np.ndarray) -> list[int]:
        out = [i for kind in (0, 1) for i in np.flatnonzero(rows["kind"].to_numpy() == kind)[:prefill].tolist()][:k]
        score, left = rows["score"].to_numpy(float), np.ones(len(rows), bool)
        left[out] = False
        while len(out) < min(k, len(rows)):
            near = (x @ x[out].T).max(1) if out else np.zeros(len(rows))
            i = int(np.where(left, lam * score - (1 - lam) * near, -np.inf).argmax())
            out.append(i)
            left[i] = False
        return out

    return _picked(cands, pick, True)


def _picked(cands: DataFrame, pick: Callable, whole: bool = False) -> DataFrame:
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        dim = max((len(v) for v in rows["v"] if v is not None), default=1)
        x = np.stack([np.asarray(v, float) if v is not None and len(v) == dim else np.zeros(dim) for v in rows["v"]])
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        out = pick(rows, x) if whole else pick(x, rows["score"].to_numpy(float))
        return pd.DataFrame({"qid": rows["qid"].iloc[out].to_numpy(), "id": rows["id"].iloc[out].to_numpy(), "score": rows["score"].iloc[out].to_numpy(float), "rank": range(1, len(out) + 1)})

    return cands.groupBy("qid").applyInPandas(of, "qid long, id long, score double, rank int")


def back_filled(scored: DataFrame, least: float, at_least: int) -> DataFrame:
    """Of each query and ``kind``: all of at least ``least``, and the best others until there are ``at_least``."""
    w = Window.partitionBy("qid", "kind").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter((F.col("score") >= least) | (F.col("rank") <= at_least))


def boosted(scored: DataFrame, matches: list[tuple[Column, float]]) -> DataFrame:
    """The score times 1 + weight for every condition that holds, between 0 and 1."""
    s = F.col("score")
    for hit, weight in matches:
        s = F.when(F.coalesce(hit, F.lit(False)), s * (1 + weight)).otherwise(s)
    return scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def reply_score(c: Column, missing: float = 0.5) -> Column:
    """The first number in [0, 1] of a reply; ``missing`` where there is none."""
    hits = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.try_cast("double"))
    return F.coalesce(F.try_element_at(F.filter(hits, lambda x: x.between(0, 1)), F.lit(1)), F.lit(missing))


def keyword_score(words: Column, fields: list[tuple[Column, float]]) -> Column:
    """For each word of a query the weight of the first field that contains it, summed."""
    def of(w: Column) -> Column:
        return F.coalesce(*[F.when(F.lower(F.coalesce(c, F.lit(""))).contains(w), weight) for c, weight in fields], F.lit(0.0))

    return F.aggregate(F.transform(words, of), F.lit(0.0), lambda s, x: s + x)


def near_existing(new: DataFrame, bank: DataFrame, least: float, k: int = 1) -> DataFrame:
    """For each new vector (``qid``, ``v``) the k nearest of the bank (``id``, ``v``) of cosine ``least`` or more."""
    return R.search_all(bank, "id", "v", new, k).filter(F.col("score") >= least)


def first_of_similar(rows: DataFrame, by: str, id_: str, text: str, most: float, window: int = 512) -> DataFrame:
    """Ids that stay when, within each group in the order of ids, a text goes that is like an earlier one that stayed: the cosine of their TF-IDF
    vectors (over the group's texts) is ``most`` or more. A group is a pool of candidates; one of more than ``window`` texts is taken in runs of that many."""

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        import re
        from collections import Counter
        from math import log

        part = part.sort_values("id")
        counts = [Counter(re.findall(r"\w\w+", t.lower())) for t in part["text"]]
        df = Counter(w for c in counts for w in c)
        at = {w: i for i, w in enumerate(df)}
        x = np.zeros((len(part), max(1, len(at))), np.float32)
        for i, c in enumerate(counts):
            for w, n in c.items():
                x[i, at[w]] = n * (log((1 + len(part)) / (1 + df[w])) + 1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        kept: list[int] = []
        for i in range(len(part)):
            if not kept or (x[kept] @ x[i]).max() < most:
                kept.append(i)
        return part.iloc[kept][["id"]]

    run = F.floor((F.row_number().over(Window.partitionBy("by").orderBy("id")) - 1) / window)
    pool = rows.select(F.col(by).alias("by"), F.col(id_).alias("id"), F.col(text).alias("text")).filter("text is not null and id is not null").withColumn("run", run)
    return pool.groupBy("by", "run").applyInPandas(keep, T.StructType([T.StructField("id", rows.schema[id_].dataType)])).withColumnRenamed("id", id_)


def cluster_tree(nodes: DataFrame, most: int = 10, seed: int = 3) -> DataFrame:
    """A tree of summaries over nodes (``id``, ``v``): ``level``, ``id`` and ``cluster``. Each level is a Gaussian mixture of at most ``most`` parts, and of half as many
    as there are nodes; the next one is over the clusters' mean vectors, until there is one or two."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    level, out = 0, None
    rows = cut(nodes.select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v")))
    while (n := rows.count()) > 2:
        model = GaussianMixture(featuresCol="x", predictionCol="cluster", k=max(2, min(most, n // 2)), seed=seed, maxIter=20).fit(rows.withColumn("x", array_to_vector("v")))
        placed = cut(model.transform(rows.withColumn("x", array_to_vector("v"))).select("id", "v", "cluster"))
        one = placed.select(F.lit(level).alias("level"), "id", "cluster")
        out = one if out is None else out.unionByName(one)
        long = placed.select("cluster", F.posexplode("v").alias("p", "x")).groupBy("cluster", "p").agg(F.avg("x").alias("x"))
        rows = cut(long.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("v")).select(F.col("cluster").cast("long").alias("id"), "v"))
        level += 1
    return out if out is not None else rows.select(F.lit(0).alias("level"), "id", F.lit(0).alias("cluster"))
