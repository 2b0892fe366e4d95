"""Searches over all pairs, held against brute force; no pair is shuffled."""

from collections import Counter
from datetime import datetime
from math import log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestrand.operators import hybrid, retrieval, scan


def _texts(n, seed=5):
    """Texts with frequent and rare words, copies, a null, a blank and an empty one."""
    rng = np.random.default_rng(seed)
    rows = [" ".join([*(f"w{int(x)}" for x in rng.zipf(1.4, 12) if x < 400), f"only{i}"]) for i in range(1, n + 1)]
    for i in range(0, n - 7, 9):
        rows[i + 7] = rows[i]
    rows[3], rows[4], rows[5] = None, "", " \t "
    return [(i + 1, t) for i, t in enumerate(rows)]


def _bm25(docs, queries, k, okapi=False, delta=0.0, later=False):
    """From the definition; documents of one id are summed up, those of one length as one."""
    words = [(i, (t or "").lower().split()) for i, t in docs]
    total, avgdl = len(words), sum(len(w) for _, w in words) / len(words)
    n = {}
    for _, w in words:
        for t in set(w):
            n[t] = n.get(t, 0) + 1
    idf = {t: log((total - c + 0.5) / (c + 0.5) + (not okapi)) for t, c in n.items()}
    if okapi:
        mean = sum(idf.values()) / len(idf)
        idf = {t: x if x >= 0 else 0.25 * mean for t, x in idf.items()}
    out, same = set(), {}
    for i, w in words:
        same.setdefault((i, len(w)), []).extend(w)
    for qid, text in queries:
        score = {}
        for (i, dl), w in same.items():
            for t in (text or "").lower().split():
                if tf := w.count(t):
                    score[i] = score.get(i, 0) + idf[t] * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) + delta)
        best = sorted(score, key=lambda i: (-round(score[i], 6), -i if later else i))[:k]
        out |= {(qid, i, round(round(score[i], 6), 4), r + 1) for r, i in enumerate(best)}
    return out


def _got(df, digits=4):
    return {(r["qid"], r["id"], round(r["score"], digits), r["rank"]) for r in df.collect()}


def _shuffled(spark):
    """Bytes shuffled so far."""
    each = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


@pytest.mark.parametrize("dense", [0.0, 1.3e-3, 1.0])
def test_bm25_of_all_pairs(spark, monkeypatch, dense):
    monkeypatch.setattr(scan, "DENSE", dense)  # all words, some or none as columns
    docs = _texts(150)
    df, q = spark.createDataFrame(docs, "id long, text string"), docs[::7]
    queries = spark.createDataFrame(q, "qid long, query string")
    assert _got(retrieval.bm25(df, "id", "text", queries, 5)) == _bm25(docs, q, 5)
    assert _got(retrieval.bm25(df, "id", "text", queries, 6, delta=1.0, later_first=True)) == _bm25(docs, q, 6, delta=1.0, later=True)
    assert _got(retrieval.bm25(df, "id", "text", queries, 1000, "okapi")) == _bm25(docs, q, 1000, True)


def test_bm25_in_blocks_and_small_steps(spark, monkeypatch):
    for name, value in (("QUERIES", 3), ("CELLS", 30), ("STEP", 7), ("KEPT", 4)):
        monkeypatch.setattr(scan, name, value)
    docs = _texts(120)
    df, q = spark.createDataFrame(docs, "id long, text string"), docs[::11]
    assert _got(retrieval.bm25(df, "id", "text", spark.createDataFrame(q, "qid long, query string"), 4)) == _bm25(docs, q, 4)


def test_bm25_of_repeated_ids_negative_and_zero_idf(spark):
    docs = [(1, "a b"), (1, "a b c"), (1, "a b"), (2, "a c"), (3, "a"), (4, "b a"), (5, None)]
    q = [(7, "a b"), (8, "c c b"), (9, "absent"), (10, None)]
    df, queries = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(q, "qid long, query string")
    assert _got(retrieval.bm25(df, "id", "text", queries, 3)) == _bm25(docs, q, 3)
    few = [(1, "a b"), (2, "a"), (3, "b c"), (4, "d a")]  # the idf of b is 0 and that of a negative
    got = retrieval.bm25(spark.createDataFrame(few, "id long, text string"), "id", "text", queries, 9, "okapi")
    assert _got(got) == _bm25(few, q, 9, True) and {r["id"] for r in got.filter("qid = 8").collect()} == {1, 3}
    names = spark.createDataFrame([("x", "a b"), ("y", "b a"), ("z", "c")], "id string, text string")
    assert [r["id"] for r in retrieval.bm25(names, "id", "text", queries.filter("qid = 7"), 1).collect()] == ["x"]
    assert retrieval.bm25(names.limit(0), "id", "text", queries, 1).count() == 0 and retrieval.bm25(names, "id", "text", queries.limit(0), 1).count() == 0


def _blend(docs, queries, bank, asking, k):
    words = {}
    for i, t in docs:
        words.setdefault(i, []).extend(w for w in t.lower().split() if len(w) > 1)
    n, df = len(docs), {}
    for w in words.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1

    def unit(w):
        x = {t: w.count(t) * (log((1 + n) / (1 + df[t])) + 1) for t in set(w) if t in df}
        norm = sqrt(sum(v * v for v in x.values()))
        return {t: v / norm for t, v in x.items()}

    units = {i: unit(w) for i, w in words.items()}
    out = set()
    texts, ask = dict(queries), dict(asking)
    for qid in {*texts, *ask}:
        q = unit([w for w in texts.get(qid, "").lower().split() if len(w) > 1])
        score = {}
        for i, x in units.items():
            if common := q.keys() & x.keys():
                score[i] = 0.5 * sum(q[t] * x[t] for t in common)
        for i, v in bank:
            if qid in ask and len(v) == len(ask[qid]):
                norm = np.linalg.norm(v) * np.linalg.norm(ask[qid])
                score[i] = score.get(i, 0) + 0.5 * (round(float(np.dot(v, ask[qid])) / norm, 6) if norm else 0)
        best = sorted(score, key=lambda i: (-round(score[i], 6), i))[:k]
        out |= {(qid, i, round(score[i], 4), r + 1) for r, i in enumerate(best)}
    return out


@pytest.mark.parametrize("known", [0, 2_000_000])
def test_blend_of_all_pairs(spark, monkeypatch, known):
    monkeypatch.setattr(hybrid, "KNOWN", known)
    docs = [(i, t) for i, t in _texts(90) if t is not None]
    rng = np.random.default_rng(2)
    bank = [(i, rng.normal(size=4 if i % 5 else 3).round(3).tolist()) for i in range(60, 120)] + [(130, [0.0] * 4)]
    q, asking = docs[::8], [b for b in bank if b[0] % 8 == 1]
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = hybrid.blended_top(of(docs, "i long, t string"), "i", "t", of(q, "qid long, query string"), of(bank, "id long, v array<float>"), of(asking, "qid long, v array<float>"), 200)
    want = {x[:2]: x[2] for x in _blend(docs, q, bank, asking, 200)}
    have = {(r["qid"], r["id"]): r["score"] for r in got.collect()}
    assert have.keys() == want.keys() and all(abs(have[x] - want[x]) < 1e-3 for x in want) and any(x < 0 for x in have.values())


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """2,000 documents that all have 30 words in common, 20 of which ask: 40,000 pairs."""
    d = str(tmp_path_factory.mktemp("crowd"))
    docs = [(i, " ".join(f"c{j}" for j in range(30)) + f" x{i % 50}", "en", "log", f"k{i}", datetime(2024, 1, 1 + i % 9)) for i in range(1, 2001)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, context_id string, created_at timestamp").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, [1.0, i / 300]) for i in range(300)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize(("name", "rows"), [
    ("r12_normalised_rank", 200),
    ("r15_hybrid_cut", 210),
    ("r20_additive", 30),
    ("v1_retrieve", 100),
    ("v4_provide", 20),
    ("r16_rank_fusion", 210),
    ("r19_recall_pipeline", 201),
    ("r21_multi_signal", 30),
    ("r2_bm25_plus_one", 200),
    ("m9_sigmoid", 200),
    ("r14_hybrid_whole", 210),
    ("r17_rrf", 200),
    ("r1_bm25_okapi", 200),
    ("v11_provided", 60),
])
def test_no_pairs_are_shuffled(spark, crowd, name, rows):
    before = _shuffled(spark)
    assert len(__spark_entry__.queries()[name](spark, crowd).collect()) == rows
    assert _shuffled(spark) - before < 200_000  # pairs took above 1 MB


@pytest.mark.parametrize("idf", ["plus", "okapi"])
def test_texts_are_read_twice(spark, idf):
    reads = spark.sparkContext.accumulator(0)

    def read(text: str) -> str:
        reads.add(1)
        return text

    df = spark.createDataFrame(_texts(100), "id long, text string").repartition(3)
    docs = df.select("id", F.udf(read, "string").asNondeterministic()("text").alias("text"))
    assert retrieval.bm25(docs, "id", "text", df.filter("id < 4").select(F.col("id").alias("qid"), F.col("text").alias("query")), 3, idf).count()
    assert reads.value == 200  # once to count words, once for the scores; it was three times


def test_texts_are_split_as_by_the_sessions_words(spark, monkeypatch):
    monkeypatch.setattr(scan, "HELD", 3)
    texts = ["  a b\x0bc\x0cd\r\ne\t", "", "x", "a b　c\x85d\x1ce", None, " ", "Ä ä İ b b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    rows = scan.counted_words(docs.select("id", F.lower("text").alias("w"))).collect()
    each = docs.select("id", retrieval.words("text").alias("w")).collect()
    assert {r["id"]: r["dl"] for r in rows if r["dl"] is not None} == {r["id"]: len(r["w"]) for r in each}
    n = Counter()
    for r in rows:
        if r["dl"] is None:
            n[r["term"]] += r["n"]
    assert n == Counter(w for r in each for w in set(r["w"]))
