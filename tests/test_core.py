"""Core operators on small cases with known results."""

import json
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.operators import analytics, filters, graph, lifecycle, nested, retrieval
from lodestrand.plans import memory_queries, more_queries, nested_queries

RAW = [
    json.dumps({"id": "a", "n": 1, "metadata": {"k": "x", "questions": [{"q": "1"}, {"q": "2"}]}, "per_turn_totals": [{"input_tokens_per_step": [1, None, "3"]}, None, {"input_tokens_per_step": 5}]}),
    json.dumps({"schema": 2, "record": {"id": "b/1", "metadata": json.dumps({"k": "y", "per_turn_totals": [{"input_tokens_per_step": "[7, 8]"}]})}}),
    json.dumps({"id": "c", "per_turn_totals": {"2": {"input_tokens_per_step": [9]}, "0": {"input_tokens_per_step": []}}}),
    json.dumps({"id": "d", "per_turn_totals": {"step_count": 1, "input_tokens_per_step": [4]}}),
    json.dumps({"id": "a", "n": 1, "per_turn_totals": [{"input_tokens_per_step": [1]}]}),
    '{"id": "broken"', "null", "[]", "", None, json.dumps({"n": 3}),
]


def _raw(spark, rows):
    return spark.createDataFrame([(i, r, "clash") for i, r in enumerate(rows)], "line_no long, raw string, key string")


def test_flat_tables_read_every_shape(spark):
    df = _raw(spark, RAW)
    t = nested.flat_tables(df, keep=frozenset(["metadata"]))
    assert {r["key"] for r in t["record"].collect()} == {"a", "b/1", "c", "d"}
    turns = {r["key"]: (r["record_key"], r["pos"]) for r in t["per_turn_totals"].collect()}
    steps = {(*turns[r["parent_key"]], r["pos"], r["value"]) for r in t["input_tokens_per_step"].collect() if r["value"] is not None}
    assert steps == {("a", 0, 0, "1"), ("a", 0, 2, "3"), ("a", 2, 0, "5"), ("b/1", 0, 0, "7"), ("b/1", 0, 1, "8"), ("c", 2, 0, "9"), ("d", 0, 0, "4")}
    assert {(r["record_key"], r["pos"], r["q"]) for r in t["questions"].collect()} == {("a", 0, "1"), ("a", 1, "2")}
    assert {(r["record_key"], r["k"]) for r in t["metadata"].collect()} == {("a", "x"), ("b/1", "y")}
    assert t["_rejected"].count() == 6


def test_flat_tables_of_nothing(spark):
    t = nested.flat_tables(_raw(spark, []))
    assert list(t) == ["record", "_rejected"] and t["record"].count() == 0


def test_recursive_element_gets_its_own_table(spark):
    df = _raw(spark, [json.dumps({"id": "r", "node": {"v": 1, "node": {"v": 2, "node": {"v": 3}}}})])
    t = nested.flat_tables(df)
    assert sorted(r["v"] for r in t["node"].collect()) == [1, 2, 3]
    keys = {r["key"]: r["parent_key"] for r in t["node"].collect()}
    assert sum(p in keys for p in keys.values()) == 2


@pytest.mark.parametrize(
    ("raw", "want"), [("The  Cat, sat!", "cat sat"), ("a an the", ""), ("", ""), ("theory of An A", "theory of")]
)
def test_normalize_answer(spark, raw, want):
    assert spark.range(1).select(X.normalize_answer(F.lit(raw))).first()[0] == want


def test_token_scores(spark):
    rows = spark.createDataFrame([("a b b c", "b b d"), ("yes", "no"), (None, "x"), ("x", "x")], "p string, g string")
    got = [r[0] for r in rows.select(X.token_f1(F.col("p"), F.col("g"))).collect()]
    assert got == pytest.approx([2 * 2 / (3 + 3), 0, 0, 1])


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, None, 7)], "i int, s string, n int")
    ids = lambda f: [r["i"] for r in df.filter(filters.build(f)).orderBy("i").collect()]
    assert ids({}) == ids(None) == [1, 2, 3]
    assert ids({"s": "a"}) == [1] and ids({"s": ["a", "b"]}) == [1, 2] and ids({"s": "*"}) == [1, 2]
    assert ids({"s": {"ne": "a"}}) == [2, 3] and ids({"n": {"gt": 5, "lte": 7}}) == [3]
    assert ids({"$or": [{"s": "a"}, {"n": 7}]}) == [1, 3] and ids({"$not": [{"s": "a"}]}) == [2, 3]
    with pytest.raises(ValueError, match="unknown"):
        filters.build({"s": {"near": 1}})


def test_nearest_rank_keeps_the_floor_rule(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(10)] + [("h", 3.0), ("h", float("nan")), ("e", None)], "g string, v double")
    got = {r["g"]: (r["p50"], r["p99"]) for r in analytics.nearest_rank(df, ["g"], "v", [50, 99]).collect()}
    assert got == {"g": (5.0, 9.0), "h": (3.0, 3.0)}


def test_rrf_and_fusion(spark):
    ranked = lambda ids: spark.createDataFrame([(0, i, r + 1, 1.0) for r, i in enumerate(ids)], "qid long, id long, rank int, score double")
    got = {r["id"]: r["score"] for r in retrieval.rrf([ranked([1, 2, 3]), ranked([2, 1, 4])], 10).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == got[2] == pytest.approx(1 / 61 + 1 / 62, abs=1e-6)
    sem = spark.createDataFrame([(0, 1, 0.8), (0, 2, 0.6), (0, 3, 0.05)], "qid long, id long, score double")
    lex = spark.createDataFrame([(0, 1, 0.3), (0, 2, 0.9), (0, 3, 0.99)], "qid long, id long, score double")
    assert {r["id"]: r["score"] for r in retrieval.additive_fusion(sem, lex, None, 10).collect()} == {1: 0.55, 2: 0.75}


def test_recency_and_sigmoid(spark):
    r = spark.range(1).select(retrieval.recency(F.lit(1.0), F.lit(365.0)), retrieval.recency(F.lit(1.0), F.lit(-5.0)), retrieval.sigmoid(F.lit(5.0), 5.0, 0.7)).first()
    assert 0.3 < r[0] < 0.301 and r[1] == 1.0 and math.isclose(r[2], 0.5)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "K"), ("b", "c", "K"), ("a", "c", "K"), ("c", "a", "K")], "src string, dst string, kind string")
    assert {tuple(r["path"]) for r in graph.paths(e, "a", "c").collect()} == {("a", "c"), ("a", "b", "c")}
    hops = {r["id"]: r["hops"] for r in graph.k_hop(e, spark.createDataFrame([("b",)], "id string"), 2, True).collect()}
    assert hops == {"b": 0, "c": 1, "a": 2}
    assert {(r.src, r.dst, r.kind) for r in graph.fold(e, ["b", "c"], "s", "new").collect()} == {("a", "s", "new"), ("s", "a", "K")}


def test_life_cycle(spark):
    bank = spark.createDataFrame([("A",)], "t string")
    batch = spark.createDataFrame([(1, "a"), (2, "B"), (3, "b"), (4, None)], "i int, t string")
    assert [r["i"] for r in lifecycle.new_by_signature(bank, batch, "t", "i").collect()] == [2]
    assert sorted(r["i"] for r in lifecycle.new_by_signature(bank, batch, "t", "i", False).collect()) == [2, 3]
    old = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, a string, b double")
    new = spark.createDataFrame([(2, None, 5.0)], "k int, a string, b double")
    assert {tuple(r) for r in lifecycle.partial_update(old, new, "k").collect()} == {(1, "x", 1.0), (2, "y", 5.0)}


def test_bm25_ranks_rare_terms_first(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, "common"), (4, None), (5, "")], "id long, text string")
    q = spark.createDataFrame([(0, "rare common"), (1, "absent")], "qid long, query string")
    got = retrieval.bm25(docs, "id", "text", q, 10).collect()
    assert got and min(got, key=lambda r: r["rank"])["id"] == 1 and {r["qid"] for r in got} == {0}


def test_every_hundredth_vector_asks_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1001, 8))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got: dict[int, list[int]] = {}
    for r in memory_queries.r29_l2(spark, str(tmp_path)).orderBy("qid", "distance").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert set(got) == set(range(0, 1001, 100))
    for i, ids in got.items():
        assert set(ids) == set(np.argsort(((x - x[i]) ** 2).sum(1))[:10].tolist())


def test_every_hundredth_document_asks(spark, tmp_path):
    rows = [(i, f"word{i % 100} common", "log") for i in range(301)] + [(400, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = memory_queries.r2_bm25_plus_one(spark, str(tmp_path)).filter("rank <= 4").collect()
    assert {(r["qid"], r["id"]) for r in got} == {(q, i) for q in (0, 100, 200, 300) for i in (0, 100, 200, 300)}


def test_history_and_time_range_take_all_users(spark, tmp_path):
    day = lambda n: datetime(2024, 1, n)
    rows = [(1, 7, day(9), "signup"), (2, 8, day(8), "error"), (3, 8, day(7), "view"), (4, 900, day(21), "view"), (5, None, day(22), "view"), (6, 7, day(9), "click")]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["event_id"], r["event"], r["pos"]) for r in more_queries.d12_history(spark, str(tmp_path)).collect()}
    assert got == {(1, "ADD", 1), (6, "UPDATE", 2), (3, "UPDATE", 1), (2, "DELETE", 2), (4, "UPDATE", 1), (5, "UPDATE", 1)}
    assert {r["event_id"] for r in more_queries.x9_time_range(spark, str(tmp_path)).collect()} == {1, 2, 4, 6}


def test_flat_table_queries_keep_keys_and_values(spark, tmp_path):
    raw = json.dumps({"id": "a", "metadata": {"task_id": "t", "context_id": "c", "context_category": "x", "sub_category": "y", "questions": [{"question_id": "1", "question_type": "k", "question_date": "d"}]}, "per_turn_totals": [{"step_count": 2, "latency_s": 1.0, "input_tokens": 4, "output_tokens": 2, "input_tokens_per_step": [1, None, 3]}]})
    _raw(spark, [raw]).write.parquet(f"{tmp_path}/tool_results.parquet")
    turn = nested_queries.p5_turns(spark, str(tmp_path)).first()
    steps = nested_queries.p5_steps(spark, str(tmp_path)).collect()
    assert {(r["pos"], r["value"]) for r in steps if r["value"] is not None} == {(0, "1"), (2, "3")}
    assert {(r["record_key"], r["parent_key"]) for r in steps} == {("a", turn["key"])}
    meta, question = (f(spark, str(tmp_path)).first() for f in (nested_queries.p5_metadata, nested_queries.p5_questions))
    assert question["parent_key"] == meta["key"] and meta["id"] == "a"


def test_objects_keyed_by_ids_are_maps(spark, monkeypatch):
    monkeypatch.setattr(nested, "MAP_KEYS", 20)
    rows = [json.dumps({"id": f"r{i}", "by_user": {f"u{i}_{k}": {"n": k, "tags": ["x"], "map_key": "own"} for k in range(5)}, "flat": {f"v{i}_{k}": k for k in range(3)}}) for i in range(30)]
    df = _raw(spark, [*rows, json.dumps({"id": "none", "by_user": {}, "flat": None}), None])
    graph = nested.analyse(df)
    assert graph.maps == {"by_user", "flat"} and len(graph.edges) < 10 and len(graph.attrs) < 12
    t = nested.flat_tables(df)
    entries = {(r["record_key"], r["map_key"], r["n"], r["map_key_2"]) for r in t["by_user_entry"].collect()}
    assert entries == {(f"r{i}", f"u{i}_{k}", k, "own") for i in range(30) for k in range(5)}
    assert t["tags"].count() == 150 and {r["map_key"] for r in t["flat_entry"].collect()} == {f"v{i}_{k}" for i in range(30) for k in range(3)}
    assert t["record"].count() == 31 and t["_rejected"].count() == 1
