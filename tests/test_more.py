"""More core operators on small cases, against brute force where there is no closed answer."""

import heapq
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrand import extension
from lodestrand.functions import checks, chunkers, extraction, metrics
from lodestrand.operators import analytics, filters, graph, hybrid, lifecycle, retrieval
from lodestrand.sources import files
from lodestrand.streaming import broker

DESCRIPTION = {"name": "f", "parameters": {"properties": {"n": {"type": "integer"}, "x": {"type": "float"}, "s": {"type": "string"}, "l": {"type": "array", "items": {"type": "string"}}, "d": {"type": "dict"}}, "required": ["n"]}}


@pytest.mark.parametrize(
    ("call", "answer", "fault"),
    [
        ({"f": {"n": 1}}, {"f": {"n": [1, 2]}}, None),
        ({"g": {"n": 1}}, {"f": {"n": [1]}}, "wrong_name"),
        ({"f": {}}, {"f": {"n": [1]}}, "missing_required"),
        ({"f": {"n": 1, "q": 2}}, {"f": {"n": [1]}}, "unexpected_parameter"),
        ({"f": {"n": 1.0}}, {"f": {"n": [1]}}, "type_error:simple"),
        ({"f": {"n": 1, "x": 2}}, {"f": {"n": [1], "x": [2.0]}}, None),
        ({"f": {"n": 1, "s": "April 1, 2024"}}, {"f": {"n": [1], "s": ["april 1,2024"]}}, None),
        ({"f": {"n": 1, "s": "May"}}, {"f": {"n": [1], "s": ["april"]}}, "value_error:string"),
        ({"f": {"n": 1}}, {"f": {"n": [1], "s": ["a", ""]}}, None),
        ({"f": {"n": 1}}, {"f": {"n": [1], "s": ["a"]}}, "missing_optional"),
        ({"f": {"n": 1, "l": ["A b", "c"]}}, {"f": {"n": [1], "l": [["ab", "C"]]}}, None),
        ({"f": {"n": 1, "l": ["c", "ab"]}}, {"f": {"n": [1], "l": [["ab", "c"]]}}, "value_error:list"),
        ({"f": {"n": 1, "d": {"k": "v"}}}, {"f": {"n": [1], "d": [{"k": ["V"], "more": ["", 1]}]}}, None),
        ({"f": {"n": 1, "d": {"z": 1}}}, {"f": {"n": [1], "d": [{"k": ["v"]}]}}, "value_error:dict_key"),
    ],
)
def test_call_faults(call, answer, fault):
    assert checks.call_fault(DESCRIPTION, call, answer) == fault


def test_checks_of_unreadable_and_unordered_calls(spark):
    d = json.dumps([DESCRIPTION])
    one, two = {"f": {"n": 1}}, {"f": {"n": 2}}
    answers = json.dumps([{"f": {"n": [2]}}, {"f": {"n": [1]}}])
    rows = spark.createDataFrame([(d, json.dumps([one, two]), answers), (d, json.dumps([one]), answers), (d, json.dumps([one, one]), answers), (d, "x", answers), (d, None, answers)], "d string, c string, a string")
    assert [r[0] for r in rows.select(checks.check_calls("d", "c", "a")).collect()] == [None, "wrong_count", "no_match", "unreadable", "unreadable"]


def test_dangerous_code_goes_by_the_syntax():
    danger = {"eval('1')": True, "x = 'eval(1)'": False, "import os\nos.remove('a')": True, "def f(:": True, "": False, "# open('x')": False, "f = open": False}
    assert {c: checks._is_dangerous(c) for c in danger} == danger


def test_states_and_answers(spark):
    r = spark.range(1).select(
        checks.state_difference(F.create_map(F.lit("a"), F.lit("1"), F.lit("_h"), F.lit("x")), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3"))),
        checks.answer_found(F.lit("It is 42.5 (about) c++"), F.array(F.lit("425"))), checks.answer_found(F.lit("the cat's hat"), F.array(F.lit("cat"), F.lit("ha"))), checks.answer_found(F.lit(None).cast("string"), F.array(F.lit("a"))),
    ).first()
    assert r[0] == ["a", "b"] and r[1] and r[2] and not r[3]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_longest_common_subsequence_equals_the_table():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(12))] for _ in range(2))
        assert metrics._common_subsequence(a, b) == lcs(a, b)


def test_text_metrics(spark):
    rows = spark.createDataFrame([("the cat sat", "the cat sat"), ("the cat", "a dog"), (None, "x"), ("", "")], "p string, g string")
    got = rows.select(metrics.rouge(F.col("p"), F.col("g")).alias("r"), metrics.bleu(F.col("p"), F.col("g"), 2).alias("b"), metrics.event_recall(F.col("p"), F.split("g", " ")).alias("e")).collect()
    assert [round(r["b"], 6) for r in got] == [1.0, 0.0, 0.0, 0.0] and [r["r"]["rl"] for r in got] == [1.0, 0.0, 0.0, 0.0] and [r["e"] for r in got] == [1, 0, 0, 1]


def test_chunks_by_characters_cover_and_keep_addresses():
    url = "https://example.org/" + "x" * 80
    text = "First line.\n\n" + "word " * 60 + url + " tail " * 30
    parts = chunkers.split_characters(text, 100, 20)
    assert sum(url in p for p in parts) >= 1 and all(len(p.replace(url, "")) <= 101 for p in parts)
    assert chunkers.split_characters("", 10, 0) == [] and chunkers.split_characters("   ", 10, 0) == []
    assert "".join("".join(chunkers.split_characters("ab " * 50, 10, 0)).split()) == "ab" * 50


def test_header_chunks_repair_flat_levels():
    text = "# A\nx\n# B\ny\n# C\nz"
    assert chunkers.split_headers(text, 100) == [("A", "x"), ("A > B", "y"), ("A > C", "z")]
    assert chunkers.split_headers("plain", 100) == [("", "plain")] and chunkers.split_headers("# A\nx\n## B\ny", 100) == [("A", "x"), ("A > B", "y")]


def test_windows_keep_the_overlap():
    assert chunkers.windows(["a b", "c d", "e f", "g"], 4, 2) == [[0, 1], [1, 2], [2, 3]] and chunkers.windows([], 4, 2) == []
    assert chunkers.windows(["a " * 9, "b"], 4, 2) == [[0], [1]]


def test_extraction(spark):
    t = "Sure:\n```json\n{\"a\": [1]}\n```"
    r = spark.range(1).select(extraction.json_in(F.lit(t)), extraction.json_in(F.lit("no {json")), extraction.list_items(F.lit("- a\n- b\n- a\nx")), extraction.between(F.lit("Q: x?\nA:"), "Q: ", "\nA:"), extraction.language(F.lit("用户说今天")), extraction.judged_score(F.lit("x"))).first()
    assert json.loads(r[0]) == {"a": [1]} and r[1] is None and r[2] == ["a", "b"] and r[3] == "x?" and r[4] == "zh" and r[5] == 0


def test_words_meet_the_terms_before_any_exchange(spark):
    docs = spark.createDataFrame([(i, f"common w{i}") for i in range(200)], "id long, text string")
    hits = retrieval.bm25(docs, "id", "text", spark.createDataFrame([(0, "w7 common")], "qid long, query string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Cartesian" not in plan and hits.first()["id"] == 7
    last = plan[plan.rindex("Generate explode") - 2000 : plan.rindex("Generate explode")]
    assert "BroadcastHashJoin" in last


def test_case_and_ties_of_word_search(spark):
    docs = spark.createDataFrame([(1, "Word a"), (2, "word a"), (3, "word a")], "id long, text string")
    q = spark.createDataFrame([(0, "word")], "qid long, query string")
    assert [r["id"] for r in retrieval.bm25(docs, "id", "text", q).orderBy("rank").collect()] == [1, 2, 3]
    assert [r["id"] for r in retrieval.bm25(docs, "id", "text", q, lower=False, later_first=True).orderBy("rank").collect()] == [3, 2]
    assert retrieval.bm25(docs.limit(0), "id", "text", q).count() == 0


def test_percentiles_by_ranges_with_hot_groups(spark):
    rnd = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rnd.normal(size=3000)] + [("few", 1.0), ("few", 2.0)] + [("same", 5.0)] * 500 + [(None, 3.0), ("hot", None), ("nan", float("nan"))]
    got = {r["g"]: r for r in analytics.nearest_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0, 50, 99, 100]).collect()}
    x = np.sort([v for g, v in rows if g == "hot" and v is not None])
    assert [got["hot"][f"p{p}"] for p in (0, 50, 99, 100)] == [x[min(int(len(x) * p / 100), len(x) - 1)] for p in (0, 50, 99, 100)]
    lin = {r["g"]: r["p95"] for r in analytics.linear_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [95]).collect()}
    assert lin["hot"] == pytest.approx(np.percentile(x, 95)) and lin["few"] == pytest.approx(1.95) and lin["same"] == 5.0
    assert got["few"]["p50"] == 2.0 and got["same"]["p99"] == 5.0 and got[None]["p50"] == 3.0 and "nan" not in got


@pytest.mark.parametrize("bound", [10_000, 20])
def test_fronts_equal_peeling(spark, monkeypatch, bound):
    monkeypatch.setattr(analytics, "SORTED", bound)
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(12), rnd.randrange(12)) for i in range(80)] + [(900, None, 1)]
    got = {r["i"]: r["front"] for r in analytics.pareto_ranks(spark.createDataFrame(rows, "i int, a int, b int"), "i", ["a"], ["b"]).collect()}
    left, want, k = rows[:-1], {}, 0
    while left:
        k += 1
        front = [r for r in left if not any(o[1] >= r[1] and o[2] <= r[2] and (o[1] > r[1] or o[2] < r[2]) for o in left)]
        want |= {r[0]: k for r in front}
        left = [r for r in left if r not in front]
    assert got == want


def test_similar_pairs_and_walk_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL", 25)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([centres[i % 6] + 0.4 * rng.normal(size=(1, 8)) for i in range(150)] + [centres[:1]] * 40)
    nodes = spark.createDataFrame([(i, v.tolist(), [f"t{i % 4}"]) for i, v in enumerate(x)] + [(900, None, None), (901, [0.0] * 8, [])], "id long, v array<double>, tags array<string>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    assert {(r["x"], r["y"]) for r in graph.similar_pairs(nodes, 0.8).collect()} == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] > 0.8}
    edges = [(r["src"], r["dst"], r["weight"]) for r in graph.similarity_edges(nodes, 0.9).collect()]
    near: dict[int, list] = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    seeds = {3: 0.9, 7: 0.5}
    heap, seen = [(1 / v, i) for i, v in seeds.items()], []
    heapq.heapify(heap)
    while heap and len(seen) < 6:
        c, i = heapq.heappop(heap)
        if i not in seen:
            seen.append(i)
            for j, w in near.get(i, []):
                heapq.heappush(heap, (c + 1 / w, j))
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    got = graph.walk(e, spark.createDataFrame([(0, i, v) for i, v in seeds.items()], "qid long, id long, score double"), 6).orderBy("step").collect()
    assert [r["id"] for r in got] == seen
    assert graph.similar_pairs(nodes.limit(0), 0.8).count() == 0


def test_entity_boost_and_blend(spark):
    ent = spark.createDataFrame([("e", 1), ("e", 2), ("f", 2)], "entity string, id long")
    asked = spark.createDataFrame([(0, "e", 0.8), (0, "f", 0.9), (0, "g", 1.0), (1, "e", 0.4)], "qid long, entity string, sim double")
    assert {(r["qid"], r["id"]): round(r["score"], 6) for r in hybrid.entity_boost(ent, asked).collect()} == {(0, 1): round(0.4 / 1.001, 6), (0, 2): 0.45}
    r = spark.range(1).select(hybrid.bm25_sigmoid(F.lit(5.0), F.lit(2)), hybrid.bm25_sigmoid(F.lit(12.0), F.lit(99)), hybrid.reply_score(F.lit("7 then 0.5")), hybrid.reply_score(F.lit(None).cast("string"))).first()
    assert tuple(r) == (0.5, 0.5, 0.5, 0.5)


def test_tfidf_equals_numpy(spark):
    docs = {1: "red red apple", 2: "green apple pie", 3: "a b c", 4: None}
    hits = hybrid.tfidf(spark.createDataFrame(list(docs.items()), "id long, text string"), "id", "text", spark.createDataFrame([(9, "red apple")], "qid long, query string"))
    got = {r["id"]: r["score"] for r in hits.collect()}
    idf = {"red": np.log(5 / 2) + 1, "apple": np.log(5 / 3) + 1, "green": np.log(5 / 2) + 1, "pie": np.log(5 / 2) + 1}
    unit = lambda w: {k: v / np.sqrt(sum(x * x for x in w.values())) for k, v in w.items()}
    q = unit({"red": idf["red"], "apple": idf["apple"]})
    d = {1: unit({"red": 2 * idf["red"], "apple": idf["apple"]}), 2: unit({w: idf[w] for w in ("green", "apple", "pie")})}
    assert got == pytest.approx({i: sum(q.get(w, 0) * x for w, x in v.items()) for i, v in d.items()})


def test_greedy_choices(spark):
    rows = spark.createDataFrame([(0, 1, 0.9, [1.0, 0.0]), (0, 2, 0.8, [1.0, 0.01]), (0, 3, 0.7, [0.0, 1.0]), (0, 4, 0.6, None)], "qid long, id long, score double, v array<double>")
    assert [r["id"] for r in hybrid.spread(rows, 10).orderBy("rank").collect()] == [1, 3, 4]
    kinds = rows.withColumn("kind", (F.col("id") == 4).cast("int"))
    assert [r["id"] for r in hybrid.spread_kinds(kinds, 3, prefill=1).orderBy("rank").collect()][:2] == [1, 4]
    fill = rows.withColumn("kind", F.lit(0))
    assert sorted(r["id"] for r in hybrid.back_filled(fill, 0.85, 2).collect()) == [1, 2]
    texts = spark.createDataFrame([("g", "a", "red apple pie today"), ("g", "b", "red apple pie today"), ("g", "c", "else"), ("h", "d", "red apple pie today"), (None, "e", "x"), ("g", "f", None)], "g string, i string, t string")
    assert sorted(r["i"] for r in hybrid.first_of_similar(texts, "g", "i", "t", 0.75).collect()) == ["a", "c", "d", "e"]


def test_access_rules(spark):
    rules = spark.createDataFrame([("all", 1, "allow", None), ("all", 2, "deny", None), ("none", 1, "deny", None), ("some", 1, "allow", 1), ("some", 2, "allow", 2), ("some", 3, "deny", 2), ("denied", 1, "deny", 1)], "reader string, pos int, effect string, id long")
    items = spark.createDataFrame([(r, i) for r in ("all", "none", "some", "denied", "free") for i in (1, 2)], "reader string, id long")
    assert {tuple(r) for r in filters.accessible(rules, items).collect()} == {("all", 1), ("all", 2), ("some", 1), ("free", 1), ("free", 2)}


def test_filters_with_dates_and_expressions(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "2024-01-31 23:00:00"), (2, None, "2024-02-01 00:00:00"), (3, ["c"], None)], "i int, t array<string>, at string").withColumn("at", F.col("at").cast("timestamp"))
    ids = lambda c: sorted(r["i"] for r in df.filter(c).collect())
    assert ids(filters.build(filters.with_dates({"at": {"lt": "2024-01-31"}}))) == [1] and ids(filters.build(filters.with_dates({"at": {"gt": "2024-02-01"}}))) == []
    assert ids(filters.from_expressions([{"field": "t", "op": "contains", "value": ["b", "c"]}])) == [1, 3]
    with pytest.raises(ValueError, match="unknown"):
        filters.from_expressions([{"field": "t", "op": "near", "value": 1}])


def test_key_value_log_and_monitor(spark):
    ops = [("add", "k", "v"), ("add", "k", "w"), ("remove", "k", None), ("remove", "k", None), ("replace", "k", "x"), ("add", "k", "y" * 99), ("add", "k", "z"), ("replace", "k", "q"), ("add", "Bad", "v")]
    df = spark.createDataFrame([("s", k, i, o, v) for i, (o, k, v) in enumerate(ops)], "store string, key string, pos int, op string, value string")
    assert [r["done"] for r in lifecycle.key_value_log(df, F.col("key") == "k", 10).orderBy("pos").collect()] == [True, False, True, False, False, False, True, True, False]
    old = spark.createDataFrame([("a", 5.0, 1), ("b", 4.0, 2), ("c", 3.0, 1)], "key string, score double, recorded int")
    new = spark.createDataFrame([("b", 1.0), ("d", 2.0)], "key string, score double")
    assert {tuple(r) for r in lifecycle.merged_monitor(old, new, 1, 3).collect()} == {("d", 2.0, 1), ("b", 1.0, 3), ("a", 0.0, 1)}


def test_broker(spark):
    m = spark.createDataFrame([("s", i, f"2024-01-01 00:00:{i:02}") for i in range(6)], "stream string, id long, at string").withColumn("at", F.col("at").cast("timestamp"))
    pending = m.filter("id < 2").withColumn("owner", F.lit("w"))
    assert {(r["id"], r["batch"]) for r in broker.batches(m, pending, 3).collect()} == {(2, 0), (3, 0), (4, 0), (5, 1), (0, 1), (1, 1)}
    assert [r["id"] for r in broker.claimed(pending, F.lit("2024-01-01 00:01:00").cast("timestamp"), 59, "x").collect()] == [0]
    assert sorted(r["id"] for r in broker.trimmed(m, 2).collect()) == [4, 5]


def test_ciphers_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "héllo", "k"), (2, "", "k"), (3, None, "k")], "i int, t string, k string")
    back = df.select("t", files.xor_decoded(files.xor_encoded(F.col("t"), F.col("k")), F.col("k")).alias("b")).collect()
    assert all(r["t"] == r["b"] for r in back)
    files.write_ranked_csv(spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "i int, s double"), "s", f"{tmp_path}/r", "i")
    assert [(r["i"], r["s"], r["rank"]) for r in spark.read.option("header", True).csv(f"{tmp_path}/r").orderBy("rank").collect()] == [("3", "7.00", "1"), ("1", "5.00", "2"), ("2", "N/A", "3")]
    got = files.indexed(spark.createDataFrame([(i,) for i in (5, 1, 900, 33)], "i long"), "i", 10).collect()
    assert {r["i"]: r["index"] for r in got} == {1: 0, 5: 1, 33: 2, 900: 3}


def test_plugged_in_code(spark):
    with pytest.raises(ValueError, match="allowed"):
        extension.installed("bad", "import os\nos.system('x')\nclass Provided(WordMemory): pass")
    with pytest.raises(ValueError, match="no class"):
        extension.installed("bad", "x = 1")
    with pytest.raises(ValueError, match="no memory"):
        extension.memory("unknown")
    with pytest.raises(ValueError, match="registered"):
        extension.register("bm25")(extension.WordMemory)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, v array<double>, tags array<string>")
    assert graph.similarity_edges(none).count() == 0 and graph.components(spark.createDataFrame([], "x long, y long")).count() == 0
    assert analytics.pareto_ranks(spark.createDataFrame([], "k int, a int, b int"), "k", ["a"], ["b"]).count() == 0
    assert analytics.nearest_rank(spark.createDataFrame([], "g string, v double"), ["g"], "v", [50]).count() == 0
    assert isinstance(spark.createDataFrame([], "a int").toPandas(), pd.DataFrame)
