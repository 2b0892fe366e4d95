"""Training-data operators against brute force, on small cases with nulls, ties, repeats and long texts."""

import random
import re
import sys
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import chunking, mixing, neighbours, packing, partenum, quantiles, spans
from lodestrand.llm.fmindex import FMIndex
from lodestrand.operators import graph


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


# 1. Pieces


@pytest.mark.parametrize("seed", range(8))
def test_pieces_cover_the_text_within_the_limit(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice([" ", ". ", "\n", "\n\n", "。"]) if rnd.random() < 0.15 else rnd.choice("abcdeéß中😀") for _ in range(rnd.randrange(2000, 9000)))
    cuts = chunking.cut_points(text, 500, 50, 20)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (_, b), (c, _) in zip(cuts, cuts[1:], strict=False):
        assert 30 <= b - c <= 50
    assert all(0 < b - a <= 500 for a, b in cuts)
    ends = {b for b in range(1, len(text)) if text[b - 1].isspace() or text[b - 1] == "。"}
    assert all(b in ends or not any(b - 250 <= e <= b for e in ends) for _, b in cuts[:-1])


def test_strongest_and_rightmost_cut_wins():
    text = "a" * 300 + ". " + "b" * 100 + "\n\n" + "c" * 50 + " " + "d" * 400
    assert chunking.cut_points(text, 500, 0, 0)[0] == (0, 404)
    assert chunking.cut_points("x" * 1001, 500, 100, 0) == [(0, 500), (400, 900), (800, 1001)]


def test_range_maximum():
    rnd = np.random.default_rng(0)
    v = rnd.integers(0, 5, 200)
    ix = chunking.RangeMax(v, 200)
    for _ in range(500):
        a, b = sorted(rnd.integers(0, 200, 2).tolist())
        b += 1
        assert ix.argmax(a, b) == a + max(i for i in range(b - a) if v[a + i] == v[a:b].max())


def test_split_keeps_columns_and_handles_edges(spark):
    df = spark.createDataFrame([(1, "x " * 3000, 7), (2, "", 8), (3, None, 9), (4, "short", 1)], "id int, t string, piece int")
    rows = chunking.split_oversized(df, "t").collect()
    assert {r["id"] for r in rows} == {1, 2, 4} and {r["piece"] for r in rows if r["id"] == 1} == {7}
    assert all(len(r["piece_new"]) <= 3000 for r in rows)
    assert chunking.split_oversized(df.limit(0), "t").count() == 0


# 2. Near-duplicates


def brute(texts, g, width):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", t.lower()) if t else []
        if len(w) >= width:
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= g * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("g", "width"), [(Fraction(3, 5), 3), (Fraction(4, 5), 5)])
def test_near_duplicates_equal_brute_force(spark, g, width):
    rnd = random.Random(3)
    texts = {}
    for i in range(120):
        base = words(rnd, rnd.choice([1, 3, 5, 8, 40, 150, 600]), 60)
        texts[f"{i:03}a"] = " ".join(base)
        for k in range(rnd.randrange(4)):
            edited = list(base)
            for _ in range(rnd.randrange(1, 4)):
                edited[rnd.randrange(len(edited))] = f"e{rnd.randrange(30)}"
            texts[f"{i:03}b{k}"] = ", ".join(edited).upper()
    whole = next(t for t in texts.values() if t.count(" ") > 30)
    texts |= {"n": None, "e": "", "p": "... --- ...", "same1": whole, "same2": whole, "same3": whole.upper()}
    rows = [("f", i, t) for i, t in texts.items()] + [("f", "000a", texts["000a"]), (None, "x", "a b c d e"), ("f", None, "a b c d e")]
    df = spark.createDataFrame(rows, "field string, id string, text string")
    pairs, members = partenum.near_duplicates(df, "field", "id", "text", g, width)
    got = {(r["id_a"], r["id_b"]) for r in partenum.expand(pairs, members).collect()}
    assert got == brute(texts, g, width)
    per = {r["id"]: r for r in partenum.classes(pairs, members).collect()}
    assert per["same1"]["class"] == per["same2"]["class"] and per["same1"]["copies"] >= 3


@pytest.mark.parametrize(("levels", "entries"), [(3, 200_000), (1, 30)])
def test_near_duplicates_hot_signatures(spark, monkeypatch, levels, entries):
    monkeypatch.setattr(partenum, "HOT", 3)
    monkeypatch.setattr(partenum, "LEVELS", levels)
    monkeypatch.setattr(partenum, "ENTRIES", entries)
    monkeypatch.setattr(partenum, "COMMON", 4)
    rnd = random.Random(5)
    base = words(rnd, 30)
    texts = {f"{i:03}": " ".join([*base[:22], *words(rnd, 12)]) for i in range(60)}
    df = spark.createDataFrame([("f", i, t) for i, t in texts.items()], "field string, id string, text string")
    pairs, members = partenum.near_duplicates(df, "field", "id", "text", Fraction(1, 2), 3)
    assert {(r["id_a"], r["id_b"]) for r in partenum.expand(pairs, members).collect()} == brute(texts, Fraction(1, 2), 3)


def grouped(ids, pairs):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_duplicates_come_out_in_groups(spark):
    base = [f"w{i}" for i in range(40)]
    texts = {"z": base, "m": ["x", "y", "v", *base[3:]], "c": ["x", "y", "v", *base[3:-8], *"abcdefgh"], "copy": base, "alone": words(random.Random(1), 40), "short": ["a", "b", "c"]}
    texts = {i: " ".join(t) for i, t in texts.items()}
    df = spark.createDataFrame([("f", i, t) for i, t in texts.items()] + [("g", "other", texts["z"])], "field string, id string, text string")
    pairs, members = partenum.near_duplicates(df, "field", "id", "text", Fraction(3, 5), 3)
    want = brute(texts, Fraction(3, 5), 3)
    assert ("c", "z") not in want and ("c", "m") in want and ("m", "z") in want
    per = {(r["field"], r["id"]): r for r in partenum.classes(pairs, members).collect()}
    assert {k: r["group"] for k, r in per.items()} == {("f", i): g for i, g in grouped(texts, want).items()} | {("g", "other"): "other"}
    assert per["f", "z"]["class"] == per["f", "copy"]["class"] != per["f", "m"]["class"] and per["f", "m"]["links"] == 2


def test_components_of_long_chains_and_hubs(spark):
    rnd = random.Random(7)
    n = rnd.sample(range(10_000), 400)
    pairs = [*zip(n[:150], n[1:151], strict=True), *[(n[200], x) for x in n[201:300]], *[tuple(rnd.sample(n[300:], 2)) for _ in range(60)]]
    pairs = [(min(p), max(p)) for p in pairs]
    got = {r["id"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    ends = {x for p in pairs for x in p}
    assert got == grouped(ends, pairs)
    assert graph.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "field string, id string, text string")
    pairs, members = partenum.near_duplicates(df, "field", "id", "text")
    assert pairs.count() == 0 and members.count() == 0


# 3. Percentiles


def test_percentiles_stay_within_the_rank_error_and_merge(spark):
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.normal(size=20_000), np.full(5_000, 0.5)])
    df = spark.createDataFrame([(int(i % 4), float(v)) for i, v in enumerate(x)] + [(9, None), (9, float("nan"))], "day int, v double")
    parts = quantiles.sketches(df, ["day"], ["v"])
    assert {r["day"] for r in parts.select("day").collect()} == {0, 1, 2, 3}
    order = np.sort(x)
    for r in quantiles.percentiles(quantiles.merged(parts, []), [5, 50, 95], widen=2.0).collect():
        true = order[int(np.ceil(r["pct"] / 100 * len(x))) - 1]
        assert r["n"] == len(x) and r["low"] <= true <= r["high"]


def test_above_is_exact_at_the_bound(spark):
    rows = [("a", float(i)) for i in range(1, 41)] + [("b", 20.0)] * 29 + [("c", 21.0)] * 30 + [("c", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["pct"]) for r in quantiles.above(df, ["g"], [("v", 50, 20.0), ("v", 95, 37.5)]).collect()}
    assert got == {("c", 50), ("a", 95)}


# 4. Neighbours


def test_neighbours_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 64))
    x = [(f"{i:04}", (centres[i % 20] + 0.3 * rng.normal(size=64)).tolist()) for i in range(1200)]
    x += [(f"c{i}", x[0][1]) for i in range(8)]
    bad = [("z0", None), ("z1", [0.0] * 64), ("z2", [1.0] * 63), ("z3", [float("nan")] * 64), ("z4", [float("inf")] + [1.0] * 63), (None, x[1][1]), x[5]]
    df = spark.createDataFrame(x + bad, "id string, v array<double>")
    got: dict[str, list[str]] = {}
    for r in neighbours.similar(df, "id", ["v"]).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    m = np.array([v for _, v in x], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    ids = [i for i, _ in x]
    hits = [len(set(got[i]) & {ids[j] for j in np.argsort(-s[k])[:5]}) / 5 for k, i in enumerate(ids) if not i.startswith("c") and i != "0000"]
    assert set(got) == set(ids) and np.mean(hits) >= 0.9
    assert got["0000"] == ["c0", "c1", "c2", "c3", "c4"] and got["c0"] == ["0000", "c1", "c2", "c3", "c4"]


@pytest.mark.parametrize(("cells", "together", "rerank"), [(4_000_000, 64, 96), (30_000, 7, 96), (4_000_000, 64, 5000)])
def test_neighbours_are_searched_by_arrays_and_not_query_by_query(monkeypatch, cells, together, rerank):
    for name, value in (("CELLS", cells), ("TOGETHER", together), ("RERANK", rerank)):
        monkeypatch.setattr(neighbours, name, value, raising=False)
    rng = np.random.default_rng(6)
    x = neighbours._unit(np.concatenate([rng.normal(size=(1400, 16)), np.repeat(rng.normal(size=(1, 16)), 200, 0)]))
    m = neighbours.fit(x, 12, 12, 1)
    cell, ties, own = m.nearest(x, 1)[:, 0], rng.permutation(len(x)), np.arange(len(x)) % 3 > 0
    rows = pd.DataFrame({"f": 0, "no": range(len(x)), "h1": ties, "cell": cell, "unit": [v.tobytes() for v in x], "codes": [c.tobytes() for c in m.encode(x, cell)], "own": own, "asks": True})
    search, calls = neighbours._searcher([m], 16, 5), []
    sys.setprofile(lambda _, event, __: calls.append(event) if event in ("call", "c_call") else None)
    try:
        got = search(rows)
    finally:
        sys.setprofile(None)
    s = np.round(x.astype(float) @ x.astype(float).T, 6)
    s[:, ~own] = -2
    np.fill_diagonal(s, -2)
    best = np.stack([np.lexsort([ties, -row])[:5] for row in s])
    got = got.sort_values(["q", "cos", "tie"], ascending=[True, False, True])
    assert (got["q"].to_numpy() == np.repeat(np.arange(len(x)), 5)).all()
    have = got["c"].to_numpy().reshape(-1, 5)
    same = np.take_along_axis(s, have, 1) == np.take_along_axis(s, best, 1)
    assert same.mean() > 0.999 and (np.round(got["cos"].to_numpy(), 6).reshape(-1, 5) == np.take_along_axis(s, have, 1)).all()
    assert rerank == 96 or (have == best).all()  # of the 200 equal vectors 96 at most are ranked
    assert together < 64 or len(calls) < 4 * len(x)  # it was above 40 a query


def test_neighbours_of_few(spark):
    schema = "id string, v array<float>"
    assert neighbours.similar(spark.createDataFrame([], schema), "id", ["v"]).count() == 0
    assert neighbours.similar(spark.createDataFrame([("a", [1.0] * 64)], schema), "id", ["v"]).count() == 0
    two = neighbours.similar(spark.createDataFrame([("a", [1.0] * 64), ("b", [-1.0] * 64)], schema), "id", ["v"]).collect()
    assert {(r["id"], r["neighbour"], round(r["cos"], 5)) for r in two} == {("a", "b", -1.0), ("b", "a", -1.0)}


def test_more_lists_than_the_sample_bears_are_never_made(spark, monkeypatch):
    seen = []

    def fit(vectors, lists, probes, groups):
        seen.append((len(vectors), lists, probes))
        return kept(vectors, lists, probes, groups)

    kept = neighbours.fit
    monkeypatch.setattr(neighbours, "fit", fit)
    rows = [(str(i), v.tolist()) for i, v in enumerate(np.random.default_rng(4).normal(size=(4000, 8)))]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    neighbours.similar(df, "id", ["v"], dim=8)
    monkeypatch.setattr(neighbours, "SAMPLE", 1600)
    neighbours.similar(df, "id", ["v"], dim=8)
    assert seen[0] == (4000, 126, 18) and seen[1][0] <= 1600 and seen[1][1:] == (40, 10)


def test_quantiser_keeps_real_residuals_and_many_lists():
    x = neighbours._unit(np.random.default_rng(5).normal(size=(60_000, 16)))
    m = neighbours.fit(x, 1500, 60, 6)
    assert 1300 <= m.lists <= 1700 and np.abs(m.books).max() > 0.05
    cell = m.nearest(x[:500], 1)[:, 0]
    rest = x[:500] - m.centres[cell]
    parts, _, width = m.books.shape
    coded = np.stack([m.books[p][m.encode(x[:500], cell)[:, p]] for p in range(parts)], axis=1).reshape(500, -1)
    assert np.linalg.norm(rest - coded, axis=1).mean() < 0.3 * np.linalg.norm(rest, axis=1).mean()


def test_a_hot_direction_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP", 20)
    rng = np.random.default_rng(6)
    v = rng.normal(size=16)
    x = [(f"z{i}", (v * (i + 1)).tolist(), None) for i in range(9)] + [(f"h{i:03}", [1.0, *[0.0] * 15], [1.0] * 16) for i in range(150)]
    x += [(f"r{i:03}", rng.normal(size=16).tolist(), None) for i in range(300)]
    df = spark.createDataFrame(x, "id string, v array<double>, w array<double>")
    rows = neighbours.similar(df, "id", ["v", "w"], dim=16, probes=10_000).orderBy("rank").collect()
    got: dict[tuple[str, str], list[str]] = {}
    for r in rows:
        got.setdefault((r["field"], r["id"]), []).append(r["neighbour"])
    assert got["v", "z8"] == ["z0", "z1", "z2", "z3", "z4"] and got["v", "h149"] == got["w", "h149"] == ["h000", "h001", "h002", "h003", "h004"]
    asked = df.filter("id like 'r%0'").select("id")
    kept = {(r["field"]): (r["asked"], r["recall"]) for r in neighbours.recall(neighbours.similar(df, "id", ["v", "w"], dim=16, probes=10_000), df, "id", ["v", "w"], asked, dim=16).collect()}
    assert kept == {"v": (30, 1.0)}


# 6. Containers


def test_packing_places_everything_once_within_capacity(spark):
    rnd = random.Random(4)
    items = [(i, rnd.choice([0, 1, 5, 99, 100, 101, 250, rnd.randrange(1, 100)])) for i in range(3000)] + [(9001, None), (9002, -3)]
    df = spark.createDataFrame(items, "id int, tokens long")
    rows = packing.pack(df, "id", "tokens", 100, shard_items=500).collect()
    per, bins = {}, {}
    for r in rows:
        per[int(r["item"])] = per.get(int(r["item"]), 0) + r["size"]
        assert (r["container"] is None) == (r["size"] == 0)
        if r["container"]:
            bins[r["container"]] = bins.get(r["container"], 0) + r["size"]
        assert r["n_parts"] == max(1, -(-max(0, dict(items)[int(r["item"])] or 0) // 100))
    assert per == {i: max(0, n or 0) for i, n in items} and max(bins.values()) <= 100
    assert sum(bins.values()) / (100 * len(bins)) > 0.97
    assert packing.pack(df.limit(0), "id", "tokens", 100).count() == 0


def test_no_level_packs_more_than_a_shard_holds(spark, monkeypatch):
    seen, packer = [], packing._packer
    monkeypatch.setattr(packing, "_packer", lambda capacity, level: seen.append(level) or packer(capacity, level))
    half = spark.range(4000).select("id", F.lit(51).cast("long").alias("tokens"))
    rows = packing.pack(half, "id", "tokens", 100, shard_items=200).collect()
    assert len({r["container"] for r in rows}) == 4000 and seen == [0]
    assert max(sum(r["container"].startswith(f"0-{s}-") for r in rows) for s in range(20)) < 300


def test_packing_keeps_unnamed_and_repeated_items(spark):
    items = [(None, 30), (None, 230), (None, 100), (None, 0), ("a", 60), ("a", 60), ("a", 100), ("a", 100), ("b", 250), ("b", 250)]
    rows = packing.pack(spark.createDataFrame(items, "id string, tokens long"), "id", "tokens", 100).collect()
    want = [(i, k, max(1, -(-n // 100)), min(100, n - 100 * k)) for i, n in items for k in range(max(1, -(-n // 100)))]
    assert sorted(map(repr, want)) == sorted(repr((r["item"], r["part"], r["n_parts"], r["size"])) for r in rows)
    bins: dict[str, int] = {}
    for r in rows:
        if r["container"]:
            bins[r["container"]] = bins.get(r["container"], 0) + r["size"]
    assert max(bins.values()) <= 100 and sum(bins.values()) == sum(n for _, n in items)


def test_sum_of_squares_takes_the_least_sum():
    rnd = random.Random(6)
    sizes = np.array([rnd.randrange(1, 10) for _ in range(200)])
    where, gaps = packing.sum_of_squares(sizes, 10)
    left: list[int] = []
    for s, b in zip(sizes.tolist(), where.tolist(), strict=True):
        def total(change):
            n: dict[int, int] = {}
            for g in change:
                if 0 < g < 10:
                    n[g] = n.get(g, 0) + 1
            return sum(v * v for v in n.values())
        options = [total([*left[:i], g - s, *left[i + 1 :]]) for i, g in enumerate(left) if g >= s] + [total([*left, 10 - s])]
        if b == len(left):
            left.append(10)
        left[b] -= s
        assert left[b] >= 0 and total(left) == min(options)
    assert left == gaps.tolist()


# 7. Mixtures


def test_mixture_reaches_shares_within_caps(spark):
    rows = [(i, " Big " if i % 2 else "big", 10, 1.0) for i in range(2000)] + [(9000 + i, "small", 10, 2.0) for i in range(30)] + [(9900, None, 500, 1.0), (9901, "other", None, None)]
    sized = spark.createDataFrame(rows, "id long, source string, size long, weight double")
    targets = spark.createDataFrame([("BIG", 0.5, 1), ("small", 0.05, 3), ("none", 0.2, 2), ("rest", 0.25, 0)], "source string, target_weight double, max_repeat int")
    m = mixing.mix(sized, targets)
    total = 2000 * 10 + 300 + 500
    report = {r["source"]: r for r in m.report.collect()}
    assert abs(report["big"]["used"] - 0.5 * total) <= 10 and not report["big"]["short"]
    assert report["small"]["used"] == 900 and report["small"]["short"] and report["small"]["most_copies"] == 3
    assert report["none"]["short"] and report["none"]["used"] == 0
    chosen = {r["id"]: r["copies"] for r in m.chosen.collect()}
    assert len(chosen) == sum(1 for _ in chosen) and all(chosen[9000 + i] == 3 for i in range(30))
    once = mixing.mix(sized, targets.filter("source = 'small'").withColumn("target_weight", F.lit(0.02)))
    copies = [r["copies"] for r in once.chosen.collect()]
    assert sum(copies) * 10 <= 0.02 * total < (sum(copies) + 1) * 10 and set(copies) <= {1, 2}
    assert mixing.mix(sized.limit(0), targets).chosen.count() == 0


@pytest.mark.parametrize("weights", ["equal", "tiny", "wide"])
def test_budget_ends_in_a_range_of_few_records(spark, monkeypatch, weights):
    monkeypatch.setattr(mixing, "SORTED", 20)
    rnd = random.Random(9)
    weight = {"equal": lambda: 1.0, "tiny": lambda: None, "wide": lambda: 10 ** rnd.uniform(-5, 5)}[weights]
    rows = [(i if i < 700 else 7, "a" if i % 3 else "b", rnd.randrange(0, 40), weight()) for i in range(1000)] + [(None, "a", 5, 1.0)] * 500
    sized = spark.createDataFrame(rows, "id long, source string, size long, weight double")
    targets = spark.createDataFrame([("a", 0.31, 2), ("b", 0.2, 1)], "source string, target_weight double, max_repeat int")
    m = mixing.mix(sized, targets)
    for r in m.report.collect():
        assert 0 <= r["budget"] - r["used"] < 40 and r["most_copies"] <= r["max_repeat"]
    ids = [r["id"] for r in m.chosen.collect()]
    assert sorted(map(str, ids)) == sorted(str(r["id"]) for r in mixing.mix(sized, targets).chosen.collect())
    unnamed = mixing.mix(sized.filter("id is null"), targets.limit(1)).report.collect()
    assert [(r["budget"], r["used"]) for r in unnamed] == [(775.0, 775)]


# 8. Shared spans


@pytest.mark.parametrize("seed", range(6))
def test_index_matches_equal_brute_force(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([3, 6, 20])
    texts = ["".join(rnd.choice("abé中") for _ in range(rnd.randrange(60))) for _ in range(10)]
    texts += [t[2:40] for t in texts]
    own = [rnd.randrange(5) for _ in texts]
    ix = FMIndex(texts, np.array(own), cap)
    streamed = [*texts[:5], "".join(rnd.choice("abz") for _ in range(50)), ""]
    got = {(i, p, tuple(ix.owners[ix.owner_lo[c] : ix.owner_hi[c]].tolist())) for i, p, c in zip(*map(np.ndarray.tolist, ix.matches(streamed)), strict=True)}
    want = set()
    for i, q in enumerate(streamed):
        for p in range(len(q) - cap + 1):
            if found := sorted({o for o, t in zip(own, texts, strict=True) if q[p : p + cap] in t}):
                want.add((i, p, tuple(found)))
    assert got == want


def test_index_goes_beyond_256_characters():
    rnd = random.Random(1)
    base = "".join(rnd.choice("abcd") for _ in range(900))
    ix = FMIndex([base, "x" + base[100:500] + "y"], np.array([1, 2]), 300)
    got = {(p, tuple(ix.owners[ix.owner_lo[c] : ix.owner_hi[c]].tolist())) for _, p, c in zip(*map(np.ndarray.tolist, ix.matches([base[50:600]])), strict=True)}
    assert got == {(p, (1, 2) if 50 <= p <= 150 else (1,)) for p in range(251)}


@pytest.mark.parametrize("hot", [2, 64])
def test_shared_spans_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    monkeypatch.setattr(spans, "ROWS", 50)
    monkeypatch.setattr(spans, "SHARD", 3000)
    monkeypatch.setattr(spans, "STREAM", 3000)
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefgh \n中é") for _ in range(n))
    docs = {i: text(rnd.randrange(50, 900)) for i in range(40)}
    common, long = text(260), text(3000)
    for i in range(40, 60):
        docs[i] = text(rnd.randrange(100)) + (common if i % 2 else long[rnd.randrange(900) :][: rnd.randrange(190, 2500)]) + text(rnd.randrange(100))
    docs |= {60: docs[3] + "x", 61: docs[45], 62: docs[45], 63: "-" * 700, 64: "y" + "-" * 300, 65: None, 66: "", 67: long[:199] + "!" + long[200:399]}
    df = spark.createDataFrame([(i, t, "k") for i, t in docs.items()] + [(1, docs[1], "k")], "doc_id long, text string, a string")
    n = 200
    where: dict[str, dict[int, list[int]]] = {}
    for i, t in docs.items():
        for p in range(len(t or "") - n + 1):
            where.setdefault(t[p : p + n], {}).setdefault(i, []).append(p)
    pairs, covered = set(), {}
    for m in where.values():
        if len(m) > 1:
            pairs |= {(a, b) for a in m for b in m if a < b}
            for i, ps in m.items():
                for p in ps:
                    covered.setdefault(i, set()).update(range(p, p + n))
    got = spans.expand(*spans.shared_pairs(df, "doc_id", "text"))
    assert {tuple(r) for r in got.collect()} == pairs
    sums: dict[int, int] = {}
    for r in spans.shared_spans(df, "doc_id", "text").collect():
        sums[r["id"]] = sums.get(r["id"], 0) + r["stop"] - r["start"]
    assert sums == {i: len(c) for i, c in covered.items()}
    found, members = spans.pair_spans(df, "doc_id", "text")
    rep = {r["id"]: r["rep"] for r in members.collect()}
    want: dict[tuple[int, int], set[int]] = {}
    for m in where.values():
        for x in {rep[i] for i in m}:
            for y in {rep[i] for i in m} - {x}:
                want.setdefault((x, y), set()).update(m[x])
    runs = {(*k, p, next(q for q in range(p, 10_000) if q not in ps) - 1 + n) for k, ps in want.items() for p in ps if p - 1 not in ps}
    assert {tuple(r) for r in found.collect()} == runs
    assert spans.shared_pairs(df.limit(0), "doc_id", "text")[0].count() == 0
