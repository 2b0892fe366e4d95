"""Memory graphs as two tables: nodes, and edges (``src``, ``dst``, ``kind``)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.session import cut


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Each triple once."""
    return edges.unionByName(new).dropDuplicates(["src", "dst", "kind"])


def neighbours(edges: DataFrame, seeds: DataFrame, direction: str = "both") -> DataFrame:
    """``id``, ``neighbour`` of every seed (``id``); in, out or both ways, each once."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"))
    way = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return way.join(seeds.select("id").distinct(), "id", "left_semi").distinct()


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """``seed``, ``id``, ``hops``: everything within ``depth`` steps, the seed itself at 0. Each round joins
    only the rows reached in the round before."""
    step = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if not directed:
        step = step.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    step = step.distinct()
    seen = frontier = seeds.select(F.col("id").alias("seed"), F.col("id"), F.lit(0).alias("hops"))
    for hop in range(1, depth + 1):
        fresh = frontier.join(step, frontier["id"] == step["a"]).select("seed", F.col("b").alias("id")).distinct()
        frontier = cut(fresh.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def paths(edges: DataFrame, src, dst, depth: int = 3) -> DataFrame:
    """Simple directed paths of at most ``depth`` edges from ``src`` to ``dst``, as arrays of nodes. What was reached
    is written after each step, so that no step starts from the beginning."""
    grown = edges.filter(F.col("src") == src).select(F.array("src", "dst").alias("path"))
    out = grown.filter(F.element_at("path", -1) == dst)
    for _ in range(depth - 1):
        open_ = grown.filter(F.element_at("path", -1) != dst)
        grown = cut(open_).join(edges, F.element_at("path", -1) == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        out = out.unionByName(grown.filter(F.element_at("path", -1) == dst))
    return out.select("path", (F.size("path") - 1).alias("length"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (``id``) without any edge."""
    return nodes.join(edges, nodes["id"] == edges["src"], "left_anti").join(edges, F.col("id") == edges["dst"], "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Active nodes without an outgoing edge to any node; flushed nodes count as active."""
    return nodes.filter(F.col("status").isin("active", "flushed")).join(edges, F.col("id") == edges["src"], "left_anti")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes in ``gone`` (``id``) and all edges at them."""
    g = gone.select("id").distinct()
    kept = edges.join(g, edges["src"] == g["id"], "left_anti").join(g, F.col("dst") == g["id"], "left_anti")
    return nodes.join(g, "id", "left_anti"), kept


def fold(edges: DataFrame, members: list, summary, rationale: str) -> DataFrame:
    """Edges after the members became one summary node: inner edges go, incoming ones take the new
    rationale, outgoing ones keep theirs."""
    s, d = F.col("src").isin(members), F.col("dst").isin(members)
    kept = edges.filter(~(s & d))
    return kept.select(
        F.when(s, F.lit(summary)).otherwise(F.col("src")).alias("src"), F.when(d, F.lit(summary)).otherwise(F.col("dst")).alias("dst"), F.when(d, F.lit(rationale)).otherwise(F.col("kind")).alias("kind")
    ).distinct()


def removed_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the triples in ``gone`` (``src``, ``dst``, ``kind``)."""
    return edges.join(gone, ["src", "dst", "kind"], "left_anti")


def subgraph(edges: DataFrame, centre: DataFrame, depth: int) -> DataFrame:
    """Edges between the nodes that are within ``depth`` directed steps of the centres (``id``)."""
    near = cut(k_hop(edges, centre, depth, True).select("id").distinct())
    inside = edges.join(near.select(F.col("id").alias("src")), "src", "left_semi")
    return inside.join(near.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "kind")


def components(edges: DataFrame) -> DataFrame:
    """Of each end of the pairs ``x``, ``y``: ``id`` and ``root``, the least one it is linked to by any chain of pairs.

    Alternating stars: each node's larger neighbours, then its smaller ones, are linked to the least node next to
    it. That joins nothing new and cuts nothing, and the chains get about half as long each time, until every node
    has one link, to the least of its group. The driver only hears whether that is so.
    """
    edges = cut(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct())
    while True:
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or (up = 1 and down > 0)").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def forest(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """For each root (``id``) of a forest: ``depth``, ``nodes``, ``leaves``, ``branches`` (nodes with two children or more) and ``widest``, the most nodes of a level."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("children"))
    level = reached = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("hops"))
    while not (level := cut(level.join(edges, level["id"] == edges["src"]).select("root", F.col("dst").alias("id"), (F.col("hops") + 1).alias("hops")))).isEmpty():
        reached = reached.unionByName(level)
    nodes = cut(reached.join(out, "id", "left"))
    per = nodes.groupBy("root", "hops").agg(F.count("*").alias("n"), F.count_if(F.col("children").isNull()).alias("leaves"), F.count_if(F.col("children") >= 2).alias("branches"))
    return per.groupBy("root").agg(F.max("hops").alias("depth"), F.sum("n").alias("nodes"), F.sum("leaves").alias("leaves"), F.sum("branches").alias("branches"), F.max("n").alias("widest"))


PIVOTS, CELL = 256, 2000


def similar_pairs(nodes: DataFrame, least: float) -> DataFrame:
    """Pairs ``x`` < ``y`` of nodes (``id``, ``v``) whose cosine is above ``least`` (0 or more), with ``cos``; exact.

    Vectors of unit length with that cosine are closer than r = sqrt(2 - 2 least). Each vector belongs to the nearest of some
    pivots (vectors of a bounded sample), and is copied to every other pivot that is at most 2 r farther: by the triangle
    inequality no pair is lost. A pivot's own vectors meet in blocks of about ``CELL``. Unusable vectors are in no pair.
    """
    rows = nodes.filter(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: ~F.isnan(x.cast("double")))).select("id", "v")
    n = rows.count()
    share = min(1.0, 4.0 * PIVOTS / max(n, 1))
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("v").limit(min(PIVOTS, max(1, n // CELL))).collect()
    if not sample:
        return nodes.sparkSession.createDataFrame([], T.StructType([T.StructField("x", nodes.schema["id"].dataType), T.StructField("y", nodes.schema["id"].dataType), T.StructField("cos", T.DoubleType())]))
    p = np.stack([np.asarray(r["v"], float) for r in sample])
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    reach = 2 * (2 - 2 * least) ** 0.5 + 1e-9

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        d = np.sqrt(np.maximum(2 - 2 * x @ p.T, 0))
        own = d.argmin(1)
        return pd.Series([[int(o), *[int(j) for j in np.flatnonzero(row <= row[o] + reach) if j != o]] for o, row in zip(own, d, strict=True)])

    placed = cut(rows.withColumn("cells", cells("v")))
    size = placed.groupBy(F.col("cells")[0].alias("cell")).agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    spread = placed.select("id", "v", F.posexplode("cells").alias("k", "cell")).join(F.broadcast(size), "cell")  # a row for each pivot
    own = spread.filter("k = 0").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("own", F.lit(True))
    others = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("own", F.lit(False))
    both = own.unionByName(others).select("cell", "block", "id", "v", "own")

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["v"].to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids, mine = rows["id"].to_numpy(), rows["own"].to_numpy()
        out = []
        for i in np.flatnonzero(mine):
            cos = np.round(x[~mine] @ x[i], 6)
            hit = (cos > least) & (ids[~mine] > ids[i])  # the cell of the smaller id tells
            out.append(pd.DataFrame({"x": ids[i], "y": ids[~mine][hit], "cos": cos[hit]}))
        return pd.concat(out) if out else pd.DataFrame({"x": ids[:0], "y": ids[:0], "cos": np.zeros(0)})

    kind = nodes.schema["id"].dataType
    return both.groupBy("cell", "block").applyInPandas(match, T.StructType([T.StructField("x", kind), T.StructField("y", kind), T.StructField("cos", T.DoubleType())]))


def similarity_edges(nodes: DataFrame, least: float = 0.8, share: float = 0.3, overlap: bool = False) -> DataFrame:
    """``src`` > ``dst``, ``weight`` of the nodes (``id``, ``v``, ``tags``) with a cosine above ``least``: (1 - share) cosine + share x
    the tags' Jaccard coefficient, or with ``overlap`` what they have in common over the smaller set; 0 where one has none."""
    tags = nodes.select("id", F.coalesce("tags", F.array().cast("array<string>")).alias("t"))
    rows = similar_pairs(nodes, least).join(tags.select(F.col("id").alias("x"), F.col("t").alias("a")), "x").join(tags.select(F.col("id").alias("y"), F.col("t").alias("b")), "y")
    a, b = F.array_distinct("a"), F.array_distinct("b")
    of = F.least(F.size(a), F.size(b)) if overlap else F.size(F.array_union(a, b))
    like = F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), of), F.lit(0.0))
    return rows.select(F.col("y").alias("src"), F.col("x").alias("dst"), ((1 - share) * F.col("cos") + share * like).alias("weight"))


def walk(edges: DataFrame, seeds: DataFrame, k: int, gate: DataFrame | None = None) -> DataFrame:
    """Best first from the seeds (``qid``, ``id``, ``score``): ``qid``, ``id``, ``step`` of the first k nodes visited. A seed costs 1 / score,
    a neighbour 1 / weight more than the node it is reached from; the cheapest node is next, the smaller id of equal ones.
    ``gate`` (``qid``, ``id``), if given, names the only nodes that may be reached."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    open_ = seeds.groupBy("qid", "id").agg((1.0 / F.greatest(F.max("score"), F.lit(1e-9))).alias("cost"))
    seen = None
    for step in range(k):
        best = cut(open_.groupBy("qid").agg(F.min(F.struct("cost", "id")).alias("b")).select("qid", "b.*"))
        if best.isEmpty():
            break
        now = best.select("qid", "id", F.lit(step).alias("step"))
        seen = now if seen is None else seen.unionByName(now)
        fresh = best.join(both, best["id"] == both["src"]).select("qid", F.col("dst").alias("id"), (F.col("cost") + 1.0 / F.greatest("weight", F.lit(1e-9))).alias("cost"))
        if gate is not None:
            fresh = fresh.join(gate, ["qid", "id"], "left_semi")
        open_ = cut(open_.unionByName(fresh).join(seen.select("qid", "id"), ["qid", "id"], "left_anti").groupBy("qid", "id").agg(F.min("cost").alias("cost")))
    return seen if seen is not None else seeds.select("qid", "id", F.lit(0).alias("step")).limit(0)


def flush(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """The nodes in ``gone`` (``id``) keep their place, with the status "flushed"."""
    hit = gone.select("id", F.lit(True).alias("__hit")).distinct()
    return nodes.join(hit, "id", "left").withColumn("status", F.when(F.col("__hit"), "flushed").otherwise(F.col("status"))).drop("__hit")


def patched(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a patch. New nodes come with temporary ids (``temp``) and get the next numbers after the highest
    id, in their order; the ends of new edges (texts) name temporary or existing ids. An edge with an unknown end is left out."""
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    w = Window.orderBy("temp")  # over one patch
    named = new_nodes.withColumn("id", (F.row_number().over(w) + top.scalar()).cast("long"))
    known = nodes.select(F.col("id").cast("string").alias("name"), "id").unionByName(named.select(F.col("temp").alias("name"), "id"))
    ends = new_edges.join(known.select(F.col("name").alias("src"), F.col("id").alias("s")), "src").join(known.select(F.col("name").alias("dst"), F.col("id").alias("d")), "dst")
    return nodes.unionByName(named.select(*nodes.columns)), add_edges(edges, ends.select(F.col("s").alias("src"), F.col("d").alias("dst"), "kind"))


def balanced_sample(nodes: DataFrame, kind: str, total: int, key: str) -> DataFrame:
    """About ``total`` nodes, as many of each kind as its share is, at least one; the first by the digest of their key."""
    n = nodes.agg(F.count("*").alias("n"))
    per = nodes.groupBy(kind).agg(F.count("*").alias("c"))
    quota = F.greatest(F.lit(1), F.floor(F.col("c") * total / n.scalar()))
    w = Window.partitionBy(kind).orderBy(F.md5(F.col(key).cast("string")), key)
    return nodes.join(per.withColumn("quota", quota), kind).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= F.col("quota")).drop("__r", "c", "quota")
