"""The k most similar vectors of every vector: inverted file with product-quantised residuals.

Fit (on a bounded sample): coarse centroids by two levels of k-means; the residuals' parts are quantised by
``PARTS`` codebooks of 256 centres each. There are about 2 sqrt(n) lists, each with ``PER_LIST`` sample
vectors at least, so the sample is of min(n, PER_LIST x lists) vectors and never of more than ``SAMPLE``;
that bounds the lists too, and the model to a few MB.
Index: every distinct vector is put into the list of its nearest centroid, with the codes of its residual.
Search: every vector asks its nearest lists, ``PROBES`` times the square root of their number. Per list,
asymmetric distances (the query's exact parts against the codebooks' entries) score all codes, for all queries of
the list in one matrix product; the best ``RERANK`` candidates are scored again with their exact vectors, and the best k of all lists stay. A query
thus scores about n^(3/4) codes, until n exceeds (SAMPLE / PER_LIST / 2)^2, some 25 million.

Lists near each other form a group, of about ``GROUP`` vectors, so that a query goes to few groups. A group
is searched in one task, unless it came out several times as large: then its rows are parted into blocks
and its queries into turns, and each turn asks each block. Vectors of equal direction (to six digits) are one
vector with members, so a vector that a third of all rows has is indexed and asked once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import cut

SAMPLE, PER_LIST, PROBES, PARTS, RERANK, GROUP = 200_000, 40, 1.6, 16, 96, 10_000
CELLS, TOGETHER = 4_000_000, 64  # of a search: scores of codes at once, and queries whose best are chosen at once
QUERIES = 256  # asked at once when recall is measured
DIGITS = 6  # of a cosine, and of the vectors that count as equal


def usable(v, dim: int):
    """Column: the vector where it has ``dim`` finite values that aren't all zero, null elsewhere."""
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.when(F.coalesce(good, F.lit(False)), v)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres by Lloyd's algorithm; an empty one restarts at the point farthest from its centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, far = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
        half = (c * c).sum(1) / 2
        for a in range(0, len(x), 4096):
            s = half - x[a : a + 4096] @ c.T
            near[a : a + 4096] = s.argmin(1)
            far[a : a + 4096] = s.min(1)
        count = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c).astype(np.float32)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            c[empty] = x[np.argsort(-far)[: len(empty)]]
    return c


def coarse(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """About k centres: of sqrt(k) first, then some for the vectors next to each, by their number."""
    if k <= 1024:
        return kmeans(x, k, 8, seed)
    top = kmeans(x, int(k**0.5), 8, seed)
    half, near = (top * top).sum(1) / 2, np.empty(len(x), np.int64)
    for a in range(0, len(x), 4096):
        near[a : a + 4096] = (half - x[a : a + 4096] @ top.T).argmin(1)
    order = np.argsort(near, kind="stable")
    parts = np.split(order, np.cumsum(np.bincount(near, minlength=len(top)))[:-1])
    return np.concatenate([kmeans(x[p], max(1, round(k * len(p) / len(x))), 8, seed) for p in parts if len(p)])


@dataclass
class Model:
    centres: np.ndarray  # lists x dim
    group: np.ndarray  # cell group of each list
    books: np.ndarray  # parts x 256 x dim / parts
    probes: int

    @property
    def lists(self) -> int:
        return len(self.centres)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first."""
        s = (self.centres * self.centres).sum(1) / 2 - x @ self.centres.T
        n = min(n, self.lists)
        best = np.argpartition(s, n - 1, axis=1)[:, :n] if n < self.lists else np.broadcast_to(np.arange(self.lists), s.shape)
        return np.take_along_axis(best, np.take_along_axis(s, best, 1).argsort(1), 1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        r = (x - self.centres[cell]).reshape(len(x), parts, width)
        out = np.empty((len(x), parts), np.uint8)
        for p in range(parts):
            b = self.books[p]
            out[:, p] = ((b * b).sum(1) / 2 - r[:, p] @ b.T).argmin(1)
        return out


def fit(vectors: np.ndarray, lists: int, probes: int, groups: int, seed: int = 5) -> Model:
    """A model from a sample of unit vectors."""
    dim = vectors.shape[1]
    parts = PARTS if dim % PARTS == 0 else 1
    if not len(vectors):
        return Model(np.zeros((1, dim), np.float32), np.zeros(1, np.int64), np.zeros((parts, 1, dim // parts), np.float32), 1)
    centres = coarse(vectors, lists, seed)
    model = Model(centres, np.zeros(len(centres), np.int64), np.zeros((parts, 1, dim // parts), np.float32), probes)
    residual = (vectors - centres[model.nearest(vectors, 1)[:, 0]]).reshape(len(vectors), parts, -1)[:40_000]
    books = [kmeans(np.ascontiguousarray(residual[:, p]), 256, 6, seed + p) for p in range(parts)]
    width = max(map(len, books))
    model.books = np.stack([np.concatenate([b, np.repeat(b[:1], width - len(b), 0)]) for b in books])
    if groups > 1:
        top = kmeans(centres, groups, 10, seed)
        model.group = ((top * top).sum(1) / 2 - centres @ top.T).argmin(1)
    return model


def _placer(models: list[Model], first: list[int], dim: int):
    """The list of each vector, its group, its codes, and the groups that it asks. Groups are numbered from ``first``."""

    @F.pandas_udf("struct<unit:binary,cell:int,grp:int,codes:binary,ask:array<int>>")
    def place(fields: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        n = len(vectors)
        unit, cell, grp, codes, ask = ([None] * n for _ in range(5))
        for f in fields.unique():
            at = np.flatnonzero(fields.to_numpy() == f)
            model, x = models[f], np.frombuffer(b"".join(vectors.iloc[at]), np.float32).reshape(-1, dim)
            near = np.concatenate([model.nearest(x[a : a + 2048], model.probes) for a in range(0, len(x), 2048)])
            groups = np.sort(model.group[near], axis=1) + first[f]
            new = np.ones(groups.shape, bool)
            new[:, 1:] = groups[:, 1:] != groups[:, :-1]
            asked = np.split(groups[new].astype(np.int32), np.cumsum(new.sum(1))[:-1])
            own, code = near[:, 0], model.encode(x, near[:, 0]).tobytes()
            width = len(code) // max(1, len(x))
            for k, i in enumerate(at.tolist()):
                cell[i], grp[i], codes[i], ask[i] = int(own[k]), int(model.group[own[k]]) + first[f], code[k * width : (k + 1) * width], asked[k]
        return pd.DataFrame({"unit": vectors, "cell": cell, "grp": grp, "codes": codes, "ask": ask})

    return place


def _united():
    """Unit vectors as bytes, and rounded to whole ``DIGITS``-th parts, as bytes too."""

    @F.pandas_udf("struct<unit:binary,rounded:binary>")
    def united(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"unit": [], "rounded": []}, dtype=object)
        unit, width = _unit(np.stack(vectors.to_numpy())), 4 * len(vectors.iloc[0])
        both = unit.tobytes(), np.round(unit.astype(np.float64) * 10**DIGITS).astype(np.int32).tobytes()
        return pd.DataFrame({name: [raw[a : a + width] for a in range(0, len(raw), width)] for name, raw in zip(("unit", "rounded"), both, strict=True)})

    return united


def _searcher(models: list[Model], dim: int, k: int):
    near_by = 10.0**-DIGITS + dim * 2.0**-22  # rounded cosines that are equal or reversed differ by less in 32 bits

    def best(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of the ``RERANK`` largest of each row that aren't -inf, row by row."""
        floor = np.full(len(score), np.finfo(np.float32).min, np.float32)
        if score.shape[1] > RERANK:
            floor = np.maximum(floor, np.partition(score, score.shape[1] - RERANK, axis=1)[:, score.shape[1] - RERANK])
        at = np.flatnonzero(score >= floor[:, None])
        row, col = at // score.shape[1], at % score.shape[1]
        if len(at) and np.bincount(row).max() > RERANK:  # equal ones at the end
            by = np.lexsort([-score.reshape(-1)[at], row])
            by = by[_rank(row) < RERANK]
            row, col = row[by], col[by]
        return row, col

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        model = models[rows["f"].iloc[0]]
        parts = model.books.shape[0]
        own, asks = rows[rows["own"]].sort_values("cell", kind="stable"), rows[rows["asks"]]
        ids, ties, cells = own["no"].to_numpy(), own["h1"].to_numpy(), own["cell"].to_numpy()
        x = np.frombuffer(b"".join(own["unit"]), np.float32).reshape(-1, dim)
        codes = np.frombuffer(b"".join(own["codes"]), np.uint8).reshape(-1, parts)
        # The query isn't quantised, so its product with what the codes stand for is the sum over their distance tables.
        coded = model.centres[cells] + model.books[np.arange(parts), codes].reshape(-1, dim)
        lo, hi = np.searchsorted(cells, np.arange(model.lists)), np.searchsorted(cells, np.arange(model.lists), "right")
        qid, q = asks["no"].to_numpy(), np.frombuffer(b"".join(asks["unit"]), np.float32).reshape(-1, dim)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, min(1024, CELLS // max(1, len(own))))
        for a in range(0, len(q), step):
            qs, qi = q[a : a + step], qid[a : a + step]
            near = model.nearest(qs, model.probes)
            size = (hi - lo)[near]
            by = np.argsort(size.sum(1), kind="stable")  # of like length side by side
            qs, qi, near, size = qs[by], qi[by], near[by], size[by]
            # The candidates of a query lie side by side, list by list; TOGETHER queries have room for the most of one of them.
            stop = np.cumsum(size, axis=1)
            width = np.repeat(np.maximum.reduceat(stop[:, -1], np.arange(0, len(qs), TOGETHER)), TOGETHER)[: len(qs)]
            first = np.cumsum(width) - width
            stop += first[:, None]
            flat, start, stop = near.ravel(), (stop - size).ravel(), stop.ravel()
            score = np.full(int(width.sum()), -np.inf, np.float32)
            order = np.argsort(flat, kind="stable")
            order = order[size.ravel()[order] > 0]
            for block in np.split(order, np.flatnonzero(np.diff(flat[order])) + 1) if len(order) else []:
                cell = flat[block[0]]
                score[start[block][:, None] + np.arange(hi[cell] - lo[cell])] = qs[block // near.shape[1]] @ coded[lo[cell] : hi[cell]].T
            for b in range(0, len(qs), TOGETHER):
                n = len(width[b : b + TOGETHER])
                if not width[b]:
                    continue
                w, col = best(score[first[b] : first[b] + n * width[b]].reshape(n, -1))
                w += b
                place = np.searchsorted(stop, first[w] + col, "right")
                cand = lo[flat[place]] + first[w] + col - start[place]
                other = ids[cand] != qi[w]
                w, cand = w[other], cand[other]
                # Exactly in 32 bits first; only what may be among the best k is rounded in 64.
                s = np.einsum("ij,ij->i", x[cand], qs[w])
                by = np.lexsort([-s, w])
                w, cand, s = w[by], cand[by], s[by]
                rank = _rank(w)
                least = np.full(len(qs), -np.inf)
                least[w[rank == k - 1]] = s[rank == k - 1]
                few = s >= least[w] - near_by
                w, cand = w[few], cand[few]
                exact = np.round(np.einsum("ij,ij->i", x[cand].astype(np.float64), qs[w].astype(np.float64)), DIGITS)
                top = np.lexsort([ties[cand], -exact, w])
                top = top[_rank(w) < k]
                out.append((qi[w[top]], ids[cand[top]], exact[top], ties[cand[top]]))
        if not out:
            return pd.DataFrame({"q": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "cos": np.zeros(0), "tie": np.zeros(0, np.int64)})
        return pd.DataFrame(dict(zip(("q", "c", "cos", "tie"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return search


def _rank(group: np.ndarray) -> np.ndarray:
    """The place of each within its run of equal numbers."""
    return np.arange(len(group)) - np.searchsorted(group, group)


def similar(df: DataFrame, id_: str, vectors: list[str], k: int = 5, dim: int = 64, lists: int | None = None, probes: int | None = None) -> DataFrame:
    """For each of the columns ``vectors`` and every row with a usable vector in it, its k most similar other
    rows: ``field`` (the column), ``id``, ``rank`` (from 1), ``neighbour``, ``cos`` (to six digits). Ids are
    compared as text. Vectors of equal cosine go by a hash of their direction; rows of equal direction by their id.

    A row without an id, or whose vector is null, of another length, not finite or all zero, takes no
    part. Rows that repeat an id are one (if their vectors differ, the one of the least hash). Fewer than k
    neighbours come out where there are no more rows. Unless told otherwise, there are about 2 sqrt(n)
    lists, of which 1.6 times the square root of their number, and 8 at least, are asked.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), usable(F.col(f"`{v}`").cast("array<float>"), dim).alias("v")) for i, v in enumerate(vectors)]))
    rows = df.select(F.col(f"`{id_}`").cast("string").alias("id"), each.alias("e")).select("id", "e.f", "e.v").filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    rows = rows.select("id", "f", _united()("v").alias("u")).select("id", "f", "u.unit", F.xxhash64("u.rounded").alias("h1"), F.xxhash64(F.lit(1), "u.rounded").alias("h2"))
    ids = rows.groupBy("f", "id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("f", "id", "h.*")
    # Equal vectors are one; what is written here keeps its number.
    one = rows.groupBy("f", "h1", "h2").agg(F.min_by("unit", "id").alias("unit")).join(ids.select("f", "h1", "h2").distinct(), ["f", "h1", "h2"], "left_semi")
    distinct = cut(one.select("f", "h1", "h2", "unit", F.monotonically_increasing_id().alias("no")))
    members = cut(ids.join(distinct.select("f", "h1", "h2", "no"), ["f", "h1", "h2"]).select("f", "id", "no"))
    counts = dict(distinct.groupBy("f").agg(F.count("*")).collect())  # a row for each of the columns asked
    models, first, groups = [], [], 0
    for f in range(len(vectors)):
        n = counts.get(f, 0)
        wanted = lists or max(1, min(int(2 * n**0.5), SAMPLE // PER_LIST))
        size = min(n, SAMPLE, max(PER_LIST * wanted, 40_000))
        share = int(min(1.0, 1.05 * size / max(n, 1)) * (1 << 20)) + 1
        got = distinct.filter((F.col("f") == f) & (F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 20)) < share)).select("unit").limit(size).toArrow()["unit"] if n else []
        x = np.frombuffer(b"".join(v.as_py() for v in got), np.float32).reshape(-1, dim)
        models.append(fit(x, wanted, probes or min(wanted, max(8, round(PROBES * wanted**0.5))), max(1, -(-n // GROUP))))
        first.append(groups)
        groups += int(models[-1].group.max()) + 1
    placed = cut(distinct.select("f", "no", "h1", _placer(models, first, dim)("f", "unit").alias("p")).select("f", "no", "h1", "p.*"))
    # A large group is parted into blocks of its rows and turns of its queries; every turn asks every block.
    load = placed.select("grp", F.explode("ask").alias("g")).groupBy("g").agg(F.count("*").alias("asks"), F.count_if(F.col("g") == F.col("grp")).alias("rows"))
    load = load.select("g", F.ceil(F.col("rows") / (4 * GROUP)).cast("int").alias("blocks"), F.ceil(F.col("asks") / (4 * GROUP)).cast("int").alias("turns"))
    load = cut(load.filter(F.col("blocks") > 0))
    few = F.broadcast(load) if groups <= 200_000 else load  # a row for each group
    seen = placed.withColumn("g", F.explode("ask")).drop("ask").join(few, "g")
    block, turn = F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64(F.lit(2), "no"), F.col("turns")).cast("int")
    seen = seen.withColumns({"block0": block, "turn0": turn, "owned": F.col("g") == F.col("grp")})
    # An owned row is indexed in its block for every turn, and asks in its turn in every block; one row does both where these meet.
    here = F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda t: F.struct(b.alias("block"), t.alias("turn")))))
    seen = seen.withColumn("at", F.explode(F.filter(here, lambda x: (x["turn"] == F.col("turn0")) | (F.col("owned") & (x["block"] == F.col("block0"))))))
    owns = F.col("owned") & (F.col("at.block") == F.col("block0"))
    both = seen.select("f", "g", "at.block", "at.turn", "no", "h1", "cell", "unit", F.when(owns, F.col("codes")).alias("codes"), owns.alias("own"), (F.col("at.turn") == F.col("turn0")).alias("asks"))
    tasks = load.agg(F.sum(F.col("blocks") * F.col("turns"))).first()[0] or 1
    parts = 4 * tasks if tasks < 2000 else tasks  # they are long for their size, so few of them should meet in a task
    hits = both.repartition(parts, "g", "block", "turn").groupBy("g", "block", "turn").applyInPandas(_searcher(models, dim, k), "q long, c long, cos double, tie long")
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos"), "tie", "c"))).filter(F.col("r") <= k).select("q", "c", "cos")
    # From distinct vectors back to rows: the least k + 1 members of a vector are all that an answer can hold.
    few = members.withColumn("m", F.row_number().over(Window.partitionBy("no").orderBy("id"))).filter(F.col("m") <= k + 1).select(F.col("no").alias("c"), F.col("id").alias("neighbour"))
    mine = members.select("f", F.col("no").alias("q"), "id")
    near = mine.join(hits, "q").join(few, "c").select("f", "id", "neighbour", "cos")
    same = mine.join(few, F.col("q") == F.col("c")).filter(F.col("id") != F.col("neighbour")).select("f", "id", "neighbour", F.lit(1.0).alias("cos"))
    rank = F.row_number().over(Window.partitionBy("f", "id").orderBy(F.desc("cos"), "neighbour"))
    name = F.element_at(F.array(*map(F.lit, vectors)), F.col("f") + 1)
    return near.unionByName(same).withColumn("rank", rank).filter(F.col("rank") <= k).select(name.alias("field"), "id", "rank", "neighbour", "cos")


def recall(found: DataFrame, df: DataFrame, id_: str, vectors: list[str], asked: DataFrame, k: int = 5, dim: int = 64) -> DataFrame:
    """How much of the true answers ``found`` (as made by :func:`similar`) has, for the ids in ``asked`` (column
    ``id``): a row for each column of ``vectors`` with ``field``, ``asked`` and ``recall``. An answer counts if its
    cosine reaches that of the k-th true one. The queries are held against all rows in blocks of ``QUERIES``.
    """
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("field"), usable(F.col(f"`{v}`").cast("array<float>"), dim).alias("v")) for v in vectors]))
    rows = df.select(F.col(f"`{id_}`").cast("string").alias("id"), each.alias("e")).select("id", "e.field", "e.v").filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    rows = rows.groupBy("field", "id").agg(F.first("v").alias("v")).select("field", "id", _united()("v").unit.alias("unit"))
    blocks = max(1, -(-asked.count() // QUERIES))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    queries = rows.join(asked.select("id"), "id", "left_semi").groupBy("field", block.alias("block")).agg(F.collect_list(F.struct("id", "unit")).alias("queries"))

    def best(batches):
        for b in batches:
            out = []
            for queries_, part in b.groupby(["field", "block"]):
                qs = part["queries"].iloc[0]
                q = np.frombuffer(b"".join(x["unit"] for x in qs), np.float32).reshape(-1, dim).astype(np.float64)
                s = np.round(np.frombuffer(b"".join(part["unit"]), np.float32).reshape(-1, dim).astype(np.float64) @ q.T, DIGITS)
                ids = part["id"].to_numpy()
                for j, x in enumerate(qs):
                    col = np.where(ids == x["id"], -2.0, s[:, j])
                    top = np.argpartition(-col, min(k, len(col) - 1))[:k]
                    out += [(queries_[0], x["id"], float(c)) for c in col[top] if c > -2]
            yield pd.DataFrame(out, columns=["field", "id", "cos"])

    if blocks <= 64:  # some 5 MB a column
        queries = F.broadcast(queries)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256)))
        queries = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(255))).cast("long"))
    hits = rows.join(queries, "field" if blocks <= 64 else ["field", "salt"]).drop("salt").mapInPandas(best, "field string, id string, cos double")
    by = Window.partitionBy("field", "id").orderBy(F.desc("cos"))
    kth = hits.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k).groupBy("field", "id").agg(F.min("cos").alias("least"), F.count("*").alias("true"))
    got = kth.join(found.select("field", "id", "cos"), ["field", "id"], "left").groupBy("field", "id").agg(F.first("true").alias("true"), F.count_if(F.col("cos") >= F.col("least") - 2e-6).alias("hit"))
    return got.groupBy("field").agg(F.count("*").alias("asked"), (F.sum(F.least("hit", "true")) / F.sum("true")).alias("recall"))
