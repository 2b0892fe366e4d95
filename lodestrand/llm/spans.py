"""Long exact spans shared between records.

1. Equal texts are one: their first id stands for them, and the others are members.
2. Each text is sampled by its content: of every ``WINDOW`` successive substrings of ``SEED`` characters the
   one with the least hash is taken, so any stretch of ``least`` characters that two texts share gives both
   the same hash. Only hashes that occur in two different texts go on. One that more than ``HOT`` texts have may be
   a phrase shorter than ``least``, so it is replaced by longer ones: a stretch around the seed has half of its
   other characters on one side of it at least, half of the rest on one side of that, and so on, ``HALVINGS`` times;
   each of the ways is a substring, and two texts that share the stretch share one of these. The text around
   what is left, as far as a stretch can reach, is a unit. This loses nothing and leaves out text that can't be shared.
3. Units are dealt to shards by document. Each shard's units make an FM-index (see ``fmindex``), and every
   unit that has a hash in common with a shard is streamed through it: matching statistics by backward
   search give all places where it agrees with the shard in ``least`` characters, and with which documents.

A shard holds at most about ``SHARD`` characters, whatever the corpus. A shard whose stream is longer than
``STREAM`` is searched by several tasks. For pairs, what is streamed follows the number of pairs there are. To tell
only how much of a text occurs elsewhere, no pairs are needed: the stretches around what more than ``HOT`` texts
have even after the halvings are then counted by their digests, so that the work stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.fmindex import FMIndex
from lodestrand.llm.hashing import powers
from lodestrand.session import cut

LEAST, SHARD, STREAM, UNIT = 200, 1_500_000, 4_000_000, 2048
HOT, HALVINGS = 64, 3
ROWS = 2_000_000  # of a result that a task makes at once
BLOCK = 1 << 18  # characters that are hashed at once


def _seeds(points: np.ndarray, starts: np.ndarray, seed: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``points`` of the sampled substrings, ascending, and their hashes. ``starts``: where each text starts."""
    n = len(points)
    up, down = powers(max(n + 1, BLOCK))
    mask = np.uint64((1 << 20) - 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    h = (sums[seed:] - sums[:-seed]) * down[: n - seed + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    m = len(h)
    # The least hash wins, of equal ones the rightmost: the position, counted from the right, is in the low bits.
    key = (h & ~mask) | (mask - np.arange(m, dtype=np.uint64))
    padded = np.full(-(-m // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = key
    rows = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()[window - 1 : m]
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[: m - window + 1]
    least = np.minimum(behind, ahead)
    # Windows that lie within one text.
    bad = np.zeros(n + 1, np.int64)
    span = window + seed - 1
    inner = starts[(starts > 0) & (starts < n)]
    np.add.at(bad, np.maximum(inner - span + 1, 0), 1)
    np.add.at(bad, inner, -1)
    ok = np.cumsum(bad)[: len(least)] == 0
    chosen = np.unique((mask - (least[ok] & mask)).astype(np.int64))
    return chosen, h[chosen]


def _sample(texts: list[str], seed: int, window: int) -> list[list[tuple[int, int, int]]]:
    """For each text its sampled hashes with the first and last position of each run of equal ones."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    span = window + seed - 1
    slices: list[tuple[int, int, str]] = []

    def flush() -> None:
        points = np.frombuffer("".join(s for _, _, s in slices).encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.array([len(s) for _, _, s in slices])
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        pos, h = _seeds(points, starts, seed, window)
        owner = np.searchsorted(starts, pos, "right") - 1
        if len(pos):
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (pos[1:] - pos[:-1] >= window)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(pos)) - 1
            shift = np.array([a for _, a, _ in slices])[owner[first]] - starts[owner[first]]
            for o, x, a, b in zip(owner[first].tolist(), h[first].view(np.int64).tolist(), (pos[first] + shift).tolist(), (pos[last] + shift).tolist(), strict=True):
                out[slices[o][0]].append((x, a, b))
        slices.clear()

    size = 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - span + 1), BLOCK // 2):
            piece = t[a : a + BLOCK // 2 + span - 1]
            if len(piece) < span:
                continue
            if size + len(piece) > BLOCK:
                flush()
                size = 0
            slices.append((i, a, piece))
            size += len(piece)
    if slices:
        flush()
    return out


def _sampler(seed: int, window: int):
    @F.pandas_udf("array<struct<h:long,a:int,b:int>>")
    def sample(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"h": h, "a": a, "b": b} for h, a, b in x] for x in _sample(texts.tolist(), seed, window)])

    return sample


def _unit_maker(least: int, seed: int):
    @F.pandas_udf("array<struct<a:int,b:int>>")
    def units(spots: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for found, n in zip(spots, sizes, strict=True):
            merged: list[list[int]] = []
            for x in sorted(found, key=lambda x: x["a"]):
                a, b = max(0, x["a"] + seed - least), min(n, x["b"] + least)
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            cut_up = []
            for a, b in merged:
                # Long regions become overlapping units, so that each stretch of `least` is whole in one of them.
                while b - a > UNIT:
                    cut_up.append({"a": a, "b": a + UNIT})
                    a += UNIT - least + 1
                cut_up.append({"a": a, "b": b})
            out.append(cut_up)
        return pd.Series(out)

    return units


def _around(extra: int, halvings: int) -> list[tuple[int, int]]:
    """All (left, right): of ``extra`` characters on two sides, so many are to the left or right at least, as chosen ``halvings`` times."""
    ways, rest = [(0, 0)], extra
    for _ in range(halvings):
        half = -(-rest // 2)
        ways, rest = [w for x, y in ways for w in ((x + half, y), (x, y + half))], rest - half
    return ways


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-32-le", "surrogatepass"), digest_size=16).digest()


def _places(text: str, spots, seed: int) -> Iterator[int]:
    """Where the seeds of the runs are."""
    for x in spots:
        piece, p = text[x["a"] : x["a"] + seed], x["a"]
        while 0 <= p <= x["b"]:
            yield p
            p = text.find(piece, p + 1)


def _lengthener(least: int, seed: int, window: int):
    """For hashes with too many texts: the longer substrings around them, with the first and last place of each run."""
    ways = _around(least - seed, HALVINGS)

    @F.pandas_udf("array<struct<h:long,a:int,b:int>>")
    def lengthen(texts: pd.Series, spots: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, spots, strict=True):
            runs: dict[int, list[list[int]]] = {}
            for p in sorted(set(_places(t, found, seed))):
                for left, right in ways:
                    if left <= p and p + seed + right <= len(t):
                        h = int.from_bytes(_digest(f"{left} {t[p - left : p + seed + right]}")[:8], "little", signed=True)
                        run = runs.setdefault(h, [])
                        if run and p - run[-1][1] < window:
                            run[-1][1] = p
                        else:
                            run.append([p, p])
            out.append([{"h": h, "a": a, "b": b} for h, run in runs.items() for a, b in run])
        return pd.Series(out)

    return lengthen


def _stretcher(least: int, seed: int):
    """The digest of each stretch of ``least`` characters around the seeds, and its first and last place."""

    @F.pandas_udf("array<struct<d:binary,a:array<int>>>")
    def stretches(texts: pd.Series, spots: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, spots, strict=True):
            starts = {s for p in _places(t, found, seed) for s in range(max(0, p + seed - least), min(p, len(t) - least) + 1)}
            at: dict[bytes, list[int]] = {}
            for s in sorted(starts):
                at.setdefault(_digest(t[s : s + least]), []).append(s)
            out.append([{"d": d, "a": a} for d, a in at.items()])
        return pd.Series(out)

    return stretches


def _expanded(index: FMIndex, cls: np.ndarray, *more: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Each row with each owner of its class (first), at most about ROWS at once."""
    width = (index.owner_hi - index.owner_lo)[cls]
    upto = np.cumsum(width)
    a = 0
    while a < len(cls):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + ROWS, "right")))
        w = width[a:b]
        inner = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        yield index.owners[np.repeat(index.owner_lo[cls[a:b]], w) + inner], *[np.repeat(x[a:b], w) for x in more]
        a = b


def _matcher(least: int, want: str):
    """``want``: the "pairs" of texts, the "spans" of each pair, or what is shared with "any"."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        own, streamed = rows[rows["own"]], rows[~rows["own"]]
        index = FMIndex(own["piece"].tolist(), own["id"].to_numpy(), least)
        ids, starts = streamed["id"].to_numpy(), streamed["a"].to_numpy()
        lane, at, cls = index.matches(streamed["piece"].tolist())
        if not len(cls):
            return
        sole = (index.owner_hi - index.owner_lo)[cls] == 1
        other = ~(sole & (index.owners[index.owner_lo[cls]] == ids[lane]))
        lane, at, cls = lane[other], at[other], cls[other]
        _, kind = np.unique(index.signature[cls], return_inverse=True)  # classes with the same documents
        doc, pos = ids[lane], starts[lane] + at
        if want == "pairs":
            key = np.unique(np.stack([doc, kind]), axis=1, return_index=True)[1] if len(cls) else cls
            for right, left in _expanded(index, cls[key], doc[key]):
                keep = left != right
                both = np.unique(np.stack([np.minimum(left, right)[keep], np.maximum(left, right)[keep]]), axis=1)
                yield pd.DataFrame({"x": both[0], "y": both[1], "a": 0, "b": 0})
            return
        order = np.lexsort([kind, pos, doc]) if want == "any" else np.lexsort([pos, kind, doc])
        doc, pos, kind, cls = doc[order], pos[order], kind[order], cls[order]
        if not len(doc):
            return
        same = kind[1:] == kind[:-1] if want == "spans" else np.ones(len(doc) - 1, bool)
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | ~same | (pos[1:] - pos[:-1] > 1)]))
        last = np.append(first[1:], len(doc)) - 1
        if want == "any":
            yield pd.DataFrame({"x": doc[first], "y": doc[first], "a": pos[first], "b": pos[last] + least})
            return
        for y, x, a, b in _expanded(index, cls[first], doc[first], pos[first], pos[last] + least):
            keep = x != y
            yield pd.DataFrame({"x": x[keep], "y": y[keep], "a": a[keep], "b": b[keep]})

    return match


def _of_two(keys: DataFrame, key: str) -> DataFrame:
    """Keys that two different ids have, and whether more than ``HOT`` have them (as rows go, one for an id and run)."""
    found = keys.groupBy(key).agg(F.min("id").alias("p"), F.max("id").alias("q"), F.count("*").alias("n"))
    return found.filter(F.col("p") < F.col("q")).select(key, (F.col("n") > HOT).alias("hot"))


def _search(docs: DataFrame, id_: str, text: str, least: int, want: str) -> tuple[DataFrame, DataFrame]:
    """What the shards found (``x``, ``y``, ``a``, ``b``), and the members of each text (``id``, ``rep``)."""
    if least < 16:
        raise ValueError("least must be 16 or more")
    seed = max(8, least * 64 // 200)
    window = least - seed + 1
    t = F.col("text")
    known = docs.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).filter(F.col("id").isNotNull() & (F.char_length(t) >= least))
    sampled = cut(known.select("id", F.unhex(F.md5(t)).alias("digest"), F.char_length(t).alias("n"), _sampler(seed, window)(t).alias("spots")))
    first = sampled.groupBy("digest").agg(F.min("id").alias("rep"))
    members = sampled.select("id", "digest").join(first, "digest").select("id", "rep").distinct()

    reps = sampled.groupBy("digest").agg(F.min_by(F.struct("id", "n", "spots"), "id").alias("r")).select("r.*")
    spots = reps.select("id", "n", F.explode("spots").alias("s")).select("id", "n", "s.*")
    both = cut(spots.join(_of_two(spots, "h"), "h"))
    hits, stretches = both.filter(~F.col("hot")).drop("hot"), None
    hot = both.filter("hot").groupBy("id", "n").agg(F.collect_list(F.struct("a", "b")).alias("spots"))  # as many as one text has
    if not hot.isEmpty():
        longer = known.join(hot, "id").select("id", "n", F.explode(_lengthener(least, seed, window)("text", "spots")).alias("s")).select("id", "n", "s.*")
        longer = cut(longer)
        longer = cut(longer.join(_of_two(longer, "h"), "h"))
        if want == "any":
            wide = longer.filter("hot").groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("spots"))
            each = cut(known.join(wide, "id").select("id", F.explode(_stretcher(least, seed)("text", "spots")).alias("s")).select("id", "s.*"))
            twice = each.groupBy("d").agg(F.min("id").alias("p"), F.max("id").alias("q")).filter(F.col("p") < F.col("q")).select("d")
            stretches = each.join(twice, "d").select(F.col("id").alias("x"), F.col("id").alias("y"), F.explode("a").alias("a")).withColumn("b", F.col("a") + least)
            longer = longer.filter(~F.col("hot"))
        hits = cut(hits.unionByName(longer.drop("hot")))
    regions = hits.groupBy("id", "n").agg(F.collect_list(F.struct("a", "b")).alias("spots"))  # as many as one text has
    regions = regions.select("id", _unit_maker(least, seed)("spots", "n").alias("units"))
    units = known.join(regions, "id").select("id", F.explode("units").alias("u"), "text").select("id", F.col("u.a").alias("a"), F.substring(t, F.col("u.a") + 1, F.col("u.b") - F.col("u.a")).alias("piece"))
    units = cut(units)
    volume = units.agg(F.sum(F.char_length("piece"))).first()[0] or 0
    shards = -(-volume // SHARD) or 1
    home = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    at = hits.select("h", home.alias("shard")).distinct()
    routes = hits.select("id", "h").join(at, "h").select("id", "shard").distinct() if shards > 1 else hits.select("id", F.lit(0).alias("shard")).distinct()
    streamed = cut(units.join(routes, "id"))
    # A shard whose stream is long is searched by several tasks, each with the same index.
    turns = streamed.groupBy("shard").agg(F.ceil(F.sum(F.char_length("piece")) / STREAM).cast("int").alias("turns"))
    asks = streamed.join(turns, "shard").select("shard", F.pmod(F.xxhash64("id", "a"), F.col("turns")).cast("int").alias("turn"), F.lit(False).alias("own"), "id", "a", "piece")
    owns = units.withColumn("shard", home).join(turns, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(True).alias("own"), "id", "a", "piece")
    tasks = turns.agg(F.sum("turns")).first()[0] or 1
    parts = 4 * tasks if tasks < 2000 else tasks  # they are long for their size, so few of them should meet in a task
    found = asks.unionByName(owns).repartition(parts, "shard", "turn").groupBy("shard", "turn").applyInPandas(_matcher(least, want), "x long, y long, a int, b int")
    return found if stretches is None else found.unionByName(stretches), members


def shared_pairs(docs: DataFrame, id_: str, text: str, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Pairs ``x`` < ``y`` of different texts, by the first id of each, that share ``least`` characters in a
    row, each once; and the members of each text (``id``, ``rep``; texts of at least that length only).

    Nulls and shorter texts share nothing. The same id with several texts shares with itself nothing.
    """
    found, members = _search(docs, id_, text, least, "pairs")
    return found.select("x", "y").distinct(), members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of ids ``doc_a`` < ``doc_b``: those between texts, and those of equal text."""
    a, b = members.select(F.col("id").alias("ia"), F.col("rep").alias("x")), members.select(F.col("id").alias("ib"), F.col("rep").alias("y"))
    between = pairs.join(a, "x").join(b, "y").select(F.least("ia", "ib").alias("doc_a"), F.greatest("ia", "ib").alias("doc_b"))
    same = a.join(b, (F.col("x") == F.col("y")) & (F.col("ia") < F.col("ib"))).select(F.col("ia").alias("doc_a"), F.col("ib").alias("doc_b"))
    return between.unionByName(same).filter(F.col("doc_a") != F.col("doc_b")).distinct()


def _merged(found: DataFrame, by: list[str]) -> DataFrame:
    """Spans that overlap so far that every stretch is within one, as one: ``by``, ``start``, ``stop``."""
    order = Window.partitionBy(*by).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.withColumn("fresh", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0)).withColumn("k", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(*by, "k").agg(F.min("a").alias("start"), F.max("b").alias("stop")).drop("k")


def pair_spans(docs: DataFrame, id_: str, text: str, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """For each pair of different texts that share text, both ways round: ``x``, ``y``, and ``start`` and ``stop``
    (code points) of every span of x of which each stretch of ``least`` characters occurs in y; a span begins anew
    where two such stretches don't overlap in all but one character. And the members of each text, as above."""
    found, members = _search(docs, id_, text, least, "spans")
    # Two spans are one if the second starts no later than one character after the first's last stretch does.
    spans = _merged(found.select("x", "y", "a", (F.col("b") - least + 1).alias("b")).distinct(), ["x", "y"])
    return spans.select("x", "y", "start", (F.col("stop") + least - 1).alias("stop")), members


def shared_spans(docs: DataFrame, id_: str, text: str, least: int = LEAST) -> DataFrame:
    """How much of each document occurs elsewhere, for those that share text: ``id``, ``start``, ``stop`` of every
    covered part (code points, parts that touch being one): each of its characters lies in a stretch of ``least``
    characters that another document has, though not all of them in the same one (:func:`pair_spans` tells these).

    The whole of a text that occurs twice is shared, whatever its parts are.
    """
    found, members = _search(docs, id_, text, least, "any")
    spans = _merged(found, ["x"]).withColumnRenamed("x", "rep")
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    sizes = docs.select(F.col(f"`{id_}`").cast("long").alias("id"), F.char_length(F.col(f"`{text}`")).alias("n"))
    alone = spans.join(copies, "rep").filter(F.col("copies") == 1).select(F.col("rep").alias("id"), "start", "stop")
    whole = members.join(copies.filter(F.col("copies") > 1), "rep").join(sizes, "id").filter(F.col("n") >= least).select("id", F.lit(0).alias("start"), F.col("n").alias("stop"))
    return alone.unionByName(whole)
