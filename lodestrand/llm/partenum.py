"""Near-duplicate texts: set similarity join by signatures over a partitioned domain.

A text is the set of its runs of ``width`` words. Two sets r, s are similar if |r & s| >= g |r | s|.

Partition: the domain of word runs is dealt by hash into parts. As the sums over all parts satisfy the
inequality, at least one part satisfies it by itself, with something in common: |r_i & s_i| >= g |r_i | s_i|.
Enumerate: sets with a and b elements in that part have o >= g / (1 + g) (a + b) of them in common, so in any
fixed order of the domain the t = min(o, 2) first common ones lie among the first a - o + t elements of r_i (and
b - o + t of s_i). All subsets of t of these elements are signatures; a similar pair shares one. The number of
parts goes by size band (of ratio 8, with 4 to 32 elements a part where sets are large); a pair counts in the
band of its smaller set, and a set makes signatures for each band in which a similar set can be the smaller one.
Nothing is lost, and no signature is empty.

The order is by frequency, rare runs first. To that end the hashes of all runs are shuffled once, packed into a
few binary rows, and what occurs in two sets or more is sent back with the order of magnitude of its frequency.
A run that only one set has is first in the order and in no signature; a set most of which is like no other
needs no signature at all.

Pairs with an equal signature are screened by parity sketches (two sketches differ in no more bits than the
sets in elements), and what passes is compared exactly. A signature can't be more frequent than its rarest
element, so most are known to have at most ``HOT`` sets. The others are counted; one that is too frequent is
taken together with each signature of a second, independent partition, of which a similar pair also shares one;
and with a third, if need be. Sets that agree in all of these are nearly alike, so what is still frequent then
makes as many pairs as there are; its sets are dealt to blocks of about ``HOT``, and each two blocks are compared
by themselves.

Runs that a ``COMMON``-th of all sets or more have would make their bucket of the shuffle as large as the table.
They are found in a sample of ``SAMPLE`` texts, at most COMMON times as many as a text has runs, and don't take part
in the shuffle: they are known to be shared, and count as the most frequent. What the sample misses is only slower.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.hashing import powers
from lodestrand.operators import graph
from lodestrand.session import cut

HOT, BUCKET = 512, 1_000_000
LEVELS = 3
BLOCK = 1 << 18
COMMON, SAMPLE, ENTRIES = 500, 20_000, 200_000


def words(text: Column) -> Column:
    """The maximal runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


@lru_cache(maxsize=10_000)
def _salt(field: str) -> int:
    return int.from_bytes(blake2b(field.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _runs_of(texts: list[str], fields: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of each distinct run of words, in that order."""
    points = np.frombuffer("".join(f"{t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    up, down = powers(max(len(points) + 1, BLOCK))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], dtype=np.uint64)])
    stop = np.flatnonzero(points == 32)
    start = np.append(0, stop[:-1] + 1)
    word = _mix((sums[stop] - sums[start]) * down[start])
    text = np.repeat(np.arange(len(texts)), [t.count(" ") + 1 for t in texts])
    n = len(word) - width + 1
    if n <= 0:
        return text[:0], word[:0].view(np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n])
    text, same = text[:n], text[:n] == text[width - 1 :]
    h = h ^ np.array([_salt(f) for f in fields], np.uint64)[text]
    text, h = text[same], h[same].view(np.int64)
    order = np.lexsort([h, text])
    text, h = text[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[first], h[first]


def _sets(texts: list[str], fields: list[str], width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of the texts with their runs: from, to, number of the text in the slice, hash."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > BLOCK:
            yield a, i, *_runs_of(texts[a:i], fields[a:i], width)
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts), *_runs_of(texts[a:], fields[a:], width)


def _element(h: np.ndarray, buckets: int) -> np.ndarray:
    """A run's id: its bucket in the first shuffle, and 32 bits of its hash."""
    u = h.view(np.uint64)
    return ((u & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) << np.uint64(32) | u >> np.uint64(32)).view(np.int64)


def _edges(x: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one positions of the runs of equal values (in all arrays)."""
    if not len(x):
        none = np.zeros(0, np.int64)
        return none, none
    new = x[1:] != x[:-1]
    for y in more:
        new = new | (y[1:] != y[:-1])
    cuts = np.flatnonzero(new) + 1
    return np.append(0, cuts), np.append(cuts, len(x))


def _common(texts: DataFrame, n: int, buckets: int, width: int) -> np.ndarray:
    """Runs that so many sets have that they would fill a bucket with ``ENTRIES`` or more."""
    if n < ENTRIES:
        return np.zeros(0, np.int64)
    share = int(min(1.0, 1.05 * SAMPLE / n) * (1 << 20)) + 1

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_, fields = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for _, _, _, h in _sets(texts_, fields, width):
                yield pa.RecordBatch.from_arrays([pa.array(_element(h, buckets))], names=["e"])

    sample = cut(texts.filter(F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) < share).limit(SAMPLE).select("norm", "field"))
    least = max(2, sample.count() // COMMON)
    often = sample.mapInArrow(runs, "e long").groupBy("e").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("e")
    return np.sort(np.array(often.toArrow()["e"].to_pylist(), np.int64))


def _packer(buckets: int, width: int, common: np.ndarray):
    """Deals the runs of each block of 1,024 texts to the buckets, a row of bytes for each; common ones to places of their own, by block."""
    schema = pa.schema([("place", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("hash", pa.binary()), ("delta", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, texts, fields = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b, text, h in _sets(texts, fields, width):
                e, r = _element(h, buckets), rid[a:b][text]
                bucket, block = e >> 32, r >> 10
                known = np.isin(e, common) if len(common) else np.zeros(len(e), bool)
                place = np.where(known, buckets + block % buckets, bucket)
                order = np.lexsort([block, bucket, place])
                place, bucket, block, e, r = place[order], bucket[order], block[order], e[order].astype(np.uint32), (r[order] & 1023).astype(np.uint16)
                lo, hi = _edges(place, bucket, block)
                cols = [pa.array([x[i:j].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary()) for x in (e, r)]
                yield pa.RecordBatch.from_arrays([pa.array(place[lo].astype(np.int32)), pa.array(bucket[lo].astype(np.int32)), pa.array(block[lo]), *cols], schema=schema)

    return pack


def _sharer(buckets: int):
    """Of a bucket, the runs that two sets or more have, dealt back by block, with the bit length of their number; common ones as they come."""

    def share(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= buckets:
            return rows[["block", "bucket", "hash", "delta"]].assign(grade=[b"\x3f" * (len(d) // 2) for d in rows["delta"]])
        h = np.frombuffer(b"".join(rows["hash"]), np.uint32)
        delta = np.frombuffer(b"".join(rows["delta"]), np.uint16)
        block = np.repeat(rows["block"].to_numpy(), [len(d) // 2 for d in rows["delta"]])
        order = np.argsort(h, kind="stable")
        lo, hi = _edges(h[order])
        count = np.repeat(hi - lo, hi - lo)
        keep, count = order[count > 1], count[count > 1]
        grade = np.ceil(np.log2(count + 1)).astype(np.uint8)
        by = np.argsort(block[keep], kind="stable")
        keep, grade = keep[by], grade[by]
        h, delta, block = h[keep], delta[keep], block[keep]
        lo, hi = _edges(block)
        cols = {c: [x[i:j].tobytes() for i, j in zip(lo, hi, strict=True)] for c, x in (("hash", h), ("delta", delta), ("grade", grade))}
        return pd.DataFrame({"block": block[lo], "bucket": np.full(len(lo), key[0], np.int32), **cols})

    return share


def _band(n: int) -> int:
    return max(0, (n.bit_length() - 5) // 3)


def bands(n: int, g: Fraction) -> range:
    """Size bands of the smaller set of any similar pair with a set of n elements."""
    return range(_band(max(1, ceil(g * n))), _band(n) + 1)


def _part(e: np.ndarray, band: int, seed: int) -> np.ndarray:
    return (_mix(e.view(np.uint64) + np.uint64((seed + 1) * 0xD1B54A32D192ED03 % (1 << 64))) % np.uint64(4 << 3 * band)).astype(np.int64)


@lru_cache(maxsize=100_000)
def plan(m: int, g: Fraction) -> tuple[tuple[int, int], ...]:
    """For a part with m elements: sizes t of subsets, and from how many of the first elements they are taken."""
    best: dict[int, int] = {}
    for other in range(ceil(g * m), floor(m / g) + 1):
        o = ceil(g / (1 + g) * (m + other))
        if 0 < o <= min(m, other):
            t = min(o, 2)
            best[t] = max(best.get(t, 0), m - o + t)
    return tuple(best.items())


def _profiler(buckets: int, width: int, g: Fraction):
    """Of each text: how many runs it has, in all and by part, and their parity sketch."""
    schema = pa.schema([("rid", pa.int64()), ("n", pa.int32()), ("s0", pa.int64()), ("s1", pa.int64()), ("counts", pa.binary())])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, texts, fields = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b, text, h in _sets(texts, fields, width):
                e = _element(h, buckets)
                mixed = _mix(e.view(np.uint64))
                bit = np.uint64(1) << (mixed & np.uint64(63))
                high = (mixed >> np.uint64(6) & np.uint64(1)).astype(bool)
                lo, hi = _edges(text)
                sketch = [np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), lo).view(np.int64) if len(lo) else lo for side in (high, ~high)]
                counts = []
                for i, j in zip(lo.tolist(), hi.tolist(), strict=True):
                    each = [np.bincount(_part(e[i:j], band, 0), minlength=4 << 3 * band) for band in bands(j - i, g)]
                    counts.append(np.concatenate(each).astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[a:b][text[lo]]), pa.array((hi - lo).astype(np.int32)), pa.array(sketch[0]), pa.array(sketch[1]), pa.array(counts, pa.binary())], schema=schema
                )

    return profile


def _subsets(e: list[int], grade: list[int], m: int, g: Fraction, key: tuple, cool: list[int], warm: list[int]) -> None:
    """Adds the signatures of a part with m elements, of which ``e``, rare ones first, are in other sets too."""
    alone = m - len(e)
    for t, first in plan(m, g):
        for c in combinations(range(min(len(e), first - alone)), t) if first > alone else ():
            (cool if (1 << int(grade[c[0]])) - 1 <= HOT else warm).append(hash((*key, *[e[i] for i in c])))


def _signer(g: Fraction):
    """Signatures of the sets of a block: ``cool`` ones have at most HOT sets each, of ``warm`` ones it isn't known."""

    def sign(profiles: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(shared) and len(profiles):
            h = [np.frombuffer(x, np.uint32).astype(np.int64) | int(b) << 32 for x, b in zip(shared["hash"], shared["bucket"], strict=True)]
            e, delta = np.concatenate(h), np.frombuffer(b"".join(shared["delta"]), np.uint16)
            grade = np.frombuffer(b"".join(shared["grade"]), np.uint8)
            order = np.lexsort([e, grade, delta])
            e, delta, grade = e[order], delta[order], grade[order]
            lo = np.searchsorted(delta, np.arange(1025))
            for rid, n, s0, s1, raw in profiles[["rid", "n", "s0", "s1", "counts"]].itertuples(index=False):
                i, j = lo[rid & 1023], lo[(rid & 1023) + 1]
                if (j - i) < ceil(g * n):
                    continue
                counts, cool, warm, at = np.frombuffer(raw, np.uint32), [], [], 0
                for band in bands(n, g):
                    part = _part(e[i:j], band, 0)
                    by = np.argsort(part, kind="stable")
                    el, gr, p = e[i:j][by].tolist(), grade[i:j][by].tolist(), part[by]
                    for x, y in zip(*map(np.ndarray.tolist, _edges(p)), strict=True):
                        k = int(p[x])
                        _subsets(el[x:y], gr[x:y], int(counts[at + k]), g, (band, k), cool, warm)
                    at += 4 << 3 * band
                out.append((rid, n, s0, s1, cool, warm))
        return pd.DataFrame(out, columns=["rid", "n", "s0", "s1", "cool", "warm"])

    return sign


def _resigner(g: Fraction, width: int, buckets: int, seed: int):
    """Signatures by another partition, from the whole text and in the order of the hashes."""

    @F.pandas_udf("array<long>")
    def sign(texts: pd.Series, fields: pd.Series) -> pd.Series:
        out = []
        for t, f in zip(texts, fields, strict=True):
            e = np.sort(_element(_runs_of([t], [f], width)[1], buckets))
            sigs: list[int] = []
            for band in bands(len(e), g):
                part = _part(e, band, seed)
                by = np.argsort(part, kind="stable")
                el, p = e[by].tolist(), part[by]
                for x, y in zip(*map(np.ndarray.tolist, _edges(p)), strict=True):
                    _subsets(el[x:y], [0] * (y - x), y - x, g, (seed, band, int(p[x])), sigs, sigs)
            out.append(sigs)
        return pd.Series(out)

    return sign


def _pairer(g: float):
    """Pairs with an equal signature that the sketches and sizes don't rule out."""

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sig", kind="stable")
        sig, rid, n = rows["sig"].to_numpy(), rows["rid"].to_numpy(), rows["n"].to_numpy().astype(np.int64)
        s0, s1 = rows["s0"].to_numpy().view(np.uint64), rows["s1"].to_numpy().view(np.uint64)
        lo = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        size = np.append(lo[1:], len(sig)) - lo if len(sig) else lo
        found = [np.zeros((2, 0), np.int64)]
        for w in np.unique(size[size > 1]).tolist():
            i, j = np.triu_indices(w, 1)
            starts = lo[size == w]
            step = max(1, 2_000_000 // len(i))
            for a in range(0, len(starts), step):
                x, y = (starts[a : a + step, None] + i).ravel(), (starts[a : a + step, None] + j).ravel()
                d = np.bitwise_count(s0[x] ^ s0[y]).astype(np.int64) + np.bitwise_count(s1[x] ^ s1[y])
                good = (d * (1 + g) <= (1 - g) * (n[x] + n[y]) + 1e-9) & (np.minimum(n[x], n[y]) >= g * np.maximum(n[x], n[y]) - 1e-9) & (rid[x] != rid[y])
                x, y = rid[x[good]], rid[y[good]]
                found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return pd.DataFrame({"x": both[0], "y": both[1]})

    return pairs


def _candidates(sets: DataFrame, texts: DataFrame, buckets: int, g: Fraction, width: int) -> DataFrame:
    """Pairs ``x`` < ``y`` of ``sets`` that share a signature and that the sketches allow."""
    kept = ["rid", "n", "s0", "s1"]

    def pairs_of(rows: DataFrame, buckets: int = buckets) -> DataFrame:
        bucket = F.pmod(F.col("sig"), F.lit(buckets)).cast("int")
        return rows.select(bucket.alias("bucket"), "sig", *kept).groupBy("bucket").applyInPandas(_pairer(float(g)), "x long, y long")

    out = pairs_of(sets.select(F.explode("cool").alias("sig"), *kept))
    rows = sets.filter(F.size("warm") > 0).select(F.explode("warm").alias("sig"), *kept)
    for level in range(1, LEVELS + 1):
        sizes = rows.groupBy("sig").agg(F.count("*").alias("c")).filter(F.col("c") > 1)
        alike = cut(rows.join(sizes, "sig"))
        out = out.unionByName(pairs_of(alike.filter(F.col("c") <= HOT)))
        hot = alike.filter(F.col("c") > HOT)
        if hot.isEmpty():
            break
        if level == LEVELS:
            blocks = F.ceil(F.col("c") / HOT).cast("int")
            mine = F.pmod(F.xxhash64("rid"), blocks).cast("int")
            two = hot.select("sig", *kept, mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
            two = cut(two.select(F.xxhash64("sig", F.least("mine", "other"), F.greatest("mine", "other")).alias("sig"), *kept))
            out = out.unionByName(pairs_of(two, max(buckets, -(-two.count() // ENTRIES))))
            break
        hot = hot.drop("c")
        again = hot.select("rid").distinct().join(texts.select("rid", "norm", "field"), "rid").select("rid", _resigner(g, width, buckets, level)("norm", "field").alias("more"))
        rows = hot.join(again, "rid").withColumn("sig", F.explode(F.transform("more", lambda x: F.xxhash64("sig", x)))).drop("more")
    return out.distinct()


def near_duplicates(df: DataFrame, field: str, id_: str, text: str, threshold: Fraction = Fraction(4, 5), width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of different texts, ``field``, ``x`` < ``y`` (numbers), ``similarity``; and the members of
    each text, ``field``, ``id``, ``rid``. Records of one ``field`` are compared with each other only.

    Texts with the same words in the same order are one text. Nulls, and texts of fewer than ``width``
    words, take no part, nor do rows without an id or field. Rows that repeat an id are one record; if
    their texts differ, any one of these. An empty table gives no rows.
    """
    g = Fraction(threshold)
    if not Fraction(1, 2) <= g <= 1:
        raise ValueError("the threshold must be from 0.5 to 1")
    w = words(F.col("text"))
    rows = df.select(F.col(f"`{field}`").cast("string").alias("field"), F.col(f"`{id_}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = rows.filter(F.col("field").isNotNull() & F.col("id").isNotNull()).withColumn("w", w).filter(F.size("w") >= width)
    rows = rows.select("field", "id", F.concat_ws(" ", "w").alias("norm")).withColumn("digest", F.unhex(F.md5("norm")))
    ids = rows.groupBy("field", "id").agg(F.min("digest").alias("digest"))
    texts = rows.groupBy("field", "digest").agg(F.first("norm").alias("norm")).join(ids.select("field", "digest").distinct(), ["field", "digest"], "left_semi")
    texts = cut(texts.withColumn("rid", F.monotonically_increasing_id()))
    members = ids.join(texts.select("field", "digest", "rid"), ["field", "digest"]).select("field", "id", "rid")

    n, volume = texts.agg(F.count("*"), F.coalesce(F.sum(F.char_length("norm")), F.lit(0))).first()
    buckets = max(12, -(-volume // (6 * BUCKET)))  # about one run for each 6 characters
    full, block = texts.select("rid", "norm", "field"), F.shiftright("rid", 10)
    common = _common(texts, n, buckets, width)
    packed = full.mapInArrow(_packer(buckets, width, common), "place int, bucket int, block long, hash binary, delta binary")
    parts = 4 * buckets if buckets < 2000 else buckets  # a bucket is about 14 MB, so few of them should meet in a task
    shared = packed.repartition(parts, "place").groupBy("place").applyInPandas(_sharer(buckets), "block long, bucket int, hash binary, delta binary, grade binary")
    profiles = full.mapInArrow(_profiler(buckets, width, g), "rid long, n int, s0 long, s1 long, counts binary").withColumn("block", block)
    signed = profiles.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(_signer(g), "rid long, n int, s0 long, s1 long, cool array<long>, warm array<long>")
    pairs = cut(_candidates(cut(signed), texts, buckets, g, width))
    ends = pairs.select(F.explode(F.array("x", "y")).alias("rid")).distinct()
    compared = cut(full.join(ends, "rid").select("rid", _hasher(width)("norm", "field").alias("sh")))
    a, b = compared.select(F.col("rid").alias("x"), F.col("sh").alias("xs")), compared.select(F.col("rid").alias("y"), F.col("sh").alias("ys"))
    both = pairs.join(a, "x").join(b, "y").withColumn("o", F.size(F.array_intersect("xs", "ys"))).withColumn("u", F.size("xs") + F.size("ys") - F.col("o"))
    good = both.filter(F.col("o") * g.denominator >= F.col("u") * g.numerator).select("x", "y", (F.col("o") / F.col("u")).alias("similarity"))
    return good, members


def _hasher(width: int):
    """The whole set of runs of each text."""

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series, fields: pd.Series) -> pd.Series:
        return pd.Series([_runs_of([t], [f], width)[1] for t, f in zip(texts, fields, strict=True)])

    return hashes


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of records ``field``, ``id_a`` < ``id_b``: between similar texts, and within a text."""
    a = members.select("field", F.col("id").alias("ia"), F.col("rid").alias("x"))
    b = members.select(F.col("id").alias("ib"), F.col("rid").alias("y"))
    ends = [F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")]
    between = pairs.join(a, "x").join(b, "y").select("field", *ends)
    same = a.join(b, (F.col("x") == F.col("y")) & (F.col("ia") < F.col("ib"))).select("field", *ends)
    return between.unionByName(same)


def classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each record: ``field``, ``id``, its text's number ``class``, how many records ``copies`` have
    that text, how many other texts ``links`` are similar to it, and its ``group``: all records that a chain of
    similar texts links have the least of their ids there. A record like no other is a group by itself."""
    pairs, members = cut(pairs.select("x", "y")), cut(members)
    ends = pairs.select(F.explode(F.array("x", "y")).alias("rid")).groupBy("rid").agg(F.count("*").alias("links"))
    copies = members.groupBy("rid").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    texts = copies.join(ends, "rid", "left").join(graph.components(pairs).withColumnRenamed("id", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    groups = texts.groupBy("root").agg(F.min("least").alias("group"))
    rows = members.join(texts.join(groups, "root"), "rid")
    return rows.select("field", "id", F.col("rid").alias("class"), "copies", F.coalesce("links", F.lit(0)).alias("links"), "group")
