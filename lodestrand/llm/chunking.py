"""Cutting oversized texts into pieces at natural boundaries.

A cut between two characters has a strength: 4 after a paragraph, 3 after a line, 2 after a sentence,
1 after a word, 0 elsewhere. For each piece the strongest cut in the permissible window of lengths is
asked of a sparse table of range maxima over the boundaries; among equals the rightmost wins, so pieces
come out as long as they can. The next piece starts ``overlap`` characters before that cut, or at the
first boundary within the ``slack`` characters after that point, so that it starts with a whole word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, SLACK = 3000, 150, 30

#: White space of Unicode, sentence marks that white space must follow, marks that end a sentence alone, closing marks.
_SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_STOPS, _CJK_STOPS, _CLOSERS = ".!?…؟", "。！？；", "\"')]}”’»」』"


def _table(chars) -> np.ndarray:
    t = np.zeros(0x10000, bool)
    t[[c if isinstance(c, int) else ord(c) for c in chars]] = True
    return t


_SPACE, _STOP, _CJK, _CLOSE = _table(_SPACES), _table(_STOPS), _table(_CJK_STOPS), _table(_CLOSERS)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the cuts with a strength above 0 (a cut at i parts text[:i] from text[i:]), and the strengths."""
    cp = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    space, newline = _SPACE[cp], cp == 10
    before = np.empty(len(cp), bool)  # the character before the white space ends a sentence
    ends = _STOP[cp].copy()
    ends[1:] |= _CLOSE[cp[1:]] & _STOP[cp[:-1]]
    before[0], before[1:] = False, ends[:-1]
    strength = space.astype(np.int8)
    strength[space & before] = 2
    strength[_CJK[cp]] = 2
    strength[newline] = 3
    if newline.any():
        # A newline closes a paragraph if only white space lies between it and the newline before it.
        at = np.flatnonzero(newline)
        inked = np.concatenate([[0], np.cumsum(~space)])
        blank = np.flatnonzero(inked[at[1:]] == inked[at[:-1]]) + 1
        strength[at[blank]] = 4
    # Inside a run of white space only its end is a cut, with the greatest strength of the run.
    pos = np.flatnonzero(strength)
    if not len(pos):
        return pos, strength[:0]
    inner = np.zeros(len(pos), bool)
    inner[:-1] = (pos[1:] == pos[:-1] + 1) & space[pos[1:]]
    run = np.concatenate([[0], np.cumsum(~inner)[:-1]])
    best = np.zeros(run[-1] + 1, np.int8)
    np.maximum.at(best, run, strength[pos])
    return pos[~inner] + 1, best


class RangeMax:
    """Sparse table: the position of the rightmost maximum of any range, in constant time."""

    def __init__(self, values: np.ndarray, widest: int):
        keys = values.astype(np.int64) << 40 | np.arange(len(values), dtype=np.int64)
        self.levels = [keys]
        while (w := 1 << len(self.levels)) <= min(widest, len(keys)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[: len(keys) - w + 1], last[w // 2 : w // 2 + len(keys) - w + 1]))

    def argmax(self, a: int, b: int) -> int:
        """Index of the rightmost maximum of [a, b); b > a."""
        k = (b - a).bit_length() - 1
        row = self.levels[k]
        return int(max(row[a], row[b - (1 << k)])) & ((1 << 40) - 1)


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> list[tuple[int, int]]:
    """Start and end of each piece of ``text``, in code points."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    pos, strength = boundaries(text)
    index = RangeMax(strength, limit) if len(pos) else None
    out, start = [], 0
    while n - start > limit:
        end = start + limit
        if index is not None:
            b = int(np.searchsorted(pos, start + limit, "right"))
            for least in (start + limit // 2, start + max(overlap, 0) + 1):
                a = int(np.searchsorted(pos, least))
                if a < b:
                    end = int(pos[index.argmax(a, b)])
                    break
        out.append((start, end))
        start = end - overlap
        if index is not None and overlap:
            a = int(np.searchsorted(pos, start))
            if a < len(pos) and pos[a] <= min(start + slack, end - 1):
                start = int(pos[a])
    out.append((start, n))
    return out


def _cutter(limit: int, overlap: int, slack: int):
    if not 0 <= overlap < limit // 2 or slack < 0:
        raise ValueError("overlap must be at least 0 and less than half the limit")

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def cuts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else [{"a": a, "b": b} for a, b in cut_points(x, limit, overlap, slack)])

    return cuts.asNondeterministic()  # else the filter that an explode implies would cut every text a second time


def split_oversized(df: DataFrame, text: str, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> DataFrame:
    """``df`` with a row for each piece of ``text``: ``piece_no``, ``n_pieces``, ``piece_start``, ``piece_end``
    (code points) and ``piece``. Where a column of such a name exists, that column stays and the new one
    is called ``<name>_new``.

    A text within the limit is its own only piece, and only a null goes to Python for it; an empty text gives
    one empty piece, a null gives no row. There is no shuffle.
    """
    new = {c: f"{c}_new" if c in df.columns else c for c in ("piece_no", "n_pieces", "piece_start", "piece_end", "piece")}
    size, t = F.char_length(F.col(f"`{text}`")), F.col(f"`{text}`")
    long = _cutter(limit, overlap, slack)(F.when(size > limit, t))
    whole = F.array(F.struct(F.lit(0).alias("a"), size.cast("int").alias("b")))
    cut = df.withColumn("__cuts", F.when(t.isNull(), None).otherwise(F.coalesce(long, whole)))
    rows = cut.select(*[F.col(f"`{c}`") for c in df.columns], F.size("__cuts").alias("__n"), F.posexplode("__cuts").alias("__k", "__c"))
    return rows.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col("__k").alias(new["piece_no"]),
        F.col("__n").alias(new["n_pieces"]),
        F.col("__c.a").alias(new["piece_start"]),
        F.col("__c.b").alias(new["piece_end"]),
        F.substring(t, F.col("__c.a") + 1, F.col("__c.b") - F.col("__c.a")).alias(new["piece"]),
    )
