"""Scores of generated texts against references. What needs dynamic programming runs in Arrow batches."""

from __future__ import annotations

from collections import Counter
from math import exp, log

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions import text as X


def event_recall(predicted: Column, golds: Column) -> Column:
    """1 if every gold text lies in the prediction, letter case apart, else 0; 1 where there are none."""
    return F.coalesce(F.forall(golds, lambda g: F.lower(predicted).contains(F.lower(g))), F.lit(False)).cast("int")


def fractional_recall(predicted: Column, golds: Column) -> Column:
    """The share of the gold texts that lie in the prediction, letter case apart; 0 where there are none."""
    hits = F.size(F.filter(golds, lambda g: F.coalesce(F.lower(predicted).contains(F.lower(g)), F.lit(False))))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(golds)), F.lit(0.0))


def choice_match(predicted: Column, letter: Column, answer: Column) -> Column:
    """Exact match with the letter of the choice, which the choice's text within the prediction counts as, too; 0 for a null."""
    hit = F.greatest(X.exact_match(predicted, letter), F.coalesce(predicted.contains(answer), F.lit(False)).cast("int"))
    return F.when(predicted.isNotNull(), hit).otherwise(0)


def best_of(metric, raw: Column, parsed: Column, gold: Column) -> Column:
    """The metric of the output as it is or as parsed, whichever is greater; nulls count as 0."""
    of = lambda p: F.when(p.isNotNull() & gold.isNotNull(), metric(p, gold)).otherwise(0)
    return F.greatest(of(raw), of(parsed))


def gated_f1(fluency: Column, precision: Column, recall: Column) -> Column:
    """Fluency times 2PR / (P + R); 0 where both are 0."""
    return F.coalesce(fluency * F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def _grams(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(n)), strict=False))


def _common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one bit vector for each row."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row = 0
    for w in b:
        x = at.get(w, 0) | row
        row = x & ~(x - (row << 1 | 1))
    return row.bit_count()


def _f(common: int, predicted: int, gold: int) -> float:
    return 2 * common / (predicted + gold) if common else 0.0


def rouge(predicted: Column, gold: Column) -> Column:
    """``r1``, ``r2``, ``rl``: F-measures of words, pairs of words and the longest common subsequence, over runs of ASCII
    letters and digits in lower case, unstemmed. A null is an empty text; empty texts score 0."""

    @F.pandas_udf("struct<r1:double,r2:double,rl:double>")
    def score(p: pd.Series, g: pd.Series) -> pd.DataFrame:
        import re

        word, out = re.compile("[a-z0-9]+"), []
        for x, y in zip(p, g, strict=True):
            a, b = word.findall((x or "").lower()), word.findall((y or "").lower())
            one, two = ((_grams(a, n) & _grams(b, n)).total() for n in (1, 2))
            out.append((_f(one, len(a), len(b)), _f(two, max(0, len(a) - 1), max(0, len(b) - 1)), _f(_common_subsequence(a, b), len(a), len(b))))
        return pd.DataFrame(out, columns=["r1", "r2", "rl"])

    return score(predicted, gold)


def bleu(predicted: Column, gold: Column, most: int = 4) -> Column:
    """BLEU over 1 to ``most`` words between white space, in lower case, a precision of 0 being smoothed to 0.1 over its
    count; 0 where no word is shared. With the brevity penalty."""

    @F.pandas_udf("double")
    def score(p: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(p, g, strict=True):
            a, b = (x or "").lower().split(), (y or "").lower().split()
            hits = [(_grams(a, n) & _grams(b, n)).total() for n in range(1, most + 1)]
            if not hits or not hits[0]:
                out.append(0.0)
                continue
            parts = [log((h or 0.1) / max(1, len(a) - n + 1)) for n, h in enumerate(hits, 1)]
            out.append(min(1.0, exp(1 - len(b) / len(a))) * exp(sum(parts) / most))
        return pd.Series(out)

    return score(predicted, gold)
