"""Run analytics: joins of a baseline with a memory run, rates, percentiles, tiers, roll-ups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.session import cut


def last_by(df: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """One row a key, the last in the order: as a later line of a result file replaces an earlier one."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o.desc() for o in order])
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def score(c: Column) -> Column:
    """A score that may be text or null, as 0 or more: what is no integer counts as 0."""
    return F.coalesce(F.expr("try_cast(`{}` as int)".format(c)) if isinstance(c, str) else c.try_cast("int"), F.lit(0))


def rate(hit: Column) -> Column:
    """Share of rows for which ``hit`` holds; 0 for no rows."""
    return F.coalesce(F.try_divide(F.count_if(hit).cast("double"), F.count("*")), F.lit(0.0))


def compared(base: DataFrame, memory: DataFrame, key: str = "task_id") -> DataFrame:
    """The tasks that both runs have, with all columns of both (``b_`` and ``m_``)."""
    b = base.select(key, *[F.col(c).alias(f"b_{c}") for c in base.columns if c != key])
    m = memory.select(key, *[F.col(c).alias(f"m_{c}") for c in memory.columns if c != key])
    return b.join(m, key)


def ranked(df: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Values at ranks (from 0) of the sorted values of each group: ``by``, ``n``, and a column for each of ``ranks``, which gives the rank for the group's size.

    Equal values are counted first, so a group's rows meet as counts. The counts' prefix sums then come from ranges of
    values: the group's values are dealt to ranges by approximate percentiles, the ranges summed, and only the
    ranges that hold an asked rank are ordered. So no task sorts a whole group, however large it is. Null and NaN are no values.
    """
    if not by:
        return ranked(df.withColumn("__all", F.lit(0)), ["__all"], value, ranks).drop("__all")
    v = F.col(value).cast("double")
    counts = cut(df.filter(F.col(value).isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("v")).agg(F.count("*").alias("c")))
    edges = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000).alias("edges"))
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    ranged = counts.alias("r").join(edges.alias("e"), same)
    ranged = cut(ranged.select(*[F.col(f"r.{k}") for k in by], "v", "c", "n", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("range")))
    sums = ranged.groupBy(*by, "n", "range").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*by).orderBy("range")  # over at most 64 rows
    sums = sums.withColumn("through", F.sum("c").over(w)).withColumn("under", F.col("through") - F.col("c"))
    at = F.array(*[F.struct(F.lit(k).alias("p"), of(F.col("n")).cast("long").alias("at")) for k, of in ranks.items()])
    held = F.filter(at, lambda x: (x["at"] >= F.col("under")) & (x["at"] < F.col("through")))
    sums = sums.withColumn("asked", held).filter(F.size("asked") > 0).select(*by, "range", "under", "asked")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*by, "range"]]
    inside = ranged.alias("r").join(sums.alias("s"), same).select("r.*", "s.under", "s.asked")
    run = Window.partitionBy(*by, "range").orderBy("v")
    inside = inside.withColumn("to", F.col("under") + F.sum("c").over(run))
    hit = inside.select(*by, "n", "v", F.explode(F.filter("asked", lambda x: (x["at"] < F.col("to")) & (x["at"] >= F.col("to") - F.col("c")))).alias("a"))
    return hit.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("a.p") == k, F.col("v"))).alias(k) for k in ranks])


def nearest_rank(df: DataFrame, by: list[str], value: str, pcts: list[int]) -> DataFrame:
    """Percentiles ``p<pct>`` as s[min(floor(n p / 100), n - 1)] of the sorted values, with ``n``, see :func:`ranked`."""
    return ranked(df, by, value, {f"p{p}": lambda n, p=p: F.least(F.floor(n * p / 100), n - 1) for p in pcts})


def linear_percentiles(df: DataFrame, by: list[str], value: str, pcts: list[int]) -> DataFrame:
    """Percentiles ``p<pct>`` between the values around the place (n - 1) p / 100, with ``n``, see :func:`ranked`."""
    place = lambda n, p: (n - 1) * p / 100
    ends = {f"{side}{p}": lambda n, p=p, round_=round_: round_(place(n, p)) for p in pcts for side, round_ in (("lo", F.floor), ("hi", F.ceil))}
    part = lambda p: place(F.col("n"), p) - F.floor(place(F.col("n"), p))
    return ranked(df, by, value, ends).select(*by, "n", *[(F.col(f"lo{p}") + part(p) * (F.col(f"hi{p}") - F.col(f"lo{p}"))).alias(f"p{p}") for p in pcts])


def min_max(c: str, constant: float = 1.0) -> Column:
    """The column between its least (0) and greatest value (1) over all rows, which are few; ``constant`` if all are equal."""
    w = Window.partitionBy(F.lit(0))
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(lo == hi, F.lit(constant)).otherwise((F.col(c) - lo) / (hi - lo))


def mean_of_means(df: DataFrame, value: str, levels: list[list[str]]) -> DataFrame:
    """Mean by the first level's keys, then the mean of these means by the next level's, and so on."""
    for keys in levels:
        df = df.groupBy(*keys).agg(F.avg(value).alias(value))
    return df


def _fronts(x: np.ndarray, most: int | None = None) -> np.ndarray:
    """Number of the front (from 1) of each row of ``x``, where less is better; 0 beyond the front ``most``."""
    front, left, k = np.zeros(len(x), np.int32), np.arange(len(x)), 0
    while len(left) and (most is None or k < most):
        k += 1
        order = np.lexsort(x[left].T[::-1])
        kept = np.zeros((0, x.shape[1]))
        best = []
        for i in order:
            row = x[left[i]]
            if not len(kept) or not ((kept <= row).all(1) & (kept < row).any(1)).any():
                best.append(i)
                kept = np.vstack([kept, row])
        front[left[best]] = k
        left = np.delete(left, best)
    return front


SORTED = 20_000


def pareto_ranks(df: DataFrame, key: str, up: list[str], down: list[str]) -> DataFrame:
    """``key``, the measures and ``front``: 1 for the rows that no other dominates (as good in all measures and better
    in one), 2 for those that only rows of the first front dominate, and so on. Rows with a null measure take no part.

    Up to ``SORTED`` rows are ranked in one task. Of more, each front is peeled off by itself: the front of every
    partition first, as no row that is dominated there is in it, then the front of these.
    """
    cols = [key, *up, *down]
    left, out = cut(df.select(*cols).na.drop()), None
    schema = T.StructType([*left.schema.fields, T.StructField("front", T.IntegerType())])

    def measures(rows: pd.DataFrame) -> np.ndarray:
        return np.column_stack([-rows[c].to_numpy(float) for c in up] + [rows[c].to_numpy(float) for c in down])

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[_fronts(measures(b), 1) == 1]

    def first_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if batches := list(batches):
            rows = pd.concat(batches, ignore_index=True)
            yield rows[_fronts(measures(rows), 1) == 1]

    def all_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if batches := list(batches):
            rows = pd.concat(batches, ignore_index=True)
            yield rows.assign(front=_fronts(measures(rows)))

    k = 0
    while left.count() > SORTED:
        k += 1
        first = left.mapInPandas(local, left.schema).repartition(1).mapInPandas(first_of, left.schema)  # fronts only
        first = cut(first.withColumn("front", F.lit(k)))
        out = first if out is None else out.unionByName(first)
        left = cut(left.join(first.select(key), key, "left_anti"))
    rest = left.repartition(1).mapInPandas(all_, schema).withColumn("front", F.col("front") + k)
    return rest if out is None else out.unionByName(rest)
