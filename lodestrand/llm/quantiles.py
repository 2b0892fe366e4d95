"""Percentiles per group from mergeable sketches with a bounded rank error.

A sketch is a hierarchy of randomized compactors (KLL): each level sorts what it holds and passes every
other value, from a random start, to the level above, where a value stands for twice as many. Sketches
are merged level by level, so those of partitions, days or groups combine into that of their union.
Spark's own aggregates build and merge them inside the JVM; a task sends one sketch a group, whatever
the number of its rows, so a group with a third of all rows needs no salting.

With parameter ``k`` the rank of an answer is off by at most ``rank_error(k)`` of the group's size, with
a probability of 0.99 for one answer. Nulls and NaN aren't values; a group without values has no sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.session import cut

K, FEW = 400, 20_000


def rank_error(k: int = K) -> float:
    """Single-sided normalised rank error at 99 % confidence: the empirical fit published for such sketches."""
    return 2.296 / k**0.9723


def value(column: Column | str) -> Column:
    """The column as double, null where it is no value."""
    c = F.col(column) if isinstance(column, str) else column
    d = c.cast("double")
    return F.when(F.isnan(d), None).otherwise(d)


def sketches(df: DataFrame, by: list[str], metrics: list[str], k: int = K) -> DataFrame:
    """A row for each group and metric: ``by``, ``metric``, ``n`` (values) and ``sketch``."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), value(m).alias("value")) for m in metrics])).alias("__m"))
    long = long.select(*by, "__m.metric", "__m.value").filter(F.col("value").isNotNull())
    return long.groupBy(*by, "metric").agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", k).alias("sketch"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups: those of ``parts`` (as made by :func:`sketches`) merged over ``by`` and metric."""
    return parts.groupBy(*by, "metric").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def percentiles(parts: DataFrame, pcts: list[int], k: int = K, widen: float = 1.0, least_width: float = 0.0) -> DataFrame:
    """For each sketch and percentile: the ``estimate``, and ``low`` and ``high`` between which the true
    percentile lies as far as the rank error, times ``widen``, goes. Up to ``k`` values a sketch holds
    all of them; for half as many the three are equal, unless a ``least_width`` (a share of the ranks) is asked."""
    e = max(rank_error(k) * widen, least_width)

    def at(rank: float) -> Column:
        return F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, rank))))

    def one(pct: int) -> Column:
        p, exact = pct / 100, (F.col("n") <= k // 2) & F.lit(least_width == 0)
        return F.struct(
            F.lit(pct).alias("pct"), at(p).alias("estimate"), F.when(exact, at(p)).otherwise(at(p - e)).alias("low"), F.when(exact, at(p)).otherwise(at(p + e)).alias("high")
        )

    rows = parts.withColumn("__q", F.explode(F.array(*map(one, pcts))))
    return rows.select(*[c for c in parts.columns if c != "sketch"], "__q.*")


def above(df: DataFrame, by: list[str], bounds: list[tuple[str, int, float]], least: int = 30, k: int = K) -> DataFrame:
    """Groups of at least ``least`` values whose percentile (the smallest value with at least ``pct`` % of
    the values at or below it) lies above the bound: ``by``, ``metric``, ``pct``.

    The sketches decide all groups whose interval, three rank errors and more than one rank
    wide on either side, doesn't hold the bound.
    The values of the others alone are read again and counted, without a shuffle of the values as long as there are at
    most ``FEW`` such groups.
    """
    limits = df.sparkSession.createDataFrame(bounds, "metric string, pct int, bound double")
    metrics = sorted({m for m, _, _ in bounds})
    asked = percentiles(sketches(df, by, metrics, k).filter(F.col("n") >= least), sorted({p for _, p, _ in bounds}), k, 3.0, 1.2 / max(least, 1))
    asked = cut(asked.join(F.broadcast(limits), ["metric", "pct"]))  # as many rows as the caller gave bounds
    sure = asked.filter(F.col("low") > F.col("bound")).select(*by, "metric", "pct")
    unsure = asked.filter((F.col("low") <= F.col("bound")) & (F.col("high") > F.col("bound"))).select(*by, "metric", "pct", "bound", "n")
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), value(m).alias("value")) for m in metrics])).alias("__m"))
    long = long.select(*by, "__m.metric", "__m.value").filter(F.col("value").isNotNull())
    if unsure.count() <= FEW:
        unsure = F.broadcast(unsure)
    counted = long.join(unsure, [*by, "metric"]).groupBy(*by, "metric", "pct", "n").agg(F.count_if(F.col("value") <= F.col("bound")).alias("under"))
    checked = counted.filter(F.col("under") * 100 < F.col("pct") * F.col("n")).select(*by, "metric", "pct")
    return sure.unionByName(checked)
