"""Mixing sources to target weights by weighted sampling without replacement.

Every record draws an exponential key, its rate being the record's quality weight; taking the smallest
keys first is sampling without replacement with those weights (Efraimidis and Spirakis). A source whose
budget is larger than its size is used in complete epochs first; the rest of the budget is filled in the
order of the keys, by prefix sums of the sizes.

The order is never made in one task. It is a number of several digits of ``DIGIT`` bits: the logarithm of the
key, then the hash that the key was drawn from, then the record's own number. The sums of each source by the
first digit tell in which range the budget ends; only that range is summed by the next digit, and so on until
``SORTED`` records or fewer are left, which are sorted. So any distribution of the weights, and any number of
records with one id, is parted finely enough.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import cut

SORTED, DIGIT = 50_000, 12
LEAST_WEIGHT = 1e-6
ORDER = ["rank", "draw", "no"]


@dataclass
class Mix:
    """``chosen``: ``id``, ``source``, ``size``, ``copies`` (at least 1) of every record used.
    ``report``: a row for each target with what was available, wanted and reached."""

    chosen: DataFrame
    report: DataFrame


def normal_source(c: Column | str) -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def _drawn(id_: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), id_)


def exponential_key(id_: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1] from the record's id: the same on every run."""
    u = (F.shiftrightunsigned(_drawn(id_, seed), 11) + 1).cast("double") / float(1 << 53)
    return -F.log(u) / weight


def _digits() -> list[Column]:
    """The digits of the order, first ones first; all of the first number, then of the second, then of the third."""
    out = []
    for c, bits in zip(ORDER, (48, 64, 64), strict=True):
        for low in range(bits - DIGIT, -DIGIT, -DIGIT):
            out.append(F.shiftrightunsigned(F.col(c), max(low, 0)).bitwiseAND((1 << DIGIT + min(low, 0)) - 1).cast("int"))
    return out


def _cutoffs(records: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Of each source of ``plan`` whose ``rest`` doesn't reach for all of its records: the place ``cutoff`` in the
    order of the first record that doesn't fit any more."""
    hint = F.broadcast if few else (lambda x: x)
    state = plan.filter(F.col("rest") < F.col("available")).select("source", "rest", F.lit(0).cast("long").alias("under"), F.array().cast("array<int>").alias("edge"))
    state, digits = cut(state), _digits()
    for i, digit in enumerate(digits):
        held = F.lit(True)
        for k, d in enumerate(digits[:i]):
            held &= d == F.element_at("edge", k + 1)
        inside = records.join(hint(state), "source").filter(held)
        sums = inside.groupBy("source", "rest", "under", "edge", digit.alias("digit")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        run = Window.partitionBy("source").orderBy("digit")  # over at most 2^DIGIT rows
        over = sums.withColumn("through", F.sum("size").over(run) + F.col("under")).filter(F.col("through") > F.col("rest"))
        first = over.groupBy("source").agg(F.min_by(F.struct("rest", (F.col("through") - F.col("size")).alias("under"), F.concat("edge", F.array("digit")).alias("edge"), "n"), "digit").alias("s"))
        found = cut(first.select("source", "s.*"))
        state, most = found.drop("n"), found.agg(F.max("n")).first()[0] or 0
        if most <= SORTED or i == len(digits) - 1:
            break
    held = F.lit(True)
    for k, d in enumerate(digits[: i + 1]):
        held &= d == F.element_at("edge", k + 1)
    inside = records.join(hint(state), "source").filter(held)
    run = Window.partitionBy("source").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)  # over at most SORTED rows
    over = inside.withColumn("through", F.sum("size").over(run) + F.col("under")).filter(F.col("through") > F.col("rest"))
    return over.groupBy("source").agg(F.min(F.struct(*ORDER)).alias("cutoff"))


def mix(sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> Mix:
    """``sized`` has ``id``, ``source``, ``size`` and ``weight``; ``targets`` has ``source``, ``target_weight`` and ``max_repeat``.

    ``total`` is the size of the mix that is asked for; without it, the size of all records, those
    without a source included. Sources compare trimmed and lower-cased; equal targets after that are one
    (weights added, the larger ``max_repeat``). A record without a source, or of a source without a
    target, is never chosen; a null or negative size counts as 0; a null, NaN or non-positive weight
    counts as the least, 1e-6. A source without records reaches 0. Rows that repeat an id, or have none,
    are records of their own; where their keys are equal, their order is that of the rows as read.
    """
    w = F.col("weight").cast("double")
    records = sized.select(
        "id", normal_source("source").alias("source"), F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long").alias("size"), F.when(F.isnan(w) | w.isNull() | (w < LEAST_WEIGHT), LEAST_WEIGHT).otherwise(w).alias("weight")
    )
    place = (F.log(F.greatest(exponential_key(F.col("id"), F.col("weight"), seed), F.lit(1e-300))) + 700) * float(1 << 36)  # below 2^46
    records = records.select("id", "source", "size", F.floor(place).cast("long").alias("rank"), F.shiftrightunsigned(_drawn(F.col("id"), seed), 1).alias("draw"), F.monotonically_increasing_id().alias("no"))
    records = cut(records)
    wanted = targets.select(normal_source("source").alias("source"), F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"), F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0)).alias("max_repeat"))
    wanted = wanted.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_weight").alias("target_weight"), F.max("max_repeat").alias("max_repeat"))

    by_source = records.groupBy("source").agg(F.sum("size").alias("available"))
    whole = F.lit(total).cast("double") if total is not None else F.col("all_size").cast("double")
    grand = by_source.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("all_size"))
    plan = wanted.join(by_source, "source", "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("all_size", grand.scalar())
    plan = plan.withColumn("budget", F.col("target_weight") * whole)
    epochs = F.when(F.col("available") > 0, F.least(F.col("max_repeat").cast("double"), F.floor(F.col("budget") / F.col("available")))).otherwise(0)
    plan = plan.withColumn("epochs", epochs.cast("int"))
    plan = cut(plan.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeat"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0.0)))

    few = plan.count() <= 10_000  # as many rows as the caller gave targets; more than that aren't broadcast
    hint = F.broadcast if few else (lambda x: x)
    ends = cut(plan.select("source", "epochs", "rest").join(_cutoffs(records, plan, few), "source", "left"))
    fits = (F.col("rest") > 0) & (F.col("cutoff").isNull() | (F.struct(*ORDER) < F.col("cutoff")))
    chosen = records.join(hint(ends), "source").select("id", "source", "size", (F.col("epochs") + F.when(fits, 1).otherwise(0)).alias("copies")).filter(F.col("copies") > 0)
    used = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"))
    report = plan.join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    reached = report.agg(F.sum("used").alias("all_used"))
    report = report.withColumn("all_used", reached.scalar()).select(
        "source", "target_weight", "max_repeat", "available", "budget", "epochs", "used", F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.try_divide(F.col("used"), F.col("all_used")), F.lit(0.0)).alias("actual_share"),
        ((F.col("used") == F.col("max_repeat") * F.col("available")) & (F.col("used") < F.col("budget"))).alias("short"),
    )
    return Mix(chosen, report)
