"""A message broker over tables: reading in batches, claiming what lies idle, acknowledging, dispatching, measuring.

Messages are rows ``stream``, ``id``, ``at``; what was delivered and not acknowledged is pending: ``stream``, ``id``, ``owner``, ``at``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trimmed(messages: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` messages of each stream; older ones are dropped."""
    w = Window.partitionBy("stream").orderBy(F.desc("at"), F.desc("id"))
    return messages.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")


def claimed(pending: DataFrame, now, idle_s: int, owner: str) -> DataFrame:
    """Pending messages that lay for more than ``idle_s`` seconds, now the new owner's."""
    return pending.filter(F.unix_timestamp(now) - F.unix_timestamp("at") > idle_s).withColumns({"owner": F.lit(owner), "at": now})


def acknowledged(messages: DataFrame, pending: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and pending ones without those that are done (``stream``, ``id``)."""
    return messages.join(done, ["stream", "id"], "left_anti"), pending.join(done, ["stream", "id"], "left_anti")


def batches(messages: DataFrame, pending: DataFrame, size: int) -> DataFrame:
    """What a reader gets of each stream: new messages (not pending), the oldest first, then claimed ones, in batches of ``size``: ``batch`` from 0."""
    new = messages.join(pending.select("stream", "id"), ["stream", "id"], "left_anti").select("stream", "id", "at", F.lit(0).alias("turn"))
    rows = new.unionByName(pending.select("stream", "id", "at", F.lit(1).alias("turn")))
    w = Window.partitionBy("stream").orderBy("turn", "at", "id")
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int")).drop("turn")


def dispatched(messages: DataFrame, *levels: str) -> DataFrame:
    """One unit of work for each group of the levels: how many messages, the first and the last id."""
    return messages.groupBy(*levels).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def bounded_queues(messages: DataFrame, most: int, take: int) -> tuple[DataFrame, DataFrame]:
    """Local queues that take no more than ``most`` each (the oldest), and what one sequential drain of ``take`` gets: whole queues in their order as far as it goes."""
    w = Window.partitionBy("stream").orderBy("at", "id")
    held = messages.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    size = held.groupBy("stream").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("stream").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over queues
    return held, held.join(size.withColumn("before", before), "stream").filter(F.col("before") + F.col("place") <= take).select("stream", "id")


def task_metrics(log: DataFrame) -> DataFrame:
    """Of each kind of task (``kind``, ``id``, ``queued``, ``started``, ``done``, times or null): counts by status, mean seconds of waiting and working."""
    s = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return log.groupBy("kind").agg(
        F.count_if(F.col("started").isNull()).alias("waiting"), F.count_if(F.col("started").isNotNull() & F.col("done").isNull()).alias("running"), F.count_if(F.col("done").isNotNull()).alias("finished"),
        F.round(F.avg(s("started") - s("queued")), 3).alias("wait_s"), F.round(F.avg(s("done") - s("started")), 3).alias("work_s"),
    )


def mirrored(postings: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """A word index (``id``, ``term``, ...) after rows changed: all words of the changed ids go, those of their new texts come."""
    return postings.join(changed, "id", "left_anti").unionByName(fresh.select(*postings.columns))
