"""Memory life-cycle: keeping, replacing, pruning, deduplicating. Every operator is a plan over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, by: list[str], order: str, n: int, tie: str) -> DataFrame:
    """The newest n rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(order), F.desc(tie))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def partial_update(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Non-null fields of the patch replace those of the row with that key."""
    p = patch.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in patch.columns if c != key])
    return old.join(p, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in patch.columns and c != key else F.col(c) for c in old.columns])


def prune(df: DataFrame, by: str, priority: Column, order: str, most: int, buffer: int = 0) -> DataFrame:
    """Of groups with more than ``most + buffer`` rows, the ``most`` with the highest priority; later rows win ties."""
    w = Window.partitionBy(by)
    ranked = df.withColumns({"__n": F.count("*").over(w), "__rn": F.row_number().over(w.orderBy(priority.desc(), F.desc(order)))})
    return ranked.filter((F.col("__n") <= most + buffer) | (F.col("__rn") <= most)).drop("__n", "__rn")


def new_by_signature(bank: DataFrame, batch: DataFrame, text: str, order: str, within_batch: bool = True, least: int = 0) -> DataFrame:
    """Rows of the batch whose lower-case text isn't in the bank yet, and (``within_batch``) not earlier in the batch."""
    sig = F.sha2(F.lower(F.col(text)), 256)
    fresh = batch.filter(F.char_length(text) >= least).withColumn("sig", sig).join(bank.select(sig.alias("sig")).distinct(), "sig", "left_anti")
    if within_batch:
        fresh = fresh.withColumn("__rn", F.row_number().over(Window.partitionBy("sig").orderBy(order))).filter("__rn = 1").drop("__rn")
    return fresh


def soft_delete(df: DataFrame, hit: Column, record: str) -> DataFrame:
    """Marks rows that aren't deleted yet; ``status`` and ``record_id`` change."""
    now = hit & (F.coalesce("status", F.lit("activated")) != "deleted")
    return df.withColumns({"status": F.when(now, "deleted").otherwise(F.col("status")), "record_id": F.when(now, record).otherwise(F.col("record_id"))})


def recover(df: DataFrame, record: str) -> DataFrame:
    """Rows deleted under that record become activated, whatever they were before."""
    hit = F.coalesce(F.col("record_id") == record, F.lit(False))
    return df.withColumns({"status": F.when(hit, "activated").otherwise(F.col("status")), "record_id": F.when(hit, None).otherwise(F.col("record_id"))})


def heat(visits: Column, pages: Column, recency: Column, a: float = 1.0, b: float = 1.0, c: float = 1.0) -> Column:
    return a * visits + b * pages + c * recency


def time_decay(event: Column, now: Column, tau_hours: float) -> Column:
    """exp(-hours / tau); an unreadable time gives 0.1."""
    hours = (F.unix_timestamp(now) - F.unix_timestamp(event)) / 3600.0
    return F.coalesce(F.exp(-hours / tau_hours), F.lit(0.1))


def rate_limited(df: DataFrame, key: str, ts: str, window_s: int, most: int) -> DataFrame:
    """``allowed``: at most ``most`` calls, this one and denied ones included, in the window that ends with it."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-window_s * 1_000_000 + 1, 0)
    return df.withColumn("in_window", F.count("*").over(w)).withColumn("allowed", F.col("in_window") <= most)


def linked_entities(known: DataFrame, found: DataFrame, near: DataFrame) -> DataFrame:
    """Entities after memories named some: ``entity`` and the sorted ``ids`` of its memories. ``known`` has ``entity`` and ``ids``, ``found``
    ``entity`` and ``id``; ``near`` (``entity``, ``as``) tells which known one a found one is so close to that it counts as that; the others are new."""
    named = found.join(near, "entity", "left").select(F.coalesce("as", "entity").alias("entity"), "id")
    rows = known.select("entity", F.explode("ids").alias("id")).unionByName(named)
    return rows.groupBy("entity").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def unlinked(entities: DataFrame, gone: DataFrame) -> DataFrame:
    """Entities without the memories in ``gone`` (``id``); one that has none left goes."""
    left = entities.select("entity", F.explode("ids").alias("id")).join(gone, "id", "left_anti")
    return left.groupBy("entity").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def merged_monitor(old: DataFrame, new: DataFrame, retained: int, most: int) -> DataFrame:
    """Monitored items (``key``, ``score``, ``recorded``) after a round: those seen again are recorded once more with the new score; of the others
    the best ``retained`` stay, with score 0; the best ``most`` of all remain, the more recorded first among equals."""
    both = old.alias("o").join(new.alias("n"), "key", "full").select("key", F.col("o.score").alias("was"), F.col("o.recorded").alias("r"), F.col("n.score").alias("now"))
    again = both.filter("now is not null").select("key", F.col("now").alias("score"), (F.coalesce("r", F.lit(0)) + 1).alias("recorded"))
    rest = both.filter("now is null").orderBy(F.desc("was"), "key").limit(retained).select("key", F.lit(0.0).alias("score"), F.col("r").alias("recorded"))
    return again.unionByName(rest).orderBy(F.desc("score"), F.desc("recorded"), "key").limit(most)


def key_value_log(ops: DataFrame, valid: Column, longest: int) -> DataFrame:
    """Operations (``store``, ``key``, ``pos``, ``op``, ``value``) of key-value memories with ``done``: add needs a ``valid`` key that isn't there and a
    value of at most ``longest`` characters, replace and remove one that is there (replace a short value, too). Whether a key is there
    before an operation follows from the last add or remove before it, as each of these leaves it there or not."""
    fits = valid & (F.coalesce(F.char_length("value"), F.lit(0)) <= longest)
    sets = F.when((F.col("op") == "add") & fits, 1).when(F.col("op") == "remove", 0)
    before = Window.partitionBy("store", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    there = F.coalesce(F.last(sets, True).over(before), F.lit(0)) == 1
    done = F.when(F.col("op") == "add", fits & ~there).when(F.col("op") == "replace", there & fits).when(F.col("op") == "remove", there).otherwise(F.lit(False))
    return ops.withColumn("done", F.coalesce(done, F.lit(False)))


def versioned(old: DataFrame, new: DataFrame, key: str, tag: int, order: str, most: int) -> tuple[DataFrame, int]:
    """The newest ``most`` rows after ``new`` replaced rows of ``old`` with the same key, and the tag that follows: from 0 to 255, then 0 again."""
    return upsert(old, new, key).orderBy(F.desc(order), key).limit(most), (tag + 1) % 256
