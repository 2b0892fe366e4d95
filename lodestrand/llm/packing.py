"""Filling containers of fixed capacity: sum-of-squares packing.

Each item goes where the sum over all residual gaps g of N(g)^2 becomes smallest, N(g) being the number
of open containers with gap g. Opening a container counts as filling one of gap ``capacity``; a container
that is exactly full is closed. The rule keeps many different gaps in stock, so that later items find one
that they fill, and it needs only the counts, not the containers.

Items are dealt to shards by hash, about ``shard_items`` to each, and every shard packs its own. Containers
that stay emptier than ``target`` after that are opened again: their items go on to the next level, again
about ``shard_items`` to a shard. That ends with a single shard, or where the shards would be more than half
as many as before: items most of which can't be combined (all just over half the capacity, for instance)
stay where they are, as other items of their kind would fill their containers no better.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.session import cut

OUT = "no long, item string, part int, n_parts int, size long, level int, shard int, bin int, gap long"
ITEM = ["no", "item", "part", "n_parts", "size"]


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item (1 <= size <= capacity), and the final gap of each container."""
    counts = np.zeros(capacity + 1, np.int64)
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    where = np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        # Change of the sum if the item goes to gap g: -2 N(g) + 1 for g, and 2 N(g - s) + 1 for g - s unless that is 0.
        change = counts[: capacity + 1 - s] * 2 + 1
        change[0] = 0
        change -= counts[s:] * 2 - 1
        change[:-1][counts[s:capacity] == 0] = np.iinfo(np.int64).max
        change[-1] = 2 * counts[capacity - s] + 1 if s < capacity else 0  # a new container: no count of gap `capacity` is lost
        g = int(change.argmin()) + s
        if g < capacity:
            b = stock[g].pop()
            counts[g] -= 1
        else:
            b = len(gaps)
            gaps.append(capacity)
        where[i], gaps[b] = b, g - s
        if g > s:
            stock[g - s].append(b)
            counts[g - s] += 1
    return where, np.array(gaps, np.int64)


def _packer(capacity: int, level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["size", "item", "part", "no"], ascending=[False, True, True, True], kind="stable")
        where, gaps = sum_of_squares(items["size"].to_numpy(), capacity)
        return items[ITEM].assign(level=level, shard=int(key[0]), bin=where, gap=gaps[where] if len(where) else [])

    return pack


def pack(df: DataFrame, item: str, size: Column | str, capacity: int = 2048, shard_items: int = 20_000, target: float = 0.99) -> DataFrame:
    """A row for each part of each item: ``item`` (text), ``part``, ``n_parts``, ``size``, ``container``, ``gap``.

    An item within the capacity has one part. A larger one is cut into parts that fill a container each,
    and a rest that is packed like any item. Items of size 0, or without a size, need no container: they
    come out with a null ``container``. The same item twice is two items of equal name, as are two
    without a name. An empty table gives an empty table.
    """
    c, s = F.lit(capacity), F.coalesce((F.col(size) if isinstance(size, str) else size).cast("long"), F.lit(0))
    sized = cut(df.select(F.col(f"`{item}`").cast("string").alias("item"), F.greatest(s, F.lit(0)).alias("total")).withColumn("no", F.monotonically_increasing_id()))
    parts = F.greatest(F.lit(1), F.ceil(F.col("total") / c)).cast("int")
    rows = sized.withColumn("n_parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    rows = rows.withColumn("size", F.least(c, F.col("total") - F.col("part") * c))
    none = F.col("size") == 0
    full = rows.filter((F.col("size") == c) | none).select(
        "item", "part", "n_parts", "size", F.when(~none, F.concat_ws("-", F.lit("whole"), "no", "part")).alias("container"), F.when(~none, F.lit(0)).cast("long").alias("gap")
    )
    todo = rows.filter((F.col("size") > 0) & (F.col("size") < c)).select(*ITEM)
    shards, level, closed = max(1, -(-todo.count() // shard_items)), 0, None
    while True:
        shard = F.pmod(F.xxhash64("no", "part", F.lit(level)), F.lit(shards)).cast("int")
        packed = cut(todo.withColumn("shard", shard).groupBy("shard").applyInPandas(_packer(capacity, level), OUT))
        emptier = packed.filter(F.col("gap") > c * (1 - target))
        fewer = max(1, -(-emptier.count() // shard_items)) if shards > 1 else 1
        last = fewer * 2 > shards
        good = packed if last else packed.filter(F.col("gap") <= c * (1 - target))
        closed = good if closed is None else closed.unionByName(good)
        if last:
            break
        todo, shards, level = emptier.select(*ITEM), fewer, level + 1
    placed = closed.select("item", "part", "n_parts", "size", F.concat_ws("-", "level", "shard", "bin").alias("container"), "gap")
    return full.unionByName(placed)
