"""Stores on the shared folder: an event history and messages by scope, as Parquet files that are only added to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import lifecycle

HISTORY = "memory_id string, old_memory string, new_memory string, event string, created_at timestamp, updated_at timestamp, is_deleted boolean, actor_id string, role string"
MESSAGES = "id long, scope string, role string, content string, name string, created_at timestamp"


class HistoryStore:
    """Histories of memories, and the last messages of each scope. Batches of any size are written at once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _added(self, rows: DataFrame, table: str, schema: str) -> None:
        want = self.spark.createDataFrame([], schema)
        want.unionByName(rows, allowMissingColumns=True).write.mode("append").parquet(f"{self.path}/{table}")

    def add_history(self, rows: DataFrame) -> None:
        """Rows with any of the history's columns; the others are null."""
        self._added(rows, "history", HISTORY)

    def history(self) -> DataFrame:
        """All entries with ``pos``, their place in the history of their memory."""
        from pyspark.sql import Window

        w = Window.partitionBy("memory_id").orderBy("created_at", "updated_at", "event")
        return self.spark.read.schema(HISTORY).parquet(f"{self.path}/history").withColumn("pos", F.row_number().over(w))

    def save_messages(self, rows: DataFrame) -> None:
        self._added(rows, "messages", MESSAGES)

    def last_messages(self, n: int = 10) -> DataFrame:
        """The newest ``n`` messages of each scope; what is older counts as evicted."""
        return lifecycle.keep_latest(self.spark.read.schema(MESSAGES).parquet(f"{self.path}/messages"), ["scope"], "created_at", n, "id")


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 64, **options: str) -> DataFrame:
    """A table of a relational database (with vectors or not); read in ranges of an integer key if one is named. The driver's jar must be there."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()
