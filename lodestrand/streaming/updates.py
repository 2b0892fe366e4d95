"""Keyed micro-batch streams. Delivery is at least once, so every sink is idempotent by batch or by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.session import fresh_dir


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str, files: int = 1) -> DataFrame:
    """Messages from Parquet files as they come, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there and returns what it wrote. In append mode each micro-batch has a
    folder of its own, which a repeated batch overwrites; in complete mode the last result stays."""
    spark = stream.sparkSession
    at = fresh_dir(spark)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/{'all' if mode == 'complete' else f'batch={epoch}'}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out/{'all' if mode == 'complete' else 'batch=*'}")


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], window: str, late: str = "10 minutes") -> DataFrame:
    """Counts by keys and tumbling window. The watermark is an engineering choice of this library."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), *keys, "n")


def quota(batch: DataFrame, stream_key: str, order: str, most: int) -> DataFrame:
    """At most so many messages of each stream, the oldest first."""
    from pyspark.sql import Window

    w = Window.partitionBy(stream_key).orderBy(order)
    return batch.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= most).drop("__rn")


def sessions(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Activity sessions of each key: a stream counts as expired after a gap without messages."""
    timed = df.withColumn("__ts", F.col(ts).cast("timestamp"))
    return timed.groupBy(key, F.session_window("__ts", gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.unix_micros("s.start").alias("start_us"), "n")
