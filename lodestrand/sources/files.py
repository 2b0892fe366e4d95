"""File sources and sinks of result logs: tolerant JSON lines, attributes in paths, ciphered CSV, phase logs."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.session import cut


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the bad lines; blank lines are skipped."""
    lines = spark.read.text(path, recursiveFileLookup=True).filter(F.trim("value") != "")
    bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = lines.select(F.from_json("value", bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return rows.filter("r._corrupt_record is null").select(*[f"r.`{f.name}`" for f in schema.fields]), rows.filter("r._corrupt_record is not null").select(F.col("r._corrupt_record").alias("line"))


def path_attributes(path: Column) -> dict[str, Column]:
    """Back-end and top-k that a run's path names; null where it names none."""
    k = F.regexp_extract(path, r"topk(\d+)", 1)
    return {"run": F.regexp_extract(path, r"([^/]+)/[^/]*$", 1), "top_k": F.when(k != "", k.cast("int"))}


def _over(data: bytes, key: str) -> bytes:
    """The bytes with the key's digest, repeated, XORed over."""
    pad, x = np.frombuffer(hashlib.sha256(key.encode()).digest(), np.uint8), np.frombuffer(data, np.uint8)
    return (x ^ np.resize(pad, len(x))).tobytes() if len(x) else b""


def xor_decoded(cipher: Column, key: Column) -> Column:
    """Text from base64 bytes that a repeating key was XORed over; the key is the SHA-256 of a password. Null for a null."""

    @F.pandas_udf("string")
    def decode(cs: pd.Series, ks: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or k is None else _over(bytes(c), k).decode("utf-8", "replace") for c, k in zip(cs, ks, strict=True)], dtype=object)

    return decode(F.unbase64(cipher), key)


def xor_encoded(text: Column, key: Column) -> Column:
    """The opposite of :func:`xor_decoded`."""

    @F.pandas_udf("binary")
    def encode(ts: pd.Series, ks: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or k is None else _over(t.encode(), k) for t, k in zip(ts, ks, strict=True)], dtype=object)

    return F.base64(encode(text, key))


def json_folder(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all files below a folder whose lines are an object or a list of objects each; other lines give none."""
    lines = spark.read.text(path, recursiveFileLookup=True).filter(F.trim("value") != "")
    one = F.from_json("value", schema)
    many = F.from_json("value", T.ArrayType(schema))
    return lines.select(F.explode(F.when(F.col("value").startswith("["), many).otherwise(F.array(one))).alias("r")).filter("r is not null").select("r.*")


def indexed(df: DataFrame, order: str, width: int) -> DataFrame:
    """``df`` with ``index``, the place of each row in the order of an integer column, from 0: rows are counted by ranges of
    ``width`` values first, so no window holds more than a range."""
    rows = df.withColumn("__range", F.floor(F.col(order) / width))
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over ranges
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return rows.join(sizes.withColumn("__before", before), "__range").withColumn("index", F.col("__before") + inside - 1).drop("__range", "__n", "__before")


def load(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Rows from files of a kind: csv (with a header), json (lines), xml (elements ``row``), text (fields parted by tabs), html (table rows)."""
    if kind == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    if kind == "json":
        return spark.read.schema(schema).json(path)
    if kind == "xml":
        return spark.read.schema(schema).option("rowTag", "row").xml(path)
    kept = T._parse_datatype_string(schema)
    lines = spark.read.text(path)
    if kind == "text":
        parts = F.split("value", "\t")
    elif kind == "html":
        lines = lines.filter(F.col("value").contains("<td"))
        parts = F.transform(F.regexp_extract_all("value", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda x: F.regexp_replace(x, "<[^>]+>", ""))
    else:
        raise ValueError(f"no loader for {kind!r}")
    return lines.select(*[F.get(parts, i).try_cast(f.dataType).alias(f.name) for i, f in enumerate(kept.fields)])


def save(df: DataFrame, path: str, kind: str) -> None:
    """Writes what :func:`load` reads."""
    if kind == "csv":
        df.write.option("header", True).csv(path)
    elif kind == "json":
        df.write.json(path)
    elif kind == "xml":
        df.write.option("rowTag", "row").xml(path)
    else:
        cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
        row = F.concat_ws("\t", *cells) if kind == "text" else F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
        df.select(row.alias("value")).write.text(path)


def write_tsv(df: DataFrame, path: str, headers: list[list[str]]) -> None:
    """A small table as text: rows of headers, then the table's, parted by tabs, in one file."""
    head = df.sparkSession.createDataFrame([(i - len(headers), "\t".join(h)) for i, h in enumerate(headers)], "k long, value string")
    rows = df.select(F.monotonically_increasing_id().alias("k"), F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value"))
    head.unionByName(rows).repartitionByRange(1, "k").sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def phases(lines: DataFrame, key: str, order: str, text: str, start: str, done: str) -> DataFrame:
    """Log lines with the number of the phase they lie in, per ``key``: a line that matches ``start`` opens
    one, a line that matches ``done`` is its last; lines outside have phase 0."""
    w = Window.partitionBy(key).orderBy(order)
    opened = F.sum(F.col(text).rlike(start).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    closed = F.coalesce(F.sum(F.col(text).rlike(done).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("phase", F.when(opened > closed, opened).otherwise(0))


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_ranked_csv(df: DataFrame, score: str, path: str, tie: str) -> None:
    """Rows ranked by score with two decimals, those without one last, as N/A. Files are in the order of the ranks; these come from the
    number of rows in each range that a sort by range makes, not from one window."""
    ordered = df.repartitionByRange(F.desc_nulls_last(score), F.asc(tie)).sortWithinPartitions(F.desc_nulls_last(score), F.asc(tie)).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id())
    ordered = cut(ordered)
    sizes = ordered.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over partitions
    inside = F.row_number().over(Window.partitionBy("__p").orderBy("__k"))
    rows = ordered.join(sizes.withColumn("__before", before), "__p").withColumn("rank", F.col("__before") + inside)
    text = F.when(F.col(score).isNull(), "N/A").otherwise(F.format_string("%.2f", F.col(score)))
    rows = rows.select(*[text.alias(c) if c == score else F.col(f"`{c}`") for c in df.columns], "rank")
    rows.repartitionByRange("rank").sortWithinPartitions("rank").write.mode("overwrite").option("header", True).csv(path)
