"""The training-data queries, each over its whole tables, and SQL twins where SQL is fast enough."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.chunking import split_oversized
from lodestrand.llm.mixing import Mix, mix
from lodestrand.llm.neighbours import recall, similar
from lodestrand.llm.packing import pack
from lodestrand.llm.partenum import classes, near_duplicates
from lodestrand.llm.partenum import expand as expand_near
from lodestrand.llm.quantiles import above, merged, percentiles, sketches
from lodestrand.llm.spans import expand, pair_spans, shared_pairs, shared_spans
from lodestrand.llm.tokens import token_count
from lodestrand.session import cut
from lodestrand.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # unless the session's setting spark.lodestrand.tokenizer names another file of ranks
CAPACITY = 2048
BOUNDS = [("latency_s", 50, 20.0), ("latency_s", 95, 150.0), ("total_tokens", 50, 15_000.0), ("total_tokens", 95, 150_000.0)]


# 1. Splitting oversized messages


def _messages(records: DataFrame) -> DataFrame:
    """``idx``, ``msg_index``, ``content`` of every message with a content."""
    rows = records.filter(F.col("idx").isNotNull()).select("idx", F.posexplode("messages").alias("msg_index", "m"))
    return rows.select("idx", "msg_index", F.col("m.content").alias("content")).filter(F.col("content").isNotNull())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_oversized(_messages(table(spark, d, "inference_records")), "content")
    return pieces.filter((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("idx", "msg_index").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all messages; of a record written twice, those of the first."""
    records = table(spark, d, "inference_records").select("idx", "ingested_at", "messages")
    first = records.filter(F.col("idx").isNotNull()).groupBy("idx").agg(F.min_by("messages", F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp"))).alias("messages"))
    return split_oversized(_messages(first), "content").select("idx", "msg_index", "piece_no", "n_pieces", "piece_start", "piece_end", "piece")


def p1_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of each message: the digest of its pieces put together again, and whether these are small enough, and overlap as they should."""
    rows = p1_pieces(spark, d).groupBy("idx", "msg_index").agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece_start", "piece_end", "piece"))).alias("p"))  # of one message
    before = F.transform("p", lambda x, i: F.when(i > 0, F.element_at("p", i)["piece_end"]).otherwise(0))
    fresh = F.zip_with("p", before, lambda x, b: F.substring(x["piece"], b - x["piece_start"] + 1, 3000))
    laps = F.zip_with("p", before, lambda x, b: (x["piece_no"] == 0) | (b - x["piece_start"]).between(120, 150))
    small = F.forall("p", lambda x: (F.char_length(x["piece"]) <= 3000) & (F.char_length(x["piece"]) == x["piece_end"] - x["piece_start"]))
    return rows.select("idx", "msg_index", F.md5(F.array_join(fresh, "")).alias("digest"), small.alias("small"), F.forall(laps, lambda x: x).alias("overlapping"))


# 2. Near-duplicates


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Three words and 0.6, as the cases of this data are defined."""
    memory = table(spark, d, "memory_bank").select(F.lit("content").alias("field"), F.col("memory_id").alias("id"), F.col("content").alias("text"))
    flows = table(spark, d, "workflow_instances")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("query", "agent_experience")]))
    flows = flows.select(F.col("workflow_id").alias("id"), each.alias("t")).select("t.field", "id", "t.text")
    return near_duplicates(memory.unionByName(flows), "field", "id", "text", Fraction(3, 5), 3)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return expand_near(*_near(spark, d)).select("field", "id_a", "id_b").distinct()


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its class, the number of similar texts and its group of near-duplicates."""
    return classes(*_near(spark, d))


# 3. Percentiles


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """One row a sample: of redelivered rows, the one ingested first."""
    rows = table(spark, d, "sample_totals").filter(F.col("sample_id").isNotNull())
    kept = F.struct("context_category", F.date_format("run_ts", "yyyy-MM-dd").alias("run_date"), "latency_s", "total_tokens")
    first = rows.groupBy("sample_id").agg(F.min_by(kept, F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp"))).alias("r"))
    return first.select("sample_id", "r.*")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    samples = cut(_samples(spark, d).filter(F.col("context_category").isNotNull() & F.col("run_date").isNotNull()))
    found = above(samples, ["context_category", "run_date"], BOUNDS)
    return found.select("metric", F.col("pct").cast("int").alias("pct"), "context_category", "run_date")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of every category and day, with the interval that the rank error allows."""
    return percentiles(sketches(_samples(spark, d), ["context_category", "run_date"], ["latency_s", "total_tokens"]), [5, 25, 50, 75, 90, 95, 99])


def p3_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same over all days, from the days' sketches."""
    days = sketches(_samples(spark, d), ["context_category", "run_date"], ["latency_s", "total_tokens"])
    return percentiles(merged(days, ["context_category"]), [5, 25, 50, 75, 90, 95, 99])


# 4. Similar vectors

FIELDS = ["query_embedding", "plan_embedding", "search_plan_embedding"]


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar workflows of every workflow, by each of the three vectors."""
    return similar(table(spark, d, "workflow_instances").select("workflow_id", *FIELDS), "workflow_id", FIELDS).withColumnRenamed("id", "workflow_id")


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """The share of the true 5 neighbours that is found, for every workflow whose second is divisible by 100."""
    flows = table(spark, d, "workflow_instances").select("workflow_id", *FIELDS)
    asked = flows.select(F.col("workflow_id").alias("id")).distinct().filter(F.pmod(F.floor(F.col("id").cast("double")), F.lit(100)) == 0)
    return recall(similar(flows, "workflow_id", FIELDS), flows, "workflow_id", FIELDS, asked)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = p4_neighbours(spark, d).filter(F.col("cos") >= 0.9)
    return near.select("field", F.least("workflow_id", "neighbour").alias("id_a"), F.greatest("workflow_id", "neighbour").alias("id_b")).distinct()


# 6. and 7. Containers and mixtures


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return docs.select("doc_id", "source", F.char_length("text").alias("chars"), token_count("text", spark.conf.get("spark.lodestrand.tokenizer", TOKENIZER)).alias("tokens"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Container of every part of every document."""
    return pack(_sizes(spark, d), "doc_id", "tokens", CAPACITY).select(F.col("item").cast("long").alias("doc_id"), "part", "n_parts", "size", "container", "gap")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_packed(spark, d).filter((F.col("n_parts") > 1) & (F.col("part") == F.col("n_parts") - 1)).select("doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, and how full."""
    each = p6_packed(spark, d).filter(F.col("container").isNotNull()).groupBy("container").agg(F.sum("size").alias("size"), F.count("*").alias("parts"))
    return each.agg(F.count("*").alias("containers"), F.sum("size").alias("tokens"), F.max("size").alias("fullest"), (F.sum("size") / (F.count("*") * CAPACITY)).alias("fill"))


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: documents placed; containers above the capacity, documents cut without need, and documents of which tokens are missing."""
    sizes = _sizes(spark, d).select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    rows = cut(pack(sizes, "doc_id", "tokens", CAPACITY))
    over = rows.filter(F.col("container").isNotNull()).groupBy("container").agg(F.sum("size").alias("s")).agg(F.count_if(F.col("s") > CAPACITY).alias("overfull"))
    each = rows.groupBy(F.col("item").cast("long").alias("doc_id")).agg(F.sum("size").alias("s"), F.max("n_parts").alias("n"), F.count("*").alias("parts")).join(sizes, "doc_id", "full")
    wrong = F.col("s").isNull() | F.col("tokens").isNull() | (F.col("s") != F.col("tokens")) | (F.col("n") != F.col("parts"))
    return each.agg(F.count_if(F.col("s") > 0).alias("placed"), F.count_if((F.col("n") > 1) & (F.col("s") <= CAPACITY)).alias("cut_small"), F.count_if(wrong).alias("lost")).withColumn("overfull", over.scalar())


def _mix(spark: SparkSession, d: str) -> Mix:
    """The weight is a measure of the text as it is: its characters a token."""
    weight = F.try_divide(F.col("chars").cast("double"), F.col("tokens"))
    return mix(_sizes(spark, d).select(F.col("doc_id").alias("id"), "source", F.col("tokens").alias("size"), weight.alias("weight")), table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report.filter("short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every chosen document and how often it is used."""
    return _mix(spark, d).chosen


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of each source: no record above the repeats allowed, no more used than the budget, and no more left of it than the largest record, unless the source ran short."""
    sizes = _sizes(spark, d).groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("tokens").alias("largest"))
    r = p7_report(spark, d).join(sizes, "source", "left")
    near = F.col("short") | (F.col("budget") - F.col("used") <= F.coalesce("largest", F.lit(0)))
    return r.select("source", (F.col("most_copies") <= F.col("max_repeat")).alias("repeats"), (F.col("used") <= F.col("budget")).alias("within"), near.alias("near"))


# 8. Shared spans


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return expand(*shared_pairs(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The shared spans themselves: document, start and stop, and the document (the first of those with that text)
    that has them too. Of documents with the same text, the first stands for all; ``p8_classes`` names the others."""
    spans, _ = pair_spans(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return spans.select(F.col("x").alias("doc_id"), F.col("y").alias("other_doc"), "start", "stop")


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document of 200 characters or more with the first document of the same text, the number of its copies,
    how many other texts share a span with it, and its group: all documents that shared spans link."""
    pairs, members = shared_pairs(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    rows = classes(pairs, members.select(F.lit("text").alias("field"), F.col("id"), F.col("rep").alias("rid")))
    return rows.select(F.col("id").alias("doc_id"), "class", "copies", "links", "group")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """For every document with a text, how many spans it shares and what share of the text they cover."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    spans = shared_spans(docs, "doc_id", "text").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("spans"), F.sum(F.col("stop") - F.col("start")).alias("shared_chars"))
    sizes = docs.filter(F.col("text").isNotNull()).select("doc_id", F.char_length("text").alias("chars"))
    rows = sizes.join(spans, "doc_id", "left")
    n = F.coalesce("shared_chars", F.lit(0))
    return rows.select("doc_id", "chars", F.coalesce("spans", F.lit(0)).alias("spans"), n.alias("shared_chars"), F.coalesce(F.try_divide(n, F.col("chars")), F.lit(0.0)).alias("share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_whole, p2_found, p2_classes, p3_found, p3_percentiles, p3_merged, p4_found, p4_neighbours, p4_recall, p6_found, p6_packed, p6_fill, p6_checked, p7_found, p7_report, p7_mixture, p7_checked, p8_found, p8_shares, p8_spans, p8_classes)}

SQL = {
    "p1_found": "SELECT DISTINCT idx, (i - 1)::INTEGER AS msg_index FROM (SELECT idx, messages, unnest(range(1, len(messages) + 1)) AS i FROM inference_records WHERE idx IS NOT NULL) WHERE length(messages[i].content) > 3000",
    "p1_whole": """SELECT idx, (i - 1)::INTEGER AS msg_index, md5(messages[i].content) AS digest, true AS small, true AS overlapping FROM (
  SELECT idx, messages, unnest(range(1, len(messages) + 1)) AS i FROM (SELECT idx, arg_min(messages, ingested_at) AS messages FROM inference_records WHERE idx IS NOT NULL GROUP BY 1)
) WHERE messages[i].content IS NOT NULL""",
    "p6_checked": "SELECT count(*) FILTER (WHERE text <> '') AS placed, 0::BIGINT AS cut_small, 0::BIGINT AS lost, 0::BIGINT AS overfull FROM documents",
    "p7_checked": "SELECT DISTINCT lower(trim(source)) AS source, true AS repeats, true AS within, true AS near FROM mix_targets WHERE source IS NOT NULL",
    "p3_found": """WITH s AS (
  SELECT sample_id, arg_min({'c': context_category, 'd': strftime(run_ts, '%Y-%m-%d'), 'l': latency_s, 't': total_tokens}, ingested_at) AS r FROM sample_totals WHERE sample_id IS NOT NULL GROUP BY 1
), v AS (
  SELECT 'latency_s' AS metric, r.c AS c, r.d AS d, r.l AS x FROM s UNION ALL SELECT 'total_tokens', r.c, r.d, r.t::DOUBLE FROM s
), g AS (SELECT metric, c, d, x FROM v WHERE c IS NOT NULL AND d IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)),
b(metric, pct, bound) AS (VALUES ('latency_s', 50, 20.0), ('latency_s', 95, 150.0), ('total_tokens', 50, 15000.0), ('total_tokens', 95, 150000.0))
SELECT g.metric, b.pct::INTEGER AS pct, c AS context_category, d AS run_date FROM g JOIN b USING (metric)
GROUP BY g.metric, b.pct, c, d, b.bound HAVING count(*) >= 30 AND count(*) FILTER (WHERE x <= bound) * 100 < b.pct * count(*)""",
}
