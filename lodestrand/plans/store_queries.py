"""Queries of filters, stores, files, streams and life-cycles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.functions import extraction as E
from lodestrand.functions import text as X
from lodestrand.operators import filters, lifecycle
from lodestrand.operators import hybrid as H
from lodestrand.plans.graph_queries import SQL as GRAPH_SQL
from lodestrand.session import fresh_dir
from lodestrand.sources import files
from lodestrand.sources.stores import HistoryStore
from lodestrand.sources.tables import table
from lodestrand.streaming import broker

_NOW = "2024-02-01"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


# Filters


def pred2_first_operator(spark: SparkSession, d: str) -> DataFrame:
    f = {"value": {"gte": 10, "lt": 60}, "NOT": [{"event_type": {"in": ["click", "view"], "ne": "error"}}]}
    return _events(spark, d).filter(filters.build(filters.first_operator(f))).select("event_id")


def pred3_lower_case(spark: SparkSession, d: str) -> DataFrame:
    f = {"and": [{"event_type": {"icontains": "I"}}, {"event_type": {"like": "%c%"}}], "not": [{"value": {"gte": 20, "lte": 30, "ne": 25}}]}
    return _events(spark, d).filter(filters.build(f)).select("event_id")


def pred4_flat(spark: SparkSession, d: str) -> DataFrame:
    """On the payload: a missing key satisfies nothing."""
    payload = lambda key: F.get_json_object("props", f"$.{key}")
    return _events(spark, d).filter(filters.build({"k": ["1", "2", "3"]}, payload) & ~filters.build({"absent": "x"}, payload)).select("event_id")


def pred5_expressions(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memory_bank").select("memory_id", "tags", "usage_count")
    return m.filter(filters.from_expressions([{"field": "tags", "op": "contains", "value": "ledger"}, {"field": "usage_count", "op": ">", "value": 3}])).select("memory_id").distinct()


def pred6_overlap(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memory_bank").select("memory_id", "tags", "type")
    return m.filter(filters.from_expressions([{"field": "tags", "op": "contains", "value": ["ledger", "retry", "tools"]}, {"field": "memory_id", "op": "starts_with", "value": "mem-"}])).select("memory_id").distinct()


def pred7_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.filter(filters.build(filters.with_dates({"o_orderdate": {"gte": "1995-01-01", "lt": "1995-03-31"}}))).select("o_orderkey")


def pred9_listing_state(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("state", F.when(F.col("c_acctbal") < 0, "deleted").otherwise("active"))
    o = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return c.filter("state <> 'deleted'").join(o, "c_custkey", "left").filter(F.lower("c_mktsegment").contains("b")).select("c_custkey", "c_mktsegment").distinct().orderBy("c_custkey").offset(3).limit(40)


def pred10_sorted_listing(spark: SparkSession, d: str) -> DataFrame:
    """Sorted by an allowed column, else by the newest first."""
    wanted, allowed = "o_secret", {"o_totalprice": F.desc("o_totalprice"), "o_orderdate": F.desc("o_orderdate")}
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").orderBy(allowed.get(wanted, allowed["o_orderdate"]), "o_orderkey").limit(30).select("o_orderkey")


def pred12_roles(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a role with any of the words, those of the latest records first."""
    r = table(spark, d, "inference_records").groupBy("idx").agg(F.max("run_ts").alias("at"), F.min("messages").alias("m"))
    m = r.filter("at is not null").select("idx", "at", F.posexplode("m").alias("pos", "x")).filter("x.role = 'user' and (x.content like '%ledger%' or x.content like '%agent%')")
    return m.orderBy(F.desc("at"), "idx", "pos").limit(40).select("idx", "pos")


def pred13_subset(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey")
    return filters.subset(c, "c_custkey", c.filter("c_custkey % 3 = 0"), c.filter("c_custkey % 2 = 0"), 50)


def pred17_fields(spark: SparkSession, d: str) -> DataFrame:
    return filters.fields(table(spark, d, "supplier"), ["s_suppkey", "s_name", "s_acctbal; drop"], ["s_suppkey", "s_name", "s_nationkey"])


def pred18_price_range(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(i,) for i in range(-2, 40)], "p_partkey long")
    return asked.join(table(spark, d, "part"), "p_partkey", "left").filter(F.coalesce("p_retailprice", F.lit(0.0)).between(0, 930)).select("p_partkey")


def pred19_changes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("change", F.col("value") - F.lag("value").over(w))
    return e.filter(F.abs("change") >= 60).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("ids"))


def pred22_owner_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(filters.build({"o_custkey": {"lt": 200}, "o_orderstatus": "F"})).select("o_orderkey")


def pred23_cube_access(spark: SparkSession, d: str) -> DataFrame:
    """Active customers and the nations they own or are members of, if these are active."""
    c = table(spark, d, "customer").filter("c_acctbal >= 0").select("c_custkey", "c_nationkey")
    owns = c.select("c_custkey", F.col("c_nationkey").alias("cube"))
    member = c.filter("c_custkey % 10 = 0").select("c_custkey", F.pmod(F.col("c_nationkey") + 1, F.lit(25)).alias("cube"))
    return owns.unionByName(member).distinct().filter("cube % 5 <> 0").groupBy("cube").agg(F.count("*").alias("n"))


def pred24_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The oldest three rounds of every session."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("event_id")


def pred25_where(spark: SparkSession, d: str) -> DataFrame:
    """All keys count, numbers as well."""
    where = {"event_type": "click", "user_id": 7}
    return _events(spark, d).filter(filters.build({"$and": [{k: v} for k, v in where.items()]})).select("event_id")


# Files: written to the shared folder, and read again


def s1_json_lines(spark: SparkSession, d: str) -> DataFrame:
    at = fresh_dir(spark)
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    e.select(F.concat(F.to_json(F.struct("*")), F.when(F.col("event_id") % 3 == 0, "\n   ").otherwise("")).alias("value")).write.text(at)
    return files.json_lines(spark, at, e.schema)[0]


def s2_bad_lines(spark: SparkSession, d: str) -> DataFrame:
    at = fresh_dir(spark)
    e = table(spark, d, "events").select("event_id", "event_type")
    e.select(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("*"))).alias("value")).write.text(at)
    good, bad = files.json_lines(spark, at, e.schema)
    return good.select(F.lit("good").alias("kind")).unionByName(bad.select(F.lit("bad").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


def s3_json_folder(spark: SparkSession, d: str) -> DataFrame:
    """Files of one object or one list each."""
    at = fresh_dir(spark)
    e = table(spark, d, "events").select("event_type", F.struct("event_id", "user_id").alias("o"))
    e.groupBy("event_type").agg(F.to_json(F.array_sort(F.collect_list("o"))).alias("value")).select("value").repartition(4).write.text(at + "/lists")
    table(spark, d, "region").select(F.to_json(F.struct(F.col("r_regionkey").cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"))).alias("value")).repartition(5).write.text(at + "/objects")
    return files.json_folder(spark, at, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType())])).select("event_id", "user_id")


def s4_path_attributes(spark: SparkSession, d: str) -> DataFrame:
    at = fresh_dir(spark)
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "bm25_topk5").otherwise("graph_topk10").alias("run"))
    s.write.partitionBy("run").json(at)
    a = files.path_attributes(F.col("path"))
    rows = spark.read.schema("s_suppkey long").option("recursiveFileLookup", True).json(at).select("s_suppkey", F.col("_metadata.file_path").alias("path"))
    return rows.groupBy(a["top_k"].alias("top_k")).agg(F.count("*").alias("n"))


def s5_csv_dicts(spark: SparkSession, d: str) -> DataFrame:
    at = fresh_dir(spark)
    table(spark, d, "difficulty_tiers").write.option("header", True).option("quoteAll", True).csv(at)
    t = spark.read.option("header", True).schema("context_id string, context_category string, difficulty string").csv(at)
    return t.groupBy(F.lower(F.trim("difficulty")).alias("tier")).agg(F.count("*").alias("n"))


def s6_ciphered(spark: SparkSession, d: str) -> DataFrame:
    """Texts enciphered, written as CSV, read and deciphered."""
    at = fresh_dir(spark)
    s = table(spark, d, "supplier").select("s_suppkey", files.xor_encoded(F.col("s_name"), F.concat(F.lit("key"), F.col("s_suppkey"))).alias("prompt"))
    s.write.option("header", True).csv(at)
    rows = spark.read.option("header", True).schema("s_suppkey long, prompt string").csv(at)
    return rows.select("s_suppkey", files.xor_decoded(F.col("prompt"), F.concat(F.lit("key"), F.col("s_suppkey"))).alias("s_name"))


def s7_four_filters(spark: SparkSession, d: str) -> DataFrame:
    """Four equality filters, letter case apart, and the place of each document in the order of ids, from counts of ranges of ids."""
    docs = files.indexed(table(spark, d, "documents"), "doc_id", 1000)
    same = lambda c, v: F.lower(F.trim(c)) == v
    return docs.filter(same("lang", "en") & same("source", "rulebook") & same(F.substring("context_id", 1, 4), "ctx-") & same((F.col("n_chars") > 100).cast("string"), "true")).select("doc_id", "index")


def s8_split_by_source(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(F.lower(F.trim("source"))).orderBy("doc_id")
    return table(spark, d, "documents").withColumn("r", F.row_number().over(w)).filter("r <= 7 and source is not null").select("doc_id")


def s9_text_and_questions(spark: SparkSession, d: str) -> DataFrame:
    """Context texts as files and questions as JSON, joined by name; a sample by digest."""
    at = fresh_dir(spark)
    f = table(spark, d, "workflow_instances").filter("query is not null").groupBy("workflow_id").agg(F.min("query").alias("query"))
    f.select(F.to_json(F.struct("workflow_id", F.col("query").alias("question"))).alias("value")).write.text(at)
    q = spark.read.schema("workflow_id string, question string").json(at)
    return q.orderBy(F.md5(F.concat(F.lit("7:"), "workflow_id")), "workflow_id").limit(50).select("workflow_id", F.md5("question").alias("question"))


def s10_log_file(spark: SparkSession, d: str) -> DataFrame:
    """A log with phases that open and close, and steps between."""
    at = fresh_dir(spark)
    e = table(spark, d, "events")
    line = F.when(F.col("event_type") == "signup", "phase start").when(F.col("event_type") == "purchase", "phase done").otherwise(F.concat(F.lit("step "), "event_id"))
    e.select(F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.concat(F.lit("user="), "user_id"), F.concat(F.lit("n="), "event_id"), line).alias("value")).write.text(at)
    p = r"^(\S+ \S+)\tuser=(\d+)\tn=(\d+)\t(.*)$"
    rows = spark.read.text(at).select(*[F.regexp_extract("value", p, i).alias(c) for i, c in enumerate(("at", "user", "n", "text"), 1)])
    done = files.phases(rows.withColumn("n", F.col("n").cast("long")), "user", "n", "text", "phase start", "phase done")
    return done.groupBy(F.col("user").cast("long").alias("user_id")).agg(F.max("phase").cast("long").alias("phases"), F.count_if((F.col("phase") > 0) & F.col("text").startswith("step")).alias("steps"))


def s13_loaders(spark: SparkSession, d: str) -> DataFrame:
    """The same rows as CSV, JSON, XML, text and HTML."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    out = None
    for kind in ("csv", "json", "xml", "text", "html"):
        at = fresh_dir(spark)
        files.save(n, at, kind)
        one = files.load(spark, at, kind, "id long, name string").select(F.lit(kind).alias("kind"), "id", "name")
        out = one if out is None else out.unionByName(one)
    return out


def k1_append(spark: SparkSession, d: str) -> DataFrame:
    at = fresh_dir(spark)
    e = table(spark, d, "events").select("event_id", "value")
    for k in range(3):
        files.append_json(e.filter(F.col("event_id") % 3 == k), at)
    return spark.read.schema(e.schema).json(at)


def k2_two_headers(spark: SparkSession, d: str) -> DataFrame:
    """A table with two header rows, as text; all of it is read again."""
    at = fresh_dir(spark)
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.min("n_name").alias("first")).orderBy("n_regionkey")
    files.write_tsv(n, at, [["", "count", "name"], ["region", "n", "first"]])
    return spark.read.text(at).select("value")


def k3_summaries(spark: SparkSession, d: str) -> DataFrame:
    at = fresh_dir(spark)
    s = table(spark, d, "supplier")
    s.select("s_suppkey", "s_nationkey", "s_acctbal").write.option("header", True).csv(at + "/samples")
    s.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 4).alias("mean")).write.option("header", True).csv(at + "/summary")
    return spark.read.option("header", True).schema("s_nationkey int, n long, mean double").csv(at + "/summary")


def k4_ranked_file(spark: SparkSession, d: str) -> DataFrame:
    at = fresh_dir(spark)
    files.write_ranked_csv(table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("score")), "score", at, "s_suppkey")
    return spark.read.option("header", True).schema("s_suppkey long, score string, rank long").csv(at)


def k6_insert_batch(spark: SparkSession, d: str) -> DataFrame:
    """Rows of three arrays: ids, vectors' first values, payloads."""
    v = table(spark, d, "embeddings").groupBy(F.pmod("vec_id", F.lit(10)).alias("b")).agg(F.collect_list(F.struct("vec_id", F.col("embedding")[0].alias("first"))).alias("x"))
    rows = v.select(F.explode(F.arrays_zip(F.col("x.vec_id").alias("id"), F.col("x.first").alias("first"))).alias("r"))
    return rows.select("r.id", F.round(F.col("r.first").cast("double"), 4).alias("first"))


def k11_history(spark: SparkSession, d: str) -> DataFrame:
    """Changes as a log: an update of each customer who ordered, then the number of entries by kind."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("ADD").alias("event"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n")).select("id", F.when(F.col("n") > 10, "DELETE").otherwise("UPDATE").alias("event"))
    return c.unionByName(o).groupBy("event").agg(F.count("*").alias("n"))


def k13_score_files(spark: SparkSession, d: str) -> DataFrame:
    """Score files of several runs, a folder each, in one table."""
    at = fresh_dir(spark)
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("model"), "o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("score"))
    o.write.partitionBy("model").json(at)
    rows = spark.read.schema("o_orderpriority string, score double, model string").option("basePath", at).json(at)
    return rows.groupBy("model").agg(F.round(F.avg("score"), 2).alias("overall"), F.count("*").alias("parts"))


def k14_hard_delete(spark: SparkSession, d: str) -> DataFrame:
    """What was marked under one record goes for good, with its vectors."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 6 == 0, "r1").alias("record_id"))
    gone = docs.filter("record_id = 'r1'").select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").join(gone, "vec_id", "left_anti").select("vec_id")


def k16_versioned(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    rows, tag = lifecycle.versioned(c, c.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(0.0)), "o_orderkey", 255, "o_orderdate", 100)
    return rows.select("o_orderkey", "o_totalprice", F.lit(tag).alias("version"))


# Streams


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), "event_type")


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).filter("id % 4 = 0").select("stream", "id", F.lit("w1").alias("owner"), "at")


def x1_trimmed(spark: SparkSession, d: str) -> DataFrame:
    return broker.trimmed(_messages(spark, d), 30).select("id")


def x2_batches(spark: SparkSession, d: str) -> DataFrame:
    return broker.batches(_messages(spark, d).drop("event_type"), _pending(spark, d), 10).select("id", "batch")


def x3_claims(spark: SparkSession, d: str) -> DataFrame:
    now = F.to_timestamp(F.lit(_NOW))
    return broker.claimed(_pending(spark, d), now, 20 * 86_400, "w2").select("id", "owner")


def x4_acknowledged(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    left, pending = broker.acknowledged(m, _pending(spark, d), m.filter("id % 8 = 0").select("stream", "id"))
    return left.join(pending.select("id", F.lit(1).alias("p")), "id", "left").agg(F.count("*").alias("messages"), F.count("p").alias("pending"))


def x5_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return broker.dispatched(_messages(spark, d), "stream", "event_type")


def x7_queues(spark: SparkSession, d: str) -> DataFrame:
    return broker.bounded_queues(_messages(spark, d), 20, 1000)[1].select("id")


def x11_tasks(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    log = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), at.alias("queued"), F.when(F.col("value") > 10, at + F.expr("make_interval(0, 0, 0, 0, 0, 0, cast(floor(value) as int))")).alias("started"), F.when(F.col("value") > 30, at + F.expr("make_interval(0, 0, 0, 0, 0, 0, cast(floor(value * 2) as int))")).alias("done"))
    return broker.task_metrics(log)


def x12_mirror(spark: SparkSession, d: str) -> DataFrame:
    """A word index kept up as some texts become shorter: by word, how many documents have it."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), F.array_distinct(X.tokens(F.lower("text"))).alias("w"))
    changed = docs.filter("id % 3 = 0").select("id", F.slice("w", 1, 5).alias("w"))
    each = lambda x: x.select("id", F.explode("w").alias("term"))
    return broker.mirrored(each(docs), each(changed), changed.select("id")).groupBy("term").agg(F.count("*").alias("n")).filter("n > 20")


def x13_dropping(spark: SparkSession, d: str) -> DataFrame:
    """What a queue of 30 a stream has dropped, the oldest."""
    m = _messages(spark, d)
    return m.join(broker.trimmed(m, 30).select("id"), "id", "left_anti").groupBy("stream").agg(F.count("*").alias("dropped"))


# Life-cycle


def d3_near_copies(spark: SparkSession, d: str) -> DataFrame:
    """Of the memories of each task, the earliest stay; one is left out if a similar one (0.75) came before it."""
    m = table(spark, d, "memory_bank").filter("content is not null and task_id is not null").groupBy("memory_id").agg(F.min("task_id").alias("task"), F.min("content").alias("content"))
    return H.first_of_similar(m, "task", "memory_id", "content", 0.75)


def d4_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Near copies out, then short texts, then repeated ones."""
    m = table(spark, d, "memory_bank").filter("content is not null and task_id is not null").groupBy("memory_id").agg(F.min("task_id").alias("task"), F.min("content").alias("content"))
    kept = m.join(H.first_of_similar(m, "task", "memory_id", "content", 0.75), "memory_id", "left_semi").filter(~X.too_short(F.col("content")))
    return kept.withColumn("r", F.row_number().over(Window.partitionBy("content").orderBy("memory_id"))).filter("r = 1").select("memory_id")


def d6_counters(spark: SparkSession, d: str) -> DataFrame:
    """Uses by ids such as "view_7": type, and number within it."""
    used = table(spark, d, "events").select(F.concat_ws("_", "event_type", F.pmod("event_id", F.lit(9)).cast("string")).alias("id"), (F.col("value") > 50).cast("int").alias("ok"))
    kind, number = F.regexp_extract("id", r"^(.*)_(\d+)$", 1), F.regexp_extract("id", r"^(.*)_(\d+)$", 2).cast("int")
    return used.groupBy(kind.alias("kind"), number.alias("number")).agg(F.count("*").alias("used"), F.sum("ok").alias("success"))


def d7_evicted(spark: SparkSession, d: str) -> DataFrame:
    """A short-term queue of 10 a user; what left it is in mid-term sessions of 10, oldest first."""
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").select("event_id", "user_id", F.row_number().over(w.orderBy("ts", "event_id")).alias("r"), F.count("*").over(w).alias("n"))
    return e.filter("r <= n - 10").select("event_id", F.floor((F.col("r") - 1) / 10).cast("int").alias("session"))


def d9_lfu_over_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Of users with more than 60 events, the kind of event that came least often goes."""
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("user_id"))
    return per.withColumn("total", total).filter("total > 60").groupBy("user_id").agg(F.min_by("event_type", F.struct("n", "event_type")).alias("evicted"))


def d10_promoted(spark: SparkSession, d: str) -> DataFrame:
    """Pages not looked at yet, of users whose heat is 150 or more."""
    e = table(spark, d, "events")
    hot = e.groupBy("user_id").agg(lifecycle.heat(F.count_if(F.col("event_type") == "view"), F.count("*"), F.max("value") / 100).alias("heat")).filter("heat >= 90").select("user_id")
    return e.filter("event_type <> 'view'").join(hot, "user_id", "left_semi").select("event_id")


def d13_entities(spark: SparkSession, d: str) -> DataFrame:
    """Sources as entities; spellings that differ in case and spaces only count as one that is known."""
    docs = table(spark, d, "documents").filter("source is not null").select(F.col("source").alias("entity"), F.col("doc_id").alias("id"))
    known = table(spark, d, "mix_targets").select(F.col("source").alias("entity"), F.array(F.lit(-1).cast("long")).alias("ids")).distinct()
    near = docs.select("entity").distinct().join(known.select(F.col("entity").alias("as")), F.lower(F.trim("entity")) == F.col("as"))
    linked = lifecycle.linked_entities(known, docs, near)
    left = lifecycle.unlinked(linked, docs.filter("id % 2 = 0").select("id").unionByName(spark.createDataFrame([(-1,)], "id long")))
    return left.select("entity", F.size("ids").alias("n"))


def d14_monitor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    half = lambda c: e.filter(c).groupBy(F.col("user_id").alias("key")).agg(F.round(F.max("value"), 2).alias("score"))
    return lifecycle.merged_monitor(half("event_id % 2 = 0 and value < 60").withColumn("recorded", F.lit(1)), half("event_id % 5 = 1 and value > 40"), 20, 100)


def d16_bounded_summary(spark: SparkSession, d: str) -> DataFrame:
    """A summary that takes in a text and keeps its last 50 tokens."""
    w = X.tokens(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - 49), F.lit(50)), " ")).alias("h"))


def d17_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tiers by thresholds on the share of a segment's customers with a lower balance."""
    w = Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")
    share = (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.when(share < 1 / 3, "hard").when(share < 2 / 3, "medium").otherwise("easy").alias("tier"))


def d19_key_values(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "signup", "remove").when(F.col("event_type") == "error", "replace").otherwise("add")
    ops = e.select("event_id", F.col("user_id").alias("store"), F.when(F.col("event_id") % 7 == 0, "Bad Key").otherwise(F.concat(F.lit("key_"), F.pmod("event_id", F.lit(3)).cast("string"))).alias("key"), F.col("event_id").alias("pos"), op.alias("op"), F.repeat(F.lit("x"), F.floor("value").cast("int")).alias("value"))
    return lifecycle.key_value_log(ops, X.is_valid_key(F.col("key")), 80).select("event_id", "done")


def m1_math(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(F.log(2.0, p), 6).alias("log2"), F.round(F.sqrt(p), 6).alias("root"), F.round(F.pow("p_size", F.lit(2)), 2).cast("double").alias("square"), F.round(100 * F.col("p_size") / p, 6).alias("pct"), F.abs(F.col("p_size") - 25).alias("distance"))


def m2_units(spark: SparkSession, d: str) -> DataFrame:
    from lodestrand.functions import scores as S

    v = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", *[F.round(S.convert(v, a, b), 6).alias(f"{a}_{b}") for a, b in (("celsius", "fahrenheit"), ("fahrenheit", "celsius"), ("mile", "km"), ("kg", "pound"), ("litre", "gallon"))])


def m11_triggers(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("gap", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6)
    return e.select("event_id", F.coalesce(F.col("gap") >= 43_200, F.lit(True)).alias("due"))


def m12_buckets(spark: SparkSession, d: str) -> DataFrame:
    t = F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").groupBy(F.date_format(F.date_trunc("hour", t), "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"))


def s11_history_store(spark: SparkSession, d: str) -> DataFrame:
    """Histories of users in a store of their own, written in two batches, and read back in order."""
    store = HistoryStore(spark, fresh_dir(spark))
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("memory_id"), F.col("event_id").cast("string").alias("new_memory"), F.upper("event_type").alias("event"), F.col("ts").cast("timestamp").alias("created_at"))
    store.add_history(e.filter("cast(new_memory as int) % 2 = 0"))
    store.add_history(e.filter("cast(new_memory as int) % 2 = 1"))
    return store.history().select("memory_id", "new_memory", "pos")


def s11_last_messages(spark: SparkSession, d: str) -> DataFrame:
    store = HistoryStore(spark, fresh_dir(spark))
    store.save_messages(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("scope"), F.col("event_type").alias("role"), F.col("ts").cast("timestamp").alias("created_at")))
    return store.last_messages(10).select("id")


def k5_report(spark: SparkSession, d: str) -> DataFrame:
    """A report with a row for each category and one over all, as CSV."""
    at = fresh_dir(spark)
    files.save(table(spark, d, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean")).select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), "n", "mean"), at, "csv")
    return files.load(spark, at, "csv", "flag string, n long, mean double")


def m3_exchange(spark: SparkSession, d: str) -> DataFrame:
    from lodestrand.functions import scores as S

    k = F.col("s_suppkey") % 3
    base, target = F.when(k == 0, "USD").when(k == 1, "JPY").otherwise("EUR"), F.when(k == 0, "GBP").when(k == 1, "USD").otherwise("JPY")
    return table(spark, d, "supplier").select("s_suppkey", F.round(S.exchanged(F.col("s_acctbal"), base, target), 6).alias("value"))


def g18_tree_quality(spark: SparkSession, d: str) -> DataFrame:
    from lodestrand.functions import scores as S
    from lodestrand.plans.graph_queries import g17_forest

    return g17_forest(spark, d).select("root", F.round(S.tree_quality(F.col("depth"), F.col("leaves"), F.col("nodes"), F.col("branches"), F.lit(1), F.col("widest")), 6).alias("quality"))


def f37_named_things(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.array_join(F.array_sort(E.named_things(F.col("text"))), "|").alias("names"))


def f38_search_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(E.search_form(F.col("text"))).alias("h"))


def f46_configuration(spark: SparkSession, d: str) -> DataFrame:
    config = {"store": {"kind": "vector", "size": {"dim": 64}}, "key": None, "on": True}
    return spark.createDataFrame(list(E.flattened(config, "app").items()), "name string, value string")


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"(pred|[skxdmgf])\d+_", k)}

_EV = "WITH ev AS (SELECT *, json_extract(props, '$.k')::INTEGER AS k FROM events)"
_N = "count(*) AS n"
_FOREST = GRAPH_SQL["g17_forest"]
_KV = """WITH o AS (SELECT event_id, user_id AS s, CASE WHEN event_id % 7 = 0 THEN 'Bad Key' ELSE 'key_' || event_id % 3 END AS k, CASE event_type WHEN 'signup' THEN 'remove' WHEN 'error' THEN 'replace' ELSE 'add' END AS op, floor(value) <= 80 AND event_id % 7 <> 0 AS fits FROM events),
 p AS (SELECT *, coalesce(last_value(CASE WHEN op = 'add' AND fits THEN 1 WHEN op = 'remove' THEN 0 END IGNORE NULLS) OVER (PARTITION BY s, k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS there FROM o)"""
SQL = {
    "pred2_first_operator": "SELECT event_id FROM events WHERE value >= 10 AND event_type NOT IN ('click', 'view')",
    "pred3_lower_case": "SELECT event_id FROM events WHERE contains(event_type, 'i') AND event_type LIKE '%c%' AND NOT (value >= 20 AND value <= 30 AND value <> 25)",
    "pred4_flat": _EV + " SELECT event_id FROM ev WHERE k IN (1, 2, 3)",
    "pred5_expressions": "SELECT DISTINCT memory_id FROM memory_bank WHERE list_contains(tags, 'ledger') AND usage_count > 3",
    "pred6_overlap": "SELECT DISTINCT memory_id FROM memory_bank WHERE list_has_any(tags, ['ledger', 'retry', 'tools']) AND starts_with(memory_id, 'mem-')",
    "pred7_dates": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01'",
    "pred9_listing_state": "SELECT DISTINCT c_custkey, c_mktsegment FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 WHERE c_acctbal >= 0 AND c_mktsegment ILIKE '%b%' ORDER BY c_custkey LIMIT 40 OFFSET 3",
    "pred10_sorted_listing": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 30",
    "pred12_roles": "WITH r AS (SELECT idx, max(run_ts) AS t, min(messages) AS m FROM inference_records GROUP BY 1), u AS (SELECT idx, t, unnest(range(len(m))) AS pos, m FROM r WHERE t IS NOT NULL) SELECT idx, pos::INTEGER AS pos FROM u WHERE m[pos + 1].role = 'user' AND (contains(m[pos + 1].content, 'ledger') OR contains(m[pos + 1].content, 'agent')) ORDER BY t DESC, idx, pos LIMIT 40",
    "pred13_subset": "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0 ORDER BY 1 LIMIT 50",
    "pred17_fields": "SELECT s_suppkey, s_name FROM supplier",
    "pred18_price_range": "SELECT k AS p_partkey FROM (SELECT unnest(range(-2, 40)) AS k) LEFT JOIN part ON p_partkey = k WHERE coalesce(p_retailprice, 0) BETWEEN 0 AND 930",
    "pred19_changes": "SELECT user_id, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM (SELECT event_id, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM events) WHERE abs(c) >= 60 GROUP BY 1",
    "pred22_owner_status": "SELECT o_orderkey FROM orders WHERE o_custkey < 200 AND o_orderstatus = 'F'",
    "pred23_cube_access": f"SELECT cube, {_N} FROM (SELECT c_custkey, c_nationkey AS cube FROM customer WHERE c_acctbal >= 0 UNION SELECT c_custkey, (c_nationkey + 1) % 25 FROM customer WHERE c_acctbal >= 0 AND c_custkey % 10 = 0) WHERE cube % 5 <> 0 GROUP BY 1",
    "pred24_rounds": "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 3",
    "pred25_where": "SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 7",
    "s1_json_lines": "SELECT event_id, event_type, value FROM events",
    "s2_bad_lines": f"SELECT CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE 'good' END AS kind, {_N} FROM events GROUP BY 1",
    "s3_json_folder": "SELECT event_id, user_id FROM events UNION ALL SELECT r_regionkey, -1 FROM region",
    "s4_path_attributes": f"SELECT CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 10 END AS top_k, {_N} FROM supplier GROUP BY 1",
    "s5_csv_dicts": f"SELECT lower(trim(difficulty, ' ')) AS tier, {_N} FROM difficulty_tiers GROUP BY 1",
    "s6_ciphered": "SELECT s_suppkey, s_name FROM supplier",
    "s7_four_filters": "SELECT doc_id, i AS index FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE lower(trim(lang, ' ')) = 'en' AND lower(trim(source, ' ')) = 'rulebook' AND lower(context_id[1:4]) = 'ctx-' AND n_chars > 100",
    "s8_split_by_source": "SELECT doc_id FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(source, ' ')) ORDER BY doc_id) <= 7",
    "s9_text_and_questions": "SELECT workflow_id, md5(min(query)) AS question FROM workflow_instances WHERE query IS NOT NULL GROUP BY 1 ORDER BY md5('7:' || workflow_id), workflow_id LIMIT 50",
    "s10_log_file": """WITH r AS (SELECT user_id, event_id, event_type, sum((event_type = 'signup')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS o, coalesce(sum((event_type = 'purchase')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM events)
        SELECT user_id, max(CASE WHEN o > c THEN o ELSE 0 END)::BIGINT AS phases, count(*) FILTER (WHERE o > c AND event_type NOT IN ('signup', 'purchase')) AS steps FROM r GROUP BY 1""",
    "s13_loaders": "SELECT kind, n_nationkey::BIGINT AS id, n_name AS name FROM nation, (VALUES ('csv'), ('json'), ('xml'), ('text'), ('html')) t(kind)",
    "k1_append": "SELECT event_id, value FROM events",
    "k2_two_headers": "SELECT n_regionkey || chr(9) || count(*) || chr(9) || min(n_name) AS value FROM nation GROUP BY n_regionkey UNION ALL SELECT chr(9) || 'count' || chr(9) || 'name' UNION ALL SELECT 'region' || chr(9) || 'n' || chr(9) || 'first'",
    "k3_summaries": f"SELECT s_nationkey, {_N}, round(avg(s_acctbal), 4) AS mean FROM supplier GROUP BY 1",
    "k4_ranked_file": "SELECT s_suppkey, coalesce(printf('%.2f', x), 'N/A') AS score, row_number() OVER (ORDER BY x DESC NULLS LAST, s_suppkey) AS rank FROM (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS x FROM supplier)",
    "k6_insert_batch": "SELECT vec_id AS id, round(embedding[1]::DOUBLE, 4) AS first FROM embeddings",
    "k11_history": f"SELECT event, {_N} FROM (SELECT 'ADD' AS event FROM customer UNION ALL SELECT CASE WHEN count(*) > 10 THEN 'DELETE' ELSE 'UPDATE' END FROM orders GROUP BY o_custkey) GROUP BY 1",
    "k13_score_files": "SELECT model, round(avg(s), 2) AS overall, count(*) AS parts FROM (SELECT o_orderstatus AS model, round(avg(o_totalprice), 2) AS s FROM orders GROUP BY o_orderstatus, o_orderpriority) GROUP BY 1",
    "k14_hard_delete": "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 6 = 0)",
    "k16_versioned": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice, 0::INTEGER AS version FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "x1_trimmed": "SELECT event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30",
    "x2_batches": "SELECT event_id AS id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 = 0, ts, event_id) - 1) // 10)::INTEGER AS batch FROM events",
    "x3_claims": "SELECT event_id AS id, 'w2' AS owner FROM events WHERE event_id % 4 = 0 AND epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) > 20 * 86400",
    "x4_acknowledged": "SELECT count(*) AS messages, count(*) FILTER (WHERE event_id % 4 = 0) AS pending FROM events WHERE event_id % 8 <> 0",
    "x5_dispatch": f"SELECT user_id AS stream, event_type, {_N}, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1, 2",
    "x7_queues": "WITH h AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events QUALIFY p <= 20), s AS (SELECT user_id, sum(count(*)) OVER (ORDER BY user_id) - count(*) AS b FROM h GROUP BY 1) SELECT event_id AS id FROM h JOIN s USING (user_id) WHERE b + p <= 1000",
    "x11_tasks": "SELECT event_type AS kind, count(*) FILTER (WHERE value <= 10) AS waiting, count(*) FILTER (WHERE value > 10 AND value <= 30) AS running, count(*) FILTER (WHERE value > 30) AS finished, round(avg(floor(value)) FILTER (WHERE value > 10), 3) AS wait_s, round(avg(floor(value * 2) - floor(value)) FILTER (WHERE value > 30), 3) AS work_s FROM events GROUP BY 1",
    "x12_mirror": "WITH l AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL), o AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM l), f AS (SELECT doc_id, term, min(i) AS i FROM o GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f) SELECT term, count(*) AS n FROM r WHERE doc_id % 3 <> 0 OR r <= 5 GROUP BY 1 HAVING count(*) > 20",
    "x13_dropping": "SELECT user_id AS stream, count(*) - 30 AS dropped FROM events GROUP BY 1 HAVING count(*) > 30",
    "s11_history_store": "SELECT user_id::VARCHAR AS memory_id, event_id::VARCHAR AS new_memory, row_number() OVER (PARTITION BY user_id ORDER BY ts, upper(event_type))::INTEGER AS pos FROM events",
    "s11_last_messages": "SELECT event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10",
    "k5_report": "SELECT coalesce(l_returnflag, 'all') AS flag, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY ROLLUP (l_returnflag)",
    "m3_exchange": "SELECT s_suppkey, round(CASE s_suppkey % 3 WHEN 0 THEN s_acctbal * 0.7::DOUBLE WHEN 1 THEN round(s_acctbal / 110, 2) END, 6) AS value FROM supplier",
    "f37_named_things": r"""WITH t AS (SELECT doc_id, list_distinct(list_transform(list_concat(regexp_extract_all(text, '"([^"]{2,80})"', 1), regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+)', 1)), lambda x: lower(x))) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(list_sort(n), '|') AS names FROM t""",
    "f38_search_form": "SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(lower(coalesce(text, '')), '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> ''), ' ')) AS h FROM documents",
    "g18_tree_quality": "WITH t AS (" + _FOREST + """), q AS (SELECT *, branches::DOUBLE / nodes AS b, leaves::DOUBLE / nodes AS l, depth::DOUBLE / greatest(widest, 1) AS thin FROM t)
        SELECT root, round((0.35 * (least(branches * 3, 15) + CASE WHEN b < 0.2 THEN 25 * b WHEN b <= 0.6 THEN 10 ELSE greatest(5, 22 - 20 * b) END) + 0.25 * (least(leaves * 2, 20) + CASE WHEN l < 0.3 THEN 20 * l WHEN l <= 0.7 THEN 10 ELSE greatest(3, 24 - 20 * l) END)
        + 0.25 * greatest(0, CASE WHEN depth < 3 THEN 3 * depth WHEN depth <= 8 THEN 15 ELSE greatest(5, 27 - 1.5 * depth) END + least(widest * 1.5, 15) - CASE WHEN thin > 3 THEN 2 * (thin - 3) ELSE 0 END) + 1.5)::DOUBLE * CASE WHEN b < 0.1 AND nodes > 5 THEN 0.5 ELSE 1 END, 6) AS quality FROM q""",
    "f46_configuration": "SELECT * FROM (VALUES ('APP_STORE_KIND', 'vector'), ('APP_STORE_SIZE_DIM', '64'), ('APP_KEY', ''), ('APP_ON', 'True')) t(name, value)",
    "d6_counters": "SELECT event_type AS kind, (event_id % 9)::INTEGER AS number, count(*) AS used, sum((value > 50)::INTEGER)::BIGINT AS success FROM events GROUP BY 1, 2",
    "d7_evicted": "SELECT event_id, ((r - 1) // 10)::INTEGER AS session FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= n - 10",
    "d9_lfu_over_capacity": "WITH p AS (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS t FROM events GROUP BY 1, 2) SELECT user_id, event_type AS evicted FROM p WHERE t > 60 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n, event_type) = 1",
    "d10_promoted": "SELECT event_id FROM events WHERE event_type <> 'view' AND user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'view') + count(*) + max(value) / 100 >= 90)",
    "d13_entities": "WITH k AS (SELECT DISTINCT source FROM mix_targets), e AS (SELECT CASE WHEN lower(trim(source, ' ')) IN (SELECT source FROM k) THEN lower(trim(source, ' ')) ELSE source END AS entity, doc_id FROM documents WHERE source IS NOT NULL AND doc_id % 2 <> 0) SELECT entity, count(*)::INTEGER AS n FROM e GROUP BY 1",
    "d14_monitor": """WITH o AS (SELECT user_id AS key, round(max(value), 2) AS s FROM events WHERE event_id % 2 = 0 AND value < 60 GROUP BY 1), n AS (SELECT user_id AS key, round(max(value), 2) AS s FROM events WHERE event_id % 5 = 1 AND value > 40 GROUP BY 1),
        a AS (SELECT n.key, n.s AS score, (1 + (o.key IS NOT NULL)::INTEGER)::INTEGER AS recorded FROM n LEFT JOIN o USING (key)), r AS (SELECT key, 0.0 AS score, 1 AS recorded FROM o WHERE key NOT IN (SELECT key FROM n) ORDER BY s DESC, key LIMIT 20)
        SELECT key, score::DOUBLE AS score, recorded FROM (SELECT * FROM a UNION ALL SELECT * FROM r) ORDER BY score DESC, recorded DESC, key LIMIT 100""",
    "d16_bounded_summary": "SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> '')[-50:], ' ')) AS h FROM documents WHERE text IS NOT NULL",
    "d17_tiers": "SELECT c_custkey, CASE WHEN s < 1.0::DOUBLE / 3 THEN 'hard' WHEN s < 2.0::DOUBLE / 3 THEN 'medium' ELSE 'easy' END AS tier FROM (SELECT c_custkey, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1)::DOUBLE / count(*) OVER (PARTITION BY c_mktsegment) AS s FROM customer)",
    "d19_key_values": _KV + " SELECT event_id, CASE op WHEN 'add' THEN fits AND NOT there WHEN 'replace' THEN there AND fits ELSE there END AS done FROM p",
    "m1_math": "SELECT p_partkey, round(ln(p_retailprice) / ln(2), 6) AS log2, round(sqrt(p_retailprice), 6) AS root, (p_size * p_size)::DOUBLE AS square, round(100 * p_size / p_retailprice, 6) AS pct, abs(p_size - 25)::INTEGER AS distance FROM part",
    "m2_units": "SELECT p_partkey, round(p_size * 9.0::DOUBLE / 5 + 32, 6) AS celsius_fahrenheit, round((p_size - 32) * 5.0::DOUBLE / 9, 6) AS fahrenheit_celsius, round(p_size * 1.609344::DOUBLE, 6) AS mile_km, round(p_size / 0.45359237::DOUBLE, 6) AS kg_pound, round(p_size / 3.785411784::DOUBLE, 6) AS litre_gallon FROM part",
    "m11_triggers": "SELECT event_id, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 >= 43200, true) AS due FROM events",
    "m12_buckets": f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, {_N} FROM events GROUP BY 1",
}
