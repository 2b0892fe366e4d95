"""Queries of answer scores, call checks, chunkers and text extraction."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import checks as C
from lodestrand.functions import chunkers as K
from lodestrand.functions import extraction as E
from lodestrand.functions import metrics as M
from lodestrand.functions import text as X
from lodestrand.plans.text_queries import _COMMON, _FLOWS, _flows, _norm, _tok
from lodestrand.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", "text", "source")


def _golds() -> Column:
    return F.split("gold", " -> ")


# Scores


def f2_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    a, b = X.tokens(X.normalize_answer(F.col("pred"))), X.tokens(X.normalize_answer(F.col("gold")))
    k = X.common_tokens(a, b).cast("double")
    ratio = lambda n: F.round(F.coalesce(F.try_divide(k, n), F.lit(0.0)), 6)
    return _flows(spark, d).select("workflow_id", ratio(F.size(a)).alias("precision"), ratio(F.size(b)).alias("recall"))


def f7_raw_or_parsed(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat(F.lit("Well.\nAnswer: "), F.col("pred"))
    return _flows(spark, d).select("workflow_id", M.best_of(X.exact_match, p, X.parse_output(p), F.col("pred")).alias("em"))


def f8_event_recall(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d).select("workflow_id", M.event_recall(F.col("pred"), _golds()).alias("recall"))


def f9_fractional_recall(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d).select("workflow_id", F.round(M.fractional_recall(F.col("pred"), _golds()), 6).alias("recall"))


def f10_choice(spark: SparkSession, d: str) -> DataFrame:
    answer = F.element_at(_golds(), 1)
    return _flows(spark, d).select("workflow_id", M.choice_match(F.col("pred"), F.lit("A"), answer).alias("match"))


def f11_rouge(spark: SparkSession, d: str) -> DataFrame:
    s = M.rouge(F.col("pred"), F.col("gold"))
    rows = _flows(spark, d).select("workflow_id", s.alias("s"))
    return rows.select("workflow_id", F.round("s.r1", 6).alias("r1"), F.round("s.r2", 6).alias("r2"), F.round("s.rl", 6).alias("rl"))


def f11_rouge_1(spark: SparkSession, d: str) -> DataFrame:
    return f11_rouge(spark, d).select("workflow_id", "r1")


def f12_bleu(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d).select("workflow_id", *[F.round(M.bleu(F.col("pred"), F.col("gold"), n), 6).alias(f"bleu{n}") for n in (1, 2, 3, 4)])


def f12_bleu_1(spark: SparkSession, d: str) -> DataFrame:
    return f12_bleu(spark, d).select("workflow_id", "bleu1")


def f15_answer_found(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d).select("workflow_id", C.answer_found(F.col("query"), F.array(F.lit("ledger"), F.lit("How should"))).alias("found"))


def a37_gated_f1(spark: SparkSession, d: str) -> DataFrame:
    s = _records(spark, d)
    n, yes = F.size("r"), F.size(F.filter("r", lambda x: x == "yes"))
    p, fluent = F.coalesce(F.try_divide(yes.cast("double"), n), F.lit(0.0)), F.coalesce("score", F.lit(0)).cast("double")
    return s.groupBy("category").agg(F.round(F.avg(M.gated_f1(fluent, p, F.lit(0.5))), 6).alias("f1"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "inference_records").groupBy("idx").agg(F.max(F.struct("ingested_at", F.col("metadata.context_category").alias("category"), "score", F.coalesce("requirement_status", F.array().cast("array<string>")).alias("r"))).alias("x"))
    return r.select("idx", "x.category", "x.score", "x.r")


# Checks


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls made from events, each with one fault or none by its number."""
    k = F.get_json_object("props", "$.k").cast("int")
    u, v, kind = F.col("user_id").cast("string"), F.floor("value").cast("string"), F.col("event_id") % 8
    name = F.when(kind == 1, "other").otherwise("record")
    who = F.when(kind == 2, "").otherwise(F.concat(F.lit('"user": '), F.when(kind == 3, F.concat(F.lit('"'), u, F.lit('"'))).otherwise(u), F.lit(", ")))
    kinds = F.when(kind == 4, F.lit('"nothing"')).otherwise(F.concat(F.lit('" '), F.upper("event_type"), F.lit('."')))
    rest = F.when(kind == 5, ', "more": 1').when(kind == 6, "").otherwise(F.concat(F.lit(', "value": '), v))
    call = F.concat(F.lit('{"'), name, F.lit('": {'), who, F.lit('"type": '), kinds, rest, F.lit("}}"))
    answer = F.concat(F.lit('{"record": {"user": ['), u, F.lit('], "type": ["'), F.col("event_type"), F.lit('"], "value": ['), v, F.lit("]}}"))
    return table(spark, d, "events").select("event_id", call.alias("call"), answer.alias("answer"), k.alias("k"), "event_type", "user_id")


_RECORD = json.dumps({"name": "record", "parameters": {"properties": {"user": {"type": "integer"}, "type": {"type": "string"}, "value": {"type": "float"}}, "required": ["user"]}})


def f17_call_check(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).select("event_id", F.coalesce(C.check_call(F.lit(_RECORD), F.col("call"), F.col("answer")), F.lit("none")).alias("fault"))


def u9_calls_in_any_order(spark: SparkSession, d: str) -> DataFrame:
    """The calls of each user and the answers in the opposite order."""
    rows = _calls(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "call", "answer"))).alias("x"))
    listed = lambda f, x: F.concat(F.lit("["), F.array_join(F.transform(x, lambda y: y[f]), ","), F.lit("]"))
    few = F.filter("x", lambda y: (y["event_id"] % 8 == 0) | (y["event_id"] % 64 == 1))
    fault = C.check_calls(F.lit(f"[{_RECORD}]"), listed("call", few), listed("answer", F.reverse(few)))
    return rows.select("user_id", F.coalesce(fault, F.lit("none")).alias("fault"))


def f16_value_check(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    value = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["a, b", '), F.col("user_id").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit("}")))
    kind = F.when(F.col("event_id") % 2 == 0, '"array"').otherwise('"dict"')
    options = F.when(F.col("event_id") % 2 == 0, F.lit('[["AB", 7], ["ab", 8]]')).otherwise('[{"k": [1, 2, 3], "other": ["", 4]}]')
    return e.select("event_id", F.coalesce(C.check_value(value, kind, options), F.lit("none")).alias("fault"))


def f18_state_difference(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    state = lambda seg, nation: F.create_map(F.lit("segment"), seg, F.lit("nation"), nation.cast("string"), F.lit("_seen"), F.col("c_name"))
    other = state(F.when(F.col("c_custkey") % 3 == 0, "OTHER").otherwise(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 4 == 0, -1).otherwise(F.col("c_nationkey")))
    other = F.map_concat(F.map_filter(other, lambda k, _: k != "_seen"), F.when(F.col("c_custkey") % 5 == 0, F.create_map(F.lit("extra"), F.lit("x"))).otherwise(F.map_filter(other, lambda k, _: k == "")))
    return c.select("c_custkey", F.array_join(C.state_difference(state(F.col("c_mktsegment"), F.col("c_nationkey")), other), ",").alias("differ"))


def pred16_dangerous_code(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 5
    code = F.when(kind == 0, "x = [1, 2]\nprint(x)").when(kind == 1, "import os\nos.system('ls')").when(kind == 2, "eval ( '1' )").when(kind == 3, "def f(:").otherwise("# eval('1')\nname = 'os.remove'")
    return table(spark, d, "events").select("event_id", C.dangerous_code(code).alias("dangerous"))


# Chunks: what they put together again must be the text


def f19_sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c")
    rows = _docs(spark, d).select("doc_id", K.sentence_chunks(F.col("text"), 64).alias("c"))
    return rows.select("doc_id", F.md5(F.regexp_replace(F.array_join(c, " "), r"(?U)\s+", "")).alias("h"), F.forall(c, lambda x: (F.size(X.tokens(x)) <= 64) | ~x.rlike(r"[.!?。！？]\s+\S")).alias("fits"))


def f20_sentence_chunks_counted(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", K.sentence_chunks(F.col("text"), 64, True).alias("c"))
    return rows.select("doc_id", F.md5(F.regexp_replace(F.array_join("c", " "), r"(?U)\s+", "")).alias("h"))


def f21_character_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", "text", K.character_chunks(F.col("text"), 300).alias("c"), K.character_chunks(F.col("text"), 300, 40).alias("o"))
    inside = F.forall("o", lambda x: F.col("text").contains(x))
    return rows.select("doc_id", F.md5(F.regexp_replace(F.array_join("c", ""), r"(?U)\s+", "")).alias("h"), inside.alias("inside"))


def f22_header_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).filter("text not like '%#%'").select("doc_id", K.header_chunks(F.concat(F.lit("# A\n## B\n"), "text"), 400).alias("c"))
    return rows.select("doc_id", F.md5(F.regexp_replace(F.array_join(F.transform("c", lambda x: x["text"]), ""), r"(?U)\s+", "")).alias("h"), F.coalesce(F.array_max(F.transform("c", lambda x: x["header"])), F.lit("A > B")).alias("header"))


def f23_line_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", K.line_chunks(F.col("text"), 50).alias("c"))
    return rows.select("doc_id", F.md5(F.array_join("c", "\n")).alias("h"), F.forall("c", lambda x: (F.size(X.tokens(x)) <= 50) | ~x.contains("\n")).alias("fits"))


def f24_item_windows(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "inference_records").filter("messages is not null").groupBy("idx").agg(F.min(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit("")))).alias("m"))
    rows = r.select("idx", "m", K.item_windows(F.col("m"), 400, 100).alias("w"))
    fits = F.forall("w", lambda x: (F.size(x) == 1) | (F.aggregate(F.transform(x, lambda i: F.size(X.tokens(F.element_at("m", i + 1)))), F.lit(0), lambda s, n: s + n) <= 400))
    return rows.select("idx", F.size(F.array_distinct(F.flatten("w"))).cast("long").alias("items"), fits.alias("fits"))


def f25_identified_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = K.identified(_docs(spark, d), "doc_id", F.split("text", "\n"), F.col("source"), 20)
    return rows.select("doc_id", "chunk_id")


def w10_token_packing(spark: SparkSession, d: str) -> DataFrame:
    """Lines into bins by a running sum that starts anew: number of bins, and of tokens in them."""
    rows = _docs(spark, d).select("doc_id", K.line_chunks(F.col("text"), 50).alias("c"))
    return rows.select("doc_id", F.aggregate("c", F.lit(0), lambda s, x: s + F.size(X.tokens(x))).cast("long").alias("tokens"))


# Extraction


def f29_tags(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(E.tags(F.col("text")), ",").alias("tags"))


def f32_json_in_chat(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "events").select("event_id", F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone.")).alias("t"))
    return raw.select("event_id", F.get_json_object(E.json_in(F.col("t")), "$.k").cast("int").alias("k"))


def f33_list_items(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(E.list_items(F.col("text")), "|").alias("items"))


def f35_templated_query(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("Now answer.\nQuestion: "), F.col("query"), F.lit("\nAnswer:"))
    return _flows(spark, d).select("workflow_id", E.between(F.when(F.col("query").contains("?"), t).otherwise(F.col("query")), "Question: ", "\nAnswer:").alias("query"))


def f36_playbook(spark: SparkSession, d: str) -> DataFrame:
    """New lines of a playbook get the next numbers after the highest there is, by section."""
    m = table(spark, d, "memory_bank").filter("type is not null and content is not null").groupBy("memory_id").agg(F.min("type").alias("section"), F.min("content").alias("content"), F.min("usage_count").alias("usage"))
    old, new = F.coalesce(F.col("usage") > 10, F.lit(False)), F.coalesce(F.col("usage") <= 10, F.lit(True))
    lines = m.filter(old).select("section", F.format_string("%s-%05d", F.substring("section", 1, 3), F.col("usage")).alias("id"), "content")
    return E.numbered(lines, m.filter(new).select("section", "content", F.col("memory_id").alias("by")))


def f39_relations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", E.relation_name(F.concat_ws(" / ", "p_type", "p_brand")).alias("relation"))


def f40_files(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).select("doc_id", E.line_count(t).alias("lines"), F.size(X.tokens(t)).alias("words"), F.char_length(t).alias("chars"), F.size(E.grep(t, "agent")).alias("hits"), F.size(E.differing(t, F.upper(t))).alias("differ"))


def f43_correctness(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 4
    judged = E.is_correct(F.when(kind == 0, F.when(F.col("value") > 50, "Correct").otherwise("incorrect")), F.when(kind == 1, F.col("value") - 50), F.when(kind == 2, F.col("value") > 50), F.when(F.col("event_id") % 8 == 3, F.lit(True)))
    return table(spark, d, "events").select("event_id", judged.alias("correct"))


def f45_judgements(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 5
    raw = F.when(kind == 0, '{"score": 1, "rationale": "good"}').when(kind == 1, '{"score": 2, "rationale": "x"}').when(kind == 2, '{"score": 1, "rationale": " "}').when(kind == 3, "score: 1").otherwise('{"score": 0, "rationale": "bad"}')
    return table(spark, d, "events").select("event_id", E.judged_score(raw).alias("score"))


def f47_tfidf(spark: SparkSession, d: str) -> DataFrame:
    rows = _flows(spark, d).filter("pred is not null and gold is not null")
    return rows.select("workflow_id", F.round(E.char_tfidf(F.col("pred"), F.col("gold")), 5).alias("tfidf"))


def f48_highly_similar(spark: SparkSession, d: str) -> DataFrame:
    rows = _flows(spark, d).filter("pred is not null and gold is not null")
    return rows.select("workflow_id", E.text_similarity(F.col("pred"), F.col("gold")).between(0.8, 2.0).alias("alike"))


def f49_language(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", E.language(F.col("text")).alias("lang"))


def u8_keep_update(spark: SparkSession, d: str) -> DataFrame:
    rows = _flows(spark, d).filter("pred is not null and gold is not null and pred <> '' and gold <> ''")
    return rows.select("workflow_id", E.keeps_update(F.col("pred"), F.col("gold")).alias("kept"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[0] in "fauwp" and any(c.isdigit() for c in k.split("_")[0]) and not k.startswith("_")}

_S = r"regexp_replace({}, '[\s\x0B\x1C-\x1F\x85   -     　]+', '', 'g')".replace(r"\u", "\\u")
for _c in ("00A0", "1680", "2000", "200A", "2028", "2029", "202F", "205F", "3000"):
    _S = _S.replace("\\u" + _c, chr(int(_c, 16)))
_TEXT = "FROM documents WHERE text IS NOT NULL"
_EM = f"WITH {_FLOWS}"
_W = "list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda w: w)"
SQL = {
    "f2_precision_recall": f"""WITH {_FLOWS}, n AS (SELECT workflow_id, {_norm("coalesce(pred, '')")} AS p, {_norm("coalesce(gold, '')")} AS g FROM flows), t AS (SELECT workflow_id, {_tok('p')} AS a, {_tok('g')} AS b FROM n), c AS (SELECT *, {_COMMON} AS k FROM t)
        SELECT workflow_id, round(coalesce(k::DOUBLE / nullif(len(a), 0), 0), 6) AS precision, round(coalesce(k::DOUBLE / nullif(len(b), 0), 0), 6) AS recall FROM c""",
    "f7_raw_or_parsed": f"{_EM} SELECT workflow_id, (pred IS NOT NULL)::INTEGER AS em FROM flows",
    "f8_event_recall": f"{_EM} SELECT workflow_id, coalesce(len(list_filter(string_split(gold, ' -> '), lambda g: NOT contains(lower(pred), lower(g)))) = 0 AND pred IS NOT NULL, false)::INTEGER AS recall FROM flows",
    "f9_fractional_recall": f"{_EM} SELECT workflow_id, round(coalesce(len(list_filter(string_split(gold, ' -> '), lambda g: coalesce(contains(lower(pred), lower(g)), false)))::DOUBLE / len(string_split(gold, ' -> ')), 0), 6) AS recall FROM flows",
    "f10_choice": f"""{_EM} SELECT workflow_id, greatest(coalesce(({_norm('pred')} = '')::INTEGER * 0 + ({_norm('pred')} = {_norm("'A'")})::INTEGER, 0), coalesce(contains(pred, string_split(gold, ' -> ')[1]), false)::INTEGER)::INTEGER AS match FROM flows""",
    "f11_rouge_1": f"""{_EM}, t AS (SELECT workflow_id, {_W.format('pred')} AS a, {_W.format('gold')} AS b FROM flows), c AS (SELECT *, {_COMMON} AS k FROM t)
        SELECT workflow_id, round(CASE WHEN k > 0 THEN 2.0::DOUBLE * k / (len(a) + len(b)) ELSE 0 END, 6) AS r1 FROM c""",
    "f12_bleu_1": f"""{_EM}, t AS (SELECT workflow_id, {_tok('lower(pred)')} AS a, {_tok('lower(gold)')} AS b FROM flows), c AS (SELECT *, {_COMMON} AS k FROM t)
        SELECT workflow_id, round(CASE WHEN k > 0 THEN least(1.0, exp(1 - len(b)::DOUBLE / len(a))) * k / len(a) ELSE 0 END::DOUBLE, 6) AS bleu1 FROM c""",
    "f15_answer_found": f"""{_EM}, n AS (SELECT workflow_id, replace(lower(regexp_replace(query, '[,./\\-_*^()]', '', 'g')), chr(39), '"') AS q FROM flows)
        SELECT workflow_id, coalesce(regexp_matches(q, '(^|[^\\p{{L}}\\p{{N}}_])(ledger|how should)($|[^\\p{{L}}\\p{{N}}_])'), false) AS found FROM n""",
    "a37_gated_f1": """WITH r AS (SELECT * FROM (SELECT idx, metadata.context_category AS category, score, coalesce(requirement_status, []) AS r, row_number() OVER (PARTITION BY idx ORDER BY ingested_at DESC) AS n FROM inference_records) WHERE n = 1),
        p AS (SELECT category, coalesce(score, 0) AS s, coalesce(len(list_filter(r, lambda x: x = 'yes'))::DOUBLE / nullif(len(r), 0), 0) AS p FROM r) SELECT category, round(avg(s * p / (p + 0.5)), 6) AS f1 FROM p GROUP BY 1""",
    "f17_call_check": """SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'wrong_name' WHEN 2 THEN 'missing_required' WHEN 3 THEN 'type_error:simple' WHEN 4 THEN 'value_error:string' WHEN 5 THEN 'unexpected_parameter' WHEN 6 THEN 'missing_optional' ELSE 'none' END AS fault FROM events""",
    "u9_calls_in_any_order": "SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_id % 64 = 1) > 0 THEN 'no_match' ELSE 'none' END AS fault FROM events GROUP BY 1",
    "f16_value_check": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN user_id IN (7, 8) THEN 'none' ELSE 'value_error:list' END WHEN json_extract(props, '$.k')::INTEGER IN (1, 2, 3) THEN 'none' ELSE 'value_error:dict_value' END AS fault FROM events""",
    "f18_state_difference": """SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'extra' END, CASE WHEN c_custkey % 4 = 0 THEN 'nation' END, CASE WHEN c_custkey % 3 = 0 THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS differ FROM customer""",
    "pred16_dangerous_code": "SELECT event_id, event_id % 5 IN (1, 2, 3) AS dangerous FROM events",
    "f19_sentence_chunks": f"SELECT doc_id, md5({_S.format('text')}) AS h, true AS fits {_TEXT}",
    "f20_sentence_chunks_counted": f"SELECT doc_id, md5({_S.format('text')}) AS h {_TEXT}",
    "f21_character_chunks": f"SELECT doc_id, md5({_S.format('text')}) AS h, true AS inside {_TEXT}",
    "f22_header_chunks": f"SELECT doc_id, md5({_S.format('text')}) AS h, 'A > B' AS header {_TEXT} AND NOT contains(text, '#')",
    "f23_line_chunks": f"SELECT doc_id, md5(text) AS h, true AS fits {_TEXT}",
    "f24_item_windows": "SELECT idx, len(min(messages))::BIGINT AS items, true AS fits FROM inference_records WHERE messages IS NOT NULL GROUP BY 1",
    "f25_identified_chunks": f"SELECT DISTINCT doc_id, sha256(c || coalesce(source, '')) AS chunk_id FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS c {_TEXT}) WHERE length(c) >= 20",
    "w10_token_packing": f"SELECT doc_id, len({_tok('text')})::BIGINT AS tokens {_TEXT}".replace(r"'\s+'", r"'[\t\n\x0B\f\r ]+'"),
    "f29_tags": f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(text), {chr(39)}{p}{chr(39)}) THEN {chr(39)}{t}{chr(39)} END' for t, p in E.TAGS)}], lambda x: x IS NOT NULL), ',') AS tags {_TEXT}",
    "f32_json_in_chat": "SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events",
    "f33_list_items": f"""WITH l AS (SELECT doc_id, i, trim(regexp_extract(l, '^- (.*)$', 1), ' ') AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i {_TEXT}) WHERE starts_with(l, '- ')),
        u AS (SELECT doc_id, x, min(i) AS i FROM l WHERE x <> '' GROUP BY 1, 2), g AS (SELECT doc_id, string_agg(x, '|' ORDER BY i) AS items FROM u GROUP BY 1) SELECT doc_id, coalesce(items, '') AS items FROM documents LEFT JOIN g USING (doc_id) WHERE text IS NOT NULL""",
    "f35_templated_query": f"{_EM} SELECT workflow_id, query FROM flows",
    "f36_playbook": """WITH m AS (SELECT memory_id, min(type) AS section, min(content) AS content, min(usage_count) AS usage FROM memory_bank WHERE type IS NOT NULL AND content IS NOT NULL GROUP BY 1), top AS (SELECT max(usage) AS n FROM m WHERE usage > 10)
        SELECT section, printf('%s-%05d', section[1:3], coalesce((SELECT n FROM top), 0) + row_number() OVER (ORDER BY section, memory_id)) AS id, content FROM m WHERE coalesce(usage <= 10, true)""",
    "f39_relations": "SELECT p_partkey, lower(trim(regexp_replace(p_type || ' / ' || p_brand, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS relation FROM part",
    "f40_files": f"""SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS lines, len({_tok('text')})::INTEGER AS words, length(text)::INTEGER AS chars, len(list_filter(string_split(text, chr(10)), lambda l: contains(l, 'agent')))::INTEGER AS hits, len(list_filter(string_split(text, chr(10)), lambda l: upper(l) <> l))::INTEGER AS differ {_TEXT}""".replace(r"'\s+'", r"'[\t\n\x0B\f\r ]+'"),
    "f43_correctness": "SELECT event_id, CASE event_id % 4 WHEN 3 THEN event_id % 8 = 3 ELSE value > 50 END AS correct FROM events",
    "f45_judgements": "SELECT event_id, (event_id % 5 = 0)::INTEGER AS score FROM events",
    "f47_tfidf": f"""{_EM}, t AS (SELECT workflow_id, pred, gold, unnest(list_distinct(string_split(pred || gold, ''))) AS c FROM flows WHERE pred IS NOT NULL AND gold IS NOT NULL),
        f AS (SELECT workflow_id, (length(pred) - length(replace(pred, c, '')))::DOUBLE / nullif(length(pred), 0) AS a, (length(gold) - length(replace(gold, c, '')))::DOUBLE / nullif(length(gold), 0) AS b FROM t WHERE c <> ''), w AS (SELECT workflow_id, a * CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE 1.5 END AS a, b * CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE 1.5 END AS b FROM f)
        SELECT f0.workflow_id, round(coalesce(s, 0), 5) AS tfidf FROM flows f0 LEFT JOIN (SELECT workflow_id, sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0) AS s FROM w GROUP BY 1) USING (workflow_id) WHERE pred IS NOT NULL AND gold IS NOT NULL""",
    "f49_language": rf"""WITH p AS (SELECT doc_id, {_S.format(r"regexp_replace(regexp_replace(text, '(?i)(^|\n)(user|assistant|system|query|answer): ?', ' ', 'g'), 'https?://\S+', ' ', 'g')")} AS t {_TEXT})
        SELECT doc_id, CASE WHEN length(t) > 0 AND (length(t) - length(regexp_replace(t, '[一-鿿]', '', 'g')))::DOUBLE / length(t) > 0.3 THEN 'zh' ELSE 'en' END AS lang FROM p""",
    "u8_keep_update": f"""{_EM}, t AS (SELECT workflow_id, list_distinct(string_split(pred, '')) AS a, list_distinct(string_split(gold, '')) AS b, pred FROM flows WHERE pred <> '' AND gold <> ''),
        s AS (SELECT workflow_id, 1 - len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS c, greatest(1, floor(1.33::DOUBLE * len(list_filter({_tok('pred')}, lambda w: regexp_matches(w, '\\p{{L}}'))) + 0.5::DOUBLE * length(pred))) AS n FROM t)
        SELECT workflow_id, c <> 0 AND c < CASE WHEN n < 200 THEN 0.7 ELSE 0.2 END AS kept FROM s""",
}
