"""Parts and properties of chatty texts: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as X

#: Tags, and the words one of which must occur in a lower-case text.
TAGS = [
    ("search", "search|retrieve|query|find"),
    ("computation", "calculate|compute|count|sum"),
    ("validation", "validate|verify|check"),
    ("error_handling", "error|fallback|handle"),
    ("strategy", "strategy|plan|approach"),
    ("format", "format|output|unit"),
    ("rules", "rule|exception|case"),
]


def tags(c: Column, rules: list[tuple[str, str]] = TAGS) -> Column:
    """Names of the rules whose pattern occurs in the lower-case text, in their order."""
    found = F.array(*[F.when(F.lower(c).rlike(p), F.lit(t)) for t, p in rules])
    return F.filter(found, lambda x: x.isNotNull())


def without_fences(c: Column) -> Column:
    """What stands in the first code block, or the whole text, trimmed."""
    inner = F.regexp_extract(c, r"(?s)```[a-zA-Z]*\n?(.*?)```", 1)
    return F.trim(F.when(c.contains("```"), inner).otherwise(c))


def json_in(c: Column) -> Column:
    """The JSON object or list in a text, from its first brace to the last one; null if that isn't JSON."""
    body = F.regexp_extract(without_fences(c), r"(?s)([\{\[].*[\}\]])", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def list_items(c: Column) -> Column:
    """The different texts after "- " at the start of a line, in order."""
    hits = F.transform(F.filter(F.split(c, "\n"), lambda line: line.startswith("- ")), lambda line: F.trim(F.substring(line, 3, 1_000_000_000)))
    return F.array_distinct(F.filter(hits, lambda x: x != ""))


def between(c: Column, start: str, stop: str) -> Column:
    """What stands between two fixed texts; the whole where these don't occur."""
    hit = F.regexp_extract(c, rf"(?s)\Q{start}\E(.*?)\Q{stop}\E", 1)
    return F.when(c.rlike(rf"(?s)\Q{start}\E.*?\Q{stop}\E"), hit).otherwise(c)


def numbered(lines: DataFrame, new: DataFrame) -> DataFrame:
    """``section``, ``id``, ``content`` of the lines to add: ``new`` has ``section``, ``content`` and ``by``, the order in
    it; ids are the section's first three letters and the next numbers after the highest one in ``lines``."""
    top = lines.agg(F.coalesce(F.max(F.regexp_extract("id", r"(\d+)$", 1).cast("int")), F.lit(0)).alias("top"))
    per = new.groupBy("section").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("section").rowsBetween(Window.unboundedPreceding, -1))  # over sections, which are few
    first = per.select("section", F.coalesce(before, F.lit(0)).alias("before"))
    rows = new.join(first, "section").withColumn("k", F.row_number().over(Window.partitionBy("section").orderBy("by")))
    number = top.scalar() + F.col("before") + F.col("k")
    return rows.select("section", F.format_string("%s-%05d", F.substring("section", 1, 3), number).alias("id"), "content")


def relation_name(c: Column) -> Column:
    """Lower case, all that is neither letter nor digit as single ``_``, none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def line_count(c: Column) -> Column:
    return F.size(F.split(c, "\n"))


def grep(c: Column, needle: str) -> Column:
    """Lines that contain the text."""
    return F.filter(F.split(c, "\n"), lambda line: line.contains(needle))


def differing(a: Column, b: Column) -> Column:
    """Places of the lines that differ, as far as the shorter text goes."""
    x, y = F.split(a, "\n"), F.split(b, "\n")
    n = F.least(F.size(x), F.size(y))
    return F.filter(F.transform(F.slice(x, 1, n), lambda line, i: F.when(line != F.element_at(y, i + 1), i)), lambda i: i.isNotNull())


def is_correct(judgement: Column, score: Column, flag: Column, other: Column) -> Column:
    """The first of these that isn't null decides: the judgement is "correct", the score is above 0, either flag."""
    return F.coalesce(F.lower(F.trim(judgement)) == "correct", score > 0, flag, other, F.lit(False))


def judged_score(raw: Column) -> Column:
    """The score of a judge's JSON if it is 0 or 1 and comes with a rationale, else 0."""
    j = F.from_json(raw, "score int, rationale string")
    return F.when(j["score"].isin(0, 1) & (F.trim(j["rationale"]) != ""), j["score"]).otherwise(0)


def char_tfidf(a: Column, b: Column) -> Column:
    """Cosine of the shares of the characters, those that only one text has weighing 1.5; 0 for an empty text."""
    chars = X.characters(a), X.characters(b)
    share = lambda c, x: F.try_divide(F.size(F.filter(c, lambda y: y == x)).cast("double"), F.size(c))
    both = F.transform(F.array_distinct(F.concat(*chars)), lambda x: F.struct(share(chars[0], x).alias("a"), share(chars[1], x).alias("b")))
    weigh = lambda s, f: s[f] * F.when((s["a"] > 0) & (s["b"] > 0), 1.0).otherwise(1.5)
    total = lambda f, g: F.aggregate(F.transform(both, lambda s: weigh(s, f) * weigh(s, g)), F.lit(0.0), lambda t, x: t + x)
    return F.coalesce(F.try_divide(total("a", "b"), F.sqrt(total("a", "a")) * F.sqrt(total("b", "b"))), F.lit(0.0))


def text_similarity(a: Column, b: Column) -> Column:
    """0.40 Dice of the characters + 0.35 their weighted cosine + 0.25 Jaccard of their pairs."""
    return 0.40 * X.char_dice(a, b) + 0.35 * char_tfidf(a, b) + 0.25 * X.jaccard(X.bigrams(a), X.bigrams(b))


def language(c: Column) -> Column:
    """"zh" if more than 0.3 of the characters, apart from speakers' names, addresses and white space, are CJK, else "en"."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?i)(^|\n)(user|assistant|system|query|answer): ?", " "), r"https?://\S+", " ")
    plain = F.regexp_replace(plain, r"(?U)\s+", "")
    cjk = F.char_length(plain) - F.char_length(F.regexp_replace(plain, "[一-鿿]", ""))
    return F.when(F.coalesce(F.try_divide(cjk.cast("double"), F.char_length(plain)), F.lit(0.0)) > 0.3, "zh").otherwise("en")


def keeps_update(old: Column, new: Column) -> Column:
    """Whether a new wording changes enough but not too much: by the characters in common, against 0.7 or, of a text of 200 estimated tokens or more, 0.2."""
    a, b = F.array_distinct(X.characters(old)), F.array_distinct(X.characters(new))
    change = 1 - F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(1.0))
    return (change != 0) & (change < F.when(X.estimate_tokens(old) < 200, 0.7).otherwise(0.2))


def named_things(c: Column) -> Column:
    """What a text names, by its form alone: texts in double quotes, and two or more capitalised words in a row; each once, in lower case."""
    quoted = F.regexp_extract_all(c, F.lit('"([^"]{2,80})"'), F.lit(1))
    proper = F.regexp_extract_all(c, F.lit(r"(?:^|[^\p{L}\p{N}_])(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+)"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(quoted, proper), lambda x: F.lower(x)))


def search_form(c: Column) -> Column:
    """A text as the word search sees it where no lemmatiser is there: its lower-case words, joined by spaces."""
    return F.array_join(X.tokens(F.lower(c)), " ")


def flattened(config: dict, prefix: str = "") -> dict[str, str]:
    """A nested configuration as PREFIX_A_B: "value"; None is an empty text."""
    out: dict[str, str] = {}
    for key, value in config.items():
        name = f"{prefix}_{key}".strip("_").upper()
        out |= flattened(value, name) if isinstance(value, dict) else {name: "" if value is None else str(value)}
    return out
