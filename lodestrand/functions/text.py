"""Scalar functions over texts, tokens and hashes: columns in, columns out, nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, articles that answers are compared without, and what tool arguments are compared without.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ["a", "an", "the"]
ARGUMENT_NOISE = r"[ ,./\-_*^]"


def tokens(c: Column) -> Column:
    """The words of a text between white space; none for null or blank."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def normalize_answer(c: Column) -> Column:
    """Lower case, without ASCII punctuation, without English articles, single spaces, in that order."""
    plain = F.translate(F.lower(c), PUNCTUATION, "")
    return F.array_join(F.filter(tokens(plain), lambda x: ~x.isin(ARTICLES)), " ")


def common_tokens(a: Column, b: Column) -> Column:
    """Number of tokens in common, repeated ones counted as often as both have them."""
    each = F.transform(F.array_distinct(a), lambda t: F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def f1(common: Column, predicted: Column, gold: Column) -> Column:
    """2PR / (P + R) from counts; 0 where nothing is in common."""
    return F.when(common > 0, 2.0 * common / (predicted + gold)).otherwise(0.0)


def token_f1(predicted: Column, gold: Column) -> Column:
    """Token F1 of normalised answers. If one is yes, no or noanswer and the other differs, 0."""
    p, g = normalize_answer(predicted), normalize_answer(gold)
    fixed = ["yes", "no", "noanswer"]
    a, b = tokens(p), tokens(g)
    return F.when((p.isin(fixed) | g.isin(fixed)) & (p != g), 0.0).otherwise(f1(common_tokens(a, b), F.size(a), F.size(b)))


def set_f1(predicted: Column, gold: Column) -> Column:
    """F1 over distinct lower-case tokens."""
    a, b = F.array_distinct(tokens(F.lower(predicted))), F.array_distinct(tokens(F.lower(gold)))
    return f1(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def exact_match(predicted: Column, gold: Column) -> Column:
    return (normalize_answer(predicted) == normalize_answer(gold)).cast("int")


def substring_match(predicted: Column, gold: Column) -> Column:
    """1 if the normalised gold answer lies in the prediction; an empty gold answer always does."""
    return normalize_answer(predicted).contains(normalize_answer(gold)).cast("int")


def parse_output(c: Column, prefix: str = "answer:") -> Column:
    """What follows the prefix on its line, else the first line; trimmed, and without the prefix where it comes again."""
    hit = F.regexp_extract(c, rf"(?i){prefix}([^\n]*)", 1)
    found = F.trim(F.when(c.rlike(rf"(?i){prefix}"), hit).otherwise(F.split(c, "\n")[0]))
    return F.trim(F.regexp_replace(found, rf"(?i)^{prefix}", ""))


def standardize_string(c: Column) -> Column:
    """A tool argument as it is compared: without noise characters, lower case, double quotes."""
    return F.replace(F.lower(F.regexp_replace(c, ARGUMENT_NOISE, "")), F.lit("'"), F.lit('"'))


def truncate_head_tail(c: Column, most: int, marker: str = "\n...\n") -> Column:
    """The text, or its first and last halves of ``most`` characters around a marker."""
    half = most // 2
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(half)), F.lit(marker), F.right(c, F.lit(half))))


def estimate_tokens(c: Column) -> Column:
    """floor(1.5 CJK characters + 1.33 words with a letter and without CJK + 0.5 other characters), at least 1; 0 if empty."""
    cjk = F.char_length(c) - F.char_length(F.regexp_replace(c, "[一-鿿]", ""))
    lettered = F.size(F.filter(F.split(c, r"\s+"), lambda w: w.rlike(r"\p{L}") & ~w.rlike("[一-鿿]")))
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(1.5 * cjk + 1.33 * lettered + 0.5 * (F.char_length(c) - cjk)))).cast("long")


def signature(c: Column) -> Column:
    return F.sha2(F.lower(c), 256)


def name_to_key(c: Column) -> Column:
    """Lower-case key: characters other than word characters, CJK and spaces dropped, spaces to ``_``."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(c, "[^A-Za-z0-9_一-鿿 ]", "")), " +", "_"))


def is_valid_key(c: Column) -> Column:
    """Snake case: lower-case words with digits, joined by single underscores, a letter first."""
    return F.coalesce(c.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), F.lit(False))


def is_english(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[\x00-\x7F]*$"), F.lit(False))


def too_short(c: Column, least: int = 20) -> Column:
    """Fewer than ``least`` words if all is ASCII, else fewer characters; null is too short."""
    return F.coalesce(F.when(is_english(c), F.size(tokens(c)) < least).otherwise(F.char_length(c) < least), F.lit(True))


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def char_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the sets of characters; 0 where either is empty."""
    x, y = F.array_distinct(characters(a)), F.array_distinct(characters(b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(0.0)


def bigrams(c: Column) -> Column:
    n = F.char_length(c)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def last_user_message(messages: Column) -> Column:
    """Content of the last message of the role user."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"]


def trajectory_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), F.coalesce(m["role"], F.lit("")), F.lit("] "), F.coalesce(m["content"], F.lit("")))), "\n")


def rubrics_text(rubrics: Column) -> Column:
    """Numbered lines."""
    return F.array_join(F.transform(rubrics, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x, F.lit("")))), "\n")
