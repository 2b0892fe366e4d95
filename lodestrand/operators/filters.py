"""Metadata filters as data: nested dictionaries in, one boolean column out.

Operators: eq, ne, gt, gte, lt, lte, in, nin, contains, icontains, and ``*`` (the field is there); a list
means ``in``, a bare value ``eq``; AND, OR and NOT (also ``$and``, ``$or``, ``$not``) combine lists of
filters. Several operators on one field are all required. An unknown operator raises ValueError. A missing
field satisfies no comparison but ``ne`` and ``nin``; an empty filter is true.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "nin": lambda c, v: c.isNull() | ~c.isin(list(v)),
    "contains": lambda c, v: c.contains(v),
    "icontains": lambda c, v: F.lower(c).contains(str(v).lower()),
    "like": lambda c, v: c.like(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
}


def build(filters: dict | None, field: Callable[[str], Column] = F.col) -> Column:
    """The condition of ``filters``; ``field`` gives the column of a key (a payload path, say)."""
    out = F.lit(True)
    for key, want in (filters or {}).items():
        name = key.lstrip("$").upper()
        if name in ("AND", "OR", "NOT") and isinstance(want, list | dict):
            parts = [build(x, field) for x in (want if isinstance(want, list) else [want])]
            if name == "OR":
                cond = F.lit(False)
                for p in parts:
                    cond = cond | p
            else:
                cond = F.lit(True)
                for p in parts:
                    cond = cond & p
                cond = ~cond if name == "NOT" else cond
        elif want == "*":
            cond = field(key).isNotNull()
        elif isinstance(want, list):
            cond = field(key).isin(want)
        elif isinstance(want, dict):
            cond = F.lit(True)
            for op, v in want.items():
                if op.lstrip("$") not in _OPS:
                    raise ValueError(f"unknown filter operator {op!r}")
                cond = cond & _OPS[op.lstrip("$")](field(key), v)
        else:
            cond = field(key) == want
        out = out & F.coalesce(cond, F.lit(False))
    return out


def default_status(c: Column) -> Column:
    """Rows that are activated, or of which nothing is said."""
    return F.coalesce(c, F.lit("activated")) == "activated"


def kept_by_relevance(c: Column, least: float) -> Column:
    """A missing or unreadable relevance counts as 1."""
    return F.coalesce(c.try_cast("double"), F.lit(1.0)) >= least


def accessible(rules: DataFrame, items: DataFrame) -> DataFrame:
    """``reader``, ``id`` of the items (``reader``, ``id``) that each reader may have.

    ``rules`` has ``reader``, ``pos``, ``effect`` ("allow" or "deny") and ``id``, null for all. The first rule in ``pos``
    that is about all decides alone: everything, or nothing. Without one, what is allowed and not denied remains, so
    denials alone leave nothing. A reader without rules may have everything.
    """
    whole = rules.filter(F.col("id").isNull()).groupBy("reader").agg(F.min_by("effect", "pos").alias("whole"))
    kinds = rules.groupBy("reader").agg(F.lit(True).alias("ruled")).join(whole, "reader", "left")
    own = rules.filter(F.col("id").isNotNull()).groupBy("reader", "id").agg(F.bool_and(F.col("effect") == "allow").alias("fine"))
    rows = items.select("reader", "id").distinct().join(kinds, "reader", "left").join(own, ["reader", "id"], "left")
    allowed = F.when(F.col("ruled").isNull(), True).when(F.col("whole").isNotNull(), F.col("whole") == "allow").otherwise(F.coalesce("fine", F.lit(False)))
    return rows.filter(allowed).select("reader", "id")


def first_operator(filters: dict | None) -> dict:
    """The same filters as a store reads them that honours only the first operator of each field."""
    out: dict = {}
    for key, want in (filters or {}).items():
        if key.lstrip("$").upper() in ("AND", "OR", "NOT"):
            out[key] = [first_operator(x) for x in (want if isinstance(want, list) else [want])]
        else:
            out[key] = dict(list(want.items())[:1]) if isinstance(want, dict) else want
    return out


def with_dates(filters: dict) -> dict:
    """Dates without a time in comparisons cover their whole day: ``lt`` and ``lte`` go to its end, ``gt`` and ``gte`` from its start."""
    from datetime import date, datetime, timedelta

    def moved(op: str, v: object) -> object:
        if not isinstance(v, str):
            return v
        try:
            day = date.fromisoformat(v)
        except ValueError:
            return v
        start = datetime(day.year, day.month, day.day)
        return start + timedelta(days=1) if op == "lt" else start + timedelta(days=1, microseconds=-1) if op == "lte" else start

    out: dict = {}
    for key, want in filters.items():
        if isinstance(want, list) and key.lstrip("$").upper() in ("AND", "OR", "NOT"):
            out[key] = [with_dates(x) for x in want]
        else:
            out[key] = {op: moved(op.lstrip("$"), v) for op, v in want.items()} if isinstance(want, dict) else want
    return out


def from_expressions(conditions: list[dict], field: Callable[[str], Column] = F.col) -> Column:
    """A list of ``field``, ``op``, ``value``: =, in, >, >=, <, <=, contains (of a list: it has the value, or for several values any of
    them), starts_with, ends_with; all are required. An unknown op raises ValueError."""
    out = F.lit(True)
    for c in conditions:
        x, op, v = field(c["field"]), c["op"], c["value"]
        if op == "contains":
            cond = F.arrays_overlap(x, F.array(*map(F.lit, v))) if isinstance(v, list) else F.array_contains(x, v)
        else:
            name = {"=": "eq", "in": "in", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "starts_with": "starts_with", "ends_with": "ends_with"}.get(op)
            if name is None:
                raise ValueError(f"unknown filter operator {op!r}")
            cond = _OPS[name](x, v)
        out = out & F.coalesce(cond, F.lit(False))
    return out


def subset(rows: DataFrame, id_: str, wanted: DataFrame | None = None, skipped: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Only the wanted ids, then without the skipped ones, then the first ``limit`` by id."""
    if wanted is not None:
        rows = rows.join(wanted, id_, "left_semi")
    if skipped is not None:
        rows = rows.join(skipped, id_, "left_anti")
    return rows if limit is None else rows.orderBy(id_).limit(limit)


def fields(df: DataFrame, wanted: list[str], allowed: list[str]) -> DataFrame:
    """Only columns that are wanted and allowed; no other name comes through."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in allowed and c in df.columns])
