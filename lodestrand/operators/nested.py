"""Deeply nested records as related flat tables, by shared inlining.

The schema graph has an element for every field that holds objects or lists, and an edge for every
pair of parent and child that occurs. An element gets a table of its own if it is the root, repeated
(it occurs as a list or as a keyed object anywhere), shared (it has several parents) or recursive (it
can be reached from itself). Everything else is a singleton and is inlined, as columns, into the table
of its nearest ancestor that has one. Each row carries its key, its parent's table and key, and its
position; ``place`` tells where in the record a shared element was found.

An object with more than ``MAP_KEYS`` different names in all records is no record but a map (of ids, say): its entries are
rows of a table ``<name>_entry``, with the name in ``map_key``. So the schema doesn't grow with the data, and neither does what
the driver learns of it.

The same field may come in several shapes; all are read alike: a list, a JSON text that holds a list or
an object, an object keyed by position ("0", "1", ...), one bare object, or one bare value (position 0).
A null inside a list keeps its position and gives no row. Rows that aren't readable JSON objects, or
that lack the key field, go to the table ``_rejected``; an empty input gives empty tables; records that
arrive again under the same key count once, the line with the lowest number winning.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.session import cut

MAP_KEYS = 500
RESERVED = {"record_key", "key", "parent_table", "parent_key", "pos", "place", "line_no"}
ROW = "tbl string, line_no long, rkey string, key string, parent_table string, parent_key string, pos int, place string, attrs string"


def _decode(value):
    """The value; where it is a text that holds a JSON list or object, what that text holds."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def _occurrences(value) -> list[tuple[int, object]]:
    """Position and content of each occurrence that a field's value holds."""
    value = _decode(value)
    if value is None:
        return []
    if isinstance(value, list):
        return [(i, _decode(x)) for i, x in enumerate(value)]
    if isinstance(value, dict) and value and all(k.isascii() and k.isdigit() for k in value):
        return [(int(k), _decode(x)) for k, x in value.items()]
    return [(0, value)]


def _repeated(value) -> bool:
    value = _decode(value)
    return isinstance(value, list) or (isinstance(value, dict) and bool(value) and all(k.isascii() and k.isdigit() for k in value))


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint" if -(1 << 63) <= value < 1 << 63 else "string"
    return "double" if isinstance(value, float) else "string"


def read_record(raw, envelope: str | None, key_field: str):
    """The record in a raw line, out of its envelope if it has one; None where there is none."""
    if not raw:
        return None
    try:
        record = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    if isinstance(record, dict) and envelope and key_field not in record and isinstance(_decode(record.get(envelope)), dict):
        record = _decode(record[envelope])
    return record if isinstance(record, dict) and record.get(key_field) is not None else None


@dataclass
class Graph:
    """Elements, their parents, and the attributes of each with their types."""

    root: str
    edges: dict[tuple[str, str], bool] = field(default_factory=dict)  # (parent, child) -> repeated there
    attrs: dict[tuple[str, str], str] = field(default_factory=dict)  # (element, attribute) -> type
    maps: frozenset[str] = frozenset()  # elements whose fields are entries of a map

    def parents(self, element: str) -> set[str]:
        return {p for p, c in self.edges if c == element}

    def below(self, element: str) -> set[str]:
        seen: set[str] = set()
        todo = [element]
        while todo:
            for p, c in self.edges:
                if p == todo[-1] and c not in seen:
                    seen.add(c)
                    todo.insert(0, c)
            todo.pop()
        return seen

    def tables(self, keep: frozenset[str] = frozenset()) -> list[str]:
        """Elements with a table of their own, by the rules above; ``keep`` names more."""
        found = [self.root]
        for e in sorted({c for _, c in self.edges}):
            if e == self.root:
                continue
            repeated = any(r for (_, c), r in self.edges.items() if c == e)
            if e in keep or repeated or len(self.parents(e)) > 1 or e in self.below(e):
                found.append(e)
        return found


def _entries(element: str, value: dict) -> dict:
    """A map as an object with one field, the list of its entries; each with its name as ``map_key`` (an entry's own field of that name becomes ``map_key_2``)."""
    out = []
    for name, x in value.items():
        d = _decode(x)
        own = ({"map_key_2" if k == "map_key" else k: v for k, v in d.items()} if isinstance(d, dict) else {"value": x}) if d is not None else {}
        out.append({"map_key": name, **own})
    return {f"{element}_entry": out}


def _walk(element: str, value, seen: dict, maps: frozenset[str] = frozenset()) -> None:
    """Adds what ``value``, an occurrence of ``element``, tells of the graph."""
    if isinstance(value, dict):
        for name, x in (_entries(element, value) if element in maps else value).items():
            d = _decode(x)
            if isinstance(d, (dict, list)):
                seen[element, name, "edge"] = seen.get((element, name, "edge"), False) or _repeated(d)
                for _, y in _occurrences(d):
                    _walk(name, y, seen, maps)
            elif d is not None:
                seen[element, name, _kind(d)] = False
    elif isinstance(value, list):
        seen[element, f"{element}_item", "edge"] = True
        for y in value:
            _walk(f"{element}_item", _decode(y), seen, maps)
    elif value is not None:
        seen[element, "value", _kind(value)] = False


def analyse(df: DataFrame, raw: str = "raw", root: str = "record", key_field: str = "id", envelope: str | None = "record") -> Graph:
    """The schema graph of all rows. Only distinct (parent, child, kind) triples leave the tasks, and the driver gets them when
    no element has more than ``MAP_KEYS`` names: until then it learns which have more, and the rows are read again with these as maps."""
    rows, maps = df.select(F.col(raw).alias("raw")), frozenset()
    while True:

        def part(batches: Iterator[pd.DataFrame], maps: frozenset[str] = maps) -> Iterator[pd.DataFrame]:
            seen: dict = {}
            for b in batches:
                for text in b["raw"]:
                    if (record := read_record(text, envelope, key_field)) is not None:
                        _walk(root, record, seen, maps)
            yield pd.DataFrame([(p, c, k, r) for (p, c, k), r in seen.items()], columns=["p", "c", "k", "r"])

        triples = cut(rows.mapInPandas(part, "p string, c string, k string, r boolean").groupBy("p", "c", "k").agg(F.max("r").alias("r")))
        wide = triples.groupBy("p").agg(F.count_distinct("c").alias("n")).filter(F.col("n") > MAP_KEYS).orderBy(F.desc("n")).limit(1000).collect()
        found = frozenset(r["p"] for r in wide) - maps
        if not found:
            break
        maps |= found
    graph = Graph(root, maps=maps)
    kinds: dict[tuple[str, str], set[str]] = {}
    for p, c, k, r in triples.collect():
        if k == "edge":
            graph.edges[p, c] = bool(r)
        else:
            kinds.setdefault((p, c), set()).add(k)
    elements = {c for _, c in graph.edges}
    for (p, c), ks in kinds.items():
        t = next(iter(ks)) if len(ks) == 1 else "double" if ks == {"bigint", "double"} else "string"
        if c in elements and c != "value" and (p, c) in graph.edges:
            old = graph.attrs.get((c, "value"), t)
            graph.attrs[c, "value"] = t if old == t else "string"
        elif c in elements and c != "value":
            graph.edges[p, c] = False
            old = graph.attrs.get((c, "value"), t)
            graph.attrs[c, "value"] = t if old == t else "string"
        else:
            old = graph.attrs.get((p, c), t)
            graph.attrs[p, c] = t if old == t else "string"
    return graph


def shred(
    df: DataFrame, graph: Graph, raw: str = "raw", line_no: str = "line_no", key_field: str = "id", envelope: str | None = "record", keep: frozenset[str] = frozenset(), only: frozenset[str] | None = None
) -> DataFrame:
    """One row per row of every flat table (or of the tables in ``only``), the columns as a JSON text in ``attrs``."""
    tabled, elements, root = frozenset(graph.tables(keep)), frozenset(c for _, c in graph.edges), graph.root
    wanted = tabled | {"_rejected"} if only is None else only

    def rows(record: dict, n: int) -> Iterator[tuple]:
        rkey = str(record[key_field])
        todo = [(root, record, rkey, None, None, 0, "")]
        while todo:
            element, value, key, ptable, pkey, pos, place = todo.pop()
            attrs: dict = {}

            def inline(e, v, prefix, where, key=key, attrs=attrs, element=element):
                if isinstance(v, list):
                    v = {f"{e}_item": v}
                elif isinstance(v, dict) and e in graph.maps:
                    v = _entries(e, v)
                if not isinstance(v, dict):
                    attrs[f"{prefix}value"] = v
                    return
                for name, x in v.items():
                    if name in elements:
                        if name in tabled:
                            for i, y in _occurrences(x):
                                if y is not None:
                                    at = f"{where}.{name}"
                                    todo.append((name, y, f"{key}/{at[1:]}:{i}", element, key, i, at[1:]))
                        elif (d := _decode(x)) is not None:
                            inline(name, d, f"{prefix}{name}_", f"{where}.{name}")
                    elif x is not None:
                        attrs[f"{prefix}{name}"] = x

            inline(element, value, "", "")
            if element in wanted:
                yield element, n, rkey, key, ptable, pkey, pos, place, json.dumps(attrs, ensure_ascii=False)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["tbl", "line_no", "rkey", "key", "parent_table", "parent_key", "pos", "place", "attrs"]
        for b in batches:
            out: list[tuple] = []
            for text, n in zip(b["raw"], b["line_no"], strict=True):
                record = read_record(text, envelope, key_field)
                if record is not None:
                    out += rows(record, n)
                elif "_rejected" in wanted:
                    out.append(("_rejected", n, None, str(n), None, None, 0, "", json.dumps({"raw": text})))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=cols)
                    out = []
            yield pd.DataFrame(out, columns=cols)

    return df.select(F.col(raw).alias("raw"), F.col(line_no).alias("line_no")).mapInPandas(part, ROW)


def _columns(graph: Graph, element: str, tabled: set[str]) -> list[tuple[str, str]]:
    """Names and types of a table's own columns, inlined descendants included."""
    cols: dict[str, str] = {}

    def add(e: str, prefix: str, path: tuple[str, ...]) -> None:
        for (p, a), t in sorted(graph.attrs.items()):
            if p == e:
                cols.setdefault(f"{prefix}{a}", t)
        for (p, c) in sorted(graph.edges):
            if p == e and c not in tabled and c not in path:
                add(c, f"{prefix}{c}_", (*path, c))

    add(element, "", (element,))
    return list(cols.items())


def _first_lines(rows: DataFrame) -> DataFrame:
    """Keeps, of a record delivered more than once, the rows of its first line."""
    first = rows.groupBy("rkey").agg(F.min("line_no").alias("line_no"))
    return rows.join(first, ["rkey", "line_no"], "left_semi")


def flat_tables(df: DataFrame, graph: Graph | None = None, keep: frozenset[str] = frozenset(), only: frozenset[str] | None = None, **names) -> dict[str, DataFrame]:
    """The flat tables of ``df`` by name. ``keep`` forces a table for singletons; ``only`` limits what is built."""
    graph = graph or analyse(df, **{k: v for k, v in names.items() if k in ("raw", "key_field", "envelope")})
    tabled = set(graph.tables(keep))
    built = tabled if only is None else tabled & only
    all_rows = cut(shred(df, graph, keep=keep, only=frozenset(built | ({"_rejected"} if only is None else set())), **names))
    out = {}
    for name in sorted(built):
        cols = _columns(graph, name, tabled)
        schema = T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in cols])
        part = _first_lines(all_rows.filter(F.col("tbl") == name)).dropDuplicates(["key"])
        parsed = part.withColumn("a", F.from_json("attrs", schema)) if cols else part
        out[name] = parsed.select(
            F.col("rkey").alias("record_key"), "key", "parent_table", "parent_key", "pos", "place", "line_no", *[F.col(f"a.`{c}`").alias(f"attr_{c}" if c in RESERVED else c) for c, _ in cols]
        )
    if only is None:
        out["_rejected"] = all_rows.filter(F.col("tbl") == "_rejected").select("line_no", F.get_json_object("attrs", "$.raw").alias("raw"))
    return out
