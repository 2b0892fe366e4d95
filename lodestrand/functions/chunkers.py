"""Cutting texts by sentences, lines, headers or characters. Greedy rules carry state from part to part, so they run in
Arrow batches. Tokens are words between white space; a null text gives a null, a blank one no chunks."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
_URL = re.compile(r"https?://\S+")
_HEADER = re.compile(r"(#{1,6})\s+(.*)")
#: Where a chunk of characters may end, best first.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " "]


def _listed(cut: Callable[[str], list], kind: str = "string") -> Callable[[Column], Column]:
    def of(text: Column) -> Column:
        @F.pandas_udf(f"array<{kind}>")
        def chunks(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else cut(t))

        return chunks.asNondeterministic()(text)

    return of


def _grouped(parts: list[str], most: int, glue: str, glue_tokens: int) -> list[str]:
    out, held, size = [], [], 0
    for part in parts:
        n = len(part.split())
        if held and size + n > most:
            out.append(glue.join(held))
            held, size = [], 0
        size += n + (glue_tokens if held else 0)
        held.append(part)
    return [*out, glue.join(held)] if held else out


def sentence_chunks(text: Column, most: int, count_separators: bool = False) -> Column:
    """Sentences, joined by spaces while they are ``most`` tokens together; a longer one is a chunk by itself.
    ``count_separators``: each space between two sentences counts as a token, too."""
    return _listed(lambda t: _grouped([s for s in _SENTENCE.split(t.strip()) if s], most, " ", int(count_separators)))(text)


def line_chunks(text: Column, most: int) -> Column:
    """Lines, joined while they are ``most`` tokens together; no line is cut, and nothing is lost."""
    return _listed(lambda t: _grouped(t.split("\n"), most, "\n", 0))(text)


def split_characters(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of ``size`` characters at most that end at a separator, the best kind there is in reach; an address is not
    cut and counts as two characters. The next one starts ``overlap`` characters before the end of the last."""
    kept = _URL.findall(text)
    text, k = _URL.sub("", text), 0
    spans, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            end = next((at + len(s) for s in SEPARATORS if (at := text.rfind(s, start, end)) >= 0), end)
            end += text[end - 1 : end + 1] == ""
        spans.append((start, end))
        if end == len(text):
            break
        start = max(start + 1, end - overlap)
        start += text[start : start + 1] == ""
    before = [0]
    for c in text:
        before.append(before[-1] + (c == ""))
    out = []
    for a, b in spans:
        urls = iter(kept[before[a] : before[b]])
        if chunk := re.sub("", lambda _: next(urls), text[a:b]).strip():
            out.append(chunk)
    return out


def character_chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """See :func:`split_characters`."""
    return _listed(lambda t: split_characters(t, size, overlap))(text)


def split_headers(text: str, size: int) -> list[tuple[str, str]]:
    """Path of headers and text of each section, sections above ``size`` characters cut further.

    If more than 5 headers are there and over 90 % of them, or 5 or fewer and all of them, are of the first level, those after
    the first go one level down.
    """
    lines = text.split("\n")
    levels = [len(m[1]) for m in map(_HEADER.fullmatch, lines) if m]
    top = levels.count(1)
    flat = len(levels) > 1 and (top > 0.9 * len(levels) if len(levels) > 5 else top == len(levels))
    out, path, held, seen = [], {}, [], False

    def close() -> None:
        body = "\n".join(held).strip()
        out.extend((" > ".join(path[k] for k in sorted(path)), x) for x in (split_characters(body, size, 0) if body else []))
        held.clear()

    for line in lines:
        if m := _HEADER.fullmatch(line):
            close()
            level = min(6, len(m[1]) + (flat and seen))
            seen = True
            path = {k: v for k, v in path.items() if k < level} | {level: m[2].strip()}
        else:
            held.append(line)
    close()
    return out


def header_chunks(text: Column, size: int) -> Column:
    """Sections as ``header`` and ``text``, see :func:`split_headers`."""
    return _listed(lambda t: [{"header": h, "text": x} for h, x in split_headers(t, size)], "struct<header:string,text:string>")(text)


def windows(items: list[str], most: int, overlap: int) -> list[list[int]]:
    """Numbers of the items in each window of ``most`` tokens; the next window keeps the last ones, ``overlap`` tokens at most."""
    out, held, size = [], [], 0
    for i, item in enumerate(items):
        n = len((item or "").split())
        if held and size + n > most:
            out.append([k for k, _ in held])
            while held and (size > overlap or size + n > most):
                size -= held.pop(0)[1]
        held.append((i, n))
        size += n
    return [*out, [k for k, _ in held]] if held else out


def item_windows(items: Column, most: int, overlap: int) -> Column:
    """See :func:`windows`; ``items`` is an array of texts."""
    return _listed(lambda x: windows(list(x), most, overlap), "array<int>")(items)


def identified(df: DataFrame, id_: str, chunks: Column, url: Column, least: int = 1) -> DataFrame:
    """A row for each different chunk of at least ``least`` characters of each document: ``id_``, ``chunk_id``, ``chunk``. The id is a digest of chunk and address."""
    rows = df.select(F.col(id_), url.alias("__url"), F.explode(chunks).alias("chunk")).filter(F.char_length("chunk") >= least)
    return rows.select(id_, F.sha2(F.concat("chunk", F.coalesce("__url", F.lit(""))), 256).alias("chunk_id"), "chunk").dropDuplicates([id_, "chunk_id"])
