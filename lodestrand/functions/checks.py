"""Checks of tool calls against what was expected: names, parameters, types and values, and of program states.

Calls, descriptions and answers come as JSON texts; a check gives null if it passes and else the kind of its first
fault. These are small trees of any shape, so the checks run in Arrow batches of Python.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What string arguments are compared without, and the types that the descriptions name.
_NOISE = re.compile(r"[ ,./\-_*^]")
TYPES = {"integer": int, "float": float, "number": float, "string": str, "boolean": bool, "array": list, "tuple": list, "dict": dict, "object": dict, "any": str}


def plain(value: Any) -> Any:
    """A string without noise, in lower case and with double quotes; another value as it is."""
    return _NOISE.sub("", value).lower().replace("'", '"') if isinstance(value, str) else value


def _equal(a: Any, b: Any) -> bool:
    return type(a) is type(b) and a == b or isinstance(a, int | float) and isinstance(b, int | float) and not isinstance(a, bool) and not isinstance(b, bool) and a == b


def _among(value: Any, options: list) -> bool:
    if isinstance(value, list):
        return any(isinstance(o, list) and len(o) == len(value) and all(_equal(plain(v), plain(w)) for v, w in zip(value, o, strict=True)) for o in options)
    return any(_equal(plain(value), plain(o)) for o in options)


def _dict_fault(value: dict, options: list) -> str | None:
    """Against dictionaries of lists of possible values; "" among these lets a key be left out."""
    fault = "value_error:dict"
    for option in options:
        if not isinstance(option, dict):
            continue
        if any(k not in option for k in value) or any(k not in value and "" not in o for k, o in option.items()):
            fault = "value_error:dict_key"
        elif any(not _among(v, option[k]) for k, v in value.items()):
            fault = "value_error:dict_value"
        else:
            return None
    return fault


def _list_of_dicts_fault(value: list, options: list) -> str | None:
    fault = "value_error:list_dict"
    for option in options:
        if not isinstance(option, list) or len(option) != len(value):
            fault = "value_error:list_dict_count"
            continue
        fault = next((f for v, o in zip(value, option, strict=True) if (f := _dict_fault(v, [o]))), None)
        if fault is None:
            return None
    return fault


def value_fault(value: Any, kind: str, options: list, items: str | None = None) -> str | None:
    """The fault of one argument of the type ``kind`` (and of its ``items``), given its possible values."""
    want = TYPES.get(kind, str)
    value = float(value) if want is float and type(value) is int else value
    named = next((o for o in options if o != ""), None)  # a variable's name may stand for a value of any type
    if type(value) is not want:
        if named is None or type(value) is not type(named):
            return "type_error:simple"
        return None if _among(value, options) else "value_error:string"
    if want is list and items and not any(isinstance(o, list) and all(type(v) is TYPES.get(items, str) for v in value) for o in options):
        return "type_error:nested"
    if want is dict:
        return _dict_fault(value, options)
    if want is list and value and all(isinstance(v, dict) for v in value):
        return _list_of_dicts_fault(value, options)
    if _among(value, options):
        return None
    return {str: "value_error:string", list: "value_error:list"}.get(want, "value_error:others")


def call_fault(description: dict, call: dict, answer: dict) -> str | None:
    """The first fault of a call {name: {parameter: value}}; ``answer`` has the possible values of each parameter."""
    name, properties = description["name"], description["parameters"]["properties"]
    if name not in call:
        return "wrong_name"
    given, options = call[name], answer[name]
    if any(p not in given for p in description["parameters"].get("required", [])):
        return "missing_required"
    for p, v in given.items():
        if p not in properties or p not in options:
            return "unexpected_parameter"
        if fault := value_fault(v, properties[p]["type"], options[p], properties[p].get("items", {}).get("type")):
            return fault
    return next(("missing_optional" for p, o in options.items() if p not in given and "" not in o), None)


def _judged(check):
    @F.pandas_udf("string")
    def judge(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for args in zip(a, b, c, strict=True):
            try:
                out.append(check(*[json.loads(x) for x in args]))
            except (TypeError, ValueError, KeyError, AttributeError):
                out.append("unreadable")
        return pd.Series(out, dtype=object)

    return judge


def check_call(description: Column, call: Column, answer: Column) -> Column:
    """Fault of a call, see :func:`call_fault`; "unreadable" for what is no JSON or has another shape."""
    return _judged(call_fault)(description, call, answer)


def check_value(value: Column, kind: Column, options: Column) -> Column:
    """Fault of a value (JSON) of the type ``kind`` (a JSON text), given the possible ones (a JSON list)."""
    return _judged(lambda v, k, o: value_fault(v, k, o))(value, kind, options)


def check_calls(descriptions: Column, calls: Column, answers: Column) -> Column:
    """Calls in any order: as many as answers, and each answer takes the first call left that fits it."""

    def unordered(d: list, given: list, want: list) -> str | None:
        if len(given) != len(want):
            return "wrong_count"
        left, by = list(range(len(given))), {x["name"]: x for x in d}
        for answer in want:
            name = next(iter(answer))
            i = next((i for i in left if name in by and call_fault(by[name], given[i], answer) is None), None)
            if i is None:
                return "no_match"
            left.remove(i)
        return None

    return _judged(unordered)(descriptions, calls, answers)


def state_difference(got: Column, want: Column) -> Column:
    """Names of the public attributes (those without a leading underscore) in which two states (maps) differ, sorted."""
    keys = F.array_distinct(F.concat(F.map_keys(got), F.map_keys(want)))
    return F.array_sort(F.filter(keys, lambda k: ~k.startswith("_") & ~F.try_element_at(got, k).eqNullSafe(F.try_element_at(want, k))))


def answer_found(response: Column, answers: Column) -> Column:
    """Whether any answer lies in the response as whole words; both in lower case and without noise, spaces kept."""
    norm = lambda c: F.replace(F.lower(F.regexp_replace(c, r"[,./\-_*^()]", "")), F.lit("'"), F.lit('"'))
    text = norm(response)
    quoted = lambda a: F.concat(F.lit(r"(?U)\b"), F.regexp_replace(norm(a), r"([\\.\[\]{}()*+?^$|])", r"\\$1"), F.lit(r"\b"))
    return F.coalesce(F.exists(answers, lambda a: F.regexp_like(text, quoted(a))), F.lit(False))



def _is_dangerous(code: str | None) -> bool:
    """By the syntax tree; what can't be parsed is dangerous."""
    import ast

    #: Built-ins and methods that count as dangerous.
    names, methods = {"exec", "eval", "compile", "__import__", "open"}, {"system", "popen", "spawn", "remove", "rmdir"}
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return True
    calls = [n.func for n in ast.walk(tree) if isinstance(n, ast.Call)]
    return any(isinstance(f, ast.Name) and f.id in names or isinstance(f, ast.Attribute) and f.attr in methods for f in calls)


def dangerous_code(code: Column) -> Column:
    """Whether Python code calls what runs code or touches the system; a null is empty code."""

    @F.pandas_udf("boolean")
    def dangerous(texts: pd.Series) -> pd.Series:
        return texts.map(_is_dangerous)

    return dangerous(code)
