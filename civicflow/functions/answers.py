"""Reading lists and objects out of model answers, where brackets must be matched one by one.

A scan over characters has no built-in expression, so these are Arrow-batched UDFs.
"""

from __future__ import annotations

import ast
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from civicflow.functions.batches import by_parts


def balanced_arrays(text: str) -> list[str]:
    """Outermost bracketed stretches, strings respected."""
    found, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"' and depth:
            quoted = True
        elif c == "[":
            start = i if not depth else start
            depth += 1
        elif c == "]" and depth:
            depth -= 1
            if not depth:
                found.append(text[start : i + 1])
    return found


def _list(text: str) -> list | None:
    for form in (text, re.sub(r",\s*([\]}])", r"\1", text)):
        try:
            got = json.loads(form)
        except ValueError:
            continue
        return got if isinstance(got, list) else None
    return None


def last_list(text: str | None) -> list[str] | None:
    """The last non-empty list of an answer, thoughts removed; an empty one if there is no other; else none."""
    clean = re.sub(r"(?s)<think>.*?</think>|^.*</think>", "", text or "").strip()
    whole = _list(clean)
    lists = [whole] if whole is not None else [x for x in map(_list, balanced_arrays(clean)) if x is not None]
    full = [x for x in lists if x]
    found = (full or lists or [None])[-1]
    return None if found is None else [x if isinstance(x, str) else json.dumps(x) for x in found]


def first_list(text: str | None) -> list[str] | None:
    """The first list of an answer, code fences removed and trailing commas forgiven."""
    clean = re.sub(r"```(?:json)?", "", text or "").strip()
    whole = _list(clean)
    found = whole if whole is not None else next((x for x in map(_list, balanced_arrays(clean)) if x is not None), None)
    return None if found is None else [x if isinstance(x, str) else json.dumps(x, sort_keys=True) for x in found]


def loose_list(text: str | None) -> list[str]:
    """A list in JSON, or as Python writes it, or with stray backslashes; else an empty one."""
    for read in (json.loads, ast.literal_eval, lambda t: json.loads(t.replace("\\", "\\\\"))):
        try:
            got = read(text or "")
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
        if isinstance(got, list):
            return [x if isinstance(x, str) else json.dumps(x) for x in got]
        return [got if isinstance(got, str) else json.dumps(got)]
    return []


def _udf(fn):
    return by_parts(lambda texts: pa.array([fn(x) for x in texts.to_pylist()], pa.list_(pa.string())), "array<string>")


def answer_list(c: Column) -> Column:
    return _udf(last_list)(c)


def answer_objects(c: Column) -> Column:
    return _udf(first_list)(c)


def listed(c: Column) -> Column:
    return _udf(loose_list)(c)


def answer_object(c: Column, schema: str) -> Column:
    """The object in an answer, fences removed."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"```(?:json)?", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema)


def first_object(c: Column, schema: str) -> Column:
    """An object, or the first of a list of objects."""
    return F.coalesce(F.get(F.from_json(c, f"array<{schema}>"), 0), F.from_json(c, schema))


def flattened(c: Column, paths: dict[str, tuple[str, ...]]) -> list[Column]:
    """A text column for each path into an answer's object, or into the first object of its list; null where the path leads nowhere.

    All paths are read in one pass. A path that ends where another goes on is an error.
    """
    tree: dict = {}
    for path in paths.values():
        at = tree
        for name in path[:-1]:
            at = at.setdefault(name, {})
            if not isinstance(at, dict):
                raise ValueError(f"{name} in {path} is the end of another path")
        if at.setdefault(path[-1], "string") != "string":
            raise ValueError(f"{path} goes on in another path")

    def typed(node: dict | str) -> str:
        return node if isinstance(node, str) else "struct<" + ", ".join(f"`{k}`: {typed(v)}" for k, v in node.items()) + ">"

    found = first_object(c, typed(tree))
    out = []
    for alias, path in paths.items():
        value = found
        for name in path:
            value = value.getField(name)
        out.append(value.alias(alias))
    return out
