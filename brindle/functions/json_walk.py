"""Walking JSON of unknown shape: table functions for its leaves and for all its entries, called LATERAL.

They are Python, for what needs the order of a document, which a VARIANT, whose keys are sorted, has lost, or unbounded depth.
Profiles of keys need neither: see json_variant.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def leaves(value: object, max_depth: int = 8) -> Iterator[tuple[str, int, object]]:
    """(path, depth, leaf): 'a.b[].c'; of a list the first element; an empty list is a null leaf, an empty object nothing."""
    stack = [("", 0, value)]
    while stack:
        path, depth, v = stack.pop()
        if isinstance(v, dict) and depth < max_depth:
            stack.extend((f"{path}.{k}" if path else str(k), depth + 1, x) for k, x in reversed(v.items()))
        elif isinstance(v, list) and depth < max_depth:
            stack.append((f"{path}[]", depth + 1, v[0] if v else None))
        elif path:
            yield path, depth, v


class _Flatten:
    def eval(self, text: str):
        if text is None:
            return
        try:
            value = json.loads(text.lstrip("﻿"))
        except ValueError:
            return
        for n, rec in enumerate(value if isinstance(value, list) else [value]):
            if isinstance(rec, dict):
                # a path that comes twice keeps its last value
                found = {p: (d, v) for p, d, v in leaves(rec)}
                for k, (p, (d, v)) in enumerate(found.items()):
                    yield n, p, d, k, type(v).__name__, None if v is None else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list, bool)) else str(v)


class _Entries:
    def eval(self, text: str):
        if text is None:
            return
        try:
            value = json.loads(text.lstrip("\ufeff"))
        except ValueError:
            return
        for n, rec in enumerate(value if isinstance(value, list) else [value]):
            if not isinstance(rec, (dict, list)):
                continue
            at, todo = 0, deque([("", rec)])
            while todo:
                path, v = todo.popleft()
                for k, x in v.items() if isinstance(v, dict) else ((None, x) for x in v):
                    inner = path if k is None else f"{path}.{k}" if path else str(k)
                    if k is not None:
                        yield n, inner, at, type(x).__name__, x if isinstance(x, str) else None if x is None else json.dumps(x, ensure_ascii=False)
                        at += 1
                    if isinstance(x, (dict, list)):
                        todo.append((inner, x))


def register(spark: SparkSession) -> None:
    """For LATERAL joins in SQL: flatten_json(text) -> (record, path, depth, ord, type, value), the leaves;
    json_entries(text) -> (record, path, ord, type, value), every key with what it holds, shallow ones first, lists and objects as JSON."""
    leaf = F.udtf(_Flatten, returnType="record int, path string, depth int, ord int, type string, value string")
    entry = F.udtf(_Entries, returnType="record int, path string, ord int, type string, value string")
    spark.udtf.register("flatten_json", leaf)
    spark.udtf.register("json_entries", entry)


def find_first(rows, hints: list[str], exclude: list[str] | None = None, types: list[str] | None = None):
    """From flatten_json rows(id, path, depth, ord, type, value): for each id the shallowest, then first, leaf whose last key holds a hint."""
    last = F.lower(F.regexp_replace(F.substring_index("path", ".", -1), r"\[\]", ""))
    hit = F.lit(False)
    for h in hints:
        hit = hit | last.contains(h)
    for x in exclude or []:
        hit = hit & ~last.contains(x)
    if types:
        hit = hit & F.col("type").isin(*types)
    return rows.filter(hit & F.col("value").isNotNull()).groupBy("id").agg(F.min_by(F.struct("path", "value"), F.struct("depth", "ord")).alias("found")).select("id", "found.path", "found.value")


def collect_numbers(rows, keys: list[str]):
    """From flatten_json rows: for each id all numbers under the keys, in document order."""
    last = F.lower(F.regexp_replace(F.substring_index("path", ".", -1), r"\[\]", ""))
    hit = rows.filter(last.isin(*keys) & F.col("type").isin("int", "float"))
    return hit.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("value").cast("double").alias("v")))), lambda s: s["v"]).alias("numbers"))
