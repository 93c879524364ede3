"""Coordinates in any of their usual forms, as an expression over a VARIANT.

What a value is decides its form: text holds numbers; a list holds numbers, pairs or objects; an object holds numbered
corners, one corner with or without a size, or wraps another value. Each form is one rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.geometry import let, numbered_points

# Keys that wrap coordinates, and what counts as a number in text.
WRAPPERS = ("location", "points", "coordinates", "vertices", "coord", "value", "data")
NUMBER = r"-?[0-9]+\.?[0-9]*"

POINTS = "array<struct<x:double,y:double>>"


def _none() -> Column:
    return F.array().cast(POINTS)


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _known(points: Column) -> Column:
    return F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _number(v: Column) -> Column:
    return _as(v, "string").try_cast("double")


def _two_by_two(numbers: Column) -> Column:
    """Numbers in pairs; nothing if they are fewer than four or odd in number."""
    pairs = lambda n: F.when((F.size(n) >= 4) & (F.size(n) % 2 == 0), F.transform(F.sequence(F.lit(0), (F.size(n) / 2).cast("int") - 1), lambda i: _point(F.get(n, 2 * i), F.get(n, 2 * i + 1)))).otherwise(_none())
    return let(numbers, pairs)


def _of_text(v: Column) -> Column:
    return _two_by_two(F.transform(F.regexp_extract_all(_as(v, "string"), F.lit(NUMBER), F.lit(0)), lambda t: t.try_cast("double")))


def _of_list(items: Column, depth: int) -> Column:
    """By its first item: objects give the points of each, lists one point each, all else is numbers."""
    first = F.schema_of_variant(F.get(items, F.lit(0)))
    pair = lambda v: let(_as(v, "array<variant>"), lambda p: F.when(F.size(p) >= 2, _point(_number(F.get(p, F.lit(0))), _number(F.get(p, F.lit(1))))))
    numbers = F.transform(F.filter(items, lambda v: F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")), _number)
    objects = F.flatten(F.transform(items, lambda v: points(v, depth - 1))) if depth > 0 else _none()
    out = F.when(first.startswith("OBJECT"), objects).when(first.startswith("ARRAY"), _known(F.filter(F.transform(items, pair), lambda p: p.isNotNull())))
    return out.otherwise(_two_by_two(numbers))


def _of_object(m: Column, depth: int) -> Column:
    """m: a map of variants with keys in lower case."""
    text = F.transform_values(m, lambda _, v: _as(v, "string"))
    here = lambda *keys: F.forall(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(m, k))
    n = lambda k: _number(F.try_element_at(m, F.lit(k)))
    corner = F.array(_point(n("x"), n("y")), _point(n("x") + n("width"), n("y") + n("height")))
    wrapped = _none()
    if depth > 0:
        held = F.array(*(F.try_element_at(m, F.lit(k)) for k in WRAPPERS))
        lists = F.filter(F.map_values(m), lambda v: F.size(_as(v, "array<variant>")) > 0)
        inner = F.transform(F.filter(F.concat(held, lists), lambda v: v.isNotNull()), lambda v: points(v, depth - 1))
        wrapped = F.coalesce(F.get(F.filter(inner, lambda p: F.size(p) > 0), F.lit(0)), _none())
    other = F.when(here("x", "y"), _known(corner)).otherwise(wrapped)
    return let(numbered_points(text), lambda p: F.when(F.size(p) >= 2, p).otherwise(other))


def points(v: Column | str, depth: int = 3) -> Column:
    """The points of a VARIANT; an empty array for a null and for anything that holds none. depth: values within values that are looked at."""
    v = F.col(v) if isinstance(v, str) else v
    lower = lambda e: F.transform(e, lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value")))
    last = lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"]))
    by_key = F.map_from_entries(let(lower(F.map_entries(_as(v, "map<string,variant>"))), last))
    kind = F.schema_of_variant(v)
    out = F.when(kind == "STRING", _of_text(v)).when(kind.startswith("ARRAY"), let(_as(v, "array<variant>"), lambda a: _of_list(a, depth)))
    return F.coalesce(out.when(kind.startswith("OBJECT"), let(by_key, lambda m: _of_object(m, depth))), _none())


def as_xy(text: Column | str) -> Column:
    """The points of JSON text; of text that is no JSON, those that its numbers make."""
    t = F.col(text) if isinstance(text, str) else text
    return points(F.coalesce(F.try_parse_json(t), t.cast("variant")))
