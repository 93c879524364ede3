"""Leaves of JSON of unknown shape as expressions over VARIANT: no Python, no shuffle, one Generate for the records and one for the leaves.

A VARIANT sorts the keys of an object, so what needs the order of a document (the first key that fits, numbers in sequence)
stays with json_walk; profiles of keys don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DUPLICATES = "spark.sql.variant.allowDuplicateKeys"


def parsed(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the VARIANT of a text; null where it is no JSON. Of a key that an object has twice the last value counts.

    Whether keys may come twice is a setting that the expression takes when it is resolved, so it holds for this column only.
    """
    conf = rows.sparkSession.conf
    before = conf.get(DUPLICATES, "false")
    conf.set(DUPLICATES, "true")
    try:
        return rows.withColumn(name, F.try_parse_json(F.regexp_replace(text, "^﻿+", "")))
    finally:
        conf.set(DUPLICATES, before)


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _node(path: Column, depth: Column, v: Column) -> Column:
    return F.struct(path.alias("path"), depth.alias("depth"), v.alias("v"), _object(v).alias("o"), _list(v).alias("a"))


def _open(x: Column) -> Column:
    return x["o"].isNotNull() | x["a"].isNotNull()


def _inner(level: Column) -> Column:
    """The level below: an object's entries, a list's first element (null of an empty one), and what is a leaf already."""

    def below(x: Column) -> Column:
        keys = F.transform(F.map_entries(x["o"]), lambda e: _node(F.when(x["path"] == "", e["key"]).otherwise(F.concat(x["path"], F.lit("."), e["key"])), x["depth"] + 1, e["value"]))
        first = F.array(_node(F.concat(x["path"], F.lit("[]")), x["depth"] + 1, F.get(x["a"], F.lit(0))))
        return F.when(x["o"].isNotNull(), keys).when(x["a"].isNotNull(), first).otherwise(F.array(x))

    return F.flatten(F.transform(level, below))


def _typed(x: Column) -> Column:
    """path, depth, type (as json_walk names them), value of a leaf; lists and objects are leaves at the last depth."""
    v = x["v"]
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    # a decimal without a fraction has lost its point; whole numbers come as decimals only beyond 64 bits
    whole = kind.rlike(r"^DECIMAL\((19|[2-3][0-9]),0\)$")
    kind = F.when(v.isNull() | F.is_variant_null(v), "NoneType").when(x["o"].isNotNull(), "dict").when(x["a"].isNotNull(), "list").when(kind == "BOOLEAN", "bool").when((kind == "BIGINT") | whole, "int").when(kind == "STRING", "str").otherwise("float")
    value = F.when(kind == "NoneType", F.lit(None)).when(kind.isin("dict", "list"), F.to_json(v)).when((kind == "float") & ~text.rlike(r"[.E]"), F.concat(text, F.lit(".0"))).otherwise(text)
    return F.struct(x["path"].alias("path"), x["depth"].alias("depth"), kind.alias("type"), value.alias("value"))


def leaf_rows(rows: DataFrame, text: str, max_depth: int = 8) -> DataFrame:
    """rows without the text, times record, path ('a.b[].c'), depth, type, value: one row a leaf.

    As flatten_json: a text is one record, or a list of records of which only objects count; of a list the first element; an
    empty list is a null leaf, an empty object nothing, and so is a leaf under empty keys alone; below max_depth lists and objects are leaves, in JSON without blanks.
    Null texts and texts that are no JSON give no rows (NaN and Infinity are none here; neither are texts beyond a VARIANT's
    size, 128 MB). Where a key with a point makes the path of another leaf, the one whose own keys sort last counts. Columns of rows with these names
    are an error to Spark, as the result would have them twice: rename them before.
    """
    clash = {"record", "path", "depth", "type", "value"} & {c.lower() for c in rows.columns if c != text}
    if clash:
        raise ValueError(f"columns of the result's names: {sorted(clash)}")
    kept = [c for c in rows.columns if c != text]
    base = parsed(rows.select(*kept, F.col(text).alias("_text")), "_text", "_v").drop("_text")
    records = base.select(*kept, F.posexplode(F.coalesce(_list(F.col("_v")), F.array("_v"))).alias("record", "_v")).filter(_object(F.col("_v")).isNotNull())
    # a level is a column of its own, so that records without anything left to open are done with a look at it
    found = records.select(*kept, "record", F.array(_node(F.lit(""), F.lit(0), F.col("_v"))).alias("_l"))
    for _ in range(max_depth):
        found = found.withColumn("_l", F.when(F.exists("_l", _open), _inner(F.col("_l"))).otherwise(F.col("_l")))
    found = found.withColumn("_l", F.filter("_l", lambda x: x["path"] != "")).withColumn("_p", F.transform("_l", lambda x: x["path"]))
    # rare: a path that comes twice. Only then is each leaf compared with those after it
    last = F.filter("_l", lambda x, k: ~F.array_contains(F.slice("_p", k + 2, F.size("_p")), x["path"]))
    once = F.when(F.size(F.array_distinct("_p")) == F.size("_p"), F.col("_l")).otherwise(last)
    leaves = found.select(*kept, "record", F.explode(once).alias("_x")).select(*kept, "record", _typed(F.col("_x")).alias("_x"))
    return leaves.select(*kept, "record", "_x.path", "_x.depth", "_x.type", "_x.value")
