"""Leaves over VARIANT are those of the walk in Python, on odd JSON and on JSON drawn at random."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.functions import json_variant, json_walk

ODD = [
    None, "", "  ", "no json", "{", "[]", "{}", "null", "3", '"x"', "[1, 2]", "[[{\"a\": 1}]]", '﻿{"a": 1}', '{"a": 1, "a": 2}',
    '{"a": {"b": 1}, "a.b": 2}', '{"a": [], "b": {}, "c": [[]], "d": [{}], "e": [{"x": []}]}', '[{"a": 1}, 5, null, {"b": [true, 2]}, []]',
    '{"i": 9223372036854775807, "j": 9223372036854775808, "k": 100000000000000000000}', '{"f": 1.0, "g": 1.50, "h": -2.0, "n": 0.5}', '{"t": "1.0", "u": "", "v": "null", "w": "A\\u00e9\\ud55c"}',
    '{"": 1}', '{"": {"": 1}}', '{"a": [[[[[[[[[[1]]]]]]]]]]}', '{"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": {"i": 1}}}}}}}}}', '{"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": [1, 2]}}}}}}}}',
]


def want(texts, depth=8):
    out = []
    for n, t in enumerate(texts):
        out += [(n, r, p, d, k, v) for r, p, d, _, k, v in json_walk._Flatten().eval(t)] if depth == 8 else []
    return out


def squeezed(kind, value):
    """JSON of lists and objects without blanks."""
    return json.dumps(json.loads(value), separators=(",", ":"), sort_keys=True, ensure_ascii=False) if kind in ("list", "dict") else value


def got(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [tuple(r) for r in json_variant.leaf_rows(df, "t").select("id", "record", "path", "depth", "type", "value").collect()]


def same(spark, texts):
    norm = lambda rows: sorted(((*r[:5], squeezed(r[4], r[5])) for r in rows), key=repr)
    assert norm(got(spark, texts)) == norm(want(texts))


def test_odd_forms(spark):
    same(spark, ODD)


KEYS = st.text("abc", min_size=1, max_size=2)
LEAF = st.none() | st.booleans() | st.integers(-(2**40), 2**40) | st.sampled_from([0.5, -1.25, 3.0, 1e-3]) | st.text("xyé", max_size=3)
VALUE = st.recursive(LEAF, lambda x: st.lists(x, max_size=3) | st.dictionaries(KEYS, x, max_size=3), max_leaves=12)


@settings(max_examples=6, deadline=None)
@given(st.lists(VALUE, min_size=20, max_size=40))
def test_random(spark, values):
    same(spark, [json.dumps(v) for v in values])


def test_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": {"c": 1}}]}')], "id int, t string").repartition(2)
    plan = json_variant.leaf_rows(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UDTF" not in plan and plan.count("Exchange") == 1


def test_setting_is_put_back_and_columns_stay(spark):
    before = spark.conf.get(json_variant.DUPLICATES)
    df = spark.createDataFrame([(1, '{"a": 1, "a": 2}', "x")], "id int, t string, other string")
    out = json_variant.leaf_rows(df, "t")
    assert spark.conf.get(json_variant.DUPLICATES) == before
    assert [tuple(r) for r in out.collect()] == [(1, "x", 0, "a", 1, "int", "2")]
    with pytest.raises(ValueError, match="path"):
        json_variant.leaf_rows(df.withColumnRenamed("other", "path"), "t")
    assert json_variant.leaf_rows(df.filter("id > 1"), "t").count() == 0


def test_long_text_and_many_leaves(spark):
    wide = json.dumps({f"k{n}": n for n in range(3000)} | {"text": "x" * 2_000_000})
    rows = got(spark, [wide, wide])
    assert len(rows) == 6002 and max(len(r[5]) for r in rows) == 2_000_000
