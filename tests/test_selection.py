"""Exact ranks by brackets: against sorted lists, with few values allowed so that brackets are narrowed many times."""

import math
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import audit
from brindle.operators.selection import order_statistics, quantiles


def ranked(values):
    return sorted(values, key=lambda x: (isinstance(x, float) and math.isnan(x), x))


@pytest.mark.parametrize("few", [10, 1_000_000])
def test_ranks_by_group(spark, few):
    """A group of most rows, ties on both sides of a rank, NaN, infinities, nulls, a null key, a group without values."""
    rnd = random.Random(few)
    odd = (math.nan, math.inf, -math.inf, None, 0.5, 0.5000001)
    rows = [(k % 4 and "hot" or rnd.choice(("a", None)), rnd.choice(odd) if rnd.random() < 0.3 else rnd.gauss(0, 1)) for k in range(6000)]
    rows += [("nan", math.nan)] * 3 + [("none", None), ("one", 2.0)] + [("tied", 7.0)] * 500 + [("two", float(k % 2)) for k in range(501)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    points = {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1}
    targets = {name: (f, f) for name, f in points.items()} | {"pair": (lambda n: F.floor((n - 1) * 0.9), lambda n: F.ceil((n - 1) * 0.9))}
    got = {r["g"]: r for r in order_statistics(df, "v", targets, ["g"], few=few).collect()}
    held: dict = {}
    for g, v in rows:
        if v is not None:
            held.setdefault(g, []).append(v)
    assert set(got) == set(held)
    for g, vs in held.items():
        vs, n, r = ranked(vs), len(vs), got[g]
        want = {"low": (0, 0), "mid": (n // 2, n // 2), "top": (n - 1, n - 1), "pair": (math.floor((n - 1) * 0.9), math.ceil((n - 1) * 0.9))}
        assert r["n"] == n
        for name, ends in want.items():
            for end, k in zip(("first", "last"), ends, strict=True):
                assert r[f"{name}_{end}"] == vs[k] or math.isnan(vs[k]) and math.isnan(r[f"{name}_{end}"]), (g, name, end)


def test_whole_numbers_keep_their_type(spark):
    """Values above 2**53 that are one double are told apart."""
    big = 2**60
    df = spark.range(3000).select((F.col("id") % 1500 + big).alias("v"))
    r = order_statistics(df, "v", {"m": (lambda n: n - 1, lambda n: n - 1), "q": (lambda n: F.floor(n / 3), lambda n: F.floor(n / 3))}, few=5, passes=3).collect()
    assert [(x["n"], x["m_first"], x["q_last"]) for x in r] == [(3000, big + 1499, big + 500)]


def test_nothing(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert quantiles(none, "v", {"m": 0.5}).count() == 0 and quantiles(none, "v", {"m": 0.5}, ["g"]).count() == 0
    assert audit.floor_quantiles(none, "v", [0.1, 0.9]).collect() == [(None, None)]
    assert audit.overlap_summary(none.select(F.col("v").alias("lift"))).collect() == [(0, None, None, None)]


def test_narrowing_sorts_few_rows(spark):
    """What reaches the sort of the last step is what the brackets hold, not the table."""
    df = spark.range(200_000).select(F.xxhash64("id").cast("double").alias("v"), F.col("id").alias("unused"))
    out = order_statistics(df, "v", {"m": (lambda n: F.floor(n / 2), lambda n: F.floor(n / 2))}, few=2000)
    want = sorted(float(r[0]) for r in df.select("v").collect())[100_000]
    assert out.collect()[0]["m_first"] == want
    text = out._jdf.queryExecution().toString()
    assert "rangepartitioning" not in text and "unused" not in text.split("== Physical Plan ==")[1]
