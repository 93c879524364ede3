"""Expressions over arrays of logits or probabilities. Ties go to the first class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(a: Column | str, start: int, n: int) -> Column:
    """n entries from the start-th (1-based), as doubles."""
    return F.transform(F.slice(_c(a), start, n), lambda x: x.cast("double"))


def total(a: Column | str) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def softmax(z: Column | str, temperature: float = 1.0) -> Column:
    e = F.transform(_c(z), lambda x: F.exp((x - F.array_max(_c(z))) / temperature))
    # the sum is bound once
    return F.transform(F.array(F.struct(e.alias("e"), total(e).alias("s"))), lambda p: F.transform(p["e"], lambda x: x / p["s"]))[0]


def argmax(a: Column | str) -> Column:
    """The first place, from 0, of the largest entry."""
    return (F.array_position(_c(a), F.array_max(_c(a))) - 1).cast("int")


def log_sum_exp(z: Column | str, temperature: float = 1.0) -> Column:
    m = F.array_max(_c(z)) / temperature
    return m + F.ln(total(F.transform(_c(z), lambda x: F.exp(x / temperature - m))))


def nll(z: Column | str, y: Column | str, temperature: float = 1.0) -> Column:
    """Minus the log probability of class y (from 0)."""
    return log_sum_exp(z, temperature) - F.get(_c(z), _c(y)) / temperature


def top_k(p: Column | str, k: int) -> Column:
    """The k most likely classes as (class, p), the smaller class first among equals."""
    keyed = F.transform(_c(p), lambda x, i: F.struct((-x).alias("q"), i.alias("class")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: F.struct(s["class"].alias("class"), (-s["q"]).alias("p")))


def _times(w: float):
    return lambda x: x * w


def weighted_mean(arrays: list[Column | str], weights: list[float] | None = None) -> Column:
    """Entry by entry."""
    weights = weights or [1.0] * len(arrays)
    out = F.transform(_c(arrays[0]), lambda x: x * weights[0])
    for a, w in zip(arrays[1:], weights[1:], strict=True):
        out = F.zip_with(out, F.transform(_c(a), _times(w)), lambda x, y: x + y)
    return F.transform(out, lambda x: x / sum(weights))


def band(p: Column | str, high: float = 0.75, middle: float = 0.5) -> Column:
    return F.when(_c(p) >= high, "high").when(_c(p) >= middle, "middle").otherwise("low")
