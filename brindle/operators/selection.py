"""Exact order statistics without a sort of all rows: a sketch brackets a rank, a count confirms the bracket, and so on inside it.

A pass is one aggregation with a map-side combine, which counts what is below and within each bracket and sketches what is
within; a hundred-thousand-million values are a million after four passes. Only distinct values inside the last brackets are sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brindle.session import Staged

#: Entries of a sketch, thrice its error of rank, which is added on both sides, and the ranks that it is asked for, as these must be constants.
ENTRIES, SLACK = 800, 0.01
GRID = 200

Rank = Callable[[Column], Column]


def _narrow(sketch: Column, first: Column, last: Column, t: dict[str, Column]) -> tuple[Column, Column]:
    """The bounds that should hold the ranks first to last, by a sketch of the values of bracket t. A sketch leaves NaN out."""
    n = F.kll_sketch_get_n_double(sketch)
    a, b = (first - t["below"]) / n - SLACK, (last + 1 - t["below"]) / n + SLACK
    grid = F.kll_sketch_get_quantile_double(sketch, F.array(*(F.lit(k / GRID) for k in range(GRID + 1))))
    lo = F.when((n > 0) & (a > 0), F.get(grid, F.floor(F.least(a, F.lit(1.0)) * GRID).cast("int")))
    hi = F.when((n > 0) & (b < 1), F.get(grid, F.ceil(b * GRID).cast("int")))
    return lo.otherwise(t["lo"]), hi.otherwise(t["hi"])


def order_statistics(rows: DataFrame, value: str, targets: dict[str, tuple[Rank, Rank]], by: list[str] | None = None, few: int = 1_000_000, passes: int = 12, staged: Staged | None = None) -> DataFrame:
    """by, n, and for each name: (first, last) of targets the columns <name>_first and <name>_last, the group's values at these ranks.

    first and last give ranks from 0, near each other, for the column n of the values' number. Null values don't count, NaN is the
    largest, a null key is a group, a group without values has no row. Brackets are narrowed until none holds more than `few`
    distinct values, or for `passes` passes; the result is exact whichever ends it, as only a counted bracket is taken. Runs a job a pass.
    """
    by, staged = by or [], staged or Staged(rows.sparkSession)
    keys = [f"_k{i}" for i in range(len(by))]
    known = rows.filter(F.col(value).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).alias("_v"), F.col(value).cast("double").alias("_d"))
    names = list(targets)
    ranks = [tuple(r(F.col("n")).cast("long") for r in targets[n]) for n in names]

    def bracket(i: int) -> dict[str, Column]:
        return {c: F.col(f"_t{i}")[c] for c in ("lo", "hi", "below", "held", "next_lo", "next_hi")}

    def state(t: dict[str, Column], sketch: Column, i: int) -> Column:
        lo, hi = _narrow(sketch, *ranks[i], t)
        return F.struct(*(t[c].alias(c) for c in ("lo", "hi", "below", "held")), lo.alias("next_lo"), hi.alias("next_hi"))

    def written(df: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        most = F.max(F.greatest(F.lit(0), *(F.col(f"_t{i}.held") for i in range(len(names)))))
        return staged.write(df.observe(seen, most.alias("held"))), seen.get["held"] or 0

    def beside(brackets: DataFrame) -> DataFrame:
        """The values next to their group's brackets, a row a group."""
        if not keys:
            return known.crossJoin(F.broadcast(brackets))  # one row
        same = [F.col(f"v.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        return known.alias("v").join(brackets.alias("b"), same).select("v.*", "b.n", *(f"b._t{i}" for i in range(len(names))))

    total = known.groupBy(*keys).agg(F.count("*").alias("n"), F.approx_count_distinct("_v").alias("_held"), F.kll_sketch_agg_double("_d", F.lit(ENTRIES)).alias("_sketch")).filter("n > 0")
    whole = {"lo": F.lit(float("-inf")), "hi": F.lit(float("nan")), "below": F.lit(0).cast("long"), "held": F.col("_held")}
    now, held = written(total.select(*keys, "n", *(state(whole, F.col("_sketch"), i).alias(f"_t{i}") for i in range(len(names)))))
    for _ in range(passes):
        if held <= few:
            break
        counts, after = [], []
        for i in range(len(names)):
            t = bracket(i)
            inside = (F.col("_d") >= t["next_lo"]) & (F.col("_d") <= t["next_hi"])
            counts += [F.first(f"_t{i}").alias(f"_t{i}"), F.count_if(F.col("_d") < t["next_lo"]).alias(f"_below{i}"), F.count_if(inside).alias(f"_in{i}")]
            counts += [F.approx_count_distinct(F.when(inside, F.col("_v"))).alias(f"_held{i}"), F.kll_sketch_agg_double(F.when(inside, F.col("_d")), F.lit(ENTRIES)).alias(f"_sketch{i}")]
            hit = (F.col(f"_below{i}") <= ranks[i][0]) & (ranks[i][1] < F.col(f"_below{i}") + F.col(f"_in{i}"))
            found = {"lo": t["next_lo"], "hi": t["next_hi"], "below": F.col(f"_below{i}"), "held": F.col(f"_held{i}")}
            # a bracket that missed is given up for the one before it, which the next pass sketches anew
            again = F.struct(*(t[c].alias(c) for c in ("lo", "hi", "below", "held")), t["lo"].alias("next_lo"), t["hi"].alias("next_hi"))
            after.append(F.when(hit, state(found, F.col(f"_sketch{i}"), i)).otherwise(again).alias(f"_t{i}"))
        before = now
        now, held = written(beside(now).groupBy(*keys, "n").agg(*counts).select(*keys, "n", *after))
        staged.drop(before)

    def claim(i: int) -> Column:
        t = bracket(i)
        one = F.struct(F.lit(i).alias("i"), t["below"].alias("below"), ranks[i][0].alias("first"), ranks[i][1].alias("last"))
        return F.when((F.col("_d") >= t["lo"]) & (F.col("_d") <= t["hi"]), one)

    inside = beside(now).select(*keys, "n", "_v", F.explode(F.array_compact(F.array(*map(claim, range(len(names)))))).alias("t"))
    inside = inside.groupBy(*keys, "n", "t", "_v").agg(F.count("*").alias("_c"))
    upto = F.col("t.below") + F.sum("_c").over(W.partitionBy(*keys, "n", "t").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    at = lambda i, end: F.min(F.when((F.col("t.i") == i) & (F.col("_upto") > F.col(f"t.{end}")), F.col("_v"))).alias(f"{names[i]}_{end}")
    out = inside.withColumn("_upto", upto).groupBy(*keys, "n").agg(*(at(i, end) for i in range(len(names)) for end in ("first", "last")))
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), "n", *(f"{n}_{end}" for n in names for end in ("first", "last")))


def quantiles(rows: DataFrame, value: str, points: dict[str, float], by: list[str] | None = None, staged: Staged | None = None) -> DataFrame:
    """by, n, and for each name: p the exact p-quantile of value, between two ranks in proportion. Null values don't count."""
    place = lambda n, p: (n - 1) * F.lit(p)
    both = {name: (lambda n, p=p: F.floor(place(n, p)), lambda n, p=p: F.ceil(place(n, p))) for name, p in points.items()}
    found = order_statistics(rows, value, both, by, staged=staged)

    def between(name: str, p: float) -> Column:
        x, a, b = place(F.col("n"), p), F.col(f"{name}_first").cast("double"), F.col(f"{name}_last").cast("double")
        return F.when(a == b, a).otherwise((F.ceil(x) - x) * a + (x - F.floor(x)) * b).alias(name)

    return found.select(*(by or []), "n", *(between(name, p) for name, p in points.items()))
