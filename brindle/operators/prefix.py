"""Running sums, and running values of any associative operator, over a global order, without a single task that sorts all rows.

Rows are dealt out by ranges of the order and written; a window per range sums within it, and the totals of the ranges
before it, one row a range, are added. A scan within groups takes what its first and its last group carry across a range's ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brindle.session import Staged


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], staged: Staged | None = None) -> DataFrame:
    """df with, for each name: column of sums, the sum of column over all rows up to this one. The order must be total."""
    staged = staged or Staged(df.sparkSession)
    # the writer keeps a partition's rows together under its number
    ranged = staged.write(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = ranged.select("*", *(F.sum(c).over(within).alias(n) for n, c in sums.items()))
    return local.join(F.broadcast(offsets), "_part").select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def _either(join):
    """join of two values, or the one that is there."""
    return lambda before, here: F.when(before.isNull(), here).when(here.isNull(), before).otherwise(join(before, here))


#: Associative operators: the aggregate of rows in order, and of what is before with what is here. Nulls change nothing.
OPERATORS = {
    "sum": (F.sum, _either(lambda a, b: a + b)),
    "max": (F.max, _either(F.greatest)),
    "min": (F.min, _either(F.least)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, here: F.coalesce(here, before)),
    "first": (lambda c: F.first(c, ignorenulls=True), lambda before, here: F.coalesce(before, here)),
}


def scan(df: DataFrame, order: list[Column | str], values: dict[str, tuple[str, Column | str]], by: list[str] | None = None, before: tuple[str, ...] = (), staged: Staged | None = None) -> DataFrame:
    """df with, for each name: (operator, column) of values, the operator over all rows of its group up to this one, or, for names
    in `before`, up to the one before it. Null where there is nothing yet.

    The order must be total within a group. A group of any size is dealt out by ranges like all others; by: null is a group.
    """
    staged, by = staged or Staged(df.sparkSession), by or []
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    rows = W.partitionBy("_part", *by).orderBy(*order)
    upto, until = rows.rowsBetween(W.unboundedPreceding, W.currentRow), rows.rowsBetween(W.unboundedPreceding, -1)
    each = {n: (*OPERATORS[op], F.col(c) if isinstance(c, str) else c) for n, (op, c) in values.items()}
    local = ranged.select("*", *(f(c).over(until if n in before else upto).alias(f"_{n}") for n, (f, _, c) in each.items()), *(f(c).over(upto).alias(f"_t_{n}") for n, (f, _, c) in each.items()), F.lead(F.lit(1)).over(rows).isNull().alias("_tail"))
    local = staged.write(local)
    total = local.filter("_tail").select("_part", F.struct(*by).alias("_g") if by else F.lit(0).alias("_g"), *(f"_t_{n}" for n in each))
    # of a range, only its first and its last group can stand in another one, too
    ends = total.groupBy("_part").agg(F.min("_g").alias("lo"), F.max("_g").alias("hi"))
    edge = total.join(ends, "_part").filter("_g = lo or _g = hi")
    past = W.partitionBy("_g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = edge.select("_part", "_g", *(f(F.col(f"_t_{n}")).over(past).alias(f"_c_{n}") for n, (f, _, _) in each.items()))
    same = (F.col("l._part") == F.col("c._part")) & (F.struct(*by).eqNullSafe(F.col("c._g")) if by else F.lit(True))
    both = local.alias("l").join(F.broadcast(carried).alias("c"), same, "left")  # two rows a range at most
    return both.select(*(F.col(f"l.{c}") for c in df.columns), *(join(F.col(f"_c_{n}"), F.col(f"_{n}")).alias(n) for n, (_, join, _) in each.items()))
