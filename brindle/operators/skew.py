"""Joins on keys of which a few hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that a heavy key is dealt out to.
SALTS = 32


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, by: list[str], least: int = 1000) -> DataFrame:
    """left join right on keys, a heavy key's rows of left dealt out to SALTS parts and its rows of right sent to each.

    right, a written table, says in column n how many rows of left a key has. Heavy is a key with more than a ten-thousandth
    of them, and more than `least`; there are fewer than ten thousand such keys at any size, so their list is broadcast. by:
    columns of left that tell its rows apart. Keys must not be null. Reads n of right at once.
    """
    total = right.agg(F.sum(n).alias("total")).first()["total"] or 0
    is_heavy = F.col(n) > max(total / 10_000, least)
    heavy = right.filter(is_heavy).select(*keys, F.lit(True).alias("_heavy"))
    left = left.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0).cast("long"))
    right = right.withColumn("_salt", F.explode(F.expr(f"case when {n} > {max(total / 10_000, least)}D then sequence(0L, {SALTS - 1}L) else array(0L) end")))
    return left.join(right, [*keys, "_salt"]).drop("_salt", "_heavy")
