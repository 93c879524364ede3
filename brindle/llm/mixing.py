"""Mixing sources to target weights by systematic sampling.

Within a source, documents stand in a fixed order; each expects target / source size copies. The prefix sum of these,
plus one random offset of the source, crosses integers: a document is taken once for each that it crosses. Ordered by
size, a source's taken words differ from its target by little more than one document. The prefix sum is a rank times a
rate, and the rank has three levels (size, bucket, place in the bucket), each a window over counts of the next, so that
no task holds a source. DataFrame expressions only.

Defined cases: a null text has size 0; a null source is a source, the last; an empty source (all sizes 0) has target 0
and is not taken. Repeated rows are documents of their own. Null ids share one bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in code-point order, repeating; share of all words; most: times a source's size; buckets: of a size."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: float = 2.0
    buckets: int = 1024
    seed: str = "mix"


def size() -> Column:
    """Words of text."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key() -> Column:
    """source, never null, as a key of equi-joins."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def targets(sizes: DataFrame, m: Mix = Mix()) -> DataFrame:
    """sizes(source, source_size), a row a source, to key, source_size, target.

    Targets are min(most * size, level * weight); sources in the order of most * size / weight reach their most one after
    another, and the level is that of the first that doesn't.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in m.weights)), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(m.weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("weight")).withColumn("cap", F.col("source_size") * m.most).withColumn("at", F.col("cap") / F.col("weight"))
    by = W.orderBy("at", F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(W.currentRow, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()) * m.share
    s = s.withColumn("level", (total - capped) / rest)
    # the level: the first, in order, that its own source's cap admits; none if all stop
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "source", "level"))).over(W.partitionBy())["level"])
    return s.select(_key().alias("key"), "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def sample(docs: DataFrame, m: Mix = Mix(), table=lambda df: df) -> DataFrame:
    """docs(doc_id, source, size, ...) with source_size, target, copies. table: writes and rereads, to read the texts once."""
    keyed = docs.withColumn("key", _key()).withColumn("bucket", F.coalesce(F.pmod(F.col("doc_id"), F.lit(m.buckets)), F.lit(0)))
    cells = table(keyed.groupBy("source", "key", "size", "bucket").agg(F.count("*").alias("n")))
    goal = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), m)
    upto = lambda part, *by: F.coalesce(F.sum("n").over(W.partitionBy(*part).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = cells.groupBy("key", "size").agg(F.sum("n").alias("n")).select("key", "size", upto(["key"], "size").alias("before"))
    inner = cells.select("key", "size", "bucket", upto(["key", "size"], "bucket").alias("inside"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{m.seed}|"), F.col("key"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    per = sizes.join(goal, "key").select("key", "size", "before", "source_size", "target", offset.alias("u"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    per = inner.join(per, ["key", "size"])
    place = F.row_number().over(W.partitionBy("key", "size", "bucket").orderBy("doc_id"))
    ranked = keyed.withColumn("place", place).join(per, ["key", "size", "bucket"]).withColumn("rank", F.col("before") + F.col("inside") + F.col("place"))
    crossed = F.floor(F.col("rank") * F.col("rate") + F.col("u")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("u"))
    return ranked.select(*docs.columns, "source_size", "target", F.least(crossed, F.lit(int(m.most))).cast("long").alias("copies"))


def mixture(docs: DataFrame, m: Mix = Mix(), table=lambda df: df) -> DataFrame:
    """docs(doc_id, source, text) to doc_id, size, source_size, target, taken."""
    sized = table(docs.select("doc_id", "source", size().alias("size")))
    return sample(sized, m, table).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, m: Mix = Mix(), table=lambda df: df) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them; the columns stay."""
    rest = F.struct(*docs.columns).alias("row")
    drawn = sample(docs.select("doc_id", "source", size().alias("size"), rest), m, table)
    return drawn.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT key, source, sum(size)::BIGINT AS source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY key, source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM s),
l AS (SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM c),
t AS (SELECT key, source_size, least(cap, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) * weight, cap)) AS target,
        ('0x' || substr(md5('mix|' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
r AS (SELECT d.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY d.key ORDER BY size, coalesce(doc_id % 1024, 0), doc_id) AS rank FROM d JOIN t ON d.key = t.key)
SELECT doc_id, size, source_size, target, (size * least(floor(rank * rate + u) - floor((rank - 1) * rate + u), 2))::BIGINT AS taken FROM r
"""
