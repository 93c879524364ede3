"""Audits of a labelled manifest: quantiles by label, crop geometry, boxes out of bounds, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import geometry as G
from brindle.functions.scalars import NORMAL
from brindle.operators.selection import order_statistics, quantiles
from brindle.session import Staged


def quantiles_by_label(rows: DataFrame, label: str, value: str) -> DataFrame:
    """label, n, p25, median, p75 (exact, linear); null labels are left out."""
    known = rows.filter(F.col(label).isNotNull())
    q = quantiles(known, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}, [label])
    return known.groupBy(label).agg(F.count("*").alias("n")).join(q.drop("n"), label, "left")


def label_spread(rows: DataFrame, label: str, value: str, normal: str = NORMAL) -> DataFrame:
    """One row: normal / lesion ratio of medians, and the largest over the smallest lesion median, with their labels."""
    m = quantiles_by_label(rows, label, value).select(label, "median")
    les = F.col(label) != normal
    g = m.agg(F.max(F.when(~les, F.col("median"))).alias("normal"), F.percentile(F.when(les, F.col("median")), F.lit(0.5)).alias("lesion"), F.max(F.when(les, F.struct("median", label))).alias("hi"), F.min(F.when(les, F.struct("median", label))).alias("lo"))
    ratio, spread = F.col("normal") / F.nullif("lesion", F.lit(0.0)), F.col("hi.median") / F.nullif(F.col("lo.median"), F.lit(0.0))
    return g.select(ratio.alias("ratio"), spread.alias("spread"), F.col(f"hi.{label}").alias("largest"), F.col(f"lo.{label}").alias("smallest"), ((ratio > 1.5) | (ratio < 0.67)).alias("scale_leak"), (spread > 2).alias("uneven"))


def floor_quantiles(rows: DataFrame, value: str, points: list[float]) -> DataFrame:
    """One row: for each p the value at rank floor(n p), from 0 and at most n - 1; p<percent> columns. Nulls if there are no values."""
    at = lambda p: lambda n: F.least(F.floor(n * F.lit(p)), n - 1)
    found = order_statistics(rows, value, {f"p{round(p * 100)}": (at(p), at(p)) for p in points})
    return found.agg(*(F.max(f"p{round(p * 100)}_first").alias(f"p{round(p * 100)}") for p in points))


def area_profile(rows: DataFrame, value: str = "area_ratio") -> DataFrame:
    """One row: n, p10, p25, p50, p75, p90 (floor rank), and the shares below 0.05 and 0.01; rounded to 4 and 3 places."""
    known = rows.filter(F.col(value).isNotNull())
    q = floor_quantiles(known, value, [0.1, 0.25, 0.5, 0.75, 0.9])
    under = lambda x: F.round(F.avg((F.col(value) < x).cast("double")), 3)
    g = known.agg(F.count("*").alias("n"), under(0.05).alias("under_5pct"), under(0.01).alias("under_1pct"))
    return g.crossJoin(F.broadcast(q)).select("n", *(F.round(c, 4).alias(c) for c in q.columns), "under_5pct", "under_1pct")


def sharpness_by_label(rows: DataFrame, blurry: float = 100.0, label: str = "label", value: str = "sharpness") -> DataFrame:
    """label, n, median, share_blurry."""
    known = rows.filter(F.col(label).isNotNull() & F.col(value).isNotNull())
    blur = known.groupBy(label).agg(F.avg((F.col(value) < blurry).cast("double")).alias("share_blurry"))
    return quantiles(known, value, {"median": 0.5}, [label]).join(blur, label).select(label, "n", "median", "share_blurry")


def sharpness_audit(rows: DataFrame, blurry: float = 100.0, label: str = "label", value: str = "sharpness", normal: str = NORMAL) -> DataFrame:
    """One row: the median and the share of blurry images, the normal median over the median lesion median, and warnings."""
    each = sharpness_by_label(rows, blurry, label, value)
    ratio = F.max(F.when(F.col(label) == normal, F.col("median"))) / F.greatest(F.percentile(F.when(F.col(label) != normal, F.col("median")), F.lit(0.5)), F.lit(1e-9))
    blur = rows.filter(F.col(value).isNotNull()).agg(F.avg((F.col(value) < blurry).cast("double")).alias("share_blurry"))
    half = quantiles(rows, value, {"median": 0.5}).agg(F.max("median").alias("median"))
    out = half.crossJoin(blur).crossJoin(each.agg(ratio.alias("normal_over_lesion")))  # one row each
    return out.withColumn("uneven", F.coalesce((F.col("normal_over_lesion") > 1.6) | (F.col("normal_over_lesion") < 0.62), F.lit(False))).withColumn("many_blurry", F.col("share_blurry") > 0.3)


def box_audit(rows: DataFrame) -> DataFrame:
    """rows(bbox, img_w, img_h) to one row: boxes out of bounds, the worst overflow, its share of the median height, a verdict."""
    over = rows.filter("bbox is not null").withColumn("_over", G.overflow("bbox", "img_w", "img_h")).withColumn("_bad", G.out_of_bounds("bbox", "img_w", "img_h"))
    g = over.agg(F.count("*").alias("n"), F.count_if(F.col("_bad")).alias("n_bad"), F.coalesce(F.max(F.when(F.col("_bad"), F.col("_over"))), F.lit(0.0)).alias("worst"), F.percentile("img_h", F.lit(0.5)).alias("h"))
    share, rel = F.col("n_bad") / F.nullif("n", F.lit(0)), F.col("worst") / F.nullif("h", F.lit(0.0))
    verdict = F.when(F.col("n_bad") == 0, "clean").when((share < 0.01) & (rel < 0.30), "labeller").otherwise("convention")
    return g.select("n", "n_bad", F.col("worst").alias("worst_overflow"), share.alias("share"), rel.alias("relative"), verdict.alias("verdict"))


def window_sizes(rows: DataFrame, tag: str, img_size: int = 224, min_px: int = 64) -> DataFrame:
    """One row: quartiles of the crop windows' short side and the share that would be enlarged."""
    win = rows.withColumn("_w", G.crop_window("bbox", "img_w", "img_h", F.lit(tag), min_px)).filter("_w is not null")
    short = F.least(F.col("_w.x2") - F.col("_w.x1"), F.col("_w.y2") - F.col("_w.y1"))
    q = win.agg(F.count("*").alias("n"), F.percentile(short, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.avg((short < img_size).cast("double")).alias("upscaled"))
    return q.select("n", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "upscaled", (F.col("upscaled") > 0.5).alias("too_small"))


def _visible(rows: DataFrame, tag: str) -> DataFrame:
    return rows.filter("bbox is not null").withColumn("_w", G.crop_window("bbox", "img_w", "img_h", F.lit(tag))).filter("_w is not null").withColumn("v", G.visibility("bbox", "_w"))


def visibility_by_label(rows: DataFrame, tag: str, label: str = "label") -> DataFrame:
    """label, n, mostly_gone, median_visible."""
    seen = Staged(rows.sparkSession).write(_visible(rows, tag).filter(F.col(label).isNotNull()).select(label, "v"))  # the windows are worked out once
    gone = seen.groupBy(label).agg(F.avg((F.col("v") <= 0.1).cast("double")).alias("mostly_gone"))
    return quantiles(seen, "v", {"median_visible": 0.5}, [label]).join(gone, label).select(label, "n", "mostly_gone", "median_visible")


def visibility_loss(rows: DataFrame, tag: str, normal: str = NORMAL, label: str = "label") -> DataFrame:
    """One row: how much of the boxes a crop tag shows, and the recall that its losses still allow. A null label is a lesion."""
    seen = Staged(rows.sparkSession).write(_visible(rows, tag).select(label, "v"))
    les = ~F.col(label).eqNullSafe(normal)
    gone = F.coalesce(F.avg(F.when(les, (F.col("v") <= 0.1).cast("double"))), F.lit(0.0))
    rates = seen.agg(
        F.count("*").alias("n"), F.avg((F.col("v") >= 0.9).cast("double")).alias("fully_visible"), F.avg(((F.col("v") > 0.1) & (F.col("v") < 0.9)).cast("double")).alias("partial"),
        F.avg((F.col("v") <= 0.1).cast("double")).alias("mostly_gone"), gone.alias("lesion_mostly_gone"), (1 - gone).alias("recall_ceiling"),
    )
    both = rates.join(quantiles(seen, "v", {"median_visible": 0.5}).select("median_visible"), how="left")  # one row each
    return both.select("n", "fully_visible", "partial", "mostly_gone", "median_visible", "lesion_mostly_gone", "recall_ceiling")


def names_with_labels(rows: DataFrame, name: str = "image_name", label: str = "label") -> DataFrame:
    """Names that carry more than one label."""
    return rows.groupBy(name).agg(F.countDistinct(label).alias("n_labels")).filter("n_labels > 1")


def exact_duplicates(rows: DataFrame, digest: str, label: str) -> DataFrame:
    """One row: groups of equal digests, the duplicate rate, groups across labels."""
    g = rows.groupBy(digest).agg(F.count("*").alias("n"), F.countDistinct(label).alias("k"))
    return g.agg(F.count_if(F.col("n") > 1).alias("groups"), F.sum(F.col("n") - 1).alias("extra"), F.sum("n").alias("rows"), F.count_if(F.col("k") > 1).alias("cross_class")).withColumn("dup_rate", F.col("extra") / F.col("rows"))


def overlap_score(rows: DataFrame, heat: str = "heat", width: str = "w", box: str = "bbox") -> DataFrame:
    """rows with lift: a heat map's mass inside the (relative) box over the box's share of the area.

    heat is an array of cells in rows of `width` cells.
    """
    h, w, b = F.col(heat), F.col(width), F.col(box)
    rows_n = F.size(h) / w
    x1, x2 = F.floor(b["x1"] * w), F.greatest(F.ceil(b["x2"] * w), F.floor(b["x1"] * w) + 1)
    y1, y2 = F.floor(b["y1"] * rows_n), F.greatest(F.ceil(b["y2"] * rows_n), F.floor(b["y1"] * rows_n) + 1)
    inside = F.aggregate(F.transform(h, lambda v, i: F.when((i % w >= x1) & (i % w < x2) & (F.floor(i / w) >= y1) & (F.floor(i / w) < y2), v).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    total = F.aggregate(h, F.lit(0.0), lambda s, v: s + v)
    area = (x2 - x1) * (y2 - y1) / F.size(h)
    return rows.withColumn("lift", F.when((total > 0) & (area > 0), inside / total / area))


def overlap_summary(scored: DataFrame) -> DataFrame:
    """One row: n, the mean and the median lift, and the share above 1; rows without a lift don't count."""
    known = scored.filter("lift is not null")
    half = quantiles(known, "lift", {"median_lift": 0.5}).agg(F.max("median_lift").alias("median_lift"))
    g = known.agg(F.count("*").alias("n"), F.avg("lift").alias("mean_lift"), F.avg((F.col("lift") > 1).cast("double")).alias("share_above_1"))
    return g.crossJoin(half).select("n", "mean_lift", "median_lift", "share_above_1")  # one row each
