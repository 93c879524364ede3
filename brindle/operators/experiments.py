"""Stress curves, usable bands, comparison of runs, training traces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brindle.operators.prefix import scan


def stress_summary(rows: DataFrame, baseline: str, by: list[str] | None = None) -> DataFrame:
    """rows(condition, score): baseline, worst, worst_condition, abs_drop, rel_drop, verdict; no row without a baseline."""
    s = rows.withColumn("score", F.nanvl("score", F.lit(None).cast("double"))).filter("score is not null")
    g = s.groupBy(*(by or [])).agg(F.max(F.when(F.col("condition") == baseline, F.col("score"))).alias("baseline"), F.min(F.struct("score", "condition")).alias("w"))
    g = g.filter("baseline is not null").select(*(by or []), "baseline", F.col("w.score").alias("worst"), F.col("w.condition").alias("worst_condition"))
    g = g.withColumn("abs_drop", F.col("baseline") - F.col("worst")).withColumn("rel_drop", F.col("abs_drop") / F.greatest("baseline", F.lit(1e-9)))
    return g.withColumn("verdict", F.when(F.col("rel_drop") > 0.30, "fail").when(F.col("rel_drop") > 0.15, "warn").otherwise("pass"))


def usable_band(rows: DataFrame, tolerances: list[float], x: str = "x", score: str = "score", by: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """For each tolerance, the run of x about the peak whose scores stay above peak * (1 - tolerance): gaps and islands.

    Equal peaks: the first by `tie` (else the smallest x).
    """
    by = by or []
    clean = rows.withColumn("_s", F.nanvl(score, F.lit(None).cast("double"))).filter("_s is not null")
    top = clean.groupBy(*by).agg(F.max(F.struct("_s"))["_s"].alias("_peak"))
    beside = lambda df: _beside(clean, df, by)
    at = beside(top).filter(F.col("_s") == F.col("_peak")).groupBy(*by).agg(F.max("_peak").alias("_peak"), F.min(F.struct(F.col(tie or x).alias("o"), F.col(x).alias("x")))["x"].alias("_at"))
    each = beside(at).withColumn("tolerance", F.explode(F.array(*(F.lit(float(t)) for t in tolerances))))
    ok = F.col("_s") >= F.col("_peak") * (1 - F.col("tolerance"))
    # a step of x is one row, so that the order is total; what breaks the run is counted along it
    steps = each.groupBy(*by, "tolerance", x).agg(F.max(ok).alias("_ok"), F.count_if(~ok).alias("_bad"), F.max("_peak").alias("_peak"), F.max("_at").alias("_at"))
    cut = scan(steps, [x], {"_gap": ("sum", "_bad")}, [*by, "tolerance"])
    island = cut.filter("_ok").groupBy(*by, "tolerance", "_gap").agg(F.min(x).alias("low"), F.max(x).alias("high"), F.max(F.col(x) == F.col("_at")).alias("_here"), F.max("_peak").alias("peak"), F.max("_at").alias("peak_at"))
    return island.filter("_here").select(*by, "tolerance", "low", "high", "peak", "peak_at")


def _beside(rows: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """rows with the facts of their group, of which there is one row; null is a group."""
    if not by:
        return rows.crossJoin(facts)  # one row
    named = facts.select(*(F.col(c).alias(f"_by_{c}") for c in by), *(c for c in facts.columns if c not in by))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(named, same).drop(*(f"_by_{c}" for c in by))


def usable_shift(rows: DataFrame, tolerance: float, x: str = "x", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """For each curve the largest x up to which, from 0, every score is at least the one at 0 times (1 - tolerance).

    It lies before the first x whose score is too low, so a curve is two aggregations, however many points it has.
    """
    by = by or []
    base = rows.groupBy(*by).agg(F.max(F.when(F.col(x) == 0, F.col(score))).alias("base"))
    both = rows.join(base, by) if by else rows.crossJoin(base)
    low = ~F.coalesce(F.col(score) >= F.col("base") * (1 - tolerance), F.lit(False))
    first = both.groupBy(*by).agg(F.min(F.when(low, F.col(x))).alias("first"))
    both = both.join(first, by) if by else both.crossJoin(first)
    inside = (F.col(x) >= 0) & (F.col("first").isNull() | (F.col(x) < F.col("first")))
    return both.groupBy(*by).agg(F.coalesce(F.max(F.when(inside, F.col(x))), F.lit(0.0)).alias("usable_shift"))


def scores_by_condition(rows: DataFrame, condition: str = "condition", y: str = "y", pred: str = "pred") -> DataFrame:
    """rows(condition, y, pred), a row per image and stress condition, to condition, n, accuracy, score (macro-F1 over the classes seen)."""
    sides = F.array(F.struct(F.col(y).alias("c"), F.lit(1).alias("s"), F.lit(0).alias("p"), (F.col(y) == F.col(pred)).cast("int").alias("t")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("t")))
    per = rows.select(condition, F.explode(sides).alias("x")).select(condition, "x.*").groupBy(condition, "c").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    return per.groupBy(condition).agg(F.sum("s").alias("n"), (F.sum("t") / F.sum("s")).alias("accuracy"), F.avg(2 * F.col("t") / (F.col("s") + F.col("p"))).alias("score"))


def occupancy(zoom: Column | str, margin: float) -> Column:
    """The share of the frame that the object fills."""
    z = F.col(zoom) if isinstance(zoom, str) else zoom
    return F.least(z / margin, F.lit(1.0))


def compare_runs(runs: DataFrame, base_value: str, noise: float = 0.03, want: float = 0.15) -> DataFrame:
    """runs(stage, run, ord, score, scale_drop) to a verdict for each stage.

    The baseline is the first run named base_value, else the first; the best is the least scale_drop among the others.
    """
    by = W.partitionBy("stage")
    head = F.struct((F.col("run") != base_value).alias("other"), F.col("ord").alias("ord"))
    marked = runs.withColumn("_base", head == F.min(head).over(by))
    g = marked.groupBy("stage").agg(
        F.max(F.when(F.col("_base"), F.struct("run", "score", "scale_drop"))).alias("b"),
        F.min(F.when(~F.col("_base") & F.col("scale_drop").isNotNull(), F.struct("scale_drop", "ord", "run", "score"))).alias("o"),
        F.count("*").alias("n"),
    )
    drop = F.col("o.scale_drop") - F.col("b.scale_drop")
    verdict = F.when(F.col("n") == 1, "no_comparison").when(drop.isNull(), "unmeasured").when((drop < -noise) & (F.col("o.scale_drop") <= want), "adopt").when(drop < -noise, "improved").otherwise("no_effect")
    return g.select("stage", F.col("b.run").alias("baseline"), F.col("o.run").alias("best"), drop.alias("drop_delta"), (F.col("o.score") - F.col("b.score")).alias("score_delta"), verdict.alias("verdict"))


def training_trace(history: DataFrame, epoch: str = "epoch", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """history with best_so_far, improved (strictly), best_epoch and epochs_since."""
    h = scan(history, [epoch], {"_before": ("max", score), "best_so_far": ("max", score)}, by, before=("_before",))
    h = h.withColumn("improved", F.col("_before").isNull() | (F.col(score) > F.col("_before"))).drop("_before")
    h = scan(h, [epoch], {"best_epoch": ("last", F.when(F.col("improved"), F.col(epoch)))}, by)
    return h.withColumn("epochs_since", F.col(epoch) - F.col("best_epoch"))


def learning_rate(step: Column | str, warmup: int, total: int, low: float = 0.01) -> Column:
    """The factor of a linear warm-up and a cosine decay."""
    s = F.col(step) if isinstance(step, str) else step
    t = F.least((s - warmup) / float(max(1, total - warmup)), F.lit(1.0))
    return F.when(s < warmup, (s + 1) / float(max(1, warmup))).otherwise(low + (1 - low) * 0.5 * (1 + F.cos(t * math.pi)))


def choose_stage1_tag(best: str, scale_gap: float, ceiling: float | None, tags: list[str], target: float = 0.95, low: float = 0.67, high: float = 1.5) -> tuple[str, str]:
    """The crop tag for the screen and why: a tag whose window doesn't follow the lesion, unless the scale tells nothing."""

    def there(tag: str, why: str) -> tuple[str, str]:
        if tag not in tags:
            raise ValueError(f"tag {tag} is not prepared: {tags}")
        return tag, why

    if low <= scale_gap <= high:
        return there(best, "scale tells nothing")
    fixed = [t for t in tags if t[:1] == "f" and t[1:].isdigit()]
    if fixed:
        return there(fixed[0], "fixed window")
    if "full" not in tags:
        raise ValueError("scale tells the class, and no tag avoids it")
    if ceiling is not None and ceiling >= target + 0.01:
        return "full", "whole image; nothing of note is lost"
    return there(best, "warning: the whole image loses lesions, the crop tells scale")
