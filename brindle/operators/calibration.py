"""Calibration and selective prediction over rows(id, conf, correct) or logits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.operators.prefix import running_sums


def confidences(rows: DataFrame, key: str, probs: str = "probs", y: str = "y") -> DataFrame:
    """key, conf, correct."""
    return rows.select(F.col(key).alias("id"), F.array_max(probs).alias("conf"), (V.argmax(probs) == F.col(y)).cast("int").alias("correct"))


def reliability(rows: DataFrame, bins: int = 15, least: int = 1) -> DataFrame:
    """bin (1..bins, (lo, hi]), n, mean_conf, accuracy, of bins with `least` rows."""
    b = F.least(F.greatest(F.ceil(F.col("conf") * float(bins)).cast("int"), F.lit(1)), F.lit(bins))
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.avg(F.col("correct").cast("double")).alias("accuracy")).filter(F.col("n") >= least)


def calibration_error(rows: DataFrame, bins: int = 15, least: int = 5) -> DataFrame:
    """One row: ece over all bins, mce over those with `least` rows."""
    gap = F.abs(F.col("accuracy") - F.col("mean_conf"))
    return reliability(rows, bins).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.coalesce(F.max(F.when(F.col("n") >= least, gap)), F.lit(0.0)).alias("mce"))


def temperature_grid(rows: DataFrame, temperatures: list[float], logits: str = "logits", y: str = "y") -> DataFrame:
    """temperature, nll: the mean loss at each, in one pass over the rows."""
    losses = rows.agg(*(F.avg(V.nll(logits, y, t)).alias(f"t{k}") for k, t in enumerate(temperatures)))
    return losses.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{k}").alias("nll")) for k, t in enumerate(temperatures)))).alias("x")).select("x.*")


def fit_temperature(rows: DataFrame, logits: str = "logits", y: str = "y", low: float = 0.25, high: float = 10.0, rounds: int = 4, points: int = 9) -> float:
    """The temperature of least loss: a grid in log T, narrowed about its best point; each round is one pass."""
    import math

    lo, hi = math.log(low), math.log(high)
    best = 1.0
    for _ in range(rounds):
        grid = [math.exp(lo + (hi - lo) * k / (points - 1)) for k in range(points)]
        got = {r["temperature"]: r["nll"] for r in temperature_grid(rows, grid, logits, y).collect()}
        if any(v is None for v in got.values()):
            return 1.0
        best = min(got, key=lambda t: (got[t], t))
        step = (hi - lo) / (points - 1)
        lo, hi = max(math.log(low), math.log(best) - step), min(math.log(high), math.log(best) + step)
    return best


def calibration_report(rows: DataFrame, key: str, temperature: float, logits: str = "logits", y: str = "y") -> DataFrame:
    """Two rows, before and after: temperature, ece, mce, nll, accuracy (the same in both)."""
    out = None
    for when, t in (("before", 1.0), ("after", temperature)):
        p = rows.withColumn("probs", V.softmax(logits, t))
        conf = confidences(p, key, "probs", y)
        one = calibration_error(conf).crossJoin(conf.agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))).crossJoin(rows.agg(F.avg(V.nll(logits, y, t)).alias("nll")))
        one = one.select(F.lit(when).alias("stage"), F.lit(t).alias("temperature"), "ece", "mce", "nll", "accuracy")
        out = one if out is None else out.union(one)
    return out


def coverage_risk(rows: DataFrame, targets: tuple[float, ...] = (1.0, 0.9, 0.8, 0.7, 0.5)) -> DataFrame:
    """coverage, risk, threshold: answering the surest share of rows; ties in confidence stand in the order of id."""
    ranked = running_sums(rows.withColumn("one", F.lit(1)), [F.col("conf").desc(), F.col("id")], {"cum_correct": "correct", "rank": "one"})
    n = rows.agg(F.count("*").alias("n"))
    goals = rows.sparkSession.createDataFrame([(float(t),) for t in targets], "coverage double")
    at = F.greatest(F.least((F.col("coverage") * F.col("n")).cast("int"), F.col("n")), F.lit(1))
    wanted = goals.crossJoin(n).select("coverage", at.cast("long").alias("rank"))
    return ranked.join(F.broadcast(wanted), "rank").select("coverage", (1 - F.col("cum_correct") / F.col("rank")).alias("risk"), F.col("conf").alias("threshold"))


def abstain_threshold(rows: DataFrame, max_risk: float = 0.20, low: float = 0.2, high: float = 0.99, points: int = 80, least: int = 20) -> DataFrame:
    """One row: the threshold of largest coverage whose risk is allowed (the first of equals; 1.0 if none), and that coverage.

    Rows are counted by the last grid point that they reach; the grid's cumulative sums do the rest.
    """
    from pyspark.sql.window import Window as W

    grid = [low + (high - low) * k / (points - 1) for k in range(points)]
    reach = sum(F.when(F.col("conf") >= t, 1).otherwise(0) for t in grid)
    counts = rows.groupBy(reach.alias("k")).agg(F.count("*").alias("n"), F.sum("correct").alias("c"))
    dim = rows.sparkSession.createDataFrame([(k + 1, t) for k, t in enumerate(grid)] + [(0, -1.0)], "k int, threshold double")
    by = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, W.currentRow)  # points + 1 rows
    full = dim.join(F.broadcast(counts), "k", "left").select("k", "threshold", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", F.lit(0)).alias("c"))
    cum = full.select("k", "threshold", F.sum("n").over(by).alias("n"), F.sum("c").over(by).alias("c"), F.sum("n").over(W.partitionBy()).alias("total"))
    ok = cum.filter((F.col("k") > 0) & (F.col("n") >= least) & (1 - F.col("c") / F.col("n") <= max_risk))
    best = ok.agg(F.max_by(F.struct("threshold", (F.col("n") / F.col("total")).alias("coverage")), F.struct("n", -F.col("k"))).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(1.0)).alias("threshold"), F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"))
