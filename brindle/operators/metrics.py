"""Classification metrics as aggregations over predictions(y, pred) or scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.prefix import running_sums


def confusion(rows: DataFrame, k: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """(y, pred, n) for all k x k cells."""
    spark = rows.sparkSession
    dim = spark.range(k).select(F.col("id").cast("int").alias("y")).crossJoin(spark.range(k).select(F.col("id").cast("int").alias("pred")))
    n = rows.groupBy(F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    return dim.join(F.broadcast(n), ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).alias("n"))  # n: k x k rows


def _safe(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(cells: DataFrame) -> DataFrame:
    """From confusion cells: class, support, predicted, precision, recall, f1 (0 where undefined)."""
    one = cells.select(F.explode(F.array(F.struct(F.col("y").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("t")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("t")))).alias("x")).select("x.*")
    c = one.groupBy("class").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("tp"))
    pr, rc = _safe(F.col("tp"), F.col("predicted")), _safe(F.col("tp"), F.col("support"))
    c = c.select("class", "support", "predicted", "tp", pr.alias("precision"), rc.alias("recall"))
    return c.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(cells: DataFrame) -> DataFrame:
    """One row: accuracy, balanced_accuracy, macro_f1 (over classes seen), weighted_f1, kappa."""
    c = per_class(cells)
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    n, tp = F.sum("support"), F.sum("tp")
    pe = F.sum(F.col("support") * F.col("predicted").cast("double"))
    out = c.agg(
        n.alias("n"), (tp / n).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
        (pe / (n.cast("double") * n)).alias("pe"),
    )
    return out.select("n", "accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", ((F.col("accuracy") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def by_score(rows: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """score, tp, n, and of all rows with this score or a higher one cum_tp, cum_n."""
    points = rows.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("tp"), F.count("*").alias("n"))
    return running_sums(points, [F.col("score").desc()], {"cum_tp": "tp", "cum_n": "n"})


def auroc(rows: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """One row; null if a class is missing. Ties count half."""
    p = by_score(rows, score, y)
    # negatives at lower scores, and half of those at the same one
    t = p.agg(F.sum("tp").alias("pos"), F.sum(F.col("n") - F.col("tp")).alias("neg"), F.sum(F.col("tp") * (F.col("cum_n") - F.col("cum_tp") - (F.col("n") - F.col("tp")) / 2.0)).alias("above"))
    return t.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), 1 - F.col("above") / (F.col("pos").cast("double") * F.col("neg"))).alias("auroc"))


def pr_curve(rows: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """score, precision, recall at each distinct score, predicting score >= it."""
    p = by_score(rows, score, y)
    pos = rows.agg(F.sum(F.col(y).cast("long")).alias("pos"))
    return p.crossJoin(F.broadcast(pos)).select("score", "tp", "n", (F.col("cum_tp") / F.col("cum_n")).alias("precision"), (F.col("cum_tp") / F.col("pos")).alias("recall"), (F.col("tp") / F.col("pos")).alias("step"))


def average_precision(curve: DataFrame) -> DataFrame:
    return curve.agg(F.sum(F.col("step") * F.col("precision")).alias("ap"))


def threshold_at_recall(curve: DataFrame, target: float = 0.95) -> DataFrame:
    """One row: of the scores that reach the recall, that of highest precision, the lowest among equals."""
    best = curve.filter(F.col("recall") >= target).agg(F.max_by(F.struct("score", "precision", "recall"), F.struct("precision", -F.col("score"))).alias("b"))
    return best.select(F.col("b.score").alias("threshold"), F.col("b.precision").alias("precision_at_target"), F.col("b.recall").alias("recall_at_target"))


def macro_auroc(rows: DataFrame, probs: str = "probs", y: str = "y") -> DataFrame:
    """One row: the mean over classes of one-against-rest AUROC; null if a class can't be measured.

    All classes are ranked in one running sum over (class, score), so a class is dealt out like all else.
    """
    long = rows.select(F.col(y).alias("y"), F.posexplode(probs).alias("class", "score"))
    g = long.groupBy("class", "score").agg(F.count_if(F.col("y") == F.col("class")).alias("tp"), F.count("*").alias("n")).withColumn("fp", F.col("n") - F.col("tp"))
    ranked = running_sums(g, [F.col("class"), F.col("score")], {"upto": "fp"})
    # negatives up to and with this score, of this class and of those before it
    c = ranked.groupBy("class").agg(F.sum(F.col("tp") * (F.col("upto") - F.col("fp") / 2.0)).alias("w"), F.sum("tp").alias("pos"), F.sum("fp").alias("neg"), F.max("upto").alias("end"))
    before = F.col("end") - F.col("neg")
    a = F.when((F.col("pos") > 0) & (F.col("neg") > 0), (F.col("w") - F.col("pos") * before) / (F.col("pos").cast("double") * F.col("neg")))
    return c.agg(F.when(F.count("*") == F.count(a), F.avg(a)).alias("macro_auroc"))


def bootstrap(rows: DataFrame, key: str, replicates: int = 200, alpha: float = 0.05, seed: int = 42, y: str = "y", pred: str = "pred") -> DataFrame:
    """One row: accuracy with a percentile interval, from Poisson(1) weights that are a hash of key and replicate.

    Rows are first counted by the hash bucket that fixes their weights (1024 of them), so that the replicates multiply counts,
    not rows. Replicates with fewer than two true classes are left out.
    """
    slots = rows.withColumn("slot", F.conv(F.substring(F.md5(F.concat(F.lit(f"boot{seed}"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 1024)
    cells = slots.groupBy("slot", F.col(y).alias("y")).agg(F.count("*").alias("n"), F.count_if(F.col(y) == F.col(pred)).alias("hit"))
    reps = cells.crossJoin(F.broadcast(rows.sparkSession.range(replicates).withColumnRenamed("id", "rep")))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("slot").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    # Poisson(1) by its cumulative chances: fixed values
    w = F.when(u < 0.36787944117144233, 0).when(u < 0.7357588823428847, 1).when(u < 0.9196986029286058, 2).when(u < 0.9810118431238462, 3).when(u < 0.9963401531726563, 4).otherwise(5)
    per = reps.withColumn("w", w).filter("w > 0").groupBy("rep").agg((F.sum(F.col("hit") * F.col("w")) / F.sum(F.col("n") * F.col("w"))).alias("acc"), F.countDistinct("y").alias("k")).filter("k >= 2")
    point = cells.agg((F.sum("hit") / F.sum("n")).alias("accuracy"))
    return point.crossJoin(per.agg(F.expr(f"percentile(acc, {alpha / 2}D)").alias("low"), F.expr(f"percentile(acc, {1 - alpha / 2}D)").alias("high"), F.count("*").alias("replicates")))


#: Rows of a cell up to which its weight comes from the cumulative chances themselves.
COUNTED = 32


def poisson_steps(most: int = COUNTED) -> list[tuple[int, float]]:
    """(n, c): for each n up to most, the cumulative chances of Poisson(n), term by term until they no longer grow."""
    out = []
    for n in range(1, most + 1):
        p = c = math.exp(-n)
        out.append((n, c))
        for i in range(4 * most):
            p = p * n / (i + 1)
            c = c + p
            out.append((n, c))
    return out


def bootstrap_cells(rows: DataFrame, metric: str = "macro_f1", replicates: int = 1000, alpha: float = 0.05, seed: int = 42, y: str = "y", pred: str = "pred") -> DataFrame:
    """One row: metric (macro_f1 or balanced_accuracy), value, low, high, replicates: a percentile interval of a bootstrap by rows.

    n rows of a confusion cell, weighed by Poisson(1) each, weigh Poisson(n) together, so each cell of each replicate is drawn at
    once, at any table size: by inversion up to COUNTED rows, beyond by a normal deviate with the next term of the expansion.
    Draws are digests of seed, replicate and cell. Rows without y are left out, a null pred is a miss, and so are replicates
    with fewer than two true classes left out. Classes are those seen in y or pred (macro_f1) or in y (balanced_accuracy).
    """
    if metric not in ("macro_f1", "balanced_accuracy"):
        raise ValueError(metric)
    spark, kind = rows.sparkSession, rows.schema[y].dataType
    cells = rows.select(F.col(y).alias("y"), F.col(pred).cast(kind).alias("pred")).filter("y is not null").groupBy("y", "pred").agg(F.count("*").alias("n"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    draw = lambda salt: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{salt}{seed}"), F.col("rep").cast("string"), name("y"), name("pred")).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    drawn = cells.crossJoin(F.broadcast(spark.range(replicates).withColumnRenamed("id", "rep"))).withColumn("u", draw("a")).withColumn("v", draw("b"))
    z = F.sqrt(-2 * F.log("u")) * F.cos(2 * math.pi * F.col("v"))
    many = F.greatest(F.round(F.col("n") + F.sqrt("n") * z + (z * z - 1) / 6), F.lit(0.0)).cast("long")
    steps = spark.createDataFrame(poisson_steps(), "k int, c double").groupBy("k").agg(F.collect_list("c").alias("steps"))
    weighed = drawn.join(F.broadcast(steps), F.col("n") == F.col("k"), "left")  # COUNTED rows
    weighed = weighed.select("rep", "y", "pred", F.when(F.col("n") > COUNTED, many).otherwise(F.size(F.filter("steps", lambda c: c < F.col("u")))).cast("long").alias("n")).filter("n > 0")
    weighed = weighed.unionByName(cells.withColumn("rep", F.lit(-1).cast("long")))
    zero = F.lit(0).cast("long")
    sides = F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("s"), zero.alias("p"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(zero).alias("t")), F.struct(F.col("pred").alias("c"), zero.alias("s"), F.col("n").alias("p"), zero.alias("t")))
    per = weighed.select("rep", F.explode(sides).alias("x")).select("rep", "x.*").filter("c is not null").groupBy("rep", "c").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    value = F.avg(2 * F.col("t") / (F.col("s") + F.col("p"))) if metric == "macro_f1" else F.avg(F.when(F.col("s") > 0, F.col("t") / F.col("s")))
    per = per.groupBy("rep").agg(value.alias("v"), F.count_if(F.col("s") > 0).alias("k"))
    kept = F.when((F.col("rep") >= 0) & (F.col("k") >= 2), F.col("v"))
    return per.agg(F.lit(metric).alias("metric"), F.max(F.when(F.col("rep") < 0, F.col("v"))).alias("value"), F.percentile(kept, alpha / 2).alias("low"), F.percentile(kept, 1 - alpha / 2).alias("high"), F.count(kept).alias("replicates"))  # a row a replicate


def bootstrap_ci(rows: DataFrame, key: str, metric: str = "macro_f1", replicates: int = 1000, alpha: float = 0.05, seed: int = 42, slots: int = 1024, y: str = "y", pred: str = "pred") -> DataFrame:
    """One row: macro_f1 or balanced_accuracy with a percentile interval, from weights as in bootstrap.

    The weights belong to `slots` hash slots of key, so rows of a slot share one; confusion cells are weighed, not rows.
    Classes are those seen in y or pred (macro_f1) or in y (balanced_accuracy); rows without y are left out, and a null pred is
    a miss. Replicates with fewer than two true classes are left out.
    """
    if metric not in ("macro_f1", "balanced_accuracy"):
        raise ValueError(metric)
    spark = rows.sparkSession
    slot = F.conv(F.substring(F.md5(F.concat(F.lit(f"boot{seed}"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % slots
    kind = rows.schema[y].dataType
    cells = rows.select(F.coalesce(slot, F.lit(0)).alias("slot"), F.col(y).alias("y"), F.col(pred).cast(kind).alias("pred")).filter("y is not null").groupBy("slot", "y", "pred").agg(F.count("*").alias("n"))
    drawn = spark.range(slots).withColumnRenamed("id", "slot").crossJoin(F.broadcast(spark.range(replicates).withColumnRenamed("id", "rep")))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("slot").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    w = F.when(u < 0.36787944117144233, 0).when(u < 0.7357588823428847, 1).when(u < 0.9196986029286058, 2).when(u < 0.9810118431238462, 3).when(u < 0.9963401531726563, 4).otherwise(5)
    # replicate -1 is the table itself
    drawn = drawn.withColumn("w", w).filter("w > 0").unionByName(spark.range(slots).select(F.col("id").alias("slot"), F.lit(-1).cast("long").alias("rep"), F.lit(1).alias("w")))
    per = cells.join(drawn, "slot").groupBy("rep", "y", "pred").agg(F.sum(F.col("n") * F.col("w")).alias("n"))
    zero = F.lit(0).cast("long")
    sides = F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("s"), zero.alias("p"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(zero).alias("t")), F.struct(F.col("pred").alias("c"), zero.alias("s"), F.col("n").alias("p"), zero.alias("t")))
    per = per.select("rep", F.explode(sides).alias("x")).select("rep", "x.*").filter("c is not null").groupBy("rep", "c").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    value = F.avg(2 * F.col("t") / (F.col("s") + F.col("p"))) if metric == "macro_f1" else F.avg(F.when(F.col("s") > 0, F.col("t") / F.col("s")))
    per = per.groupBy("rep").agg(value.alias("v"), F.count_if(F.col("s") > 0).alias("k"))
    point, kept = F.col("rep") < 0, "case when rep >= 0 and k >= 2 then v end"
    return per.agg(F.max(F.when(point, F.col("v"))).alias(metric), F.expr(f"percentile({kept}, {alpha / 2}D)").alias("low"), F.expr(f"percentile({kept}, {1 - alpha / 2}D)").alias("high"), F.expr(f"count({kept})").alias("replicates"))


def class_weights(rows: DataFrame, k: int, y: str = "y", scheme: str = "inverse_sqrt") -> DataFrame:
    """class, n, weight: 1/sqrt(n) or 1/n, divided by the mean over all k classes; a class without rows counts as 1."""
    from pyspark.sql.window import Window as W

    n = rows.groupBy(F.col(y).cast("int").alias("class")).agg(F.count("*").alias("n"))
    dim = rows.sparkSession.range(k).select(F.col("id").cast("int").alias("class"))
    full = dim.join(F.broadcast(n), "class", "left").select("class", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("n"))
    raw = 1 / F.sqrt("n") if scheme == "inverse_sqrt" else 1 / F.col("n")
    return full.withColumn("raw", raw).select("class", "n", (F.col("raw") / F.avg("raw").over(W.partitionBy())).alias("weight"))


def sampler_weights(rows: DataFrame, y: str = "y", known: str = "y >= 0") -> DataFrame:
    """rows with sample_weight: 1 / rows of its class, 0 for an unknown one."""
    n = rows.groupBy(y).agg(F.count("*").alias("_n"))
    return rows.join(n, y, "left").withColumn("sample_weight", F.when(F.expr(known), 1 / F.col("_n")).otherwise(0.0)).drop("_n")


def compare_models(rows: DataFrame) -> DataFrame:
    """rows(model, macro_f1, recalls array) with min_recall, best first."""
    return rows.withColumn("min_recall", F.array_min("recalls")).orderBy(F.desc("macro_f1"), "model")
