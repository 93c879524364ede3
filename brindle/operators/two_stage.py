"""Two-stage classifiers: a screen (normal or not) and a kind. Classes 0..k-1 are kinds, k is normal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.functions.scalars import ABNORMAL, CLASSES, NORMAL
from brindle.operators.metrics import confusion, per_class, summary


def to_stage1(rows: DataFrame, label: str = "label", normal: str = NORMAL) -> DataFrame:
    """label to normal or ABNORMAL, the old one in label_orig; the split stays. A null label is ABNORMAL."""
    return rows.withColumn("label_orig", F.col(label)).withColumn(label, F.when(F.col(label) == normal, F.lit(normal)).otherwise(F.lit(ABNORMAL)))


def to_stage2(rows: DataFrame, label: str = "label", classes: tuple[str, ...] = CLASSES) -> DataFrame:
    return rows.filter(F.col(label).isin(*classes))


def binary_target(y: str, normal: int) -> Column:
    return F.when(F.col(y) == normal, 0).otherwise(1)


def predict(rows: DataFrame, s1: str = "s1", p2: str = "p2", threshold: float = 0.5) -> DataFrame:
    """rows with pred and conf: the kind where the screen's score reaches the threshold, else normal (the number of kinds)."""
    hit = F.col(s1) >= threshold
    return rows.withColumn("pred", F.when(hit, V.argmax(p2)).otherwise(F.size(p2))).withColumn("conf", F.when(hit, F.col(s1) * F.array_max(p2)).otherwise(1 - F.col(s1)))


def join_stages(stage1: DataFrame, stage2: DataFrame, key: str) -> DataFrame:
    """Scores of both stages by key; an error if a key is missing on either side."""
    both = stage1.join(stage2, key, "full_outer")
    gap = both.agg(F.count_if(F.col("s1").isNull() | F.col("p2").isNull()).alias("gap")).first()["gap"]
    if gap:
        raise ValueError(f"{gap} keys have only one of the two stages")
    return both


def unknown_labels(rows: DataFrame, known: list, label: str = "y") -> DataFrame:
    return rows.filter(F.col(label).isNotNull() & ~F.col(label).isin(*known)).select(label).distinct()


def report(rows: DataFrame, kinds: int, y: str = "y") -> DataFrame:
    """One row over predict()'s output: what the screen misses and what is left right. Unknown labels are an error."""
    if not unknown_labels(rows, list(range(kinds + 1)), y).isEmpty():
        raise ValueError("labels that the classifier does not know")
    lesion, said = F.col(y) != kinds, F.col("pred") != kinds
    rates = rows.agg(
        F.count("*").alias("n"),
        (F.count_if(lesion & ~said) / F.greatest(F.count_if(lesion), F.lit(1))).alias("missed_rate"),
        (F.count_if(~lesion & said) / F.greatest(F.count_if(~lesion), F.lit(1))).alias("false_alarm_rate"),
        (F.count_if(lesion & said & (F.col("pred") == F.col(y))) / F.nullif(F.count_if(lesion & said), F.lit(0))).alias("kind_accuracy"),
        F.avg("conf").alias("mean_conf"),
    )
    return rates.crossJoin(summary(confusion(rows, kinds + 1, y)).select("accuracy", "macro_f1"))


def report_classes(rows: DataFrame, kinds: int, y: str = "y") -> DataFrame:
    return per_class(confusion(rows, kinds + 1, y))


def product_estimate(stage1: DataFrame, stage2: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: recall of stage1(s1, y) times accuracy of stage2(p2, y), which is optimistic."""
    a = stage1.agg((F.count_if((F.col("y") == 1) & (F.col("s1") >= threshold)) / F.nullif(F.count_if(F.col("y") == 1), F.lit(0))).alias("recall"))
    b = stage2.agg(F.avg((V.argmax("p2") == F.col("y")).cast("double")).alias("kind_accuracy"))
    return a.crossJoin(b).select("recall", "kind_accuracy", (F.col("recall") * F.col("kind_accuracy")).alias("estimate"))


def engine(rows: DataFrame, s1: str = "s1", p2: str = "p2", threshold: float = 0.5, k: int = 3, abstain_below: float = 0.45) -> DataFrame:
    """rows with topk (class, p), abstain, band: kinds scaled by the screen's score; a normal verdict never abstains."""
    hit = F.col(s1) >= threshold
    kinds = F.transform(V.top_k(p2, k), lambda t: F.struct(t["class"].alias("class"), (t["p"] * F.col(s1)).alias("p")))
    normal = F.array(F.struct(F.size(p2).alias("class"), (1 - F.col(s1)).alias("p")))
    top = F.when(hit, kinds).otherwise(normal)
    return rows.withColumn("topk", top).withColumn("abstain", hit & (F.col("topk")[0]["p"] < abstain_below)).withColumn("band", V.band(F.col("topk")[0]["p"]))


def gate(value: float | None, stop: float, warn: float, name: str) -> str:
    """'pass' or 'warn'; at the stop line or below, or without a value, an error."""
    if value is None or value <= stop:
        raise ValueError(f"{name} {value} is not above {stop}")
    return "warn" if value < warn else "pass"


def gate_stage1(auroc: float | None) -> str:
    return gate(auroc, 0.70, 0.80, "AUROC")


def gate_stage2(macro_f1: float | None) -> str:
    return gate(macro_f1, 0.20, 0.25, "macro-F1")
