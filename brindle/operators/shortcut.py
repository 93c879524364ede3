"""What metadata alone can tell: a floor that a model on content has to beat."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import geometry as G
from brindle.functions.scalars import CLASSES, NORMAL, bucket
from brindle.functions.vectors import argmax
from brindle.operators.metrics import auroc, confusion, per_class, summary
from brindle.session import Staged, dealt

#: What a crop's scale alone shows, and all that is known without pixels.
SCALE = ["area_ratio", "log_area", "win_side", "win_over_input"]
FEATURES = {"scale_only": SCALE, "all": [*SCALE, "aspect", "img_w", "img_h", "n_lesion", "synthetic"]}


def _vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows.na.fill(0.0, features))


def _parts(rows: DataFrame, features: list[str], group: str) -> tuple[DataFrame, DataFrame]:
    v = _vectors(rows, features)
    fold = bucket(group, 5, "shortcut")
    return v.filter(fold != 0), v.filter(fold == 0)


def _scored(train: DataFrame, test: DataFrame, seed: int) -> DataFrame:
    """y and score of the test rows, by boosted trees."""
    model = GBTClassifier(labelCol="y", featuresCol="features", maxIter=10, maxDepth=3, seed=seed).fit(train)
    return model.transform(test).select(F.col("y"), F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def _predicted(train: DataFrame, test: DataFrame, seed: int) -> DataFrame:
    """y and pred of the test rows, by a forest with balanced class weights."""
    n = train.groupBy("y").count()
    weighted = train.join(F.broadcast(n), "y").withColumn("weight", 1.0 / F.col("count"))  # n: a row a class
    model = RandomForestClassifier(labelCol="y", featuresCol="features", weightCol="weight", numTrees=20, maxDepth=5, seed=seed).fit(weighted)
    return model.transform(test).select("y", argmax(vector_to_array("probability")).alias("pred"))


def shortcut_auroc(rows: DataFrame, features: list[str], group: str, seed: int = 42) -> DataFrame:
    """rows(y 0/1, features) to one row: the held-out AUROC of boosted trees. Groups don't cross the split."""
    train, test = _parts(rows, features, group)
    return auroc(_scored(train, test, seed)).select(F.round("auroc", 4).alias("auroc"))


def shortcut_macro_f1(rows: DataFrame, features: list[str], group: str, k: int, seed: int = 42) -> DataFrame:
    """rows(y 0..k-1, features) to one row: held-out metrics of a forest with balanced class weights."""
    train, test = _parts(rows, features, group)
    return summary(confusion(_predicted(train, test, seed), k))


def crop_features(rows: DataFrame, tag: Column | str, img_size: int = 224, min_px: int = 64) -> DataFrame:
    """rows(bbox, img_w, img_h) with the features of FEATURES; img_w and img_h as doubles, at least 1 where unknown.

    tag: a crop tag or a column of them. Without a box its sides are 0. n_lesion and synthetic are 0 where rows lack the columns.
    """
    tag = F.lit(tag) if isinstance(tag, str) else tag
    win = G.crop_window("bbox", "img_w", "img_h", tag, min_px)
    b = F.col("bbox")
    w, h = (F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0)) for c in ("img_w", "img_h"))
    bw, bh = (F.coalesce(F.greatest(b[f"{x}2"] - b[f"{x}1"], F.lit(0.0)), F.lit(0.0)) for x in "xy")
    side = F.coalesce(G.let(win, lambda v: F.least(v["x2"] - v["x1"], v["y2"] - v["y1"]).cast("double")), F.lit(0.0))
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0)
    return rows.withColumn("win_side", side).withColumns({
        "area_ratio": bw * bh / F.greatest(w * h, F.lit(1.0)), "log_area": F.log1p(bw * bh), "aspect": bw / F.greatest(bh, F.lit(1e-6)),
        "win_over_input": F.col("win_side") / F.lit(float(max(img_size, 1))), "img_w": w, "img_h": h, "n_lesion": known("n_lesion"), "synthetic": known("synthetic"),
    })


def crop_baseline(rows: DataFrame, tag: Column | str, fold: int = 0, features: str = "scale_only", classes: tuple[str, ...] = CLASSES, normal: str = NORMAL, seed: int = 42) -> DataFrame:
    """rows(label, fold, is_holdout, bbox, img_w, img_h) to one row: what both stages reach on a fold without a pixel.

    stage1_auroc: normal or not, null unless both are in both parts; stage2_macro_f1 and stage2_recall (a map by class) of the
    classes, null unless more than 50 rows of them are trained on and more than 20 tested. Hold-out rows take no part, null
    labels count as not normal. Trees are fitted while this is built.
    """
    if features not in FEATURES:
        raise KeyError(f"no features {features!r}, but {sorted(FEATURES)}")
    # written once: the window is a large expression, and every pass of a fit would plan, compile and compute it again
    dev = Staged(rows.sparkSession).write(crop_features(dealt(rows.filter(~F.col("is_holdout"))), tag).select("label", "fold", *FEATURES[features]))
    one = _vectors(dev.withColumn("y", (~F.col("label").eqNullSafe(F.lit(normal))).cast("int")), FEATURES[features])
    two = _vectors(dev.withColumn("y", F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("int") - 1).filter("y >= 0"), FEATURES[features])
    train, test = (lambda d: d.filter(F.col("fold") != fold)), (lambda d: d.filter(F.col("fold") == fold))
    tested, named = F.col("fold") == fold, F.col("label").isin(*classes)
    odd = ~F.col("label").eqNullSafe(F.lit(normal))
    n = dev.filter(F.col("fold").isNotNull()).agg(*(F.count_if(part & what).alias(f"{p}_{k}") for p, part in (("train", ~tested), ("test", tested)) for k, what in (("odd", odd), ("normal", ~odd), ("named", named)))).first()
    spark = rows.sparkSession
    out = spark.range(1).select(F.lit(None).cast("double").alias("stage1_auroc"), F.lit(None).cast("double").alias("stage2_macro_f1"), F.lit(None).cast("map<string,double>").alias("stage2_recall"))
    if min(n["train_odd"], n["train_normal"], n["test_odd"], n["test_normal"]):
        out = out.drop("stage1_auroc").crossJoin(auroc(_scored(train(one), test(one), seed)).select(F.col("auroc").alias("stage1_auroc")))  # one row each
    if n["train_named"] > 50 and n["test_named"] > 20:
        cells = confusion(_predicted(train(two), test(two), seed), len(classes))
        name = F.element_at(F.array(*map(F.lit, classes)), F.col("class").cast("int") + 1)
        recall = per_class(cells).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("k"), F.col("recall").alias("v"))))).alias("stage2_recall"))  # a row a class
        out = out.drop("stage2_macro_f1", "stage2_recall").crossJoin(summary(cells).select(F.col("macro_f1").alias("stage2_macro_f1"))).crossJoin(recall)
    return out.select("stage1_auroc", "stage2_macro_f1", "stage2_recall")
