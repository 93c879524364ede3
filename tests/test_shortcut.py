"""What a crop's scale tells: features by hand, and both stages above chance only where sizes tell."""

import math

from pyspark.sql import functions as F

from brindle.functions import geometry as G
from brindle.functions.scalars import CLASSES
from brindle.operators import shortcut

SCHEMA = "label string, x1 double, y1 double, x2 double, y2 double, img_w int, img_h int"


def with_box(df):
    return df.withColumn("bbox", F.when(F.col("x1").isNotNull(), G.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))))


def test_features(spark):
    rows = [("A1", 100.0, 50.0, 140.0, 60.0, 400, 200), ("A2", None, None, None, None, 300, 200), ("A3", 9.0, 9.0, 5.0, 20.0, 400, 200), (None, 1.0, 1.0, 3.0, 3.0, None, None)]
    df = with_box(spark.createDataFrame(rows, SCHEMA)).withColumn("synthetic", F.col("label") == "A1")
    a, b, c, d = shortcut.crop_features(df, "m1.5").collect()
    assert (a["area_ratio"], a["aspect"], a["win_side"], a["img_w"], a["synthetic"], a["n_lesion"]) == (400 / 80000, 4.0, 64.0, 400.0, 1.0, 0.0)
    assert math.isclose(a["log_area"], math.log(401)) and a["win_over_input"] == 64 / 224
    assert (b["area_ratio"], b["aspect"], b["win_side"]) == (0.0, 0.0, 200.0)
    assert (c["area_ratio"], c["aspect"]) == (0.0, 0.0)
    assert (d["img_w"], d["area_ratio"], d["win_side"], d["synthetic"]) == (1.0, 4.0, 0.0, 0.0)


def test_both_stages(spark):
    """Sides that grow with the class are found; those that a hash gives are not; too few rows give nulls."""
    base = spark.range(3000).withColumns({"c": F.pmod(F.xxhash64("id"), F.lit(7)).cast("int"), "fold": (F.col("id") % 5).cast("int"), "is_holdout": F.col("id") % 11 == 0, "img_w": F.lit(1000), "img_h": F.lit(1000)})
    base = base.withColumn("label", F.concat(F.lit("A"), F.col("c") + 1))
    side = {"told": 30.0 + 90 * F.col("c"), "chance": 30.0 + 90 * F.pmod(F.xxhash64("id", F.lit("x")), F.lit(7))}
    got = {k: shortcut.crop_baseline(base.withColumn("bbox", G.box(F.lit(10.0), F.lit(10.0), 10 + s, 10 + s)), "m1.5").first() for k, s in side.items()}
    assert got["told"]["stage1_auroc"] > 0.99 and got["told"]["stage2_macro_f1"] > 0.99 and set(got["told"]["stage2_recall"]) == set(CLASSES)
    assert abs(got["chance"]["stage1_auroc"] - 0.5) < 0.12 and got["chance"]["stage2_macro_f1"] < 0.3
    few = base.filter("id < 40 and c < 6").withColumn("bbox", F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>"))
    assert tuple(shortcut.crop_baseline(few, "full").first()) == (None, None, None)


def test_the_window_is_computed_once(spark):
    """Its sides are asked for by two features, and by every pass of a fit; the plan holds it once."""
    df = with_box(spark.createDataFrame([("A1", 1.0, 1.0, 9.0, 9.0, 40, 30)], SCHEMA)).withColumn("fold", F.lit(0))
    count = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("transform(")
    alone = count(df.select(G.crop_window("bbox", "img_w", "img_h", F.lit("m1.5"))))
    assert 0 < count(shortcut.crop_features(df, "m1.5").select("win_side", "win_over_input")) <= alone + 1
