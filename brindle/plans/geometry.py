"""Crop windows, boxes, polygons and their audits, on boxes derived from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import geometry as G
from brindle.functions import scalars as S
from brindle.operators import audit
from brindle.plans.registry import query
from brindle.session import table


def boxes(spark, sf: str) -> DataFrame:
    """k, ln, label, bbox (null for some), img_w, img_h: boxes that may leave the image."""
    x1, y1 = (F.col("l_partkey") * 7 % 1900 - 20).cast("double"), (F.col("l_suppkey") * 37 % 1060 - 10).cast("double")
    w, h = 20 + F.col("l_quantity") * 9, (15 + F.col("l_linenumber") * 45).cast("double")
    box = F.when(F.col("l_orderkey") % 11 != 0, G.box(x1, y1, x1 + w, y1 + h))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.concat(F.lit("A"), F.col("l_linenumber")).alias("label"), box.alias("bbox"), F.lit(1920).alias("img_w"), F.lit(1080).alias("img_h"))


_BOX = """b AS (SELECT l_orderkey AS k, l_linenumber AS ln, 'A' || l_linenumber AS label, l_orderkey % 11 <> 0 AS has, (l_partkey * 7 % 1900 - 20)::DOUBLE AS x1, (l_suppkey * 37 % 1060 - 10)::DOUBLE AS y1,
 (l_partkey * 7 % 1900 - 20)::DOUBLE + 20 + l_quantity * 9 AS x2, (l_suppkey * 37 % 1060 - 10)::DOUBLE + 15 + l_linenumber * 45 AS y2, 1920 AS iw, 1080 AS ih FROM lineitem)"""


def _slide(low: str, high: str, size: str) -> tuple[str, str]:
    """An interval moved inside, as SQL."""
    h1 = f"(CASE WHEN {low} < 0 THEN {high} - ({low}) ELSE {high} END)"
    l1 = f"greatest({low}, 0)"
    l2 = f"(CASE WHEN {h1} > {size} THEN {l1} - ({h1} - {size}) ELSE {l1} END)"
    return f"greatest(trunc({l2})::INT, 0)", f"least(round_even(least({h1}, {size}), 0)::INT, {size})"


def _square(side: str, x: str = "(x1 + x2) / 2", y: str = "(y1 + y2) / 2") -> str:
    (a, c), (b, d) = _slide(f"({x} - {side} / 2)", f"({x} + {side} / 2)", "iw"), _slide(f"({y} - {side} / 2)", f"({y} + {side} / 2)", "ih")
    return f"{a} AS wx1, {b} AS wy1, {c} AS wx2, {d} AS wy2"


_EXPAND = "greatest(greatest(x2 - x1, y2 - y1, 1.0::DOUBLE) * 1.5::DOUBLE, 64.0::DOUBLE)"
_FIXED = "320.0::DOUBLE"
_FLAT = ("x1", "y1", "x2", "y2")


def flat(df: DataFrame, *keep: str) -> DataFrame:
    """The window's corners as columns."""
    return df.select(*keep, *(F.col(f"w.{c}").alias(f"w{c}") for c in _FLAT))



@query(f"WITH {_BOX} SELECT k, ln, {_square(_EXPAND)} FROM b WHERE has")
def expand_box(spark, sf):
    return flat(boxes(spark, sf).filter("bbox is not null").select("k", "ln", G.expand_box("bbox", "img_w", "img_h", 1.5).alias("w")), "k", "ln")


@query(f"WITH {_BOX} SELECT k, ln, {_square(_FIXED, '(CASE WHEN has THEN (x1 + x2) / 2 ELSE 960 END)', '(CASE WHEN has THEN (y1 + y2) / 2 ELSE 540 END)')} FROM b")
def fixed_box(spark, sf):
    return flat(boxes(spark, sf).select("k", "ln", G.fixed_box("bbox", "img_w", "img_h", 320).alias("w")), "k", "ln")


def windows(spark, sf: str) -> DataFrame:
    b = boxes(spark, sf).withColumn("crop_tag", F.element_at(F.array(*map(F.lit, ("full", "m1.5", "f320"))), (F.col("k") % 3 + 1).cast("int")))
    return b.withColumn("w", G.crop_window("bbox", "img_w", "img_h", "crop_tag"))


_ANY = f"""WITH {_BOX}, t AS (SELECT *, ['full', 'm1.5', 'f320'][k % 3 + 1] AS tag FROM b),
u AS (SELECT *, CASE WHEN tag = 'f320' THEN 320.0::DOUBLE ELSE {_EXPAND} END AS side, CASE WHEN has THEN (x1 + x2) / 2 ELSE 960 END AS cx, CASE WHEN has THEN (y1 + y2) / 2 ELSE 540 END AS cy, tag = 'full' OR (tag = 'm1.5' AND NOT has) AS centre FROM t),
v AS (SELECT *, {_square("side", "cx", "cy")} FROM u),
win AS (SELECT k, ln, label, has, x1, y1, x2, y2, tag, CASE WHEN centre THEN 420 ELSE wx1 END AS wx1, CASE WHEN centre THEN 0 ELSE wy1 END AS wy1, CASE WHEN centre THEN 1500 ELSE wx2 END AS wx2, CASE WHEN centre THEN 1080 ELSE wy2 END AS wy2 FROM v)"""


@query(f"{_ANY} SELECT k, ln, tag AS crop_tag, wx1, wy1, wx2, wy2 FROM win")
def crop_window(spark, sf):
    return flat(windows(spark, sf), "k", "ln", "crop_tag")


@query(f"""{_ANY}, s AS (SELECT *, CASE WHEN has THEN greatest(x2 - x1, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS bw, CASE WHEN has THEN greatest(y2 - y1, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS bh, least(wx2 - wx1, wy2 - wy1)::DOUBLE AS side FROM win)
SELECT k, ln, tag AS crop_tag, round(bw * bh / (1920.0::DOUBLE * 1080.0::DOUBLE), 6) AS area_ratio, round(ln(1 + bw * bh), 6) AS log_area, round(bw / greatest(bh, 1e-6::DOUBLE), 6) AS aspect, side AS win_side, round(side / 224.0::DOUBLE, 6) AS win_over_input FROM s""")
def shortcut_crop_features(spark, sf):
    """What a crop tells of its label without a pixel, for every box."""
    from brindle.operators.shortcut import crop_features

    f = crop_features(windows(spark, sf), F.col("crop_tag"))
    return f.select("k", "ln", "crop_tag", *(F.round(c, 6).alias(c) for c in ("area_ratio", "log_area", "aspect")), "win_side", F.round("win_over_input", 6).alias("win_over_input"))


@query()
def shortcut_crop_baseline(spark, sf):
    """Both stages by crop features on a given fold; heights follow labels here, so it is far above chance (tests hold it there)."""
    from brindle.operators.shortcut import crop_baseline

    b = boxes(spark, sf).withColumns({"fold": S.bucket("k", 5, "shortcut"), "is_holdout": S.bucket("k", 10, "holdout") == 0})
    r = crop_baseline(b, "m1.5")
    return r.select(F.round("stage1_auroc", 4).alias("stage1_auroc"), F.round("stage2_macro_f1", 4).alias("stage2_macro_f1"), "stage2_recall")


def _clip(v: str) -> str:
    return f"least(greatest({v}, 0.0::DOUBLE), 1.0::DOUBLE)"


@query(f"""{_ANY}, r AS (SELECT k, ln, {_clip("(x1 - wx1) / (wx2 - wx1)")} AS rx1, {_clip("(y1 - wy1) / (wy2 - wy1)")} AS ry1, {_clip("(x2 - wx1) / (wx2 - wx1)")} AS rx2, {_clip("(y2 - wy1) / (wy2 - wy1)")} AS ry2 FROM win WHERE has)
SELECT k, ln, round(rx1, 6) AS rx1, round(ry1, 6) AS ry1, round(rx2, 6) AS rx2, round(ry2, 6) AS ry2 FROM r WHERE rx2 > rx1 AND ry2 > ry1""")
def geometry_in_crop(spark, sf):
    r = windows(spark, sf).select("k", "ln", G.bbox_in_crop("bbox", "w").alias("r")).filter("r is not null")
    return r.select("k", "ln", *(F.round(f"r.{c}", 6).alias(f"r{c}") for c in ("x1", "y1", "x2", "y2")))


@query(f"""WITH {_BOX}, v AS (SELECT label, greatest(least(x2, 1500) - greatest(x1, 420), 0) * greatest(least(y2, 1080) - greatest(y1, 0), 0) / greatest((x2 - x1) * (y2 - y1), 1e-9::DOUBLE) AS v FROM b WHERE has)
SELECT count(*) AS n, round(avg((v >= 0.9)::INT), 6) AS fully_visible, round(avg((v > 0.1 AND v < 0.9)::INT), 6) AS partial, round(avg((v <= 0.1)::INT), 6) AS mostly_gone, round(median(v), 6) AS median_visible,
 round(coalesce(avg((v <= 0.1)::INT) FILTER (label <> 'A7'), 0), 6) AS lesion_mostly_gone, round(1 - coalesce(avg((v <= 0.1)::INT) FILTER (label <> 'A7'), 0), 6) AS recall_ceiling FROM v""")
def crop_visibility_loss(spark, sf):
    r = audit.visibility_loss(boxes(spark, sf), "full")
    return r.select("n", *(F.round(c, 6).alias(c) for c in r.columns if c != "n"))


@query(f"""WITH {_BOX}, o AS (SELECT greatest(-x1, -y1, x2 - iw, y2 - ih, 0) AS over, ih, x2 <= x1 OR y2 <= y1 AS inv FROM b WHERE has), g AS (SELECT count(*) AS n, count(*) FILTER (over > 1 OR inv) AS n_bad, coalesce(max(over) FILTER (over > 1 OR inv), 0)::DOUBLE AS worst, median(ih) AS h FROM o)
SELECT n, n_bad, worst AS worst_overflow, n_bad / n::DOUBLE AS share, worst / h AS relative, CASE WHEN n_bad = 0 THEN 'clean' WHEN n_bad / n::DOUBLE < 0.01 AND worst / h < 0.3 THEN 'labeller' ELSE 'convention' END AS verdict FROM g""")
def box_bounds_audit(spark, sf):
    return audit.box_audit(boxes(spark, sf))


@query(f"""WITH {_BOX}, e AS (SELECT {_square(_EXPAND)} FROM b WHERE has), c AS (SELECT least(wx2 - wx1, wy2 - wy1) AS s FROM e UNION ALL SELECT 1080 FROM b WHERE NOT has)
SELECT count(*) AS n, quantile_cont(s, 0.25) AS p25, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.75) AS p75, avg((s < 224)::INT) AS upscaled, avg((s < 224)::INT) > 0.5 AS too_small FROM c""")
def window_sizes(spark, sf):
    return audit.window_sizes(boxes(spark, sf), "m1.5")


@query("""SELECT p_partkey, (p_size + 3.0::DOUBLE) * (p_size + 5) - 0.5::DOUBLE * (p_size + 3) * (p_size + 5) / 2 - 0 AS area, least(greatest((p_size + 3.0::DOUBLE) * (p_size + 5), 0) / (100 * 80), 1.0) AS box_ratio FROM part""")
def polygon_shoelace(spark, sf):
    # a rectangle with the corner opposite the origin cut half-way: three quarters of it
    a, b = F.col("p_size") + 3.0, F.col("p_size") + 5.0
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    z = F.lit(0.0)
    poly = F.array(pt(z, z), pt(a, z), pt(a, b / 2), pt(a / 2, b / 2), pt(a / 2, b), pt(z, b))
    rows = table(spark, sf, "part").select("p_partkey", poly.alias("poly"))
    return rows.select("p_partkey", G.shoelace("poly").alias("area"), G.area_ratio(G.box_of_points("poly"), F.lit(100), F.lit(80)).alias("box_ratio"))


@query("""SELECT p_partkey, len(list_filter([1, 2, 3], lambda i: i <= p_size % 4)) AS n, (CASE WHEN p_size % 4 >= 1 THEN 1.0 + p_size END)::DOUBLE AS first_x FROM part""")
def numbered_points(spark, sf):
    keys = [(f"x{i}", F.col("p_size") + float(i)) for i in (1, 2, 3)] + [(f"y{i}", F.col("p_size") * float(i)) for i in (1, 2, 3)]
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in keys))
    m = F.map_from_entries(F.filter(entries, lambda e: F.substring(e["key"], 2, 1).cast("int") <= F.col("p_size") % 4))
    pts = table(spark, sf, "part").select("p_partkey", G.numbered_points(m).alias("p"))
    return pts.select("p_partkey", F.size("p").cast("long").alias("n"), F.get("p", F.lit(0))["x"].alias("first_x"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 1.5 ELSE 0 END::DOUBLE AS margin, CASE p_size % 3 WHEN 1 THEN 320 ELSE 0 END AS fixed_px FROM part""")
def crop_tags(spark, sf):
    tag = F.element_at(F.array(*map(F.lit, ("m1.5", "f320", "full"))), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", S.margin_of_tag(tag).alias("margin"), S.fixed_of_tag(tag).alias("fixed_px"))


@query(f"""WITH {_BOX}, c AS (SELECT k, ln, x1, y1, x2, y2, {_square(_EXPAND)} FROM b WHERE has)
SELECT round(avg(greatest(least(x2, wx2) - greatest(x1, wx1), 0) * greatest(least(y2, wy2) - greatest(y1, wy1), 0) / greatest((x2 - x1) * (y2 - y1), 1e-9::DOUBLE)), 6) AS visible, count(*) AS n FROM c""")
def mean_visibility(spark, sf):
    b = boxes(spark, sf).filter("bbox is not null")
    return b.agg(F.round(F.avg(G.visibility("bbox", G.expand_box("bbox", "img_w", "img_h", 1.5))), 6).alias("visible"), F.count("*").alias("n"))


@query("""SELECT vec_id, round((sum(h) FILTER (i % 8 >= 2 AND i % 8 < 6 AND i // 8 >= 2 AND i // 8 < 6)) / sum(h) / 0.25, 6) AS lift FROM (SELECT vec_id, i - 1 AS i, abs(embedding[i]::DOUBLE) AS h FROM embeddings, unnest(range(1, 65)) u(i)) GROUP BY vec_id""")
def heat_overlap(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("heat"), F.lit(8).alias("w"), G.box(F.lit(0.25), F.lit(0.25), F.lit(0.75), F.lit(0.75)).alias("bbox"))
    return audit.overlap_score(e).select("vec_id", F.round("lift", 6).alias("lift"))


@query(f"""WITH {_BOX}, v AS (SELECT label, greatest(least(x2, 1500) - greatest(x1, 420), 0) * greatest(least(y2, 1080) - greatest(y1, 0), 0) / greatest((x2 - x1) * (y2 - y1), 1e-9::DOUBLE) AS v FROM b WHERE has)
SELECT label, count(*) AS n, round(avg((v <= 0.1)::INT), 6) AS mostly_gone, round(median(v), 6) AS median_visible FROM v GROUP BY 1""")
def visibility_by_label(spark, sf):
    return audit.visibility_by_label(boxes(spark, sf), "full").select("label", "n", F.round("mostly_gone", 6).alias("mostly_gone"), F.round("median_visible", 6).alias("median_visible"))


@query(f"""WITH {_BOX}, r AS (SELECT k, ln, {_clip("x1 / iw")} AS rx1, {_clip("y1 / ih")} AS ry1, {_clip("x2 / iw")} AS rx2, {_clip("y2 / ih")} AS ry2 FROM b WHERE has)
SELECT k, ln, round(rx1, 10) AS rx1, round(ry1, 10) AS ry1, round(rx2, 10) AS rx2, round(ry2, 10) AS ry2 FROM r WHERE rx2 > rx1 AND ry2 > ry1""")
def box_in_image(spark, sf):
    r = boxes(spark, sf).select("k", "ln", G.box_in_image("bbox", "img_w", "img_h").alias("r")).filter("r is not null")
    return r.select("k", "ln", *(F.round(f"r.{c}", 10).alias(f"r{c}") for c in ("x1", "y1", "x2", "y2")))


@query("SELECT p_partkey, p_size::DOUBLE AS x1, p_size + 0.5::DOUBLE AS y1, p_size + 3.0::DOUBLE AS x2, p_size + 4.5::DOUBLE AS y2 FROM part WHERE p_size % 5 <> 0")
def box_of_corner_and_size(spark, sf):
    s = F.col("p_size")
    b = G.xywh_box(s.cast("double"), s + 0.5, F.when(s % 5 != 0, F.lit(3.0)), F.lit(4.0))
    return table(spark, sf, "part").select("p_partkey", b.alias("b")).filter("b is not null").select("p_partkey", "b.*")


@query("""WITH s AS (SELECT n_chars / 7919.0::DOUBLE AS r, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT count(*) AS n, """ + ", ".join(f"round(max(r) FILTER (i = least(floor(n * {p}::DOUBLE), n - 1)), 4) AS p{round(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + """, round(avg((r < 0.05)::INT), 3) AS under_5pct, round(avg((r < 0.01)::INT), 3) AS under_1pct FROM s""")
def area_profile(spark, sf):
    return audit.area_profile(table(spark, sf, "documents").select((F.col("n_chars") / 7919.0).alias("area_ratio")))


_SHARP = "s AS (SELECT 'A' || (label % 7 + 1) AS label, abs(embedding[1]::DOUBLE) * 900 AS v FROM embeddings)"


def _sharp(spark, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.concat(F.lit("A"), (F.col("label") % 7 + 1).cast("string")).alias("label"), (F.abs(F.element_at("embedding", 1).cast("double")) * 900).alias("sharpness"))


@query(f"WITH {_SHARP} SELECT label, count(*) AS n, round(median(v), 6) AS median, round(avg((v < 100)::INT), 6) AS share_blurry FROM s GROUP BY 1")
def sharpness_by_label(spark, sf):
    return audit.sharpness_by_label(_sharp(spark, sf)).select("label", "n", F.round("median", 6).alias("median"), F.round("share_blurry", 6).alias("share_blurry"))


@query(f"""WITH {_SHARP}, m AS (SELECT label, median(v) AS m FROM s GROUP BY 1), r AS (SELECT max(m) FILTER (label = 'A7') / greatest(median(m) FILTER (label <> 'A7'), 1e-9::DOUBLE) AS r FROM m)
SELECT round(median(v), 6) AS median, round(avg((v < 100)::INT), 6) AS share_blurry, round(any_value(r), 6) AS normal_over_lesion, any_value(r) > 1.6 OR any_value(r) < 0.62 AS uneven, avg((v < 100)::INT) > 0.3 AS many_blurry FROM s, r""")
def sharpness_audit(spark, sf):
    a = audit.sharpness_audit(_sharp(spark, sf))
    return a.select(*(F.round(c, 6).alias(c) for c in a.columns[:3]), "uneven", "many_blurry")
