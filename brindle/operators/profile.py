"""Profiles of file listings, names, JSON keys and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brindle.functions import scalars as S
from brindle.operators.selection import quantiles

# The roles that keys may play and words that hint at them.
FIELD_HINTS = {
    "label": ("label", "class", "disease", "lesion", "질환", "증상", "라벨", "code", "diag"),
    "polygon": ("polygon", "poly", "segmentation", "points", "contour", "좌표"),
    "bbox": ("bbox", "box", "rect", "location", "region", "roi", "x1", "xmin"),
    "image_name": ("file", "image", "img", "name", "이미지", "파일"),
    "animal_id": ("pet", "animal", "individual", "subject", "id", "no", "번호", "개체", "환자", "chart"),
    "breed": ("breed", "species", "품종", "견종"),
    "age": ("age", "나이", "birth"),
    "camera": ("camera", "device", "카메라", "장비"),
    "width": ("width", "가로", "너비"),
    "height": ("height", "세로", "높이"),
}
AXIS_TOKENS = {
    "species": ("반려견", "반려묘", "dog", "cat"),
    "camera": ("일반카메라", "더모스코프", "microscope", "dermoscope"),
    "symptom": ("유증상", "무증상"),
    "split": ("Training", "Validation", "Test", "TS", "TL", "VS", "VL"),
    "class": ("A1", "A2", "A3", "A4", "A5", "A6", "A7"),
}
# Endings of images.
IMAGE_EXTENSIONS = ("bmp", "jpeg", "jpg", "png", "webp")


def top(df: DataFrame, k: int, by: list[str] | None = None, count: str = "n", tie: str = "value") -> DataFrame:
    """The k most common values of each group; equal counts in the order of the value."""
    if not by:
        return df.orderBy(F.desc(count), tie).limit(k)
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(count), tie))).filter(F.col("_r") <= k).drop("_r")


def extension_counts(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """extension, n, bytes."""
    return files.groupBy(S.extension(path).alias("extension")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def depth_segments(files: DataFrame, path: str = "path", k: int = 15) -> DataFrame:
    """depth, value, n: the commonest path segments at every depth."""
    parts = files.select(F.posexplode(F.filter(F.split(path, "/"), lambda s: s != "")).alias("depth", "value"))
    return top(parts.groupBy("depth", "value").agg(F.count("*").alias("n")), k, ["depth"])


def axis_hits(files: DataFrame, tokens: dict[str, tuple[str, ...]], path: str = "path") -> DataFrame:
    """axis, token, n: how many paths hold each token. One pass: every token is a conditional count."""
    pairs = [(a, t) for a, ts in tokens.items() for t in ts]
    one = files.agg(*(F.count_if(F.col(path).contains(t)).alias(f"c{k}") for k, (_, t) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(t).alias("token"), F.col(f"c{k}").alias("n")) for k, (a, t) in enumerate(pairs)))).alias("x")).select("x.*").filter("n > 0")


def has_normal(files: DataFrame, path: str = "path", token: str = S.NORMAL) -> DataFrame:
    return files.agg(F.coalesce(F.bool_or(F.col(path).contains(token)), F.lit(False)).alias("has_normal"))


def name_shapes(names: DataFrame, name: str, k: int = 10) -> DataFrame:
    """value (the shape), n."""
    return top(names.groupBy(S.name_shape(name).alias("value")).agg(F.count("*").alias("n")), k)


def class_counts(files: DataFrame, path: str = "path") -> DataFrame:
    code = F.nullif(F.regexp_extract(path, r"(?:^|[/\\_\-. ])(A[1-7])(?:$|[/\\_\-. ])", 1), F.lit(""))
    return files.groupBy(code.alias("class")).agg(F.count("*").alias("n"))


def id_token_candidates(names: DataFrame, name: str, least: int = 50, k: int = 5) -> DataFrame:
    """position, total, n_unique, ratio: name tokens that repeat like ids do."""
    token = names.select(F.posexplode(F.slice(F.split(name, r"[_\-.]"), 1, 8)).alias("position", "token")).filter("token <> ''")
    g = token.groupBy("position", "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("position").orderBy(F.desc("n"), "token"))
    s = g.withColumn("r", rank).groupBy("position").agg(F.sum("n").alias("total"), F.count("*").alias("n_unique"), F.min(F.when(F.col("r") <= 3, F.col("token").rlike("^A[1-7]$"))).alias("codes"))
    ok = s.filter((F.col("total") >= least) & (F.col("n_unique") >= 5) & (F.col("total") / F.col("n_unique") >= 2) & (F.col("n_unique") < F.col("total") / 2) & ~F.col("codes"))
    return ok.select("position", "total", "n_unique", F.round(F.col("total") / F.col("n_unique"), 6).alias("ratio")).orderBy(F.desc("n_unique"), "position").limit(k)


def key_profile(leaves: DataFrame, files: DataFrame, k: int = 120) -> DataFrame:
    """From flatten_json rows(id, path, type, value): path, freq (records per file), types, up to 3 examples."""
    n = files.agg(F.count("*").alias("files"))
    short = F.when(F.length("value") > 60, F.concat(F.substring("value", 1, 60), F.lit("..."))).otherwise(F.col("value"))
    by_type = leaves.groupBy("path", "type").agg(F.count("*").alias("n"), F.min(F.struct("id", short.alias("v"))).alias("e"))
    g = by_type.groupBy("path").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"), F.slice(F.array_sort(F.collect_list(F.when(F.col("type") != "NoneType", F.col("e")))), 1, 3)["v"].alias("examples"))
    return top(g.crossJoin(F.broadcast(n)).select("path", F.col("n"), (F.col("n") / F.col("files")).alias("freq"), "types", "examples"), k, tie="path")


def role_guess(profile: DataFrame, hints: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """From key_profile rows(path, freq, types, examples): role, path, score: the key that fits each role best; the first path
    among equals.

    A hint gives most where it is the leaf, less where it is in it, least where it is in the path; the sum is times freq. A key
    that any hint speaks for gains by the look of its values.
    """
    spark = profile.sparkSession
    table = spark.createDataFrame([(r, h.lower()) for r, hs in (hints or FIELD_HINTS).items() for h in hs], "role string, hint string")
    leaf = F.lower(F.substring_index("path", ".", -1))
    # Points of a hint, and what the look of values adds by role.
    points = F.when(leaf == F.col("hint"), 3.0).when(leaf.contains(F.col("hint")), 1.5).when(F.lower("path").contains(F.col("hint")), 0.5).otherwise(0.0)
    has = lambda *kinds: F.arrays_overlap("kinds", F.array(*map(F.lit, kinds)))
    role, shown = F.col("role"), F.array_join(F.coalesce("examples", F.array().cast("array<string>")), " ")
    looks = F.when(role.isin("width", "height") & has("int", "float"), 1.0).when((role == "polygon") & (has("list") | shown.rlike(r"\d+\s*,\s*\d+")), 1.5)
    looks = looks.when((role == "bbox") & has("int", "float", "list"), 1.0).when((role == "image_name") & shown.rlike(r"(?i)\.(jpg|jpeg|png)"), 3.0)
    looks = looks.when((role == "label") & shown.rlike(r"\bA[1-7]\b"), 3.0).when((role == "animal_id") & has("str", "int") & (F.length(shown) < 40), 0.5).otherwise(0.0)
    hit = profile.select("path", "freq", "examples", F.map_keys("types").alias("kinds")).crossJoin(F.broadcast(table))  # the hints
    scored = hit.groupBy("role", "path", "freq", "kinds", "examples").agg(F.sum(points).alias("s")).filter("s > 0")
    best = scored.groupBy("role").agg(F.min(F.struct((-(F.col("s") * F.col("freq") + looks)).alias("neg"), F.col("path").alias("path"))).alias("b"))
    return best.select("role", F.col("b.path").alias("path"), (-F.col("b.neg")).alias("score"))


def manifest_profile(rows: DataFrame, label: str, value: str) -> DataFrame:
    """label, n, share, value median; a null label is a row of its own."""
    half = quantiles(rows, value, {"median_value": 0.5}, [label]).select(F.col(label).alias("_label"), "median_value")
    g = rows.groupBy(label).agg(F.count("*").alias("n"))
    g = g.join(half, F.col(label).eqNullSafe(F.col("_label")), "left").select(label, "n", "median_value")
    return g.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def imbalance(rows: DataFrame, label: str) -> DataFrame:
    n = rows.filter(F.col(label).isNotNull()).groupBy(label).count()
    return n.agg((F.max("count") / F.min("count")).alias("imbalance"))


def null_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    one = rows.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate")) for c in columns))).alias("x")).select("x.*")


def id_sanity(rows: DataFrame, key: Column | str, least: float = 1.5) -> DataFrame:
    """One row: ids, rows per id, and whether that is too few for groups to mean anything."""
    k = F.col(key) if isinstance(key, str) else key
    r = F.count("*") / F.countDistinct(k)
    return rows.agg(F.countDistinct(k).alias("n_ids"), F.count("*").alias("n_rows"), r.alias("rows_per_id"), (r < least).alias("warn"))


def size_histogram(images: DataFrame, w: str = "width", h: str = "height") -> DataFrame:
    return images.groupBy(F.concat(F.col(w), F.lit("x"), F.col(h)).alias("value")).agg(F.count("*").alias("n"))


def key_uniques(leaves: DataFrame, k: int = 120) -> DataFrame:
    """From flatten_json rows(id, path, type, value): path, n, n_unique, rows_per_value, and whether the key may name individuals.

    Only text and numbers count. Fewest values first.
    """
    g = leaves.filter(F.col("type").isin("str", "int", "float")).groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_unique"))
    n = leaves.agg(F.countDistinct("id").alias("files"))
    per = F.col("files") / F.greatest("n_unique", F.lit(1))
    out = g.crossJoin(F.broadcast(n)).select("path", "n", "n_unique", per.alias("rows_per_value"), ((per >= 1.5) & (per <= 200) & (F.col("n_unique") > 3)).alias("may_be_id"))
    return out.orderBy("n_unique", "path").limit(k)


def diagnose(files: DataFrame, leaves: DataFrame, path: str = "path") -> dict[str, DataFrame]:
    """What to look at before a schema is settled: segments by depth, axes, distinct values of keys, coordinate keys, name shapes."""
    place = F.lower("path").rlike("box|poly|point|loca|coord|x|y|width|height|size")
    return {
        "segments": depth_segments(files, path, 12), "axes": axis_hits(files, AXIS_TOKENS, path), "keys": key_uniques(leaves),
        "geometry": leaves.filter(place).groupBy("path").agg(F.min("value").alias("least"), F.max("value").alias("most")),
        "shapes": name_shapes(files.select(S.stem(path).alias("name")), "name", 6), "tokens": id_token_candidates(files.select(S.stem(path).alias("name")), "name"),
    }
