"""From raw label records and file listings to one manifest table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brindle.functions import geometry as G
from brindle.functions import scalars as S
from brindle.operators.matching import match_images  # noqa: F401  it belongs to the steps here


# Fixed values of the confirmed schema: keys 'Raw data ID', '합성유무' and the others named below.
def parse_records(records: DataFrame, text: str = "json", path: str = "json_path") -> DataFrame:
    """Label records of the confirmed schema, objects or arrays of them, to manifest columns.

    A byte-order mark is dropped; text that is no JSON, items that are no objects and records without metaData give no row.
    """
    v = records.select(F.col(path).alias("json_path"), F.try_parse_json(F.regexp_replace(text, "^﻿", "")).alias("v")).filter("v is not null")
    one = v.select("json_path", F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))).alias("v"))
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    meta = lambda k: get(f"$.metaData['{k}']")
    rec = one.filter(F.schema_of_variant(F.expr("try_variant_get(v, '$.metaData', 'variant')")).startswith("OBJECT"))
    items = F.filter(F.coalesce(get("$.labelingInfo", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    maps = lambda k: F.transform(F.col("items"), lambda x: F.coalesce(F.try_variant_get(x, f"$.{k}.location[0]", "map<string,string>"), F.try_variant_get(x, f"$.{k}.location", "map<string,string>")))
    rec = rec.withColumn("items", items)
    polys = F.filter(F.transform(F.filter(maps("polygon"), lambda m: m.isNotNull()), G.numbered_points), lambda p: F.size(p) >= 3)
    d = lambda m, k: F.element_at(m, F.lit(k)).try_cast("double")
    boxes = F.filter(F.transform(F.filter(maps("box"), lambda m: m.isNotNull()), lambda m: G.xywh_box(d(m, "x"), d(m, "y"), d(m, "width"), d(m, "height"))), lambda b: b.isNotNull())
    lesion = F.upper(F.trim(meta("lesions")))
    from_path = F.nullif(F.regexp_extract("json_path", r"(?:^|[/\\_\-. ])(A[1-7])(?:$|[/\\_\-. ])", 1), F.lit(""))
    out = rec.select(
        "json_path",
        S.file_name(F.nullif(F.trim(meta("Raw data ID")), F.lit(""))).alias("image_name"),
        F.when(lesion.rlike("^A[1-7]$"), lesion).otherwise(from_path).alias("label"),
        S.surrogate_id([meta(k) for k in ("species", "breed", "age", "gender", "date")]).alias("animal_id"),
        F.upper(F.trim(F.coalesce(meta("species"), F.lit("")))).alias("species_code"),
        *(meta(k).alias(k) for k in ("breed", "age", "gender", "region", "date")),
        (F.upper(F.trim(F.coalesce(meta("합성유무"), F.lit("")))) == "Y").alias("synthetic"),
        meta("Path").alias("symptom_meta"),
        F.get(polys, F.lit(0)).alias("polygon"), F.get(boxes, F.lit(0)).alias("box"),
        S.resolution(meta("resolution"), 1).alias("img_w"), S.resolution(meta("resolution"), 2).alias("img_h"),
        F.size("items").alias("n_lesion"),
    )
    out = out.withColumn("bbox", F.coalesce("box", F.when(F.col("polygon").isNotNull(), G.box_of_points("polygon")))).drop("box")
    return out.withColumn("is_normal", F.coalesce(F.col("label") == S.NORMAL, F.lit(False))).withColumn("area_ratio", G.area_ratio("bbox", "img_w", "img_h"))


def unparsed(records: DataFrame, text: str = "json") -> DataFrame:
    """One row: records that are no JSON, which parse_records leaves out."""
    return records.agg(F.count_if(F.col(text).isNotNull() & F.try_parse_json(F.regexp_replace(text, "^﻿", "")).isNull()).alias("n_unparsed"))


def scope(rows: DataFrame, species: str = "species_code", keep_species: str | None = "D", camera: str = "camera", include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows in scope. A filter applies only where the data has what it asks for: one pass looks for it first."""
    has = rows.agg(F.count(F.nullif(species, F.lit(""))).alias("s"), F.count_if(F.col(camera).isin(*(include or [""]))).alias("i")).first()
    if has["s"] and keep_species is not None:
        rows = rows.filter(F.col(species) == keep_species)
    if exclude:
        rows = rows.filter(F.col(camera).isNull() | ~F.col(camera).isin(*exclude))
    if include and has["i"]:
        rows = rows.filter(F.col(camera).isNull() | F.col(camera).isin(*include))
    return rows


def drop_unlabeled(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.filter(F.trim(F.col(label).cast("string")) != "")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each combination of those keys that rows has; nulls are equal."""
    present = [k for k in keys if k in rows.columns]
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*present).orderBy(*order))).filter("_r = 1").drop("_r")


def combine(chunks: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """All chunks by column name, a chunk's number in `chunk`, without repeats."""
    out = None
    for k, c in enumerate(chunks):
        c = c.withColumn("chunk", F.lit(k))
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    return keep_first(out, keys, ["chunk", *order])


def to_do(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Those of wanted whose key is not in done."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def coverage(rows: DataFrame, present: DataFrame, key: str, least: float = 0.95) -> float:
    """The share of rows whose key is present; an error below the least."""
    got = rows.join(present.select(key).distinct().withColumn("_here", F.lit(1)), key, "left").agg(F.avg(F.coalesce("_here", F.lit(0)).cast("double")).alias("c")).first()["c"]
    if got is not None and got < least:
        raise ValueError(f"only {got:.1%} of the files are there")
    return got


def within_budget(files: DataFrame, size: str, budget: float, order: list[str]) -> DataFrame:
    """The files, in order, until the first that would pass the budget."""
    from brindle.operators.prefix import running_sums

    return running_sums(files.withColumn("_size", F.coalesce(F.col(size), F.lit(0.0))), [F.col(c) for c in order], {"running": "_size"}).drop("_size").filter(F.col("running") <= budget)


def select_files(files: DataFrame, path: str, include: list[list[str]] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files that hold no excluded word and, for each axis of words that they speak of at all, an included one.

    include: axes, each a list [wanted, other, other ...]; a path with none of an axis' words is undecided and stays.
    """
    out = files
    for x in exclude or []:
        out = out.filter(~F.col(path).contains(x))
    for wanted, *others in include or []:
        other = F.lit(False)
        for o in others:
            other = other | F.col(path).contains(o)
        out = out.filter(F.col(path).contains(wanted) | ~other)
    return out


def fingerprint(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: n, and a digest of the rows in order of key. Equal content has equal digests."""
    line = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in [key, *columns])), 256)
    # digests of 65,536 blocks of keys, each in key order, then of those: no task gathers all rows' digests
    block = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 4)
    per = rows.select(block.alias("b"), F.col(key).alias("k"), line.alias("h")).groupBy("b").agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda s: s["h"])), 256).alias("h"), F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: s["h"])), 256).alias("fingerprint"))


def with_target(rows: DataFrame, classes: list[str], label: str = "label", path: str = "crop_path") -> DataFrame:
    """Rows that have a path, with y: the number of their class, -1 for any other label."""
    at = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("string"))
    return rows.filter(F.col(path).isNotNull()).withColumn("y", F.coalesce((at - 1).cast("int"), F.lit(-1)))
