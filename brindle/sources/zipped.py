"""A manifest from zip archives that are not unpacked: labels, images, paths and scope in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import json_walk, png
from brindle.functions import geometry as G
from brindle.functions import scalars as S
from brindle.operators import fallback
from brindle.operators import normalize as N
from brindle.operators.profile import IMAGE_EXTENSIONS
from brindle.session import Staged
from brindle.sources.zip_listing import listed, with_contents


def members(spark: SparkSession, path: str, suffixes: tuple[str, ...], contents: bool = True, include: list[list[str]] | None = None, exclude: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """zip_path, zip_member, length, content (null without contents) of the members with one of the suffixes.

    include, exclude: as in select_files; where: a predicate on zip_path, zip_member and length. Members that these leave out
    are not read. Archives are opened in tasks only; with contents, the job that lists them is run.
    """
    found = listed(spark, path, suffixes, include, exclude)
    found = found if where is None else found.filter(where)
    return with_contents(found) if contents else found.select("zip_path", "zip_member", "length", F.lit(None).cast("binary").alias("content"))


def manifest_from_zip(spark: SparkSession, path: str, id_token: int | None = None, dogs_only: bool = True, normal_camera_only: bool = True, **select: list) -> DataFrame:
    """The manifest of the archives at path (several with commas); an error if no record finds its image.

    Records of the confirmed schema are parsed by it, others by words in their keys. A record's image is the member of its
    name, or else of its stem, whose path shares most with that of the record, within the archive. select: include, exclude.
    """
    staged = Staged(spark)
    labels = members(spark, path, (".json",), **select).select("zip_path", F.concat_ws("!", "zip_path", "zip_member").alias("json_path"), F.decode("content", "utf-8").alias("json"))
    labels = staged.write(labels)
    pictures = staged.write(members(spark, path, tuple(f".{x}" for x in IMAGE_EXTENSIONS), contents=False, **select).select("zip_path", "zip_member"))
    sure = N.parse_records(labels)
    # records that the confirmed schema does not fit
    json_walk.register(spark)
    rest = labels.join(sure.select("json_path").distinct(), "json_path", "left_anti").withColumn("id", F.col("json_path"))
    entries = spark.sql("SELECT id, e.* FROM {rest}, LATERAL json_entries(json) e", rest=rest)
    guessed = fallback.extract(entries, rest.select("id", "json_path"), id_token).withColumnRenamed("id", "json_path").drop("record")
    rows = sure.withColumn("guessed", F.lit(False)).unionByName(guessed.withColumn("guessed", F.lit(True)), allowMissingColumns=True)
    named = F.coalesce("image_name", S.stem("json_path"))
    rows = staged.write(rows.withColumn("image_name", named).withColumn("archive", F.substring_index("json_path", "!", 1)))
    matched = N.match_images(rows, pictures.select(F.concat_ws("!", "zip_path", "zip_member").alias("image_path"), F.col("zip_path").alias("archive")), within=["archive"])
    side = lambda c: [x.alias(n) for x, n in zip(S.path_axes(c), ("species", "camera", "symptom", "src_split"), strict=True)]
    axes = {n: S.prefer(a, b) for n, a, b in zip(("species", "camera", "symptom", "src_split"), side("image_path"), side("json_path"), strict=True)}
    out = matched.withColumns(axes).withColumns({"zip_path": F.col("archive"), "zip_member": F.substring_index("image_path", "!", -1), "image_name": S.file_name("image_path")})
    quiet = F.col("symptom") == S.SYMPTOMS[1]
    out = out.withColumn("is_normal", F.when(F.col("guessed"), F.coalesce(quiet, F.lit(False))).otherwise(F.col("is_normal")))
    out = out.withColumn("area_ratio", F.coalesce("area_ratio", G.area_ratio("bbox", "img_w", "img_h"))).drop("archive", "guessed")
    out = staged.write(out)
    if out.isEmpty():
        raise ValueError(f"no record of {path} has an image")
    return N.drop_unlabeled(N.scope(out, "species_code", "D" if dogs_only else None, "camera", include=[S.CAMERAS[0]] if normal_camera_only else None))


def zip_pixels(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".png", ".jpg", ".jpeg", ".bmp", ".webp")) -> DataFrame:
    """path ('archive!member'), image(height, width, nChannels, data) of the images in archives; null for what can't be decoded.

    PNG of eight bits is decoded here; other formats need Pillow on the workers.
    """
    m = members(spark, path, suffixes)
    return m.select(F.concat_ws("!", "zip_path", "zip_member").alias("path"), png.decode_udf()("content").alias("image"))
