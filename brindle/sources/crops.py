"""Crops of a manifest's images: cut, written once, joined back by key, and switched from one tag to another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import geometry as G
from brindle.functions import scalars as S
from brindle.session import Staged
from brindle.sources.crop_sink import save_crops


def crop_run(manifest: DataFrame, pixels: DataFrame, root: str, tag: str, min_px: int = 64, ending: str = ".png") -> tuple[DataFrame, DataFrame]:
    """The manifest with crop_path, crop_tag, crop_rel, without rows whose crop failed; and (image_path, error) of those.

    pixels(path, image): decoded images; only those that the manifest names are cut. A crop's name follows from its image's
    path, so an image of several rows is cut once, at the first of their windows, and rows join their result by path. The crops
    are written while this runs, under a commit. ending: of the crops' names, as in switch_tag.
    """
    staged = Staged(manifest.sparkSession)
    todo = manifest.select("image_path", G.crop_window("bbox", "img_w", "img_h", F.lit(tag), min_px).alias("window"))
    todo = todo.groupBy("image_path").agg(F.min("window").alias("window"))
    named = todo.join(pixels.select(F.col("path").alias("image_path"), "image"), "image_path", "left").withColumn("crop_rel", S.crop_path("image_path", F.lit(tag), ending))
    done = save_crops(named, root, staged)
    kept = manifest.drop("crop_path", "crop_tag", "crop_rel").join(done.filter("error is null").select("image_path", "crop_path", "crop_rel"), "image_path").withColumn("crop_tag", F.lit(tag))
    return kept, done.filter("error is not null").select("image_path", "error")


def switch_tag(manifest: DataFrame, files: DataFrame, root: str, tag: str, least: float = 0.95, allow_missing: bool = False, ending: str = ".png") -> DataFrame:
    """The manifest with the paths of another tag's crops; rows whose crop isn't among files(path) go.

    An error if fewer than `least` of the rows have theirs, unless missing ones are allowed. Runs the job that counts.
    """
    rel = S.crop_path("image_path", F.lit(tag), ending)
    moved = manifest.drop("crop_path", "crop_tag", "crop_rel").withColumn("crop_rel", rel).withColumn("crop_path", S.rebase(root, "crop_rel")).withColumn("crop_tag", F.lit(tag))
    there = files.select(F.regexp_replace("path", "^file:/+", "/").alias("crop_path")).distinct()
    kept = moved.join(there, "crop_path", "left_semi")
    n = moved.join(there.withColumn("_here", F.lit(1)), "crop_path", "left").agg(F.count("*").alias("n"), F.count("_here").alias("here")).first()
    if n["n"] and n["here"] < least * n["n"] and not allow_missing:
        raise FileNotFoundError(f"{n['here']} of {n['n']} crops of {tag} are there")
    return kept
