"""What label records of an unknown schema say, found by words in their keys.

Input are the rows of the table function json_entries (see json_walk), every key of a record with what it holds. Each
column is the first fitting entry, shallow ones first: one aggregation over all entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import geometry as G
from brindle.functions import points as PT
from brindle.functions import scalars as S

# Words in keys that hint at a role, and the pattern of class codes.
NAME_WORDS = ("file", "image", "img", "이미지", "파일")
LABEL_WORDS = ("label", "class", "질환", "증상", "라벨", "disease", "lesion", "code")
ID_WORDS = ("pet_id", "petid", "animal_id", "animalid", "개체", "환자", "chart", "subject")
OTHER_ID_WORDS, NO_ID_WORDS = ("_id", "id_"), ("image", "file", "label", "ann")
WIDTH_WORDS, HEIGHT_WORDS = ("width", "가로", "너비"), ("height", "세로", "높이")
POLYGON_WORDS = ("polygon", "segmentation", "contour")
BOX_WORDS, PLACE_WORDS = ("bbox", "box", "rect", "roi"), ("location", "region")
CODE = r"\b(A[1-6])\b"
CODE_IN_PATH = r"(?:^|[/_\\-])(A[1-6])(?:[_/\\-]|$)"


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _first(words: tuple[str, ...], fits: Column, without: tuple[str, ...] = ()) -> Column:
    """The value of the first entry whose key holds a word, and no key above it or itself one of `without`."""
    key = F.lower(F.substring_index("path", ".", -1))
    ok = _holds(key, words) & fits
    if without:
        ok = ok & ~_holds(F.lower("path"), without)
    return F.min(F.when(ok, F.struct("ord", "value")))["value"]


def extract(entries: DataFrame, paths: DataFrame | None = None, id_token: int | None = None) -> DataFrame:
    """entries(id, record, path, ord, type, value) to id, record, image_name, label, animal_id, img_w, img_h, bbox, polygon.

    paths(id, json_path) gives the label that the record lacks. id_token: the part of the image's name that stands for the
    individual where no key does. What isn't found is null.
    """
    filled = F.col("value").isNotNull() & ~F.col("value").isin("", "[]", "{}")
    number = F.col("type").isin("int", "float")
    held = F.col("type").isin("list", "dict") & filled
    found = entries.groupBy("id", "record").agg(
        F.trim(_first(NAME_WORDS, (F.col("type") == "str") & (F.trim("value") != ""))).alias("name"), _first(LABEL_WORDS, filled).alias("said"),
        _first(ID_WORDS, filled).alias("own_id"), _first(OTHER_ID_WORDS, filled, NO_ID_WORDS).alias("any_id"),
        _first(WIDTH_WORDS, number).alias("w"), _first(HEIGHT_WORDS, number).alias("h"),
        _first(POLYGON_WORDS, held).alias("poly"), F.coalesce(_first(BOX_WORDS, held), _first(PLACE_WORDS, held)).alias("box"),
    )
    if paths is not None:
        found = found.join(paths.select("id", "json_path"), "id", "left")
    else:
        found = found.withColumn("json_path", F.lit(None).cast("string"))
    code = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    is_file = F.col("name").rlike(r"(?i)\.(jpg|jpeg|png|bmp|webp)$")
    plain = (F.length("name") > 3) & (F.length("name") < 120) & ~F.col("name").contains("/")
    found = found.withColumn("image_name", F.when(is_file, S.file_name("name")).when(plain, F.col("name")))
    token = F.lit(None).cast("string") if id_token is None else F.get(F.split(S.stem("image_name"), r"[_\-.]"), F.lit(id_token))
    size = lambda c: F.when(F.col(c).cast("double") > 1, F.col(c).cast("double").cast("int"))
    polygon, corners = PT.as_xy("poly"), PT.as_xy("box")
    out = found.select("id", "record", "image_name", F.coalesce(code("said", CODE), code("json_path", CODE_IN_PATH)).alias("label"), F.coalesce("own_id", "any_id", token).alias("animal_id"), size("w").alias("img_w"), size("h").alias("img_h"), corners.alias("corners"), polygon.alias("polygon"))
    out = out.withColumn("polygon", F.when(F.size("polygon") >= 3, F.col("polygon")))
    box = F.coalesce(F.when(F.size("corners") >= 2, G.box_of_points("corners")), G.box_of_points("polygon"))
    return out.select("id", "record", "image_name", "label", "animal_id", "img_w", "img_h", box.alias("bbox"), "polygon")
