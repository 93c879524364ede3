"""Scalar expressions: hashes, names, paths, sizes, keys. All stay inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path tokens of the axes, in order of precedence.
SPECIES = ("반려견", "반려묘")
CAMERAS = ("일반카메라", "더모스코프")
SYMPTOMS = ("유증상", "무증상")
#: src_split -> words, then a pattern that needs a separator before it.
SPLITS = {"train": ("Training", r"[/\\](TS|TL)[0-9]"), "val": ("Validation", r"[/\\](VS|VL)[0-9]")}
CLASSES = ("A1", "A2", "A3", "A4", "A5", "A6")
NORMAL = "A7"
ABNORMAL = "ABNORMAL"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bucket(key: Column | str, n: int, salt: str = "") -> Column:
    """A stable bucket in [0, n): the first 32 bits of md5(salt + key), modulo n."""
    digest = F.md5(F.concat(F.lit(salt), _c(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def axis(path: Column | str, tokens: tuple[str, ...]) -> Column:
    """The first of the tokens that path contains, else null."""
    out = F.lit(None).cast("string")
    for t in reversed(tokens):
        out = F.when(_c(path).contains(t), F.lit(t)).otherwise(out)
    return out


def src_split(path: Column | str, splits: dict[str, tuple[str, str]] = SPLITS) -> Column:
    out = F.lit(None).cast("string")
    for name, (word, pattern) in reversed(splits.items()):
        out = F.when(_c(path).contains(word) | _c(path).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def path_axes(path: Column | str) -> list[Column]:
    """species, camera, symptom, src_split of a path."""
    return [axis(path, SPECIES).alias("species"), axis(path, CAMERAS).alias("camera"), axis(path, SYMPTOMS).alias("symptom"), src_split(path).alias("src_split")]


def prefer(first: Column | str, second: Column | str) -> Column:
    """first, unless it is null or empty."""
    return F.coalesce(F.nullif(_c(first), F.lit("")), _c(second))


def resolution(text: Column | str, which: int) -> Column:
    """Width (1) or height (2) of '1920X1080'; null if the text isn't one."""
    return F.nullif(F.regexp_extract(_c(text), r"^\s*([0-9]+)\s*[xX*×]\s*([0-9]+)\s*$", which), F.lit("")).cast("int")


def surrogate_id(parts: list[Column | str]) -> Column:
    """'G_' and the trimmed parts joined by '|'; a missing part is empty."""
    return F.concat(F.lit("G_"), F.concat_ws("|", *(F.coalesce(F.trim(_c(p).cast("string")), F.lit("")) for p in parts)))


def name_shape(name: Column | str) -> Column:
    """Runs of digits to '#', then runs of letters to 'L'."""
    return F.regexp_replace(F.regexp_replace(_c(name), "[0-9]+", "#"), "[A-Za-z]+", "L")


def file_name(path: Column | str) -> Column:
    return F.substring_index(F.replace(_c(path), F.lit("\\"), F.lit("/")), "/", -1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))


def size_gb(text: Column | str) -> Column:
    """'1.2 GB' in decimal GB; null if it isn't a size."""
    number = F.nullif(F.regexp_extract(_c(text), r"([0-9]+(?:\.[0-9]+)?)\s*([KMGTkmgt]?)[Bb]", 1), F.lit("")).cast("double")
    unit = F.upper(F.regexp_extract(_c(text), r"([0-9]+(?:\.[0-9]+)?)\s*([KMGTkmgt]?)[Bb]", 2))
    scale = F.when(unit == "T", 1e3).when(unit == "G", 1.0).when(unit == "M", 1e-3).when(unit == "K", 1e-6).otherwise(1e-9)
    return number * scale


def crop_path(path: Column | str, tag: Column | str, ending: str = ".jpg") -> Column:
    """Where a crop of path is kept: tag/first two digits/stem_digest and the ending."""
    d = F.substring(F.md5(_c(path).cast("binary")), 1, 12)
    return F.concat_ws("/", _c(tag), F.substring(d, 1, 2), F.concat(stem(path), F.lit("_"), d, F.lit(ending)))


def rebase(root: str, relative: Column | str) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), F.replace(_c(relative), F.lit("\\"), F.lit("/")))


def margin_of_tag(tag: Column | str) -> Column:
    """1.5 of 'm1.5'; 0 for other tags."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(tag), r"^m([0-9]+(?:\.[0-9]+)?)$", 1), F.lit("")).cast("double"), F.lit(0.0))


def fixed_of_tag(tag: Column | str) -> Column:
    """320 of 'f320'; 0 for other tags."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(tag), r"^f([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
