"""Settings as frozen dataclasses, saved as JSON and varied by named overlays."""

from __future__ import annotations

import json
from dataclasses import asdict, fields, replace
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def from_dict(kind: type[T], values: dict) -> T:
    """An instance of a dataclass: unknown keys are ignored, lists become tuples, what is missing has its default."""
    names = {f.name for f in fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in names})


def overlay(settings: T, presets: dict[str, dict], name: str, plain: str = "default", label: str = "exp_name") -> T:
    """settings with a preset's values; but for the plain one, the preset's name is added to the label, if there is one."""
    if name not in presets:
        raise KeyError(f"no preset {name}; there are {', '.join(sorted(presets))}")
    out = from_dict(type(settings), {**asdict(settings), **presets[name]})
    if name != plain and hasattr(settings, label):
        out = replace(out, **{label: f"{getattr(settings, label)}_{name}"})
    return out


def save(spark: SparkSession, settings: object, path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(settings), ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, kind: type[T], path: str) -> T:
    return from_dict(kind, json.loads(spark.read.text(path).first()["value"]))


def differences(runs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """setting, value, n: of the settings that differ between runs, their values."""
    long = runs.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("setting"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select(key, "x.*")
    counted = long.groupBy("setting", "value").agg(F.count("*").alias("n"))
    varied = counted.groupBy("setting").agg(F.count("*").alias("k")).filter("k > 1").select("setting")
    return counted.join(varied, "setting")
