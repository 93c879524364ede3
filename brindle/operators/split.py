"""Leak-free groups, hold-outs and folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brindle.functions.scalars import bucket
from brindle.operators.forest import Forest
from brindle.operators.graph import connected_components
from brindle.operators.prefix import running_sums
from brindle.session import Staged


def build_groups(rows: DataFrame, key: str, animal: str = "animal_id", dup: str = "dup_cluster") -> DataFrame:
    """rows with group: the smallest key of the component that shared animals and duplicates make.

    Rows are edges between keys, so components run on keys. Only columns with a value take part; a row with neither is a
    group of its own.
    """
    has = rows.agg(F.count(animal).alias("a"), F.count(dup).alias("d")).first() if {animal, dup} <= set(rows.columns) else {"a": int(animal in rows.columns), "d": int(dup in rows.columns)}
    keyed = _keyed(rows, animal if has["a"] else None, dup if has["d"] else None)
    comp = connected_components(_edges(keyed), Staged(rows.sparkSession))
    return _grouped(keyed, comp, key)


def _keyed(rows: DataFrame, animal: str | None, dup: str | None) -> DataFrame:
    of = lambda kind, c: F.concat(F.lit(f"{kind}::"), F.col(c).cast("string")) if c else F.lit(None).cast("string")
    return rows.withColumn("_a", of("animal", animal)).withColumn("_d", of("dup", dup))


def _edges(keyed: DataFrame) -> DataFrame:
    return keyed.filter("_a is not null and _d is not null").select(F.col("_a").alias("u"), F.col("_d").alias("v")).distinct()


def _grouped(keyed: DataFrame, comp: DataFrame, key: str) -> DataFrame:
    grouped = keyed.withColumn("_n", F.coalesce("_a", "_d")).join(comp.withColumnRenamed("v", "_n"), "_n", "left")
    return grouped.withColumn("group", F.coalesce("component", "_n", F.concat(F.lit("row::"), F.col(key).cast("string")))).drop("_a", "_d", "_n", "component")


def extend_groups(forest: Forest, rows: DataFrame, animal: str = "animal_id", dup: str = "dup_cluster") -> None:
    """The groups that a chunk of rows makes or joins, in a stored forest; what it doesn't touch is not read again."""
    forest.add(_edges(_keyed(rows, animal, dup)))


def groups_of(forest: Forest, rows: DataFrame, key: str, animal: str = "animal_id", dup: str = "dup_cluster") -> DataFrame:
    """rows with their group as the forest has it, named as by `build_groups`."""
    return _grouped(_keyed(rows, animal, dup), forest.components(), key)


def holdout(group: Column | str, share: float = 0.15, seed: int = 42) -> Column:
    return bucket(group, 1000, f"holdout{seed}") < int(share * 1000)


def hash_fold(group: Column | str, k: int = 5, seed: int = 42) -> Column:
    return bucket(group, k, f"fold{seed}").cast("int")


def stratified_group_folds(rows: DataFrame, label: str = "label", k: int = 5, seed: int = 42, shards: int = 1) -> DataFrame:
    """group, fold: groups in descending spread of their class counts, each into the fold that evens the classes most.

    Sequential by nature; a task reads one row a group and class. Groups with equal spread stand in the order of a hash. With
    shards, groups are dealt out to so many tasks by a hash and each evens its own; the shards' folds are even together, too.
    Take as many as leave a task a few hundred thousand groups.
    """
    counts = rows.groupBy("group", F.coalesce(F.col(label).cast("string"), F.lit("NA")).alias("label")).agg(F.count("*").alias("n"))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        import numpy as np

        table = pdf.drop(columns="_shard").pivot_table(index="group", columns="label", values="n", fill_value=0, aggfunc="sum")
        names, m = table.index.to_numpy(), table.to_numpy(float)
        ties = [hashlib.md5(f"{seed}{g}".encode()).hexdigest() for g in names]
        order = sorted(range(len(m)), key=lambda i: (-m[i].std(), ties[i]))
        total, held, size = np.maximum(m.sum(axis=0), 1), np.zeros((k, m.shape[1])), np.zeros(k)
        fold = np.zeros(len(m), int)
        for i in order:
            spread = []
            for f in range(k):
                held[f] += m[i]
                spread.append((float((held / total).std(axis=0).mean()), size[f], f))
                held[f] -= m[i]
            f = min(spread)[2]
            fold[i], held[f], size[f] = f, held[f] + m[i], size[f] + m[i].sum()
        return pd.DataFrame({"group": names, "fold": fold})

    kind = dict(counts.dtypes)["group"]
    return counts.withColumn("_shard", bucket("group", max(1, shards), f"shard{seed}")).groupBy("_shard").applyInPandas(assign, f"group {kind}, fold int")


def dealt_group_folds(rows: DataFrame, label: str = "label", k: int = 5, seed: int = 42) -> DataFrame:
    """group, fold: groups of like profile and size, one after another, dealt to the folds there and back.

    Groups stand in order of profile (their labels by frequency, then how much the first prevails in eighths), then of size,
    then of a hash, and a running count over that order deals them; it goes on from one profile to the next, so that what is
    left of one is made up for in the other. The count is dealt out by ranges, so no task sees all groups. Null is a group.
    """
    counts = rows.groupBy("group", F.coalesce(F.col(label).cast("string"), F.lit("NA")).alias("label")).agg(F.count("*").alias("n"))
    # a row a group; its labels are as many as there are classes at most
    g = counts.groupBy("group").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "label"))).alias("by"))
    g = g.select("group", "n", F.array_join(F.col("by.label"), "\x1f").alias("profile"), F.floor(-8 * F.col("by")[0]["m"] / F.col("n")).alias("eighths"), F.lit(1).alias("one"))
    tie = F.md5(F.concat(F.lit(str(seed)), F.coalesce(F.col("group").cast("string"), F.lit(""))).cast("binary"))
    order = [F.col("profile"), F.col("eighths"), F.col("n").desc(), tie, F.col("group")]
    at = F.col("rank") - 1
    turn = F.pmod(at, F.lit(k))
    fold = F.when(F.floor(at / k) % 2 == 0, turn).otherwise(k - 1 - turn)
    return running_sums(g, order, {"rank": "one"}).select("group", fold.cast("int").alias("fold"))


def assign(rows: DataFrame, key: str, label: str = "label", k: int = 5, share: float = 0.15, seed: int = 42, stratify: bool = True) -> DataFrame:
    """rows(group) with is_holdout and fold; hold-out rows have fold -1. Without stratify, folds are a hash of the group."""
    rows = rows.withColumn("is_holdout", holdout("group", share, seed))
    if not stratify:
        return rows.withColumn("fold", F.when(F.col("is_holdout"), -1).otherwise(hash_fold("group", k, seed)))
    folds = dealt_group_folds(rows.filter("not is_holdout"), label, k, seed)
    return rows.join(folds, "group", "left").withColumn("fold", F.when(F.col("is_holdout"), -1).otherwise(F.col("fold")))


def fold_crosstab(rows: DataFrame, label: str, values: list | None = None) -> DataFrame:
    """fold by label: counts, and each label's share of its fold."""
    counts = rows.groupBy("fold").pivot(label, values).count().na.fill(0)
    names = [c for c in counts.columns if c != "fold"]
    total = sum(F.col(f"`{c}`") for c in names)
    return counts.select("fold", *names, *(F.round(F.col(f"`{c}`") * 100.0 / total, 4).alias(f"{c}_pct") for c in names))


def leaks(rows: DataFrame, keys: list[str], fold: int = 0) -> DataFrame:
    """For each key column and pair of parts (train, val, holdout): how many values both have. All should be 0."""
    part = F.when(F.col("is_holdout"), "holdout").when(F.col("fold") == fold, "val").otherwise("train")
    out = None
    for c in keys:
        seen = rows.filter(F.col(c).isNotNull()).groupBy(c).agg(*(F.max(part == p).alias(p) for p in ("train", "val", "holdout")))
        one = seen.agg(*(F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in (("train", "val"), ("train", "holdout"), ("val", "holdout")))).select(F.lit(c).alias("key"), "*")
        out = one if out is None else out.union(one)
    return out


def verify(rows: DataFrame, keys: list[str], fold: int = 0, strict: bool = True) -> bool:
    """True if no part shares a key with another; strict raises instead of returning False."""
    bad = leaks(rows, keys, fold).filter("train_val + train_holdout + val_holdout > 0").collect()
    if bad and strict:
        raise ValueError(f"keys are shared between parts: {[r.asDict() for r in bad]}")
    return not bad


def random_split_leak(rows: DataFrame, key: str, group: str, seed: int = 42, share: float = 0.8) -> DataFrame:
    """One row: the share of validation rows of a plain random split whose group is in training, too."""
    train = bucket(key, 1000, f"random{seed}") < int(share * 1000)
    flagged = rows.withColumn("_t", train)
    seen = flagged.groupBy(group).agg(F.count_if(F.col("_t")).alias("t"), F.count_if(~F.col("_t")).alias("v"))
    return seen.agg(F.sum("v").alias("n_val"), F.sum(F.when(F.col("t") > 0, F.col("v")).otherwise(0)).alias("n_leaked")).select("n_val", "n_leaked", F.round(F.col("n_leaked") / F.col("n_val"), 6).alias("leak_rate"))


def get_fold(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    dev = rows.filter("not is_holdout")
    return dev.filter(F.col("fold") != k), dev.filter(F.col("fold") == k)


def get_holdout(rows: DataFrame) -> DataFrame:
    return rows.filter("is_holdout")


def sample_per_label(rows: DataFrame, key: str, label: str, n: int | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """n rows, or a rounded fraction, of each label, by a hash of the key."""
    by = W.partitionBy(label)
    ranked = rows.withColumn("_r", F.row_number().over(by.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key)))
    limit = F.lit(n) if n is not None else F.bround(F.lit(fraction) * F.count("*").over(by))
    return ranked.withColumn("_n", limit).filter("_r <= _n").drop("_r", "_n")


def group_stats(rows: DataFrame, group: str = "group") -> DataFrame:
    """One row: groups, rows, rows_per_group, and whether groups are hardly larger than rows."""
    per = F.count("*") / F.nullif(F.countDistinct(group), F.lit(0))
    return rows.agg(F.countDistinct(group).alias("groups"), F.count("*").alias("rows"), per.alias("rows_per_group"), F.coalesce(per < 1.2, F.lit(False)).alias("warn"))


def sample_uniform(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, or all if they are fewer: those whose digest of seed and key is smallest, on any number of machines the same."""
    return rows.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)
