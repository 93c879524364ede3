"""Running values by ranges, what is dealt along them, and a bootstrap that draws cells."""

import math
import random

from pyspark.sql import functions as F

from brindle.operators import metrics as M
from brindle.operators import profile as P
from brindle.operators import split
from brindle.operators.prefix import scan


def test_scan(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice((None, "a", "b", "c")) if k % 3 else "a", k, rnd.choice((None, rnd.randrange(50)))) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, x int").repartition(7)
    folds = {"sum": lambda a, b: a + b, "max": max, "min": min, "last": lambda a, b: b, "first": lambda a, b: a}
    for by in ([], ["g"]):
        values = {op: (op, "x") for op in folds} | {"past": ("max", "x")}
        got = {r["k"]: r for r in scan(df, ["k"], values, by, before=("past",)).collect()}
        assert len(got) == len(rows)
        held: dict = {}
        for g, k, x in rows:
            part = held.setdefault(g if by else 0, {})
            assert got[k]["past"] == part.get("max")
            for op, f in folds.items():
                if x is not None:
                    part[op] = f(part[op], x) if op in part else x
                assert got[k][op] == part.get(op), (by, op, k)
    down = {r["k"]: r["s"] for r in scan(df, [F.desc("k")], {"s": ("last", "x")}).collect()}
    last = None
    for _, k, x in reversed(rows):
        last = x if x is not None else last
        assert down[k] == last
    assert scan(df.limit(0), ["k"], {"s": ("sum", "x")}, ["g"]).count() == 0


def test_dealt_folds(spark):
    """About as even as one task's greedy deal, which looks at every group in turn; a group of a third of all rows is dealt, too."""
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.floor(F.col("id") / 17)).alias("group"), F.concat(F.lit("A"), F.floor(F.sqrt(F.xxhash64("id") % 30 + 30))).alias("label"))
    rows = rows.withColumn("group", F.when(F.col("group") % 50 == 7, None).otherwise(F.col("group")))
    folds = split.dealt_group_folds(rows, "label").cache()
    assert folds.count() == rows.select("group").distinct().count()
    fair = rows.filter("group <> -1")

    def spread(f):
        n = {(r["fold"], r["label"]): r["count"] for r in fair.join(f, "group").groupBy("fold", "label").count().collect()}
        labels = {lab for _, lab in n}
        share = [[n.get((k, lab), 0) / sum(n.get((j, lab), 0) for j in range(5)) for k in range(5)] for lab in labels]
        return sum(math.sqrt(sum((x - 0.2) ** 2 for x in s) / 5) for s in share) / len(share)

    greedy = split.stratified_group_folds(fair.filter("group is not null"), "label")
    assert spread(split.dealt_group_folds(fair, "label")) < spread(greedy) + 0.02
    again = split.dealt_group_folds(rows.repartition(9), "label")
    assert folds.exceptAll(again).isEmpty()


def test_bootstrap_cells(spark):
    """Few rows by inversion and many by the expansion: means and spreads of the weights are Poisson's."""
    for n in (1, 5, M.COUNTED, 40, 5000):
        steps = [c for k, c in M.poisson_steps() if k == n]
        if steps:
            rnd = random.Random(n)
            drawn = [sum(c < u for c in steps) for u in (rnd.random() for _ in range(4000))]
            mean = sum(drawn) / len(drawn)
            assert abs(mean - n) < 5 * math.sqrt(n / 4000) and abs(sum((x - mean) ** 2 for x in drawn) / 4000 / n - 1) < 0.15
    rows = spark.createDataFrame([(0, 0)] * 300 + [(0, 1)] * 100 + [(1, 1)] * 80 + [(1, None)] * 20 + [(None, 0)] * 9, "y int, pred int")
    b = M.bootstrap_cells(rows, "balanced_accuracy").first()
    assert abs(b["value"] - (0.75 + 0.8) / 2) < 1e-12 and b["replicates"] == 1000
    sd = math.sqrt(0.75 * 0.25 / 400 + 0.8 * 0.2 / 100) / 2
    assert abs((b["high"] - b["low"]) / (2 * 1.96 * sd) - 1) < 0.15 and b["low"] < b["value"] < b["high"]
    f = M.bootstrap_cells(rows, "macro_f1").first()
    assert abs(f["value"] - (2 * 300 / 700 + 2 * 80 / 280) / 2) < 1e-12 and f["low"] < f["value"] < f["high"]
    assert M.bootstrap_cells(rows.filter("y = 0")).first()["replicates"] == 0
    assert M.bootstrap_cells(rows.limit(0)).first()["value"] is None


def test_role_guess_by_hint_and_look(spark):
    """A hint counts once, in its strictest place; values add to what a hint speaks for."""
    rows = [
        ("box.width", 1.0, {"int": 5}, ["3"]), ("width", 0.9, {"str": 5}, ["wide"]),  # 3.0 + 1.0 beats 2.7
        ("label.note", 1.0, {"str": 5}, ["x"]), ("kind_label", 0.5, {"str": 5}, ["A3"]),  # 0.5 loses to 0.75 + 3.0
        ("id.no", 1.0, {"str": 3}, ["x" * 50]), ("animal_no", 0.9, {"str": 3}, ["k1"]),  # 3.5 loses to nothing: 1.35 + 0.5
    ]
    profile = spark.createDataFrame(rows, "path string, freq double, types map<string,bigint>, examples array<string>")
    got = {r["role"]: (r["path"], round(r["score"], 6)) for r in P.role_guess(profile, {"width": ("width",), "label": ("label",), "animal_id": ("id", "no"), "bbox": ("nothing",)}).collect()}
    assert got == {"width": ("box.width", 4.0), "label": ("kind_label", 3.75), "animal_id": ("id.no", 3.5)}
