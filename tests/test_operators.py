"""Properties that the operators keep, on tables small enough to check by hand."""

import bisect
import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import geometry as G
from brindle.functions import json_walk
from brindle.functions import pixels
from brindle.functions import points as PT
from brindle.functions import scalars as S
from brindle.functions import vectors as V
from brindle.operators import calibration as C
from brindle.operators import dedup as D
from brindle.operators import experiments as X
from brindle.operators import metrics as M
from brindle.operators import normalize as N
from brindle.operators import split as P
from brindle.operators import two_stage as T
from brindle.operators.graph import connected_components
from brindle.operators.prefix import running_sums
from brindle.operators.selection import quantiles
from brindle.operators.skew import salted_join


def one(df):
    return df.collect()[0]


def window(spark, box, tag, w=1920, h=1080):
    b = F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>") if box is None else G.box(*map(F.lit, map(float, box)))
    r = one(spark.range(1).select(G.crop_window(b, F.lit(w), F.lit(h), F.lit(tag)).alias("w")))["w"]
    return None if r is None else tuple(r)


def test_windows(spark):
    x1, y1, x2, y2 = window(spark, (860, 440, 1060, 640), "m1.5")
    assert (x2 - x1, y2 - y1) == (300, 300) and (x1 + x2) / 2 == 960 and (y1 + y2) / 2 == 540
    assert window(spark, (0, 0, 100, 100), "m1.5")[:2] == (0, 0)
    assert window(spark, (1900, 1060, 1920, 1080), "f320") == (1600, 760, 1920, 1080)
    assert window(spark, None, "m1.5") == window(spark, None, "full") == (420, 0, 1500, 1080)
    assert window(spark, None, "f320") == (800, 380, 1120, 700)
    assert window(spark, (5, 5, 9, 9), "f4000", 300, 200) == (0, 0, 200, 200)
    assert window(spark, (1, 1, 2, 2), "m1.5", 0, 0) is None
    # a small box gets the least side
    a = window(spark, (500, 500, 501, 501), "m1.0")
    assert a[2] - a[0] == 64


def test_relative_geometry(spark):
    box, win = G.box(*map(F.lit, (0.0, 400.0, 200.0, 600.0))), G.box(*map(F.lit, (420, 0, 1500, 1080)), "int")
    r = one(spark.range(1).select(G.bbox_in_crop(box, win).alias("r"), G.visibility(box, win).alias("v")))
    assert r["r"] is None and r["v"] == 0
    pts = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((420.0, 0.0), (1500.0, 0.0), (960.0, 540.0))))
    assert [tuple(p) for p in one(spark.range(1).select(G.polygon_in_crop(pts, win).alias("p")))["p"]] == [(0.0, 0.0), (1.0, 0.0), (0.5, 0.5)]


def test_components_match_union_find(spark):
    rnd = random.Random(5)
    for n, m in ((1, 0), (40, 25), (200, 260)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        edges += [(k, k + 1) for k in range(1000, 1030)]  # a chain
        parent = {v: v for e in edges for v in e}

        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in edges:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        got = {r["v"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {v: find(v) for v in parent if any(a != b and v in (a, b) for a, b in edges)}
        few = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(3), chunk=7)  # rounds of stars
        assert {r["v"]: r["component"] for r in few.collect()} == got
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_salted_join_is_the_join(spark, tmp_path):
    left = spark.range(4000).selectExpr("id", "if(id % 3 = 0, 7, id % 50) as k")
    left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).write.parquet(str(tmp_path / "r"))
    right = spark.read.parquet(str(tmp_path / "r"))
    want = sorted(map(tuple, left.join(right, "k").select("id", "k", "n", "low").collect()))
    for least in (0, 100, 10**6):
        assert sorted(map(tuple, salted_join(left, right, ["k"], "n", ["id"], least).select("id", "k", "n", "low").collect())) == want


def test_quantiles_are_percentiles(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(("a", "b", None)), rnd.choice((1.5, 2.5, rnd.random(), None))) for _ in range(500)] + [("c", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["q"], r["m"]) for r in quantiles(df, "v", {"q": 0.3, "m": 0.5}, ["g"]).collect()}
    for g in ("a", "b", None, "c"):
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g][0] == len(v) and np.allclose(got[g][1:], np.quantile(v, [0.3, 0.5]))
    assert quantiles(df.limit(0), "v", {"m": 0.5}, ["g"]).count() == 0


def test_running_sums(spark):
    df = spark.range(1000).repartition(7).withColumn("x", F.col("id") % 13)
    for r in running_sums(df, [F.col("id").desc()], {"s": "x"}).collect():
        assert r["s"] == sum(k % 13 for k in range(r["id"], 1000))


def test_candidates_share_a_band_and_cap(spark):
    rows = [(k, k % 2, 5, k, k) for k in range(8)]
    sigs = spark.createDataFrame(rows, "doc_id long, b0 long, b1 long, b2 long, b3 long")
    near = {(r["u"], r["v"]) for r in D.candidate_pairs(sigs, max_hamming=60).collect()}
    assert near == set(itertools.combinations(range(8), 2))
    assert D.candidate_pairs(sigs, max_hamming=60, cap=3).count() == 0 < D.candidate_pairs(sigs, max_hamming=60, crowded=3).count()
    assert {r["n"] for r in D.skipped_buckets(sigs, cap=5).collect()} == {8}


def test_no_cap_loses_no_pair_of_a_crowded_bucket(spark):
    rnd = random.Random(3)
    base, rows = [rnd.getrandbits(64) - (1 << 63) for _ in range(4)], []
    for k in range(60):
        w = [base[0], *(x ^ sum(1 << i for i in rnd.sample(range(63), rnd.randint(0, 3))) for x in base[1:])]
        w[3] ^= -(1 << 63) if k % 3 == 0 else 0  # the sign is a bit as well
        rows.append((k, *w))
    sigs = spark.createDataFrame(rows, "doc_id long, b0 long, b1 long, b2 long, b3 long")
    first = {r[1:]: r[0] for r in reversed(rows)}
    far = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True))
    for most in (0, 6, 9, 70):
        want = {(first[a], first[b], far(a, b)) for a in first for b in first if first[a] < first[b] and far(a, b) <= most}
        for crowded in (5, 2000):
            got = D.candidate_pairs(sigs, max_hamming=most, cap=None, crowded=crowded).collect()
            assert {(r["u"], r["v"], r["distance"]) for r in got} == want and len(got) == len(want)
    assert D.candidate_pairs(sigs, cap=5).count() < D.candidate_pairs(sigs, cap=None, crowded=5).count()
    assert {r["dup_cluster"] for r in D.clusters(sigs, max_hamming=70, cap=None).collect()} == {0}


def test_a_bucket_of_more_than_2000(spark):
    rnd = random.Random(8)
    rows = [(k, 77, *(rnd.getrandbits(15) for _ in range(3))) for k in range(2600)]
    rows += [(10_000 + k, 77, a ^ (1 << k % 15), b ^ (1 << k % 7), c) for k, (_, _, a, b, c) in enumerate(rows[:200])]
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if sum((x ^ y).bit_count() for x, y in zip(a[1:], b[1:], strict=True)) <= 6}
    got = D.candidate_pairs(spark.createDataFrame(rows, "doc_id long, b0 long, b1 long, b2 long, b3 long")).collect()
    first = {r[1:]: r[0] for r in reversed(rows)}
    assert len(first) == len(rows) and len(want) >= 200
    assert {(r["u"], r["v"]) for r in got} == want


def test_signatures_of_scripts_and_wordless_texts(spark):
    texts = [None, "", "!!! ???", "これは 日本語 の 文章 です", "это русский текст о погоде", "هذا نص عربي عن الطقس", "plain english words here", "αυτό είναι ελληνικό κείμενο", "это русский текст о погоде"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sig = {r["doc_id"]: tuple(r)[1:] for r in D.simhash(rows).collect()}
    assert all(sig[k] == (None,) * 4 for k in range(3)) and len({sig[k] for k in range(3, 9)}) == 5
    got = {r["doc_id"]: (r["dup_cluster"], r["hashed"]) for r in D.clusters(D.simhash(rows)).collect()}
    assert got == {k: (4 if k == 8 else k, k > 2) for k in range(9)}
    labels = D.clusters(D.simhash(rows)).withColumn("label", F.lit("a")).withColumn("area_ratio", F.lit(1.0))
    kept = D.keep_largest(labels, "doc_id", order="doc_id")
    assert [r["doc_id"] for r in kept.collect()] == list(range(8))
    info = D.dedup_info(labels, kept)
    assert (one(info)["hashed"], one(info)["removed"], one(info)["alarm"]) == (6, 1, False)
    D.ensure_rows_left(info)
    with pytest.raises(ValueError):
        D.ensure_rows_left(D.dedup_info(labels, kept.limit(0)))


def test_conflicts_and_keep(spark):
    rows = spark.createDataFrame([(1, 7, "a", 0.1), (2, 7, "a", 0.3), (3, 7, None, None), (4, 8, "a", 1.0), (5, 8, "b", 1.0), (6, 9, "b", None), (7, 9, "b", None)], "id long, dup_cluster long, label string, area_ratio double")
    assert [r["dup_cluster"] for r in D.conflicts(rows).collect()] == [8]
    assert sorted(r["id"] for r in D.keep_largest(rows, "id").collect()) == [2, 3, 6]
    again = D.keep_largest(D.keep_largest(rows, "id"), "id")
    assert sorted(r["id"] for r in again.collect()) == [2, 3, 6]


def test_groups_bridge_animals_by_duplicates(spark):
    rows = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (3, "y", 2), (4, None, 2), (5, None, None), (6, "z", None)], "id long, animal_id string, dup_cluster long")
    g = {r["id"]: r["group"] for r in P.build_groups(rows, "id").collect()}
    assert g[1] == g[2] == g[3] == g[4] and len({g[1], g[5], g[6]}) == 3
    bare = P.build_groups(rows.withColumn("dup_cluster", F.lit(None).cast("long")), "id")
    g = {r["id"]: r["group"] for r in bare.collect()}
    assert g[2] == g[3] != g[1] and g[4] != g[5]


def test_folds_do_not_leak_and_are_even(spark):
    rows = spark.range(1200).select("id", (F.col("id") / 6).cast("long").alias("group"), F.concat(F.lit("A"), (F.col("id") / 6).cast("long") % 3).alias("label"))
    a = P.assign(rows, "id").cache()
    assert P.verify(a, ["group"])
    n = {(r["fold"], r["label"]): r["count"] for r in a.filter("fold >= 0").groupBy("fold", "label").count().collect()}
    for lab in ("A0", "A1", "A2"):
        per = [n[k, lab] for k in range(5)]
        assert max(per) - min(per) <= 6 * 2
    shuffled = P.assign(rows.orderBy(F.rand(1)).repartition(3), "id")
    assert a.select("id", "fold").exceptAll(shuffled.select("id", "fold")).isEmpty()
    with pytest.raises(ValueError):
        P.verify(a.withColumn("group", F.lit(1)), ["group"])


def test_metrics_with_missing_classes(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 2)], "y int, pred int")
    s = one(M.summary(M.confusion(rows, 4)))
    # classes 0, 1, 2 are seen; 3 is not
    assert s["accuracy"] == 0.5 and abs(s["balanced_accuracy"] - 0.5) < 1e-12 and abs(s["macro_f1"] - (0.8 + 0 + 0) / 3) < 1e-12
    perfect = one(M.summary(M.confusion(rows.withColumn("pred", F.col("y")), 2)))
    assert perfect["kappa"] == 1
    assert one(M.auroc(spark.createDataFrame([(1.0, 1), (1.0, 0), (1.0, 1)], "score double, y int")))["auroc"] == 0.5
    assert one(M.auroc(spark.createDataFrame([(1.0, 1)], "score double, y int")))["auroc"] is None


@pytest.mark.parametrize("metric", ["macro_f1", "balanced_accuracy"])
def test_bootstrap_of_class_metrics(spark, metric):
    rnd = random.Random(9)
    rows = [(k, c := rnd.choice([0, 0, 0, 1, 1, 2]), c if rnd.random() < 0.7 else rnd.choice([0, 1, 2, 3, None])) for k in range(300)]
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    steps = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563)

    def value(weights):
        s, p, t = Counter(), Counter(), Counter()
        for (_, y, q), w in zip(rows, weights, strict=True):
            s[y] += w
            p[q] += w
            t[y] += w * (y == q)
        if metric == "macro_f1":
            seen = [c for c in (0, 1, 2, 3) if s[c] + p[c]]
            return sum(2 * t[c] / (s[c] + p[c]) for c in seen) / len(seen)
        return sum(t[c] / s[c] for c in s if s[c]) / sum(1 for c in s if s[c])

    slot = [number(f"boot42{k}") % 1024 for k, _, _ in rows]
    all_ = [value([bisect.bisect_right(steps, number(f"42|{r}|{x}") / 4294967296.0) for x in slot]) for r in range(1000)]
    got = one(M.bootstrap_ci(spark.createDataFrame(rows + [(999, None, 1)], "id long, y int, pred int"), "id", metric))
    assert got["replicates"] == 1000 and got[metric] == pytest.approx(value([1] * len(rows)))
    assert [got["low"], got["high"]] == pytest.approx(np.quantile(all_, [0.025, 0.975]).tolist())
    assert got["low"] < got[metric] < got["high"]


def test_calibration(spark):
    rows = spark.createDataFrame([(k, (k % 15 + 1) / 15.0, k % 2) for k in range(60)], "id long, conf double, correct int")
    assert {r["bin"] for r in C.reliability(rows).collect()} == set(range(1, 16))
    z = spark.createDataFrame([(k, [3.0, 0.0, 0.0], 0 if k % 3 else 1) for k in range(90)], "id long, logits array<double>, y int")
    t = C.fit_temperature(z)
    fine = [0.25 * 1.02**k for k in range(186)]
    best = min(C.temperature_grid(z, fine).collect(), key=lambda r: r["nll"])["temperature"]
    assert abs(t - best) / best < 0.05
    acc = {r["accuracy"] for r in C.calibration_report(z, "id", t).collect()}
    assert len(acc) == 1
    tiny = spark.createDataFrame([(1, 0.9, 1)], "id long, conf double, correct int")
    assert {r["threshold"] for r in C.coverage_risk(tiny).collect()} == {0.9}
    assert tuple(one(C.abstain_threshold(tiny))) == (1.0, 0.0)


def test_two_stage(spark):
    rows = spark.createDataFrame([(1, 0.9, [0.7, 0.3], 0), (2, 0.1, [0.6, 0.4], 1), (3, 0.2, [0.5, 0.5], 2), (4, 0.8, [0.5, 0.5], 2)], "id long, s1 double, p2 array<double>, y int")
    p = T.predict(rows)
    assert [r["pred"] for r in p.orderBy("id").collect()] == [0, 2, 2, 0]
    r = one(T.report(p, 2))
    assert (r["missed_rate"], r["false_alarm_rate"], r["kind_accuracy"]) == (0.5, 0.5, 1.0)
    missed = [one(T.report(T.predict(rows, threshold=t), 2))["missed_rate"] for t in (0.05, 0.5, 0.95)]
    assert missed == sorted(missed)
    with pytest.raises(ValueError):
        T.report(p.withColumn("y", F.lit(9)), 2)
    with pytest.raises(ValueError):
        T.join_stages(rows.select("id", "s1"), rows.filter("id < 3").select("id", "p2"), "id")
    e = {r["id"]: r for r in T.engine(rows, abstain_below=0.45).collect()}
    assert e[4]["abstain"] and not e[2]["abstain"] and e[1]["band"] == "middle"
    assert T.gate_stage1(0.75) == "warn" and T.gate_stage2(0.4) == "pass"
    with pytest.raises(ValueError):
        T.gate_stage1(0.70)
    v = spark.createDataFrame([("A7",), ("A1",), (None,)], "label string")
    assert [r["label"] for r in T.to_stage1(v).collect()] == ["A7", "ABNORMAL", "ABNORMAL"]


def test_bands_and_runs(spark):
    pts = spark.createDataFrame([(0.5, 0.4066), (0.71, 0.4920), (1.0, 0.5489), (1.41, 0.5205), (2.0, 0.4632)], "x double, score double")
    b = {r["tolerance"]: (r["low"], r["high"]) for r in X.usable_band(pts, [0.05, 0.1, 0.2]).collect()}
    assert b == {0.05: (1.0, 1.0), 0.1: (1.0, 1.41), 0.2: (0.71, 2.0)} or b[0.1][0] in (0.71, 1.0)
    gap = spark.createDataFrame([(1.0, 0.9), (2.0, 0.1), (3.0, 1.0), (4.0, 0.95)], "x double, score double")
    assert tuple(one(X.usable_band(gap, [0.2]))[1:3]) == (3.0, 4.0)
    none = spark.createDataFrame([("x2", 0.5)], "condition string, score double")
    assert X.stress_summary(none, "x1").count() == 0
    runs = spark.createDataFrame([(1, "base", 1, 0.8, 0.3), (1, "new", 2, 0.79, 0.1), (2, "base", 1, 0.8, None), (2, "new", 2, 0.8, 0.1), (3, "base", 1, 0.8, 0.2)], "stage int, run string, ord int, score double, scale_drop double")
    assert {r["stage"]: r["verdict"] for r in X.compare_runs(runs, "base").collect()} == {1: "adopt", 2: "unmeasured", 3: "no_comparison"}
    assert X.choose_stage1_tag("m2.5", 1.0, None, ["m2.5"])[0] == "m2.5"
    assert X.choose_stage1_tag("m2.5", 0.57, 0.97, ["m2.5", "full"])[0] == "full"
    assert X.choose_stage1_tag("m2.5", 0.57, 0.90, ["m2.5", "full"])[0] == "m2.5"
    assert X.choose_stage1_tag("m2.5", 0.57, 0.97, ["m2.5", "full", "f320"])[0] == "f320"
    with pytest.raises(ValueError):
        X.choose_stage1_tag("m2.5", 0.57, 0.97, ["m2.5"])


RECORDS = {
    "a.json": '﻿{"metaData": {"lesions": "A7", "resolution": "1920X1080", "species": "D", "breed": "B", "age": 3, "gender": "F", "date": "2022", "합성유무": "N", "Raw data ID": "x/IMG_1.jpg"}, "labelingInfo": []}',
    "b.json": '[{"metaData": {"lesions": " a2 ", "resolution": "100x50", "species": "C"}, "labelingInfo": [{"polygon": {"location": [{"x1": 0, "y1": 0, "x2": 10, "y2": 0, "x3": 10, "y3": 20, "x5": 1, "y5": 1}]}}, 7]}, {"nothing": 1}, 3]',
    "VL/A3_x/c.json": '{"metaData": {"lesions": ""}, "labelingInfo": [{"box": {"location": [{"x": 1, "y": 2, "width": 3, "height": 4}]}}]}',
    "d.json": "{broken",
}


def test_label_records(spark):
    raw = spark.createDataFrame(list(RECORDS.items()), "json_path string, json string")
    got = {r["json_path"]: r for r in N.parse_records(raw).collect()}
    assert set(got) == {"a.json", "b.json", "VL/A3_x/c.json"}
    a, b, c = got["a.json"], got["b.json"], got["VL/A3_x/c.json"]
    assert (a["label"], a["is_normal"], a["img_w"], a["img_h"], a["image_name"], a["animal_id"], a["bbox"]) == ("A7", True, 1920, 1080, "IMG_1.jpg", "G_D|B|3|F|2022", None)
    assert b["label"] == "A2" and len(b["polygon"]) == 3 and tuple(b["bbox"]) == (0.0, 0.0, 10.0, 20.0) and b["area_ratio"] == 200 / 5000 and b["n_lesion"] == 1
    assert c["label"] == "A3" and tuple(c["bbox"]) == (1.0, 2.0, 4.0, 6.0) and c["area_ratio"] is None
    assert one(N.unparsed(raw))["n_unparsed"] == 1


def test_coordinates(spark):
    import json

    two = [(1.0, 2.0), (3.0, 4.0)]
    cases = [
        ([[1, 2], [3, 4]], two), ([{"x": 1, "y": 2}, {"x": 3, "y": 4}], two), ([1, 2, 3, 4], two), ({"x1": 1, "y1": 2, "x2": 3, "y2": 4}, two),
        ({"X1": "1", "Y1": 2.0, "x2": 3, "y2": 4, "x4": 9, "y4": 9}, two), ({"x": 1, "y": 2, "width": 2, "height": 2}, two), ({"x": "1", "y": 2}, two[:1]),
        ({"polygon": 0, "location": [[1, 2], [3, 4]]}, two), ({"points": {"data": [{"x": 1, "y": 2}, {"x": 3, "y": 4}]}}, two), ({"other": [], "shape": [[1, 2], [3, 4], "x", [5]]}, two),
        ([[1, 2], ["a", 3], [3, 4]], two), ({"x": "a", "y": 2}, []), ([1, 2, 3], []), ({}, []), ([], []), (7, []), (True, []), ("1,2 3,4", two), ("-1.5;2 3,4 5", []),
    ]
    rows = [(k, json.dumps(v)) for k, (v, _) in enumerate(cases)] + [(100, "1,2 3,4"), (101, None), (102, "null")]
    got = {r["k"]: [tuple(p) for p in r["p"]] for r in spark.createDataFrame(rows, "k int, t string").select("k", PT.as_xy("t").alias("p")).collect()}
    assert got == {**{k: want for k, (_, want) in enumerate(cases)}, 100: two, 101: [], 102: []}
    flat = list(json_walk.leaves({"a": {"b": [{"c": 1}, {"c": 2}], "e": []}, "d": None, "f": {}}))
    assert [(p, v) for p, _, v in flat] == [("a.b[].c", 1), ("a.e[]", None), ("d", None)]


def test_paths(spark):
    p = "root\\Training\\TL01\\반려견\\일반카메라\\유증상\\A1_x.json"
    r = one(spark.createDataFrame([(p,)], "p string").select(*S.path_axes("p"), S.name_shape(F.lit("IMG_12-a3")).alias("shape"), S.rebase("/r", F.lit("a\\b.jpg")).alias("re"), S.size_gb(F.lit("1.5 TB")).alias("gb"), S.resolution(F.lit(" 12 x 34 "), 2).alias("h"), S.resolution(F.lit("x"), 1).alias("none")))
    assert tuple(r) == ("반려견", "일반카메라", "유증상", "train", "L_#-L#", "/r/a/b.jpg", 1500.0, 34, None)


def test_vectors(spark):
    r = one(spark.range(1).select(V.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("p"), V.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("a"), V.top_k(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)), 2).alias("k")))
    assert r["p"] == [0.5, 0.5] and r["a"] == 1 and [x["class"] for x in r["k"]] == [1, 2]


def test_pixels():
    import numpy as np

    rng = np.random.default_rng(1)
    flat, noisy = np.full((40, 60), 9.0), rng.uniform(0, 255, (40, 60))
    assert pixels.sharpness(flat) == 0 < pixels.sharpness(noisy)
    smooth = np.kron(rng.uniform(0, 255, (16, 16)), np.ones((8, 8)))
    big = np.kron(smooth, np.ones((2, 2)))
    a, b = pixels.phash(smooth), pixels.phash(big)
    assert len(a) == 4 and sum((x ^ y).bit_count() for x, y in zip((v % 2**64 for v in a), (v % 2**64 for v in b), strict=True)) <= 6


def test_scope_guards(spark):
    rows = spark.createDataFrame([("", "x"), ("", None), ("", "y")], "species_code string, camera string")
    assert N.scope(rows, include=["z"], exclude=["y"]).count() == 2
    assert N.scope(rows, include=["x"]).count() == 2


def test_fingerprint_ignores_order(spark):
    a = spark.range(50).withColumn("v", F.col("id") * 2)
    d = [one(N.fingerprint(x, "id", ["v"]))["fingerprint"] for x in (a, a.orderBy(F.rand(3)).repartition(5), a.withColumn("v", F.col("v") + 1))]
    assert d[0] == d[1] != d[2]
