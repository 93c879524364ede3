"""Images of frequent names, against all pairs."""

import random
import re

from pyspark.sql import functions as F

from brindle.operators.matching import FEW, candidates, match_images
from brindle.session import Staged


def wanted(records, images):
    def parts(p):
        return set(re.split(r"[/\\]", p))

    out = {}
    for name, path in records:
        if name is None or path is None:
            continue
        for k, of in ((name, lambda f: f), (re.sub(r"\.[^.]*$", "", name), lambda f: f)):
            fits = [p for p in images if p is not None and k in (re.split(r"[/\\]", p)[-1], re.sub(r"\.[^.]*$", "", re.split(r"[/\\]", p)[-1]))]
            if fits:
                out[name, path] = min(fits, key=lambda p: (-len(parts(p) & parts(path)), p))
                break
    return out


def test_frequent_names(spark):
    rnd = random.Random(5)
    folder = lambda: "/".join(["data", *(rnd.choice("abcdef") + rnd.choice(("", "1")) for _ in range(rnd.randint(1, 4)))])
    images = [f"{folder()}/{rnd.choice(('img', 'pic'))}.{rnd.choice(('jpg', 'png'))}" for _ in range(400)] + ["one/only.jpg", None]
    records = [(f"{rnd.choice(('img', 'pic'))}.{rnd.choice(('jpg', 'png', 'gif'))}", f"{folder()}/labels.json") for _ in range(150)]
    records += [("only.jpg", "x.json"), ("none.jpg", "x.json"), (None, "x"), ("img.jpg", None), ("img.gif", ""), records[0]]
    want = wanted(records, images)
    rows = spark.createDataFrame(records, "image_name string, json_path string")
    pics = spark.createDataFrame([(p,) for p in images], "image_path string")
    for few in (1, 3, FEW, 1000):
        got = match_images(rows, pics, few=few).collect()
        assert {(r["image_name"], r["json_path"]): r["image_path"] for r in got} == want
        assert len(got) == sum((n, p) in want for n, p in records)
    assert match_images(rows.limit(0), pics).count() == match_images(rows, pics.limit(0)).count() == 0


def test_a_name_in_100_000_folders(spark):
    """Folders of both levels are frequent; only both together tell images apart."""
    both = lambda n: spark.range(n).select(F.lit("img").alias("k"), F.concat(F.lit("t"), (F.col("id") % 100).cast("string"), F.lit("/s"), F.floor(F.col("id") / 100).cast("string")).alias("f"))
    images = both(100_000).select("k", F.concat(F.lit("root/img/"), "f", F.lit("/img.jpg")).alias("p"))
    records = both(100_000).filter(F.xxhash64("f") % 20 == 0).select("k", F.concat(F.lit("root/labels/"), "f", F.lit("/img.json")).alias("path")).withColumn("r", F.col("path"))
    found = candidates(records, images, ["k"], FEW, Staged(spark)).cache()
    n = records.count()
    assert found.count() < 20 * n
    best = found.groupBy("r").agg(F.min(F.struct(-F.col("o"), "p"))["p"].alias("p"))
    assert best.filter(F.regexp_replace("r", "labels|json", "") == F.regexp_replace(F.regexp_replace("p", "/img/", "//"), "jpg", "")).count() == n
