"""What is stored between runs: a forest that grows by edges, an index of signatures that grows by chunks."""

import random

from brindle.operators import dedup
from brindle.operators.dedup_index import SignatureIndex
from brindle.operators.forest import Forest


def parts(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_forest(spark, tmp_path):
    rnd = random.Random(2)
    forest, kept = Forest(spark, str(tmp_path / "a"), "long"), Forest(spark, str(tmp_path / "b"), "long", keep_names=True)
    edges, names = [], {}
    assert forest.components().count() == 0
    for n in (40, 25, 0, 60, 5):
        batch = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(n)]
        edges += batch
        df = spark.createDataFrame([*batch, (None, 3), *batch[:3]], "u long, v long")
        for f in (forest, kept):
            f.add(df)
        want = parts(edges)
        assert {r["v"]: r["component"] for r in forest.components().collect()} == want
        # the same components, and of old names that come together one stays
        got = {r["v"]: r["component"] for r in kept.components().collect()}
        assert {(want[v], c) for v, c in got.items()} == {(want[v], got[want[v]]) for v in want}
        for part in set(want.values()):
            before = {names[v] for v in want if want[v] == part and v in names}
            assert not before or got[part] in before
        names = got


def test_a_batch_that_failed_is_repeated(spark, tmp_path):
    forest = Forest(spark, str(tmp_path), "long")
    forest.add(spark.createDataFrame([(1, 2)], "u long, v long"))
    spark.createDataFrame([(9, 9, 2)], forest.vertex).write.parquet(str(tmp_path / "vertices" / "2"))  # no moves: not whole
    assert {r["v"] for r in forest.components().collect()} == {1, 2}
    forest.add(spark.createDataFrame([(2, 3)], "u long, v long"))
    assert {r["v"]: r["component"] for r in forest.components().collect()} == {1: 1, 2: 1, 3: 1}


def test_signature_index(spark, tmp_path):
    """Crowded buckets, equal signatures in several chunks, keys that come again, a session that opens what is stored."""
    rnd = random.Random(3)
    base = [rnd.getrandbits(60) for _ in range(12)]
    rows = []
    for k in range(300):
        s = rnd.choice(base)
        for _ in range(rnd.choice((0, 0, 2, 5, 9))):
            s ^= 1 << rnd.randrange(60)
        rows.append((1000 - k if k % 2 else k, *((s >> 15 * b) & 32767 for b in range(4))) if k % 17 else (k + 5000, None, None, None, None))
    schema = "doc_id long, b0 long, b1 long, b2 long, b3 long"
    want = {tuple(r) for r in dedup.clusters(spark.createDataFrame(rows, schema)).collect()}
    index = SignatureIndex(spark, str(tmp_path), "bands_a", buckets=4, crowded=3)
    for k in range(3):
        index.add(spark.createDataFrame(rows[k::3] + rows[:5], schema))
        index = SignatureIndex(spark, str(tmp_path), f"bands_{k}", buckets=4, crowded=3)
    assert {tuple(r) for r in index.clusters().collect()} == want
    index.add(spark.createDataFrame([], schema))
    assert index.clusters().distinct().count() == len(want)  # rows that come twice in a chunk stay two


def test_the_stored_side_is_not_shuffled(spark, tmp_path):
    index = SignatureIndex(spark, str(tmp_path), "bands_plan", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).selectExpr("cast(id % 4 as int) as band", "id as bits", "id as m").groupBy("band", "bits").count()
        plan = spark.table("bands_plan").join(rows, ["band", "bits"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and index.buckets == 4
