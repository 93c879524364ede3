"""Keys once, by state: restarts, known keys, a time to live, null keys, and a cost that doesn't follow the target."""

import time

import pytest

from brindle.streaming import ingest

SCHEMA = "k long, v long, `_the note` string"


@pytest.fixture
def place(spark, tmp_path):
    """A place, and one state partition: each starts a Python worker of its own in every batch."""
    (tmp_path / "in").mkdir()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield tmp_path
    spark.conf.set("spark.sql.shuffle.partitions", before)


def put(spark, place, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(place / "in"))


def run(spark, place, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(place / "in"))
    q = ingest.append_keyed(stream, str(place / more.pop("to", "out")), "k", ["v", "_the note"], str(place / more.pop("at", "ck")), **more)
    assert q.awaitTermination(60) and q.exception() is None
    return q


def got(spark, place, at="out"):
    return sorted((tuple(r) for r in spark.read.schema(SCHEMA).parquet(str(place / at)).collect()), key=repr)


def test_restart_and_ties(spark, place):
    before = spark.conf.get(ingest.PROVIDER)
    put(spark, place, [(1, 5, "b"), (1, 5, "a"), (1, 9, "c"), (2, None, "n"), (2, 7, "m"), (None, 1, "x"), (None, 1, "x")])
    run(spark, place)
    first = [(1, 5, "a"), (2, 7, "m"), (None, 1, "x")]
    assert got(spark, place) == sorted(first, key=repr) and spark.conf.get(ingest.PROVIDER) == before
    run(spark, place)  # nothing new
    assert got(spark, place) == sorted(first, key=repr)
    put(spark, place, [(1, 0, "late"), (3, 1, "new"), (None, 0, "late")])
    put(spark, place, [(3, 0, "late"), (4, 1, "new")])
    q = run(spark, place)
    rows = got(spark, place)
    assert sorted((r[0] for r in rows), key=repr) == [1, 2, 3, 4, None] and set(first) < set(rows)
    # a batch reads what came, not what was taken
    assert sum(p["numInputRows"] for p in q.recentProgress) == 5


def test_known_keys_stand_for_a_lost_checkpoint(spark, place):
    put(spark, place, [(n, n, "a") for n in range(20)])
    run(spark, place)
    put(spark, place, [(n, 0, "b") for n in range(15, 25)])
    run(spark, place, at="other", to="more", known=str(place / "out"))
    assert got(spark, place, "more") == [(n, 0, "b") for n in range(20, 25)]


def test_time_to_live(spark, place):
    put(spark, place, [(1, 1, "a")])
    run(spark, place, ttl="1 second")
    time.sleep(2)
    put(spark, place, [(1, 2, "b")])
    run(spark, place, ttl="1 second")
    assert got(spark, place) == [(1, 1, "a"), (1, 2, "b")]


def test_hot_key_and_nothing(spark, place):
    put(spark, place, [(7, n, "h") for n in range(30_000, 0, -1)] + [(8, 1, "h")])
    run(spark, place)
    assert got(spark, place) == [(7, 1, "h"), (8, 1, "h")]


def test_empty(spark, place):
    put(spark, place, [])
    run(spark, place)
    assert got(spark, place) == []
