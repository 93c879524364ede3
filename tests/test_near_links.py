"""Near signatures by places: all pairs once without a shuffle of pairs, clusters and the stored index by few links."""

import hashlib
import random

from pyspark.sql import functions as F

from brindle.operators import dedup, dedup_index

SCHEMA = "doc_id long, b0 long, b1 long, b2 long, b3 long"


def crowd(n, seed, width=15, flips=(0, 1, 2, 3, 6)):
    """Signatures about a few centres, all unequal."""
    rnd = random.Random(seed)
    base = [rnd.getrandbits(4 * width) for _ in range(3)]
    seen = {}
    while len(seen) < n:
        s = rnd.choice(base)
        for _ in range(rnd.choice(flips)):
            s ^= 1 << rnd.randrange(4 * width)
        seen.setdefault(s, len(seen))
    word = lambda s, b: (x := s >> width * b & (1 << width) - 1) - (1 << 64 if x >> 63 else 0)
    return [(k, *(word(s, b) for b in range(4))) for s, k in seen.items()]


def brute(rows):
    far = lambda x, y: sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(x[1:], y[1:], strict=True))
    return {(x[0], y[0], far(x, y)) for x in rows for y in rows if x[0] < y[0] and any(a == b for a, b in zip(x[1:], y[1:], strict=True)) and far(x, y) <= 6}


def test_pairs_come_once_and_are_not_shuffled(spark):
    for rows in (crowd(200, 1), crowd(150, 2, 64)):
        want = brute(rows)
        assert len(want) > 100
        sigs = spark.createDataFrame([*rows, (9999, None, None, None, None)], SCHEMA)
        for crowded in (2000, 5):
            got = dedup.candidate_pairs(sigs, crowded=crowded)
            assert sorted(map(tuple, got.collect())) == sorted(want)
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert "Aggregate [u" not in plan and "Deduplicate" not in plan


def test_clusters_need_few_links(spark, monkeypatch):
    rows = crowd(300, 3, flips=(1, 2, 3))
    sigs = spark.createDataFrame(rows, SCHEMA)
    seen, real = [], dedup.connected_components
    monkeypatch.setattr(dedup, "connected_components", lambda e, *a: (seen.append(e.count()), real(e, *a))[1])
    got = {tuple(r)[:2] for r in dedup.clusters(sigs).collect()}
    pairs = brute(rows)
    assert len(pairs) > 4 * len(rows) >= seen[0] > 0
    root = {r[0]: r[0] for r in rows}
    for _ in rows:
        for u, v, _ in pairs:
            root[u] = root[v] = min(root[u], root[v])
    assert got == set(root.items()) == {tuple(r)[:2] for r in dedup.clusters(sigs, crowded=5).collect()}


def test_an_index_is_given_few_links(spark, tmp_path, monkeypatch):
    rows = crowd(300, 4, flips=(1, 2, 3))
    want = {tuple(r) for r in dedup.clusters(spark.createDataFrame(rows, SCHEMA)).collect()}
    seen, real = [], dedup_index.Forest.add
    monkeypatch.setattr(dedup_index.Forest, "add", lambda self, e: (seen.append(e.count()), real(self, e))[1])
    index = dedup_index.SignatureIndex(spark, str(tmp_path), "bands_few", buckets=4)
    for k in (0, 1):
        index.add(spark.createDataFrame(rows[k::2], SCHEMA))
    assert {tuple(r) for r in index.clusters().collect()} == want
    assert sum(seen) <= 9 * len(rows) < len(brute(rows))  # four bands of both chunks, and one more for each of its rows


def test_two_old_signatures_are_not_compared(spark):
    """A new one joins both of those it is near to; old ones alone stay apart."""
    rows = [(1, 0, 0, 0, 0, False), (2, 0, 1, 0, 0, False), (3, 7, 0, 0, 0, False), (4, 7, 1, 0, 0, True), (5, 7, 3, 0, 0, False)]
    reps = spark.createDataFrame(rows, "id long, b0 long, b1 long, b2 long, b3 long, fresh boolean")
    placed = dedup.bands(reps).join(reps.select("id", "fresh"), "id").filter("band = 0")
    sized = placed.groupBy("band", "bits").agg(F.count("*").alias("n"))
    for crowded in (100, 1):
        assert {frozenset(r) for r in dedup.links(dedup.parted(placed, sized, 6, crowded), 6).collect()} == {frozenset((4, 3)), frozenset((4, 5))}


def test_signatures_of_odd_texts(spark):
    """Long texts, many words in one, no words, nulls, a key that comes twice, letters of other scripts."""
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(40)}" for _ in range(n)) for n in (1, 254, 255, 256, 511, 9000)] + ["same " * 700, "", "  ..!", None, "Ünï cödé 가나다 x9_y", "... edge ..."]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1, "more words for one")]

    def want(words):
        h = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words]
        bits = sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(60))
        return tuple(bits >> 15 * b & 32767 for b in range(4)) if h else (None,) * 4

    words = {}
    for k, t in rows:
        words.setdefault(k, []).extend("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    got = dedup.simhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {k: want(w) for k, w in words.items()} and len(got) == len(words)
