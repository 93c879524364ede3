"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

Texts with equal shingle sets are one class. Each class has one signature: its shingle hashes fall into bins, a bin keeps
its smallest hash, and an empty bin borrows from the first non-empty bin of its own random walk. Runs of bins are bucket
keys. Within a bucket, candidates are stars: the centre against every member of another component, then the next centres,
until the members left are one component. So a bucket of copies costs one edge a member, yet no pair of a bucket is left
untried unless it is linked already or can't be: after the first stars, classes of different components that share a rare
shingle are paired by it, and all others are bounded by what they share of the common ones. In these later stars two
classes are a candidate in the first bucket that they share only. Links are confirmed on the full sets.

With the default 32 bands of 4 bins, a pair at similarity 0.75 shares a bucket with probability 1 - 5e-6.

Defined cases: a null or empty text, or one of white space, has no shingles and links with nothing. Rows that share a
doc_id are one document for linking. A null doc_id links with nothing; its component_id is null and it is kept. Repeated
rows stay repeated. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brindle.llm._text import U64, Runs, Words, mix, sliced
from brindle.operators.graph import connected_components
from brindle.operators.sieve import bitmap, cannot_meet, may_meet
from brindle.operators.skew import salted_join
from brindle.session import Staged


@dataclass(frozen=True)
class NearDedup:
    """words: in a shingle; percent: least Jaccard similarity, in hundredths; bands of rows bins (bands * rows: a power of two).

    centres: of a bucket in the second round of stars; each later round has four times as many, or all once no bucket has
    more than `last` classes left. rare: classes that may share a shingle for it to be looked up on its own.
    """

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    centres: int = 16
    rare: int = 64
    last: int = 2048


def shingle_sets(raw: np.ndarray, offs: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles, A-Z lower-cased; fewer words than a shingle are one."""
    w = Words(raw, offs, lower=True)
    runs = Runs(w.hash)
    n = len(w.hash)
    at = np.arange(max(0, n - words + 1))
    full = runs.hash(at, at + words)
    out = []
    for a, b in zip(w.offs[:-1].tolist(), w.offs[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(full[a : b - words + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix(runs.hash(np.array([a]), np.array([b])) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


class _Signer:
    def __init__(self, p: NearDedup):
        self.p, self.bins = p, p.bands * p.rows
        self.shift = U64(64 - (self.bins.bit_length() - 1))
        self.walk = mix(np.arange(self.bins * 64, dtype=U64) + U64(0x5851F42D4C957F2D)).reshape(64, self.bins) & U64(self.bins - 1)
        self.salt = mix(np.arange(1, p.bands + 1, dtype=U64))

    def step(self, t: int) -> np.ndarray:
        """Where each bin looks at its t-th try."""
        if t < len(self.walk):
            return self.walk[t].astype(np.int64)
        return (mix(np.arange(self.bins, dtype=U64) + U64(t * self.bins) + U64(0x5851F42D4C957F2D)) & U64(self.bins - 1)).astype(np.int64)

    def bands(self, s: np.ndarray) -> np.ndarray:
        """The bucket keys of a sorted set that isn't empty."""
        bins = (s >> self.shift).astype(np.int64)
        lead = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        own = np.full(self.bins, -1, np.int64)
        own[bins[lead]] = lead
        sig = own.copy()
        empty, t = np.flatnonzero(sig < 0), 0
        while len(empty):
            sig[empty] = own[self.step(t)[empty]]
            empty, t = empty[sig[empty] < 0], t + 1
        rows = s[sig].reshape(self.p.bands, self.p.rows)
        key = self.salt.copy()
        for k in range(self.p.rows):
            key = mix(key ^ rows[:, k]) * U64(0x9E3779B97F4A7C15)
        return key


def features(docs: DataFrame, p: NearDedup) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null: empty set), bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer(p)
        for b, raw, offs in sliced(batches, "text"):
            sets = shingle_sets(raw, offs, p.words)
            keys = [signer.bands(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32), np.concatenate(keys)),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _full_sets(docs: DataFrame, p: NearDedup) -> DataFrame:
    """c, the bytes of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, offs in sliced(batches, "text"):
            yield pa.record_batch([b.column("c"), pa.array([s.tobytes() for s in shingle_sets(raw, offs, p.words)], pa.binary())], ["c", "shingles"])

    return docs.mapInArrow(run, "c long, shingles binary")


def _confirm(pairs: DataFrame, sets: DataFrame, p: NearDedup) -> DataFrame:
    """Of pairs (u, v), those with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                s, t = (np.frombuffer(z.as_buffer(), U64) for z in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                keep.append(100 * both >= p.percent * (len(s) + len(t) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("c").alias("u"), F.col("shingles").alias("x"))
    y = sets.select(F.col("c").alias("v"), F.col("shingles").alias("y"))
    # the centres of stars are mostly u: their sets come first, so that no set is sent to the key of many pairs
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _shared(left: DataFrame, sets: DataFrame, p: NearDedup, staged: Staged) -> tuple[DataFrame, DataFrame]:
    """What the classes of left(c, n, comp) share with classes of other components in left.

    First, for each class, how many shingles it shares at all (e) and how many of these are common, in more than `rare`
    classes (h). Second, the pairs (u, un, v, vn) of classes of different components that share a rare shingle; at most
    `rare` classes meet under one. A class that shares too little to be linked with anything takes no part.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                s = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("shingles")]
                take = pa.array(np.repeat(np.arange(len(s)), [len(x) for x in s]))
                yield pa.record_batch([*(part.column(c).take(take) for c in ("c", "n", "comp")), pa.array(np.concatenate(s))], ["c", "n", "comp", "s"])

    rows = left.select("c", "n", "comp").distinct().join(sets, "c").select("c", "n", "comp", "shingles")
    rows = staged.write(rows.mapInArrow(spread, "c long, n long, comp long, s long"))
    met = rows.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), (F.count("*") > p.rare).alias("common")).filter("lo < hi").select("s", "common")
    both = staged.write(rows.join(met, "s"))
    staged.drop(rows)
    sizes = staged.write(both.select("c", "s", "common").distinct().groupBy("c").agg(F.count("*").alias("e"), F.count_if("common").alias("h")))
    able = sizes.select("c", "e")
    few = both.filter("not common").join(able, "c").filter(F.col("e") * 100 >= F.col("n") * p.percent)
    met = few.groupBy("s").agg(F.collect_set(F.struct("c", "n", "comp", "e")).alias("x"))
    pair = met.filter("size(x) > 1").select("x", F.explode("x").alias("y")).select("y", F.explode("x").alias("z")).filter("y.c < z.c and y.comp <> z.comp")
    bound = F.least("y.e", "z.e") * (100 + p.percent) >= (F.col("y.n") + F.col("z.n")) * p.percent
    return sizes.select("c", "h"), pair.filter(bound).select(F.col("y.c").alias("u"), F.col("y.n").alias("un"), F.col("z.c").alias("v"), F.col("z.n").alias("vn")).distinct()


def _stars(comp: DataFrame) -> DataFrame:
    return comp.filter("v <> component").select(F.col("component").alias("u"), "v")


def links(docs: DataFrame, feats: DataFrame, p: NearDedup, staged: Staged) -> tuple[DataFrame, DataFrame]:
    """The classes (digest, c: their smallest doc_id) and the components (v, component) of those with a link."""
    known = feats.filter("digest is not null and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("c"))
    heads = staged.write(classes.join(known.select(F.col("doc_id").alias("c"), "digest", "n_shingles", "bands"), ["digest", "c"]).drop("digest"))
    rows = heads.select("c", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    # buckets with two members or more; the smallest is the first centre, found before the shuffle in part
    first = rows.groupBy("bucket").agg(F.min("c").alias("c"), F.min_by("n", "c").alias("n"), F.max("c").alias("hi"), F.count("*").alias("rows")).filter("c < hi")
    first = staged.write(first.select("bucket", F.struct("c", "n").alias("m"), "rows"))
    members = staged.write(salted_join(rows, first, ["bucket"], "rows", ["c"]).drop("rows"))
    # only texts that may be asked for are shuffled
    wanted = staged.write(members.select("c").distinct())
    texts = may_meet(docs.select(F.col("doc_id").cast("long").alias("c"), "text"), F.col("c"), bitmap(wanted, "c")).join(wanted, "c")
    sets = staged.write(_full_sets(texts, p))
    staged.drop(first, wanted)

    # a pair outside these sizes can't reach the similarity
    apt = (F.col("u") != F.col("v")) & (F.least("un", "vn") * 100 >= F.greatest("un", "vn") * p.percent)
    pair = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    star = members.select(F.col("m.c").alias("u"), F.col("m.n").alias("un"), F.col("c").alias("v"), F.col("n").alias("vn"))
    tried = staged.write(star.filter(apt).select(*pair).distinct())
    # written first: a Python step on another's rows would take a second worker in every task
    comp = connected_components(staged.write(_confirm(tried, sets, p)), staged)
    # an intersection of m can't link sets of together `sizes` shingles otherwise
    bound = lambda m, sizes: (F.col(m) if isinstance(m, str) else m) * (100 + p.percent) >= sizes * p.percent
    own = W.partitionBy("bucket")
    lo, hi = F.min("comp").over(own).alias("lo"), F.max("comp").over(own).alias("hi")
    named = lambda rows: rows.join(comp.withColumnRenamed("v", "c"), "c", "left").withColumn("comp", F.coalesce("component", "c")).drop("component")

    def ranked(rows: DataFrame) -> DataFrame:
        """Of open buckets, with the smallest size in each, the classes that a pair can still link, numbered.

        Two classes that share no rare shingle share common ones only; a class too far from even the smallest member is done
        with in that bucket, and a bucket that has one component left is, too.
        """
        near = rows.filter(bound("h", F.col("n") + F.col("least"))).drop("least").select("*", lo, hi).filter("lo < hi").drop("lo", "hi")
        return near.withColumn("rank", F.row_number().over(own.orderBy("c")))

    # what is left of a bucket is of interest while it holds two components; a centre that had its turn is done with
    now = named(members.filter("c <> m.c").select("bucket", "c", "n"))
    open_ = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least")).filter("lo < hi")
    left, n = staged.counted(now.join(open_.select("bucket", "least"), "bucket"))
    if not n:
        return classes, comp
    sizes, rare = _shared(left, sets, p, staged)
    # the bucket keys go along: two classes share many buckets as a rule; they are paired in the first one only, when its turn comes
    more = heads.select("c", "bands").join(left.select("c").distinct(), "c").distinct().join(sizes, "c", "left").withColumn("h", F.coalesce("h", F.lit(0)))
    left, n, most = staged.counted(ranked(left.join(more, "c").filter(F.array_contains("bands", F.col("bucket")))), F.max("rank"))
    centres = p.centres
    while n or rare is not None:
        hub = left.filter(F.col("rank") <= centres).select("bucket", F.col("c").alias("u"), F.col("n").alias("un"), F.col("comp").alias("ucomp"), F.col("h").alias("uh"), F.col("bands").alias("ubands"))
        first_shared = F.get(F.array_intersect("ubands", "bands"), F.lit(0)) == F.col("bucket")
        pairs = left.join(hub, "bucket").filter("comp <> ucomp").filter(bound(F.least("h", "uh"), F.col("n") + F.col("un")) & first_shared).select("u", "un", F.col("c").alias("v"), F.col("n").alias("vn"))
        pairs = pairs if rare is None else pairs.union(rare)
        pairs = staged.write(pairs.filter(apt).select(*pair).distinct().join(tried, ["u", "v"], "left_anti"))
        new, n = staged.counted(_confirm(pairs, sets, p))
        if n:
            comp = connected_components(_stars(comp).union(new), staged)
        tried, rare = tried.union(pairs), None
        # a bucket is sorted for its numbers already, so no join is needed for what it holds
        rest = named(left.filter(F.col("rank") > centres).drop("comp", "rank")).select("*", lo, hi, F.min("n").over(own).alias("least"))
        left, n, most = staged.counted(ranked(rest.filter("lo < hi").drop("lo", "hi")), F.max("rank"))
        centres = max(centres * 4, most if n and most <= p.last else 0)
    return classes, comp


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id, kept: one row for each input row."""
    staged = Staged(docs.sparkSession)
    feats = staged.write(features(docs, p))
    classes, comp = links(docs, feats, p, staged)
    known = feats.filter("digest is not null and doc_id is not null")
    # rows that share a doc_id are one document, so their classes are linked
    twice = known.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("doc_id")
    if not twice.isEmpty():
        ends = known.join(twice, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("u"), F.col("c").alias("v"))
        comp = connected_components(_stars(comp).union(ends), staged)
    of = classes.join(comp.withColumnRenamed("v", "c"), "c", "left").select("digest", F.coalesce("component", "c").alias("component_id"))
    own = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    out = feats.select("doc_id", "n_shingles", "digest").join(of, "digest", "left")
    out = staged.write(out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept")))
    staged.keep(out)
    return out


def drop_near_duplicates(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """docs without all but one row of each group; the columns stay. Of rows that share a doc_id, one stays."""
    staged = Staged(docs.sparkSession)
    gone = staged.write(near_duplicates(docs, p).filter("not kept").select(F.col("doc_id").alias("gone")).distinct())
    # only documents that may go are shuffled
    bits, key = staged.write(bitmap(gone, "gone")), F.col("doc_id").cast("long")
    some = may_meet(docs, key, bits)
    left = cannot_meet(docs, key, bits).union(some.join(gone, some["doc_id"].cast("long") == gone["gone"], "left_anti"))
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left
    rows = left.select(F.struct(*docs.columns).alias("row"))
    place = F.row_number().over(W.partitionBy("row.doc_id").orderBy("row.text"))
    return rows.withColumn("place", place).filter("place = 1 or row.doc_id is null").select("row.*")
