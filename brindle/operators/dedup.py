"""Near-duplicate clusters of signatures, label conflicts, and keeping one of each.

A signature is four 15-bit bands (texts) or any four words (perceptual hashes); candidates share a band, by which they are
dealt out; a Hamming distance confirms them; components make clusters. Equal signatures are collapsed before that.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window as W

from brindle.operators.graph import connected_components
from brindle.session import Staged, dealt, ship

BANDS, BITS = 4, 15


@lru_cache(maxsize=1 << 17)
def _hash(word: bytes) -> int:
    """The first 60 bits of md5, and above them a one that counts; 0 for the empty ends of a split."""
    return int.from_bytes(hashlib.md5(word).digest()[:8], "big") >> 4 | 1 << 60 if word else 0


def _votes(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(key, words) to key, n and 30 sums of bits, two to a long."""
    half, run = BANDS * BITS // 2, 255
    for b in batches:
        n = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        votes = np.zeros((len(n), 64), np.int64)
        full = np.flatnonzero(n)
        if len(full):
            coded = b.column(1).flatten().dictionary_encode()
            h = np.array([_hash(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], "<u8")
            # a byte for each bit, eight of them added as one number: runs of 255 words can't carry
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
            code = coded.indices.to_numpy()
            runs = -(-n[full] // run)
            first = np.cumsum(runs) - runs
            at = np.append(np.repeat(np.cumsum(n[full]) - n[full] - run * first, runs) + run * np.arange(runs.sum()), len(code))
            parts = [np.add.reduceat(bits[code[at[k] : at[min(k + 512, len(at) - 1)]]], at[k : min(k + 512, len(at) - 1)] - at[k], axis=0) for k in range(0, len(at) - 1, 512)]
            votes[full] = np.add.reduceat(np.concatenate(parts).view(np.uint8), first, axis=0, dtype=np.int64)
        sums = votes[:, :half] + (votes[:, half : 2 * half] << 31)
        yield pa.record_batch([b.column(0), pa.array(votes[:, 2 * half]), *(pa.array(sums[:, k].copy()) for k in range(half))], schema=schema)


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, b0..b3: sign bits of summed word hashes, 15 to a band; nulls for a text without words, which nothing is near to.

    A word is a run of letters and digits of any script. A batch hashes its distinct words and sums their bits text by text; two
    counters share a long, so that a text is 30 sums.
    """
    ship(docs.sparkSession)
    docs = dealt(docs.select(key, text))
    words = docs.select(key, F.split(F.lower(text), r"[^\p{L}\p{N}]+").alias("w"))
    half = BANDS * BITS // 2
    kind = StructType([words.schema[0], *(StructField(c, LongType()) for c in ("n", *(f"v{k}" for k in range(half))))])
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from _votes(chain([first], batches), pa.schema([first.schema.field(0), *(pa.field(c, pa.int64()) for c in names[1:])]))

    summed = words.mapInArrow(run, kind).groupBy(key).agg(*(F.sum(c).alias(c) for c in names[1:]))

    def bit(k: int) -> str:
        count = f"(v{k} & 2147483647L)" if k < half else f"shiftright(v{k - half}, 31)"
        return f"(case when 2 * {count} > n then {1 << (k % BITS)}L else 0L end)"

    bands = [F.expr(" + ".join(bit(b * BITS + i) for i in range(BITS))).alias(f"b{b}") for b in range(BANDS)]
    return summed.select(key, *(F.when(F.col("n") > 0, band).alias(f"b{b}") for b, band in enumerate(bands)))


def _words(n: int = BANDS) -> list[str]:
    return [f"b{k}" for k in range(n)]


def candidate_pairs(sigs: DataFrame, key: str = "doc_id", max_hamming: int = 6, cap: int | None = None, crowded: int = 2000) -> DataFrame:
    """(u, v, distance), u < v: representatives of equal signatures that share a band and are near enough. Null ones take no part.

    A bucket of more than `crowded` representatives is split by parts of the signature, bits k, k + m, ... of every word for k
    below m = max_hamming + 1. Of m parts, signatures that differ in fewer bits share at least one, so no pair is lost. A pair
    is given by the first place that it shares, so pairs aren't shuffled. With a cap, buckets of more representatives than that
    are left out instead; `skipped_buckets` lists them.
    """
    rows = placed(sigs, key, max_hamming, cap, crowded)
    kind = StructType([*(StructField(c, rows.schema["id"].dataType) for c in "uv"), StructField("distance", IntegerType())])
    once = cap is None  # else the first place may be left out
    pairs = _by_place(rows, kind, lambda *place: _pairs(*place, max_hamming, once))
    return pairs if once else pairs.distinct()


def placed(sigs: DataFrame, key: str, max_hamming: int, cap: int | None, crowded: int) -> DataFrame:
    """parted() representatives of equal signatures, in the buckets of more than one."""
    rows = bands(sigs.filter(F.col("b0").isNotNull()).groupBy(*_words()).agg(F.min(key).alias("id")))
    sized = rows.groupBy("band", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    if cap is not None:
        sized = sized.filter(F.col("n") <= cap).withColumn("n", F.lit(0))
    return parted(rows, sized, max_hamming, crowded)


def bands(reps: DataFrame) -> DataFrame:
    """id, s (the words), band, bits: a row a band of each representative(id, words)."""
    return reps.select("id", F.struct(*_words()).alias("s"), F.posexplode(F.array(*_words())).alias("band", "bits"))


def _masks(max_hamming: int) -> list[int]:
    m = max_hamming + 1  # parts beyond the 64th are empty, and so equal
    masks = [sum(1 << i for i in range(k, 64, m)) for k in range(m)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def parted(rows: DataFrame, sized: DataFrame, max_hamming: int, crowded: int) -> DataFrame:
    """bands() in the buckets of sized(band, bits, n), with p: the part of the signature that a crowded bucket is split by."""
    part = [F.struct(F.lit(k).alias("part"), *(F.col(f"s.{w}").cast("long").bitwiseAND(F.lit(x)).alias(w) for w in _words())) for k, x in enumerate(_masks(max_hamming))]
    whole = F.struct(F.lit(-1).alias("part"), *(F.lit(0).cast("long").alias(w) for w in _words()))
    split = F.explode(F.when(F.col("n") > crowded, F.array(*part)).otherwise(F.array(whole))).alias("p")
    own = rows.columns
    rows = rows.join(sized, ["band", "bits"]).select(*own, split)
    return rows.select(*own, *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("part", *_words())))


def links(rows: DataFrame, max_hamming: int) -> DataFrame:
    """(u, v): in every place of parted() rows a star of each component that the near enough ones there make, not all pairs.

    What is found needn't be found again, so a place of n rows costs n links at most, and memory for its n rows and 2**20
    distances at a time. fresh, if rows have it: two rows without it aren't compared.
    """
    kind = StructType([StructField(c, rows.schema["id"].dataType) for c in "uv"])
    return _by_place(rows, kind, lambda ids, words, fresh, _: _hung(ids, words, fresh, max_hamming))


#: What rows have in common that are compared.
PLACE = ["band", "bits", *(f"p_{c}" for c in ("part", *_words()))]
#: Distances held at once.
CELLS = 1 << 20

Columns = tuple[np.ndarray, ...]


def _by_place(rows: DataFrame, kind: StructType, work: Callable[..., Iterable[Columns]]) -> DataFrame:
    """What work makes of each place's ids (in their order), words, fresh and PLACE, in columns."""
    ship(rows.sparkSession)
    fresh = F.col("fresh") if "fresh" in rows.columns else F.lit(True)
    rows = rows.dropna(subset=["id", *(f"s.{w}" for w in _words())]).select("id", *(F.col(f"s.{w}").cast("long").alias(w) for w in _words()), fresh.alias("fresh"), *(F.col(c).cast("long").alias(c) for c in PLACE))
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []
        n, key = 0, None
        made = lambda: pa.record_batch([pa.array(np.concatenate(x), key if k < 2 else None) for k, x in enumerate(zip(*held, strict=True))], names)
        for got, key in _worked(batches, work):
            held.append(got)
            n += len(got[0])
            if n >= 50_000:
                yield made()
                held, n = [], 0
        if held:
            yield made()

    return rows.repartition(*PLACE).sortWithinPartitions(*PLACE, "id").mapInArrow(run, kind)


def _worked(batches: Iterator[pa.RecordBatch], work: Callable[..., Iterable[Columns]]) -> Iterator[tuple[Columns, pa.DataType]]:
    held: list[Columns] = []  # pieces of one place
    where = kind = None

    def done() -> Iterator[tuple[Columns, pa.DataType]]:
        if sum(len(p[0]) for p in held) > 1:
            place = held[0] if len(held) == 1 else tuple(np.concatenate([p[k] for p in held], axis=-1) for k in range(3))
            for x in work(*place, where):
                if len(x[0]):
                    yield x, kind

    for b in batches:
        kind = b.schema.field(0).type
        ids = b.column(0).to_numpy(zero_copy_only=False)
        words = np.stack([b.column(k).to_numpy() for k in range(1, BANDS + 1)])
        fresh = b.column(BANDS + 1).to_numpy(zero_copy_only=False)
        place = np.stack([b.column(k).to_numpy() for k in range(BANDS + 2, b.num_columns)])
        cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
        for lo, hi in pairwise([0, *cuts.tolist(), b.num_rows]):
            if hi > lo:
                if held and (place[:, lo] != where).any():
                    yield from done()
                    held = []
                where = place[:, lo]
                held.append((ids[lo:hi], words[:, lo:hi], fresh[lo:hi]))
    yield from done()


def _packed(words: np.ndarray) -> np.ndarray:
    """Words of up to 16 bits as one."""
    w = words.view(np.uint64)
    if ((words >= 0) & (words < 1 << 16)).all():
        return (w[0] | w[1] << np.uint64(16) | w[2] << np.uint64(32) | w[3] << np.uint64(48))[None]
    return w


def _apart(w: np.ndarray, a: np.ndarray | slice, b: np.ndarray | slice) -> np.ndarray:
    """Distances of all a to all b."""
    each = (np.bitwise_count(x[a][:, None] ^ x[b][None]) for x in w)
    return next(each) if len(w) == 1 else reduce(np.add, (x.astype(np.uint16) for x in each))


def _pairs(ids: np.ndarray, words: np.ndarray, fresh: np.ndarray, place: np.ndarray, far: int, once: bool) -> Iterator[Columns]:
    """u, v, distance of one place, a square of CELLS at a time; once: only those that share no place before it."""
    w, masks = _packed(words), _masks(far)
    band, part, side = int(place[0]), int(place[2]), math.isqrt(CELLS)
    for i in range(0, len(ids), side):
        for j in range(i, len(ids), side):
            apart = _apart(w, slice(i, i + side), slice(j, j + side))
            a, b = np.nonzero(np.triu(apart <= far, 1) if i == j else apart <= far)
            distance, a, b = apart[a, b].astype(np.int32), a + i, b + j
            ok = ids[a] != ids[b]
            if once:
                bits = words[:, a] ^ words[:, b]
                ok &= (bits[:band] != 0).all(axis=0)
                some = np.bitwise_or.reduce(bits, axis=0)
                for m in masks[: max(part, 0)]:
                    ok &= some & m != 0
            yield ids[a[ok]], ids[b[ok]], distance[ok]


def _hung(ids: np.ndarray, words: np.ndarray, fresh: np.ndarray, far: int) -> list[Columns]:
    """The links of one place."""
    root = _roots(words, fresh, far)
    hung = np.flatnonzero(root != np.arange(len(root)))
    return [(ids[hung], ids[root[hung]])]


def _roots(words: np.ndarray, fresh: np.ndarray, far: int) -> np.ndarray:
    """For each signature the one whose search has reached it, else itself: from one to all that are near, and on from these."""
    w = _packed(words)

    def meet(now: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rest, those near to some of now, and the others."""
        near = np.zeros(len(rest), bool)
        for k in range(0, len(rest), CELLS):  # at least one of now at a time
            part = rest[k : k + CELLS]
            near[k : k + CELLS] = (_apart(w, now, part) <= far).any(axis=0)
        return rest[near], rest[~near]

    root = np.arange(w.shape[1])
    new, old = np.flatnonzero(fresh), np.flatnonzero(~fresh)
    while len(new):
        front, new = new[:1], new[1:]
        seed = front[0]
        while len(front) and len(new) + len(old):
            step = max(1, CELLS // (len(new) + len(old)))
            now, front = front[:step], front[step:]
            found, new = meet(now, new)
            also, old = meet(now[fresh[now]], old)
            found = np.concatenate([found, also])
            root[found] = seed
            front = np.concatenate([front, found])
    return root


def skipped_buckets(sigs: DataFrame, key: str = "doc_id", cap: int = 2000) -> DataFrame:
    """The buckets that candidate_pairs leaves out if it is given this cap."""
    reps = sigs.filter(F.col("b0").isNotNull()).groupBy(*_words()).agg(F.min(key).alias("id"))
    return reps.select(F.posexplode(F.array(*_words())).alias("band", "bits")).groupBy("band", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > cap)


def clusters(sigs: DataFrame, key: str = "doc_id", max_hamming: int = 6, cap: int | None = None, crowded: int = 16_000) -> DataFrame:
    """key, dup_cluster: the smallest key of the component; hashed: whether there is a signature. Without one a row is alone.

    The pairs grow with the square of a crowd of near copies; only `links` of each bucket are made and shuffled.
    """
    staged = Staged(sigs.sparkSession)
    sigs = staged.write(sigs.select(key, *_words()))
    comp = connected_components(staged.write(links(placed(sigs, key, max_hamming, cap, crowded), max_hamming)), staged)
    known = sigs.filter(F.col("b0").isNotNull())
    reps = known.groupBy(*_words()).agg(F.min(key).alias("v")).join(comp, "v", "left").select(*_words(), F.coalesce("component", "v").alias("dup_cluster"))
    hashed = known.join(reps, _words()).select(key, "dup_cluster", F.lit(True).alias("hashed"))
    return hashed.union(sigs.filter(F.col("b0").isNull()).select(key, F.col(key).alias("dup_cluster"), F.lit(False).alias("hashed")))


def conflicts(rows: DataFrame) -> DataFrame:
    """Clusters with more than one label that isn't null."""
    return rows.groupBy("dup_cluster").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.countDistinct("label").alias("n_labels"), F.count("*").alias("n")).filter("lo <> hi").select("dup_cluster", "n_labels", "n")


def keep_largest(rows: DataFrame, key: str, drop_cross_class: bool = True, order: str | None = None) -> DataFrame:
    """Without conflicting clusters, one row per cluster and label: the largest area_ratio, nulls last, then the smallest key.

    order: a column by whose order, that of the input, the rows are returned.
    """
    if drop_cross_class:
        rows = rows.join(conflicts(rows).select("dup_cluster"), "dup_cluster", "left_anti")
    by = W.partitionBy("dup_cluster", "label").orderBy(F.col("area_ratio").desc_nulls_last(), key)
    kept = rows.withColumn("_rank", F.row_number().over(by)).filter("_rank = 1").drop("_rank")
    return kept.orderBy(order) if order else kept


def dedup_info(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: counts, what conflicts took, the duplicate rate, and whether the rate is alarming."""
    hashed = F.count_if(F.col("hashed")) if "hashed" in before.columns else F.count("dup_cluster")
    b = before.agg(F.count("*").alias("before"), hashed.alias("hashed"), F.countDistinct("dup_cluster").alias("clusters"))
    c = conflicts(before).agg(F.count("*").alias("cross_class_clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("cross_class_rows"))
    a = after.agg(F.count("*").alias("after"))
    rate = F.round(1.0 - F.col("after") / F.greatest("before", F.lit(1)), 4)
    return b.crossJoin(c).crossJoin(a).select("before", "hashed", "clusters", "cross_class_clusters", "cross_class_rows", "after", (F.col("before") - F.col("after")).alias("removed"), rate.alias("duplicate_rate"), (rate > 0.5).alias("alarm"))


def ensure_rows_left(info: DataFrame) -> None:
    """An error if dedup_info() says that nothing is left of something. Runs the job of one row."""
    r = info.first()
    if r["before"] and not r["after"]:
        raise ValueError(f"none of {r['before']} rows is left; {r['cross_class_rows']} were in clusters of conflicting labels")
