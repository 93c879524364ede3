"""Centroid clustering (k-means on integer vectors) with Elkan's bounds.

Vectors travel in blocks of a few thousand, one row a block: their integers, the cluster of each, an upper bound of its
distance to its centroid, and k lower bounds of its distances to all. A round is one narrow pass over the cached blocks and a
sum of k x (width + 1) numbers, so nothing is shuffled but those sums, and an executor that is lost costs the recomputing of
its own blocks: every pass depends on the blocks before it and on the round's centroids only.

In a pass, centroids have moved: upper bounds grow and lower bounds shrink by how far. A vector whose upper bound is below
half the distance from its centroid to the next one keeps its cluster without a look at its components. For the others the
distance to their centroid is computed, and then only those to centroids that neither a lower bound nor half the distance
between the two centroids rules out.

Distances that decide are squared and exact integers. Bounds are single-precision square roots: upper ones are rounded up,
lower ones down, and a centroid is ruled out only if it is strictly farther, so that ties reach the comparison, where the
smaller number wins.

Defined cases: a vector that is null, has another number of components, or a null or non-finite one, is left out. Components
are floor(1024 * x), drawn to +-2**27 where they pass it (|x| of 131,072 and more), so that distances fit a long. A null
vec_id is clustered, but is no initial centroid. Repeated rows count as often as they come. Fewer vectors than k: as many
centroids. No vectors: no rows. Vectors with equal digests (a repeated vec_id) stand in the order of their components. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import dealt

#: The largest component, and the largest with which squared distances stay exact in double precision (64 components).
LARGEST, EXACT = 1 << 27, 1 << 21


@dataclass(frozen=True)
class Clustering:
    """k clusters of vectors of `width` components, times `scale` and floored; `rounds` of moving centroids; block: vectors a row."""

    k: int = 8
    width: int = 64
    scale: int = 1024
    rounds: int = 10
    salt: str = "3:"
    block: int = 4096


def _usable(vecs: DataFrame, p: Clustering) -> DataFrame:
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vecs.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).filter((F.size(x) == p.width) & finite)


def _integers(values: np.ndarray, p: Clustering) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * p.scale), -LARGEST, LARGEST).astype(np.int32)


def _initial(vecs: DataFrame, p: Clustering) -> list[list[int]]:
    """The k vectors of smallest digest, in its order."""
    digest = F.sha2(F.concat(F.lit(p.salt), F.col("vec_id").cast("string")), 256)
    top = vecs.filter("vec_id is not null").select(digest.alias("d"), "embedding").orderBy("d", "embedding").limit(p.k).collect()
    return [_integers(np.array(r["embedding"], float), p).tolist() for r in top]


def squared(x: np.ndarray, c: list[int]) -> np.ndarray:
    """Exact squared distances of the rows of x (int32) to c."""
    wide = max(int(np.abs(x).max(initial=0)), max(map(abs, c), default=0)) > EXACT
    d = x.astype(np.int64 if wide else np.float64) - np.array(c, np.int64 if wide else np.float64)
    return np.einsum("ij,ij->i", d, d).astype(np.int64)


def _up(x: np.ndarray) -> np.ndarray:
    """Not below x."""
    return np.nextafter(np.nextafter(x, np.inf).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    """Not above x, and not below 0."""
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _between(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


@dataclass(frozen=True)
class Move:
    """A round's centroids, how far at most each came, and half the least distances from each to the others."""

    centroids: list[list[int]]
    moved: np.ndarray
    half: np.ndarray  # [k, k], infinite on the diagonal

    @classmethod
    def of(cls, before: list[list[int]], now: list[list[int]]) -> Move:
        k = len(now)
        # an integer square root is below the root by less than one
        moved = np.array([math.isqrt(s) + (math.isqrt(s) ** 2 < s) for s in (_between(a, b) for a, b in zip(before, now, strict=True))], np.float64)
        half = np.full((k, k), np.inf)
        for i in range(k):
            for j in range(i):
                half[i, j] = half[j, i] = _down(np.array(math.sqrt(_between(now[i], now[j])) / 2 * (1 - 1e-12)))
        return cls(now, moved, half)


def first_pass(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clusters, upper bounds and lower bounds [k, n], all distances computed."""
    d = np.stack([squared(x, c) for c in centroids])
    a = d.argmin(axis=0)  # the first of equal ones
    root = np.sqrt(d.astype(np.float64))
    return a.astype(np.int32), _up(root[a, np.arange(len(x))]), _down(root)


def next_pass(x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, m: Move) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after centroids have moved, and how many distances were computed."""
    k, a = len(m.centroids), a.copy()
    upper = _up(upper.astype(np.float64) + m.moved[a])
    lower = _down(lower.astype(np.float64) - m.moved[:, None])
    open_ = np.flatnonzero(~(upper < m.half.min(axis=1)[a]))
    if not len(open_):
        return a, upper, lower, 0
    own, computed = np.zeros(len(open_), np.int64), len(open_)
    mine = a[open_]
    for j in range(k):
        at = np.flatnonzero(mine == j)
        if len(at):
            own[at] = squared(x[open_[at]], m.centroids[j])
            lower[j, open_[at]] = _down(np.sqrt(own[at].astype(np.float64)))
    top = _up(np.sqrt(own.astype(np.float64)))
    first = mine.copy()
    for j in range(k):
        at = np.flatnonzero((first != j) & ~(top < lower[j, open_]) & ~(top < m.half[mine, j]))
        if not len(at):
            continue
        d = squared(x[open_[at]], m.centroids[j])
        computed += len(at)
        root = np.sqrt(d.astype(np.float64))
        lower[j, open_[at]] = _down(root)
        nearer = (d < own[at]) | ((d == own[at]) & (j < mine[at]))
        won = at[nearer]
        own[won], mine[won], top[won] = d[nearer], j, _up(root[nearer])
    a[open_], upper[open_] = mine, top
    return a, upper, lower, computed


BLOCK = "ids array<long>, x binary, a binary, upper binary, lower binary, sums array<long>"


def _block(ids: pa.Array, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    """A row of BLOCK. sums: for each cluster its number of vectors, then the sums of their components."""
    k = len(lower)
    sums = np.zeros((k, x.shape[1] + 1), np.int64)
    for j in range(k):
        mine = x[a == j]
        sums[j, 0], sums[j, 1:] = len(mine), mine.sum(axis=0, dtype=np.int64)
    one = lambda v: pa.array([v.tobytes()], pa.binary())
    return pa.record_batch([pa.ListArray.from_arrays([0, len(ids)], ids), one(x), one(a), one(upper), one(lower), pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], ["ids", "x", "a", "upper", "lower", "sums"])


def _opened(b: pa.RecordBatch, i: int, p: Clustering, k: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    of = lambda c, t: np.frombuffer(b.column(c)[i].as_buffer(), t)
    x = of("x", np.int32).reshape(-1, p.width)
    return b.column("ids")[i].values, x, of("a", np.int32), of("upper", np.float32), of("lower", np.float32).reshape(k, -1)


def _blocks(vecs: DataFrame, centroids: list[list[int]], p: Clustering) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            x = np.concatenate(parts)
            out = _block(pa.concat_arrays(ids), x, *first_pass(x, centroids))
            ids.clear()
            parts.clear()
            return out

        for b in batches:
            if not b.num_rows:
                continue
            x = _integers(b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, p.width), p)
            at = 0
            while at < len(x):
                to = min(len(x), at + p.block - sum(map(len, parts)))
                ids.append(b.column("vec_id").slice(at, to - at))
                parts.append(x[at:to])
                at = to
                if sum(map(len, parts)) == p.block:
                    yield flush()
        if parts:
            yield flush()

    return vecs.mapInArrow(run, BLOCK)


def _moved(blocks: DataFrame, m: Move, p: Clustering) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, x, a, upper, lower = _opened(b, i, p, len(m.centroids))
                yield _block(ids, x, *next_pass(x, a, upper, lower, m)[:3])

    return blocks.mapInArrow(run, BLOCK)


def _settle(blocks: DataFrame, before: list[list[int]], p: Clustering) -> list[list[int]]:
    """The centroids after this pass: exact floors of means; those without vectors stay. Reads k * (width + 1) sums."""
    rows = blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r["at"]: int(r["s"]) for r in rows}
    out, w = [], p.width + 1
    for j, c in enumerate(before):
        n = sums.get(j * w, 0)
        out.append([sums[j * w + 1 + i] // n for i in range(p.width)] if n else c)
    return out


def cluster(vecs: DataFrame, p: Clustering = Clustering()) -> DataFrame:
    """vecs(vec_id, embedding) to vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row a vector kept."""
    kept = _usable(vecs, p)
    spark = vecs.sparkSession
    schema = "vec_id long, cluster int, distance long"
    more = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = _initial(kept, p)
    if not centroids:
        return spark.createDataFrame([], f"{schema}, {more.split(', ', 1)[1]}")
    last, blocks = None, _blocks(dealt(kept), centroids, p).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(p.rounds):
        # the sums make a pass whole in the cache; the one before it may go then
        now = _settle(blocks, centroids, p)
        if last is not None:
            last.unpersist()
        last, blocks, centroids = blocks, _moved(blocks, Move.of(centroids, now), p).persist(StorageLevel.MEMORY_AND_DISK), now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, x, a, _, _ = _opened(b, i, p, len(centroids))
                d = np.zeros(len(x), np.int64)
                for j, c in enumerate(centroids):
                    d[a == j] = squared(x[a == j], c)
                yield pa.record_batch([ids, pa.array(a), pa.array(d)], ["vec_id", "cluster", "distance"])

    out = blocks.select("ids", "x", "a", "upper", "lower").mapInArrow(run, schema)
    found = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    if last is not None:
        last.unpersist()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    most = (1 << 63) - 1
    facts = [(j, min(most, found.get(j, 0)), min(most, sum(found.values())), digest[j]) for j in range(len(centroids))]
    return out.join(F.broadcast(spark.createDataFrame(facts, more)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def cluster_sql(p: Clustering = Clustering()) -> str:
    """The same by plain SQL: every distance in every round."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor({p.scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings
WHERE len(embedding) = {p.width} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{p.salt}' || vec_id), x) - 1 AS k, x FROM v WHERE vec_id IS NOT NULL QUALIFY k < {p.k})",
    ]
    for r in range(p.rounds + 1):
        steps.append(f"d{r} AS (SELECT v.rid, c.k, {far} AS d FROM v CROSS JOIN c{r} c)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)")
        if r < p.rounds:
            steps.append(f"t{r} AS (SELECT k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (rid), range(1, {p.width + 1}) t(i) GROUP BY ALL)")
            steps.append(f"m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM t{r} GROUP BY k)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (k))")
    last = p.rounds
    return f"""WITH {", ".join(steps)} SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(c{last}.x, ',')) AS centroid_sha256 FROM a{last} JOIN v USING (rid) JOIN c{last} USING (k)"""
