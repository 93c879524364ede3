"""Best-fit packing of token sequences, by linear grouping or, where that takes more sequences, longest first.

Lengths are counted first: the plan is made on the driver from at most `capacity` counts, whatever the number of
documents. Lengths above `small` are split into groups of equal cardinality and rounded up to their group's longest; over
these few sizes, column generation finds the fewest configurations, whose whole parts are used; actual lengths take the
places of the rounded ones, which leaves them slack; what is left, and then the small ones, longest first, goes into the
fullest sequence that has room. Where rounding leaves more slack than the small ones can fill, a higher `small` is better;
the plan is made for each of a few and the best is kept. From half the capacity on, no two large ones share a sequence, and
the plan is best-fit decreasing. The plan comes out as runs of like sequences, a table whose size depends on the number of
distinct lengths. Documents then find their places by their rank among those of their length.

Defined cases: a null or empty text is the end mark alone; repeated rows and null ids are documents of their own. Only a
document longer than a sequence is cut; its first piece takes the remainder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brindle.llm._text import sliced
from brindle.llm._tokens import tokenizer
from brindle.session import Staged


@dataclass(frozen=True)
class Packing:
    """ranks: the vocabulary file of ranks, pattern: its split; end: closes a document.

    small: lengths up to which an item is small; each is tried, and the plan of fewest sequences is taken. groups: of the
    large ones. buckets: into which the documents of one length are split.
    """

    ranks: str
    pattern: str
    capacity: int = 2048
    end: int = 0
    small: tuple[int, ...] = (512, 1024)
    groups: int = 64
    buckets: int = 1024


#: Sequences with the same lengths: (the lengths, how many such sequences).
Run = tuple[tuple[int, ...], int]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """The fewest sequences, in fractions, that hold demand[i] items of sizes[i]: columns (items of each size) and amounts."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(60 * k):
        amount = np.linalg.solve(basis, demand)
        price = np.linalg.solve(basis.T, np.ones(k))
        # the column of highest price: an unbounded knapsack over the capacity
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            room = c - sizes
            value = np.where(room >= 0, best[np.maximum(room, 0)] + price, -1.0)
            j = int(value.argmax())
            if value[j] > best[c - 1] + 1e-12:
                best[c], pick[c] = value[j], j
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
                continue
            column[pick[c]] += 1
            c -= int(sizes[pick[c]])
        step = np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(amount, 0) / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
    amount = np.linalg.solve(basis, demand)
    return [(basis[:, i].astype(int), float(amount[i])) for i in range(k) if amount[i] > 1e-9]


def _best_fit(runs: dict[int, list[list]], counts: dict[int, int], capacity: int) -> None:
    """Into runs by room: [lengths, number], the longest items first, each into the least room that takes it."""
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r, x in runs.items() if r >= length and x), default=None)
            if room is None:
                fit = capacity // length
                if left >= fit:
                    runs.setdefault(capacity - fit * length, []).append([(length,) * fit, left // fit])
                    left %= fit
                if left:
                    runs.setdefault(capacity - left * length, []).append([(length,) * left, 1])
                break
            lengths, number = runs[room].pop()
            took = min(left, number)
            if took < number:
                runs[room].append([lengths, number - took])
            runs.setdefault(room - length, []).append([(*lengths, length), took])
            left -= took


def plan(counts: dict[int, int], capacity: int, small: int, groups: int) -> list[Run]:
    """Runs of sequences that hold counts[length] items of every length, each length at most capacity."""
    counts = {k: v for k, v in counts.items() if v}
    large = [(n, counts[n]) for n in sorted(counts, reverse=True) if n > small]
    total = sum(v for _, v in large)
    runs: dict[int, list[list]] = {}
    rest = {n: v for n, v in counts.items() if n <= small}
    if total:
        # groups of equal cardinality; a length may stand in two
        each, parts, held = -(-total // groups), [[]], 0
        for n, v in large:
            while v:
                took = min(v, each - held)
                parts[-1].append([n, took])
                v, held = v - took, held + took
                if held == each:
                    parts.append([])
                    held = 0
        parts = [p for p in parts if p]
        # groups with the same longest length are one size
        merged: dict[int, list] = {}
        for p in parts:
            merged.setdefault(p[0][0], []).extend(p)
        sizes = np.array(list(merged))
        demand = np.array([sum(v for _, v in p) for p in merged.values()], float)
        queue = [p[::-1] for p in merged.values()]
        for column, amount in sorted(configurations(sizes, demand, capacity), key=lambda x: -float(x[0] @ sizes)):
            slots = np.repeat(np.arange(len(sizes)), column).tolist()
            times = int(amount + 1e-7)
            while times and slots:
                # as many sequences as keep every slot's actual length
                heads = [queue[s] for s in slots]
                need = {s: slots.count(s) for s in set(slots)}
                if any(not q or sum(v for _, v in queue[s]) < need[s] for s, q in zip(slots, heads, strict=True)):
                    break
                took, lengths = times, []
                draw: dict[tuple[int, int], int] = {}
                for s in need:
                    want, i = need[s], 1
                    while want:
                        n, v = queue[s][-i]
                        use = min(want, v)
                        draw[s, i] = use
                        lengths += [n] * use
                        want, i = want - use, i + 1
                took = min(took, *(queue[s][-i][1] // use for (s, i), use in draw.items()))
                took = max(1, took)
                for (s, i), use in draw.items():
                    queue[s][-i][1] -= use * took
                for s in need:
                    queue[s][:] = [x for x in queue[s] if x[1]]
                runs.setdefault(capacity - sum(lengths), []).append([tuple(lengths), took])
                times -= took
        for q in queue:
            for n, v in q:
                rest[n] = rest.get(n, 0) + v
    _best_fit(runs, rest, capacity)
    return [(tuple(lengths), number) for x in runs.values() for lengths, number in x if number]


def slots(runs: list[Run]) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks and where they go: rank -> sequence first + (rank - low), at offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, number in runs:
        offset = 0
        for n in lengths:
            low = used.get(n, 0)
            rows.append((n, low, sequence, offset))
            used[n] = low + number
            offset += n
        sequence += number
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "low", "sequence", "offset"), cols.T, strict=True))


def pieces(docs: DataFrame, p: Packing) -> DataFrame:
    """docs(doc_id, text) to doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(p.ranks, p.pattern, p.end)
        for b, raw, offs in sliced(batches, "text", 1 << 19):
            data = raw.tobytes()
            rows = []
            for k, ids in enumerate(tok.encode([data[x:y].decode() for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])):
                n, start, piece = len(ids), 0, 0
                stop = n % p.capacity or p.capacity
                while start < n:
                    rows.append((k, piece, start, stop - start, zlib.crc32(ids[start:stop].astype("<u4").tobytes())))
                    start, stop, piece = stop, stop + p.capacity, piece + 1
            cols = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.record_batch(
                [b.column("doc_id").take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *(pa.array(c) for c in cols[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, p: Packing) -> DataFrame:
    """docs(doc_id, text) to doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = Staged(docs.sparkSession).write(pieces(docs, p))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    tried = [plan(counts, p.capacity, small, p.groups) for small in p.small]
    table = slots(min(tried, key=lambda runs: sum(number for _, number in runs)))
    # the rank within a length: a place within a bucket, and the buckets before it
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(p.buckets)))
    cells = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("place", place).join(cells.select("length", "bucket", before.alias("before")), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (table["length"] << 40) | table["low"]
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 40) | rank, side="right") - 1
            got = [pa.array(table["sequence"][at] + rank - table["low"][at]), pa.array(table["offset"][at])]
            yield pa.record_batch([*b.columns[:5], *got], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
