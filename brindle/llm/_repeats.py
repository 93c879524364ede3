"""Windows of a fixed number of units (words or bytes) that occur twice or more anywhere in a corpus, without loss.

1. Every window names an anchor: the gram of smallest hash within it, the first of equals. Equal windows name equal grams
   at the same place, so windows that repeat meet under one anchor. Neighbouring windows of one anchor form its context;
   a context is two hashes and a place, about one for every (window - gram + 2) / 2 units.
2. Anchors are counted, combined before the shuffle. Those that occur once are done with.
3. The contexts of the rest are collapsed to the distinct ones of each anchor, with their number and first place. Whatever
   repeats a whole context repeats its windows, so copies, however many, are settled by the first.
4. The content of every distinct context is fetched from its first place and routed by anchor into shards of bounded size.
   An index over each shard (the caller's) says which of its windows repeat.
5. An anchor of more than `hot` distinct contexts would fill a task of its own. The windows of such contexts are dealt to
   `PARTS` parts by the anchor's place in the window; all windows of a part share a longer gram about the anchor, which
   becomes the part's anchor, and 3 to 5 are done again. A part's contexts are no more rows than `PARTS` for each context,
   and after a few rounds a part is one window, which no other text can crowd.

Joins on anchors and contexts deal out heavy keys by a salt. Heavy is a key with more than a ten-thousandth of the rows, so
there are fewer than ten thousand, at any size, and their list is broadcast.

A doc_id of null is smaller than all others. Rows that share doc_id and text are documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._text import _BYTE, U64, Runs, Words, mix, release, sliced, sliding_first_min
from brindle.operators.sieve import bitmap, cannot_meet, may_meet
from brindle.operators.skew import salted_join
from brindle.session import Staged

#: Units of a text that are worked on at once.
PIECE = 1 << 19


@dataclass(frozen=True)
class Repeats:
    """window, gram: in units; words: the unit is a word, else a byte; later: only later occurrences count as repeats.

    alone: the only distinct context of an anchor is sent to an index, too. No two of a context's windows are equal, as their
    anchors would stand at one place, so its number and its first place say all that the index of such a shard could.
    """

    window: int
    gram: int
    words: bool
    later: bool
    alone: bool = True
    hot: int = 1000
    shard_bytes: int = 1 << 19


#: contexts of a shard in corpus order, how often each occurs, the window -> for each the window starts that repeat, as a mask
Resolver = Callable[[list[np.ndarray], np.ndarray, int], list[np.ndarray]]

#: Parts that a crowded anchor's windows are dealt to.
PARTS = 8


def _units(r: Repeats, raw: np.ndarray, offs: np.ndarray) -> tuple[Callable[[int, int], np.ndarray], np.ndarray]:
    if r.words:
        w = Words(raw, offs)
        return (lambda a, b: w.hash[a:b]), w.offs
    return (lambda a, b: _BYTE[raw[a:b]]), offs


def anchors_of(r: Repeats, values: Callable[[int, int], np.ndarray], offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor, context, number of its text, start within the text, number of windows."""
    out: list[tuple[np.ndarray, ...]] = []
    n, w = int(offs[-1]), r.window
    for a in range(0, max(0, n - w + 1), PIECE):
        b = min(n, a + PIECE + w - 1)
        runs = Runs(values(a, b))
        at = np.arange(b - a - r.gram + 1)
        gram = runs.hash(at, at + r.gram)
        place = sliding_first_min(gram, w - r.gram + 1)
        j = np.arange(len(place))
        doc = np.searchsorted(offs, j + a, side="right") - 1
        ok = j + a + w <= offs[doc + 1]
        j, place, doc = j[ok], place[ok], doc[ok]
        if not len(j):
            continue
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (j[1:] != j[:-1] + 1) | (doc[1:] != doc[:-1])))
        lead = np.flatnonzero(new)
        count = np.diff(np.append(lead, len(j)))
        s = j[lead]
        e = s + count - 1 + w
        out.append((gram[place[lead]], mix(runs.hash(s, e) + (e - s).astype(U64)), doc[lead], s + a - offs[doc[lead]], count))
    if not out:
        return tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(keyed: DataFrame, r: Repeats) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, offs in sliced(batches, "text", PIECE):
            gram, ctx, doc, start, count = anchors_of(r, *_units(r, raw, offs))
            take = pa.array(doc)
            yield pa.record_batch(
                [b.column("doc_id").take(take), b.column("tkey").take(take), pa.array(gram.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(start), pa.array(count)],
                ["doc_id", "tkey", "anchor", "ctx", "start", "count"],
            )

    return keyed.mapInArrow(run, "doc_id long, tkey long, anchor long, ctx long, start long, count long")


def _contents(texts: DataFrame, r: Repeats) -> DataFrame:
    """From texts with their wanted contexts: the content of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, offs in sliced(batches, "text", PIECE):
            values, uoffs = _units(r, raw, offs)
            lists = b.column("wanted")
            doc, flat = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten()
            first, count = uoffs[doc] + flat.field("start").to_numpy(), flat.field("count").to_numpy()
            ends = first + count - 1 + r.window
            pieces = [(values(s, e) if r.words else raw[s:e]).tobytes() for s, e in zip(first.tolist(), ends.tolist(), strict=True)]
            take = pa.array(doc)
            cols = [flat.field("anchor"), b.column("doc_id").take(take), b.column("tkey").take(take), flat.field("start"), flat.field("n")]
            yield pa.record_batch([*cols, pa.array(pieces, pa.binary())], ["anchor", "doc_id", "tkey", "start", "n", "content"])

    return texts.mapInArrow(run, "anchor long, doc_id long, tkey long, start long, n long, content binary")


def _parted(contents: DataFrame, r: Repeats, width: int, first: bool) -> DataFrame:
    """Contents to those of their windows whose anchor stands at like places: anchor, ctx, ..., at (the anchor's place), content.

    width: places of a part. A window's place is intrinsic, so equal windows come to equal parts. The units that all windows
    of a part have in common are its anchor, whether or not a context has all of these windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            cols = ("anchor", "doc_id", "tkey", "start", "n", *(() if first else ("at",)))
            for k, (anchor, doc, tkey, start, n, *at) in enumerate(zip(*(b.column(c).to_pylist() for c in cols), strict=True)):
                c = np.frombuffer(b.column("content")[k].as_buffer(), np.int64 if r.words else np.uint8)
                runs = Runs(c.view(U64) if r.words else _BYTE[c])
                if first:  # where the gram of the anchor's hash stands
                    i = np.arange(len(c) - r.gram + 1)
                    at = [int(np.flatnonzero(runs.hash(i, i + r.gram).view(np.int64) == anchor)[0])]
                place, last = at[0], len(c) - r.window
                for j in range(max(0, place - last) // width, place // width + 1):
                    low, high = max(0, place - (j + 1) * width + 1), min(last, place - j * width)
                    ends = np.array([[place - j * width, place - (j + 1) * width + 1 + r.window], [low, high + r.window]])
                    ends[0, 1] = min(ends[0, 1], len(c))
                    one, two = runs.hash(ends[:, 0], ends[:, 1])
                    key = mix(np.array([one ^ U64(j + 1)]))
                    rows.append((int(key.view(np.int64)[0]), int(np.array([two]).view(np.int64)[0]), doc, tkey, start + low, high - low + 1, n, place - j * width - low, c[low : high + r.window].tobytes()))
            names = ["anchor", "ctx", "doc_id", "tkey", "start", "count", "n", "at", "content"]
            for x in range(0, len(rows), 5000):
                yield pa.record_batch([pa.array(v, pa.binary() if k == 8 else pa.int64()) for k, v in enumerate(zip(*rows[x : x + 5000], strict=True))], names)

    out = contents.mapInArrow(run, "anchor long, ctx long, doc_id long, tkey long, start long, count long, n long, at long, content binary")
    return out.dropDuplicates(["anchor", "doc_id", "tkey", "start"])  # of repeated rows


def _resolve(contents: DataFrame, r: Repeats, resolver: Resolver) -> DataFrame:
    """Sorted contents, a whole anchor at a time, in shards of about shard_bytes; to ranges of windows that repeat."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
        meta, number, content, held, last = [], [], [], 0, None
        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("n", "anchor", "doc_id", "tkey", "start")]
            for k, (n, anchor, *where) in enumerate(zip(*cols, strict=True)):
                if last == (anchor, where):  # of a repeated row; it must not precede itself
                    continue
                if last and anchor != last[0] and held >= r.shard_bytes:
                    yield meta, number, content
                    meta, number, content, held = [], [], [], 0
                last = anchor, where
                meta.append(where)
                number.append(n)
                content.append(np.frombuffer(b.column("content")[k].as_buffer(), np.int64 if r.words else np.uint8))
                held += content[-1].nbytes
        if meta:
            yield meta, number, content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for meta, number, content in shards(batches):
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for (doc, tkey, start), mask in zip(meta, resolver(content, np.array(number), r.window), strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    for out, x in zip(rows, (doc, tkey, start + a, b - a), strict=True):
                        out.append(x)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in rows], ["doc_id", "tkey", "start", "count"])
        release()

    near = contents.repartition("anchor").sortWithinPartitions("anchor", F.col("doc_id").asc_nulls_first(), "start", "tkey")
    return near.select("anchor", "doc_id", "tkey", "start", "n", "content").mapInArrow(run, "doc_id long, tkey long, start long, count long")


def repeated(docs: DataFrame, r: Repeats, resolver: Resolver, carry: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text) to doc_id, text, ranges: an array of (start, count) runs of windows that repeat, or null.

    carry: columns of docs that the result has as well, in a struct named rest.
    """
    staged = Staged(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tkey"), "text")
    where, key = F.struct("doc_id", "start"), ["doc_id", "tkey"]
    found = _anchors(keyed, r)
    # 2: anchors that occur twice or more
    twice = staged.write(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    occ = staged.write(salted_join(found, twice, ["anchor"], "n", ["doc_id", "start"]).drop("n"))
    staged.drop(twice)
    # 3: the distinct contexts; but for its first place, a context repeats as a whole
    ctx = staged.write(occ.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start", "tkey", "count")).alias("first")))
    same = salted_join(occ, ctx, ["anchor", "ctx"], "n", ["doc_id", "start"])
    ranges = same.filter(where > F.struct("first.doc_id", "first.start")).select(*key, "start", "count")
    # 4: the contents of the first places
    size = staged.write(ctx.groupBy("anchor").agg(F.count("*").alias("size")))
    n_hot = size.filter(F.col("size") > r.hot).count()
    sized = salted_join(ctx, size, ["anchor"], "size", ["ctx"])
    listed = lambda c: c.select("first.doc_id", "first.tkey", F.struct("anchor", "first.start", "first.count", "n").alias("w")).groupBy(*key).agg(F.collect_list("w").alias("wanted"))

    def wanting(c: DataFrame) -> DataFrame:
        w = listed(c)
        return keyed.join(w, keyed["doc_id"].eqNullSafe(w["doc_id"]) & (keyed["tkey"] == w["tkey"])).select(keyed["doc_id"], keyed["tkey"], "text", "wanted")

    fits = (F.col("size") <= r.hot) & (F.lit(r.alone) | (F.col("size") > 1))
    ranges = ranges.union(_resolve(_contents(wanting(sized.filter(fits)), r), r, resolver))
    if not r.alone and not r.later:
        ranges = ranges.union(sized.filter("size = 1").select("first.doc_id", "first.tkey", "first.start", "first.count"))
    # 5: parts of the crowded ones, until none is crowded
    width, rows = r.window - r.gram + 1, _contents(wanting(sized.filter(F.col("size") > r.hot)), r)
    whole = rows = staged.write(rows) if n_hot else rows  # a Python step on another's rows would take a second worker in every task
    first = True
    while n_hot and width > 1:
        width = -(-width // PARTS)
        rows = staged.write(_parted(rows, r, width, first))
        if first:
            staged.drop(whole)
        ctx = staged.write(rows.groupBy("anchor", "ctx").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.min(F.struct("doc_id", "start", "tkey", "count", "at", "content")).alias("first")))
        same = salted_join(rows.drop("n"), ctx.drop("n"), ["anchor", "ctx"], "rows", ["doc_id", "start"])
        ranges = ranges.union(same.filter(where > F.struct("first.doc_id", "first.start")).select(*key, "start", "count"))
        size = staged.write(ctx.groupBy("anchor").agg(F.count("*").alias("size")))
        n_hot = size.filter(F.col("size") > r.hot).count()
        sized = salted_join(ctx.drop("rows"), size, ["anchor"], "size", ["ctx"]).select("anchor", "n", "size", "first.*")
        ranges = ranges.union(_resolve(sized.filter(fits), r, resolver))
        if not r.alone and not r.later:
            ranges = ranges.union(sized.filter("size = 1 and n > 1").select(*key, "start", "count"))
        rows, first = sized.filter(F.col("size") > r.hot), False
    if n_hot:  # one window each: only equal hashes of unequal windows could come here
        ranges = ranges.union(_resolve(rows, r, resolver))
    # from here on only the ranges are needed
    by_text = staged.write(ranges.groupBy(*key).agg(F.collect_list(F.struct("start", "count")).alias("ranges")))
    staged.keep(by_text)
    full = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text", *([F.struct(*carry).alias("rest")] if carry is not None else []))
    # only texts that may have ranges are shuffled
    bits, names = staged.write(bitmap(by_text, "tkey")), [c for c in full.columns if c != "key"]
    some = may_meet(full, F.col("key"), bits)
    some = some.join(by_text, some["doc_id"].eqNullSafe(by_text["doc_id"]) & (some["key"] == by_text["tkey"]), "left").select(*(some[c] for c in names), "ranges")
    none = cannot_meet(full, F.col("key"), bits).select(*names, F.lit(None).cast(by_text.schema["ranges"].dataType).alias("ranges"))
    return some.union(none)


def covered(r: Repeats, ranges: pa.Array, uoffs: np.ndarray) -> np.ndarray:
    """For the units of a slice, whether a repeated window covers them."""
    if isinstance(ranges, pa.ChunkedArray):
        ranges = ranges.combine_chunks()
    step = np.zeros(int(uoffs[-1]) + 1, np.int32)
    flat = ranges.flatten()
    number = ranges.value_lengths().fill_null(0).to_numpy()
    if len(flat):
        first = np.repeat(uoffs[:-1], number) + flat.field("start").to_numpy()
        np.add.at(step, first, 1)
        np.add.at(step, first + flat.field("count").to_numpy() - 1 + r.window, -1)
    return np.cumsum(step)[:-1] > 0
