"""Suffix-array dedup: a run-length Burrows-Wheeler index of repetitive shards marks long matches.

A byte is removed if a string of 400 bytes that covers it also starts anywhere else. The contexts that may hold a repeat
come from `_repeats`, routed into shards of bounded size, equal ones collapsed. For a shard, the suffixes are sorted, the
transform is cut into runs, and only at run ends are a text position and the length that it shares with its neighbour in
suffix order kept: within a run that length falls by one from each position to the next. Streaming the text past those
samples gives at every position the longest match elsewhere, to the suffix above and to the suffix below.

Defined cases: null is the empty text. Repeated rows are documents of their own, so their long strings are found
elsewhere and go. A null doc_id is a document like any other. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._repeats import PIECE, Repeats, covered, repeated
from brindle.llm._text import sliced

#: A byte that UTF-8 never has parts the strings of an index; each one is a symbol of its own.
_PART = 0xFF


class RunLengthIndex:
    """Of strings of bytes. heads, tails: text positions at the first and last places of the runs, with shared lengths."""

    def __init__(self, strings: list[np.ndarray]):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(sizes + 1)
        text = np.full(int(self.ends[-1]), _PART, np.uint8)
        for s, e in zip(strings, self.ends.tolist(), strict=True):
            text[e - 1 - len(s) : e - 1] = s
        n = len(text)
        self.text, self.left = text, np.repeat(self.ends, sizes + 1) - np.arange(n)  # left: bytes up to and with the part's end
        order, levels = self._sort(text, np.repeat(np.arange(len(strings)), sizes + 1), int(sizes.max()) + 1)
        before = text[order - 1].astype(np.int32)
        part = before == _PART
        before[part] = 256 + np.searchsorted(self.ends, (order[part] - 1) % n, side="right")  # each part's end is its own symbol
        cut = np.flatnonzero(before[1:] != before[:-1])
        self.runs = len(cut) + 1
        shared = self._shared(levels, order[cut], order[cut + 1])
        # at a run's head, the match to the suffix above; at its tail, to the one below
        self.heads = (np.append(order[0], order[cut + 1]), np.append(0, shared))
        self.tails = (np.append(order[cut], order[-1]), np.append(shared, 0))

    def _sort(self, text: np.ndarray, string: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The suffix order, by doubling from 8 bytes, and the ranks by 8, 16, ... bytes. Only suffixes still tied are sorted again.

        A rank is the place of the first of its equals, so that it stays when others are told apart.
        """
        n = len(text)
        padded = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for k in range(8):
            here = np.where(self.left > k, padded[k : k + n], 0)
            key = (key << np.uint64(8)) | here
        order = np.argsort(key)
        k = key[order]
        rank = np.empty(n, np.int32)
        head = np.concatenate(([True], k[1:] != k[:-1]))
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))

        def tell_apart(by: np.ndarray) -> None:
            """Sort those that are tied by a second key of theirs."""
            nonlocal tied
            at = order[tied]
            k = (rank[at].astype(np.uint64) << np.uint64(32)) | by[at].astype(np.uint64)
            o = np.argsort(k)
            at, k = at[o], k[o]
            order[tied] = at
            head = np.concatenate(([True], k[1:] != k[:-1]))
            rank[at] = np.maximum.accumulate(np.where(head, tied, 0))
            tied = tied[~(head & np.append(head[1:], True))]

        # past its part's end a suffix is unique already
        if len(tied):
            tell_apart(np.where(self.left <= 8, string + 1, 0))
        levels, h = [(8, rank.copy())], 8
        while h < longest and len(tied):
            ahead = np.zeros(n, np.int64)
            ahead[: n - h] = np.where(self.left[: n - h] > h, rank[h:].astype(np.int64) + 1, 0)
            tell_apart(ahead)
            h *= 2
            levels.append((h, rank.copy()))
        return order, levels

    def _shared(self, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common prefix of the suffixes at a and b, none of which passes a part's end."""
        got = np.zeros(len(a), np.int64)
        n = len(self.text)
        # most neighbours differ within the first level's bytes
        far = np.flatnonzero((levels[0][1][a] == levels[0][1][b]) & (self.left[a] > levels[0][0]) & (self.left[b] > levels[0][0]))
        x, y, long = a[far], b[far], np.zeros(len(far), np.int64)
        for h, rank in reversed(levels):
            # two blocks of the widest level may follow each other
            for _ in range(2 if h == levels[-1][0] else 1):
                u, v = np.minimum(x, n - 1), np.minimum(y, n - 1)
                same = (x < n) & (y < n) & (self.left[u] > h) & (self.left[v] > h) & (rank[u] == rank[v])
                step = h * same
                long, x, y = long + step, x + step, y + step
        got[far] = long
        a, b, open_ = a + got, b + got, np.arange(len(a))
        for _ in range(8):
            u, v = a[open_], b[open_]
            same = (u < n) & (v < n) & (self.text[np.minimum(u, n - 1)] == self.text[np.minimum(v, n - 1)]) & (self.text[np.minimum(u, n - 1)] != _PART)
            open_ = open_[same]
            got[open_] += 1
            a[open_] += 1
            b[open_] += 1
        return got

    def matches(self) -> np.ndarray:
        """At every position, the length of its longest match elsewhere."""
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for at, length in (self.heads, self.tails):
            reach = np.full(n, -1, np.int64)
            reach[at] = at + length
            known = np.maximum.accumulate(np.where(reach >= 0, np.arange(n), 0))
            best = np.maximum(best, reach[known] - np.arange(n))
        return best


def repeats_anywhere(contexts: list[np.ndarray], number: np.ndarray, window: int) -> list[np.ndarray]:
    """For each of the distinct contexts, the windows that occur elsewhere: in it, in the others, or in one more of its kind."""
    index = RunLengthIndex(contexts)
    long = index.matches() >= window
    return [long[e - 1 - len(c) : e - window] | (n > 1) for c, n, e in zip(contexts, number.tolist(), index.ends.tolist(), strict=True)]


@dataclass(frozen=True)
class SuffixDedup:
    """window: bytes of the shortest string that counts."""

    window: int = 400


def _plan(p: SuffixDedup) -> Repeats:
    return Repeats(window=p.window, gram=max(1, p.window // 4), words=False, later=False, alone=False)


def _removal(docs: DataFrame, p: SuffixDedup, emit, schema: str) -> DataFrame:
    r = _plan(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, offs in sliced(batches, "text", PIECE):
            yield emit(b, raw, offs, covered(r, b.column("ranges"), offs))

    return repeated(docs, r, repeats_anywhere).mapInArrow(run, schema)


def remove_long_repeats(docs: DataFrame, p: SuffixDedup = SuffixDedup()) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256."""

    def emit(b: pa.RecordBatch, raw: np.ndarray, offs: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        spans, kept, removed = [], [], []
        for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            g = gone[x:y]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
            spans.append([{"start": s, "stop": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            removed.append(int(g.sum()))
            kept.append(hashlib.sha256((raw[x:y][~g] if len(edge) else raw[x:y]).tobytes()).hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.record_batch(
            [b.column("doc_id"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"],
        )

    return _removal(docs, p, emit, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept_sha256 string")


def cut_long_repeats(docs: DataFrame, p: SuffixDedup = SuffixDedup()) -> DataFrame:
    """docs with the repeats cut from text. A character cut in part goes as a whole; null stays null; other columns stay."""
    names = docs.columns
    rest = [c for c in names if c != "text"]
    r = _plan(p)
    kept = repeated(docs, r, repeats_anywhere, carry=rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, offs in sliced(batches, "text", PIECE):
            gone = covered(r, b.column("ranges"), offs)
            valid = b.column("text").is_valid().to_pylist()
            cut = []
            for x, y, there in zip(offs[:-1].tolist(), offs[1:].tolist(), valid, strict=True):
                edge = np.flatnonzero(np.diff(gone[x:y].view(np.int8), prepend=1, append=1)) if y > x else []
                text = "".join(raw[x + s : x + e].tobytes().decode("utf-8", "ignore") for s, e in zip(edge[::2], edge[1::2], strict=True)) if len(edge) else ""
                cut.append((text if gone[x:y].any() else raw[x:y].tobytes().decode()) if there else None)
            yield pa.record_batch([pa.array(cut, pa.string()), b.column("rest")], ["text", "rest"])

    out = kept.select("text", "rest", "ranges").mapInArrow(run, kept.select("text", "rest").schema)
    return out.select(*(F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in names))
