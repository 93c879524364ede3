"""Substring dedup: suffix automata of reference shards give each text's matching statistics.

A window of 20 words is removed where the same words start earlier (smaller doc_id, or earlier in the document). The
contexts that may hold a repeat come from `_repeats`, routed into shards of bounded size; each shard has one suffix
automaton, grown on line over its contexts in corpus order. The length of the longest suffix seen earlier, which the
automaton's suffix link gives at every word, is the matching statistic against all that precedes: no document visits a
shard with which it shares nothing. (Broadcasting every shard to every document would cost shards x documents.)

Defined cases: null, empty and white-space texts have no words; n_removed 0 and the hash of nothing. A null doc_id is
smaller than all others. Repeated rows (same doc_id, same text) do not precede each other; both stay. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm._repeats import PIECE, Repeats, covered, repeated
from brindle.llm._text import Words, sliced


class SuffixAutomaton:
    """Of one growing sequence of tokens."""

    __slots__ = ("last", "length", "link", "next")

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, token: object) -> int:
        """Add a token; the length of the longest suffix that also ends earlier."""
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p >= 0 and token not in nxt[p]:
            nxt[p][token] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][token]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(token) == q:
                    nxt[p][token] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur
        return length[link[cur]]


def repeats_earlier(contexts: list[np.ndarray], number: np.ndarray, window: int) -> list[np.ndarray]:
    """For each context, in order, the windows that occur earlier, in it or in those before; its further copies don't matter."""
    sam, out = SuffixAutomaton(), []
    for k, tokens in enumerate(contexts):
        sam.extend(k + 0.5)  # a number that no word has keeps matches within a context
        seen = [sam.extend(t) for t in tokens.tolist()]
        out.append(np.array(seen[window - 1 :], np.int64) >= window)
    return out


@dataclass(frozen=True)
class SubstringDedup:
    """window: words of the shortest passage that counts."""

    window: int = 20


def _plan(p: SubstringDedup) -> Repeats:
    return Repeats(window=p.window, gram=max(1, min(6, p.window // 2)), words=True, later=True, shard_bytes=60_000 * 8)


def remove_repeats(docs: DataFrame, p: SubstringDedup = SubstringDedup()) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_words, n_removed, kept (the words left, joined by one space), kept_sha256."""
    r = _plan(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, offs in sliced(batches, "text", PIECE):
            w = Words(raw, offs, hashes=False)
            gone = covered(r, b.column("ranges"), w.offs)
            keep = np.flatnonzero(~gone)
            start, size = w.start[keep], w.end[keep] - w.start[keep] + 1
            ends = np.cumsum(size)
            src = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
            text = np.append(raw, np.uint8(0x20))[src]
            text[ends - 1] = 0x20
            # after which kept word, and so which byte, each document's words are over
            upto = np.concatenate(([0], ends))[np.searchsorted(keep, w.offs)]
            whole = text.tobytes()
            parts = [whole[x : y - 1] if y > x else b"" for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
            lost = np.concatenate(([0], np.cumsum(gone)))[w.offs]
            yield pa.record_batch(
                [
                    b.column("doc_id"), pa.array(np.diff(w.offs)), pa.array(np.diff(lost)),
                    pa.array([x.decode() for x in parts], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return repeated(docs, r, repeats_earlier).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
