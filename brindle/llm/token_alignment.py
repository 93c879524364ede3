"""Alignment of two tokenizers over the same bytes, by the ends of their tokens.

1. A document is a row; a task tokenizes a slice of its rows on both sides, and running sums of the tokens' bytes give every
   token its end. An end of both sides is a cut; the cuts number the groups.
2. Every distinct end closes one stretch of bytes that no token border divides, and so belongs to exactly one A and one B
   token, the nearest that end there or later; and every overlapping pair of tokens has exactly one such stretch. So links
   are the distinct ends: a search in two sorted arrays that can't give more links than there are tokens, however long a
   group is.
3. The links of a document, as distinct id pairs with their numbers, are written, one row a document. Pairs are counted over
   all documents. Counts go back to the documents by a broadcast of the `heavy` most frequent pairs, a fixed number, and a
   join for all others.

Defined cases: a null or empty text, and one whose tokens don't spell its bytes in either tokenizer (U+2581 in a text), has no
tokens: zeros and an empty digest. Repeated rows and rows that share an id are documents of their own. A null id stays null. A
text is one row and its tokens are one task's. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._text import sliced
from brindle.llm._tokens import Tokenizer, tokenizer
from brindle.session import Staged, dealt


@dataclass(frozen=True)
class Alignment:
    """ranks, pattern: of the byte-level tokenizer A; model: of the piece tokenizer B; heavy: id pairs whose counts are broadcast."""

    ranks: str
    pattern: str
    model: str
    heavy: int = 200_000


class Pieces(Tokenizer):
    """The ids of a sentencepiece model whose pieces have blanks in front only: what starts with a blank after another character
    is encoded by itself, and once. Texts come with the blank in front that the model adds."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.sp.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.blank, self.whole = self.sp.piece_to_id("▁"), all("▁" not in n.lstrip("▁") for n in names)
        self._forget(0)

    def _direct(self, text: str) -> list[int] | None:
        return None if self.whole else self.sp.encode(text[1:])

    def _pieces(self, code: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.zeros(len(code) + 1, bool)
        start[1:-1] = (code[1:] == 0x20) & (code[:-1] != 0x20)
        start[offs[:-1]] = True
        at = np.flatnonzero(start[:-1])
        return at, np.searchsorted(at, offs)

    def _merged(self, texts: list[str]) -> list[list[int]]:
        # a blank alone is a piece, where the model would see an empty text
        return [x or [self.blank] for x in self.sp.encode([t[1:] for t in texts], num_threads=1)]

    def spell(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes[i] for i in ids.tolist()])


_made: dict[Alignment, tuple] = {}


def _both(p: Alignment) -> tuple:
    """The tokenizers and the byte lengths of A's ids; one for each worker process."""
    if p not in _made:
        a = tokenizer(p.ranks, p.pattern)
        _made[p] = a, Pieces(p.model), a.sizes
    return _made[p]


_digits: list[np.ndarray] = []


def groups_text(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a1,a2|b1;a3|b2,b3; of all tokens in order, and where each token's text starts. cut: the last tokens of their groups."""
    if not _digits:
        names = [str(k).encode() for k in range(1 << 16)]
        _digits.append(np.frombuffer(b"".join(n.ljust(7) for n in names), np.uint8).reshape(-1, 7))
        _digits.append(np.array([len(n) for n in names]))
    # a group's A tokens stand behind all B tokens of the groups before, its B tokens behind all A tokens up to it
    at_a = np.arange(len(a)) + np.concatenate(([0], np.flatnonzero(b_cut) + 1))[a_group]
    at_b = np.arange(len(b)) + (np.flatnonzero(a_cut) + 1)[b_group]
    ids, mark = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a], mark[at_b] = np.where(a_cut, ord("|"), ord(",")), np.where(b_cut, ord(";"), ord(","))
    size = _digits[1][ids]
    cells = _digits[0][ids]
    cells[np.arange(len(ids)), size] = mark
    return cells[np.arange(7) <= size[:, None]], np.concatenate(([0], np.cumsum(size + 1)))


#: links: distinct id pairs, a << 15 | b, below 32 bits of how often each comes.
FACTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>"


def aligned(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, a_offs: np.ndarray, b_offs: np.ndarray) -> list[np.ndarray | list]:
    """The tokens of documents that stand one after the other, with their bytes and each document's first; to what FACTS has
    of each: n_groups, n_links, groups_sha256, the number of distinct pairs; and these pairs.

    Both sides of a document have the same bytes, so an end's place among all bytes names the document as well.
    """
    n = len(a_offs) - 1
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    end = np.union1d(a_end, b_end)
    of_a, of_b = np.searchsorted(a_end, end), np.searchsorted(b_end, end)
    cut = end[(a_end[of_a] == end) & (b_end[of_b] == end)]
    a_group, b_group = np.searchsorted(cut, a_end), np.searchsorted(cut, b_end)
    text, at = groups_text(a, b, cut[a_group] == a_end, cut[b_group] == b_end, a_group, b_group)
    upto = at[a_offs + b_offs]
    digests = [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
    doc_of_a = np.repeat(np.arange(n), np.diff(a_offs))
    doc = doc_of_a[of_a]
    pair, times = np.unique(doc << 31 | a[of_a] << 15 | b[of_b], return_counts=True)
    groups = np.bincount(doc_of_a[np.searchsorted(a_end, cut)], minlength=n)
    return [groups, np.bincount(doc, minlength=n), digests, np.bincount(pair >> 31, minlength=n), times << 32 | (pair & 0x7FFFFFFF)]


def document_facts(docs: DataFrame, p: Alignment) -> DataFrame:
    """docs(doc_id, text) to FACTS, one row a document."""
    names = [c.split()[0] for c in FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_of, b_of, size = _both(p)
        for b, _, _ in sliced(batches, "text", 1 << 19):
            spaced = [" " + t if t else "" for t in b.column("text").to_pylist()]
            xs, ys = [], []
            for t, x, y in zip(spaced, a_of.encode(spaced), b_of.encode(spaced), strict=True):
                x, y, raw = x[:-1].astype(np.int64), y[:-1].astype(np.int64), t.encode()
                if size[x].sum() != len(raw) or b_of.sizes[y].sum() != len(raw) or "▁" in t or (not t.isascii() and b_of.spell(y) != raw):
                    x = y = np.zeros(0, np.int64)
                xs.append(x)
                ys.append(y)
            n_a, n_b = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
            x, y = np.concatenate(xs), np.concatenate(ys)
            groups, links, digests, each, pairs = aligned(x, y, size[x], b_of.sizes[y], *(np.concatenate(([0], np.cumsum(n))) for n in (n_a, n_b)))
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(each))).astype(np.int32), pairs)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(v, pa.int64()) for v in (n_a, n_b, groups, links)), pa.array(digests, pa.string()), lists], names)

    return dealt(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, FACTS)


def align(docs: DataFrame, p: Alignment) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each input row."""
    staged = Staged(docs.sparkSession)
    # the number of a row is fixed by the writing
    facts = staged.write(document_facts(docs, p).withColumn("row", F.monotonically_increasing_id()))
    link = facts.select("row", F.explode("links").alias("l")).select("row", F.expr("l & 4294967295L").alias("pair"), F.shiftright("l", 32).alias("times"))
    counts = staged.write(link.groupBy("pair").agg(F.count("*").alias("n")))
    top = counts.groupBy(F.shiftright("pair", 15).alias("a")).agg(F.max("n").alias("most"))  # one row an A id
    pairs, n = staged.counted(counts.join(F.broadcast(top), F.shiftright("pair", 15) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    staged.drop(counts)
    heavy = pairs
    if n > p.heavy:
        heavy = staged.write(pairs.orderBy(F.desc("n"), "pair").limit(p.heavy))
    found = link.join(F.broadcast(heavy), "pair", "inner" if n <= p.heavy else "left")
    known = found.filter("n is not null")
    if n > p.heavy:
        rest = pairs.join(F.broadcast(heavy.select("pair")), "pair", "left_anti")
        known = known.unionByName(found.filter("n is null").drop("n", "best").join(rest, "pair"))
    sums = known.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = facts.drop("links").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
