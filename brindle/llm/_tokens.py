"""Ids of a byte-level BPE for whole texts, equal to the tokenizer file's.

Texts are split into the pattern's pieces with array operations; only pieces not met before are merged, by the same
merges as ranks. A text with a rare character (beyond U+1FFF) or an apostrophe goes through the pattern itself. Pieces are
told apart by hashes; see `apart` for long ones.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np

from brindle.llm._text import U64, Runs, apart, mix

#: White space of the pattern below U+2000.
_BLANKS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680)
_LETTER, _NUMBER, _BLANK, _OTHER = 1, 2, 3, 4
_LIMIT = 0x2000
_KNOWN = 400_000


def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    c = np.array([kinds.get(unicodedata.category(chr(k))[0], _OTHER) for k in range(_LIMIT)], np.uint8)
    c[list(_BLANKS)] = _BLANK
    return c


class Tokenizer:
    """ranks: a file of base64 tokens and ranks; end: the id that closes every document."""

    def __init__(self, ranks: str, pattern: str, end: int = 0):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.sizes = np.zeros(max(table.values(), default=-1) + 1, np.int64)  # the bytes of each id
        self.sizes[list(table.values())] = [len(t) for t in table]
        self.kind = _classes()
        self._forget(end)

    def _forget(self, end: int) -> None:
        # known pieces by sorted hash; entry 0 of the ids is the end mark
        self.hashes = np.zeros(0, U64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.array([end], np.uint32)

    def _pieces(self, code: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces, and for each document its first piece."""
        n = len(code)
        kind = self.kind[code]
        first = np.zeros(n + 1, bool)
        first[offs[:-1]] = True
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        change |= first[:n]
        blank = kind == _BLANK
        last = np.append(change[1:], True)  # the last of its run
        ends = np.zeros(n, bool)
        ends[offs[1:][offs[1:] > offs[:-1]] - 1] = True
        # the last blank of a run that something follows stands apart from the run: with the next piece if it is U+0020
        apart = blank & last & ~ends
        start = change | apart
        glued = np.zeros(n, bool)
        glued[1:] = (apart & (code == 0x20))[:-1]
        start &= ~glued
        at = np.flatnonzero(start)
        return at, np.searchsorted(at, offs)

    def _merged(self, texts: list[str]) -> list[list[int]]:
        return [self.bpe._encode_single_piece(t) for t in texts]

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges for new pieces: start, size into fresh ids."""
        got = self._merged(texts)
        size = np.array([len(g) for g in got], np.int64)
        flat = np.array([x for g in got for x in g], np.uint32)
        return np.cumsum(size) - size, size, flat

    def _direct(self, text: str) -> list[int] | None:
        """The ids of a text that array operations don't cut right; None for any other."""
        return self.bpe.encode_ordinary(text) if "'" in text or (not text.isascii() and max(text) >= chr(_LIMIT)) else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """For every text its ids and the end mark."""
        out: list[np.ndarray | None] = [None] * len(texts)
        easy = []
        for k, t in enumerate(texts):
            if (got := self._direct(t)) is not None:
                out[k] = np.array([*got, self.ids[0]], np.uint32)
            else:
                easy.append(k)
        whole = "".join(texts[k] for k in easy)
        offs = np.concatenate(([0], np.cumsum([len(texts[k]) for k in easy]))).astype(np.int64)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at, doc = self._pieces(code, offs)
        to = np.append(at[1:], len(code))
        h = apart(Runs(mix(code.astype(U64) + U64(1))).hash(at, to), code, at, to)
        uniq, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        where = np.searchsorted(self.hashes, uniq)
        known = np.zeros(len(uniq), bool)
        inside = where < len(self.hashes)
        known[inside] = self.hashes[where[inside]] == uniq[inside]
        new = np.flatnonzero(~known)
        fresh_start, fresh_size, fresh = self._learn(uniq[new], [whole[a:b] for a, b in zip(at[index[new]].tolist(), to[index[new]].tolist(), strict=True)])
        ids = np.concatenate((self.ids, fresh))
        start, size = np.zeros(len(uniq), np.int64), np.zeros(len(uniq), np.int64)
        start[known], size[known] = self.start[where[known]], self.size[where[known]]
        start[new], size[new] = fresh_start + len(self.ids), fresh_size
        if len(self.hashes) < _KNOWN:
            place = where[new]
            self.hashes = np.insert(self.hashes, place, uniq[new])
            self.start, self.size = np.insert(self.start, place, start[new]), np.insert(self.size, place, size[new])
            self.ids = ids
        # pieces in order, the end mark after each document's
        s = np.insert(start[inverse], doc[1:], 0)
        c = np.insert(size[inverse], doc[1:], 1)
        ends = np.cumsum(c)
        flat = ids[np.repeat(s - (ends - c), c) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = ends[doc[1:] + np.arange(len(easy))] if len(easy) else []
        a = 0
        for k, b in zip(easy, upto, strict=True):
            out[k] = flat[a:b]
            a = b
        return out


_made: dict[tuple, Tokenizer] = {}


def tokenizer(ranks: str, pattern: str, end: int = 0) -> Tokenizer:
    """One for each worker process."""
    key = (ranks, pattern, end)
    if key not in _made:
        _made[key] = Tokenizer(*key)
    return _made[key]
