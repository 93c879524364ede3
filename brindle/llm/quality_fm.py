"""Quality by a factorisation machine: hashed words, structure and metadata, with low-rank weights of all their pairs.

A text's features are its distinct words, hashed into 2**bits places and scaled to length 1; measurements of its structure
(sizes, marks, capitals, lines, repeats), each as a number and as one of the bins that the labelled texts' quantiles make; and
metadata: whether n_chars is there and agrees with the text. Of the score

    w0 + sum w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j

the last part is one half of the sum over factors f of (sum v_if x_i)**2 - sum (v_if x_i)**2, so scoring takes one pass over a
text's features.

It is trained by AdaGrad on at most `labelled` labelled texts, the ids of smallest hash; an eighth of them, by hash, says which
pass over the rest was best. Only rows whose crc32(doc_id as text) mod 5 is not 0 are learned from. Labels, lang, source and
doc_id are no features.

Defined cases: a null or empty text scores as a text without words. Several labels for one id: the larger one. Without labels
of both kinds every score is the share of good labels, 0.85 with none. Null ids are scored, not learned from. Repeated rows
get equal scores. Without a column n_chars, or where it is null, it counts as missing. A text of any length is one row; memory
follows the longest. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._text import _BYTE, _SPACE, U64, Runs, Words, mix, sliced

#: Measurements of a text, in the order of `structure`.
STATS = ("words", "bytes", "word_bytes", "capitals", "symbols", "exclamations", "bars", "digits", "stops", "line_words", "repeated_lines", "repeated_words", "repeated_triples", "marked_ends", "longest", "not_ascii", "no_n_chars", "n_chars")


@dataclass(frozen=True)
class Quality:
    """bits: of the places for words; rank: of the pairs' weights; bins: of a measurement; labelled: texts to train on, at most."""

    bits: int = 13
    rank: int = 8
    bins: int = 8
    labelled: int = 6000
    passes: int = 30
    batch: int = 128
    rate: float = 0.08
    decay: float = 2e-4
    threshold: float = 0.3


@dataclass(frozen=True)
class Machine:
    """w0, w, v over word places, measurements, bins; edges, mean and spread of the measurements."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    edges: np.ndarray  # [measurement, bins - 1]
    mean: np.ndarray
    spread: np.ndarray


def _remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def _per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(mask)))[offs]).astype(float)


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each text has."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n).astype(float)


def structure(raw: np.ndarray, offs: np.ndarray, n_chars: np.ndarray, w: Words) -> np.ndarray:
    """[text, measurement]; n_chars: NaN where missing."""
    n = len(offs) - 1
    words = np.diff(w.offs).astype(float)
    some, size = np.maximum(words, 1), np.diff(offs).astype(float)
    doc = np.repeat(np.arange(n), np.diff(w.offs))
    of = lambda chars: _per_text(np.isin(raw, np.frombuffer(chars, np.uint8)), offs)
    upper, lower = _per_text((raw >= 65) & (raw <= 90), offs), _per_text((raw >= 97) & (raw <= 122), offs)
    # lines with a word, as the runs of words between line ends
    nl = np.concatenate(([0], np.cumsum(raw == 10)))
    line = nl[w.start] if len(w.start) else np.zeros(0, np.int64)
    first = np.ones(len(line), bool)
    first[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(line)) - 1
    lines = np.maximum(np.bincount(doc[at], minlength=n).astype(float), 1)
    one = _distinct(Runs(_BYTE[raw]).hash(w.start[at], w.end[last]), doc[at], n) if len(at) else np.zeros(n)
    three = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
    triples = np.bincount(doc[three], minlength=n).astype(float)
    own = _distinct(Runs(w.hash).hash(three, three + 3), doc[three], n) if len(three) else np.zeros(n)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, (w.end - w.start).astype(float))
    ends = np.bincount(doc, weights=np.isin(raw[w.end - 1], np.frombuffer(b"#*$%&|<>!", np.uint8)), minlength=n) if len(doc) else np.zeros(n)
    chars = np.maximum(size - _per_text((raw & 0xC0) == 0x80, offs), 1)
    gone = np.isnan(n_chars)
    drift = np.abs(np.log(np.maximum(np.where(gone, chars, n_chars), 1) / chars))
    return np.stack(
        [
            np.log1p(words), np.log1p(size), np.log1p(size / some), upper / np.maximum(upper + lower, 1), of(b"#*$%&|<>") / some, of(b"!") / some, of(b"|") / some, of(b"0123456789") / np.maximum(size, 1),
            of(b".,;:") / some, np.log1p(words / lines), 1 - one / lines, 1 - _distinct(w.hash, doc, n) / some, 1 - own / np.maximum(triples, 1), ends / some, np.log1p(longest), _per_text(raw >= 128, offs) / np.maximum(size, 1),
            gone.astype(float), drift,
        ],
        axis=1,
    )


def measured(b: pa.RecordBatch, raw: np.ndarray, offs: np.ndarray, p: Quality) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words, each once a text, the text of each, by text; and the measurements."""
    w = Words(raw, offs)
    doc = np.repeat(np.arange(b.num_rows), np.diff(w.offs))
    place = (mix(w.hash ^ U64(0x7F4A7C15)) >> U64(64 - p.bits)).astype(np.int64)
    both = np.unique((doc << p.bits) + place)
    n_chars = np.array(b.column("n_chars").to_numpy(zero_copy_only=False), float)
    return both & ((1 << p.bits) - 1), both >> p.bits, structure(raw, offs, n_chars, w)


def _features(place: np.ndarray, doc: np.ndarray, stats: np.ndarray, m: Machine, p: Quality) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat (feature, value, text)."""
    n, s = stats.shape
    words = np.bincount(doc, minlength=n)
    base = 1 << p.bits
    number = np.clip((stats - m.mean) / m.spread, -3, 3) / 3
    bin_ = np.stack([np.searchsorted(m.edges[k], stats[:, k], side="right") for k in range(s)], axis=1)
    ids = np.concatenate((place, np.tile(base + np.arange(s), n), (base + s + np.arange(s) * p.bins + bin_).ravel()))
    values = np.concatenate((1 / np.sqrt(words[doc]), number.ravel() / np.sqrt(s), np.full(n * s, 1 / np.sqrt(s))))
    return ids, values, np.concatenate((doc, np.repeat(np.arange(n), s), np.repeat(np.arange(n), s)))


def margin(ids: np.ndarray, values: np.ndarray, doc: np.ndarray, n: int, m: Machine) -> np.ndarray:
    """The machine's sum for each text, in time linear in the features."""
    z = m.bias + np.bincount(doc, weights=m.w[ids] * values, minlength=n)
    for f in range(m.v.shape[1]):
        x = m.v[ids, f] * values
        s = np.bincount(doc, weights=x, minlength=n)
        z += (s * s - np.bincount(doc, weights=x * x, minlength=n)) / 2
    return z


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int, bool]], p: Quality = Quality()) -> Machine:
    """rows: (places, measurements, label, whether it says which pass is best)."""
    s, base = len(STATS), 1 << p.bits
    size = base + s + s * p.bins
    y = np.array([r[2] for r in rows], float)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.85
    flat = Machine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, p.rank)), np.zeros((s, p.bins - 1)), np.zeros(s), np.ones(s))
    if len(np.unique(y)) < 2:
        return flat
    stats = np.stack([r[1] for r in rows])
    edges = np.quantile(stats, np.arange(1, p.bins) / p.bins, axis=0).T
    start = Machine(flat.bias, flat.w, flat.v, edges, stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6))
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    ids, values, doc = _features(np.concatenate([r[0] for r in rows]).astype(np.int64), doc, stats, start, p)
    order = np.argsort(doc, kind="stable")
    ids, values, at = ids[order], values[order], np.searchsorted(doc[order], np.arange(len(rows) + 1))
    rnd = np.random.default_rng(13)
    w, v, b = np.zeros(size), rnd.normal(0, 0.05, (size, p.rank)), flat.bias
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, p.rank), 1e-6), 1e-6
    test = np.flatnonzero([r[3] for r in rows])
    fit = np.flatnonzero([not r[3] for r in rows])
    if not len(test) or not len(fit):
        test = fit = np.arange(len(rows))
    pick = lambda which: np.concatenate([np.arange(at[i], at[i + 1]) for i in which])
    t_flat = pick(test)
    t_doc = np.repeat(np.arange(len(test)), np.diff(at)[test])
    best, found = np.inf, start
    for _ in range(p.passes):
        rnd.shuffle(fit)
        for k in range(0, len(fit), p.batch):
            some = fit[k : k + p.batch]
            pos = pick(some)
            own, col = np.unique(ids[pos], return_inverse=True)
            x = np.zeros((len(some), len(own)))
            x[np.repeat(np.arange(len(some)), np.diff(at)[some]), col] = values[pos]
            vv = v[own]
            xv = x @ vv
            z = b + x @ w[own] + ((xv * xv).sum(axis=1) - (x * x) @ (vv * vv).sum(axis=1)) / 2
            err = (_sigmoid(z) - y[some]) / len(some)
            gw = x.T @ err + p.decay * w[own]
            gv = x.T @ (err[:, None] * xv) - vv * ((x * x).T @ err)[:, None] + p.decay * vv
            gb = float(err.sum())
            seen_w[own] += gw * gw
            seen_v[own] += gv * gv
            seen_b += gb * gb
            w[own] -= p.rate * gw / np.sqrt(seen_w[own])
            v[own] -= p.rate * gv / np.sqrt(seen_v[own])
            b -= p.rate * gb / seen_b**0.5
        now = Machine(b, w, v, edges, start.mean, start.spread)
        q = np.clip(_sigmoid(margin(ids[t_flat], values[t_flat], t_doc, len(test), now)), 1e-7, 1 - 1e-7)
        loss = float(-(y[test] * np.log(q) + (1 - y[test]) * np.log(1 - q)).mean())
        if loss < best:
            best, found = loss, Machine(b, w.copy(), v.copy(), edges, start.mean, start.spread)
    return found


def _source(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").try_cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, p: Quality = Quality()) -> Machine:
    """Reads the features of at most `labelled` texts; the work on texts is in the tasks."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    given = given.filter("doc_id is not null and y in (0, 1)").filter(_remainder() != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = given.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(p.labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, offs in sliced(batches, "text", 1 << 19):
            place, doc, stats = measured(b, raw, offs, p)
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=b.num_rows)))).astype(np.int32)
            yield pa.record_batch([b.column("doc_id"), b.column("y"), pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())), pa.array([x.tobytes() for x in stats], pa.binary())], ["doc_id", "y", "places", "stats"])

    texts = _source(docs).join(F.broadcast(chosen), "doc_id")  # `labelled` rows at most
    got = texts.select("doc_id", "y", "text", "n_chars").mapInArrow(run, "doc_id long, y int, places array<int>, stats binary")
    # rows that share an id are one text, whichever comes first in an order of their own
    rows = got.groupBy("doc_id").agg(F.min(F.struct("stats", "places", "y")).alias("r"), (F.xxhash64("doc_id", F.lit("test")) % 8 == 0).alias("test")).orderBy("doc_id").select("r.*", "test").collect()
    return train([(np.array(r["places"], np.int64), np.frombuffer(r["stats"], float), r["y"], r["test"]) for r in rows], p)


def score(docs: DataFrame, m: Machine, p: Quality = Quality()) -> DataFrame:
    """docs(doc_id, text, n_chars) to doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, offs in sliced(batches, "text", 1 << 19):
            place, doc, stats = measured(b, raw, offs, p)
            s = _sigmoid(margin(*_features(place, doc, stats, m, p), b.num_rows, m))
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= p.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    src = _source(docs).withColumn("held_out", F.coalesce(_remainder() == 0, F.lit(False)))
    return src.select("doc_id", "held_out", "text", "n_chars").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, p: Quality = Quality()) -> DataFrame:
    return score(docs, fit(docs, labels, p), p)
