"""Language ID by nearest centroid: normalised TF-IDF vectors of byte n-grams against several centroids per language.

The centroids are fitted on a bounded sample of labelled texts: those of smallest hash of the id, the same number of every
language, at most `per_language` each and `sample` in all (one of each where there are more languages than that). Their n-gram vectors (hashed into `dims` cells; log counts times inverse document frequency
over all labelled texts, length 1) are clustered within each language by cosine. A text takes the language of its nearest
centroid. It is rejected if that cosine is below what texts of its length reach: `tolerance` times the lowest hundredth of all
labelled texts of the languages that have centroids, rounded down to a step of 1 / `steps`.

Defined cases: a null text, and one without a letter, is `und` with score 0 and rejected. So is every text if no
labelled row was found. Rows with null lang or null id are not learned from. Repeated rows get equal results. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brindle.llm._text import U64, mix, release, sliced


@dataclass(frozen=True)
class LanguageId:
    """sample, per_language: bounds of the texts that centroids are fitted on; clusters: centroids of a language."""

    dims: int = 4096
    grams: tuple[int, ...] = (1, 2, 3)
    sample: int = 2000
    per_language: int = 500
    clusters: int = 4
    rounds: int = 12
    tolerance: float = 0.5
    steps: int = 2000


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray  # rows of length 1
    language_of: np.ndarray  # of a centroid
    floor: np.ndarray  # least cosine by the base-2 logarithm of a text's n-grams


def remainder() -> Column:
    """crc32(doc_id as text) mod 4; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


#: a-z for letters of ASCII, themselves for bytes of other characters, a blank for all else.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def counts(raw: np.ndarray, offs: np.ndarray, p: LanguageId) -> np.ndarray:
    """For each text the hashed counts of its n-grams; runs of blanks are one."""
    b = _FOLD[raw]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 0x20) | (b[:-1] != 0x20)
    keep[offs[:-1][offs[:-1] < len(b)]] = True
    b = b[keep].astype(U64)
    size = np.diff(np.concatenate(([0], np.cumsum(keep)))[offs])
    doc = np.repeat(np.arange(len(size)), size)
    out = np.zeros(len(size) * p.dims, np.float32)
    code, shift = np.zeros(len(b), U64), U64(64 - (p.dims.bit_length() - 1))
    for n in range(1, max(p.grams) + 1):
        m = len(b) - n + 1
        if m <= 0:
            break
        code = (code[:m] << U64(8)) | b[n - 1 :]
        if n in p.grams:
            ok = doc[:m] == doc[n - 1 :]
            cell = (mix(code + (U64(n) << U64(40))) >> shift).astype(np.int64)
            out += np.bincount((doc[:m] * p.dims + cell)[ok], minlength=len(out)).astype(np.float32)
    return out.reshape(len(size), p.dims)


def has_letter(texts: pa.Array, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    seen = np.concatenate(([0], np.cumsum(_LETTER[raw])))[offs]
    out = np.diff(seen) > 0
    for k in np.flatnonzero(~out & (np.diff(offs) > 0)).tolist():
        out[k] = any(map(str.isalpha, texts[k].as_py() or ""))
    return out


def _weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _length(tf: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1 + tf.sum(axis=1)), 31).astype(np.int64)


def _cluster(v: np.ndarray, p: LanguageId) -> np.ndarray:
    """Centroids by cosine: the first is the mean's direction, the next ones start farthest from those before."""
    k = min(p.clusters, len(v))
    seeds = [v.mean(axis=0)]
    for _ in range(k - 1):
        near = np.max(v @ np.array([s / max(np.linalg.norm(s), 1e-12) for s in seeds]).T, axis=1)
        seeds.append(v[int(near.argmin())])
    c = np.array(seeds)
    for _ in range(p.rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (v @ c.T).argmax(axis=1)
        c = np.array([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(k)])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _totals(texts: DataFrame, p: LanguageId, size: int, cells: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all texts of cells(counts), `size` numbers; added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b, raw, offs in sliced(batches, "text", 1 << 19):
            for a in range(0, b.num_rows, 256):
                z = min(b.num_rows, a + 256)
                total += cells(counts(raw[offs[a] : offs[z]], offs[a : z + 1] - offs[a], p))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["cell", "n"])
        release()

    out = np.zeros(size, np.int64)
    for r in texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def fit(docs: DataFrame, p: LanguageId = LanguageId()) -> Model:
    """From the rows of docs(doc_id, text, lang) whose remainder is not 2, text and lang not null."""
    learn = docs.select(F.col("doc_id").cast("long"), "lang", "text").filter((remainder() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = learn.agg(F.countDistinct("lang").alias("n")).first()["n"]
    each = max(1, min(p.per_language, p.sample // max(1, languages)))
    # the first of each language by a hash; a task passes on at most `each` a language to the ranking
    key = ["lang", "doc_id", "tkey"]
    keyed = learn.withColumn("tkey", F.xxhash64("text"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", "tkey"), "doc_id", "tkey")
    chosen = keyed.select(*key).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each).select(*key).distinct()
    rows = []
    if languages:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, raw, offs in sliced(batches, "text", 1 << 19):
                for a in range(0, b.num_rows, 256):
                    z = min(b.num_rows, a + 256)
                    tf = counts(raw[offs[a] : offs[z]], offs[a : z + 1] - offs[a], p)
                    yield pa.record_batch([*(b.column(c).slice(a, z - a) for c in key), pa.array([np.minimum(x, 65535).astype(np.uint16).tobytes() for x in tf], pa.binary())], [*key, "tf"])

        # at most max(sample, languages) keys, which may be sent to all tasks; repeated rows come once
        picked = keyed.join(F.broadcast(chosen), key).select(*key, "text").mapInArrow(run, "lang string, doc_id long, tkey long, tf binary")
        rows = picked.dropDuplicates(key).orderBy(*key).select("lang", "tf").collect()
    languages = tuple(sorted({r["lang"] for r in rows}))
    if not rows:
        return Model((), np.ones(p.dims, np.float32), np.zeros((0, p.dims), np.float32), np.zeros(0, np.int64), np.zeros(32))
    tf = np.array([np.frombuffer(r["tf"], np.uint16) for r in rows], np.float32)
    own = np.array([languages.index(r["lang"]) for r in rows])
    *seen, every = _totals(learn, p, p.dims + 1, lambda tf: np.append((tf > 0).sum(axis=0), len(tf)))
    idf = (np.log((1 + every) / (1 + np.array(seen))) + 1).astype(np.float32)
    v = _weigh(tf, idf)
    parts = [_cluster(v[own == k], p) for k in range(len(languages))]
    centroids = np.concatenate(parts).astype(np.float32)
    del v, tf, rows
    release()

    def reach(tf: np.ndarray) -> np.ndarray:
        near = (_weigh(tf, idf) @ centroids.T).max(axis=1)
        return np.bincount(_length(tf) * p.steps + np.clip(near * p.steps, 0, p.steps - 1).astype(np.int64), minlength=32 * p.steps)

    reached = _totals(learn.filter(F.col("lang").isin(*languages)), p, 32 * p.steps, reach).reshape(32, p.steps)
    floor = np.zeros(32)
    for k in range(32):
        upto = np.cumsum(reached[max(0, k - 1) : k + 2].sum(axis=0))
        low = np.searchsorted(upto, 0.01 * (upto[-1] - 1), side="right") / p.steps
        floor[k] = p.tolerance * low if upto[-1] >= 20 else (floor[k - 1] if k else 0.0)
    return Model(languages, idf, centroids, np.repeat(np.arange(len(parts)), [len(c) for c in parts]), floor)


def predict(docs: DataFrame, model: Model, p: LanguageId = LanguageId(), carry: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text) to doc_id, held_out, lang_pred, score, rejected; carry: columns to keep beside text, in a struct named rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, offs in sliced(batches, "text", 1 << 19):
            letters = has_letter(b.column("text"), raw, offs)
            n = b.num_rows
            best, lang, rejected = np.zeros(n), np.full(n, -1), np.ones(n, bool)
            if model.languages:
                for a in range(0, n, 256):
                    z = min(n, a + 256)
                    tf = counts(raw[offs[a] : offs[z]], offs[a : z + 1] - offs[a], p)
                    cos = _weigh(tf, model.idf) @ model.centroids.T
                    top = cos.argmax(axis=1)
                    best[a:z] = np.clip(cos[np.arange(z - a), top], 0, 1)
                    lang[a:z] = model.language_of[top]
                    rejected[a:z] = best[a:z] < model.floor[_length(tf)]
            lang[~letters], best[~letters], rejected[~letters] = -1, 0, True
            names = [*model.languages, "und"]
            cols = [pa.array([names[k] for k in lang], pa.string()), pa.array(best.astype(float)), pa.array(rejected)]
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), *cols, *([] if carry is None else [b.column("text"), b.column("rest")])], names=kinds.names)

    extra = [] if carry is None else [F.struct(*carry).alias("rest")]
    src = docs.select(F.col("doc_id").cast("long"), F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "text", *extra)
    kinds = src.select("doc_id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), *(["text", "rest"] if extra else [])).schema
    return src.mapInArrow(run, kinds)


def identify(docs: DataFrame, p: LanguageId = LanguageId()) -> DataFrame:
    return predict(docs, fit(docs, p), p)


def keep_identified(docs: DataFrame, p: LanguageId = LanguageId()) -> DataFrame:
    """The rows of docs whose language is found; the columns stay."""
    names = docs.columns
    out = predict(docs, fit(docs, p), p, carry=[c for c in names if c != "text"])
    return out.filter("not rejected").select(*(F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in names))
