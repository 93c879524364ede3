"""Toxicity by weak supervision: many voters, a label model of their accuracies and correlations, a linear classifier.

1. Voters. The labelled rows are halved by a hash of their id. Over all rows of the first half, words and word beginnings
   are counted by label; the telling ones make lexicons: whole words are dealt out to `voters` of them by hash, and the
   beginnings of each length are one more. A lexicon says toxic where a text has an entry. Fixed lexicons may be given as
   well (none is by default), and pattern voters look at punctuation, capitals and masked words. None of these voters knows
   the labels of the second half.
2. The label model is generative: a text's class, then the votes given the class. Each voter's chances to vote under either
   class are its accuracy, and the voters' correlations are a tree of pairwise tables, the spanning tree of most mutual
   information given the class. Expectation-maximisation fits all of it to the votes of a bounded sample of texts: up to
   `labelled` of the second half and up to `unlabelled` of all. A given label is one more voter, of fitted accuracy, absent
   where there is no label; the first step starts from it, which fixes what the classes mean.
3. A logistic regression on the telling features and the patterns is trained on the model's posteriors. Its output is the
   score.

Texts don't go through a shuffle but for those of labelled ids: a Bloom filter of fixed size picks them before the join.

Only rows whose crc32(doc_id as text) mod 4 is not 2 are learned from. Defined cases: a null or empty text scores as a text
without features; with no labelled rows every score is 0.025. Several labels for one id: each counts in the lexicons, and
the label model sees the larger one. Null ids are scored, not learned from. Repeated rows get equal scores. A text of any
length is one row; memory follows the longest. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._text import _BYTE_LOWER, _SPACE, U64, Runs, Words, mix, sliced
from brindle.llm.language_id import remainder


@dataclass(frozen=True)
class Toxicity:
    """lexicons: fixed lists of words, a voter each; beginnings: lengths in bytes, a voter each; voters: for whole words.

    features: telling ones kept for the classifier, at most; one needs `least` toxic texts and `lift` times the share that it
    has of the others; entries of lexicons have a likelihood ratio of at least `worth` against independence of the label, and
    at least a share `sure` of their texts are toxic. labelled, unlabelled: bounds of the texts that the label
    model and the classifier are fitted on. bits: of the Bloom filter of labelled ids.
    """

    lexicons: tuple[tuple[str, ...], ...] = ()
    beginnings: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    voters: int = 8
    features: int = 3000
    least: int = 3
    lift: float = 2.0
    worth: float = 15.0
    sure: float = 0.85
    labelled: int = 6000
    unlabelled: int = 6000
    bits: int = 1 << 23
    threshold: float = 0.3
    rounds: int = 40
    steps: int = 300


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted hashes of the features
    weights: np.ndarray  # of the features, then of the patterns
    bias: float


PATTERNS = 5


def patterns(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each text: many exclamation marks, mostly capitals, masked words, many question marks, doubled marks."""

    def share(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[offs]).astype(float)

    upper, lower, mark, star = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122), raw == 33, raw == 42
    words = np.maximum(share(_SPACE[raw]) + 1, 1)
    letters = np.maximum(share(upper) + share(lower), 1)
    twice = np.zeros(len(raw), bool)
    twice[1:] = mark[1:] & mark[:-1]
    masked = np.zeros(len(raw), bool)
    masked[1:] = star[1:] & star[:-1]
    return np.stack([share(mark) / words > 0.1, share(upper) / letters > 0.5, share(masked) > 0, share(raw == 63) / words > 0.1, share(twice) > 0], axis=1)


def _feature_hashes(raw: np.ndarray, offs: np.ndarray, p: Toxicity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words (kind 0) and of their beginnings (kind: the length), and the text of each; not yet distinct."""
    w = Words(raw, offs, hashes=False)
    runs = Runs(_BYTE_LOWER[raw])
    # a word's own marks at its end are no part of it
    end = w.end.copy()
    for _ in range(3):
        mark = (end > w.start + 1) & np.isin(raw[end - 1], np.frombuffer(b".,;:!?*#$%&\"')", np.uint8))
        end -= mark
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(w.offs))
    out, of, kind = [runs.hash(w.start, end)], [doc], [np.zeros(len(doc), np.int8)]
    for n in p.beginnings:
        ok = end - w.start > n
        out.append(mix(runs.hash(w.start[ok], w.start[ok] + n) ^ U64(n)))
        of.append(doc[ok])
        kind.append(np.full(int(ok.sum()), n, np.int8))
    return np.concatenate(out), np.concatenate(of), np.concatenate(kind)


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (h, doc) once, and where it stands in the input."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], doc[first], order[first]


def _word_hashes(words: tuple[str, ...]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    w = Words(raw, np.array([0, len(raw)]), hashes=False)
    return Runs(_BYTE_LOWER[raw]).hash(w.start, w.end)


@dataclass(frozen=True)
class LabelModel:
    """Of votes given a class. prior: of class 1; on: [class, voter], the chance to vote; parent: the voter that one depends
    on, -1 for the root; table: [class, voter, the parent's vote], the chance to vote; given: [class], that the label is 1."""

    prior: float
    on: np.ndarray
    parent: np.ndarray
    table: np.ndarray
    given: np.ndarray

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The chance of class 1. labels: 1, 0, or -1 for none."""
        v = votes.astype(int)
        above = np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], 0)
        odds = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for k in range(v.shape[1]):
            t = self.table[:, k, above[:, k]]
            odds += np.where(v[:, k] == 1, np.log(t[1] / t[0]), np.log((1 - t[1]) / (1 - t[0])))
        odds += np.select([labels == 1, labels == 0], [np.log(self.given[1] / self.given[0]), np.log((1 - self.given[1]) / (1 - self.given[0]))], 0.0)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _spanning(gain: np.ndarray) -> np.ndarray:
    """The parents of the spanning tree of most gain, from voter 0."""
    k = len(gain)
    parent, best, done = np.full(k, -1), gain[0].copy() if k else np.zeros(0), np.zeros(k, bool)
    from_ = np.zeros(k, int)
    done[:1] = True
    for _ in range(k - 1):
        j = int(np.where(done, -np.inf, best).argmax())
        parent[j], done[j] = from_[j], True
        better = gain[j] > best
        from_[better], best = j, np.maximum(best, gain[j])
    return parent


def _fit_votes(v: np.ndarray, labels: np.ndarray, post: np.ndarray, weight: np.ndarray, correlated: bool) -> LabelModel:
    """The likeliest parameters, given each text's chance of class 1, with half a text of each kind added."""
    k = v.shape[1]
    on, both, given, mass = np.zeros((2, k)), np.zeros((2, k, k)), np.zeros(2), np.zeros(2)
    for c, share in enumerate((weight * (1 - post), weight * post)):
        mass[c] = share.sum()
        on[c], both[c] = (share @ v + 0.5) / (mass[c] + 1), (v * share[:, None]).T @ v
        known = share * (labels >= 0)
        given[c] = (share[labels == 1].sum() + (0.8 if c else 0.2)) / (known.sum() + 1)
    # mutual information of two votes given the class
    gain = np.zeros((k, k))
    for c in range(2):
        one = on[c] * (mass[c] + 1)
        n11 = both[c] + 0.25
        n10, n01 = one[:, None] - n11 + 0.25, one[None, :] - n11 + 0.25
        n00 = mass[c] + 1 - n11 - n10 - n01
        for n, x, y in ((n11, on[c], on[c]), (n10, on[c], 1 - on[c]), (n01, 1 - on[c], on[c]), (n00, 1 - on[c], 1 - on[c])):
            n = np.maximum(n, 1e-9)
            gain += n * np.log(n / (mass[c] + 1) / np.outer(x, y))
    parent = _spanning(gain) if correlated else np.full(k, -1)
    table = np.repeat(on[:, :, None], 2, axis=2)
    for j in np.flatnonzero(parent >= 0).tolist():
        i = parent[j]
        for c in range(2):
            one = both[c][i, i]
            # drawn towards the voter's own rate where the parent's vote is rare
            table[c, j, 1] = (both[c][i, j] + on[c, j]) / (one + 1)
            table[c, j, 0] = (both[c][j, j] - both[c][i, j] + on[c, j]) / (mass[c] - one + 1)
    return LabelModel(float(np.clip(mass[1] / max(mass.sum(), 1e-9), 1e-4, 1 - 1e-4)), on, parent, np.clip(table, 1e-5, 1 - 1e-5), np.clip(given, 1e-3, 1 - 1e-3))


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int, correlated: bool = True) -> tuple[LabelModel, np.ndarray]:
    """votes: texts x voters of 0/1; labels: 1, 0, or -1 for none. The fitted model and the posteriors of class 1.

    Without a label of either kind the start is the share of voters that vote.
    """
    v = votes.astype(float)
    known = labels >= 0
    if known.any() and 0 < labels[known].mean() < 1:
        post, weight = np.where(labels == 1, 0.9, 0.1), known.astype(float)
    else:
        share = v.mean(axis=1)
        post, weight = np.where(share > share.mean(), 0.8, 0.1), np.ones(len(v))
    model = _fit_votes(v, labels, post, weight, correlated)
    for _ in range(rounds):
        before, post = post, model.posterior(votes, labels)
        model = _fit_votes(v, labels, post, np.ones(len(v)), correlated)
        if np.abs(post - before).max() < 1e-4:
            break
    return model, model.posterior(votes, labels)


def _some(ids: DataFrame, n: int, salt: str) -> DataFrame:
    """The n ids of smallest hash."""
    return ids.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(n)


def _labelled(texts: DataFrame, given: DataFrame, p: Toxicity) -> DataFrame:
    """texts(doc_id, text) with the y of given(id, y). Of the others, a Bloom filter keeps all but a few out of the join."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(p.bits))
    word = given.select(place("id").alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word"))
    words = word.agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask"))  # bits / 64 rows at most
    near = texts.withColumn("at", place("doc_id")).withColumn("word", F.floor(F.col("at") / 64)).join(F.broadcast(words), "word")
    near = near.filter(F.expr("(shiftrightunsigned(mask, cast(at % 64 as int)) & 1L) = 1L")).select("doc_id", "text")
    return near.join(given, near["doc_id"] == given["id"]).select("doc_id", "text", "y")


def _telling(known: DataFrame, given: DataFrame, p: Toxicity) -> tuple[np.ndarray, np.ndarray]:
    """The features that speak for label 1, over all rows of known(text, y): hashes, and kinds, -1 for those that make no lexicon."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, offs in sliced(batches, "text", 1 << 19):
            y = b.column("y").to_numpy(zero_copy_only=False)
            h, doc, kind = _feature_hashes(raw, offs, p)
            h, doc, at = _distinct(h, doc)
            one, lead, index = np.unique(h, return_index=True, return_inverse=True)
            toxic = np.bincount(index, weights=y[doc], minlength=len(one)).astype(np.int64)
            yield pa.record_batch([pa.array(one.view(np.int64)), pa.array(kind[at][lead].astype(np.int32)), pa.array(toxic), pa.array(np.bincount(index, minlength=len(one)))], ["h", "kind", "t", "n"])

    total = given.agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    all_t, all_n = float(total["t"] or 0), float(total["n"] or 0)
    tally = known.select("text", "y").mapInArrow(spread, "h long, kind int, t long, n long").groupBy("h", "kind").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    # how far the counts by label are from independence (the likelihood ratio of the two-by-two table), where 1 has more than its share
    t, c = F.col("t").cast("double"), (F.col("n") - F.col("t")).cast("double")
    cells = ((t, F.lit(all_t)), (c, F.lit(all_n - all_t)), (all_t - t, F.lit(all_t)), (all_n - all_t - c, F.lit(all_n - all_t)))
    there = (t + c) / all_n
    worth = reduce(lambda x, y: x + y, (F.when(o > 0, 2 * o * F.log(o / (of * (there if k < 2 else 1 - there)))).otherwise(0.0) for k, (o, of) in enumerate(cells)))
    more = (t + 0.5) / (all_t + 1) > p.lift * (c + 0.5) / (all_n - all_t + 1)
    telling = tally.filter((F.col("t") >= p.least) & more).select("h", "kind", F.when(F.col("t") + 0.5 >= p.sure * (F.col("n") + 1), worth).alias("sure"), worth.alias("worth"))
    top = telling.orderBy(F.desc("worth"), "h").limit(p.features).collect()
    return np.array([r["h"] for r in top], np.int64).view(U64), np.array([r["kind"] if (r["sure"] or 0) >= p.worth else -1 for r in top], np.int64)


def fit(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> Model:
    return learn(docs, labels, p)[0]


def learn(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> tuple[Model, LabelModel | None]:
    """The classifier and the label model that it was trained on."""
    given = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    given = given.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2)
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter(remainder() != 2)
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2))
    first = given.filter(half == 0)
    telling, kinds = _telling(_labelled(texts, first, p), first, p)
    fixed = [np.unique(_word_hashes(x)) for x in p.lexicons]
    keys = np.unique(np.concatenate([telling, *fixed, np.zeros(0, U64)]))
    nothing = Model(np.zeros(0, U64), np.zeros(PATTERNS), float(np.log(0.025 / 0.975)))
    # at most labelled + unlabelled ids, which therefore may be sent to all tasks
    chosen = _some(given.filter(half == 1).groupBy("id").agg(F.max("y").alias("y")), p.labelled, "labelled")
    chosen = chosen.unionByName(_some(texts.select(F.col("doc_id").alias("id")).distinct(), p.unlabelled, "unlabelled").withColumn("y", F.lit(None).cast("int")))
    chosen = chosen.groupBy("id").agg(F.max("y").alias("y"))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, offs in sliced(batches, "text", 1 << 19):
            at, doc = _found(raw, offs, keys, p)
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=b.num_rows)))).astype(np.int32)
            pats = pa.array([x.tobytes() for x in patterns(raw, offs).astype(np.int8)], pa.binary())
            yield pa.record_batch([b.column("id"), b.column("y"), pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pats], ["id", "y", "f", "p"])

    sample = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["id"]).select("id", "y", "text").mapInArrow(marks, "id long, y int, f array<int>, p binary")
    rows = sample.groupBy("id").agg(F.min(F.struct("f", "p", "y")).alias("r")).orderBy("id").select("r.*").collect()
    y = np.array([-1 if r["y"] is None else r["y"] for r in rows])
    if not (y == 1).any() and not len(telling):
        return nothing, None
    at = np.concatenate([np.array(r["f"], np.int64) for r in rows] + [np.zeros(0, np.int64)])
    of = np.repeat(np.arange(len(rows)), [len(r["f"]) for r in rows])
    pats = np.array([np.frombuffer(r["p"], np.int8) for r in rows])
    # the voters: word lexicons, beginnings by length, fixed lexicons, patterns
    order = np.argsort(telling)
    voter = np.where(kinds == 0, (mix(telling) % U64(max(1, p.voters))).astype(np.int64), p.voters + np.searchsorted(np.array(p.beginnings), kinds))
    voter[kinds < 0] = -1
    deal = np.full(len(keys), -1)
    deal[np.searchsorted(keys, telling[order])] = voter[order]
    votes = np.zeros((len(rows), p.voters + len(p.beginnings) + len(fixed) + PATTERNS), np.int8)
    votes[of[deal[at] >= 0], deal[at][deal[at] >= 0]] = 1
    for k, x in enumerate(fixed):
        votes[of[np.isin(keys[at], x)], p.voters + len(p.beginnings) + k] = 1
    votes[:, votes.shape[1] - PATTERNS :] = pats
    model, post = label_model(votes, y, p.rounds)
    w, b = _logistic(at, of, pats, len(keys), post, p)
    return Model(keys, w, b), model


def _logistic(at: np.ndarray, of: np.ndarray, pats: np.ndarray, n_keys: int, post: np.ndarray, p: Toxicity) -> tuple[np.ndarray, float]:
    """Weights and bias that predict the posteriors, by steps scaled for each weight. Text of[i] has feature at[i]."""
    n = len(post)
    w, v, b = np.zeros(n_keys), np.zeros(pats.shape[1]), float(np.log((post.mean() + 1e-3) / (1 - post.mean() + 1e-3)))
    seen, seen_v, seen_b = np.full(n_keys, 1e-8), np.full(pats.shape[1], 1e-8), 1e-8
    for _ in range(p.steps):
        z = np.bincount(of, weights=w[at], minlength=n) + pats @ v + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - post) / n
        g, gv, gb = np.bincount(at, weights=err[of], minlength=n_keys) + 1e-5 * w, err @ pats + 1e-5 * v, float(err.sum())
        seen, seen_v, seen_b = seen + g * g, seen_v + gv * gv, seen_b + gb * gb
        w, v, b = w - 0.3 * g / np.sqrt(seen), v - 0.3 * gv / np.sqrt(seen_v), b - 0.3 * gb / seen_b**0.5
    return np.concatenate((w, v)), b


def _found(raw: np.ndarray, offs: np.ndarray, keys: np.ndarray, p: Toxicity) -> tuple[np.ndarray, np.ndarray]:
    """The features that texts have, each once a text: feature, text; by text."""
    h, doc, _ = _feature_hashes(raw, offs, p)
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = keys[at] == h
    both = np.unique(doc[hit] * len(keys) + at[hit])
    return both % len(keys), both // len(keys)


def score(docs: DataFrame, model: Model, p: Toxicity = Toxicity()) -> DataFrame:
    """docs(doc_id, text) to doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, offs in sliced(batches, "text", 1 << 19):
            at, doc = _found(raw, offs, model.keys, p)
            z = np.bincount(doc, weights=model.weights[at], minlength=b.num_rows) + model.bias
            z += patterns(raw, offs) @ model.weights[len(model.keys) :]
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s.astype(float)), pa.array((s >= p.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long"), F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "text")
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> DataFrame:
    return score(docs, fit(docs, labels, p), p)
