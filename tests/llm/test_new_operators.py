"""Operators 11 to 13 against brute force."""

import hashlib
import itertools
import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
from test_llm import CLASHING, SCHEMA, texts

from brindle.llm import centroids, quality_fm, token_alignment
from brindle.llm.queries import tokenizers

# centroid clustering


def clustered(rows, p):
    kept = [(i, [max(-centroids.LARGEST, min(centroids.LARGEST, math.floor(p.scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == p.width and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    seeds = sorted((hashlib.sha256(f"{p.salt}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in seeds[: p.k]]
    far = lambda v, k: sum((a - b) ** 2 for a, b in zip(v, c[k], strict=True))
    near = lambda: [min(range(len(c)), key=lambda k: (far(v, k), k)) for _, v in kept]
    for _ in range(p.rounds):
        a = near()
        for k in range(len(c)):
            mine = [v for (_, v), x in zip(kept, a, strict=True) if x == k]
            if mine:
                c[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    a = near()
    d = [far(v, k) for (_, v), k in zip(kept, a, strict=True)]
    own = Counter()
    for k, x in zip(a, d, strict=True):
        own[k] += x
    return [(i, k, x, own[k], sum(d), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for (i, _), k, x in zip(kept, a, d, strict=True)]


def test_centroids(spark):
    rnd = random.Random(3)
    p = centroids.Clustering(k=5, width=3, rounds=6, block=16)
    rows = [(k, [rnd.choice((0.0, 0.5, 1.0, rnd.gauss(0, 1))) for _ in range(3)]) for k in range(150)]
    rows += [rows[3], rows[3], (None, [0.5, 0.5, 0.5]), (7, [9.0, 9.0, 9.0]), (900, None), (901, []), (902, [1.0, None, 2.0]), (903, [math.nan, 0.0, 0.0]), (904, [math.inf, 0.0, 0.0]), (905, [1e30, -1e30, 3e5]), (906, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "?", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, sums int").repartition(4)
    got = centroids.cluster(df, p)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(clustered(rows, p), key=key)
    few = df.filter("vec_id in (1, 2)")
    assert sorted(map(tuple, centroids.cluster(few, p).collect())) == sorted(clustered(rows[1:3], p))
    assert centroids.cluster(df.limit(0), p).count() == centroids.cluster(df.filter("vec_id > 903"), p).count() - 1 == 0


def test_bounds_skip_and_keep_ties():
    """Every pass gives the assignment of all distances, ties to the smaller number, and computes fewer of them."""
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.integers(-4, 5, (400, 6)) + c for c in rnd.integers(-30, 31, (8, 1, 6))]).astype(np.int32)
    c = [v.tolist() for v in x[::400]] + [x[0].tolist()]
    a, up, low = centroids.first_pass(x, c)
    for _ in range(6):
        now = [v if not (a == k).any() else (x[a == k].sum(axis=0) // (a == k).sum()).tolist() for k, v in enumerate(c)]
        a, up, low, computed = centroids.next_pass(x, a, up, low, centroids.Move.of(c, now))
        c = now
        d = np.array([[sum((int(p) - q) ** 2 for p, q in zip(v, w, strict=True)) for w in c] for v in x])
        assert (a == d.argmin(axis=1)).all() and computed < d.size
        root = np.sqrt(d.astype(float))
        assert (up >= root[np.arange(len(x)), a]).all() and (low.T <= root).all()


# cross-tokenizer alignment


def aligned(rows):
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    a_bytes = {i: bytes(byte[c] for c in w) for w, i in t.get_vocab().items() if w != "<|endoftext|>"}
    b_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for i, text in rows:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        x, y = [a_bytes[k] for k in a], [b_bytes(k) for k in b]
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            docs.append((i, [], [], [], []))
            continue
        ends = [list(itertools.accumulate(map(len, z))) for z in (x, y)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        of = lambda ids, e, lo, hi: ",".join(str(k) for k, z in zip(ids, e, strict=True) if lo < z <= hi)  # noqa: B023, E731
        groups = [f"{of(a, ends[0], lo, hi)}|{of(b, ends[1], lo, hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False)] if len(a) < 3000 else None
        links, m, n = [], 0, 0
        while m < len(a) and n < len(b):
            links.append((a[m], b[n]))
            here, there = ends[0][m], ends[1][n]
            m, n = m + (here <= there), n + (there <= here)
        docs.append((i, a, b, groups if groups is not None else len(cuts), links))
    count = Counter()
    for d in docs:
        count.update(set(d[4]))
    top: dict = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    digest = lambda g, a: None if isinstance(g, int) else hashlib.sha256(";".join(g).encode()).hexdigest() if a else ""
    return [(i, len(a), len(b), g if isinstance(g, int) else len(g), len(ln), sum(count[x] == top[x[0]] for x in ln), sum(count[x] for x in ln), digest(g, a)) for i, a, b, g, ln in docs]


def test_alignment(spark):
    odd = ["▁ mark", "a▁b", "<s> </s> <|endoftext|> <0x41>", "it's ﬁne ① é 😀 \x00", " ", "  two  blanks ", "\n\t x\r\n", "ab " * 300, "don't we'll I'M", "日本語 テキスト"]
    every = [*texts(), *odd]
    rows = [(k, t) for k, t in enumerate(every)]
    rows += [rows[12], rows[13], (None, rows[14][1])]
    df = spark.createDataFrame([(i, t, None, None, 1, *("?" * len(CLASHING))) for i, t in rows], SCHEMA).repartition(3)
    want = Counter(aligned(rows))
    long = {r[0] for r in want if r[-1] is None}
    for heavy in (5, 200_000):
        got = token_alignment.align(df, replace(tokenizers(), heavy=heavy)).collect()
        assert Counter((*tuple(r)[:-1], None if r["doc_id"] in long else r["groups_sha256"]) for r in got) == want
    assert token_alignment.align(df.limit(0), tokenizers()).count() == 0


def test_alignment_of_a_slice(spark):
    """Documents of a slice stay apart, one without tokens among them; no row is made for a token, and nothing is sorted."""
    array = lambda *x: np.array(x, np.int64)
    groups, links, digests, each, pairs = token_alignment.aligned(array(7, 8, 9, 7), array(1, 2, 1, 3), array(2, 3, 4, 2), array(2, 4, 3, 2), array(0, 3, 3, 4), array(0, 3, 3, 4))
    assert (groups.tolist(), links.tolist(), each.tolist()) == ([2, 0, 1], [4, 0, 1], [4, 0, 1])
    assert digests == [hashlib.sha256(b"7|1;8,9|2,1").hexdigest(), "", hashlib.sha256(b"7|3").hexdigest()]
    assert pairs.tolist() == [1 << 32 | a << 15 | b for a, b in ((7, 1), (8, 2), (9, 1), (9, 2), (7, 3))]
    plan = token_alignment.document_facts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), tokenizers())._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("Generate", "Window", "Sort"))


# the factorisation machine


def test_machine_by_all_pairs():
    rnd = np.random.default_rng(5)
    m = quality_fm.Machine(0.3, rnd.normal(size=9), rnd.normal(size=(9, 3)), None, None, None)
    ids, values, doc = np.array([0, 3, 8, 2, 2, 5]), rnd.normal(size=6), np.array([0, 0, 0, 1, 1, 1])
    got = quality_fm.margin(ids, values, doc, 3, m)
    for d in range(3):
        at = np.flatnonzero(doc == d)
        pairs = sum(m.v[ids[i]] @ m.v[ids[j]] * values[i] * values[j] for i, j in itertools.combinations(at, 2))
        assert abs(got[d] - (0.3 + (m.w[ids[at]] * values[at]).sum() + pairs)) < 1e-9


def test_quality(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeioubdkmnrst") for _ in range(rnd.randint(2, 9)))
    good = lambda: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(6))
    bad = [lambda: " ".join(word() + rnd.choice("#*$%") * 3 for _ in range(50)), lambda: " | ".join(word() for _ in range(40)), lambda: "\n".join(["again and again and again"] * 20), lambda: " ".join(word().upper() + "!!" for _ in range(50))]
    rows = [(k, rnd.choice(bad)() if k % 4 == 0 else good()) for k in range(600)]
    odd = [(None, good()), (9001, None), (9002, ""), (9003, " \n "), (9004, "w" * 200_000), rows[4], rows[5]]
    docs = spark.createDataFrame([(i, t, None if i and i % 7 == 0 else len(t or ""), "?") for i, t in rows + odd], "doc_id long, text string, n_chars int, score string").repartition(4)
    labels = spark.createDataFrame([(k, 0 if k % 4 == 0 else 1) for k in range(600)] + [(None, 1), (5, None), (9, 7)], "doc_id long, quality int")
    p = replace(quality_fm.Quality(), passes=12)
    got = [r.asDict() for r in quality_fm.quality_scores(docs, labels, p).collect()]
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(held) > 80 and sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held) >= 0.97 * len(held)
    twice = [r["score"] for r in got if r["doc_id"] == 4]
    assert len(twice) == 2 and twice[0] == twice[1]
    bare = quality_fm.quality_scores(docs.drop("n_chars"), labels.limit(0), p).collect()
    assert {round(r["score"], 6) for r in bare} == {0.85}
    assert quality_fm.quality_scores(docs.limit(0), labels, p).count() == 0
