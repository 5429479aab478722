"""Phrases, repeated passages and whitening against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from duskline.llm import phrases, substrings, whitening

LOWER = {c: c + 32 for c in range(65, 91)}


# Phrases

def mined(rows, least, covered=80, top=2000):
    count, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i:i + k])
                    count[key] = count.get(key, 0) + 1
    often = {p: f for p, f in count.items() if f >= least and len(p[1]) > 1}
    covers = {}
    for (lang, q), f in often.items():
        for size in range(2, len(q)):
            for i in range(len(q) - size + 1):
                covers[lang, q[i:i + size]] = max(f, covers.get((lang, q[i:i + size]), 0))
    out = []
    for lang in total:
        found = []
        for (of, p), a in often.items():
            if of == lang and 100 * covers.get((of, p), 0) < covered * a:
                cuts = [(2000000 * a // (count[of, p[:k]] + count[of, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), count[of, p[:k]], count[of, p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def prose(seed, docs=150):
    rng = random.Random(seed)
    words = ["Kal", "der", "ünï", "to", "be", "or", "not", "x", "😀", "a-b"] + [f"w{i}" for i in range(30)]
    fixed = ["New York City Hall", "to be or", "or not to", "ünï 😀", "x x x x x"]
    rows = []
    for i in range(docs):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(60))]
        rows.append((i, "".join(p + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "!"]) for p in parts), rng.choice(["en", "de", None])))
    return rows


@pytest.mark.parametrize("shards,bits,seed", [(3, 1 << 20, 1), (1, 1 << 20, 2), (4, 64, 3)])
def test_phrases_by_brute_force(spark, shards, bits, seed):
    rows = prose(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = phrases.mine(docs, least=5, top=40, shards=shards, filter_bits=bits).collect()
    assert sorted(map(tuple, got)) == mined([(x, t) for _, t, x in rows], 5, top=40) and got


def test_blocks_of_words_do_not_change_counts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 20)
    block = phrases.Block(["Ab  c\td. e", "", "f"], np.array([1, 1, 2]))
    assert [block.text_of(a, 2) for a in block.places(2)] == [b"ab c", b"c d"] and len(block.places(1)) == 5
    rows = prose(9, 40)
    counted = phrases.exact_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string").na.fill("und").selectExpr(
        "lang", "xxhash64(lang) as code", "text"), np.full(1, -1)).collect()
    total = Counter()
    for _, text, lang in rows:
        total[lang or "und"] += sum(len(p.split()) for p in re.split(r"[.!\n]", text))
    assert {r.lang: r.f for r in counted if r.k == 0} == dict(total)


def test_phrases_on_odd_rows(odd_rows):
    got = [tuple(r) for r in phrases.mine(odd_rows).collect()]
    assert got == mined([(r.lang, r.text) for r in odd_rows.collect()], 30) and any(p[2] == "word word word word" for p in got)
    assert phrases.mine(odd_rows.limit(0)).count() == 0


# Repeated passages

def without(rows):
    """(doc_id, n_words, n_removed, hash) of every row."""
    def rank(d):
        return math.inf if d is None else d

    owner, split = {}, [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 12):
            key = tuple(w[i:i + 13])
            owner[key] = min(rank(d), owner.get(key, math.inf))
    out = []
    for d, w in split:
        gone = {i + j for i in range(len(w) - 12) if owner[tuple(w[i:i + 13])] < rank(d) for j in range(13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def cleaned(docs, **more):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest())
                  for r in substrings.cleaned(docs, **more).collect())


@pytest.mark.parametrize("hot,bits,seed", [(1000, 1 << 20, 1), (1, 1 << 20, 2), (3, 64, 3)])
def test_substrings_by_brute_force(spark, hot, bits, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "W1", "😀"]
    shared = [[rng.choice(words) for _ in range(n)] for n in (12, 13, 14, 30, 90)] + [["again"] * 200]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(5)):
            passage = rng.choice(shared)
            at = rng.randrange(len(passage))
            text += [rng.choice(words) for _ in range(rng.randrange(20))] + (passage if rng.random() < 0.6 else passage[at:])
        rows.append((rng.choice([i, i, i // 2, None]), "".join(w + rng.choice([" ", "\n ", "\t"]) for w in text)))
    rows += rows[:10]
    assert cleaned(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, filter_bits=bits) == without(rows)


def test_substrings_on_odd_rows(odd_rows):
    assert cleaned(odd_rows) == without([(r.doc_id, r.text) for r in odd_rows.collect()])
    assert cleaned(odd_rows.limit(0)) == []


# Whitening

def whitened(vectors, components=16):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    mean = fit.mean(axis=0)
    values, vec = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(x.shape[1], -1))
    values, vec = values[::-1], vec[:, ::-1]
    k = min(components, int((values > values[0] * 1e-12).sum()))
    return len(fit), x, fit.sum(axis=0), (x - mean) @ vec[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("dims,rows", [(24, 300), (3, 50), (1, 9), (40, 30)])
def test_whitening_by_dense_eigenvectors(spark, dims, rows):
    rng = np.random.default_rng(dims)
    vectors = (rng.standard_normal((rows, dims)) * np.linspace(3, 1, dims)).astype(np.float32).tolist()
    vectors += vectors[:7] * 3
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    n, x, sums, want, share = whitened(vectors)
    got = {}
    for r in whitening.whiten(docs).collect():
        got[r.vec_id, r.component] = r
        assert r.n == n and r.identity_error < 1e-10 and abs(r.explained / share[r.component - 1] - 1) < 1e-9
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r.vec_id], sums))
    assert len(got) == want.size
    for c in range(want.shape[1]):
        mine = np.array([got[i, c + 1].whitened for i in range(len(vectors))])
        assert min(np.abs(mine - want[:, c]).max(), np.abs(mine + want[:, c]).max()) < 1e-6


def test_many_triangles_meet_in_turns(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 8)
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((200, 6)).astype(np.float32).tolist()
    docs = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(9)
    _, _, _, want, _ = whitened(vectors)
    first = {r.vec_id: abs(r.whitened) for r in whitening.whiten(docs, 1).collect()}
    assert max(abs(first[i] - abs(want[i, 0])) for i in range(200)) < 1e-6


def test_whitening_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (2, [3.0, 1.0], "a"), (2, [3.0, 1.0], "a"), (None, [0.5, 0.25], None), (4, None, "b"), (5, [], "b"),
            (6, [1.0, None], "b"), (7, [nan, 1.0], "c"), (8, [1.0, -inf], "c"), (9, [1.0, 2.0, 3.0], "c"), (10, [1e30, 0.0], "c")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string")
    got = whitening.whiten(docs).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == sorted((i, c, 3) for i in ("1", "2", "2", "None") for c in (1, 2))
    assert whitening.whiten(docs.limit(0)).count() == 0 == whitening.whiten(docs.filter("vec_id = 1")).count()
    constant = spark.createDataFrame([(i, [7.0, float(i)]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(constant).collect()} == {1}


@pytest.mark.parametrize("kind", ["plain", "steep", "flat", "ties", "zero columns", "low rank"])
def test_the_solver_on_hard_spectra(kind):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((120, 40))
    if kind == "steep":
        a *= np.logspace(0, -7, 40)
    elif kind == "flat":
        a = np.linalg.qr(a)[0]
    elif kind == "ties":
        a = np.linalg.qr(a)[0] * np.repeat([3.0, 2.0, 1.0], [5, 20, 15])
    elif kind == "zero columns":
        a[:, [3, 11]] = 0
    elif kind == "low rank":
        a = a[:, :9] @ rng.standard_normal((9, 40))
    r = np.linalg.qr(a, mode="r")
    diagonal, upper, turn = whitening.bidiagonal(r)
    values, want = whitening.singular_squares(diagonal, upper), np.linalg.svd(r, compute_uv=False) ** 2
    assert np.abs(values - want).max() < 1e-12 * want[0]
    k = min(16, int((want > want[0] * 1e-24).sum()))
    vectors = turn @ whitening.eigenvectors(diagonal, upper, values, k)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-10
    assert np.abs(r.T @ (r @ vectors) - vectors * values[:k]).max() < 1e-10 * want[0]
