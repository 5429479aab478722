"""The near-duplicate join, its components and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest

from duskline.llm import near_join
from duskline.llm.components import components


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < words else [tuple(w[i:i + words]) for i in range(len(w) - words + 1)])


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def variants(seed, groups=6, copies=12):
    """Texts around the threshold: chains, stars without links between their points, short texts, copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 30, 80, 200]))]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                text = text[:-1]
            texts.append(" ".join(text))
            if rng.random() < 0.4:
                base = text
    rng.shuffle(texts)
    return list(enumerate(texts + texts[:5] + ["", "w1", "W1", "w1 w2"]))


@pytest.mark.parametrize("words,percent,seed", [(3, 90, 1), (5, 80, 2), (3, 80, 3), (1, 90, 4)])
def test_components_by_brute_force(spark, words, percent, seed):
    rows = variants(seed)
    got = near_join.link(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, words, percent)


def test_left_over_members_are_found(spark, monkeypatch):
    """One leader whose members link with each other but not with it, in several small blocks."""
    monkeypatch.setattr(near_join, "LEAF_ROWS", 4)
    monkeypatch.setattr(near_join, "QUERY_ROWS", 4)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(100)]
    rows = []
    for i in range(40):
        text = list(base)
        for k in (range(0, 16, 2) if i % 2 else range(60, 76, 2)):
            text[k] = f"v{i // 8 if k % 4 else i}-{k}"
        rows.append((i, " ".join(text)))
    got = near_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 1, 90)


def test_routing_loses_no_pair():
    """Sets that link share a block key unless they are equal."""
    rng = np.random.default_rng(6)
    for percent in (80, 90):
        classes = near_join.Classes(percent)
        for n in (2, 5, 9, 10, 18, 19, 40, 121, 300, 1000):
            for _ in range(30):
                a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
                drop = rng.integers(0, max(1, int(len(a) * (1 - percent / 100))) + 1)
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2 ** 63, drop // 3).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and len(a) != both:
                    assert np.intersect1d(near_join.bucket_keys(a, classes), near_join.bucket_keys(b, classes)).size


def test_tree_search_equals_the_scan():
    rng = np.random.default_rng(7)
    points = rng.poisson(3, (500, near_join.GROUPS))
    points[250:] = np.maximum(points[:250] + rng.integers(-1, 2, (250, near_join.GROUPS)) * (rng.random((250, 64)) < 0.05), 0)
    sizes = points.sum(axis=1)
    tree = near_join.CountTree(points, sizes, 90)
    for q in range(0, 500, 9):
        shared = np.minimum(points, points[q]).sum(axis=1)
        assert sorted(tree.search(points[q], sizes[q])) == np.flatnonzero(190 * shared >= 90 * (sizes + sizes[q])).tolist()


def test_odd_rows(odd_rows):
    got = near_join.link(odd_rows, 3, 90).collect()
    assert len(got) == odd_rows.count()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by[1] == by[2] == by[6] == (5, 1) and by[3] == (0, 3) and by[4] == (0, 4) and by[5] == (0, 5)
    assert by[7] == (1, 7) and by[None] == (2, None)
    assert near_join.link(odd_rows.limit(0)).count() == 0
    kept = near_join.keep_one(odd_rows, 3, 90)
    assert kept.columns == odd_rows.columns and not {2, 6} & {r.doc_id for r in kept.select("doc_id").collect()}


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000, 5001), (5001, 5002), (5002, 5000)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.id)
    assert sorted(map(len, groups.values())) == [3, 100, 201] and len(got) == 304
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd_rows):
    import corpus_pipeline

    for docs in (odd_rows, odd_rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == odd_rows.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert last.columns[:len(odd_rows.columns)] == odd_rows.columns
        assert all(r.round_trip for r in last.select("round_trip").collect())


def test_pipeline_run(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(r.round_trip and r.n_tokens == len(r.tokens) for r in out)
