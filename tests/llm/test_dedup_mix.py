"""Exact dedup and source mixing against brute force, with odd rows and empty tables."""

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from duskline.llm import exact_dedup, mixing


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def sha(text):
    return hashlib.sha256(lower(text).encode()).hexdigest()


def test_exact_dedup_odd_rows(odd_rows):
    rows = odd_rows.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[sha(r.text)].append(r.doc_id)
    want = Counter()
    for key, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i, n in Counter(ids).items():
            for copy in range(n):
                want[(i, keep, len(ids), i == keep and copy == 0, key)] += 1
    for bits in (64, exact_dedup.FILTER_BITS):  # a full filter only lets more rows into the grouping
        got = exact_dedup.dedup(odd_rows, bits).drop("copy").collect()
        assert Counter(map(tuple, got)) == want


def test_drop_copies_keeps_one_row_of_each(odd_rows):
    kept = exact_dedup.drop_copies(odd_rows)
    assert kept.columns == odd_rows.columns
    got = kept.select("doc_id", "text").collect()
    assert sorted(sha(r.text) for r in got) == sorted({sha(r.text) for r in odd_rows.select("text").collect()})
    assert {r.doc_id for r in got} >= {6, 7, 8, 9, 10, None} and not {1, 2, 3} & {r.doc_id for r in got}


def test_empty_tables(odd_rows):
    none = odd_rows.limit(0)
    assert exact_dedup.dedup(none).count() == 0 == exact_dedup.drop_copies(none).count()
    assert mixing.mix(none).count() == 0 == mixing.mixed_texts(none).count()


def levels(sizes):
    """Targets by resharing the excess again and again."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full = set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[o] for o in names if o not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_targets_and_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") < 6, "tiny")
                           .otherwise(F.substring("source", 1, 4)))
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(got) == docs.count()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    want = levels(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("s")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_mixed_texts_hold_the_taken_words(spark, sf, odd_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("size", F.lit("clash"))
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(words_of(r.text))
        assert r.n_chars == len(r.text)
    assert words == {k: v for k, v in taken.items() if v}
    total = sum(r.taken for r in mixing.mix(odd_rows).collect())
    assert sum(len(words_of(r.text)) for r in mixing.mixed_texts(odd_rows).select("text").collect()) == total


def test_odd_rows_each_come_back(odd_rows):
    got = mixing.mix(odd_rows).collect()
    assert len(got) == odd_rows.count() and {r["size"] for r in got if r.doc_id in (3, 4, 5)} == {0}
