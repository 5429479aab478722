"""Cases in which an operator once did less than its whole job."""

import random

import pytest
from pyspark.sql import functions as F

from duskline.llm import fingerprints, language, licenses, near_join


def test_a_language_of_copies_is_learned_whole(spark):
    """30,000 rows of 30 texts, and one text with most rows of a language of many texts."""
    few = spark.range(30_000).select("id", F.lit("aa").alias("lang"), F.concat(F.lit("few "), (F.col("id") % 30).cast("string"),
                                                                              F.lit(".")).alias("text"))
    many = spark.range(20_000).select("id", F.lit("bb").alias("lang"), F.when(F.col("id") % 2 == 0, F.lit("hot .")).otherwise(
        F.concat(F.lit("many "), F.col("id").cast("string"), F.lit("."))).alias("text"))
    learned = language.train(few.unionByName(many))
    got = {k: set(v.decode().split("\n")) for k, v in learned.dictionaries.items()}
    assert got["aa"] == {f"few {i}." for i in range(30)} and len(got["bb"]) == language.TEXTS
    assert set(learned.prior_bits) == {"aa", "bb"} and learned.prior_bits["aa"] < 1 < learned.prior_bits["bb"]


def test_notices_inside_long_texts(spark, sf):
    """Every template in the middle of long texts; a text of licenses only has all the words of a notice elsewhere."""
    scanner = licenses.Scanner()
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    words = " ".join(texts).split()
    for n, (name, template) in enumerate(licenses.TEMPLATES):
        for i, length in enumerate((20, 130, 400, 700)):
            at = (n * 4 + i) * 37
            text = f"{' '.join(words[at:at + length])} {template} {' '.join(words[at + length:at + 2 * length])}"
            assert name in {f.name for f in scanner.scan(text)[1]}, (name, length)
    for name, template in licenses.TEMPLATES:
        if len(template.split()) == 12:
            text = "the license of a public work is general " * 40 + template + " version of this license is public" * 40
            assert [f.name for f in scanner.scan(text)[1]] == [name]


def test_every_copy_and_every_license_of_a_block():
    scanner = licenses.Scanner()
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-2.0" and len(t) > 200)
    for gap in (0, 5, 100):
        text = f"{gpl} {'more ' * gap}{gpl}"
        assert [(f.name, f.start) for f in scanner.scan(text)[1]] == [("GPL-2.0", 0), ("GPL-2.0", len(text) - len(gpl))]
    # The last or the first word is changed, and stands again further away.
    last = gpl.rsplit(" ", 1)[0] + " issue " + "plain " * 60 + "version"
    first = "this " + "plain " * 60 + "that " + gpl.split(" ", 1)[1]
    for text, word in ((last, "version"), (first, "this")):
        assert [(f.name, f.added, f.missing) for f in scanner.scan(text)[1]] == [("GPL-2.0", "", word)]
    # All templates one after the other.
    every = [f for f in scanner.scan(" filler and more ".join(t for _, t in licenses.TEMPLATES))[1]]
    assert [f.name for f in every] == [n for n, _ in licenses.TEMPLATES] and not any(f.differences for f in every)


def test_alignment_is_the_least_of_all():
    """Against all pairs of edits on small texts."""
    rng = random.Random(3)

    def least(words, block):
        best = len(words)
        for low in range(len(block) + 1):
            row = list(range(len(words) + 1))
            for j in range(low, len(block)):
                new = [row[0] + 1]
                for i, w in enumerate(words):
                    new.append(row[i] if w == block[j] else min(row[i + 1], new[i]) + 1)
                row = new
                best = min(best, row[-1])
        return best

    for _ in range(200):
        words = [rng.choice("abcdefgh") for _ in range(14)]
        copy = list(words)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy)):][:1] = []
            at = rng.randrange(len(copy))
            copy[at:at + rng.randrange(2)] = rng.choice([[], ["x"]])
        block = ["y"] * 6 + copy + ["z"] * 6
        hits = [h for s in range(3, 10) if (h := licenses.aligned(words, block, s, 3))]
        want = least(words, block)
        assert bool(hits) == (want <= 3)
        if hits:
            low, high, added, missing = min(hits, key=lambda h: len(h[2]) + len(h[3]))
            assert len(added) + len(missing) == want
            assert sorted(block[low:high]) == sorted([*words, *added], key=str) or missing


@pytest.mark.parametrize("bound", [1000, 0])
def test_keep_one_decides_per_row(spark, bound):
    """Null and repeated ids: near copies go, other rows of the same id or without an id stay."""
    def text(name, change=""):
        return " ".join(f"{name}{i}" for i in range(40)) + change

    rows = [(3, text("a"), 1), (None, text("a", " x"), 2), (None, text("b"), 3), (7, text("a", " y"), 4), (7, text("c"), 5),
            (8, text("d"), 6), (8, text("d", " z"), 7), (None, text("e"), 8), (None, text("e", " z"), 9),
            (9, text("f"), 10), (9, text("f"), 11), (None, None, 12), (None, "", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text int")
    kept = near_join.keep_one(docs, 5, 80, bound)
    assert kept.columns == docs.columns
    got = sorted(r._text for r in kept.collect())
    assert [n for n in got if n in (1, 2, 3, 4, 5, 12, 13)] == [1, 3, 5, 12, 13]
    assert [len([n for n in got if n in of]) for of in ((6, 7), (8, 9), (10, 11))] == [1, 1, 1] and len(got) == 8
    assert near_join.keep_one(docs.limit(0), 5, 80).count() == 0


def test_shifted_unbroken_passages_share_hashes(spark):
    rng = random.Random(4)
    base64, han = ["".join(rng.choice(of) for _ in range(n)) for of, n in (
        ("ABCDEFGHabcdefgh0123456789+/", 2000), ([chr(0x4E00 + i) for i in range(2000)], 40))]
    rows = [(i, f"{'q' * i}{passage}", f"{passage}zz") for passage in (base64, han) for i in range(1, 9)]
    rows.append((0, "p " + han[3:15], han))  # PART + K + WINDOW - 2 characters
    alike = fingerprints.likeness(*[fingerprints.hashes(fingerprints.select(F.col(c))) for c in "ab"])
    got = spark.createDataFrame(rows, "i int, a string, b string").select("i", alike.alias("x")).collect()
    assert all(r.x > 0.5 for r in got if r.i) and all(r.x > 0 for r in got)
