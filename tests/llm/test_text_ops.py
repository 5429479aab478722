"""Fingerprints, personal data, chat, licenses, pieces and classifiers against brute force, round trips and accuracy."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from duskline.llm import chat, fingerprints, language, licenses, pieces, pii, quality
from duskline.llm.queries import piece_model


# -- fingerprints ---------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^\x20\x09-\x0D]{1,8}")


def winnow(text, hashes):
    a = [hashes[t] for t in TOKEN.findall(text)]
    if len(a) < fingerprints.K:
        return None
    for i in range(fingerprints.K.bit_length() - 1):
        m = 1 << i
        a = [(a[j] * fingerprints.MULTIPLIERS[i] + a[j + m]) % fingerprints.PRIME for j in range(len(a) - m)]
    w = fingerprints.WINDOW
    spans = [(0, len(a))] if len(a) < w else [(s, s + w) for s in range(len(a) - w + 1)]
    chosen = []
    for s, e in spans:
        least = min(a[s:e])
        at = max(j for j in range(s, e) if a[j] == least)
        if not chosen or chosen[-1][0] != at + 1:
            chosen.append((at + 1, least))
    return chosen


@pytest.mark.parametrize("piece", [8192, 64])
def test_fingerprints_by_brute_force(spark, sf, monkeypatch, piece):
    monkeypatch.setattr(fingerprints, "PIECE", piece)
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    edited = [t[:len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][:len(t) // 4] for i, t in enumerate(texts)]
    tokens = sorted({w for t in texts + edited for w in TOKEN.findall(t)})
    hashed = spark.createDataFrame([(t,) for t in tokens], "t string").select(
        "t", F.pmod(F.xxhash64("t"), F.lit(fingerprints.PRIME)).alias("h"))
    hashes = {r.t: r.h for r in hashed.collect()}
    got = fingerprints.compare_neighbours(docs).orderBy("doc_id").collect()

    def digest(c):
        return hashlib.sha256(",".join(f"{h}:{p}" for p, h in c).encode()).hexdigest()

    for i, r in enumerate(got):
        own, new, near = winnow(texts[i], hashes), winnow(edited[i], hashes), winnow(texts[(i + 1) % len(texts)], hashes)
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest()
        if own and new and near:
            assert (r.fingerprint, r.edited_fingerprint, r.n_hashes) == (digest(own), digest(new), len(own))
            a, b, c = ({h for _, h in x} for x in (own, new, near))
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 1e-12
            assert abs(r.near_next - len(a & c) / len(a | c)) < 1e-12


def test_fingerprints_of_odd_rows(odd_rows):
    got = fingerprints.compare_neighbours(odd_rows).collect()
    assert len(got) == odd_rows.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (3, 4)}) == 1
    assert len({r.fingerprint for r in got if r.doc_id == 6 or r.doc_id == 1}) == 1
    one = fingerprints.compare_neighbours(odd_rows.filter("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.compare_neighbours(odd_rows.limit(0)).count() == 0


# -- personal data --------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in match.split(".")),
            "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


CASES = ["a@b.c_x@d.org", "a@b.com@d.org y@z", "1.2.3.4.5 256.1.1.1 001.2.3.0255 1.2.3.999",
         "4111 1111 1111 1111 5 4111-1111-1111-1111", "call +1 (017) 555-7713 and +49.", "4111 1111 1111 1111",
         "😀é a@b.de iban DE89 3704 0044 0532 0130 00 x", "1" * 9000, "a" * 20000 + "@x", "+1" + "-" * 5000 + "2"]


def test_base_spans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([None, *CASES])], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for d in docs.collect():
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, d.text or "")
                 if passes(k, m.group())]
        assert got[d.doc_id].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), d.doc_id
        assert got[d.doc_id].spans.startswith(",".join(spans))


def test_further_kinds_and_context(spark):
    rows = spark.createDataFrame([(1, "GB82WEST12345698765432"), (2, "GB83WEST12345698765432"), (3, "ssn 123-45-6789"),
                                  (4, "part 123-45-6789"), (5, "card 4111111111111111"), (6, "x 4111111111111111")],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(rows).collect()}
    assert [got[i].spans for i in range(1, 5)] == ["iban:0:22", "", "ssn:4:15", ""]
    assert got[5].top_score > got[6].top_score


def test_pii_of_many_matches(spark):
    """Places and context in a text of very many matches, over the borders of chunks; the work grows with the text."""
    import time

    line = "ü mail a{0}@b{0}.org, call +49 30 1234567{0} or 10.0.0.{1} "
    text = "".join(line.format(i, i % 300) for i in range(700))
    got = pii.find(spark.createDataFrame([(text,)], "text string")).first()
    for kind, pattern in (("email", r"a[0-9]+@b[0-9]+[.]org"), ("ip", r"10[.]0[.]0[.](25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9])")):
        assert [(s.start, s.end) for s in got[f"pii_{kind}"]] == [m.span() for m in re.finditer(pattern, text)]
    assert {round(s.score, 3) for s in got["pii_email"]} == {1.0}
    long = spark.createDataFrame([("x@y.zz " * 40_000,)], "text string")
    began = time.monotonic()
    assert pii.find(long).selectExpr("size(pii_email)").first()[0] == 40_000
    assert time.monotonic() - began < 60


def test_pii_odd_rows(odd_rows):
    assert pii.report(odd_rows).count() == odd_rows.count() and pii.report(odd_rows.limit(0)).count() == 0


# -- chat -----------------------------------------------------------------------------------------------------------

def test_rotation_rebuilds_the_dialogue(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "Bye"),
             (1, 3, "ann", "Bye"), (2, 0, None, "who"), (2, None, "  ", ""), (3, 0, "system", "only")]
    got = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob"), (2, "unknown")}
    for key in {(r.conv_id, r.perspective) for r in got}:
        rows = sorted((r for r in got if (r.conv_id, r.perspective) == key), key=lambda r: r.start)
        text = "".join(r.message for r in rows)
        for r in rows:
            assert text[r.start:].startswith(r.message)
            trained = text[r.train_start:r.train_end]
            if r.role == "assistant":
                assert r.speaker == key[1] and trained == r.message.split("\n", 1)[1]
            else:
                assert trained == ""
        assert text.count(chat.OPEN) == text.count(chat.CLOSE.strip()) == len(rows)
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# -- licenses -------------------------------------------------------------------------------------------------------

def test_license_scan(spark, sf):
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
             "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for d in docs.collect():
        want = {n for line, n in lines.items() if line in d.text}
        assert set(filter(None, got[d.doc_id].licenses.split(","))) == want
        for span in filter(None, got[d.doc_id].spans.split(",")):
            name, a, b = span.split(":")
            assert lines[d.text[int(a):int(b)] + "."] == name


def test_long_license_with_changes(spark, odd_rows):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    changed = mit.replace("free of charge", "gratis", 1)
    other = mit.replace("software", "thing")
    rows = spark.createDataFrame([(1, "some words " * 50 + mit + " more" * 50), (2, changed), (3, other)],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert got[1].licenses == got[2].licenses == "MIT" and got[1].differences == "" and got[3].licenses == ""
    assert got[2].differences == "+gratis -free of charge"
    assert licenses.scan(odd_rows).count() == odd_rows.count() and licenses.scan(odd_rows.limit(0)).count() == 0


# -- pieces ---------------------------------------------------------------------------------------------------------

TEXTS = ["", "a", " a", "a  b", "héllo ☃ 😀\n\tx", "日本語テキスト", "  ", "x" * 50, "\x00\x01", "The end. "]


def test_unigram_equals_the_library(spark, sf):
    """The library's unigram mode over the same pieces. It adds scores in single precision, so the marker runs' extreme
    scores are raised for both."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(piece_model())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    own = pieces.Unigram(model.SerializeToString())
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ids = own.encode(texts)
    assert [list(i) for i in ids] == library.encode(texts)
    assert [own.decode(i) for i in ids] == texts


def test_tokenise_round_trip(odd_rows):
    got = pieces.tokenise(odd_rows, piece_model()).collect()
    assert len(got) == odd_rows.count() and all(r.round_trip for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4)} == {0}
    assert pieces.tokenise(odd_rows.limit(0), piece_model()).count() == 0


# -- classifiers ----------------------------------------------------------------------------------------------------

def test_language_accuracy_held_out(spark, sf, odd_rows):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    odd = language.identify(odd_rows).collect()
    assert len(odd) == odd_rows.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in odd if r.doc_id in (3, 4, 5, 10))
    assert language.identify(odd_rows.limit(0)).count() == 0
    assert language.keep_identified(odd_rows).columns == odd_rows.columns


def test_quality_accuracy_held_out(spark, sf, odd_rows):
    folder = sf.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.rate(docs, labels)
    assert got.count() == docs.count() and got.filter("score < 0 or score > 1").count() == 0
    held = got.filter("held_out").join(labels, "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.9
    assert quality.rate(odd_rows, labels.limit(0)).filter("score = 0.5").count() == odd_rows.count()
    assert quality.rate(odd_rows.limit(0), labels).count() == 0
