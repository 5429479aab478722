"""Substring dedup: passages of WINDOW words that a document with a smaller id has already, by super-k-mer partitioning.

The minimiser of a window is the least hash of its runs of RUN words. Consecutive windows with one minimiser are a
super-k-mer: they travel as one packed string of their words to the bucket of the minimiser, where sorting their windows
finds the first owner of each exactly.

* A window that two documents have has one minimiser in both. A first pass sends minimisers only (one number for about
  five windows); strings are made only where the bounded bit table of the minimisers of several documents allows it. A
  full table lets more strings travel and loses none.
* A string travels once: those of a minimiser with up to HOT of them, copies counted, go straight to its bucket. Of other
  minimisers equal strings meet first, map side combined, so copies and passages that very many documents share are a few
  strings. A minimiser with more than HOT different strings (the edges of a common passage) is not given to one bucket:
  its windows are grouped by their words instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import BROADCAST_IDS, FILTER_BITS, bit_table, filled, possibly_in, stored, with_group
from .near_join import mixed

#: Words of a window and of the runs that are its minimisers; most windows of one super-k-mer.
WINDOW, RUN, LONGEST = 13, 5, 64
#: Strings of one minimiser that go to one bucket as they are, or once equal ones have met; strings to a bucket on average; texts handled at once.
HOT, BUCKET_STRINGS, ROWS = 1000, 20_000, 64

U = np.uint64
_FACTOR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], U)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more than texts)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    if not len(starts):
        return np.zeros(0, U), bounds
    length = ends - starts
    power = np.ones(int(length.max()), U)
    power[1:] = _FACTOR[0]
    power = np.multiply.accumulate(power)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    return mixed(np.add.reduceat((data[inside].astype(U) + U(1)) * power[place], first) + length.astype(U) * _FACTOR[1]), bounds


def super_kmers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window in it, number of windows, and minimiser (as a long) of every super-k-mer."""
    words, bounds = hashed_words(texts)
    runs = np.zeros(max(0, len(words) - RUN + 1), U)
    for i in range(RUN):
        runs = runs * _FACTOR[2] + words[i:len(words) - RUN + 1 + i]
    runs = mixed(runs)
    # Least of the WINDOW - RUN + 1 runs of each window, by doubling.
    least, span, wanted = runs, 1, WINDOW - RUN + 1
    while span < wanted:
        step = min(span, wanted - span)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        span += step
    counts = np.maximum(bounds[1:] - bounds[:-1] - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    value = least[bounds[:-1][text] + within] if len(text) else np.zeros(0, U)
    opens = np.ones(len(text), bool)
    opens[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(opens)
    since = np.arange(len(text)) - np.repeat(at, np.diff(np.append(at, len(text))))
    at = np.flatnonzero(since % LONGEST == 0)
    return text[at], within[at], np.diff(np.append(at, len(text))), value[at].view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, [t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]


def minimisers(rows: DataFrame) -> DataFrame:
    """rank, minimiser of every super-k-mer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(batches):
            text, _, _, value = super_kmers(texts)
            yield pa.RecordBatch.from_arrays([part.column("rank").take(pa.array(text)), pa.array(value)],
                                             names=["rank", "minimiser"])

    return rows.select("rank", "text").mapInArrow(run, "rank long, minimiser long")


def strings(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """rank, of, start, minimiser, words (a packed string) of the super-k-mers whose minimiser is in the bit table."""
    table = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(batches):
            text, start, count, value = super_kmers(texts)
            cell = value & (len(table.value) * 64 - 1)
            hit = np.flatnonzero((table.value[cell >> 6] >> (cell & 63)) & 1)
            packed, held, words = [], -1, []
            for t, a, n in zip(text[hit].tolist(), start[hit].tolist(), count[hit].tolist()):
                if t != held:
                    held, words = t, texts[t].split()
                packed.append(b" ".join(words[a:a + n + WINDOW - 1]))
            take = pa.array(text[hit])
            yield pa.RecordBatch.from_arrays(
                [part.column("rank").take(take), part.column("of").take(take), pa.array(start[hit]), pa.array(value[hit]),
                 pa.array(packed, pa.binary())], names=["rank", "of", "start", "minimiser", "words"])

    return rows.select("rank", "of", "text").mapInArrow(run, "rank long, of long, start long, minimiser long, words binary")


def _windows(packed: bytes) -> list[bytes]:
    words = packed.split(b" ")
    return [b" ".join(words[i:i + WINDOW]) for i in range(len(words) - WINDOW + 1)]


def sorted_owners(bucket: pd.DataFrame) -> pd.DataFrame:
    """minimiser, code, low, high, owner: the least rank that has each window, as stretches of the strings of a bucket."""
    bucket = bucket.groupby(["minimiser", "code", "words"], sort=False).agg({"first": "min", "last": "max"}).reset_index()
    ranks, packed = bucket["first"].tolist(), bucket["words"].tolist()
    windows = [(w, s, i) for s, p in enumerate(packed) for i, w in enumerate(_windows(p))]
    windows.sort()
    owners: list[list[int]] = [[] for _ in packed]
    for s, p in enumerate(packed):
        owners[s] = [0] * (p.count(b" ") + 2 - WINDOW)
    at = 0
    while at < len(windows):
        end = at
        while end < len(windows) and windows[end][0] == windows[at][0]:
            end += 1
        least = min(ranks[s] for _, s, _ in windows[at:end])
        for _, s, i in windows[at:end]:
            owners[s][i] = least
        at = end
    out = []
    for minimiser, code, last, mine in zip(bucket["minimiser"].tolist(), bucket["code"].tolist(), bucket["last"].tolist(), owners):
        low = 0
        for i in range(1, len(mine) + 1):
            if i == len(mine) or mine[i] != mine[low]:
                if mine[low] < last:  # some document with these words comes after the owner
                    out.append((minimiser, code, low, i - 1, mine[low]))
                low = i
    return pd.DataFrame(out, columns=["minimiser", "code", "low", "high", "owner"], dtype="int64")


OWNERS = "minimiser long, code long, low long, high long, owner long"


def _hot_owners(hot: DataFrame) -> DataFrame:
    """The same for strings whose minimiser has too many of them for a bucket: grouped by the words of each window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, place, window = [], [], []
            for r, p in enumerate(batch.column("words").to_pylist()):
                each = _windows(p)
                at += [r] * len(each)
                place += range(len(each))
                window += each
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(take) for c in ("minimiser", "code", "first", "last")], pa.array(place, pa.int64()),
                 pa.array(window, pa.binary())], names=["minimiser", "code", "first", "last", "low", "window"])

    spread = hot.select("minimiser", "code", "first", "last", "words").mapInArrow(
        run, "minimiser long, code long, first long, last long, low long, window binary")
    return with_group(spread, "window", {"owner": ("min", F.col("first"))}).filter("owner < last").select(
        "minimiser", "code", "low", F.col("low").alias("high"), "owner")


def removals(rows: DataFrame, filter_bits: int = FILTER_BITS, hot: int = HOT) -> DataFrame:
    """rank, of, low, high: stretches of words that go, for rows of rank, of, text."""
    spark = rows.sparkSession
    shared = minimisers(rows).groupBy("minimiser").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).filter("a < b")
    words = bit_table(shared, F.col("minimiser"), filter_bits).toArrow()  # bounded by the table's bits
    bits = np.zeros(filter_bits // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    found = stored(strings(rows, bits).withColumn("code", F.xxhash64("words")))
    # What tells frequent and hot minimisers from others needs no words.
    many = found.groupBy("minimiser", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("minimiser").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("strings"))
    many = durable(many.filter(F.col("n") > hot).select("minimiser", "strings"))
    flagged = possibly_in(found, F.col("minimiser"), bit_table(many, F.col("minimiser"), filter_bits), filter_bits)
    rare = flagged.filter("not maybe").select("minimiser", "code", "words", F.col("rank").alias("first"), F.col("rank").alias("last"))
    each = flagged.filter("maybe").groupBy("minimiser", "code", "words").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    hottest = many.filter(F.col("strings") > hot).select("minimiser")
    few = hottest.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    hottest = F.broadcast(hottest) if few else hottest
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // BUCKET_STRINGS))
    bucket = F.pmod(F.xxhash64("minimiser"), F.lit(buckets)).alias("bucket")
    owners = rare.unionByName(each.join(hottest, "minimiser", "left_anti")).groupBy(bucket).applyInPandas(sorted_owners, OWNERS)
    owners = durable(owners.unionByName(_hot_owners(each.join(hottest, "minimiser", "left_semi"))))
    # Back to the places of each string; a string that very many documents have is met once per salt.
    key = ["minimiser", "code", "salt"]
    placed = possibly_in(found, F.col("code"), bit_table(owners, F.col("code"), filter_bits), filter_bits).filter("maybe").select(
        "rank", "of", "start", "minimiser", "code", F.pmod(F.xxhash64("rank", "of"), F.lit(64)).alias("salt"))
    salts = placed.select(*key).distinct().join(owners, ["minimiser", "code"])
    return placed.join(salts, key).filter("owner < rank").select(
        "rank", "of", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high") + WINDOW - 1).alias("high"))


def _kept(words: list[bytes], gone: list[dict] | None) -> list[bytes]:
    mark = np.zeros(len(words) + 1, np.int64)
    for stretch in gone or ():
        mark[stretch["low"]] += 1
        mark[stretch["high"] + 1] -= 1
    left = np.flatnonzero(np.cumsum(mark[:-1]) == 0)
    return words if len(left) == len(words) else [words[i] for i in left.tolist()]


def cleaned(docs: DataFrame, filter_bits: int = FILTER_BITS, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space) per row.

    Every word goes that is covered by a window of WINDOW words which also starts in a document with a smaller doc_id;
    windows are judged on the input. Null text has no words; texts of fewer than WINDOW words stay whole. A null doc_id
    counts as the largest: such rows lose what numbered documents have and take nothing from anyone. Rows with the same
    doc_id take nothing from each other; repeated rows come out as often as they went in. Other columns are not read. An
    empty table gives an empty result.
    """
    text = filled("text")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("rank"),
                       F.xxhash64(text).alias("of"), text.alias("text"))
    gone = removals(rows.select("rank", "of", "text"), filter_bits, hot)
    gone = durable(gone.groupBy("rank", "of").agg(F.collect_set(F.struct("low", "high")).alias("gone")))
    where = F.xxhash64("rank", "of")
    flagged = possibly_in(rows, where, bit_table(gone, where))
    # Only rows that may lose words are shuffled to meet what they lose.
    met = flagged.filter("maybe").join(gone, ["rank", "of"], "left").select("doc_id", "text", "gone")
    untouched = flagged.filter("not maybe").select("doc_id", "text", F.lit(None).cast(met.schema["gone"].dataType).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n_words, n_removed, texts = [], [], []
                for t, lost in zip(part.column("text").to_pylist(), part.column("gone").to_pylist()):
                    words = t.encode("utf-8", "surrogatepass").split()
                    left = _kept(words, lost)
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    texts.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts)],
                    names=["doc_id", "n_words", "n_removed", "kept_text"])

    kind = dict(docs.dtypes)["doc_id"]
    return untouched.unionByName(met).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_text string")
