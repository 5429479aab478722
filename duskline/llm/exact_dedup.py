"""Exact dedup: two-pass Bloom filtering, so that only possibly repeated texts are shuffled.

Pass one hashes every text to one cell of a bit table and counts rows per cell; cells hit more than once form the
filter of possibly repeated hashes, packed 64 bits to a word. The filter has a fixed number of bits, so its size is
bounded whatever the input, and it is broadcast. Pass two tests each row against it: rows outside are certainly unique
and pass straight through; the others are grouped by their digest. A small filter never loses a copy: it only lets
more unique rows into the grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import ascii_lower, filled, packed, resolved, with_group

#: Bits of the filter: 2^25 is 524,288 words of 8 bytes (4 MB of bits) at most; raise it with the executors' memory.
FILTER_BITS = 1 << 25
#: Repeats of one row that are unfolded at once.
CHUNK = 1 << 16


def digest(text: Column | str) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(ascii_lower(filled(text)), 256)


def possibly_repeated(hashed: DataFrame, key: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Flag ``_maybe``: false only for rows whose key no other row has. The broadcast filter is bounded by its bits."""
    cell = F.pmod(F.xxhash64(key), F.lit(filter_bits))
    counted = hashed.select(cell.alias("_cell")).groupBy("_cell").count().filter("count > 1")
    words = counted.groupBy((F.col("_cell").bitwiseAND(F.lit(~63)) / 64).cast("long").alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_cell") % 64).cast("int"))).alias("_bits"))
    tested = hashed.withColumn("_word_of", F.shiftright(cell, 6)).withColumn("_bit", (cell % 64).cast("int"))
    return (tested.join(F.broadcast(words), F.col("_word_of") == F.col("_word"), "left")
            .withColumn("_maybe", F.coalesce(
                F.call_function("shiftright", F.col("_bits"), F.col("_bit")).bitwiseAND(F.lit(1)) == 1, F.lit(False)))
            .drop("_word_of", "_bit", "_word", "_bits"))


def together(flagged: DataFrame) -> DataFrame:
    """text_sha256, doc_id, _rows, keep_id, group_size of the possibly repeated rows."""
    met = flagged.filter("_maybe").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    return with_group(met, "text_sha256", {"keep_id": ("max", F.col("doc_id")), "group_size": ("sum", F.col("_rows"))})


def dedup(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and copy for every row.

    Texts are equal when identical after lower-casing A-Z. Null text counts as empty, and all empty texts are one
    group. Of each group the row with the largest doc_id stays (a null doc_id is smaller than any number; if all are
    null, one of those rows stays). Rows repeating the same doc_id and text are numbered by ``copy`` from 1 and only
    copy 1 can stay. An empty table gives an empty result.
    """
    # Ids and digests are written once: every later step reads these instead of the texts.
    hashed = durable(docs.select(F.col("doc_id"), digest("text").alias("text_sha256")))
    flagged = possibly_repeated(hashed, "text_sha256", filter_bits)
    single = flagged.filter(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", F.lit(1).cast("long").alias("copy"))
    one, grouped = F.lit(1).cast("long"), together(flagged)
    grouped = grouped.withColumn("_from", F.explode(F.sequence(one, F.col("_rows"), F.lit(CHUNK).cast("long"))))
    repeated = (grouped.withColumn("copy", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK - 1, "_rows"))))
                .select("doc_id", "keep_id", "group_size",
                        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                        "text_sha256", "copy"))
    return single.unionByName(repeated)


def drop_copies(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows that stay, with all columns of the input, which may have any names.

    Rows are told apart by doc_id and digest, so nulls and repeated ids are no special case; of rows alike in both one
    stays. Rows that no copy touches are not shuffled.
    """
    rows = packed(docs).withColumn("text_sha256", digest("text"))
    hashed = durable(rows.select("doc_id", "text_sha256"))
    met = together(possibly_repeated(hashed, "text_sha256", filter_bits))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    touched = durable(met.select("doc_id", "text_sha256", "_rows", stays.alias("stays")).filter("not stays or _rows > 1"))
    return resolved(rows, touched, "text_sha256")
