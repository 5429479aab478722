"""Compressed sizes of texts against zstandard raw-content dictionaries, shared by the compression classifiers."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import rank_limit

#: Texts are compressed in blocks of so many bytes, so that a long text keeps meeting the dictionary.
BLOCK, LEVEL = 4096, 6
#: Candidates drawn per wanted text, so that copies can be left out; how many times as many pass the hash threshold
#: before they are ranked, so that what meets in one task does not grow with the input.
SPARE, PASSING = 4, 4
_SPACE = 1 << 30


def compressors(dictionaries: Mapping[str, bytes], level: int = LEVEL) -> dict[str, zstandard.ZstdCompressor]:
    made = {}
    for name, content in dictionaries.items():
        # An empty dictionary is not allowed; one of a space is worth nothing.
        known = zstandard.ZstdCompressionDict(content if len(content) >= 8 else b" " * 8,
                                              dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        made[name] = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False,
                                              write_checksum=False, write_dict_id=False)
    return made


def compressed_sizes(data: bytes, made: Mapping[str, zstandard.ZstdCompressor], block: int = BLOCK) -> dict[str, int]:
    """Bytes of the whole text against each dictionary."""
    total = dict.fromkeys(made, 0)
    for at in range(0, max(1, len(data)), block):
        part = data[at:at + block]
        for name, one in made.items():
            total[name] += len(one.compress(part))
    return total


def thinned(rows: DataFrame, group: Column, by: Column, counts: Mapping[str, int], wanted: int) -> DataFrame:
    """About PASSING * wanted rows of each group (all of a small one): those whose hash is below a threshold.

    ``counts``: rows of each group, one entry per label or language. Adds the hash as ``_h``.
    """
    share = {g: min(_SPACE, math.ceil(_SPACE * PASSING * wanted / n)) for g, n in counts.items() if n}
    if not share:
        return rows.withColumn("_h", by).limit(0)
    below = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    return rows.withColumn("_h", F.pmod(by, F.lit(_SPACE))).filter(F.col("_h") < F.try_element_at(below, group))


def sample(rows: DataFrame, group: str, text: str, per_group: int, chars: int, counts: Mapping[str, int],
           copies: bool = False) -> dict[str, list[str]]:
    """Up to ``per_group`` different texts of each group, cut to ``chars`` code points: the bounded training sample.

    Texts are taken in the order of a hash of what is kept of them, so the choice is the same in every run. ``counts``:
    rows of each group, or with ``copies`` its different cut texts (see ``different``): then copies become one row
    before they are ranked, and a group with fewer texts than wanted gives all of them.
    """
    cut = F.substring(text, 1, chars)
    rows = rows.select(F.col(group).alias("_group"), cut.alias("_cut"))
    rows = thinned(rows, F.col("_group"), F.xxhash64("_cut"), counts, SPARE * per_group)
    if copies:
        rows = rows.groupBy("_group", F.xxhash64("_cut").alias("_key")).agg(F.min("_h").alias("_h"),
                                                                            F.min("_cut").alias("_cut"))
    first = rank_limit(rows, ["_group"], [F.col("_h"), F.col("_cut")], SPARE * per_group).select("_group", "_h", "_cut")
    found: dict[str, dict[str, None]] = {}
    for row in first.orderBy("_group", "_h", "_cut").toLocalIterator():
        kept = found.setdefault(row["_group"], {})
        if len(kept) < per_group:
            kept.setdefault(row["_cut"])
    return {name: list(texts) for name, texts in sorted(found.items(), key=lambda x: str(x[0]))}


def different(rows: DataFrame, group: str, text: str, chars: int) -> tuple[dict[str, int], dict[str, int]]:
    """Rows of each group, and its different texts after the cut, told apart by hash: only hashes are shuffled."""
    known = rows.groupBy(F.col(group).alias("_group"), F.xxhash64(F.substring(text, 1, chars)).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"))
    per = known.groupBy("_group").agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("texts")).collect()
    return {r["_group"]: r["rows"] for r in per}, {r["_group"]: r["texts"] for r in per}


def joined(texts: Sequence[str], limit: int) -> bytes:
    """One dictionary of the texts, the last ``limit`` bytes."""
    return "\n".join(texts).encode("utf-8", "replace")[-limit:]


def each_text(batches: Iterator, column: str = "text") -> Iterator[tuple[object, list[str]]]:
    """Arrow batches with their texts, null as empty."""
    for batch in batches:
        yield batch, [t or "" for t in batch.column(column).to_pylist()]
