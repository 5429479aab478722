"""Language ID by compression: the language whose dictionary packs the text smallest.

Each language has a zstandard raw-content dictionary made of a bounded sample of its labelled texts. The whole text is
compressed against each; how common a language is among the labelled texts adds a few bits, which decides texts too
short to tell. Narrow margins are marked as rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from . import compression
from .common import filled, widened

#: The training sample: texts per language, code points of each, bytes of a dictionary.
TEXTS, CHARS, DICTIONARY = 96, 1500, 112_000
#: Relative margin below which a prediction is rejected, and the one at which the score is 1 - 1/e.
REJECT, SCALE = 0.002, 0.03
UNDETERMINED = "und"


def held_out(doc_id: Column | str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves ``fold``; a null id is in no fold and never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


@dataclass(frozen=True)
class Languages:
    dictionaries: dict[str, bytes]
    prior_bits: dict[str, float]  # -log2 of each language's share of the labelled texts


def train(docs: DataFrame, texts: int = TEXTS, chars: int = CHARS, limit: int = DICTIONARY) -> Languages:
    """A dictionary per non-null language, from texts with a letter. Empty if nothing is labelled."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts, distinct = compression.different(rows, "lang", "text", chars)
    found = compression.sample(rows, "lang", "text", texts, chars, distinct, copies=True)
    total = sum(counts.values())
    return Languages({lang: compression.joined([t.lower() for t in of], limit) for lang, of in found.items()},
                     {lang: -math.log2(counts[lang] / total) for lang in found})


def judge(text: str, made: dict, prior_bits: dict[str, float]) -> tuple[str, float, float, bool]:
    """Language, score, relative margin over the runner-up, rejected."""
    if not made or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, 0.0, True
    data = text.lower().encode("utf-8", "replace")
    order = sorted((8 * n + prior_bits[lang], lang) for lang, n in compression.compressed_sizes(data, made).items())
    margin = 1.0 if len(order) == 1 else (order[1][0] - order[0][0]) / order[1][0]
    return order[0][1], 1 - math.exp(-margin / SCALE), margin, margin < REJECT


def predict(docs: DataFrame, learned: Languages) -> DataFrame:
    """Add lang_pred, score (0 to 1), margin and rejected to every row, from nothing but the text.

    Null text and text without a letter are "und" with score 0, and rejected; so is everything if no language was
    learned. Of languages that come out equal the first by name is named, with margin 0, and rejected.
    The input must not have columns of these names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # languages x DICTIONARY bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, bits = compression.compressors(shared.value.dictionaries), shared.value.prior_bits
        for batch, texts in compression.each_text(batches):
            found = list(zip(*[judge(t, made, bits) for t in texts])) or [[], [], [], []]
            extra = [pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()),
                     pa.array(found[2], pa.float64()), pa.array(found[3], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[
                *batch.schema.names, "lang_pred", "score", "margin", "rejected"])

    more = {"lang_pred": StringType(), "score": DoubleType(), "margin": DoubleType(), "rejected": BooleanType()}
    return docs.mapInArrow(run, widened(docs.schema, more))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected for every whole text; learned from two of three folds.

    Repeated rows are judged each on its own, alike. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", "lang", held_out("doc_id", 3, 1).alias("held_out"))
    learned = train(rows.filter(F.col("doc_id").isNotNull() & ~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", filled("text").alias("text")), learned).drop("text")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told by a clear margin, with all their columns and their own labels."""
    learned = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1)))
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(F.col("text").cast("string").alias("text"), *[F.col(c).alias(n) for c, n in names.items()
                                                                   if c != "text"])
    kept = predict(inner, learned).filter(~F.col("rejected"))
    return kept.select(*[F.col("text" if c == "text" else n).alias(c) for c, n in names.items()])
