"""Quality by compression: dictionaries of good and bad labelled text, and a calibrated score.

A text is compressed against a zstandard raw-content dictionary of good texts and one of bad texts. The normalised
difference of the two sizes, with the share that is left at best (repetition shows there), goes through a logistic
curve fitted on labelled texts that are in neither dictionary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.scale import rank_limit
from . import compression
from .common import filled, widened
from .language import held_out

#: The training sample: texts per label, the share of them that calibrates, code points of each text that goes into a
#: dictionary, code points of a calibrating one, bytes of a dictionary.
TEXTS, CALIBRATING, DICT_CHARS, CHARS, DICTIONARY = 1000, 0.5, 800, 8_000, 400_000
#: Ids drawn per text wanted, since copies and ids without a document teach nothing.
DRAWN = 2
THRESHOLD = 0.3
GOOD, BAD = "1", "0"


@dataclass(frozen=True)
class Model:
    dictionaries: dict[str, bytes]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # the last is the intercept

    def score(self, text: str, made: dict) -> float:
        x = features(text, made)
        z = self.weights[-1] + sum(w * (v - c) / s for w, v, c, s in zip(self.weights, x, self.center, self.scale))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def features(text: str, made: dict) -> tuple[float, float]:
    """Normalised size difference (over 0: good packs it smaller), log of the share of bytes left at best."""
    data = text.encode("utf-8", "replace")
    size = compression.compressed_sizes(data, made)
    good, bad = size[GOOD], size[BAD]
    return (bad - good) / (bad + good), math.log(min(good, bad) / (len(data) + 16))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps; x has a column of ones at its end."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -60, 60)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(curve, x.T @ (weight * (y - p)) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def train(docs: DataFrame, told: DataFrame, texts: int = TEXTS) -> Model | None:
    """Fit on the texts of a bounded sample of each label. None if a label has no text.

    ``told``: doc_id, quality (0 or 1). Ids are drawn from it in the order of a hash, DRAWN times as many as texts are
    wanted, and only their texts are read from ``docs``, behind a broadcast of these ids. The sample is even between
    labels; weights bring back the labels' true shares, counted over all of ``told``.
    """
    told = told.select("doc_id", F.col("quality").cast("string").alias("quality"))
    share = {r["quality"]: r["count"] for r in told.groupBy("quality").count().collect()}
    told = compression.thinned(told, F.col("quality"), F.xxhash64("doc_id"), share, DRAWN * texts)
    drawn = rank_limit(told, ["quality"], [F.col("_h"), F.col("doc_id")], DRAWN * texts).drop("rank", "_h")
    rows = docs.select("doc_id", filled("text").alias("text")).join(F.broadcast(drawn), "doc_id")
    found = compression.sample(rows, "quality", "text", texts, CHARS, dict.fromkeys(share, DRAWN * texts))
    if not (found.get(GOOD) and found.get(BAD)):
        return None
    dictionaries, held = {}, []
    for label in (BAD, GOOD):
        of = found[label]
        n = max(1, round(len(of) * (1 - CALIBRATING)))
        dictionaries[label] = compression.joined([t[:DICT_CHARS] for t in of[:n]], DICTIONARY)
        held += [(t, label) for t in of[n:] or of]
    made = compression.compressors(dictionaries)
    x = np.array([features(t, made) for t, _ in held])
    y = np.array([label == GOOD for _, label in held], float)
    true = share[GOOD] / (share[GOOD] + share[BAD])
    weight = np.where(y == 1, true / max(y.mean(), 1e-9), (1 - true) / max(1 - y.mean(), 1e-9))
    center, scale = x.mean(0), x.std(0) + 1e-6
    b = logistic(np.c_[(x - center) / scale, np.ones(len(x))], y, weight)
    return Model(dictionaries, tuple(center), tuple(scale), tuple(b))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add ``score`` (0 to 1, higher: good is likelier) from nothing but the text, null as empty.

    Without a model (a label was never seen) every score is 0.5. The input must not have a column ``score``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        made = compression.compressors(fitted.dictionaries) if fitted else {}
        for batch, texts in compression.each_text(batches):
            scores = [fitted.score(t, made) if fitted else 0.5 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, widened(docs.schema, {"score": DoubleType()}))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text; learned from four of five folds of the labels.

    Label rows with null id or quality teach nothing; ids with conflicting labels count as bad. Repeated
    documents are scored each on its own, alike. An empty table gives an empty result.
    """
    told = (labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
            .withColumn("_held", held_out("doc_id", 5, 0)).filter(~F.col("_held")))
    model = train(docs, told)
    scored = score(docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), filled("text").alias("text")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
