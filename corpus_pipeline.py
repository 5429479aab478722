"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``docs``. Near-duplicates are five-word shingles with a similarity of 0.8 or more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline.llm import exact_dedup, language, mixing, near_join, pieces
from duskline.llm.queries import piece_model
from duskline.session import ensure_checkpoint_dir

#: The stages include models and hash draws that SQL cannot express; tests/llm holds them against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language the classifier rejects (no letter, or no clear margin)."""
    return language.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of linked texts."""
    return near_join.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights: texts come out once per pass that takes words of them."""
    return mixing.mixed_texts(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, the piece ids of every text, their number, and whether decoding gives the text back."""
    model = piece_model()
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       *[F.col(c).alias(n) for c, n in names.items()])
    done = pieces.there_and_back(rows, model)

    def free(name: str) -> str:
        return name if name not in docs.columns else free(name + "_")

    back = F.col("decoded") == F.replace("text", F.lit(pieces.MARK), F.lit(" "))
    return done.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns], F.col("tokens").alias(free("tokens")),
                       F.size("tokens").cast("long").alias(free("n_tokens")), back.alias(free("round_trip")))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("sentencepiece", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
