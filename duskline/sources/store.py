"""The durable record store: partitioned Parquet, idempotent appends, conflict reports and the integrity audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import digest
from ..session import durable

ID = "observation_id"


def with_date(records: DataFrame) -> DataFrame:
    return records.withColumn("event_date", F.to_date(F.timestamp_millis("timestamp_ms")))


def new_records(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows whose id the store does not hold; repeated identical rows count once."""
    return incoming.dropDuplicates([ID]).join(existing.select(ID), ID, "left_anti")


def conflicts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids that come with content other than the stored one, or with two contents in one batch."""
    d = digest(incoming)
    inc = incoming.select(ID, d.alias("digest"))
    stored = existing.select(incoming.columns).select(ID, d.alias("digest"))
    return inc.unionByName(stored.join(inc.select(ID).distinct(), ID, "left_semi")).groupBy(ID).agg(
        F.count_distinct("digest").alias("contents")).filter("contents > 1").select(ID)


def append(spark: SparkSession, incoming: DataFrame, path: str) -> DataFrame:
    """Add records once; what is kept out comes back as (observation_id, reason).

    ``no_id``: rows without an id. ``no_evidence``: rows without evidence, where there is such a column. ``conflict``: ids that come with other content than
    the stored one, or with two contents. The store is scanned once, for the digests of the incoming ids. Appending the same
    rows again, also after a run that died while writing, adds nothing twice.
    """
    lacks = F.when(F.col(ID).isNull(), "no_id")
    if "evidence" in incoming.columns:
        lacks = lacks.when(F.col("evidence").isNull(), "no_evidence")
    bare, incoming = incoming.select(ID, lacks.alias("reason")).filter("reason is not null"), incoming.filter(lacks.isNull())
    arrived = durable(incoming.select(ID, digest(incoming).alias("digest")).distinct())
    try:
        existing = spark.read.parquet(path).select(incoming.columns)
    except AnalysisException as error:  # the store does not exist yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        existing = spark.createDataFrame([], incoming.schema)
    held = durable(existing.select(ID, digest(existing).alias("digest")).join(arrived.select(ID).distinct(), ID, "left_semi"))
    clash = durable(arrived.unionByName(held).groupBy(ID).agg(F.count_distinct("digest").alias("contents")).filter(
        "contents > 1").select(ID))
    fresh = incoming.join(clash.unionByName(held.select(ID)), ID, "left_anti").dropDuplicates([ID])
    with_date(fresh).repartition("event_date", F.pmod(F.xxhash64(ID), F.lit(32))).sortWithinPartitions(
        "category", "source_id", "timestamp_ms").write.mode("append").partitionBy("event_date").parquet(path)
    return clash.withColumn("reason", F.lit("conflict")).unionByName(bare)


def flatten(records: DataFrame, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The relational form: records without attributes, and one row per attribute with a dense ordinal.

    ``carry``: columns of the record that its attributes keep, which spares a join.
    """
    attrs = records.select(ID, *carry, F.posexplode("attributes").alias("ordinal", "a")).select(ID, *carry, "ordinal", "a.*")
    return records.drop("attributes"), attrs


def audit(records: DataFrame, attributes: DataFrame, box: tuple[str, ...] = ("x_min", "y_min", "x_max", "y_max")) -> DataFrame:
    """(observation_id, problem): partial boxes, ordinals with holes, attributes without a record, loose text."""
    nulls = sum((F.col(c).isNull().cast("int") for c in box), F.lit(0)) if all(c in records.columns for c in box) else F.lit(0)
    partial = records.filter(nulls.between(1, 3)).select(ID, F.lit("partial_box").alias("problem"))
    # Ids hardly repeat within an input split, so rows are dealt out first: counting them before that would hold a split's ids.
    # Distinct ordinals are bits of 64 at a time.
    rows = attributes.select(ID, F.col("ordinal").cast("long").alias("ordinal"),
                             (F.col("value") != F.trim(F.regexp_replace("value", "\\s+", " "))).alias("loose")).repartition(ID)
    words = rows.groupBy(ID, F.shiftright("ordinal", 6).alias("word")).agg(
        F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count(F.lit(1)).alias("n"), F.max("loose").alias("loose"),
        F.bit_count(F.bit_or(F.expr("shiftleft(1L, cast(ordinal & 63 as int))"))).cast("long").alias("d"))
    per = words.groupBy(ID).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("d").alias("d"),
                                F.max("loose").alias("loose"))
    held = records.select(ID).repartition(ID).groupBy(ID).agg(F.count(F.lit(1)).alias("times"))
    both = per.join(held, ID, "full")
    problems = F.array_compact(F.array(
        F.when((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("d") != F.col("n")), "ordinal_holes"),
        F.when(F.col("times").isNull(), "orphan_attribute"), F.when(F.col("loose"), "text_not_canonical"),
        F.when(F.col("times") > 1, "repeated_id")))
    return partial.unionByName(both.select(ID, F.explode(problems).alias("problem")))
