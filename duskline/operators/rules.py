"""Data-quality rules: split rows into clean ones and violations instead of failing a whole job for one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ATTRIBUTE, IDENTIFIER, TOKEN

MAX_TIMESTAMP_MS = 253_402_300_799_999


class Checked(NamedTuple):
    clean: DataFrame
    violations: DataFrame


class RuleViolation(ValueError):
    """Raised in strict mode when a table breaks its rules."""


def check(df: DataFrame, rules: Mapping[str, Column], key: Sequence[str], strict: bool = False) -> Checked:
    """``rules``: name -> condition that must hold (NULL counts as broken). Violations are (key, rule) rows."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    tagged = df.withColumn("_broken", broken)
    bad = tagged.filter(F.size("_broken") > 0).select(*key, F.explode("_broken").alias("rule"))
    if strict and not bad.isEmpty():
        raise RuleViolation("input breaks its data rules")
    return Checked(tagged.filter(F.size("_broken") == 0).drop("_broken"), bad)


def capacity(df: DataFrame, key: Sequence[str], most: int) -> DataFrame:
    """Keys holding more rows than allowed; counted with partial sums before the shuffle."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)


def without(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def duplicates(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return capacity(df, on, 1)


def digest(df: DataFrame, exclude: Sequence[str] = ()) -> Column:
    """Content digest of a row over its columns in name order."""
    cols = sorted(c for c in df.columns if c not in exclude)
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def _between(c: str, lo, hi) -> Column:
    return F.col(c).between(lo, hi)


def observation_rules() -> dict[str, Column]:
    return {
        "timestamp": _between("timestamp_ms", 0, MAX_TIMESTAMP_MS),
        "track_id": F.col("track_id").rlike(IDENTIFIER),
        "posture": F.col("posture").isin("upright", "down", "other", "unknown"),
        "confidence": _between("confidence", 0.0, 1.0),
    }


def detection_rules() -> dict[str, Column]:
    c = [F.col(x) for x in ("x_min", "y_min", "x_max", "y_max")]
    return {
        "category": F.length(F.trim("category")).between(1, 64),
        "confidence": _between("confidence", 0.0, 1.0),
        "box_range": (c[0] >= 0) & (c[1] >= 0) & (c[2] <= 1) & (c[3] <= 1),
        "box_area": (c[2] > c[0]) & (c[3] > c[1]),
        "frame_index": F.col("frame_index") >= 0,
    }


def record_rules() -> dict[str, Column]:
    plate = F.col("plate_text")
    keys = F.transform("attributes", lambda a: F.struct(a["name"], a["value"], a["provenance"]))
    return {
        "observation_id": F.col("observation_id").rlike(TOKEN), "source_id": F.col("source_id").rlike(TOKEN),
        "timestamp": _between("timestamp_ms", 0, MAX_TIMESTAMP_MS),
        "category": F.col("category").rlike(ATTRIBUTE), "confidence": _between("confidence", 0.0, 1.0),
        "track_id": F.col("track_id").isNull() | F.col("track_id").rlike(TOKEN),
        "plate_text": plate.isNull() | plate.rlike("^[A-Z0-9]{1,16}\\z"),
        "plate_category": plate.isNull() | (F.col("category") == "license_plate"),
        "attribute_count": F.size("attributes") <= 64,
        "attributes_unique": F.size(F.array_distinct(keys)) == F.size("attributes"),
    }
