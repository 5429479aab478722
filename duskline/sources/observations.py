"""Observation lines in, event lines out; batch and stream share the parsing."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import RuleViolation, observation_rules

MAX_LINE_BYTES = 16_384
#: One flat object and nothing else; strings may hold anything.
_ONE_OBJECT = r'^\s*+\{(?:[^"{}\[\]]|"(?:[^"\\]|\\.)*+")*+\}\s*+\z'
_TYPES = {"timestamp_ms": "long", "track_id": "string", "posture": "string", "confidence": "double"}


class Parsed(NamedTuple):
    rows: DataFrame
    quarantine: DataFrame


def parse_lines(lines: DataFrame, source_id: str, session_id: str) -> Parsed:
    """``value`` lines to observations. A line is refused when it is too long, not an object with exactly the four
    fields and nothing after it, or outside the observation rules. Blank lines are skipped."""
    raw = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    exact = F.array_sort(F.map_keys("_m")) == F.array(*[F.lit(c) for c in sorted(_TYPES)])
    m = F.col("_m")
    number = m["timestamp_ms"].rlike("^(0|[1-9][0-9]{0,14})\\z") & F.col("value").rlike(
        '"timestamp_ms"\\s*:\\s*[0-9]+\\s*[,}]') & F.col("value").rlike('"confidence"\\s*:\\s*[-+0-9.eE]+\\s*[,}]')
    fields = {c: F.expr(f"try_cast(_m['{c}'] as {t})") for c, t in _TYPES.items()}
    # A column read only when the conditions before it hold keeps bad text from raising.
    rows = (
        lines.filter(F.length(F.trim("value")) > 0).withColumn("_m", raw)
        .withColumns({**fields, "_long": F.octet_length("value") > MAX_LINE_BYTES}))
    reason: Column = (
        F.when(F.col("_long"), "too_long").when(m.isNull(), "not_an_object").when(~exact, "wrong_fields")
        .when(~F.coalesce(number, F.lit(False)), "wrong_types")
        .when(~F.col("value").rlike(_ONE_OBJECT), "not_one_object"))
    for name, ok in observation_rules().items():
        reason = reason.when(~F.coalesce(ok, F.lit(False)), name)
    tagged = rows.withColumn("reason", reason)
    good = tagged.filter("reason is null").select(
        F.lit(source_id).alias("source_id"), F.lit(session_id).alias("session_id"), *_TYPES)
    return Parsed(good, tagged.filter("reason is not null").select("reason", F.sha2("value", 256).alias("line_sha256")))


def read_observations(spark: SparkSession, path: str, source_id: str, session_id: str, strict: bool = False) -> Parsed:
    out = parse_lines(spark.read.text(path), source_id, session_id)
    if strict and not out.quarantine.isEmpty():
        raise RuleViolation("observation lines were refused")
    return out


def stream_observations(spark: SparkSession, path: str, source_id: str, session_id: str) -> Parsed:
    return parse_lines(spark.readStream.text(path), source_id, session_id)


def event_lines(events: DataFrame) -> DataFrame:
    """One JSON line per candidate event, keys in order at every level."""
    return events.select(F.to_json(sorted_struct(events, "event")).alias("value"))


def sorted_struct(df: DataFrame, name: str) -> Column:
    from pyspark.sql import types as T

    def arrange(col: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return F.struct(*[arrange(col[f.name], f.dataType).alias(f.name)
                              for f in sorted(t.fields, key=lambda f: f.name)])
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            return F.transform(col, lambda e: arrange(e, t.elementType))
        return col

    return arrange(F.col(name), df.schema[name].dataType)


def write_events(events: DataFrame, path: str) -> None:
    event_lines(events).write.mode("append").text(path)
