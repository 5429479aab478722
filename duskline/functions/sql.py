"""The scalar rules as SQL functions, for use from ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Names and bodies of temporary SQL functions; they inline into the plan, so nothing runs row by row in Python.
FUNCTIONS = {
    "box_iou(ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double)": (
        "double", """case when least(ax2, bx2) <= greatest(ax1, bx1) or least(ay2, by2) <= greatest(ay1, by1) then 0D
        else (least(ax2, bx2) - greatest(ax1, bx1)) * (least(ay2, by2) - greatest(ay1, by1))
        / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1)
           - (least(ax2, bx2) - greatest(ax1, bx1)) * (least(ay2, by2) - greatest(ay1, by1))) end"""),
    "plate_text(raw string)": (
        "string", """case when raw rlike '^[A-Za-z0-9 -]*\\\\z' and length(translate(raw, ' -', '')) <= 16
        then upper(translate(raw, ' -', '')) end"""),
    "read_errors(expected string, observed string)": ("int", "levenshtein(expected, coalesce(observed, ''))"),
}


def register(spark: SparkSession) -> None:
    for signature, (returns, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {signature} returns {returns} return {body}")
