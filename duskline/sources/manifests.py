"""Manifest, label-package and label-table sources, and the frame-completeness check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Checked, check, duplicates
from ..operators.scale import bucketed_lead

#: Missing frames unfolded at once.
STRETCH = 4096

_SAMPLE = ("sample_id string, site_id string, camera_id string, video_path string, start_timestamp_ms long, "
           "end_timestamp_ms long, authorization_ref string, media_sha256 string, "
           "labels array<struct<label_id:string,start_timestamp_ms:long,end_timestamp_ms:long>>")


def read_samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A validation manifest document as (samples, labels); unknown keys or repeated samples are refused."""
    raw = spark.read.text(path, wholetext=True)
    keys = F.map_keys(F.from_json("value", "map<string,string>"))
    doc = raw.withColumn("_k", keys).select(
        F.array_contains("_k", "samples").alias("ok"),
        F.from_json("value", f"struct<samples:array<struct<{_fields(_SAMPLE)}>>>").alias("d"),
        F.explode(F.from_json(F.get_json_object("value", "$.samples"), "array<map<string,string>>")).alias("s"))
    allowed = F.array(*[F.lit(p.strip().split(" ")[0]) for p in _SAMPLE.split(", ")])
    unknown = doc.filter(~F.col("ok") | (F.size(F.array_except(F.map_keys("s"), allowed)) > 0))
    samples = raw.select(F.explode(F.from_json(
        F.get_json_object("value", "$.samples"), f"array<struct<{_fields(_SAMPLE)}>>")).alias("s")).select("s.*")
    if not unknown.isEmpty() or not samples.groupBy("sample_id").count().filter("count > 1").isEmpty():
        raise ValueError("manifest has unknown keys or repeated samples")
    labels = samples.select("sample_id", F.explode("labels").alias("l")).select("sample_id", "l.*")
    return samples.drop("labels"), labels


def _fields(ddl: str) -> str:
    return ",".join(":".join(p.strip().split(" ", 1)) for p in ddl.split(", "))


def parse_truth_packages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ground-truth packages (one JSON text per row, with ``sequence_id``) as (frames, objects)."""
    schema = ("struct<schema_version:int,annotation_status:string,benchmark_plan_sha256:string,source_sha256:string,"
              "coordinate_space:string,frames:array<struct<frame_index:long,frame_sha256:string,"
              "objects:array<struct<object_id:string,category:string,box:array<double>>>>>>")
    frames = docs.select("sequence_id", F.from_json("value", schema).alias("d")).select(
        "sequence_id", F.posexplode("d.frames").alias("position", "f")).select(
        "sequence_id", F.col("position").cast("long"), "f.*")
    objects = frames.select("sequence_id", "frame_index", F.explode("objects").alias("o")).select(
        "sequence_id", "frame_index", "o.object_id", "o.category",
        *[F.col("o.box")[i].alias(c) for i, c in enumerate(("x_min", "y_min", "x_max", "y_max"))])
    return frames.drop("objects"), objects


def frame_gaps(frames: DataFrame, plans: DataFrame, key: Sequence[str] = ("sequence_id",)) -> DataFrame:
    """Frames a plan (key, first_frame, frame_count) expects but lacks (``missing``) or has but does not expect.

    Gaps are the intervals between neighbouring frames; only they are unfolded, a stretch of ``STRETCH`` at a time. A plan
    without frames (frame_count below 1) expects none.
    """
    key = list(key)
    have = frames.select(*key, "frame_index").distinct()
    plan = plans.select(*key, F.col("first_frame").cast("long").alias("_first"),
                        (F.col("first_frame") + F.col("frame_count")).cast("long").alias("_end")).distinct()
    inside = (F.col("frame_index") >= F.col("_first")) & (F.col("frame_index") < F.col("_end"))
    held = have.join(plan, key).filter(inside).select(*key, "_first", "_end", "frame_index")
    # Every plan starts from the frame before its first one.
    held = held.unionByName(plan.select(*key, "_first", "_end", (F.col("_first") - 1).alias("frame_index")))
    after = bucketed_lead(held, [*key, "_first", "_end"], "frame_index", "_after", 8 * STRETCH)
    low, high = F.col("frame_index") + 1, F.coalesce("_after", "_end") - 1
    stretches = after.select(*key, low.alias("_low"), high.alias("_high")).filter("_low <= _high").select(
        *key, "_high", F.explode(F.sequence("_low", "_high", F.lit(STRETCH).cast("long"))).alias("_low"))
    missing = stretches.select(*key, F.explode(F.sequence(
        "_low", F.least(F.col("_high"), F.col("_low") + (STRETCH - 1)))).alias("frame_index"))
    same = [have[k] == plan[k] for k in key]
    unexpected = have.join(plan, [*same, inside], "left_anti")
    return missing.withColumn("problem", F.lit("missing")).unionByName(unexpected.withColumn("problem", F.lit("unexpected")))


_LABEL_COLUMNS = ("frame_number", "person_id", "tracking_id", "x", "y", "width", "height", "is_valid", "pose_class",
                  "occlusion", "truncated", "visibility")


def read_label_table(spark: SparkSession, path: str) -> DataFrame:
    ddl = ", ".join(f"{c} {'double' if c == 'visibility' else 'long'}" for c in _LABEL_COLUMNS)
    return spark.read.schema(ddl).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option(
        "ignoreTrailingWhiteSpace", True).csv(path)


def label_table(rows: DataFrame, image_width: int, image_height: int, key: Sequence[str] = ()) -> Checked:
    """Twelve-column label rows to normalised truth objects. The person number is checked and then dropped.

    A track may be listed once in a frame; rows that repeat it are all refused."""
    c = F.col
    rules = {
        "identifiers": (c("frame_number") >= 0) & (c("person_id") >= 0) & (c("tracking_id") >= 0),
        "is_valid": c("is_valid").isin(0, 1), "pose_class": c("pose_class").isin(0, 1, 2),
        "flags": c("occlusion").isin(0, 1) & c("truncated").isin(0, 1), "visibility": c("visibility").between(0, 1),
        "area": (c("width") > 0) & (c("height") > 0) & (c("x") >= 0) & (c("y") >= 0),
        "inside": (c("x") + c("width") <= image_width) & (c("y") + c("height") <= image_height),
    }
    track = [*key, "frame_number", "tracking_id"]
    got = check(rows, rules, track)
    again = duplicates(rows, track).select(*track)
    clean = got.clean.join(again, track, "left_anti").filter("is_valid = 1").select(
        *key, c("frame_number").alias("frame_index"), F.concat(F.lit("label-track:"), c("tracking_id")).alias("object_id"),
        F.lit("person").alias("category"), (c("x") / image_width).alias("x_min"), (c("y") / image_height).alias("y_min"),
        ((c("x") + c("width")) / image_width).alias("x_max"), ((c("y") + c("height")) / image_height).alias("y_max"))
    return Checked(clean, got.violations.unionByName(again.withColumn("rule", F.lit("repeated"))))


def activity_intervals(rows: DataFrame, text: str = "classes") -> DataFrame:
    """Activity text like ``Falling (FW)[1.7 to 6]; Walking[0 to 1.7]`` to intervals in milliseconds."""
    pattern = r"([A-Za-z() -]+)\[(\d+(?:\.\d+)?) to (\d+(?:\.\d+)?)\]"
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n)
                           for i, n in ((1, "activity"), (2, "start"), (3, "end"))])
    out = rows.withColumn("p", F.explode(parts))
    return out.select(*[c for c in rows.columns if c != text], F.trim("p.activity").alias("activity"),
                      *[F.round(F.col(f"p.{n}").cast("double") * 1000).cast("long").alias(f"{n}_ms") for n in ("start", "end")])
