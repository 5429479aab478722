"""Live segment windows and the camera catalogue."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import Columns, fold_sorted

# Segments in a window and the longest window.
WINDOW_SEGMENTS, MAX_WINDOW_SECONDS = 3, 35.0


def camera_problems(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted cameras (index, name) that are not listed exactly once and in service."""
    # What is listed is counted before it meets what is wanted; the name and state kept are those of an index listed once.
    listed = catalogue.groupBy("index").agg(
        F.count(F.lit(1)).alias("n"), F.min("name").alias("_name"), F.min("in_service").alias("_state"))
    good = (F.col("n") == 1) & (F.col("_state") == "true") & (F.col("_name") == F.col("name"))
    return wanted.select("index", "name").join(listed, "index", "left").filter(~F.coalesce(good, F.lit(False))).select("index")


def window_checks(segments: DataFrame, key: Sequence[str] = ("camera", "window_id")) -> DataFrame:
    """Per playlist window: consecutive sequences, durations within target, count and total duration.

    A window lists a handful of segments, so its group is small.
    """
    w = Window.partitionBy(*key).orderBy("sequence")
    step = F.coalesce(F.col("sequence") - F.lag("sequence").over(w) == 1, F.lit(True))
    return segments.withColumn("_step", step).groupBy(*key).agg(
        F.count(F.lit(1)).alias("segments"), F.bool_and("_step").alias("consecutive"),
        F.bool_and((F.col("duration_seconds") > 0) & (F.col("duration_seconds") <= F.col("target_duration"))).alias("within_target"),
        F.sum("duration_seconds").alias("total_seconds")).withColumn(
        "accepted", (F.col("segments") == WINDOW_SEGMENTS) & F.col("consecutive") & F.col("within_target")
        & (F.col("total_seconds") <= MAX_WINDOW_SECONDS))


def segment_report(frames: DataFrame, sampled: DataFrame, tracks: DataFrame,
                   key: Sequence[str] = ("source_id", "segment_id")) -> DataFrame:
    """Decoded and sampled frames, detections, track observations and the span; accuracy stays NULL without labels."""
    key = list(key)
    f = frames.groupBy(*key).agg(F.count(F.lit(1)).alias("decoded_frames"), F.min("timestamp_ms").alias("first_ms"),
                                 F.max("timestamp_ms").alias("last_ms"))
    s = sampled.groupBy(*key).agg(F.count(F.lit(1)).alias("sampled_frames"), F.sum("detections").alias("detections"))
    t = tracks.groupBy(*key).agg(F.count(F.lit(1)).alias("track_observations"), F.count_distinct("track_id").alias("unique_ids"))
    return f.join(s, key, "left").join(t, key, "left").na.fill(0).withColumn("accuracy", F.lit(None).cast("double"))


def _sequence_digest(frames: DataFrame, key: Sequence[str], order: Sequence[str], item: Column, out: str) -> DataFrame:
    """SHA-256 over the items (binary) of a key in order. A hash reads its text in order, so one task reads a key, but
    holds only a slice of it."""
    kind = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in key)

    def take(state: list, c: Columns) -> None:
        state[0].update(b"".join(bytes(x) for x in c["_item"]))
        state[1] += len(c["_item"])

    return fold_sorted(frames.select(*key, *order, item.alias("_item")), key, [*order, "_item"],
                       lambda: [hashlib.sha256(), 0], take, lambda s: {out: [s[0].hexdigest()], "frames": [s[1]]},
                       f"{kind}, {out} string, frames long")


def frame_manifest_digest(frames: DataFrame, key: Sequence[str] = ("sequence_id",)) -> DataFrame:
    """SHA-256 over the ordered lines ``<index> TAB <sha>``, and the number of frames, for sequences of any length."""
    line = F.concat(F.col("frame_index").cast("string"), F.lit("\t"), F.col("sha256"), F.lit("\n"))
    return _sequence_digest(frames, list(key), ["frame_index"], F.encode(line, "UTF-8"), "digest")


def frame_chain_digest(frames: DataFrame, key: Sequence[str] = ("source_id", "segment_id")) -> DataFrame:
    """SHA-256 over index, timestamp (8 bytes each) and frame digest of a segment's frames in order."""
    def eight(c: str):
        return F.unhex(F.lpad(F.hex(F.col(c)), 16, "0"))

    item = F.concat(eight("frame_index"), eight("timestamp_ms"), F.unhex("sha256"))
    return _sequence_digest(frames, list(key), ["frame_index"], item, "chain_sha256").drop("frames")


def label_digest(objects: DataFrame, key: Sequence[str] = ("sequence_id",)) -> DataFrame:
    """Order-free digest of label boxes: per frame first, then over the frame digests of a sequence."""
    text = F.concat_ws("|", "object_id", "category", *[F.hex(F.encode(F.col(c).cast("string"), "UTF-8"))
                                                       for c in ("x_min", "y_min", "x_max", "y_max")])
    frames = objects.groupBy(*key, "frame_index").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("sha256"))
    return frame_manifest_digest(frames, key)
