"""Turning raw detector output into normalised detections, frame by frame.

A frame is bounded (the detectors emit a few hundred rows at most). Frames over a bound are refused whole and reported,
never truncated, except where keeping the best rows is the rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamp01, has_area
from .scale import once

FRAME = ("source_id", "session_id", "frame_index")
BOX = ("x_min", "y_min", "x_max", "y_max")

# Class numbers and names of the seven security-object classes, and the face class.
SECURITY_CLASSES = {285: "knife", 325: "kitchen_knife", 351: "rifle", 361: "shotgun", 365: "sword", 408: "weapon",
                    533: "handgun"}
FACE_CLASSES = {502: "face"}
MAX_TENSOR_ROWS = 100


class Screened(NamedTuple):
    """Admitted rows, and the frames refused as a whole with the reason."""

    rows: DataFrame
    refused: DataFrame


def _screen(df: DataFrame, frame: Sequence[str], reason: Column) -> Screened:
    tagged = df.withColumn("_reason", reason)
    return Screened(tagged.filter("_reason is null").drop("_reason"),
                    tagged.filter("_reason is not null").groupBy(*frame).agg(F.min("_reason").alias("reason")))


def _is_finite(v: Column) -> Column:
    return ~(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def _finite(cols: Sequence[str | Column]) -> Column:
    good = F.lit(True)
    for c in cols:
        good = good & _is_finite(F.col(c) if isinstance(c, str) else c)
    return good


def best_first(category: bool = False) -> list[Column]:
    return [F.desc("confidence"), *([F.col("category")] if category else []), *[F.col(c) for c in BOX]]


def _top_or_refuse(rows: DataFrame, frame: Sequence[str], cap: int, overflow: str, category: bool,
                   tie: Sequence[str] = ()) -> Screened:
    order = [*best_first(category), *[F.col(t) for t in tie]]
    w = Window.partitionBy(*frame)
    if overflow == "truncate":
        ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).filter(F.col("rank") <= cap)
        return Screened(ranked, rows.select(*frame, F.lit("").alias("reason")).limit(0))
    ranked = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(
        "rank", F.row_number().over(w.orderBy(*order)))
    out = _screen(ranked, frame, F.when(F.col("_n") > cap, "too_many_detections"))
    return Screened(out.rows.drop("_n"), out.refused)


def ssd_detections(raw: DataFrame, label: int, threshold: float = 0.5, cap: int = 64, overflow: str = "refuse",
                   category: str = "object", class_id: int | None = None, max_rows: int = 4096,
                   frame: Sequence[str] = FRAME, unit_confidence: bool = False) -> Screened:
    """Rows ``image_id, label, confidence, x1..y2`` in ``row_ordinal`` order; a negative image id ends the frame.

    ``overflow='truncate'`` keeps the best ``cap``; ``'refuse'`` rejects the frame. With ``unit_confidence`` a
    confidence outside 0 to 1 refuses the frame.
    """
    w = Window.partitionBy(*frame)
    live = raw.withColumn("_end", F.min(F.when(F.col("image_id") < 0, F.col("row_ordinal"))).over(w)).filter(
        F.col("_end").isNull() | (F.col("row_ordinal") <= F.col("_end")))
    live = live.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(
        "_bad", F.max((~_finite(["image_id", "label", "confidence", "x1", "y1", "x2", "y2"])).cast("int")).over(w))
    outside = F.max((~F.col("confidence").between(0.0, 1.0) & (F.col("image_id") >= 0)).cast("int")).over(w)
    live = live.withColumn("_outside", outside if unit_confidence else F.lit(0))
    screened = _screen(live, frame, F.when(F.col("_n") > max_rows, "too_many_rows").when(
        F.col("_bad") == 1, "not_finite").when(F.col("_outside") == 1, "bad_confidence"))
    box = tuple(clamp01(F.col(c)) for c in ("x1", "y1", "x2", "y2"))
    rows = (
        screened.rows.filter((F.col("image_id") >= 0) & (F.col("label") == label) & (F.col("confidence") >= threshold))
        .filter(has_area(box))
        .select(*frame, "row_ordinal", F.lit(category).alias("category"), "confidence",
                *[b.alias(n) for b, n in zip(box, BOX)],
                F.lit(label if class_id is None else class_id).cast("long").alias("class_id")))
    out = _top_or_refuse(rows, frame, cap, overflow, False, ("row_ordinal",))
    return Screened(out.rows, screened.refused.unionByName(out.refused))


def person_detections(raw: DataFrame, threshold: float = 0.5, max_people: int = 16, person_label: int = 1,
                      frame: Sequence[str] = FRAME) -> Screened:
    return ssd_detections(raw, person_label, threshold, max_people, "truncate", "person", frame=frame,
                          unit_confidence=True)


def plate_detections(raw: DataFrame, threshold: float = 0.5, max_plates: int = 16,
                     frame: Sequence[str] = FRAME) -> Screened:
    return ssd_detections(raw, 2, threshold, max_plates, "truncate", "license_plate", frame=frame)


def vehicle_detections(raw: DataFrame, threshold: float = 0.5, max_vehicles: int = 64, road_model: bool = False,
                       frame: Sequence[str] = FRAME) -> Screened:
    return ssd_detections(raw, 2 if road_model else 1, threshold, max_vehicles, "refuse", "vehicle",
                          max_rows=200, frame=frame)


def tensor_detections(tensors: DataFrame, classes: Mapping[int, str], threshold: float = 0.5, cap: int = 64,
                      frame: Sequence[str] = FRAME) -> Screened:
    """One row per frame with ``boxes`` (y1, x1, y2, x2), ``scores``, ``classes`` and ``num``.

    Only the first ``num`` entries count. Unknown classes are dropped; malformed tensors refuse the frame.
    """
    num = F.col("num")
    longest = F.greatest(F.size("boxes"), F.size("scores"), F.size("classes"))
    shortest = F.least(F.size("boxes"), F.size("scores"), F.size("classes"))
    n = num.cast("int")
    used = F.slice(F.arrays_zip("boxes", "scores", "classes"), F.lit(1), F.greatest(n, F.lit(0)))
    wrong_class = F.exists(used, lambda e: e["classes"].isNull() | (e["classes"] != F.floor(e["classes"])))
    wrong_score = F.exists(used, lambda e: e["scores"].isNull() | F.isnan(e["scores"]) | (e["scores"] < 0)
                           | (e["scores"] > 1))
    wrong_box = F.exists(used, lambda e: e["boxes"].isNull() | (F.size(e["boxes"]) != 4) | F.exists(
        e["boxes"], lambda v: ~_is_finite(v)))
    reason = (
        F.when(num.isNull() | (num != F.floor(num)) | (num < 0) | (num > MAX_TENSOR_ROWS), "bad_count")
        .when((shortest < n) | (longest > MAX_TENSOR_ROWS), "bad_length")
        .when(wrong_class, "bad_class").when(wrong_score, "bad_score")
        .when(wrong_box, "bad_box"))
    screened = _screen(tensors, frame, reason)
    names = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    e = F.col("e")
    box = tuple(clamp01(e["boxes"][i]) for i in (1, 0, 3, 2))
    rows = (
        screened.rows.select(*frame, F.posexplode(used).alias("pos", "e"))
        .withColumn("category", F.try_element_at(names, e["classes"].cast("int")))
        .filter(F.col("category").isNotNull() & (e["scores"] >= threshold)).filter(has_area(box))
        .select(*frame, F.col("pos").cast("long").alias("row_ordinal"), "category",
                e["scores"].alias("confidence"), *[b.alias(c) for b, c in zip(box, BOX)],
                e["classes"].cast("long").alias("class_id")))
    out = _top_or_refuse(rows, frame, cap, "refuse", True, ("class_id", "row_ordinal"))
    return Screened(out.rows, screened.refused.unionByName(out.refused))


def landmark_face_detections(raw: DataFrame, threshold: float = 0.9, max_faces: int = 64,
                             frame: Sequence[str] = FRAME) -> Screened:
    """Rows ``vals`` = x, y, w, h, ten landmark numbers, score, in pixels of ``width`` × ``height``.

    A row that is too short, or whose box or score is not finite, refuses its frame."""
    v = F.col("vals")
    x, y, w, h, score = (v[i] for i in (0, 1, 2, 3, 14))
    box = (clamp01(x / F.col("width")), clamp01(y / F.col("height")), clamp01((x + w) / F.col("width")),
           clamp01((y + h) / F.col("height")))
    used = (~_finite([x, y, w, h, score])).cast("int")
    short = (F.coalesce(F.size(v), F.lit(-1)) < 15).cast("int")
    whole = Window.partitionBy(*frame)
    tagged = raw.withColumn("_short", F.max(short).over(whole)).withColumn(
        "_bad", F.max(F.when(short == 0, used).otherwise(0)).over(whole))
    screened = _screen(tagged, frame, F.when(F.col("_short") == 1, "bad_length").when(F.col("_bad") == 1, "not_finite"))
    rows = (
        screened.rows.filter((score >= threshold) & (w > 0) & (h > 0)).filter(has_area(box))
        .select(*frame, "row_ordinal", F.lit("face").alias("category"), score.alias("confidence"),
                *[b.alias(c) for b, c in zip(box, BOX)], F.lit(None).cast("long").alias("class_id")))
    out = _top_or_refuse(rows, frame, max_faces, "refuse", False, ("row_ordinal",))
    return Screened(out.rows, screened.refused.unionByName(out.refused))


def count_ssd_people(raw: DataFrame, person_label: int, threshold: float = 0.5,
                     frame: Sequence[str] = FRAME) -> DataFrame:
    end = F.min(F.when(F.col("image_id") < 0, F.col("row_ordinal"))).over(Window.partitionBy(*frame))
    hit = (F.rint("label") == person_label) & (F.col("confidence") >= threshold) & (
        F.col("_end").isNull() | (F.col("row_ordinal") < F.col("_end")))
    return raw.withColumn("_end", end).groupBy(*frame).agg(F.count_if(hit).alias("people"))


def count_scored_boxes(raw: DataFrame, person_label: int = 1, threshold: float = 0.5,
                       frame: Sequence[str] = FRAME) -> DataFrame:
    """``boxes`` are arrays (x1, y1, x2, y2, score), ``labels`` numbers; one row per frame."""
    both = F.zip_with("boxes", "labels", lambda b, lab: (F.rint(lab) == person_label) & (b[4] >= threshold))
    return raw.select(*frame, F.size(F.filter(both, lambda x: x)).cast("long").alias("people"))


# Plate proposal bounds and blend.
PROPOSAL = {
    "aspect": (2.0, 6.5), "target_aspect": 4.2, "width": (0.03, 0.80), "height": (0.01, 0.25),
    "area": (0.0003, 0.20), "min_rectangularity": 0.20, "nms_iou": 0.50, "max_plates": 16,
    "weights": (0.45, 0.35, 0.20), "full_rectangularity": 0.80, "full_width": 0.20,
}


def plate_proposals(rects: DataFrame, cfg: Mapping = PROPOSAL) -> DataFrame:
    """Integer rectangles (x, y, width, height, contour_area, image_width, image_height) that look like plates."""
    x, y, w, h, a, iw, ih = (F.col(c) for c in (
        "x", "y", "width", "height", "contour_area", "image_width", "image_height"))
    low, high = cfg["aspect"]
    reach = max(cfg["target_aspect"] - low, high - cfg["target_aspect"])
    wa, wr, ws = cfg["weights"]
    inside = (x >= 0) & (y >= 0) & (w >= 1) & (h >= 1) & (x + w <= iw) & (y + h <= ih) & (a >= 0)
    measured = once(rects.filter(inside), {
        "_aspect": w / h, "_wf": w / iw, "_hf": h / ih, "_af": (w * h) / (iw * ih), "_rect": F.least(F.lit(1.0), a / (w * h))})
    aspect, wf, hf, af, rect = (F.col(c) for c in ("_aspect", "_wf", "_hf", "_af", "_rect"))
    kept = measured.filter(
        aspect.between(*cfg["aspect"]) & wf.between(*cfg["width"]) & hf.between(*cfg["height"])
        & af.between(*cfg["area"]) & (rect >= cfg["min_rectangularity"]))
    score = clamp01(
        F.lit(wa) * F.greatest(F.lit(0.0), 1.0 - F.abs(aspect - cfg["target_aspect"]) / reach)
        + F.lit(wr) * F.least(F.lit(1.0), rect / cfg["full_rectangularity"])
        + F.lit(ws) * F.least(F.lit(1.0), wf / cfg["full_width"]))
    return kept.withColumns({
        "score": score, "x_min": x / iw, "y_min": y / ih, "x_max": (x + w) / iw, "y_max": (y + h) / ih,
    }).drop("_aspect", "_wf", "_hf", "_af", "_rect")


def suppress_overlaps(proposals: DataFrame, threshold: float = 0.5, keep: int = 16,
                      frame: Sequence[str] = FRAME) -> DataFrame:
    """Greedy non-maximum suppression per frame, best first, keeping at most ``keep`` boxes.

    Frames are bounded, and a task streams through them; nested array lambdas were several times slower here.
    """
    from ..functions.assignment import iou_pair
    from .scale import Columns, map_sorted_groups

    cols = [*frame, "score", *BOX]
    rows = proposals.select(cols).withColumn("_neg", -F.col("score"))
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in proposals.select(cols).schema], "rank long"])

    def greedy(c: Columns) -> Columns:
        boxes = list(zip(*(c[b].tolist() for b in BOX)))
        kept: list[int] = []
        for i, b in enumerate(boxes):
            if len(kept) == keep:
                break
            if all(iou_pair(b, boxes[k]) <= threshold for k in kept):
                kept.append(i)
        return {**{n: c[n][kept] for n in cols}, "rank": np.arange(1, len(kept) + 1)}

    return map_sorted_groups(rows, frame, ["_neg", *BOX], greedy, schema)


def plate_reads(words: DataFrame, min_confidence: float = 0.0, key: Sequence[str] = ("crop_id",)) -> DataFrame:
    """Word rows to one complete read per crop or an abstention (NULL text).

    ``words``: crop_id, word_ordinal, level, conf (text as printed), text. One doubtful word abstains the whole crop.
    """
    from ..functions.text import MAX_PLATE, plate_text

    level_ok = F.col("level").rlike("^[1-5]\\z")
    conf_ok = F.col("conf").rlike("^-?[0-9]+(\\.[0-9]+)?\\z")
    conf = F.when(conf_ok, F.col("conf").cast("double"))
    word = level_ok & (F.col("level") == "5")
    text = plate_text(F.col("text"))
    good_word = (F.col("text") != "") & conf.between(0, 100) & text.isNotNull() & (conf / 100 >= min_confidence)
    good_layout = (F.coalesce(F.col("text"), F.lit("")) == "") & ((conf == -1) | conf.between(0, 100))
    ok = F.coalesce(level_ok & conf_ok & F.when(word, good_word).otherwise(good_layout), F.lit(False))
    parts = F.sort_array(F.collect_list(F.when(word, F.struct("word_ordinal", text.alias("t")))))
    joined = F.array_join(F.transform(F.col("_parts"), lambda p: p["t"]), "")
    accept = F.col("_ok") & (F.length("_text") > 0) & (F.length("_text") <= MAX_PLATE)
    return (
        words.groupBy(*key).agg(F.bool_and(ok).alias("_ok"), parts.alias("_parts"),
                                F.min(F.when(word, conf / 100)).alias("_conf"))
        .withColumn("_text", joined)
        .select(*key, F.when(accept, F.col("_text")).alias("plate_text"),
                F.when(accept, F.col("_conf")).alias("confidence")))


def read_plates(plates: DataFrame, reads: DataFrame, key: Sequence[str] = ("crop_id",)) -> Screened:
    """Plates joined with their reads; plates whose read abstained come back in ``refused``."""
    both = plates.join(reads.withColumnRenamed("confidence", "text_confidence"), list(key), "left")
    return Screened(
        both.filter("plate_text is not null"),
        both.filter("plate_text is null").select(*key, F.lit("abstained").alias("reason")))


def sampled_frames(frames: DataFrame, period_ms: int = 360, segment: Sequence[str] = ("source_id", "segment_id"),
                   bucket_ms: int | None = None) -> DataFrame:
    """Frames taken greedily: the first, then the first at least ``period_ms`` after the last one taken.

    ``frames``: segment keys, timestamp_ms, frame_id. A frame is taken exactly when it opens a span-limited segment.
    """
    from .cuts import CutRules, greedy_segments

    rules = CutRules(max_span_ms=period_ms - 1, bucket_ms=bucket_ms or max(60_000, 20 * period_ms))
    cut = greedy_segments(frames.withColumn("_s", F.lit("")), segment, "timestamp_ms", "_s", "frame_id", rules)
    return cut.filter(F.col("frame_id") == F.col("cut_id")).select(*segment, "frame_id", "timestamp_ms")


def heatmap_peak(matrix: Column) -> Column:
    """struct<x, y, score> of the first maximum cell, shifted a quarter cell toward its larger neighbour."""
    width = F.size(matrix[0])
    height = F.size(matrix)
    flat = F.flatten(matrix)
    top = F.array_max(flat)
    at = F.array_position(flat, top) - 1
    bx, by = F.pmod(at, width).cast("int"), F.floor(at / width).cast("int")

    def shift(pos, extent, after, before):
        delta = after - before
        moved = F.when(delta > 0, 0.25).when(delta < 0, -0.25).otherwise(0.0)
        return pos.cast("double") + F.when((pos > 0) & (pos < extent - 1), moved).otherwise(0.0)

    def cell(y, x):
        return F.get(F.get(matrix, y), x)

    return F.struct(
        shift(bx, width, cell(by, bx + 1), cell(by, bx - 1)).alias("x"),
        shift(by, height, cell(by + 1, bx), cell(by - 1, bx)).alias("y"),
        clamp01(top).alias("score"))


def joints_from_heatmaps(peaks: DataFrame) -> DataFrame:
    """Peaks (x, y, score, map_width, map_height and the crop box in pixels) placed in the picture."""
    px = F.col("crop_x_min") + ((F.col("x") + 0.5) / F.col("map_width")) * (F.col("crop_x_max") - F.col("crop_x_min"))
    py = F.col("crop_y_min") + ((F.col("y") + 0.5) / F.col("map_height")) * (F.col("crop_y_max") - F.col("crop_y_min"))
    return peaks.withColumns({"joint_x": px, "joint_y": py})
