"""Posture rules over the shoulder and hip joints of a pose, as Column expressions.

``joints`` is a ``map<string, struct<x, y, confidence>>`` Column, or a dict with one struct Column per joint (faster:
no lookups). The pose box is a tuple of four Columns.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Box

# The joints every posture rule needs.
REQUIRED = ("left_shoulder", "right_shoulder", "left_hip", "right_hip")


@dataclass(frozen=True)
class PostureConfig:
    """Engineering thresholds; each may be a number or a Column, so a grid can be swept in one pass."""

    min_pose_confidence: float | Column = 0.35
    min_keypoint_confidence: float | Column = 0.35
    min_torso_fraction: float = 0.10
    orientation_threshold: float = 0.70
    upright_aspect_min: float = 1.15
    down_aspect_min: float = 1.15


# The floors used when the joints come from the bottom-up decoder.
DECODED = replace(PostureConfig(), min_pose_confidence=0.0, min_keypoint_confidence=0.10)
DIAGONAL_DELTA = 0.02


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


Joints = Column | dict[str, Column]


def _parts(joints: Joints) -> list[Column]:
    if isinstance(joints, dict):
        return [joints[name] for name in REQUIRED]
    return [F.try_element_at(joints, F.lit(name)) for name in REQUIRED]


def _lowest(points: list[Column]) -> Column:
    return F.least(*[p["confidence"] for p in points])


def required_present(joints: Joints) -> Column:
    return sum((p.isNotNull().cast("int") for p in _parts(joints)), F.lit(0))


def pose_metrics(joints: Joints, b: Box) -> dict[str, Column]:
    """Torso and aspect measurements; NULL where a joint is missing or a length is zero."""
    ls, rs, lh, rh = pts = _parts(joints)
    dx = (lh["x"] + rh["x"]) / 2.0 - (ls["x"] + rs["x"]) / 2.0
    dy = (lh["y"] + rh["y"]) / 2.0 - (ls["y"] + rs["y"]) / 2.0
    full = ls.isNotNull() & rs.isNotNull() & lh.isNotNull() & rh.isNotNull()
    torso = F.hypot(dx, dy)
    w, h = b[2] - b[0], b[3] - b[1]
    diag = F.hypot(w, h)
    return {
        "min_required_confidence": _lowest(pts),
        "torso_fraction": F.when(full & (diag > 0), torso / diag),
        "vertical_fraction": F.when(torso > 0, F.abs(dy) / torso),
        "horizontal_fraction": F.when(torso > 0, F.abs(dx) / torso),
        "width_over_height": F.when(full, w / h),
        "height_over_width": F.when(full, h / w),
    }


def _orientation(dx: Column, dy: Column, b: Box, cfg: PostureConfig):
    torso = F.hypot(dx, dy)
    w, h = b[2] - b[0], b[3] - b[1]
    small = torso < F.hypot(w, h) * cfg.min_torso_fraction
    tall = (F.abs(dy) / torso >= cfg.orientation_threshold) & (h / w >= cfg.upright_aspect_min)
    wide = (F.abs(dx) / torso >= cfg.orientation_threshold) & (w / h >= cfg.down_aspect_min)
    return small, tall, wide


def _result(posture: str, basis: str, confidence: Column) -> Column:
    return F.struct(F.lit(posture).alias("posture"), confidence.cast("double").alias("confidence"),
                    F.lit(basis).alias("basis"))


def classify(pose_confidence: Column, joints: Joints, b: Box, cfg: PostureConfig = PostureConfig()) -> Column:
    """Four-joint posture: struct<posture, confidence, basis>."""
    ls, rs, lh, rh = pts = _parts(joints)
    low = _lowest(pts)
    conf = F.least(pose_confidence, low)
    missing = ls.isNull() | rs.isNull() | lh.isNull() | rh.isNull()
    small, tall, wide = _orientation(
        (lh["x"] + rh["x"]) / 2.0 - (ls["x"] + rs["x"]) / 2.0,
        (lh["y"] + rh["y"]) / 2.0 - (ls["y"] + rs["y"]) / 2.0, b, cfg,
    )
    return (
        F.when(pose_confidence < _lit(cfg.min_pose_confidence),
               _result("unknown", "pose_confidence_below_threshold", pose_confidence))
        .when(missing, _result("unknown", "required_keypoints_missing", F.lit(0.0)))
        .when(low < _lit(cfg.min_keypoint_confidence),
              _result("unknown", "required_keypoint_confidence_below_threshold", conf))
        .when(small, _result("unknown", "torso_geometry_too_small", conf))
        .when(tall, _result("upright", "vertical_torso_and_tall_bbox", conf))
        .when(wide, _result("down", "horizontal_torso_and_wide_bbox", conf))
        .otherwise(_result("other", "geometry_not_decisive", conf))
    )


def three_joint(joints: Joints, b: Box, cfg: PostureConfig = DECODED) -> Column:
    """Posture from the complete body side when exactly one of the four joints is absent."""
    ls, rs, lh, rh = pts = _parts(joints)
    left, right = ls.isNotNull() & lh.isNotNull(), rs.isNotNull() & rh.isNotNull()
    shoulder = F.when(left, ls).when(right, rs)
    hip = F.when(left, lh).when(right, rh)
    small, tall, wide = _orientation(hip["x"] - shoulder["x"], hip["y"] - shoulder["y"], b, cfg)
    low = _lowest(pts)

    def out(posture, basis):
        return F.struct(F.lit(posture).alias("posture"), F.lit("three_point_" + basis).alias("basis"))

    return (
        F.when(required_present(joints) != 3, out("unknown", "fallback_not_applicable"))
        .when(low < _lit(cfg.min_keypoint_confidence),
              out("unknown", "required_keypoint_confidence_below_threshold"))
        .when(~(left | right), out("unknown", "complete_side_missing"))
        .when(small, out("unknown", "torso_geometry_too_small"))
        .when(tall, out("upright", "vertical_torso_and_tall_bbox"))
        .when(wide, out("down", "horizontal_torso_and_wide_bbox"))
        .otherwise(out("unknown", "geometry_not_decisive"))
    )


def corrected(pose_confidence: Column, joints: Joints, b: Box, cfg: PostureConfig = DECODED) -> Column:
    """Four-joint posture, then the three-joint rule where exactly three joints left it unknown.

    A NULL box stands for a frame with no associated pose.
    """
    base = classify(pose_confidence, joints, b, cfg)
    alt = three_joint(joints, b, cfg)
    decided = alt["posture"].isin("upright", "down")
    use = (base["posture"] == "unknown") & (required_present(joints) == 3)
    conf = F.when(decided, F.least(pose_confidence, _lowest(_parts(joints)))).otherwise(base["confidence"])
    fallback = F.struct(
        F.when(decided, alt["posture"]).otherwise(F.lit("unknown")).alias("posture"),
        conf.cast("double").alias("confidence"), alt["basis"].alias("basis"))
    return (
        F.when(b[0].isNull(), _result("unknown", "no_associated_pose", F.lit(0.0)))
        .when(use, fallback)
        .otherwise(base)
    )


def bounded(pose_confidence: Column, joints: Joints, b: Box, cfg: PostureConfig = DECODED) -> Column:
    """``corrected`` with a near-45-degree undecided torso reported as unknown."""
    c = corrected(pose_confidence, joints, b, cfg)
    m = pose_metrics(joints, b)
    near = F.abs(m["horizontal_fraction"] - m["vertical_fraction"]) <= DIAGONAL_DELTA
    hit = (c["posture"] == "other") & (c["basis"] == "geometry_not_decisive") & F.coalesce(near, F.lit(False))
    return F.when(hit, F.struct(F.lit("unknown").alias("posture"), c["confidence"].alias("confidence"),
                                F.lit("diagonal_torso_ambiguous").alias("basis"))).otherwise(c)
