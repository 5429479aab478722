"""Decoded 17-joint poses: source-pixel geometry, association with the selected box and the bounded fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, iou, pose_vs_selection

FRAME = ("source_id", "session_id", "frame_index")
# Joint numbers of the four required joints, heat-map stride, fallback reach in selection diagonals.
REQUIRED_INDEX = {5: "left_shoulder", 6: "right_shoulder", 11: "left_hip", 12: "right_hip"}
JOINTS = 17
STRIDE = 8.0
MAX_FALLBACK_GAP = 0.125
SEL = ("sel_x_min", "sel_y_min", "sel_x_max", "sel_y_max")
POSE = ("pose_x_min", "pose_y_min", "pose_x_max", "pose_y_max")


def _sel() -> Box:
    return tuple(F.col(c) for c in SEL)  # type: ignore[return-value]


def joints() -> dict[str, Column]:
    """The four required joints of a candidate row: struct<x, y, confidence>, NULL when absent."""
    return {name: F.col("j_" + name) for name in REQUIRED_INDEX.values()}


def _points(poses: DataFrame, clip: bool) -> DataFrame:
    """One row per valid joint, placed in source pixels, with ``_inside`` for the selected box.

    ``poses`` holds an array ``joints`` per pose, or is already one row per joint (joint_index, joint_x, joint_y,
    joint_confidence), which saves building and taking apart the arrays.
    """
    def place(c: str, resized: str, extent: str) -> Column:
        p = F.col(c) * (F.col(extent) / F.col(resized) * STRIDE)
        return F.least(F.col(extent).cast("double"), F.greatest(F.lit(0.0), p)) if clip else p

    s = _sel()
    if "joints" in poses.columns:
        poses = poses.filter(F.size("joints") >= JOINTS).select(
            *[c for c in poses.columns if c != "joints"], F.posexplode(F.slice("joints", 1, JOINTS)).alias("_i", "_j"))
        names = ("_j.x", "_j.y", "_j.confidence")
    else:
        poses = poses.withColumnRenamed("joint_index", "_i")
        names = ("joint_x", "joint_y", "joint_confidence")
    out = poses.filter(F.col(names[2]) > 0).withColumns({
        "_x": place(names[0], "resized_w", "frame_w"), "_y": place(names[1], "resized_h", "frame_h"),
        "_c": F.least(F.lit(1.0), F.col(names[2]))})
    return out.withColumn("_inside", F.col("_x").between(s[0], s[2]) & F.col("_y").between(s[1], s[3])).drop(
        *[n for n in names if "." not in n])


def _gather(points: DataFrame, key: Sequence[str], extra: dict[str, Column]) -> DataFrame:
    """Back to one row per pose. The rows of a pose sit together, so the partial aggregate does the work."""
    need = F.col("_i").isin(*REQUIRED_INDEX)
    keep = [c for c in points.columns if c not in key and not c.startswith("_")]
    fields = {"x": "_x", "y": "_y", "confidence": "_c"}
    # Plain numbers aggregate by hash; structs would force a sort of every point.
    flat = points.groupBy(*key).agg(
        *[F.any_value(c).alias(c) for c in keep], *[c.alias(n) for n, c in extra.items()],
        F.count_if(need).alias("required_points"), F.count_if(need & F.col("_inside")).alias("required_inside"),
        *[F.max(F.when(F.col("_i") == i, F.col(c))).alias(f"_{n}_{f}")
          for i, n in REQUIRED_INDEX.items() for f, c in fields.items()])
    names = REQUIRED_INDEX.values()
    return flat.withColumns({
        "j_" + n: F.when(F.col(f"_{n}_x").isNotNull(), F.struct(*[F.col(f"_{n}_{f}").alias(f) for f in fields]))
        for n in names}).drop(*[f"_{n}_{f}" for n in names for f in fields])


def own_box_candidates(poses: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    """Poses with their own box, point counts, IoU and distances to the selection.

    Poses with fewer than two valid points, or whose points do not span a box, are dropped.
    """
    if "joints" in poses.columns:
        # One shuffle serves everything after it: gathering a pose, ranking a frame, joining by frame.
        poses = poses.repartition(*frame)
    x, y = F.col("_x"), F.col("_y")
    out = _gather(_points(poses, True), [*frame, "pose_ordinal"], {
        "valid_points": F.count(F.lit(1)), "all_inside": F.count_if("_inside"),
        **dict(zip(POSE, (F.min(x), F.min(y), F.max(x), F.max(y))))})
    pose = tuple(F.col(c) for c in POSE)
    return (
        out.filter("valid_points >= 2").filter(pose[2] > pose[0]).filter(pose[3] > pose[1])
        .withColumns({"selection_iou": iou(pose, _sel()), **pose_vs_selection(pose, _sel())}))  # type: ignore


def selection_box_candidates(poses: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    """The variant that keeps the selected box as the pose box and looks at the four required joints only."""
    points = _points(poses, False).filter(F.col("_i").isin(*REQUIRED_INDEX))
    return _gather(points, [*frame, "pose_ordinal"], {})


def _first(df: DataFrame, frame: Sequence[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*frame).orderBy(*order, F.col("pose_ordinal"))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def associate(candidates: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    """The pose overlapping the selection, per frame: IoU, then points inside, required points, decoder score."""
    touching = candidates.filter(
        (F.col("required_points") > 0) & ((F.col("selection_iou") > 0) | (F.col("all_inside") > 0)))
    return _first(touching, frame, F.desc("selection_iou"), F.desc("all_inside"), F.desc("required_points"),
                  F.desc("decoder_score"))


def associate_by_joints(candidates: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    """The variant on selection-box candidates: most required joints inside wins, none inside means no pose."""
    best = _first(candidates.filter("required_points > 0"), frame, F.desc("required_inside"),
                  F.desc("required_points"), F.desc("decoder_score"))
    return best.filter("required_inside > 0")


def _nearness() -> list[Column]:
    return [F.col("edge_gap_norm"), F.col("center_distance_norm"), F.desc("valid_points"), F.desc("decoder_score")]


def nearest(candidates: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    return _first(candidates.filter("required_points > 0"), frame, *_nearness())


def bounded_fallback(candidates: DataFrame, max_gap: float = MAX_FALLBACK_GAP,
                     frame: Sequence[str] = FRAME) -> DataFrame:
    """Per frame: the single near pose, or an abstention with its reason and how many were near."""
    near = (F.col("edge_gap_norm") > 0) & (F.col("edge_gap_norm") <= max_gap)
    n = F.col("near_count")
    return (
        candidates.filter("required_points > 0").groupBy(*frame)
        .agg(F.count_if(near).alias("near_count"), F.min(F.when(near, F.col("pose_ordinal"))).alias("_o"))
        .select(*frame, "near_count",
                F.when(n == 0, "no_candidate_within_bound").when(n > 1, "ambiguous_candidates_within_bound")
                .otherwise("bounded_edge_gap").alias("reason"),
                F.when(n == 1, F.col("_o")).alias("pose_ordinal")))


def associated_or_fallback(candidates: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    """One row per frame with candidates: the chosen pose (if any) and why it was or was not chosen."""
    cand = candidates.filter("required_points > 0")
    w = Window.partitionBy(*frame)
    touching = (F.col("selection_iou") > 0) | (F.col("all_inside") > 0)
    near = (F.col("edge_gap_norm") > 0) & (F.col("edge_gap_norm") <= MAX_FALLBACK_GAP)
    t_order = w.orderBy((~touching).cast("int"), F.desc("selection_iou"), F.desc("all_inside"),
                        F.desc("required_points"), F.desc("decoder_score"), "pose_ordinal")
    n_order = w.orderBy(*_nearness(), "pose_ordinal")
    c = (
        cand.withColumn("_touch", F.row_number().over(t_order)).withColumn("nearest_rank", F.row_number().over(n_order))
        .withColumn("_any", F.max(touching.cast("int")).over(w))
        .withColumn("near_count", F.count(F.when(near, 1)).over(w)))
    picked = F.when(F.col("_any") == 1, F.col("_touch") == 1).otherwise((F.col("near_count") == 1) & near)
    reason = (
        F.when(F.col("_any") == 1, "baseline_overlap").when(F.col("near_count") == 0, "no_candidate_within_bound")
        .when(F.col("near_count") > 1, "ambiguous_candidates_within_bound").otherwise("bounded_edge_gap"))
    c = c.withColumn("associated", picked).withColumn("association_reason", reason)
    has = F.max(F.col("associated").cast("int")).over(w)
    return c.withColumn("_has", has).filter(
        F.col("associated") | ((F.col("_has") == 0) & (F.col("nearest_rank") == 1))
    ).drop("_touch", "_any", "_has")
