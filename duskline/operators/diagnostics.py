"""Detector, pose and temporal diagnostics as grouped aggregates in long or wide form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import posture as ps
from ..functions.geometry import Box
from .poses import joints
from .persistence import PersistenceConfig
from .quantiles import order_statistics
from .scale import BUCKET, once

# Threshold grids and the pass marks of the detector choice.
THRESHOLDS = (0.50, 0.40, 0.30, 0.20, 0.10)
POSE_FLOORS = (0.35, 0.10)
KEYPOINT_FLOORS = (0.35, 0.20, 0.10, 0.05, 0.02)
CHOICE = {"coverage": 0.55, "negative": 0.90, "duplicates": 0.05}
CONTINUITY = {"positive_during_coverage": 0.85, "positive_during_link_rate": 0.70, "negative_coverage": 0.95,
              "negative_link_rate": 0.90, "positive_reset_rate": 0.30, "negative_reset_rate": 0.10}
MATERIAL_GAIN, MATERIAL_NEGATIVE = 0.25, 0.90


def per(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a / b).otherwise(0.0)


def with_window(rows: DataFrame, labels: DataFrame, ts: str = "timestamp_ms", otherwise: str | None = None) -> DataFrame:
    """before/during/after the sample's label (end inclusive); only samples with exactly one label have windows."""
    one = labels.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("start_ms").alias("_s"), F.max("end_ms").alias("_e")).filter("_n = 1")
    t = F.col(ts)
    name = F.when(F.col("_n").isNull(), F.lit(otherwise)).when(t < F.col("_s"), "before").when(
        t <= F.col("_e"), "during").otherwise("after")
    return rows.join(one, "sample_id", "left").withColumn("window", name).drop("_n", "_s", "_e")


def overall_and_windows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row counted once overall and once in its window, when it has one."""
    return df.withColumn("window", F.explode(F.array_compact(F.array(
        F.lit("overall"), F.when(F.col("window") != "overall", F.col("window"))))))


def threshold_sweep(frames: DataFrame, detections: DataFrame, frame: Sequence[str], group: Sequence[str],
                    thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(group, threshold): frames, coverage and duplicates. One pass per frame counts all thresholds at once.

    ``frames`` holds every frame with the ``group`` columns, including those without detections.
    """
    names = [f"_t{i}" for i in range(len(thresholds))]
    counts = detections.groupBy(*frame).agg(*[
        F.count_if(F.col("confidence") >= t).alias(n) for n, t in zip(names, thresholds)])
    j = frames.join(counts, list(frame), "left").na.fill(0, names)
    aggs = [F.count(F.lit(1)).alias("frames")]
    for n in names:
        c = F.col(n)
        aggs += [F.count_if(c > 0).alias(n + "w"), F.sum(c).alias(n + "d"), F.count_if(c > 1).alias(n + "x"),
                 F.sum(F.greatest(c - 1, F.lit(0))).alias(n + "e")]
    wide = j.groupBy(*group).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(float(t)).alias("threshold"), F.col(n + "w").alias("frames_with_detection"),
        F.col(n + "d").alias("detections"), F.col(n + "x").alias("duplicate_frames"),
        F.col(n + "e").alias("duplicate_excess")) for n, t in zip(names, thresholds)]))
    out = wide.select(*group, "frames", rows.alias("r")).select(*group, "frames", "r.*")
    return out.withColumns({"coverage": per("frames_with_detection", "frames"),
                            "duplicate_frame_rate": per("duplicate_frames", "frames")})


def choose_threshold(rows: DataFrame) -> DataFrame:
    """The highest threshold clearing the coverage and duplicate marks; NULL when none does."""
    ok = (
        (F.col("positive_during_coverage") >= CHOICE["coverage"]) & (F.col("negative_coverage") >= CHOICE["negative"])
        & (F.col("positive_duplicate_frame_rate") <= CHOICE["duplicates"])
        & (F.col("negative_duplicate_frame_rate") <= CHOICE["duplicates"]))
    return rows.agg(F.max(F.when(ok, F.col("threshold"))).alias("threshold"))


def continuity_passes() -> Column:
    """True when the continuity summary row clears every mark."""
    out = F.lit(True)
    for name, mark in CONTINUITY.items():
        c = F.col(name)
        out = out & ((c <= mark) if name.endswith("reset_rate") else (c >= mark))
    return out


def shootout_coverage(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Coverage per group from per-frame counts ``people``."""
    return counts.groupBy(*group).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("people") > 0).alias("frames_with_detection"),
        F.sum("people").alias("detections")).withColumn("coverage", per("frames_with_detection", "frames"))


def material_candidate(models: DataFrame, baseline: str) -> DataFrame:
    """The smallest model gaining enough positive coverage over the baseline while keeping negative coverage.

    ``models``: model, positive_during_coverage, negative_coverage, artifact_bytes, detector_fps.
    """
    base = models.filter(F.col("model") == baseline).select(
        F.least(F.lit(1.0), F.col("positive_during_coverage") + MATERIAL_GAIN).alias("_need"), F.lit(1).alias("_k"))
    ok = models.filter(F.col("model") != baseline).withColumn("_k", F.lit(1)).join(base, "_k").filter(
        (F.col("positive_during_coverage") >= F.col("_need")) & (F.col("negative_coverage") >= MATERIAL_NEGATIVE))
    return ok.orderBy("artifact_bytes", F.desc("detector_fps"), "model").limit(1).select("model")


def stage_totals(frames: DataFrame, group: Sequence[str], observations: DataFrame) -> DataFrame:
    """Frames, detections, poses, postures, assignments and distinct tracks per group.

    ``frames``: group, detections, poses per frame. ``observations``: group, posture, track_id per pose.
    """
    f = frames.groupBy(*group).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("detections") > 0).alias("frames_with_detection"),
        F.sum("detections").alias("detections"), F.count_if(F.col("poses") > 0).alias("frames_with_pose"),
        F.sum("poses").alias("pose_candidates"))
    o = observations.groupBy(*group).agg(
        *[F.count_if(F.col("posture") == p).alias("posture_" + p) for p in ("upright", "down", "other", "unknown")],
        F.count("track_id").alias("track_assignments"), F.count_distinct("track_id").alias("distinct_tracks"))
    return f.join(o, list(group), "left").na.fill(0)


def long_counts(rows: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Value counts of several columns in long form: (group, metric, value, n)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value"))
                                for c in columns]))
    return rows.select(*group, pairs.alias("p")).select(*group, "p.*").filter("value is not null").groupBy(
        *group, "metric", "value").agg(F.count(F.lit(1)).alias("n"))


def long_stats(rows: DataFrame, group: Sequence[str], columns: Sequence[str], quantiles: bool = False,
               approximate: bool = False) -> DataFrame:
    """count/min/max with mean, or nearest-rank p50 and p90, per numeric column in long form.

    ``approximate`` trades the exact nearest-rank quantile for a bounded sketch on very large groups.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v"))
                                for c in columns]))
    long = rows.select(*group, pairs.alias("p")).select(*group, "p.*").filter("v is not null")
    group, inner = [*group, "metric"], {"p50": ("nearest", 0.5), "p90": ("nearest", 0.9)}
    if quantiles and not approximate:
        return order_statistics(long, group, "v", {"min": ("nearest", 0.0), **inner, "max": ("nearest", 1.0)})
    middle = [F.percentile_approx("v", p, 10_000).alias(n) for n, (_, p) in inner.items()] if quantiles else [F.avg("v").alias("mean")]
    return long.groupBy(*group).agg(F.count("v").alias("n"), F.min("v").alias("min"), *middle, F.max("v").alias("max"))


def posture_sensitivity(poses: DataFrame, group: Sequence[str], box: Box) -> DataFrame:
    """(group, pose floor, keypoint floor, posture): counts over the threshold grid, classified in one pass."""
    # Only the two floors vary over the grid: the geometry is judged once per pose, with both floors off.
    free = ps.PostureConfig(min_pose_confidence=-1.0, min_keypoint_confidence=-1.0)
    low = F.least(*[j["confidence"] for j in joints().values()])
    g = once(poses.select(*group, "pose_confidence", *box, *joints().values()), {
        "_geo": ps.classify(F.lit(0.0), joints(), box, free)["posture"], "_low": low})
    g = g.select(*group, "pose_confidence", "_geo", "_low", F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), F.lit(k).alias("k")) for p in POSE_FLOORS for k in KEYPOINT_FLOORS])).alias("g"))
    weak = (F.col("pose_confidence") < F.col("g.p")) | F.coalesce(F.col("_low") < F.col("g.k"), F.lit(False))
    return g.groupBy(*group, F.col("g.p").alias("pose_floor"), F.col("g.k").alias("keypoint_floor"),
                     F.when(weak, "unknown").otherwise(F.col("_geo")).alias("posture")).agg(F.count(F.lit(1)).alias("n"))


def decoded_pose_totals(frames: DataFrame, group: Sequence[str]) -> DataFrame:
    """Coverage of selection, decoding and association from one row per frame.

    ``frames``: selected boolean, decoded_count (NULL = not inferred), associated boolean.
    """
    sel = F.col("selected")
    inf = sel & F.col("decoded_count").isNotNull()
    t = frames.groupBy(*group).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(sel).alias("selected_frames"),
        F.count_if(inf).alias("inferred_frames"),
        F.count_if(inf & (F.col("decoded_count") > 0)).alias("frames_with_decoded_pose"),
        F.coalesce(F.sum(F.when(inf, F.col("decoded_count"))), F.lit(0)).alias("total_decoded_poses"),
        F.count_if(inf & (F.col("decoded_count") > 1)).alias("multi_pose_frames"),
        F.count_if(inf & F.col("associated")).alias("associated_frames"))
    return t.withColumns({"selection_coverage": per("selected_frames", "frames"),
                          "association_fraction": per("associated_frames", "inferred_frames")})


def posture_quality(poses: DataFrame, group: Sequence[str], box: Box) -> DataFrame:
    """Associated poses tagged with posture, basis, the three-joint attempt and the corrected posture.

    Feed the result to ``long_counts`` / ``long_stats``.
    """
    df = once(poses, {"_b": ps.classify(F.lit(1.0), joints(), box, ps.DECODED), "_a": ps.three_joint(joints(), box),
                      **ps.pose_metrics(joints(), box)})
    base, alt = F.col("_b"), F.col("_a")
    unknown = base["posture"] == "unknown"
    tried = unknown & (F.col("required_points") == 3)
    took = tried & alt["posture"].isin("upright", "down")
    return df.withColumns({
        "posture": base["posture"], "unknown_basis": F.when(unknown, base["basis"]),
        "unknown_required_points": F.when(unknown, F.col("required_points")),
        "three_joint_result": F.when(tried, alt["posture"]), "three_joint_basis": F.when(tried, alt["basis"]),
        "three_joint_accepted": F.when(tried, took),
        "corrected_posture": F.when(took, alt["posture"]).otherwise(base["posture"])}).drop("_a", "_b")


# Temporal trace -------------------------------------------------------------------------------------------------------
def temporal_trace(frames: DataFrame, keys: Sequence[str], cfg: PersistenceConfig) -> DataFrame:
    """Per frame: whether a qualified run is open, bridged unknowns, run starts and why a run ended here, if it did.

    ``frames``: keys, timestamp_ms (strictly increasing per key), posture, confidence, continuity_lost. The look-back
    runs inside time buckets and takes the rest from one row per earlier bucket.
    """
    keys, part = list(keys), [*keys, BUCKET]
    bridge, t, down = cfg.max_unknown_gap_ms, F.col("timestamp_ms"), F.col("posture") == "down"
    kind = F.when(down & (F.col("confidence") >= cfg.min_confidence), "D").when(
        (F.col("posture") == "unknown") & F.lit(bridge > 0), "U").otherwise("X")
    f = frames.withColumns({"kind": kind, BUCKET: F.floor(t / F.lit(cfg.bucket_ms)).cast("long")})
    w = Window.partitionBy(*part).orderBy("timestamp_ms")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = {"d": F.when(F.col("kind") == "D", t), "x": F.when(F.col("kind") == "X", t),
             "l": F.when(F.col("continuity_lost"), t)}
    ends = f.groupBy(*part).agg(*[F.max(e).alias(n) for n, e in marks.items()],
                                F.max(F.struct(t, down.alias("down"))).alias("r"))
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    f = f.join(ends.select(*part, *[F.max(n).over(earlier).alias("_c" + n) for n in (*marks, "r")]), part)
    here = F.struct(t, down.alias("down"))
    f = f.withColumns({
        "_d": F.greatest(F.max(marks["d"]).over(before), "_cd"),
        "_x": F.greatest(F.max(marks["x"]).over(before), "_cx"),
        "_l": F.greatest(F.max(marks["l"]).over(upto), "_cl"),  # a loss counts before the row reporting it
        "_r": F.coalesce(F.lag(here).over(w), F.col("_cr"))})
    d, prev = F.col("_d"), F.col("_r.timestamp_ms")
    gap = t - d
    # Open: nothing closed the run since its last sample, and the row before this one was still inside the bridge.
    is_open = F.coalesce(
        d.isNotNull() & F.coalesce(F.col("_x") < d, F.lit(True)) & F.coalesce(F.col("_l") <= d, F.lit(True))
        & (prev - d <= bridge), F.lit(False))
    late = is_open & (F.col("kind") == "D") & (prev > d) & (gap > bridge)
    ended = is_open & ((F.col("kind") == "X") | ((F.col("kind") == "U") & (gap > bridge)))
    bridged = is_open & (F.col("kind") == "U") & (gap <= bridge)
    reason = F.when(late, "unknown_gap_exceeded").when(ended & down, "down_confidence_below_threshold").when(
        ended, F.concat(F.lit("posture_"), "posture")).when(F.col("continuity_lost"), "detection_continuity_lost")
    return f.withColumns({
        "bridged": bridged, "bridged_gap_ms": F.when(bridged, gap), "reset_reason": reason,
        "starts_run": (F.col("kind") == "D") & (~is_open | late),
        "starts_raw_run": down & (F.col("continuity_lost") | ~F.coalesce(F.col("_r.down"), F.lit(False))),
    }).drop(BUCKET, "_d", "_x", "_l", "_r", *["_c" + n for n in (*marks, "r")])


def trace_totals(trace: DataFrame, keys: Sequence[str], bucket_ms: int = 3_600_000) -> DataFrame:
    """Per key: qualified and weak down frames, bridges, and the longest raw and qualified runs."""
    keys, down = list(keys), F.col("posture") == "down"
    out = trace.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "D").alias("qualified_down_frames"),
        F.count_if(down & (F.col("kind") != "D")).alias("low_confidence_down_frames"),
        F.count_if("bridged").alias("bridged_unknown_frames"),
        F.coalesce(F.max("bridged_gap_ms"), F.lit(0)).alias("longest_bridged_unknown_gap_ms"))
    for name, starts, member in (("raw", "starts_raw_run", down), ("qualified", "starts_run", F.col("kind") == "D")):
        r = run_lengths(trace, keys, F.col(starts), member, bucket_ms).withColumnsRenamed({
            "longest_ms": f"longest_{name}_run_ms", "longest_samples": f"longest_{name}_run_samples"})
        out = out.join(r, keys, "left")
    return out.na.fill(0)


def run_lengths(rows: DataFrame, keys: Sequence[str], starts: Column, member: Column, bucket_ms: int) -> DataFrame:
    """Longest run per key as (duration ms, samples), over rows where ``member`` holds; runs open at ``starts``.

    A run is named by its start; the name is found inside buckets and carried between them, then runs are grouped.
    """
    keys = list(keys)
    part = [*keys, BUCKET]
    m = rows.filter(member).withColumn("_s", F.when(starts, F.col("timestamp_ms"))).withColumn(
        BUCKET, F.floor(F.col("timestamp_ms") / F.lit(bucket_ms)).cast("long"))
    w = Window.partitionBy(*part).orderBy("timestamp_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = m.groupBy(*part).agg(F.max("_s").alias("_m")).select(*part, F.max("_m").over(
        Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    m = m.withColumn("_in", F.max("_s").over(w)).join(carry, part).withColumn("_run", F.coalesce("_in", "_c"))
    runs = m.groupBy(*keys, "_run").agg((F.max("timestamp_ms") - F.min("timestamp_ms")).alias("ms"), F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*keys).agg(F.max(F.struct("ms", "n")).alias("_b")).select(
        *keys, F.col("_b.ms").alias("longest_ms"), F.col("_b.n").alias("longest_samples"))
