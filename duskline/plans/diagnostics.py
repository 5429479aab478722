"""Pose, threshold and temporal diagnostics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import posture as ps
from ..operators import diagnostics as dg
from ..operators import poses as po
from ..operators.persistence import PersistenceConfig
from ..operators.scale import rank_limit
from .catalog import query
from .detections import rounded
from .views import cte, table, view

FRAME = list(po.FRAME)


def pose_box():
    return tuple(F.col(c) for c in po.POSE)


# Decoded poses: joint i of a row sits at heat-map cells derived from its numbers; some joints have no confidence.
_JX, _JY = "cast((l_partkey + i * (3 + line % 4)) % 57 as double)", "cast((l_suppkey * 3 + i * 2) % 32 as double)"
_JC = "cast((line + i * (1 + ordinal % 3) + ordinal) % 6 as double) / 5"
_POSE_COLS = """source_id, session_id, frame_index, det_ordinal as pose_ordinal, det_ordinal as ordinal, line,
  cast(floor(det_ordinal / 10000000) % 1000000 as bigint) as l_partkey, cast(floor(det_ordinal / 100) % 100000 as bigint) as l_suppkey,
  confidence as decoder_score"""


def poses(spark, sf):
    import re

    cols = re.sub(r"\s+", " ", _POSE_COLS)
    parts, depth, cur = [], 0, ""
    for ch in cols + ",":
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch
    v = view(spark, sf, "v_boxes")
    sel = rank_limit(v, FRAME, [F.col("det_ordinal")], 1).selectExpr(
        *FRAME, "x_min * 1000 sel_x_min", "y_min * 600 sel_y_min", "x_max * 1000 sel_x_max", "y_max * 600 sel_y_max")
    joint = [f"{_JX} joint_x", f"{_JY} joint_y", f"{_JC} joint_confidence"]
    flat = v.selectExpr(*parts).repartition(*FRAME).join(sel, FRAME).selectExpr("*", "explode(sequence(0, 16)) i")
    p = flat.selectExpr(*FRAME, "pose_ordinal", "decoder_score", *sel.columns[3:], "i joint_index", *joint)
    return p.withColumns({
        "frame_w": F.lit(1000), "frame_h": F.lit(600), "resized_w": F.lit(456), "resized_h": F.lit(256)})


_P = f"""
sel as (select source_id, session_id, frame_index, x_min * 1000 as sx1, y_min * 600 as sy1, x_max * 1000 as sx2,
          y_max * 600 as sy2 from v_boxes
        qualify row_number() over (partition by source_id, session_id, frame_index order by det_ordinal) = 1),
raw as (select {_POSE_COLS} from v_boxes),
j as (select *, {_JX} as jx, {_JY} as jy, least(1, {_JC}) as jc from (select raw.*, unnest(range(17)) as i from raw)),
m as (select source_id, session_id, frame_index, pose_ordinal, decoder_score, i, jc,
        least(1000, greatest(0, jx * (cast(1000 as double) / 456 * 8))) as px,
        least(600, greatest(0, jy * (cast(600 as double) / 256 * 8))) as py,
        jx * (cast(1000 as double) / 456 * 8) as ux, jy * (cast(600 as double) / 256 * 8) as uy from j where jc > 0),
c0 as (select source_id, session_id, frame_index, pose_ordinal, decoder_score, count(*) as valid_points, min(px) as x1, max(px) as x2, min(py) as y1,
    max(py) as y2, count(case when i in (5, 6, 11, 12) then 1 end) as required_points,
    count(case when px between sx1 and sx2 and py between sy1 and sy2 then 1 end) as all_inside,
    count(case when i in (5, 6, 11, 12) and px between sx1 and sx2 and py between sy1 and sy2 then 1 end) as required_inside,
    any_value(sx1) as sx1, any_value(sy1) as sy1, any_value(sx2) as sx2, any_value(sy2) as sy2,
    max(case when i = 5 then px end) as lsx, max(case when i = 5 then py end) as lsy, max(case when i = 5 then jc end) as lsc,
    max(case when i = 6 then px end) as rsx, max(case when i = 6 then py end) as rsy, max(case when i = 6 then jc end) as rsc,
    max(case when i = 11 then px end) as lhx, max(case when i = 11 then py end) as lhy, max(case when i = 11 then jc end) as lhc,
    max(case when i = 12 then px end) as rhx, max(case when i = 12 then py end) as rhy, max(case when i = 12 then jc end) as rhc
  from m join sel using (source_id, session_id, frame_index) group by 1, 2, 3, 4, 5),
c as (select *, case when least(x2, sx2) <= greatest(x1, sx1) or least(y2, sy2) <= greatest(y1, sy1) then cast(0 as double)
      else (least(x2, sx2) - greatest(x1, sx1)) * (least(y2, sy2) - greatest(y1, sy1)) / ((x2 - x1) * (y2 - y1)
        + (sx2 - sx1) * (sy2 - sy1) - (least(x2, sx2) - greatest(x1, sx1)) * (least(y2, sy2) - greatest(y1, sy1))) end as iou,
    sqrt(power((x1 + x2) / 2 - (sx1 + sx2) / 2, 2) + power((y1 + y2) / 2 - (sy1 + sy2) / 2, 2))
      / sqrt(power(sx2 - sx1, 2) + power(sy2 - sy1, 2)) as cd,
    sqrt(power(greatest(sx1 - x2, x1 - sx2, 0), 2) + power(greatest(sy1 - y2, y1 - sy2, 0), 2))
      / sqrt(power(sx2 - sx1, 2) + power(sy2 - sy1, 2)) as eg
  from c0 where valid_points >= 2 and x2 > x1 and y2 > y1)"""


@query("pose_geometry", cte("v_boxes", "with " + _P.strip() + """
select source_id, session_id, frame_index, pose_ordinal, valid_points, all_inside, required_points, required_inside,
  round(x1, 6) as pose_x_min, round(y1, 6) as pose_y_min, round(iou, 6) as selection_iou, round(cd, 6) as center_distance_norm,
  round(eg, 6) as edge_gap_norm, round((x2 - x1) / (sx2 - sx1), 6) as pose_width_ratio from c"""))
def pose_geometry(spark, sf):
    out = po.own_box_candidates(poses(spark, sf)).select(
        *FRAME, "pose_ordinal", "valid_points", "all_inside", "required_points", "required_inside", "pose_x_min",
        "pose_y_min", "selection_iou", "center_distance_norm", "edge_gap_norm", "pose_width_ratio")
    for c in out.columns[8:]:
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("pose_association", cte("v_boxes", "with " + _P.strip() + """
select source_id, session_id, frame_index, pose_ordinal, all_inside, round(iou, 6) as selection_iou from c
where required_points > 0 and (iou > 0 or all_inside > 0)
qualify row_number() over (partition by source_id, session_id, frame_index
  order by iou desc, all_inside desc, required_points desc, decoder_score desc, pose_ordinal) = 1"""))
def pose_association(spark, sf):
    a = po.associate(po.own_box_candidates(poses(spark, sf)))
    return a.select(*FRAME, "pose_ordinal", "all_inside", F.round("selection_iou", 6).alias("selection_iou"))


@query("pose_association_by_joints", cte("v_boxes", "with " + _P.strip() + """,
k as (select source_id, session_id, frame_index, pose_ordinal, decoder_score, count(*) as required_points,
        count(case when ux between sx1 and sx2 and uy between sy1 and sy2 then 1 end) as required_inside
      from m join sel using (source_id, session_id, frame_index) where i in (5, 6, 11, 12) group by 1, 2, 3, 4, 5),
b as (select * from k qualify row_number() over (partition by source_id, session_id, frame_index
        order by required_inside desc, required_points desc, decoder_score desc, pose_ordinal) = 1)
select source_id, session_id, frame_index, pose_ordinal, required_points, required_inside from b where required_inside > 0"""))
def pose_association_by_joints(spark, sf):
    a = po.associate_by_joints(po.selection_box_candidates(poses(spark, sf)))
    return a.select(*FRAME, "pose_ordinal", "required_points", "required_inside")


@query("pose_bounded_fallback", cte("v_boxes", "with " + _P.strip() + """,
n as (select source_id, session_id, frame_index, count(case when eg > 0 and eg <= 0.125 then 1 end) as near_count,
        min(case when eg > 0 and eg <= 0.125 then pose_ordinal end) as o from c where required_points > 0 group by all)
select source_id, session_id, frame_index, near_count, case when near_count = 0 then 'no_candidate_within_bound'
    when near_count > 1 then 'ambiguous_candidates_within_bound' else 'bounded_edge_gap' end as reason,
  case when near_count = 1 then o end as pose_ordinal from n"""))
def pose_bounded_fallback(spark, sf):
    return po.bounded_fallback(po.own_box_candidates(poses(spark, sf)))


_CORR = """,
q0 as (select *, least(lsc, rsc, lhc, rhc) as low, sqrt(power((lhx + rhx) / 2 - (lsx + rsx) / 2, 2)
      + power((lhy + rhy) / 2 - (lsy + rsy) / 2, 2)) as torso, abs((lhx + rhx) / 2 - (lsx + rsx) / 2) as dx,
    abs((lhy + rhy) / 2 - (lsy + rsy) / 2) as dy, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) as diag,
    case when lsx is not null and lhx is not null then lhx - lsx when rsx is not null and rhx is not null then rhx - rsx end as tx,
    case when lsx is not null and lhx is not null then lhy - lsy when rsx is not null and rhx is not null then rhy - rsy end as ty
  from c where required_points > 0),
q1 as (select *, case when required_points < 4 then 'required_keypoints_missing'
    when low < {kp} then 'required_keypoint_confidence_below_threshold'
    when torso < diag * cast(0.1 as double) then 'torso_geometry_too_small'
    when dy / torso >= cast(0.7 as double) and (y2 - y1) / (x2 - x1) >= cast(1.15 as double) then 'vertical_torso_and_tall_bbox'
    when dx / torso >= cast(0.7 as double) and (x2 - x1) / (y2 - y1) >= cast(1.15 as double) then 'horizontal_torso_and_wide_bbox'
    else 'geometry_not_decisive' end as basis4,
    case when required_points <> 3 then null when low < {kp} then 'three_point_required_keypoint_confidence_below_threshold'
    when tx is null then 'three_point_complete_side_missing'
    when sqrt(tx * tx + ty * ty) < diag * cast(0.1 as double) then 'three_point_torso_geometry_too_small'
    when abs(ty) / sqrt(tx * tx + ty * ty) >= cast(0.7 as double) and (y2 - y1) / (x2 - x1) >= cast(1.15 as double) then 'three_point_vertical_torso_and_tall_bbox'
    when abs(tx) / sqrt(tx * tx + ty * ty) >= cast(0.7 as double) and (x2 - x1) / (y2 - y1) >= cast(1.15 as double) then 'three_point_horizontal_torso_and_wide_bbox'
    else 'three_point_geometry_not_decisive' end as basis3 from q0),
q as (select *, case basis4 when 'vertical_torso_and_tall_bbox' then 'upright' when 'horizontal_torso_and_wide_bbox' then 'down'
      when 'geometry_not_decisive' then 'other' else 'unknown' end as posture4,
    case basis3 when 'three_point_vertical_torso_and_tall_bbox' then 'upright'
      when 'three_point_horizontal_torso_and_wide_bbox' then 'down' else 'unknown' end as posture3 from q1)"""
_CORR10 = _CORR.replace("{kp}", "cast(0.1 as double)")


def _candidates(spark, sf):
    return po.own_box_candidates(poses(spark, sf)).filter("required_points > 0")


@query("posture_classification", cte("v_boxes", "with " + _P.strip() + _CORR10 + """
select source_id, session_id, frame_index, pose_ordinal, posture4 as posture, basis4 as basis,
  coalesce(posture3, '') as three_joint_posture, coalesce(basis3, 'three_point_fallback_not_applicable') as three_joint_basis,
  case when posture4 = 'unknown' and required_points = 3 then posture3 else posture4 end as corrected_posture,
  case when posture4 = 'other' and abs(dx / torso - dy / torso) <= cast(0.02 as double) then 'diagonal_torso_ambiguous'
       when posture4 = 'unknown' and required_points = 3 then basis3 else basis4 end as bounded_basis from q"""))
def posture_classification(spark, sf):
    one, jm = F.lit(1.0), po.joints()
    c = _candidates(spark, sf)
    base, alt = ps.classify(one, jm, pose_box(), ps.DECODED), ps.three_joint(jm, pose_box())
    return c.select(*FRAME, "pose_ordinal", base["posture"].alias("posture"), base["basis"].alias("basis"),
                    alt["posture"].alias("three_joint_posture"), alt["basis"].alias("three_joint_basis"),
                    ps.corrected(one, jm, pose_box())["posture"].alias("corrected_posture"),
                    ps.bounded(one, jm, pose_box())["basis"].alias("bounded_basis"))


@query("posture_sensitivity", cte("v_boxes", "with " + _P.strip() + _CORR.replace("{kp}", "g.k").replace(
    "from q0)", "from q0 cross join (select unnest([0.35, 0.2, 0.1, 0.05, 0.02]::double[]) as k) g)").replace(
    "q1 as (select *,", "q1 as (select q0.*, g.k,") + """
select source_id, p.pf as pose_floor, k as keypoint_floor,
  case when decoder_score < p.pf then 'unknown' else posture4 end as posture, count(*) as n
from q cross join (select unnest([0.35, 0.1]::double[]) as pf) p group by all"""))
def posture_sensitivity(spark, sf):
    c = _candidates(spark, sf).withColumn("pose_confidence", F.col("decoder_score"))
    return dg.posture_sensitivity(c, ["source_id"], pose_box())


@query("posture_quality_counts", cte("v_boxes", "with " + _P.strip() + _CORR10 + """,
t as (select source_id, required_points, posture4, case when posture4 = 'unknown' then basis4 end as unknown_basis,
    case when posture4 = 'unknown' then required_points end as unknown_required_points,
    case when posture4 = 'unknown' and required_points = 3 then posture3 end as three_joint_result,
    case when posture4 = 'unknown' and required_points = 3 then posture3 else posture4 end as corrected_posture from q),
u as (select source_id, 'unknown_basis' as metric, unknown_basis as value from t union all
  select source_id, 'unknown_required_points', cast(unknown_required_points as varchar) from t union all
  select source_id, 'three_joint_result', three_joint_result from t union all
  select source_id, 'corrected_posture', corrected_posture from t)
select source_id, metric, value, count(*) as n from u where value is not null group by all"""))
def posture_quality_counts(spark, sf):
    q = dg.posture_quality(_candidates(spark, sf), ["source_id"], pose_box())
    return dg.long_counts(q, ["source_id"], ["unknown_basis", "unknown_required_points", "three_joint_result",
                                             "corrected_posture"])


@query("posture_quality_metrics", cte("v_boxes", "with " + _P.strip() + _CORR10 + """,
t as (select source_id, posture4 as posture, case when required_points = 4 then torso / diag end as torso_fraction,
    case when torso > 0 then dy / torso end as vertical_fraction, case when required_points = 4 then (x2 - x1) / (y2 - y1) end as wh from q),
u as (select source_id, posture, 'torso_fraction' as metric, torso_fraction as v from t union all
  select source_id, posture, 'vertical_fraction', vertical_fraction from t union all
  select source_id, posture, 'width_over_height', wh from t)
select source_id, posture, metric, count(v) as n, round(min(v), 6) as min, round(quantile_disc(v, 0.5), 6) as p50,
  round(quantile_disc(v, 0.9), 6) as p90, round(max(v), 6) as max from u where v is not null group by all"""))
def posture_quality_metrics(spark, sf):
    q = dg.posture_quality(_candidates(spark, sf), ["source_id"], pose_box())
    s = dg.long_stats(q, ["source_id", "posture"], ["torso_fraction", "vertical_fraction", "width_over_height"], True)
    return s.select("source_id", "posture", "metric", "n", *[F.round(c, 6).alias(c) for c in ("min", "p50", "p90", "max")])


@query("pose_confidence_stats", cte("v_boxes", "with " + _P.strip() + """
select source_id, metric, count(v) as n, round(min(v), 9) as min, round(avg(v), 6) as mean, round(max(v), 9) as max from (
  select source_id, 'decoder_score' as metric, decoder_score as v from c where required_points > 0 union all
  select source_id, 'selection_iou', iou from c where required_points > 0) group by all"""))
def pose_confidence_stats(spark, sf):
    s = dg.long_stats(_candidates(spark, sf), ["source_id"], ["decoder_score", "selection_iou"])
    return s.select("source_id", "metric", "n", F.round("min", 9).alias("min"), F.round("mean", 6).alias("mean"),
                    F.round("max", 9).alias("max"))


def _pose_frames(spark, sf):
    """One row per frame with candidates: association outcome, bounded posture and nearest-pose metrics."""
    one, jm = F.lit(1.0), po.joints()
    c = po.associated_or_fallback(po.own_box_candidates(poses(spark, sf)))
    none = ~F.col("associated")
    bnd = ps.bounded(one, jm, tuple(F.when(F.col("associated"), b) for b in pose_box()))
    return c.withColumns({"posture": bnd["posture"], "basis": bnd["basis"],
                          "unmatched_required_points": F.when(none, F.col("required_points")),
                          "unmatched_edge_gap": F.when(none, F.col("edge_gap_norm"))})


_FALL = """,
w as (select *, (iou > 0 or all_inside > 0) as touch, eg > 0 and eg <= 0.125 as near from c where required_points > 0),
fr as (select source_id, session_id, frame_index, bool_or(touch) as any_touch, count(case when near then 1 end) as nn,
    first(pose_ordinal order by touch desc, iou desc, all_inside desc, required_points desc, decoder_score desc, pose_ordinal) as tp,
    min(case when near then pose_ordinal end) as np,
    first(pose_ordinal order by eg, cd, valid_points desc, decoder_score desc, pose_ordinal) as nearest,
    case when bool_or(touch) then 'baseline_overlap' when count(case when near then 1 end) = 0 then 'no_candidate_within_bound'
      when count(case when near then 1 end) > 1 then 'ambiguous_candidates_within_bound' else 'bounded_edge_gap' end as reason
  from w group by 1, 2, 3),
pick as (select source_id, session_id, frame_index, reason, case when any_touch then tp when nn = 1 then np end as chosen, nearest from fr)"""


@query("fragmentation_reasons", cte("v_boxes", "with " + _P.strip() + _FALL + """
select source_id, reason as value, 'association_reason' as metric, count(*) as n from pick group by all union all
select p.source_id, cast(w.required_points as varchar), 'unmatched_required_points', count(*) from pick p join w
  on w.source_id = p.source_id and w.frame_index = p.frame_index and w.pose_ordinal = p.nearest
where p.chosen is null group by all"""))
def fragmentation_reasons(spark, sf):
    return dg.long_counts(_pose_frames(spark, sf), ["source_id"], ["association_reason", "unmatched_required_points"])


@query("fragmentation_windows")
def fragmentation_windows(spark, sf):
    f = _pose_frames(spark, sf).withColumn("sample_id", F.col("source_id")).withColumn(
        "timestamp_ms", F.col("frame_index") * 40)
    labels = f.groupBy("sample_id").agg((F.max("timestamp_ms") / 3).cast("long").alias("start_ms"),
                                        (F.max("timestamp_ms") / 2).cast("long").alias("end_ms"))
    g = dg.overall_and_windows(dg.with_window(f, labels, otherwise="overall"), ["sample_id"])
    return dg.long_counts(g, ["sample_id", "window"], ["association_reason", "posture", "basis"])


@query("association_geometry", cte("v_boxes", "with " + _P.strip() + _FALL + """
select p.source_id, count(*) as n, round(min(eg), 6) as min, round(quantile_disc(eg, 0.5), 6) as p50,
  round(quantile_disc(eg, 0.9), 6) as p90, round(max(eg), 6) as max, 'unmatched_edge_gap' as metric
from pick p join w on w.source_id = p.source_id and w.frame_index = p.frame_index and w.pose_ordinal = p.nearest
where p.chosen is null group by all"""))
def association_geometry(spark, sf):
    s = dg.long_stats(_pose_frames(spark, sf), ["source_id"], ["unmatched_edge_gap"], True)
    return s.select("source_id", "metric", "n", *[F.round(c, 6).alias(c) for c in ("min", "p50", "p90", "max")])


@query("decoded_pose_totals", cte("v_boxes", "with " + _P.strip() + """,
f as (select source_id, session_id, frame_index, count(*) as decoded from v_boxes group by all),
a as (select distinct source_id, session_id, frame_index from c where required_points > 0 and (iou > 0 or all_inside > 0))
select f.source_id, count(*) as frames, count(*) as selected_frames, count(case when frame_index % 10 > 0 then 1 end) as inferred_frames,
  count(case when frame_index % 10 > 0 then 1 end) as frames_with_decoded_pose,
  cast(sum(case when frame_index % 10 > 0 then decoded else 0 end) as bigint) as total_decoded_poses,
  count(case when frame_index % 10 > 0 and decoded > 1 then 1 end) as multi_pose_frames,
  count(case when frame_index % 10 > 0 and a.source_id is not null then 1 end) as associated_frames,
  cast(1 as double) as selection_coverage,
  round(count(case when frame_index % 10 > 0 and a.source_id is not null then 1 end)
    / cast(count(case when frame_index % 10 > 0 then 1 end) as double), 9) as association_fraction
from f left join a using (source_id, session_id, frame_index) group by 1"""))
def decoded_pose_totals(spark, sf):
    p = poses(spark, sf)
    n = view(spark, sf, "v_boxes").groupBy(*FRAME).agg(F.count(F.lit(1)).alias("_n"))
    a = po.associate(po.own_box_candidates(p)).select(*FRAME, F.lit(True).alias("associated"))
    f = n.join(a, FRAME, "left").na.fill(False, ["associated"]).withColumns({
        "selected": F.lit(True), "decoded_count": F.when(F.col("frame_index") % 10 > 0, F.col("_n"))})
    return rounded(dg.decoded_pose_totals(f, ["source_id"]), "association_fraction")


_SWEEP_LABELS = """
lab as (select concat('cam-', k) as sample_id, cast(k * 2000 as bigint) * 40 as start_ms, cast(k * 2000 + 4000 as bigint) * 40 as end_ms
        from (select unnest(range(8)) as k)),
fr as (select distinct source_id as sample_id, frame_index, timestamp_ms from v_boxes),
fw as (select fr.*, case when timestamp_ms < start_ms then 'before' when timestamp_ms <= end_ms then 'during' else 'after' end as window
       from fr join lab using (sample_id))"""


def _labels(spark):
    return spark.range(8).selectExpr("concat('cam-', id) sample_id", "id * 2000 * 40 start_ms", "(id * 2000 + 4000) * 40 end_ms")


@query("window_labels", cte("v_boxes", "with " + _SWEEP_LABELS.strip() + " select sample_id, frame_index, \"window\" from fw"))
def window_labels(spark, sf):
    fr = view(spark, sf, "v_boxes").select(F.col("source_id").alias("sample_id"), "frame_index", "timestamp_ms").distinct()
    return dg.with_window(fr, _labels(spark)).select("sample_id", "frame_index", "window")


@query("threshold_sweep", cte("v_boxes", "with " + _SWEEP_LABELS.strip() + """,
th as (select unnest([0.5, 0.4, 0.3, 0.2, 0.1]::double[]) as threshold),
n as (select fw.sample_id, fw.frame_index, "window", threshold, (select count(*) from v_boxes b where b.source_id = fw.sample_id
        and b.frame_index = fw.frame_index and b.confidence >= threshold) as c from fw, th)
select sample_id, "window", threshold, count(*) as frames, count(case when c > 0 then 1 end) as frames_with_detection,
  cast(sum(c) as bigint) as detections, count(case when c > 1 then 1 end) as duplicate_frames,
  cast(sum(greatest(c - 1, 0)) as bigint) as duplicate_excess,
  round(count(case when c > 0 then 1 end) / cast(count(*) as double), 9) as coverage,
  round(count(case when c > 1 then 1 end) / cast(count(*) as double), 9) as duplicate_frame_rate from n group by all"""))
def threshold_sweep(spark, sf):
    v = view(spark, sf, "v_boxes").withColumn("sample_id", F.col("source_id"))
    fr = dg.with_window(v.select("sample_id", "frame_index", "timestamp_ms").distinct(), _labels(spark))
    out = dg.threshold_sweep(fr, v, ["sample_id", "frame_index"], ["sample_id", "window"])
    return rounded(out, "coverage", "duplicate_frame_rate")


_MODELS = """
models as (select p_brand as model, min(p_partkey % 90) / cast(100 as double) + cast(0.2 as double) as positive_during_coverage,
    least(1, max(p_partkey % 120) / cast(100 as double)) as negative_coverage, cast(sum(p_size) as bigint) as artifact_bytes,
    cast(avg(p_retailprice) as double) as detector_fps, max(p_size) / cast(1000 as double) as dup from part group by p_brand)"""


def _models(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("model")).agg(
        F.expr("min(p_partkey % 90) / cast(100 as double) + cast(0.2 as double) positive_during_coverage"),
        F.expr("least(1, max(p_partkey % 120) / cast(100 as double)) negative_coverage"),
        F.sum("p_size").alias("artifact_bytes"), F.avg("p_retailprice").alias("detector_fps"),
        F.expr("max(p_size) / cast(1000 as double) dup"))


@query("material_candidate", "with " + _MODELS.strip() + """,
b as (select least(1, positive_during_coverage + 0.25) as need from models where model = 'Brand#1')
select model from models, b where model <> 'Brand#1' and positive_during_coverage >= need and negative_coverage >= 0.9
order by artifact_bytes, detector_fps desc, model limit 1""")
def material_candidate(spark, sf):
    return dg.material_candidate(_models(spark, sf), "Brand#1")


@query("threshold_choice", "with " + _MODELS.strip() + """
select max(case when positive_during_coverage + 0.3 >= 0.55 and negative_coverage >= 0.9 and dup <= 0.05
                then artifact_bytes / cast(1000 as double) end) as threshold from models""")
def threshold_choice(spark, sf):
    m = _models(spark, sf).selectExpr(
        "positive_during_coverage + cast(0.3 as double) positive_during_coverage", "negative_coverage",
        "dup positive_duplicate_frame_rate", "dup negative_duplicate_frame_rate",
        "artifact_bytes / cast(1000 as double) threshold")
    return dg.choose_threshold(m)


@query("shootout_coverage", cte("v_boxes", """
with f as (select source_id, category as model, frame_index, count(case when confidence >= 0.6 then 1 end) as people
           from v_boxes group by all)
select source_id, model, count(*) as frames, count(case when people > 0 then 1 end) as frames_with_detection,
  cast(sum(people) as bigint) as detections, round(count(case when people > 0 then 1 end) / cast(count(*) as double), 9) as coverage
from f group by all"""))
def shootout_coverage(spark, sf):
    f = view(spark, sf, "v_boxes").groupBy("source_id", F.col("category").alias("model"), "frame_index").agg(
        F.count_if(F.col("confidence") >= 0.6).alias("people"))
    return rounded(dg.shootout_coverage(f, ["source_id", "model"]), "coverage")


@query("stage_totals", cte("v_obs", """
with f as (select source_id, timestamp_ms, count(*) as d, count(case when posture <> 'unknown' then 1 end) as p from v_obs group by all),
a as (select source_id, count(*) as frames, count(case when d > 0 then 1 end) as frames_with_detection, cast(sum(d) as bigint) as detections,
  count(case when p > 0 then 1 end) as frames_with_pose, cast(sum(p) as bigint) as pose_candidates from f group by all),
o as (select source_id, count(case when posture = 'upright' then 1 end) as posture_upright, count(case when posture = 'down' then 1 end) as posture_down,
  count(case when posture = 'other' then 1 end) as posture_other, count(case when posture = 'unknown' then 1 end) as posture_unknown,
  count(track_id) as track_assignments, count(distinct track_id) as distinct_tracks from v_obs group by all)
select * from a join o using (source_id)"""))
def stage_totals(spark, sf):
    o = view(spark, sf, "v_obs")
    f = o.groupBy("source_id", "timestamp_ms").agg(F.count(F.lit(1)).alias("detections"),
                                                   F.count_if(F.col("posture") != "unknown").alias("poses"))
    return dg.stage_totals(f, ["source_id"], o)


TRACE = PersistenceConfig(max_unknown_gap_ms=750, bucket_ms=5_000)
_TRACE = """
v as (select source_id, track_id, timestamp_ms, posture, confidence, ordinal % 13 = 0 as lost, posture = 'down' as down,
    case when posture = 'down' and confidence >= 0.7 then 'D' when posture = 'unknown' then 'U' else 'X' end as kind
  from v_obs qualify row_number() over (partition by source_id, track_id, timestamp_ms order by ordinal) = 1),
n as (select *, row_number() over (partition by source_id, track_id order by timestamp_ms) as rn from v),
walk as (
  select source_id, track_id, rn, timestamp_ms, posture, kind, down, case when kind = 'D' then timestamp_ms end as run_start,
    case when kind = 'D' then 1 else 0 end as cnt, case when kind = 'D' then timestamp_ms end as last_d, false as unk,
    case when down then timestamp_ms end as raw_start, case when down then 1 else 0 end as raw_cnt,
    case when lost then 'detection_continuity_lost' end as reason, cast(null as bigint) as bridged from n where rn = 1
  union all
  select n.source_id, n.track_id, n.rn, n.timestamp_ms, n.posture, n.kind, n.down,
    case when n.kind = 'D' then case when s.fresh then n.timestamp_ms else w.run_start end when s.keep then w.run_start end,
    case when n.kind = 'D' then case when s.fresh then 1 else w.cnt + 1 end when s.keep then w.cnt else 0 end,
    case when n.kind = 'D' then n.timestamp_ms when s.keep then w.last_d end,
    case when n.kind = 'D' then false when s.keep then true else false end,
    case when n.down then case when n.lost or w.raw_start is null then n.timestamp_ms else w.raw_start end end,
    case when n.down then case when n.lost or w.raw_start is null then 1 else w.raw_cnt + 1 end else 0 end,
    case when n.lost then 'detection_continuity_lost' when n.kind = 'D' and s.live and w.unk and n.timestamp_ms - w.last_d > 750 then 'unknown_gap_exceeded'
      when n.kind <> 'D' and s.live and not s.keep then case when n.down then 'down_confidence_below_threshold' else 'posture_' || n.posture end end,
    case when s.keep then n.timestamp_ms - w.last_d end
  from walk w join n on n.source_id = w.source_id and n.track_id = w.track_id and n.rn = w.rn + 1,
  lateral (select w.cnt > 0 and not n.lost as live,
     n.kind = 'U' and w.cnt > 0 and not n.lost and n.timestamp_ms - w.last_d <= 750 as keep,
     w.cnt = 0 or n.lost or (w.unk and n.timestamp_ms - w.last_d > 750) as fresh) s)"""


def _trace(spark, sf):
    f = view(spark, sf, "v_obs").groupBy("source_id", "track_id", "timestamp_ms").agg(
        F.min(F.struct("ordinal", "posture", "confidence")).alias("r")).select(
        "source_id", "track_id", "timestamp_ms", "r.posture", "r.confidence", (F.col("r.ordinal") % 13 == 0).alias("continuity_lost"))
    return dg.temporal_trace(f, ["source_id", "track_id"], TRACE)


@query("temporal_trace_rows", cte("v_obs", "with " + _TRACE.strip() + """
select source_id, track_id, timestamp_ms, reason as reset_reason, bridged as bridged_gap_ms from walk"""))
def temporal_trace_rows(spark, sf):
    return _trace(spark, sf).select("source_id", "track_id", "timestamp_ms", "reset_reason", "bridged_gap_ms")


@query("temporal_trace_totals", cte("v_obs", "with " + _TRACE.strip() + """
select source_id, track_id, count(case when kind = 'D' then 1 end) as qualified_down_frames,
  count(case when down and kind <> 'D' then 1 end) as low_confidence_down_frames, count(bridged) as bridged_unknown_frames,
  coalesce(max(bridged), 0) as longest_bridged_unknown_gap_ms,
  coalesce(max(case when down then timestamp_ms - raw_start end), 0) as longest_raw_run_ms,
  cast(coalesce(arg_max(raw_cnt, (timestamp_ms - raw_start) * 100000 + raw_cnt), 0) as bigint) as longest_raw_run_samples,
  coalesce(max(case when kind = 'D' then timestamp_ms - run_start end), 0) as longest_qualified_run_ms,
  cast(coalesce(arg_max(case when kind = 'D' then cnt end, case when kind = 'D' then (timestamp_ms - run_start) * 100000 + cnt end), 0) as bigint) as longest_qualified_run_samples
from walk group by all"""))
def temporal_trace_totals(spark, sf):
    return dg.trace_totals(_trace(spark, sf), ["source_id", "track_id"], bucket_ms=5_000)


@query("temporal_reset_reasons", cte("v_obs", "with " + _TRACE.strip() + """
select source_id, 'reset_reason' as metric, reason as value, count(*) as n from walk where reason is not null group by all"""))
def temporal_reset_reasons(spark, sf):
    return dg.long_counts(_trace(spark, sf), ["source_id"], ["reset_reason"])
