"""Tracker, continuity and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import matching as mt
from ..operators import tracking as tr
from .catalog import query
from .detections import BOXES, rounded
from .views import cte, table, view

SES = ["source_id", "session_id"]
CHUNK = 4096


def _tracks(spark, sf, machine):
    return tr.track(view(spark, sf, "v_lanes"), machine, chunk_frames=CHUNK)


def _truth_and_tracks(spark, sf):
    v = view(spark, sf, "v_boxes").select(*SES, "frame_index", "category", "line", "det_ordinal", *BOXES)
    truth = v.filter("line % 2 = 0").withColumn("object_id", F.concat(F.lit("o"), F.col("det_ordinal")))
    tracks = v.filter("line % 2 = 1").withColumn("track_id", F.concat(F.lit("t"), F.col("det_ordinal")))
    return truth, tracks


@query("track_overlap")
def track_overlap(spark, sf):
    return _tracks(spark, sf, tr.OverlapTracker)


@query("track_two_stage")
def track_two_stage(spark, sf):
    return _tracks(spark, sf, tr.TwoStageTracker)


@query("track_one_frame")
def track_one_frame(spark, sf):
    return _tracks(spark, sf, tr.OneFrameTracker)


def _selection(spark, sf, fallback=False):
    v = view(spark, sf, "v_lanes")
    people = v.filter("category = 'person' and confidence >= 0.4")
    if fallback:
        # Boxes of line 6 stand for a turned view, already mapped back to the source frame.
        people = people.withColumn("turn", F.when(F.col("line") == 6, 1).otherwise(0).cast("long"))
    return tr.continuity(people, v, fallback=fallback, chunk_frames=CHUNK)


@query("continuity_selection")
def continuity_selection(spark, sf):
    return _selection(spark, sf)


@query("continuity_orientation_fallback")
def continuity_orientation_fallback(spark, sf):
    return _selection(spark, sf, True)


@query("continuity_totals")
def continuity_totals(spark, sf):
    return tr.continuity_totals(_selection(spark, sf))


@query("tracker_head_to_head")
def tracker_head_to_head(spark, sf):
    truth = view(spark, sf, "v_lanes").withColumn("object_id", F.col("det_ordinal").cast("string"))
    out = None
    for name, machine in (("two_stage", tr.TwoStageTracker), ("one_frame", tr.OneFrameTracker)):
        m = ev.tracking_metrics(truth, _tracks(spark, sf, machine)).withColumn("tracker", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


_EDGE = """
t as (select *, concat('o', det_ordinal) as object_id from v_boxes where line % 2 = 0),
p as (select *, concat('t', det_ordinal) as track_id from v_boxes where line % 2 = 1),
e as (select t.source_id, t.session_id, t.frame_index, t.category, t.object_id, p.track_id,
    (least(t.x_max, p.x_max) - greatest(t.x_min, p.x_min)) * (least(t.y_max, p.y_max) - greatest(t.y_min, p.y_min)) as i,
    (t.x_max - t.x_min) * (t.y_max - t.y_min) as t_area, (p.x_max - p.x_min) * (p.y_max - p.y_min) as p_area
  from t join p on t.source_id = p.source_id and t.session_id = p.session_id and t.frame_index = p.frame_index
    and t.category = p.category
  where least(t.x_max, p.x_max) > greatest(t.x_min, p.x_min) and least(t.y_max, p.y_max) > greatest(t.y_min, p.y_min)),
edge as (select *, i / (t_area + p_area - i) as iou from e)"""


@query("match_edges", cte("v_boxes", "with " + _EDGE.strip() + """
select source_id, session_id, frame_index, category, object_id as left_id, track_id as right_id, round(iou, 9) as weight
from edge where iou >= 0.1"""))
def match_edges(spark, sf):
    truth, tracks = _truth_and_tracks(spark, sf)
    return rounded(mt.edges(truth, tracks, [*SES, "frame_index"], "object_id", "track_id", 0.1), "weight")


# Exhaustive oracle: every one-to-one subset of a frame's edges, best count first, then best weight.
_BEST = """
g as (select source_id, session_id, frame_index, object_id, track_id, iou, row_number() over
        (partition by source_id, session_id, frame_index order by object_id, track_id) as k from edge where iou >= 0.1),
sub as (
  select source_id, session_id, frame_index, k, [object_id] as os, [track_id] as ts, iou as w from g
  union all
  select s.source_id, s.session_id, s.frame_index, g.k, list_append(s.os, g.object_id), list_append(s.ts, g.track_id),
    s.w + g.iou from sub s join g on s.source_id = g.source_id and s.session_id = g.session_id
    and s.frame_index = g.frame_index and g.k > s.k
    and not list_contains(s.os, g.object_id) and not list_contains(s.ts, g.track_id))"""


@query("match_frame_totals", cte("v_boxes", "with " + _EDGE.strip() + "," + _BEST + """
select source_id, session_id, frame_index, cast(max(len(os)) as bigint) as pairs,
  round(max_by(w, len(os) * 1000 + w), 9) as total_weight from sub group by all"""))
def match_frame_totals(spark, sf):
    truth, tracks = _truth_and_tracks(spark, sf)
    frame = [*SES, "frame_index"]
    pairs = mt.best_pairs(mt.edges(truth, tracks, frame, "object_id", "track_id", 0.1), frame)
    return pairs.groupBy(*frame).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("weight"), 9).alias("total_weight"))


_PER_SESSION = """
best as (select source_id, session_id, frame_index, max(len(os)) as m, max_by(w, len(os) * 1000 + w) as w
         from sub group by all),
gt as (select source_id, session_id, count(*) as n from t group by all),
tk as (select source_id, session_id, count(*) as n from p group by all),
fr as (select source_id, session_id, count(distinct frame_index) as n from v_boxes group by all),
mm as (select source_id, session_id, sum(m) as m, sum(w) as w from best group by all)
select fr.source_id, fr.session_id, fr.n as frames, gt.n as ground_truth_observations,
  cast(mm.m as bigint) as matched_observations, cast(gt.n - mm.m as bigint) as misses,
  cast(tk.n - mm.m as bigint) as false_track_observations, round(mm.w / mm.m, 6) as mean_matched_iou,
  round(cast(mm.m as double) / gt.n, 9) as continuity
from fr join gt using (source_id, session_id) join tk using (source_id, session_id) join mm using (source_id, session_id)"""


@query("tracking_metrics", cte("v_boxes", "with " + _EDGE.strip() + "," + _BEST + "," + _PER_SESSION))
def tracking_metrics(spark, sf):
    truth, tracks = _truth_and_tracks(spark, sf)
    m = ev.tracking_metrics(truth, tracks, min_iou=0.1).drop("id_switches", "fragmentations")
    return m.withColumn("mean_matched_iou", F.round("mean_matched_iou", 6)).withColumn(
        "continuity", F.round("continuity", 9))


_SWITCH = """
o as (select source_id, frame_index, cast(line as varchar) as object_id,
        case when det_ordinal % 3 > 0 then concat('k', cast(line as varchar), '-', cast(floor(frame_index / 40) % 5 as bigint)) end as track_id
      from (select source_id, frame_index, line, min(det_ordinal) as det_ordinal from v_lanes group by all)),
w as (select *, last_value(track_id ignore nulls) over (partition by source_id, object_id order by frame_index
          rows between unbounded preceding and 1 preceding) as pt,
        lag(track_id is not null) over (partition by source_id, object_id order by frame_index) as ph from o)
select source_id, 's0' as session_id, count(case when track_id is not null and pt <> track_id then 1 end) as id_switches,
  count(case when track_id is not null and pt is not null and not ph then 1 end) as fragmentations from w group by all"""


@query("tracking_switches", cte("v_lanes", "with " + _SWITCH.strip()))
def tracking_switches(spark, sf):
    one = view(spark, sf, "v_lanes").groupBy(*SES, "frame_index", "line").agg(F.min("det_ordinal").alias("o"))
    # One lane per object; the truth box is the lane, the track box equals it when the track saw it.
    lane = one.withColumns({
        "object_id": F.col("line").cast("string"), "category": F.lit("person"), "x_min": F.col("line") / 10.0,
        "y_min": F.lit(0.0), "x_max": F.col("line") / 10.0 + 0.05, "y_max": F.lit(1.0)})
    name = F.concat(F.lit("k"), F.col("line"), F.lit("-"), (F.floor(F.col("frame_index") / 40) % 5).cast("string"))
    tracks = lane.filter("o % 3 > 0").withColumn("track_id", name)
    m = ev.tracking_metrics(lane, tracks, min_iou=0.5, bucket_frames=200)
    return m.select(*SES, "id_switches", "fragmentations")


# Candidate evaluation -----------------------------------------------------------------------------------------------
_EVAL = """
labels as (select concat('s', o_custkey) as sample_id, concat('l', o_orderkey) as label_id,
    o_custkey * 100000 + o_orderkey % 50000 as start_ms, o_custkey * 100000 + o_orderkey % 50000 + 3000 as end_ms
  from orders where o_orderkey % 2 = 0),
events as (select concat('s', o_custkey) as sample_id, concat('e', o_orderkey) as event_id,
    o_custkey * 100000 + o_orderkey % 50000 as start_ms, o_custkey * 100000 + o_orderkey % 50000 + 2000 as end_ms
  from orders where o_orderkey % 2 = 1)"""


def _eval_inputs(spark, sf):
    o = table(spark, sf, "orders")
    base = "o_custkey * 100000 + o_orderkey % 50000"
    labels = o.filter("o_orderkey % 2 = 0").selectExpr(
        "concat('s', o_custkey) sample_id", "concat('l', o_orderkey) label_id", f"{base} start_ms", f"{base} + 3000 end_ms")
    events = o.filter("o_orderkey % 2 = 1").selectExpr(
        "concat('s', o_custkey) sample_id", "concat('e', o_orderkey) event_id", f"{base} start_ms", f"{base} + 2000 end_ms")
    return view(spark, sf, "v_samples"), events, labels


@query("candidate_evaluation_counts", cte("v_samples", "with " + _EVAL.strip() + """
select s.sample_id, s.end_ms - s.start_ms as duration_ms,
  (select count(*) from labels l where l.sample_id = s.sample_id) as positive_episodes,
  (select count(*) from events e where e.sample_id = s.sample_id) as candidate_events from v_samples s"""))
def candidate_evaluation_counts(spark, sf):
    r = ev.evaluate_candidates(*_eval_inputs(spark, sf), tolerance_ms=1500)
    return r.select("sample_id", "duration_ms", "positive_episodes", "candidate_events")


# With intervals this short a greedy by end time is a recursive walk per sample: state = the labels already used.
_WALK = _EVAL.strip() + """,
e as (select *, row_number() over (partition by sample_id order by end_ms, start_ms, event_id) as k from events),
walk as (
  select sample_id, 0 as k, cast([] as varchar[]) as used, cast(null as varchar) as event_id,
    cast(null as varchar) as label_id, cast(null as bigint) as delay_ms from (select distinct sample_id from events)
  union all
  select w.sample_id, w.k + 1, case when c.label_id is null then w.used else list_append(w.used, c.label_id) end,
    e.event_id, c.label_id, e.end_ms - c.start_ms
  from walk w join e on e.sample_id = w.sample_id and e.k = w.k + 1
  left join lateral (select l.label_id, l.start_ms from labels l where l.sample_id = w.sample_id
      and l.start_ms - 1500 <= e.end_ms and l.end_ms + 1500 >= e.start_ms and not list_contains(w.used, l.label_id)
      order by l.end_ms, l.start_ms, l.label_id limit 1) c on true)"""


@query("interval_matches", "with recursive " + _WALK + """
select sample_id, event_id, label_id, delay_ms from walk where label_id is not null""")
def interval_matches(spark, sf):
    _, events, labels = _eval_inputs(spark, sf)
    return mt.match_intervals(events, labels, 1500, bucket_ms=10_000)


@query("candidate_evaluation", cte("v_samples", "with " + _WALK + """,
m as (select sample_id, count(*) as m, median(delay_ms) as d from walk where label_id is not null group by 1),
r as (select s.*, coalesce(m.m, 0) as matched_events, m.d as median_alert_delay_ms,
  (select count(*) from labels l where l.sample_id = s.sample_id) as positive_episodes,
  (select count(*) from events v where v.sample_id = s.sample_id) as candidate_events
  from v_samples s left join m on m.sample_id = s.sample_id)
select sample_id, matched_events, positive_episodes - matched_events as missed_episodes, candidate_events - matched_events as false_alerts,
  cast(median_alert_delay_ms as double) as median_alert_delay_ms,
  round(cast(matched_events as double) / nullif(candidate_events, 0), 9) as precision,
  round(cast(matched_events as double) / nullif(positive_episodes, 0), 9) as recall,
  round((candidate_events - matched_events) / ((end_ms - start_ms) / cast(3600000 as double)), 6) as false_alerts_per_camera_hour from r"""))
def candidate_evaluation(spark, sf):
    r = ev.evaluate_candidates(*_eval_inputs(spark, sf), tolerance_ms=1500)
    return r.select("sample_id", "matched_events", "missed_episodes", "false_alerts", "median_alert_delay_ms",
                    F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"),
                    F.round("false_alerts_per_camera_hour", 6).alias("false_alerts_per_camera_hour"))


@query("candidate_roll_up", cte("v_samples", "with " + _WALK + """,
d as (select w.sample_id, w.delay_ms, s.site_id, s.camera_id from walk w join v_samples s on s.sample_id = w.sample_id where w.label_id is not null),
r as (select s.sample_id, s.site_id, s.camera_id, s.end_ms - s.start_ms as duration_ms,
  (select count(*) from d where d.sample_id = s.sample_id) as matched_events,
  (select count(*) from labels l where l.sample_id = s.sample_id) as positive_episodes,
  (select count(*) from events v where v.sample_id = s.sample_id) as candidate_events from v_samples s),
g as (select 'camera' as level, site_id, camera_id, count(*) as sample_count, sum(duration_ms) as duration_ms, sum(positive_episodes) as positive_episodes,
    sum(candidate_events) as candidate_events, sum(matched_events) as matched_events,
    (select median(delay_ms) from d where d.site_id = r.site_id and d.camera_id = r.camera_id) as md from r group by site_id, camera_id
  union all
  select 'site', site_id, null, count(*), sum(duration_ms), sum(positive_episodes), sum(candidate_events), sum(matched_events),
    (select median(delay_ms) from d where d.site_id = r.site_id) from r group by site_id
  union all
  select 'all', null, null, count(*), sum(duration_ms), sum(positive_episodes), sum(candidate_events), sum(matched_events),
    (select median(delay_ms) from d) from r)
select level, site_id, camera_id, cast(sample_count as bigint) as sample_count, cast(duration_ms as bigint) as duration_ms,
  cast(positive_episodes as bigint) as positive_episodes, cast(candidate_events as bigint) as candidate_events,
  cast(matched_events as bigint) as matched_events, cast(md as double) as median_alert_delay_ms,
  cast(positive_episodes - matched_events as bigint) as missed_episodes, cast(candidate_events - matched_events as bigint) as false_alerts,
  cast(matched_events as double) / nullif(candidate_events, 0) as precision,
  cast(matched_events as double) / nullif(positive_episodes, 0) as recall,
  cast(candidate_events - matched_events as double) / (cast(duration_ms as double) / cast(3600000 as double)) as false_alerts_per_camera_hour,
  cast(duration_ms as double) / cast(3600000 as double) as camera_hours from g"""))
def candidate_roll_up(spark, sf):
    samples, events, labels = _eval_inputs(spark, sf)
    r = ev.evaluate_candidates(samples, events, labels, 1500)
    return ev.roll_up(r, mt.match_intervals(events, labels, 1500))


@query("evaluation_faults", "select cast(null as varchar) as sample_id, cast(null as varchar) as rule where false")
def evaluation_faults(spark, sf):
    return ev.evaluation_faults(ev.evaluate_candidates(*_eval_inputs(spark, sf), tolerance_ms=1500))


@query("overlapping_samples", cte("v_samples", """
select s.sample_id, s.site_id, s.camera_id, s.start_ms, s.end_ms from v_samples s where exists (
  select 1 from v_samples o where o.site_id = s.site_id and o.start_ms < s.start_ms and o.end_ms > s.start_ms)"""))
def overlapping_samples(spark, sf):
    # Cameras of a site are taken together here, so neighbouring samples collide.
    return mt.overlapping_samples(view(spark, sf, "v_samples"), ["site_id"], bucket_ms=1_000_000).select(
        "sample_id", "site_id", "camera_id", "start_ms", "end_ms")


# Still images and classes ---------------------------------------------------------------------------------------------
def _stills(spark, sf):
    v = view(spark, sf, "v_boxes").withColumnRenamed("frame_index", "image_id")
    truth = v.filter("line % 2 = 0").withColumn("object_id", F.col("det_ordinal"))
    return v.select("image_id").distinct(), truth, v.filter("line % 2 = 1")


_STILL = "with " + _EDGE.strip() + "," + _BEST + """,
best as (select frame_index, max(len(os)) as m from sub group by all),
im as (select frame_index, count(case when line % 2 = 0 then 1 end) as gt, count(case when line % 2 = 1 then 1 end) as dt
       from v_boxes group by all),
per as (select im.frame_index as image_id, coalesce(m, 0) as tp, gt, dt from im left join best using (frame_index))
"""


@query("still_images", cte("v_boxes", _STILL + """
select image_id, tp as true_positives, gt as ground_truth_count, dt as detection_count, dt - tp as false_positives,
  gt - tp as false_negatives from per"""))
def still_images(spark, sf):
    return ev.still_images(*_stills(spark, sf), min_iou=0.1)


@query("still_summary", cte("v_boxes", _STILL + """
, s as (select count(*) as image_count, sum(tp) as tp, sum(dt - tp) as fp, sum(gt - tp) as fn from per)
select image_count, cast(tp as bigint) as true_positives, cast(fp as bigint) as false_positives,
  cast(fn as bigint) as false_negatives, round(cast(tp as double) / (tp + fp), 9) as precision,
  round(cast(tp as double) / (tp + fn), 9) as recall, round(cast(2 * tp as double) / (2 * tp + fp + fn), 9) as f1,
  round(cast(fp as double) / image_count, 9) as false_detections_per_image from s"""))
def still_summary(spark, sf):
    return rounded(ev.still_summary(ev.still_images(*_stills(spark, sf), min_iou=0.1)),
                   "precision", "recall", "f1", "false_detections_per_image")


def _classes(spark, sf):
    images, truth, dets = _stills(spark, sf)
    ren = {"image_id": "asset_id", "det_ordinal": "pred_ordinal"}
    return images.withColumnsRenamed(ren), truth.withColumnsRenamed(ren), dets.withColumnsRenamed(ren)


# Every extent is divided by the larger one of its axis before areas are taken, as class_counts does: at the threshold the
# rounding of the plain quotient differs.
_CLASS = """with t as (select *, concat('o', det_ordinal) as object_id from v_boxes where line % 2 = 0),
p as (select *, concat('t', det_ordinal) as track_id from v_boxes where line % 2 = 1 and confidence >= 0.5),
b as (select t.frame_index, t.category, t.object_id, p.track_id,
    t.x_max - t.x_min as tw, t.y_max - t.y_min as th, p.x_max - p.x_min as pw, p.y_max - p.y_min as ph,
    least(t.x_max, p.x_max) - greatest(t.x_min, p.x_min) as iw, least(t.y_max, p.y_max) - greatest(t.y_min, p.y_min) as ih
  from t join p on t.source_id = p.source_id and t.session_id = p.session_id and t.frame_index = p.frame_index
    and t.category = p.category),
e as (select *, greatest(tw, pw) as sx, greatest(th, ph) as sy from b where iw > 0 and ih > 0),
i as (select *, (iw / sx) * (ih / sy) as common from e),
edge as (select *, common / ((tw / sx) * (th / sy) + (pw / sx) * (ph / sy) - common) as iou from i),
g as (select frame_index, category, object_id, track_id, row_number() over
        (partition by frame_index, category order by object_id, track_id) as k from edge where iou >= 0.15),
sub as (
  select frame_index, category, k, [object_id] as os, [track_id] as ts from g
  union all
  select s.frame_index, s.category, g.k, list_append(s.os, g.object_id), list_append(s.ts, g.track_id)
  from sub s join g on s.frame_index = g.frame_index and s.category = g.category and g.k > s.k
    and not list_contains(s.os, g.object_id) and not list_contains(s.ts, g.track_id)),
mc as (select frame_index, category, max(len(os)) as m from sub group by all),
nr as (select frame_index, category, count(distinct track_id) as n from g group by all),
cc as (select coalesce(tt.frame_index, pp.frame_index) as asset_id, coalesce(tt.category, pp.category) as category,
    coalesce(tt.n, 0) as labels, coalesce(pp.n, 0) as accepted, coalesce(mc.m, 0) as matched,
    coalesce(nr.n, 0) - coalesce(mc.m, 0) as duplicates
  from (select frame_index, category, count(*) as n from t group by all) tt
  full join (select frame_index, category, count(*) as n from p group by all) pp
    on tt.frame_index = pp.frame_index and tt.category = pp.category
  left join mc on mc.frame_index = coalesce(tt.frame_index, pp.frame_index) and mc.category = coalesce(tt.category, pp.category)
  left join nr on nr.frame_index = coalesce(tt.frame_index, pp.frame_index) and nr.category = coalesce(tt.category, pp.category))
"""


@query("class_metrics", cte("v_boxes", _CLASS + """
, names as (select unnest(['A', 'N', 'R', 'Z']) as category),
s as (select n.category, coalesce(sum(matched), 0) as tp, coalesce(sum(accepted - matched), 0) as fp,
        coalesce(sum(labels - matched), 0) as fn from names n left join cc on cc.category = n.category group by 1)
select category, cast(tp as bigint) as true_positives, cast(fp as bigint) as false_positives,
  cast(fn as bigint) as false_negatives, round(cast(tp as double) / nullif(tp + fp, 0), 9) as precision,
  round(cast(tp as double) / nullif(tp + fn, 0), 9) as recall from s"""))
def class_metrics(spark, sf):
    _, truth, preds = _classes(spark, sf)
    m = ev.class_metrics(ev.class_counts(truth, preds, min_iou=0.15), ["A", "N", "R", "Z"])
    return rounded(m, "precision", "recall")


@query("class_summary", cte("v_boxes", _CLASS + """
, per as (select b.asset_id, coalesce(sum(labels), 0) as labels, coalesce(sum(accepted), 0) as accepted,
    coalesce(sum(matched), 0) as matched, coalesce(sum(duplicates), 0) as duplicates
  from (select distinct frame_index as asset_id from v_boxes) b left join cc using (asset_id) group by 1),
s as (select count(*) as case_count, count(case when labels = 0 then 1 end) as negative_images,
  count(case when labels = 0 and accepted > matched then 1 end) as nfp_images,
  sum(case when labels = 0 then accepted - matched else 0 end) as nfp,
  count(case when labels > 0 and matched < labels then 1 end) as missed, sum(duplicates) as dup, sum(matched) as tp,
  sum(accepted - matched) as fp, sum(labels - matched) as fn from per)
select case_count, negative_images, nfp_images as negative_images_with_false_positives,
  cast(nfp as bigint) as negative_image_false_positives, missed as positive_images_with_misses,
  cast(dup as bigint) as duplicate_predictions, cast(tp as bigint) as true_positives, cast(fp as bigint) as false_positives,
  cast(fn as bigint) as false_negatives, round(cast(tp as double) / (tp + fp), 9) as precision,
  round(cast(tp as double) / (tp + fn), 9) as recall from s"""))
def class_summary(spark, sf):
    assets, truth, preds = _classes(spark, sf)
    return rounded(ev.class_summary(assets, ev.class_counts(truth, preds, min_iou=0.15)), "precision", "recall")


@query("class_summary_faults", "select cast(null as varchar) as rule where false")
def class_summary_faults(spark, sf):
    assets, truth, preds = _classes(spark, sf)
    return ev.summary_faults(ev.class_summary(assets, ev.class_counts(truth, preds, min_iou=0.15)))


_READS = """
reads as (select p_partkey as case_id, case when p_partkey % 5 = 0 then 'blank' else 'positive' end as scope, arm,
    case when p_partkey % 5 > 0 then replace(p_brand, '#', '') end as expected_text,
    case when (p_partkey * m) % 7 = 0 then null when (p_partkey * m) % 3 = 0 then replace(p_brand, '#', '')
         else replace(p_type, 'E', 'F') end as observed_text
  from part, (select 'baseline' as arm, 1 as m union all select 'candidate', 4) a)"""
_READ_SUM = _READS + """,
s as (select arm, count(case when scope = 'positive' then 1 end) as positive_cases,
  count(case when scope = 'positive' and observed_text = expected_text then 1 end) as exact_reads,
  count(case when scope = 'positive' and observed_text <> expected_text then 1 end) as wrong_accepted_reads,
  count(case when scope = 'positive' and observed_text is null then 1 end) as abstentions,
  cast(sum(case when scope = 'positive' then levenshtein(expected_text, coalesce(observed_text, '')) end) as bigint) as character_errors,
  cast(sum(case when scope = 'positive' then len(expected_text) end) as bigint) as reference_characters,
  count(case when scope = 'blank' then 1 end) as blank_cases,
  count(case when scope = 'blank' and observed_text is not null then 1 end) as blank_false_accepts from reads group by arm)"""


def _reads(spark, sf):
    p = table(spark, sf, "part")
    return p.selectExpr("*", "inline(array(struct('baseline' as arm, 1 as m), struct('candidate' as arm, 4 as m)))").selectExpr(
        "p_partkey case_id", "case when p_partkey % 5 = 0 then 'blank' else 'positive' end scope", "arm",
        "case when p_partkey % 5 > 0 then replace(p_brand, '#', '') end expected_text",
        "case when (p_partkey * m) % 7 = 0 then null when (p_partkey * m) % 3 = 0 then replace(p_brand, '#', '')"
        " else replace(p_type, 'E', 'F') end observed_text")


@query("read_comparison", "with " + _READ_SUM.strip() + " select * from s")
def read_comparison(spark, sf):
    return ev.read_comparison(_reads(spark, sf))


@query("read_edit_distance", "with " + _READS.strip() + """
select case_id, arm, cast(levenshtein(expected_text, coalesce(observed_text, '')) as int) as edits from reads
where expected_text is not null""")
def read_edit_distance(spark, sf):
    from ..functions.text import edit_distance

    return _reads(spark, sf).filter("expected_text is not null").select(
        "case_id", "arm", edit_distance(F.col("expected_text"), F.col("observed_text")).alias("edits"))
