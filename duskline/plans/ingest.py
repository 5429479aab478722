"""Source, store, report and governance queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import posture as ps
from ..functions import sql as sqlfn
from ..operators import compare as cp
from ..operators import inference as inf
from ..operators import results as rs
from ..operators import rules
from ..operators import search as srch
from ..operators import tracking as tr
from ..session import ensure_checkpoint_dir
from ..sources import artifacts as art
from ..sources import live
from ..sources import manifests as man
from ..sources import observations as obs
from ..sources import store
from . import search as sq
from .catalog import query
from .detections import rounded
from .views import cte, table, view


@query("observation_lines_round_trip", cte("v_obs", "select 'a' as source_id, 'b' as session_id, timestamp_ms, track_id, posture, confidence from v_obs"))
def observation_lines_round_trip(spark, sf):
    lines = view(spark, sf, "v_obs").select(F.to_json(F.struct("timestamp_ms", "track_id", "posture", "confidence")).alias("value"))
    return obs.parse_lines(lines, "a", "b").rows


@query("observation_lines_quarantine", """
select case event_id % 5 when 0 then 'not_an_object' when 1 then 'wrong_fields' when 2 then 'posture' when 3 then 'wrong_types' end as reason,
  count(*) as n from events where event_id % 5 < 4 group by all""")
def observation_lines_quarantine(spark, sf):
    k = F.col("event_id") % 5
    good = F.concat(F.lit('{"timestamp_ms":1,"track_id":"t'), "event_id", F.lit('","posture":"down","confidence":0.5}'))
    value = (
        F.when(k == 0, F.concat(F.lit("["), "event_id")).when(k == 1, F.lit('{"timestamp_ms":1,"track_id":"x"}'))
        .when(k == 2, F.regexp_replace(good, "down", "flying")).when(k == 3, F.regexp_replace(good, ":1,", ':"1",')).otherwise(good))
    lines = table(spark, sf, "events").select(value.alias("value"))
    return obs.parse_lines(lines, "a", "b").quarantine.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("frame_gaps", cte("v_lanes", """
with want as (select source_id as sequence_id, unnest(generate_series(10, 10 + max(frame_index))) as frame_index from v_lanes group by source_id),
have as (select distinct source_id as sequence_id, frame_index from v_lanes)
select sequence_id, frame_index, 'missing' as problem from want anti join have using (sequence_id, frame_index) union all
select sequence_id, frame_index, 'unexpected' from have anti join want using (sequence_id, frame_index)"""))
def frame_gaps(spark, sf):
    v = view(spark, sf, "v_lanes").withColumnRenamed("source_id", "sequence_id")
    plan = v.groupBy("sequence_id").agg((F.max("frame_index") + 1).alias("frame_count"), F.lit(10).cast("long").alias("first_frame"))
    return man.frame_gaps(v, plan)


_LT = """l_orderkey as frame_number, l_partkey as person_id, l_partkey * 1000 + l_suppkey as tracking_id, l_partkey % 900 as x, l_suppkey % 500 as y,
  cast(l_quantity as bigint) * 4 as width, cast(l_quantity as bigint) * 3 - 3 as height, l_orderkey % 2 as is_valid, l_partkey % 4 as pose_class,
  cast(0 as bigint) as occlusion, l_suppkey % 2 as truncated, l_discount as visibility"""


@query("label_table_objects", f"""
with r as (select *, count(*) over (partition by frame_number, tracking_id) as times from (select {_LT} from lineitem))
select frame_number as frame_index, concat('label-track:', tracking_id) as object_id, 'person' as category,
  round(cast(x as double) / 1000, 9) as x_min, round(cast(y as double) / 600, 9) as y_min,
  round(cast(x + width as double) / 1000, 9) as x_max, round(cast(y + height as double) / 600, 9) as y_max
from r where times = 1 and is_valid = 1 and pose_class < 3 and width > 0 and height > 0 and x + width <= 1000 and y + height <= 600""")
def label_table_objects(spark, sf):
    return rounded(man.label_table(table(spark, sf, "lineitem").selectExpr(*_split(_LT)), 1000, 600).clean)


@query("label_table_violations", f"""
with r as (select {_LT} from lineitem)
select rule, count(*) as n from (select 'pose_class' as rule from r where pose_class > 2 union all
  select 'area' from r where height <= 0 union all select 'inside' from r where x + width > 1000 or y + height > 600 union all
  select 'repeated' from r group by frame_number, tracking_id having count(*) > 1) group by rule""")
def label_table_violations(spark, sf):
    v = man.label_table(table(spark, sf, "lineitem").selectExpr(*_split(_LT)), 1000, 600).violations
    return v.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _split(cols: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in cols + ",":
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return parts


@query("activity_intervals", """
select p_partkey as clip_id, a as activity, s as start_ms, e as end_ms from (
  select p_partkey, 'Falling (FW)' as a, cast(p_size * 100 as bigint) as s, cast(p_size * 100 + 2500 as bigint) as e from part union all
  select p_partkey, p_name, cast(0 as bigint), cast(p_size * 1000 as bigint) from part)""")
def activity_intervals(spark, sf):
    t = table(spark, sf, "part").selectExpr(
        "p_partkey clip_id", "concat(' Falling (FW)[', cast(p_size as double) / 10, ' to ', cast(p_size + 25 as double) / 10, ']; ', p_name, '[0 to ', p_size, ']') classes")
    return man.activity_intervals(t)


def _store(spark, sf):
    r = view(spark, sf, "v_event_records")
    return r.filter("timestamp_ms % 3 > 0"), r.filter("timestamp_ms % 3 < 2").withColumn(
        "confidence", F.when(F.col("timestamp_ms") % 7 == 0, 0.123).otherwise(F.col("confidence")))


_ST = """with ex as (select * from v_event_records where timestamp_ms % 3 > 0),
inc as (select * replace (case when timestamp_ms % 7 = 0 then cast(0.123 as double) else confidence end as confidence) from v_event_records where timestamp_ms % 3 < 2)"""


@query("store_new_records", cte("v_event_records", _ST + """
select i.observation_id, i.timestamp_ms from inc i anti join ex using (observation_id)"""))
def store_new_records(spark, sf):
    existing, incoming = _store(spark, sf)
    return store.new_records(incoming, existing).select("observation_id", "timestamp_ms")


@query("store_conflicts", cte("v_event_records", _ST + """
select i.observation_id from inc i join ex using (observation_id) where i.confidence <> ex.confidence"""))
def store_conflicts(spark, sf):
    existing, incoming = _store(spark, sf)
    return store.conflicts(incoming, existing)


@query("store_append", cte("v_event_records", _ST + """,
e as (select *, case when timestamp_ms % 11 = 4 then null else source_id end as evidence from ex),
i as (select *, case when timestamp_ms % 11 = 4 then null else source_id end as evidence from inc)
select observation_id, confidence, 'stored' as state from e where evidence is not null union all
select i.observation_id, i.confidence, 'stored' from i anti join e using (observation_id) where evidence is not null union all
select observation_id, null, 'no_evidence' from e where evidence is null union all
select observation_id, null, 'no_evidence' from i where evidence is null union all
select i.observation_id, null, 'conflict' from i join e using (observation_id) where i.confidence <> e.confidence and i.evidence is not null"""))
def store_append(spark, sf):
    """Two batches go into a new store, the second one twice; what is stored then, and what either batch was refused."""
    path = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    first, second = (r.withColumn("evidence", F.when(F.col("timestamp_ms") % 11 != 4, F.col("source_id"))) for r in _store(spark, sf))
    refused = store.append(spark, first, path)
    store.append(spark, second, path)
    refused = refused.unionByName(store.append(spark, second, path))
    return spark.read.parquet(path).select("observation_id", "confidence", F.lit("stored").alias("state")).unionByName(
        refused.select("observation_id", F.lit(None).cast("double").alias("confidence"), F.col("reason").alias("state")))


@query("store_audit", cte("v_records", """
with a as (select observation_id, 0 as o, attr_type as v, timestamp_ms from v_records union all select observation_id, 1, attr_tier, timestamp_ms from v_records),
a2 as (select observation_id, case when timestamp_ms % 50 = 1 and o = 1 then 2 else o end as o, case when timestamp_ms % 40 = 3 then concat(v, '  x') else v end as v from a),
r as (select * from v_records where timestamp_ms % 60 <> 5)
select observation_id, 'ordinal_holes' as problem from a2 group by 1 having min(o) <> 0 or max(o) <> count(*) - 1 union all
select observation_id, 'orphan_attribute' from (select distinct observation_id from a2) anti join r using (observation_id) union all
select distinct observation_id, 'text_not_canonical' from a2 where v like '%  %'"""))
def store_audit(spark, sf):
    r, a = store.flatten(sq.records(spark, sf), ["timestamp_ms"])
    a = a.withColumns({
        "ordinal": F.when((F.col("timestamp_ms") % 50 == 1) & (F.col("ordinal") == 1), 2).otherwise(F.col("ordinal")),
        "value": F.when(F.col("timestamp_ms") % 40 == 3, F.concat("value", F.lit("  x"))).otherwise(F.col("value"))})
    return store.audit(r.filter("timestamp_ms % 60 <> 5"), a.drop("timestamp_ms"))


@query("artifact_identity", """
select cast(doc_id as varchar) as path, case when doc_id % 11 = 1 then 'missing' when doc_id % 7 = 0 then 'size'
  when doc_id % 5 = 0 then 'digest' end as problem from documents
where doc_id % 11 = 1 or ((doc_id % 7 = 0 or doc_id % 5 = 0) and doc_id % 11 <> 1)""")
def artifact_identity(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.encode("text", "UTF-8").alias("content"))
    found = art.digests(d.filter("doc_id % 11 <> 1"))
    k = F.col("doc_id")
    manifest = d.select("path", (F.length("content").cast("long") + F.when(k % 7 == 0, 1).otherwise(0)).alias("size_bytes"),
                        F.when(k % 5 == 0, "x").otherwise(F.sha2("content", 256)).alias("sha256"))
    return art.identity_problems(manifest, found)


@query("artifact_digests", "select cast(doc_id as varchar) as path, strlen(text) as size_bytes, sha256(text) as sha256, sha1(concat('blob ', strlen(text), chr(0), text)) as git_blob_sha1 from documents")
def artifact_digests(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return art.digests(d).drop("sha384")


_MEM = """concat('Set/', case when doc_id % 2 = 0 then 'ADL' else 'Fall' end, '/SBJ_', doc_id % 13, '_LOC', doc_id % 7, '/', doc_id, case when doc_id % 4 = 0 then '.txt' else '.mp4' end) as name,
  n_chars as compressed_size, n_chars * 900 as uncompressed_size, doc_id * 7 as crc32, doc_id * 100 as local_header_offset,
  case when doc_id % 2 = 0 then 'negative' else 'positive' end as role, concat('SBJ_', doc_id % 13) as subject_id, concat('LOC', doc_id % 7) as location_id, doc_id"""
_MEMV = f"m as (select {_MEM} from documents), b as (select * from m where name like '%.mp4' and uncompressed_size between 1 and 16777216 and compressed_size >= 1)"


def _members(spark, sf):
    return table(spark, sf, "documents").selectExpr(*_split(_MEM))


@query("archive_summary", f"with {_MEMV} select extension, count(*) as n, sum(uncompressed_size)::bigint as bytes from (select '.mp4' as extension, * from b) group by 1")
def archive_summary(spark, sf):
    return art.bounded_videos(_members(spark, sf)).groupBy("extension").agg(F.count(F.lit(1)).alias("n"), F.sum("uncompressed_size").alias("bytes"))


@query("archive_top_groups", "select source as top_level, count(*) as members from documents group by 1 order by 2 desc, 1 limit 24")
def archive_top_groups(spark, sf):
    return art.top_groups(table(spark, sf, "documents").selectExpr("concat(source, '/', doc_id) name"))


@query("archive_smallest", f"with {_MEMV} select name, uncompressed_size from b order by uncompressed_size, name limit 32")
def archive_smallest(spark, sf):
    return art.smallest(art.bounded_videos(_members(spark, sf))).select("name", "uncompressed_size")


@query("archive_pinned", f"with {_MEMV} select concat('r', doc_id) as role, name, case when doc_id % 3 = 0 then 0 else 1 end::bigint as matches, doc_id % 3 <> 0 as accepted from m")
def archive_pinned(spark, sf):
    m = _members(spark, sf)
    pins = m.withColumns({"role": F.concat(F.lit("r"), "doc_id"), "crc32": F.col("crc32") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)})
    return art.pinned_matches(m.drop("role"), pins)


@query("disjoint_pair", f"""with {_MEMV}
select n.name as negative, p.name as positive, n.uncompressed_size + p.uncompressed_size as total_bytes
from b n join b p on n.role = 'negative' and p.role = 'positive' and n.subject_id <> p.subject_id and n.location_id <> p.location_id
order by (n.location_id not in ('LOC1', 'LOC2'))::int + (p.location_id not in ('LOC1', 'LOC2'))::int desc, total_bytes,
  greatest(n.uncompressed_size, p.uncompressed_size), n.name, p.name limit 1""")
def disjoint_pair(spark, sf):
    return art.disjoint_pair(art.bounded_videos(_members(spark, sf)), ("LOC1", "LOC2"))




@query("live_windows", """
with s as (select distinct concat('cam-', l_orderkey % 5) as camera, l_orderkey as window_id, cast(l_linenumber as bigint) as sequence,
    cast(l_linenumber * 3 + l_orderkey % 4 as double) / 2 as duration_seconds from lineitem),
t as (select *, coalesce(sequence - lag(sequence) over (partition by camera, window_id order by sequence) = 1, true) as step from s)
select camera, window_id, count(*) as segments, bool_and(step) as consecutive, bool_and(duration_seconds > 0 and duration_seconds <= 10) as within_target,
  sum(duration_seconds) as total_seconds, count(*) = 3 and bool_and(step) and bool_and(duration_seconds > 0 and duration_seconds <= 10)
  and sum(duration_seconds) <= 35 as accepted from t group by all""")
def live_windows(spark, sf):
    s = table(spark, sf, "lineitem").selectExpr(
        "concat('cam-', l_orderkey % 5) camera", "l_orderkey window_id", "cast(l_linenumber as bigint) sequence",
        "cast(l_linenumber * 3 + l_orderkey % 4 as double) / 2 duration_seconds", "cast(10 as double) target_duration").distinct()
    return live.window_checks(s)


@query("camera_problems", """
select o_orderkey as "index" from orders left join (select l_orderkey, count(*) as n, bool_and(l_linestatus = 'O') as ok from lineitem group by 1)
  on l_orderkey = o_orderkey where not coalesce(n = 1 and ok, false)""")
def camera_problems(spark, sf):
    c = table(spark, sf, "lineitem").selectExpr("l_orderkey as index", "concat('camera ', l_orderkey) name", "case when l_linestatus = 'O' then 'true' else 'false' end in_service")
    return live.camera_problems(c, table(spark, sf, "orders").selectExpr("o_orderkey as index", "concat('camera ', o_orderkey) name"))


@query("segment_report", cte("v_obs", """
select source_id, posture as segment_id, count(*) as decoded_frames, min(timestamp_ms) as first_ms, max(timestamp_ms) as last_ms,
  count(case when ordinal % 3 = 0 then 1 end) as sampled_frames, coalesce(sum(case when ordinal % 3 = 0 then ordinal % 4 end), 0)::bigint as detections,
  count(case when ordinal % 4 = 1 then 1 end) as track_observations, count(distinct case when ordinal % 4 = 1 then track_id end) as unique_ids,
  cast(null as double) as accuracy from v_obs group by all"""))
def segment_report(spark, sf):
    v = view(spark, sf, "v_obs").withColumnRenamed("posture", "segment_id")
    return live.segment_report(v, v.filter("ordinal % 3 = 0").withColumn("detections", F.col("ordinal") % 4), v.filter("ordinal % 4 = 1"))


@query("frame_manifest_digest", cte("v_lanes", """
with f as (select source_id as sequence_id, frame_index, sha256(concat(source_id, frame_index)) as h from (select distinct source_id, frame_index from v_lanes))
select sequence_id, sha256(string_agg(concat(frame_index, chr(9), h, chr(10)), '' order by frame_index)) as digest, count(*) as frames from f group by 1"""))
def frame_manifest_digest(spark, sf):
    f = view(spark, sf, "v_lanes").select(F.col("source_id").alias("sequence_id"), "frame_index").distinct()
    return live.frame_manifest_digest(f.withColumn("sha256", F.sha2(F.concat("sequence_id", F.col("frame_index").cast("string")), 256)))


@query("frame_chain_digest", cte("v_lanes", """
with f as (select distinct source_id, frame_index, timestamp_ms, cast(floor(frame_index / 50) as bigint) as segment_id from v_lanes)
select source_id, segment_id, sha256(unhex(string_agg(printf('%016x', frame_index) || printf('%016x', timestamp_ms) || sha256(concat(source_id, frame_index)), '' order by frame_index))) as chain_sha256
from f group by all"""))
def frame_chain_digest(spark, sf):
    f = view(spark, sf, "v_lanes").select("source_id", "frame_index", "timestamp_ms", F.floor(F.col("frame_index") / 50).alias("segment_id")).distinct()
    return live.frame_chain_digest(f.withColumn("sha256", F.sha2(F.concat("source_id", F.col("frame_index").cast("string")), 256)))


@query("label_digest", cte("v_lanes", """
with t as (select source_id as sequence_id, frame_index, concat_ws('|', cast(det_ordinal as varchar), category, hex(cast(x_min as varchar)),
    hex(cast(y_min as varchar)), hex(cast(x_max as varchar)), hex(cast(y_max as varchar))) as t from v_lanes),
f as (select sequence_id, frame_index, sha256(string_agg(t, chr(10) order by t)) as h from t group by all)
select sequence_id, sha256(string_agg(concat(frame_index, chr(9), h, chr(10)), '' order by frame_index)) as digest, count(*) as frames from f group by 1"""))
def label_digest(spark, sf):
    o = view(spark, sf, "v_lanes").withColumnsRenamed({"source_id": "sequence_id"}).withColumn("object_id", F.col("det_ordinal").cast("string"))
    return live.label_digest(o)


@query("manifest_digest")
def manifest_digest(spark, sf):
    return cp.manifest_digest(view(spark, sf, "v_records"))


def _evidence_records(spark, sf):
    ev = F.struct(F.concat(F.lit("ev-"), "observation_id").alias("event_id"), F.lit("adapter").alias("producer"), F.lit("1").alias("producer_version"),
                  F.sha2("observation_id", 256).alias("config_sha256"), F.sha2("source_id", 256).alias("model_sha256"), F.lit("r1").alias("source_revision"))
    return sq.records(spark, sf).withColumn("evidence", F.when(F.col("timestamp_ms") % 5 > 0, ev)).drop("attr_type", "attr_tier")


@query("operator_hits", cte("v_records", """
select observation_id, source_id, timestamp_ms, cast(3000 as bigint) as pre_roll_ms, cast(4000 as bigint) as post_roll_ms, concat('ev-', observation_id) as event_id,
  track_id as local_track_id, false as identity_claim, false as authorizes_action from v_records where timestamp_ms % 5 > 0"""))
def operator_hits(spark, sf):
    return rs.hits(_evidence_records(spark, sf), 3000, 4000).select(
        "observation_id", "payload.source_id", "payload.timestamp_ms", "payload.playback.pre_roll_ms", "payload.playback.post_roll_ms",
        "payload.playback.evidence.event_id", "payload.local_track_id", "payload.identity_claim", "payload.authorizes_action")


@query("envelope_round_trip", cte("v_records", "select count(*) as lines, count(*) as accepted from v_records where timestamp_ms % 5 > 0"))
def envelope_round_trip(spark, sf):
    lines = rs.envelopes(rs.hits(_evidence_records(spark, sf)))
    back = rs.read_envelopes(lines, "hit")
    return back.agg(F.count("value").alias("lines"), F.count_if("accepted").alias("accepted"))


@query("envelope_tampered", cte("v_records", "select count(*) as lines, cast(0 as bigint) as accepted from v_records where timestamp_ms % 5 > 0"))
def envelope_tampered(spark, sf):
    lines = rs.envelopes(rs.hits(_evidence_records(spark, sf))).withColumn("value", F.regexp_replace("value", '"identity_claim":false', '"identity_claim":true'))
    return rs.read_envelopes(lines, "hit").agg(F.count("value").alias("lines"), F.count_if("accepted").alias("accepted"))


@query("trail_envelopes")
def trail_envelopes(spark, sf):
    from ..operators import trails

    r = _evidence_records(spark, sf)
    t = trails.plate_trails(r.filter(F.col("evidence").isNotNull()), None, sq.PLATE_CFG)
    lines = rs.envelopes(rs.trail_results(t, r))
    return rs.read_envelopes(lines, "trail").agg(F.count("value").alias("lines"), F.count_if("accepted").alias("accepted"))


@query("appearance_envelopes", cte("v_desc", "with " + sq._PAIRS.strip() + """
select count(distinct probe_id) as lines, count(distinct probe_id) as accepted from ranked where s >= 0.6 and rank <= 10"""))
def appearance_envelopes(spark, sf):
    from ..operators import appearance

    d = view(spark, sf, "v_desc")
    rec = d.select("observation_id", "source_id", "timestamp_ms", "category").withColumns({
        "confidence": F.lit(1.0), "track_id": F.lit(None).cast("string"), "plate_text": F.lit(None).cast("string"),
        "attributes": F.array().cast("array<struct<confidence:double,name:string,provenance:string,value:string>>"),
        "evidence": F.struct(*[F.lit("e").alias(n) for n in ("event_id", "producer", "producer_version", "config_sha256", "model_sha256", "source_revision")])})
    lines = rs.envelopes(rs.appearance_results(appearance.rank_similarity(d, d, 0.6, 10), rec))
    return rs.read_envelopes(lines, "appearance_matches").agg(F.count("value").alias("lines"), F.count_if("accepted").alias("accepted"))


@query("record_rules", cte("v_records", """
select observation_id, rule from (
  select concat(observation_id, case when timestamp_ms % 9 = 0 then ' !' else '' end) as observation_id, 'observation_id' as rule from v_records where timestamp_ms % 9 = 0 union all
  select concat(observation_id, case when timestamp_ms % 9 = 0 then ' !' else '' end), 'confidence' from v_records where confidence + 0.2 > 1 union all
  select concat(observation_id, case when timestamp_ms % 9 = 0 then ' !' else '' end), 'plate_category' from v_records where plate_text is not null and timestamp_ms % 4 = 0)"""))
def record_rules(spark, sf):
    r = sq.records(spark, sf).withColumns({
        "observation_id": F.concat("observation_id", F.when(F.col("timestamp_ms") % 9 == 0, " !").otherwise("")),
        "confidence": F.col("confidence") + 0.2,
        "category": F.when(F.col("timestamp_ms") % 4 == 0, "car").otherwise(F.col("category"))})
    return rules.check(r, rules.record_rules(), ["observation_id"]).violations


@query("capacity_rule", cte("v_boxes", "select source_id, session_id, frame_index, count(*) as n from v_boxes group by all having count(*) > 7"))
def capacity_rule(spark, sf):
    return rules.capacity(view(spark, sf, "v_boxes"), ["source_id", "session_id", "frame_index"], 7)


@query("session_violations", cte("v_obs", """
with f as (select source_id, session_id, ordinal as frame_index, timestamp_ms from v_obs),
l as (select *, lag(timestamp_ms) over (partition by source_id, session_id order by frame_index) as p from f)
select source_id, session_id, count(*) as violations from l where p >= timestamp_ms group by all"""))
def session_violations(spark, sf):
    f = view(spark, sf, "v_obs").select("source_id", "session_id", F.col("ordinal").alias("frame_index"), "timestamp_ms")
    return tr.session_violations(f, bucket_frames=1_000)


_ASSET = """concat('a', l_partkey % 500) as asset_id, sha256(concat('m', l_orderkey % 3000)) as sha256, concat('an', l_orderkey) as annotation_id, sha256(concat('as', l_orderkey)) as annotation_sha256,
  l_suppkey % 10 = 0 as identifiable_people, l_suppkey % 7 <> 0 as third_party_rights_cleared, case when l_linenumber % 3 = 0 then 'validation' else 'train' end as split,
  l_suppkey % 5 <> 0 as commercial_training_allowed, l_suppkey % 4 <> 0 as commercial_evaluation_allowed"""


@query("manifest_problems", f"""
with m as (select {_ASSET} from lineitem)
select distinct asset_id, problem from (
  select asset_id, 'rights' as problem from m where identifiable_people or not third_party_rights_cleared or not (case when split = 'train' then commercial_training_allowed else commercial_evaluation_allowed end)
  union all select asset_id, 'repeated_asset_id' from m qualify count(*) over (partition by asset_id) > 1
  union all select asset_id, 'repeated_sha256' from m qualify count(*) over (partition by sha256) > 1
  union all select asset_id, 'repeated_annotation_id' from m qualify count(*) over (partition by annotation_id) > 1
  union all select asset_id, 'repeated_annotation_sha256' from m qualify count(*) over (partition by annotation_sha256) > 1)""")
def manifest_problems(spark, sf):
    import re

    cols = [re.sub(r"sha256\((concat\([^)]*\))\)", r"sha2(\1, 256)", c) for c in _split(_ASSET)]
    return cp.manifest_problems(table(spark, sf, "lineitem").selectExpr(*cols))


@query("split_overlap", "select distinct l_partkey from lineitem where l_returnflag = 'R' and l_partkey in (select l_partkey from lineitem where l_returnflag = 'A')")
def split_overlap(spark, sf):
    li = table(spark, sf, "lineitem")
    return cp.overlap(li.filter("l_returnflag = 'R'"), li.filter("l_returnflag = 'A'"), "l_partkey")


@query("rights_check", """
select c_custkey, case when s is null then 'unknown_source' when ok then 'permitted' else 'refused' end as verdict from customer
left join (select n_nationkey as s, n_regionkey < 3 and n_nationkey % 2 = 0 as ok from nation where n_nationkey < 20) on s = c_nationkey""")
def rights_check(spark, sf):
    rights = table(spark, sf, "nation").filter("n_nationkey < 20").selectExpr(
        "n_nationkey source_id", "n_regionkey < 3 commercial_training", "true commercial_evaluation",
        "case when n_nationkey % 2 = 0 then 'real_world' else 'synthetic' end media_origin")
    assets = table(spark, sf, "customer").selectExpr("c_custkey", "c_nationkey source_id")
    return cp.rights_check(assets, rights, "training", True).select("c_custkey", "verdict")


_BLOCK = """
with p as (select p_partkey as plan_id, p_partkey % 3 = 0 as a, p_size < 10 as b, p_partkey % 5 = 0 as c, p_size > 40 as d from part)
select plan_id, concat_ws(',', case when a then 'trainer_license_not_approved' end, case when b then 'training_split_empty' end,
  case when not b and c then 'train_holdout_subject_overlap' end, case when d then 'resource_ceiling_invalid' end) as blockers,
  not a and not b and not (not b and c) and not d as ready from p"""


@query("training_blockers", _BLOCK)
def training_blockers(spark, sf):
    p = table(spark, sf, "part").selectExpr(
        "p_partkey plan_id", "case when p_partkey % 3 = 0 then 'GPL' else 'MIT' end trainer_license", f"'{cp.CLEARED}' dependency_rights_status",
        "'x' pretrained_sha256", "'MIT' pretrained_license", f"'{cp.CLEARED}' pretrained_rights_status",
        "case when p_size < 10 then cast(array() as array<string>) else array('s1', 's2') end train_subjects", "array('v1') validation_subjects",
        "case when p_partkey % 5 = 0 then array('s1') else array('h1') end holdout_subjects", "true export_smoke_tested", "true cpu_only", "false paid_compute",
        "2 max_cpu_threads", "20 max_wall_minutes", "4096 max_ram_mib", "4096 max_temp_mib", "case when p_size > 40 then 0 else 1 end max_trials")
    return cp.training_blockers(p).select("plan_id", F.array_join("blockers", ",").alias("blockers"), "ready")


@query("paired_deltas", """
with b as (select l_suppkey as k, count(*) as events, avg(l_discount) as score, count(distinct l_linenumber) as exposure from lineitem where l_returnflag = 'A' and l_suppkey % 9 > 0 group by 1),
c as (select l_suppkey as k, count(*) as events, case when l_suppkey % 4 > 0 then avg(l_discount) end as score, count(distinct l_linenumber) as exposure from lineitem where l_returnflag = 'R' and l_suppkey % 8 > 0 group by 1)
select k, c.events - b.events as delta_events, round(c.score - b.score, 9) as delta_score from b join c using (k) where b.exposure = c.exposure""")
def paired_deltas(spark, sf):
    return rounded(_paired(spark, sf)[0].select("k", "delta_events", "delta_score"), "delta_score")


@query("paired_refusals", """
with b as (select l_suppkey as k, count(distinct l_linenumber) as e from lineitem where l_returnflag = 'A' and l_suppkey % 9 > 0 group by 1),
c as (select l_suppkey as k, count(distinct l_linenumber) as e from lineitem where l_returnflag = 'R' and l_suppkey % 8 > 0 group by 1)
select k, case when b.e is null then 'only_candidate' when c.e is null then 'only_baseline' else 'exposure_differs' end as reason
from b full join c using (k) where b.e is null or c.e is null or b.e <> c.e""")
def paired_refusals(spark, sf):
    return _paired(spark, sf)[1]


def _paired(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "k")

    def arm(flag, mod, score):
        return li.filter((F.col("l_returnflag") == flag) & (F.col("k") % mod > 0)).groupBy("k").agg(
            F.count(F.lit(1)).alias("events"), score.alias("score"), F.count_distinct("l_linenumber").alias("exposure"))

    return cp.paired(arm("A", 9, F.avg("l_discount")), arm("R", 8, F.avg(F.when(F.col("k") % 4 > 0, F.col("l_discount")))), ["k"], ["events", "score"], ["exposure"])


@query("runtime_metrics", """
select event_type as tracker, count(*) as frames, round(sum(value) / 1000, 6) as elapsed_seconds, round(avg(value), 6) as mean_latency_ms, round(median(value), 6) as median_latency_ms,
  quantile_disc(value, 0.95) as p95_latency_ms, max(value) as max_latency_ms, max(user_id) as max_retained_tracks, round(count(*) / (sum(value) / 1000), 3) as throughput_fps from events group by 1""")
def runtime_metrics(spark, sf):
    m = cp.runtime_metrics(table(spark, sf, "events").selectExpr("event_type tracker", "value latency_ms", "user_id retained_tracks"), ["tracker"])
    for c, n in (("elapsed_seconds", 6), ("mean_latency_ms", 6), ("median_latency_ms", 6), ("throughput_fps", 3)):
        m = m.withColumn(c, F.round(c, n))
    return m


@query("suite_report", """
select count(*) as samples, sum(o_orderkey)::bigint as total_frames, round(sum(o_totalprice), 2) as total_elapsed_ms, false as single_runtime, true as single_device,
  round(sum(o_orderkey) * 1000 / sum(o_totalprice), 6) as frames_per_second, round(sum(o_orderkey) * 1000 / (sum(o_totalprice) + 235), 6) as frames_per_second_with_preparation from orders""")
def suite_report(spark, sf):
    r = table(spark, sf, "orders").selectExpr("o_orderkey frames_processed", "o_totalprice elapsed_ms", "o_orderstatus runtime_version", "'CPU' device")
    return rounded(cp.suite_report(r, 235.0).withColumn("total_elapsed_ms", F.round("total_elapsed_ms", 2)), "frames_per_second", "frames_per_second_with_preparation").select(
        "samples", "total_frames", "total_elapsed_ms", "single_runtime", "single_device",
        *[F.round(c, 6).alias(c) for c in ("frames_per_second", "frames_per_second_with_preparation")])


@query("activity_proxy", """
with r as (select o_orderkey as id, o_orderkey % 2 = 0 as f, case when o_orderkey % 3 > 0 then o_orderkey % 5000 end as a, 1000 + o_orderkey % 4000 as d, o_orderkey % 3 as m, o_orderkey % 4 as e from orders)
select id, case when f then m end as fall_matches, case when f then m + 1 end as fall_misses, case when not f then e end as normal_events,
  case when not f and a is not null then greatest(0, d - a) end as tail_ms, case when not f and d <= a then e end as scored_false_alerts,
  round(case when not f and d <= a then e / (d / cast(3600000 as double)) end, 6) as scored_false_alert_rate from r""")
def activity_proxy(spark, sf):
    r = table(spark, sf, "orders").selectExpr(
        "o_orderkey id", "o_orderkey % 2 = 0 is_fall", "case when o_orderkey % 3 > 0 then o_orderkey % 5000 end annotated_ms", "1000 + o_orderkey % 4000 duration_ms",
        "o_orderkey % 3 matched", "o_orderkey % 3 + 1 missed", "o_orderkey % 4 events", "o_orderkey % 4 false_alerts")
    a = cp.activity_proxy(r).withColumn("tail_ms", F.when(F.col("annotated_ms").isNotNull(), F.col("tail_ms")))
    return a.select("id", "fall_matches", "fall_misses", "normal_events", "tail_ms", "scored_false_alerts", F.round("scored_false_alert_rate", 6).alias("scored_false_alert_rate"))


@query("binding_problems", cte("v_boxes", """
with a as (select category, frame_index as asset_id from v_boxes),
s as (select asset_id, count(*) as n, list_sort(list_distinct(list(category))) as c from a group by 1)
select asset_id, case when asset_id % 10 = 0 then 'box_count' when asset_id % 7 = 0 then 'hash' when asset_id % 6 = 0 then 'dimensions' when c <> ['A', 'N', 'R'] then 'classes' end as problem
from s where asset_id % 10 = 0 or asset_id % 7 = 0 or asset_id % 6 = 0 or c <> ['A', 'N', 'R']"""))
def binding_problems(spark, sf):
    k = F.col("asset_id")
    a = view(spark, sf, "v_boxes").select(F.col("frame_index").alias("asset_id"), "category", F.col("det_ordinal").alias("object_id"),
                                          F.lit("h").alias("image_sha256"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    cases = a.groupBy("asset_id").agg(F.count(F.lit(1)).alias("_n")).select(
        "asset_id", (F.col("_n") + F.when(k % 10 == 0, 1).otherwise(0)).alias("annotation_box_count"), F.when(k % 7 == 0, "x").otherwise("h").alias("sha256"),
        F.when(k % 6 == 0, 11).otherwise(10).alias("width"), F.lit(20).alias("height"), F.array(*[F.lit(c) for c in "ANR"]).alias("annotation_classes"))
    return cp.binding_problems(cases, a)


@query("report_documents", "select concat('{\"c_custkey\":', c_custkey, ',\"c_name\":\"', c_name, '\",\"c_nationkey\":', c_nationkey, '}') as report from customer")
def report_documents(spark, sf):
    return cp.report_document(table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name"))


@query("iso_times", cte("v_records", "select observation_id, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as iso from v_records"))
def iso_times(spark, sf):
    return view(spark, sf, "v_records").select("observation_id", ids.iso_ms(F.col("timestamp_ms")).alias("iso"))


@query("plate_records", """
select concat('p', p_partkey) as observation_id, 'license_plate' as category, least(cast(p_size as double) / 100, cast(60 - p_size as double) / 100) as confidence, cast(null as varchar) as track_id from part""")
def plate_records(spark, sf):
    r = table(spark, sf, "part").selectExpr("concat('p', p_partkey) observation_id", "cast(p_size as double) / 100 plate_confidence", "cast(60 - p_size as double) / 100 text_confidence")
    return srch.record_from_plate(r).select("observation_id", "category", "confidence", "track_id")


@query("sql_functions", """
select c_custkey, case when regexp_full_match(c_mktsegment, '[A-Za-z0-9 -]*') then upper(translate(c_mktsegment, ' -', '')) end as plate,
  cast(levenshtein(c_mktsegment, 'MACHINE') as int) as errors, cast(0.25 as double) / (cast(2 as double) - cast(0.25 as double)) as iou from customer""")
def sql_functions(spark, sf):
    sqlfn.register(spark)
    table(spark, sf, "customer").createOrReplaceTempView("duskline_customer")
    return spark.sql("""select c_custkey, plate_text(c_mktsegment) as plate, read_errors(c_mktsegment, 'MACHINE') as errors,
        box_iou(0D, 0D, 1D, 1D, cast(0.5 as double), cast(0.5 as double), cast(1.5 as double), cast(1.5 as double)) as iou from duskline_customer""")


@query("model_host", "select doc_id as frame_index, 'object' as category, round(cast(strlen(text) % 100 as double) / 100, 9) as confidence from documents")
def model_host(spark, sf):
    f = table(spark, sf, "documents").select(F.col("doc_id").alias("frame_index"), F.encode("text", "UTF-8").alias("payload"))
    out = inf.predict(f, inf.stub_model, "frame_index long, category string, confidence double, x_min double, y_min double, x_max double, y_max double")
    return rounded(out.select("frame_index", "category", "confidence"), "confidence")


@query("colour_histograms")
def colour_histograms(spark, sf):
    # Whole texts as pictures: one row of pixels, a third of the bytes wide.
    b = F.encode("text", "UTF-8")
    f = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("observation_id"), F.lit("object").alias("category"), b.alias("payload"), F.length(b).alias("stride_bytes"),
        F.floor(F.length(b) / 3).cast("int").alias("width"), F.lit(1).alias("height"), F.sha2(b, 256).alias("frame_sha256"),
        F.lit(0.0).alias("x_min"), F.lit(0.0).alias("y_min"), F.lit(1.0).alias("x_max"), F.lit(1.0).alias("y_max"))
    return inf.histograms(f, cells=None)[0]


@query("frame_clock", cte("v_lanes", """
with f as (select source_id, session_id, frame_index, row_number() over (partition by source_id order by frame_index) - 1 as i,
    case when frame_index % 11 = 5 then cast(0 as double) else frame_index * 40 + frame_index % 3 end as pos from (select distinct source_id, session_id, frame_index from v_lanes)),
o as (select *, first_value(pos) over (partition by source_id order by i) as origin from f),
walk as (select source_id, session_id, frame_index, i, cast(0 as bigint) as elapsed from o where i = 0
  union all
  select o.source_id, o.session_id, o.frame_index, o.i,
    case when o.pos - o.origin >= 0 and cast(o.pos - o.origin as bigint) > w.elapsed then cast(o.pos - o.origin as bigint) when o.i * 40 > w.elapsed then o.i * 40 end
  from walk w join o on o.source_id = w.source_id and o.i = w.i + 1)
select source_id, session_id, frame_index, elapsed as elapsed_ms from walk union all
select source_id, session_id, frame_index, null from o where not exists (select 1 from walk w where w.source_id = o.source_id and w.i = o.i)"""))
def frame_clock(spark, sf):
    f = view(spark, sf, "v_lanes").select("source_id", "session_id", "frame_index").distinct().withColumns({
        "position_ms": F.when(F.col("frame_index") % 11 == 5, 0.0).otherwise(F.col("frame_index") * 40.0 + F.col("frame_index") % 3), "fps": F.lit(25.0)})
    return inf.repair_clock(f)


@query("pose_tracks_with_posture")
def pose_tracks_with_posture(spark, sf):
    from . import diagnostics as dgn

    c = dgn._candidates(spark, sf)
    box = {f"{a}": F.col("pose_" + a) for a in ("x_min", "y_min", "x_max", "y_max")}
    posture = ps.classify(F.lit(1.0), dgn.po.joints(), dgn.pose_box(), ps.DECODED)
    poses = c.select("source_id", "session_id", "frame_index", (F.col("frame_index") * 40).alias("timestamp_ms"), F.col("pose_ordinal").alias("det_ordinal"),
                     F.lit("person").alias("category"), F.lit(1.0).alias("confidence"), *[v.alias(k) for k, v in box.items()], posture.alias("p"))
    tracks = tr.track(poses, tr.OverlapTracker).select("source_id", "session_id", "frame_index", "det_ordinal", "track_id")
    return tracks.join(poses.select("source_id", "session_id", "frame_index", "det_ordinal", "p"), ["source_id", "session_id", "frame_index", "det_ordinal"]).select(
        "source_id", "session_id", "frame_index", "track_id", "p.posture", F.round("p.confidence", 6).alias("confidence"))
