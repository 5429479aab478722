"""Persistence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import persistence as p
from .catalog import query
from .views import cte, view

_MARKERS = """
frames as (select distinct source_id, session_id, timestamp_ms from v_obs),
nxt as (select *, lead(timestamp_ms) over (partition by source_id, session_id order by timestamp_ms) as next_ms
        from frames),
seen as (select distinct source_id, session_id, track_id, timestamp_ms from v_obs),
markers as (
  select s.source_id, s.session_id, s.track_id, n.next_ms as timestamp_ms
  from seen s join nxt n using (source_id, session_id, timestamp_ms)
  where n.next_ms is not null and not exists (
    select 1 from seen t where t.source_id = s.source_id and t.session_id = s.session_id
      and t.track_id = s.track_id and t.timestamp_ms = n.next_ms))"""


def _runs_sql(evidence: str, cfg: p.PersistenceConfig) -> str:
    return f"""
clean as (
  select source_id, session_id, track_id, timestamp_ms, confidence, true as observed,
         case when posture = 'down' and confidence >= cast({cfg.min_confidence} as double) then 'D'
              when posture = 'unknown' then 'U' else 'X' end as kind
  from v_obs
  qualify row_number() over (partition by source_id, session_id, track_id, timestamp_ms order by ordinal) = 1),
ev as ({evidence}),
e1 as (select *, last_value(case when observed then timestamp_ms end ignore nulls) over (w rows between unbounded
              preceding and 1 preceding) as seen_ms from ev
       window w as (partition by source_id, session_id, track_id order by timestamp_ms)),
e2 as (select *,
         count(case when kind = 'X' or (observed and timestamp_ms - seen_ms > {cfg.max_gap_ms}) then 1 end) over w as nx,
         count(case when kind = 'U' then 1 end) over w as nu
       from e1 window w as (partition by source_id, session_id, track_id order by timestamp_ms)),
d1 as (select *, lag(timestamp_ms) over w as p_ms, lag(nx) over w as p_x, lag(nu) over w as p_u
       from e2 where kind = 'D' window w as (partition by source_id, session_id, track_id order by timestamp_ms)),
d2 as (select *, sum(case when p_ms is null or nx <> p_x
                       or (nu <> p_u and timestamp_ms - p_ms > {cfg.max_unknown_gap_ms}) then 1 else 0 end)
              over (partition by source_id, session_id, track_id order by timestamp_ms) as island from d1),
d3 as (select *, min(timestamp_ms) over i as start_ms, row_number() over i as n, min(confidence) over i as conf
       from d2 window i as (partition by source_id, session_id, track_id, island order by timestamp_ms)),
hits as (select * from d3 where timestamp_ms - start_ms >= {cfg.down_duration_ms} and n >= {cfg.min_samples}
         qualify row_number() over (partition by source_id, session_id, track_id, island order by timestamp_ms) = 1)
"""


_OUT = """
select source_id, session_id, track_id, start_ms, timestamp_ms as end_ms, cast(n as bigint) as sample_count,
       conf as confidence from hits"""

_WITH_MARKERS = "select * from clean union all by name select *, false as observed, 'U' as kind from markers"
_COLS = ["source_id", "session_id", "track_id", "start_ms", "end_ms", "sample_count", "confidence"]
BRIDGED = p.PersistenceConfig(max_unknown_gap_ms=750, bucket_ms=60_000)
MISSING = p.PersistenceConfig(max_unknown_gap_ms=650, bucket_ms=60_000)
STRICT = p.PersistenceConfig(bucket_ms=60_000)


@query("missing_frame_markers", cte("v_obs", "with " + _MARKERS.strip() + " select * from markers"))
def missing_frame_markers(spark, sf):
    obs = view(spark, sf, "v_obs")
    return p.missing_markers(obs, obs, bucket_ms=600_000)


@query("person_down_strict", cte("v_obs", "with " + _runs_sql("select * from clean", STRICT).strip() + _OUT))
def person_down_strict(spark, sf):
    return p.person_down_events(view(spark, sf, "v_obs"), None, STRICT).select(*_COLS)


@query("person_down_bridged", cte("v_obs", "with " + _runs_sql("select * from clean", BRIDGED).strip() + _OUT))
def person_down_bridged(spark, sf):
    return p.person_down_events(view(spark, sf, "v_obs"), None, BRIDGED).select(*_COLS)


@query("person_down_with_missing",
       cte("v_obs", "with " + _MARKERS.strip() + "," + _runs_sql(_WITH_MARKERS, MISSING) + _OUT))
def person_down_with_missing(spark, sf):
    obs = view(spark, sf, "v_obs")
    markers = p.missing_markers(obs, obs, bucket_ms=600_000)
    return p.person_down_events(obs, markers, MISSING).select(*_COLS)


_ENVELOPE_SQL = cte("v_obs", "with " + _runs_sql("select * from clean", BRIDGED).strip() + """
select sha as event_id, track_id, 'candidate' as status, n as sample_count,
  strftime(make_timestamp(start_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as start_time,
  strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as end_time
from (select *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
        substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' ||
        substr(h, 21, 12) as sha
      from (select *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('["person_down/0.0.1","' || source_id
              || '","' || session_id || '","' || track_id || '",' || start_ms || ']')) as h from hits))""")


@query("person_down_envelope", _ENVELOPE_SQL)
def person_down_envelope(spark, sf):
    events = p.person_down_events(view(spark, sf, "v_obs"), None, BRIDGED)
    return p.event_envelope(events, BRIDGED).select(
        "event.event_id", F.col("event.objects")[0]["track_id"].alias("track_id"), "event.status",
        F.col("event.observations")[0]["sample_count"].alias("sample_count"),
        "event.start_time", "event.end_time")
