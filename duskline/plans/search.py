"""Search, ranking and trail queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import appearance, query_table, search, trails
from ..operators.search import SearchQuery
from .catalog import query
from .views import _spark, cte, table, view


def records(spark, sf):
    """Records with nested attributes."""
    attrs = F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(c).alias("value"), F.col("confidence"),
                 F.lit("adapter").alias("provenance"))
        for n, c in (("type", "attr_type"), ("tier", "attr_tier"))])
    return view(spark, sf, "v_records").withColumn("attributes", attrs)


_PICK = "observation_id, source_id, timestamp_ms, category, confidence"
Q_ERRORS = SearchQuery("errors", start_ms=1_704_100_000_000, end_ms=1_705_500_000_000, categories=("person",),
                       attributes=(("type", "error"), ("tier", "tier-1")), min_confidence=0.25, limit=50)
Q_PREFIX = SearchQuery("prefix", plate_prefix="P1", source_ids=("cam-1", "cam-4"), limit=200)
Q_PLATE = SearchQuery("plate", plate_text="P7", min_confidence=0.5, limit=1000)
Q_TRACK = SearchQuery("tracks", track_ids=("t3", "t5", "t8"), limit=25)


def _where(q: SearchQuery) -> str:
    t = []
    if q.start_ms is not None:
        t.append(f"timestamp_ms >= {q.start_ms}")
    if q.end_ms is not None:
        t.append(f"timestamp_ms <= {q.end_ms}")
    for c, vs in (("source_id", q.source_ids), ("category", q.categories), ("track_id", q.track_ids)):
        if vs:
            t.append(f"{c} in ({', '.join(repr(v) for v in vs)})")
    if q.min_confidence:
        t.append(f"confidence >= cast({q.min_confidence} as double)")
    if q.plate_text:
        t.append(f"plate_text = '{q.plate_text}'")
    if q.plate_prefix:
        t.append(f"starts_with(plate_text, '{q.plate_prefix}')")
    t += [f"attr_{n} = '{v}'" for n, v in q.attributes]
    return " and ".join(t) or "true"


def _search_sql(q: SearchQuery) -> str:
    return cte("v_records", f"select {_PICK} from v_records where {_where(q)} "
                            f"order by timestamp_ms, source_id, observation_id limit {q.limit}")


for _q, _name in ((Q_ERRORS, "search_attributes"), (Q_PREFIX, "search_plate_prefix"), (Q_PLATE, "search_plate_exact")):
    def _run(spark, sf, q=_q):
        return search.search(records(spark, sf), q).selectExpr(*_PICK.split(", "))

    query(_name, _search_sql(_q))(_run)

_BATCH = (Q_ERRORS, Q_PREFIX, Q_PLATE, Q_TRACK)


@query("search_batch", cte("v_records", " union all ".join(
    f"select '{q.query_id}' as query_id, rank, {_PICK} from (select *, row_number() over (order by timestamp_ms, "
    f"source_id, observation_id) as rank from v_records where {_where(q)}) where rank <= {q.limit}" for q in _BATCH)))
def search_batch(spark, sf):
    out = search.batch_search(records(spark, sf), _BATCH)
    return out.selectExpr("query_id", "cast(rank as bigint) rank", *_PICK.split(", "))

# One query per customer; every member is a scalar expression valid in both dialects.
_ASKED = {
    "query_id": "concat('q', cast(c_custkey as varchar(20)))",
    "start_ms": "case when c_custkey % 4 in (1, 2) then 1704067200000 + (c_custkey * 7919 % 700) * 3600000 end",
    "end_ms": "case when c_custkey % 4 = 1 then 1704067200000 + (c_custkey * 7919 % 700 + 1 + c_custkey % 48) * 3600000 end",
    "source_a": "case when c_custkey % 3 = 0 then concat('cam-', cast(c_custkey % 6 as varchar(8))) end",
    "source_b": "case when c_custkey % 6 = 0 then concat('cam-', cast((c_custkey + 1) % 7 as varchar(8))) end",
    "category": "case when c_custkey % 5 = 1 then 'person' when c_custkey % 5 = 2 then 'vehicle' end",
    "track_a": "case when c_custkey % 5 = 3 then concat('t', cast(c_custkey % 90 as varchar(8))) end",
    "track_b": "case when c_custkey % 10 = 3 then concat('t', cast(c_custkey % 70 + 7 as varchar(8))) end",
    "plate_text": "case when c_custkey % 8 = 4 then concat('P', cast(c_nationkey * 2 as varchar(8))) end",
    "plate_prefix": "case when c_custkey % 8 = 0 then concat('P', cast(c_nationkey % 10 as varchar(8))) end",
    "want_type": "case when c_custkey % 7 = 1 then 'error' when c_custkey % 7 = 2 then 'click' end",
    "want_tier": "case when c_custkey % 7 in (2, 3) then concat('tier-', cast(c_nationkey % 3 as varchar(8))) end",
    "min_confidence": "cast(c_custkey % 11 as double) / 20",
    "max_rows": "cast(1 + c_custkey % 40 as bigint)",
}


def asked(spark, sf):
    flat = table(spark, sf, "customer").selectExpr(*[f"{_spark(e)} as {n}" for n, e in _ASKED.items()])
    pair = "struct<name:string,value:string>"
    attributes = F.array_compact(F.array(*[
        F.when(F.col(f"want_{n}").isNotNull(), F.struct(F.lit(n).alias("name"), F.col(f"want_{n}").alias("value")).cast(pair))
        for n in ("type", "tier")]))
    return flat.select(
        "query_id", "start_ms", "end_ms", F.array_compact(F.array("source_a", "source_b")).alias("source_ids"),
        F.array_compact(F.array("category")).alias("categories"), F.array_compact(F.array("track_a", "track_b")).alias("track_ids"),
        "plate_text", "plate_prefix", attributes.alias("attributes"), "min_confidence", "max_rows")


@query("search_query_table", cte("v_records", f"""
with asked as (select {', '.join(f'{e} as {n}' for n, e in _ASKED.items())} from customer),
hits as (select q.query_id, q.max_rows, r.*, row_number() over (partition by q.query_id
    order by r.timestamp_ms, r.source_id, r.observation_id) as rank
  from v_records r join asked q on r.confidence >= q.min_confidence
   and (q.start_ms is null or r.timestamp_ms >= q.start_ms) and (q.end_ms is null or r.timestamp_ms <= q.end_ms)
   and ((q.source_a is null and q.source_b is null) or r.source_id = q.source_a or r.source_id = q.source_b)
   and (q.category is null or r.category = q.category)
   and ((q.track_a is null and q.track_b is null) or r.track_id = q.track_a or r.track_id = q.track_b)
   and (q.plate_text is null or r.plate_text = q.plate_text)
   and (q.plate_prefix is null or starts_with(r.plate_text, q.plate_prefix))
   and (q.want_type is null or r.attr_type = q.want_type) and (q.want_tier is null or r.attr_tier = q.want_tier))
select query_id, rank, {_PICK} from hits where rank <= max_rows"""))
def search_query_table(spark, sf):
    """A query per customer, answered in one run."""
    out = query_table.search_table(records(spark, sf), query_table.checked_queries(asked(spark, sf)).clean, _PICK.split(", "))
    return out.selectExpr("query_id", "cast(rank as bigint) rank", *_PICK.split(", "))


@query("attribute_division", cte("v_records", """
with need as (select distinct concat('req-', attr_type) as query_id, attr_type, 'tier-2' as attr_tier from v_event_records)
select n.query_id, r.observation_id from v_records r join need n
  on r.attr_type = n.attr_type and r.attr_tier = n.attr_tier"""))
def attribute_division(spark, sf):
    attrs = records(spark, sf).select("observation_id", F.explode("attributes").alias("a")).select(
        "observation_id", "a.name", "a.value")
    types = view(spark, sf, "v_event_records").select("attr_type").distinct()
    required = types.select(
        F.concat(F.lit("req-"), "attr_type").alias("query_id"),
        F.explode(F.array(
            F.struct(F.lit("type").alias("name"), F.col("attr_type").alias("value")),
            F.struct(F.lit("tier").alias("name"), F.lit("tier-2").alias("value")))).alias("a"),
    ).select("query_id", "a.name", "a.value")
    return search.divide(attrs, required)


_PAIRS = """
pairs as (select p.observation_id as probe_id, c.observation_id as candidate_id, c.timestamp_ms, c.source_id,
                 c.vec_id, list_sum(list_transform(list_zip(p.vals, c.vals), lambda z: least(z[1], z[2]))) as s
          from v_desc p join v_desc c on p.category = c.category and p.observation_id <> c.observation_id),
ranked as (select *, row_number() over (partition by probe_id order by s desc, timestamp_ms, source_id, candidate_id)
             as rank from pairs)"""


@query("appearance_ranking", cte("v_desc", "with " + _PAIRS.strip() + """
select probe_id, candidate_id, round(s, 9) as similarity, rank from ranked where s >= 0.6 and rank <= 10"""))
def appearance_ranking(spark, sf):
    d = view(spark, sf, "v_desc")
    return appearance.rank_similarity(d, d, min_similarity=0.6, limit=10).selectExpr(
        "probe_id", "candidate_id", "round(similarity, 9) similarity", "cast(rank as bigint) rank")


def _benchmark(spark, sf):
    # A candidate is relevant when the two vector numbers differ by a multiple of three.
    d = view(spark, sf, "v_desc").withColumn("residue", F.pmod(F.substring("observation_id", 2, 20).cast("long"), F.lit(3)))
    per_group = d.groupBy("category").agg((F.count(F.lit(1)) - 1).alias("candidate_count"))
    cases = d.join(per_group, "category").select(F.col("observation_id").alias("probe_id"), "candidate_count")
    # All relevant candidates count, however far down they rank; the ranking is only read to the first of them.
    usable = appearance.admissible(d)
    group = [*appearance.GROUP, "residue"]
    alike = usable.groupBy(*group).agg((F.count(F.lit(1)) - 1).alias("relevant_count")).filter("relevant_count > 0")
    probes = d.join(usable.join(alike, group).select("observation_id", "relevant_count"), "observation_id")
    ranked = appearance.rank_similarity(probes, d, limit=5, until="residue")
    counts = probes.select(F.col("observation_id").alias("probe_id"), "relevant_count")
    return appearance.benchmark_cases(ranked, cases, ranked.filter("hit"), counts=counts)


_BENCH_SQL = _PAIRS.strip() + """,
rel as (select *, abs(cast(substr(probe_id, 2) as bigint) - cast(substr(candidate_id, 2) as bigint)) % 3 = 0 as ok
        from ranked),
cases as (select probe_id, count(*) as candidate_count, count(case when ok then 1 end) as relevant_count,
                 count(case when rank <= 5 then 1 end) as retrieved_count,
                 count(case when rank <= 5 and ok then 1 end) as relevant_retrieved,
                 min(case when ok then rank end) as first_rank
          from rel group by probe_id having count(case when ok then 1 end) > 0),
scored as (select *, cast(relevant_retrieved as double) / retrieved_count as p,
                  cast(relevant_retrieved as double) / relevant_count as r,
                  coalesce(cast(1 as double) / first_rank, 0) as rr, coalesce(first_rank = 1, false) as top1 from cases)
"""


@query("appearance_benchmark_cases", cte("v_desc", "with " + _BENCH_SQL + """
select probe_id, candidate_count, relevant_count, retrieved_count, relevant_retrieved, round(p, 9) as precision_at_k,
       round(r, 9) as recall_at_k, round(rr, 9) as reciprocal_rank, top1 as top1_relevant from scored"""))
def appearance_benchmark_cases(spark, sf):
    out = _benchmark(spark, sf)
    for c in ("precision_at_k", "recall_at_k", "reciprocal_rank"):
        out = out.withColumn(c, F.round(c, 9))
    return out


@query("appearance_benchmark_summary", cte("v_desc", "with " + _BENCH_SQL + """
select count(*) as case_count, round(avg(p), 9) as mean_precision_at_k, round(avg(r), 9) as mean_recall_at_k,
       round(avg(rr), 9) as mean_reciprocal_rank, round(avg(cast(top1 as double)), 9) as top1_rate from scored"""))
def appearance_benchmark_summary(spark, sf):
    out = appearance.benchmark_summary(_benchmark(spark, sf))
    return out.select("case_count", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


# The trail limits are given in hours and days: the records are far apart in time.
HOUR = 3_600_000
PLATE_CFG = trails.TrailConfig(36 * HOUR, 120 * HOUR, 6, 3, bucket_ms=240 * HOUR)
ATTR_CFG = trails.TrailConfig(2 * HOUR, 10 * HOUR, 8, 4, bucket_ms=24 * HOUR)
Q_TRAIL_ATTR = SearchQuery("trail", attributes=(("tier", "tier-1"),), min_confidence=0.3)


def _trail_sql(key: str, where: str, cfg: trails.TrailConfig) -> str:
    """Row-by-row fold as a recursive query: the state is the open segment."""
    return cte("v_records", f"""
with src as (select {key} as k, timestamp_ms, source_id, observation_id,
    row_number() over (partition by {key} order by timestamp_ms, source_id, observation_id) as rn
  from v_records where {where}),
walk as (
  select k, rn, timestamp_ms, source_id, observation_id, timestamp_ms as start_ms, 1 as n, [source_id] as srcs, rn as seg
  from src where rn = 1
  union all
  select s.k, s.rn, s.timestamp_ms, s.source_id, s.observation_id,
    case when c.cut then s.timestamp_ms else w.start_ms end, case when c.cut then 1 else w.n + 1 end,
    case when c.cut then [s.source_id] else list_distinct(list_append(w.srcs, s.source_id)) end,
    case when c.cut then s.rn else w.seg end
  from walk w join src s on s.k = w.k and s.rn = w.rn + 1,
  lateral (select s.timestamp_ms - w.timestamp_ms > {cfg.max_link_gap_ms}
      or s.timestamp_ms - w.start_ms > {cfg.max_total_span_ms} or w.n >= {cfg.max_records}
      or len(list_distinct(list_append(w.srcs, s.source_id))) > {cfg.max_sources} as cut) c)
select k as {key}, min(timestamp_ms) as start_ms, max(timestamp_ms) as end_ms,
  count(distinct source_id) as source_count, count(*) as record_count,
  string_agg(observation_id, ',' order by timestamp_ms, source_id, observation_id) as member_ids
from walk group by k, seg having count(distinct source_id) >= 2""")


def _flat(df, key):
    return df.select(key, "start_ms", "end_ms", "source_count", "record_count",
                     F.array_join(F.col("members.observation_id"), ",").alias("member_ids"))


@query("plate_trails", _trail_sql("plate_text", "category = 'license_plate'", PLATE_CFG))
def plate_trails(spark, sf):
    return _flat(trails.plate_trails(records(spark, sf), None, PLATE_CFG), "plate_text")


@query("attribute_trails", _trail_sql(
    "category", f"category <> 'license_plate' and {_where(Q_TRAIL_ATTR)}", ATTR_CFG))
def attribute_trails(spark, sf):
    return _flat(trails.attribute_trails(records(spark, sf), Q_TRAIL_ATTR, ATTR_CFG), "category")
