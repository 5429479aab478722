"""Observation-shaped views over the given tables.

Every view is a list of scalar expressions valid in Spark SQL and in ANSI SQL, so a query and its check read the same
input. ``cte(names, body)`` puts the SQL form of the views in front of a check query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import once

D = "cast({} as double)".format

_BOX = {
    "source_id": "concat('cam-', cast(l_orderkey % 8 as varchar(8)))",
    "session_id": "'s0'",
    "frame_index": "l_orderkey",
    "timestamp_ms": "l_orderkey * 40",
    "det_ordinal": "cast(l_linenumber as bigint) * 10000000000000 + l_partkey * 10000000 + l_suppkey * 100"
                   " + cast(l_quantity as bigint)",
    "category": "l_returnflag",
    "confidence": "cast(30 + (cast(l_quantity as bigint) % 7) * 10 as double) / 100",
    "x_min": "cast((l_partkey * 37) % 800 as double) / 1000",
    "y_min": "cast((l_suppkey * 53) % 800 as double) / 1000",
    "x_max": "least(cast(1 as double), cast((l_partkey * 37) % 800 as double) / 1000"
             " + cast(50 + (cast(l_quantity as bigint) % 15) * 10 as double) / 1000)",
    "y_max": "least(cast(1 as double), cast((l_suppkey * 53) % 800 as double) / 1000"
             " + cast(50 + (l_partkey % 15) * 10 as double) / 1000)",
    "class_id": "cast(l_linenumber as bigint)",
    "line": "cast(l_linenumber as bigint)",
}

# Lanes: each line number keeps to its own column of the picture, so boxes of neighbouring frames overlap.
_LANE = {
    **_BOX,
    "frame_index": "cast(floor(l_orderkey / 8) as bigint)",
    "timestamp_ms": "cast(floor(l_orderkey / 8) as bigint) * 40",
    "category": "case when l_linenumber % 2 = 0 then 'person' else 'vehicle' end",
    "x_min": "cast(l_linenumber * 120 + l_partkey % 30 as double) / 1000",
    "y_min": "cast(200 + l_suppkey % 60 as double) / 1000",
    "x_max": "cast(l_linenumber * 120 + l_partkey % 30 + 100 as double) / 1000",
    "y_max": "cast(500 + l_suppkey % 60 + (l_partkey % 5) * 10 as double) / 1000",
}

_OBS = {
    "source_id": "concat('cam-', cast(user_id % 4 as varchar(8)))",
    "session_id": "'s0'",
    "track_id": "concat('u', cast(user_id as varchar(20)))",
    "timestamp_ms": "cast(floor(({ms}) / 100000) as bigint)",
    "ordinal": "event_id",
    "posture": "case when event_type <> 'error' then 'down' when event_id % 3 = 0 then 'upright' else 'unknown' end",
    "confidence": "cast(69 + event_id % 31 as double) / 100",
}

_EVENT_RECORDS = {
    "observation_id": "concat('e', cast(event_id as varchar(20)))",
    "source_id": "concat('cam-', cast(event_id % 6 as varchar(8)))",
    "timestamp_ms": "{ms}",
    "category": "case when event_id % 5 < 3 then 'person' else 'vehicle' end",
    "confidence": "cast(event_id % 101 as double) / 100",
    "track_id": "concat('t', cast(user_id as varchar(20)))",
    "plate_text": "cast(null as varchar(16))",
    "attr_type": "event_type",
    "attr_tier": "concat('tier-', cast(user_id % 3 as varchar(8)))",
}

_PLATE_RECORDS = {
    "observation_id": "concat('o', cast(o_orderkey as varchar(20)))",
    "source_id": "concat('cam-', cast(o_orderkey % 6 as varchar(8)))",
    "timestamp_ms": "({ms}) + (o_orderkey % 1440) * 60000",
    "category": "'license_plate'",
    "confidence": "cast(o_orderkey % 101 as double) / 100",
    "track_id": "cast(null as varchar(16))",
    "plate_text": "concat('P', cast(o_custkey % 50 as varchar(8)))",
    "attr_type": "o_orderstatus",
    "attr_tier": "o_orderpriority",
}

_SAMPLES = {
    "sample_id": "concat('s', cast(c_custkey as varchar(20)))",
    "site_id": "concat('site-', cast(c_nationkey as varchar(8)))",
    "camera_id": "concat('cam-', cast(c_custkey % 5 as varchar(8)))",
    "start_ms": "c_custkey * 100000",
    "end_ms": "c_custkey * 100000 + 60000 + (c_custkey % 7) * 20000",
}

# view -> (table, ms column, expressions, filter)
_VIEWS: dict[str, tuple[str, str | None, dict[str, str], str | None]] = {
    "v_boxes": ("lineitem", None, _BOX, None),
    "v_lanes": ("lineitem", None, _LANE, None),
    "v_obs": ("events", "ts", _OBS, None),
    "v_event_records": ("events", "ts", _EVENT_RECORDS, None),
    "v_plate_records": ("orders", "o_orderdate", _PLATE_RECORDS, None),
    "v_samples": ("customer", None, _SAMPLES, None),
}

# Views over other views: name -> (parents, ANSI SQL); Spark builds the same thing below.
_DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "v_records": (("v_event_records", "v_plate_records"),
                  "select * from v_event_records union all select * from v_plate_records"),
    "v_desc": ((), """
        select vec_id, observation_id, source_id, timestamp_ms, category,
               list_transform(a, lambda x: x / list_sum(a)) as vals
        from (select vec_id, concat('v', vec_id) as observation_id, concat('cam-', vec_id % 4) as source_id,
                     vec_id * 1000 as timestamp_ms, concat('class-', label) as category,
                     list_transform(embedding, lambda x: abs(cast(x as double))) as a from embeddings)"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "v_records":
        return view(spark, sf_dir, "v_event_records").unionByName(view(spark, sf_dir, "v_plate_records"))
    if name == "v_desc":
        base = table(spark, sf_dir, "embeddings").selectExpr(
            "vec_id", "concat('v', vec_id) observation_id", "concat('cam-', vec_id % 4) source_id",
            "vec_id * 1000 timestamp_ms", "concat('class-', label) category",
            "transform(embedding, x -> abs(cast(x as double))) a")
        # The sum once a row, not once an entry.
        summed = once(base, {"total": F.expr("aggregate(a, cast(0 as double), (s, v) -> s + v)")})
        return summed.selectExpr(
            "vec_id", "observation_id", "source_id", "timestamp_ms", "category", "transform(a, x -> x / total) vals")
    source, ms, cols, where = _VIEWS[name]
    stamp = f"unix_millis(cast({ms} as timestamp))"
    df = table(spark, sf_dir, source)
    if where:
        df = df.filter(where)
    return df.selectExpr(*[f"{_spark(e).replace('{ms}', stamp)} as {c}" for c, e in cols.items()])


def _spark(expr: str) -> str:
    import re

    return re.sub(r"varchar\(\d+\)", "string", expr)


def cte(names: str, body: str) -> str:
    """``with`` clause defining the named views (and what they read), followed by ``body``."""
    order: list[str] = []

    def need(n: str) -> None:
        if n in order:
            return
        for parent in _DERIVED.get(n, ((), ""))[0]:
            need(parent)
        order.append(n)

    for n in names.split():
        need(n)
    parts = []
    for n in order:
        if n in _DERIVED:
            parts.append(f"{n} as ({_DERIVED[n][1]})")
            continue
        source, ms, cols, where = _VIEWS[n]
        picks = ", ".join(f"{e.replace('{ms}', f'(epoch_us({ms}) // 1000)')} as {c}" for c, e in cols.items())
        parts.append(f"{n} as (select {picks} from {source}{' where ' + where if where else ''})")
    head = "with recursive " + ",\n".join(parts) if parts else ""
    body = body.strip()
    if body.lower().startswith("with "):
        return head + ",\n" + body[5:] if head else body
    return f"{head}\n{body}"
