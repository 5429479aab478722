"""Operator-facing results: playback pointers, trail results, appearance matches and their JSON envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Schema names and size bound of the envelope.
SCHEMA = "analytics.forensic-result.v1"
DESCRIPTOR_SCHEMA, DESCRIPTOR_KIND = "analytics.appearance-descriptor.v1", "model_free.color_histogram.v1"
MAX_BYTES = 1_000_000
MAX_ROLL_MS = 300_000

_EVIDENCE = ("config_sha256:string,event_id:string,model_sha256:string,producer:string,producer_version:string,"
             "source_revision:string")
_HIT = (f"attributes:array<struct<confidence:double,name:string,provenance:string,value:string>>,"
        "authorizes_action:boolean,category:string,confidence:double,"
        f"evidence:struct<{_EVIDENCE}>,identity_claim:boolean,local_track_id:string,observation_id:string,"
        f"plate_text:string,playback:struct<authorizes_action:boolean,evidence:struct<{_EVIDENCE}>,post_roll_ms:bigint,"
        "pre_roll_ms:bigint,source_id:string,timestamp_ms:bigint>,source_id:string,timestamp_ms:bigint")
_PAYLOAD = {
    "hit": "struct<" + _HIT.replace("identity_claim:boolean,local", "identity_claim:boolean,kind:string,local") + ">",
    "trail": f"struct<association_kind:string,association_value:string,authorizes_action:boolean,hits:array<struct<{_HIT}>>,"
             "identity_claim:boolean,kind:string,required_attributes:array<struct<name:string,value:string>>>",
    "appearance_matches": "struct<authorizes_action:boolean,descriptor_kind:string,descriptor_schema:string,"
                          "identity_claim:boolean,kind:string,matches:array<struct<authorizes_action:boolean,"
                          f"hit:struct<{_HIT}>,identity_claim:boolean,similarity:double>>,probe_observation_id:string>",
}


def hit(pre_roll_ms: int = 5000, post_roll_ms: int = 5000, kind: bool = False) -> Column:
    """A record as an operator hit: fields in name order, bound to the record's own evidence."""
    if not (0 <= pre_roll_ms <= MAX_ROLL_MS and 0 <= post_roll_ms <= MAX_ROLL_MS):
        raise ValueError("roll must lie in 0..300000 ms")
    no = F.lit(False)
    ev = F.struct(*[F.col("evidence")[p.split(":")[0]].alias(p.split(":")[0]) for p in _EVIDENCE.split(",")])
    playback = F.struct(
        no.alias("authorizes_action"), ev.alias("evidence"), F.lit(post_roll_ms).cast("long").alias("post_roll_ms"),
        F.lit(pre_roll_ms).cast("long").alias("pre_roll_ms"), "source_id", "timestamp_ms")
    attrs = F.transform("attributes", lambda a: F.struct(*[a[n].alias(n) for n in ("confidence", "name", "provenance", "value")]))
    extra = [F.lit("hit").alias("kind")] if kind else []
    return F.struct(
        attrs.alias("attributes"), no.alias("authorizes_action"), "category", "confidence", ev.alias("evidence"),
        no.alias("identity_claim"), *extra, F.col("track_id").alias("local_track_id"), "observation_id", "plate_text",
        playback.alias("playback"), "source_id", "timestamp_ms")


def hits(records: DataFrame, pre_roll_ms: int = 5000, post_roll_ms: int = 5000, kind: bool = True) -> DataFrame:
    """Hits of records that carry evidence; a record without evidence gives none."""
    return records.filter(F.col("evidence").isNotNull()).select("observation_id", hit(pre_roll_ms, post_roll_ms, kind).alias("payload"))


def trail_results(trails: DataFrame, records: DataFrame, pre_roll_ms: int = 5000, post_roll_ms: int = 5000) -> DataFrame:
    """Trails with full hits, joined by observation id; a trail holds a few dozen records at most."""
    plate = "plate_text" in trails.columns
    key = "plate_text" if plate else "category"
    h = hits(records, pre_roll_ms, post_roll_ms, kind=False)
    member = trails.select(key, "start_ms", F.explode("members").alias("m"),
                           *([] if plate else ["required_attributes"])).select("*", "m.observation_id", "m.timestamp_ms", "m.source_id")
    first = F.min(F.struct("timestamp_ms", "source_id", "observation_id"))
    keyed = member.join(trails.select(key, "start_ms", F.col("members")[0]["observation_id"].alias("trail_id"),
                                      F.explode("members").alias("m")).select("trail_id", "m.observation_id"), "observation_id")
    ordered = F.array_sort(F.collect_list(F.struct("timestamp_ms", "source_id", "observation_id", "payload")))
    empty = F.array().cast("array<struct<name:string,value:string>>")
    g = keyed.join(h, "observation_id").groupBy("trail_id").agg(
        F.any_value(key).alias("_k"), first.alias("_f"), ordered.alias("_o"),
        *([] if plate else [F.any_value("required_attributes").alias("_r")]))
    return g.select("trail_id", F.struct(
        F.lit("exact_plate_text" if plate else "exact_attribute_candidate").alias("association_kind"),
        (F.col("_k") if plate else F.lit(None).cast("string")).alias("association_value"), F.lit(False).alias("authorizes_action"),
        F.transform("_o", lambda x: x["payload"]).alias("hits"), F.lit(False).alias("identity_claim"),
        F.lit("trail").alias("kind"), (empty if plate else F.col("_r")).alias("required_attributes")).alias("payload"))


def appearance_results(ranked: DataFrame, records: DataFrame, pre_roll_ms: int = 5000, post_roll_ms: int = 5000) -> DataFrame:
    """One payload per probe with its ranked matches (bounded by the ranking limit)."""
    no = F.lit(False)
    h = hits(records, pre_roll_ms, post_roll_ms, kind=False).withColumnRenamed("observation_id", "candidate_id")
    item = F.struct(no.alias("authorizes_action"), F.col("payload").alias("hit"), no.alias("identity_claim"), "similarity")
    return ranked.join(h, "candidate_id").groupBy("probe_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", item.alias("m")))).alias("_o")).select(
        F.col("probe_id"), F.struct(
            no.alias("authorizes_action"), F.lit(DESCRIPTOR_KIND).alias("descriptor_kind"),
            F.lit(DESCRIPTOR_SCHEMA).alias("descriptor_schema"), no.alias("identity_claim"),
            F.lit("appearance_matches").alias("kind"), F.transform("_o", lambda x: x["m"]).alias("matches"),
            F.col("probe_id").alias("probe_observation_id")).alias("payload"))


def envelopes(payloads: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """``value``: canonical JSON with names in order and explicit nulls; oversized results become NULL, never cut."""
    text = F.to_json(F.struct("payload", F.lit(schema).alias("schema")), {"ignoreNullFields": "false"})
    return payloads.withColumn("value", text).withColumn(
        "value", F.when(F.octet_length("value") <= MAX_BYTES, F.col("value"))).drop("payload")


def read_envelopes(lines: DataFrame, kind: str, schema: str = SCHEMA) -> DataFrame:
    """Parsed payloads with ``accepted``: the text must survive parsing and writing again unchanged."""
    ddl = f"struct<payload:{_PAYLOAD[kind]},schema:string>"
    again = F.to_json(F.from_json("value", ddl), {"ignoreNullFields": "false"})
    d = F.from_json("value", ddl)
    ok = (again == F.col("value")) & (d["schema"] == schema) & (d["payload"]["kind"] == kind) & (
        F.octet_length("value") <= MAX_BYTES) & ~d["payload"]["identity_claim"] & ~d["payload"]["authorizes_action"]
    return lines.withColumn("payload", d["payload"]).withColumn("accepted", F.coalesce(ok, F.lit(False)))
