"""Paired comparisons, rights, readiness and run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import with_order_statistics

APPROVED_TRAINER_LICENSES = ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause")
CLEARED = "cleared-commercial-and-redistribution"


def paired(baseline: DataFrame, candidate: DataFrame, key: Sequence[str], metrics: Sequence[str],
           exposure: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(deltas, refusals). Delta = candidate minus baseline, NULL when either is; keys and exposure must agree."""
    key = list(key)
    cols = [*metrics, *exposure]
    b = baseline.select(*key, *[F.col(c).alias("b_" + c) for c in cols], F.lit(1).alias("_b"))
    c = candidate.select(*key, *[F.col(x).alias("c_" + x) for x in cols], F.lit(1).alias("_c"))
    j = b.join(c, key, "full")
    same = F.lit(True)
    for e in exposure:
        same = same & F.col("b_" + e).eqNullSafe(F.col("c_" + e))
    reason = F.when(F.col("_b").isNull(), "only_candidate").when(F.col("_c").isNull(), "only_baseline").when(
        ~same, "exposure_differs")
    j = j.withColumn("reason", reason)
    deltas = j.filter("reason is null").select(
        *key, *["b_" + m for m in metrics], *["c_" + m for m in metrics],
        *[(F.col("c_" + m) - F.col("b_" + m)).alias("delta_" + m) for m in metrics])
    return deltas, j.filter("reason is not null").select(*key, "reason")


def permits(purpose: str, require_real_world: bool = False) -> Column:
    if purpose not in ("training", "evaluation"):
        raise ValueError("purpose must be training or evaluation")
    ok = F.col("commercial_" + purpose)
    return ok & (F.col("media_origin") == "real_world") if require_real_world else ok


def rights_check(assets: DataFrame, rights: DataFrame, purpose: str, require_real_world: bool = False) -> DataFrame:
    """Assets with ``verdict``: permitted, refused, or unknown_source."""
    r = rights.select("source_id", permits(purpose, require_real_world).alias("_ok"))
    j = assets.join(r, "source_id", "left")
    return j.withColumn("verdict", F.when(F.col("_ok").isNull(), "unknown_source").when(F.col("_ok"), "permitted")
                        .otherwise("refused")).drop("_ok")


def eligible_for_split() -> Column:
    """Whether an asset's own flags allow the split it is declared for."""
    return ~F.col("identifiable_people") & F.col("third_party_rights_cleared") & F.when(
        F.col("split") == "train", F.col("commercial_training_allowed")).otherwise(F.col("commercial_evaluation_allowed"))


def manifest_problems(assets: DataFrame) -> DataFrame:
    """(asset_id, problem): ineligible splits, repeated identities, and splits missing from the manifest."""
    out = assets.filter(~eligible_for_split()).select("asset_id", F.lit("rights").alias("problem"))
    for c in ("asset_id", "sha256", "annotation_id", "annotation_sha256"):
        again = assets.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(c)
        out = out.unionByName(assets.join(again, c, "left_semi").select("asset_id", F.lit("repeated_" + c).alias("problem")))
    seen = assets.agg(F.max((F.col("split") == "train").cast("int")).alias("t"), F.max((F.col("split") == "validation").cast("int")).alias("v"))
    missing = seen.filter("coalesce(t, 0) = 0 or coalesce(v, 0) = 0").select(
        F.lit(None).cast("string").alias("asset_id"), F.lit("missing_split").alias("problem"))
    return out.unionByName(missing).distinct()


def manifest_digest(assets: DataFrame) -> DataFrame:
    """One digest for any number of rows: row digests are combined in a tree by their leading digits."""
    from .rules import digest

    level = assets.select(digest(assets).alias("g"), F.lit(1).cast("long").alias("n"))
    level = level.select("g", F.col("g").alias("s"), "n")
    for width in (6, 3, 0):
        level = level.groupBy(F.substring("g", 1, width).alias("g")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("s")), "\n"), 256).alias("s"), F.sum("n").alias("n"))
    return level.select(F.col("s").alias("digest"), F.col("n").alias("rows"))


def overlap(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Values two splits share; disjoint splits give no rows."""
    return left.select(on).distinct().join(right.select(on).distinct(), on, "left_semi")


def training_blockers(plans: DataFrame) -> DataFrame:
    """Plans with the ordered list of unmet prerequisites and whether training may start."""
    c = F.col
    # The names of the prerequisites, in the order in which they are reported.
    tests = [
        (~c("trainer_license").isin(*APPROVED_TRAINER_LICENSES), "trainer_license_not_approved"),
        (c("dependency_rights_status") != CLEARED, "transitive_dependency_rights_unverified"),
        (F.coalesce(c("pretrained_sha256"), F.lit("")) == "", "pretrained_weight_hash_missing"),
        ((F.coalesce(c("pretrained_license"), F.lit("")) == "") | (c("pretrained_rights_status") != CLEARED), "pretrained_weight_license_unresolved"),
        (F.size("train_subjects") == 0, "training_split_empty"),
        (F.size("validation_subjects") == 0, "validation_split_empty"),
        (F.arrays_overlap("train_subjects", "validation_subjects"), "train_validation_subject_overlap"),
        (F.arrays_overlap("train_subjects", "holdout_subjects"), "train_holdout_subject_overlap"),
        (F.arrays_overlap("validation_subjects", "holdout_subjects"), "validation_holdout_subject_overlap"),
        (~c("export_smoke_tested"), "openvino_export_not_smoke_tested"),
        (~c("cpu_only") | c("paid_compute"), "resource_ceiling_violates_cpu_no-spend_policy"),
        (F.least("max_cpu_threads", "max_wall_minutes", "max_ram_mib", "max_temp_mib", "max_trials") <= 0, "resource_ceiling_invalid"),
    ]
    return plans.withColumn("blockers", F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), n) for t, n in tests]))
                            ).withColumn("ready", F.size("blockers") == 0)


LATENCY = {"median_latency_ms": ("between", 0.5), "p95_latency_ms": ("nearest", 0.95)}


def runtime_metrics(latency: DataFrame, group: Sequence[str], approximate: bool = False) -> DataFrame:
    """fps, mean, nearest-rank p95 and max latency from rows (group, latency_ms, retained_tracks)."""
    group = list(group)
    done = latency.groupBy(*group).agg(
        F.count(F.lit(1)).alias("frames"), (F.sum("latency_ms") / 1000.0).alias("elapsed_seconds"),
        F.avg("latency_ms").alias("mean_latency_ms"), F.max("latency_ms").alias("max_latency_ms"),
        F.max("retained_tracks").alias("max_retained_tracks"),
        *([F.percentile_approx("latency_ms", p, 10_000).alias(n) for n, (_, p) in LATENCY.items()] if approximate else []))
    if not approximate:
        done = with_order_statistics(done, latency, group, "latency_ms", LATENCY)
    return done.withColumn(
        "throughput_fps", F.when(F.col("elapsed_seconds") > 0, F.col("frames") / F.col("elapsed_seconds")))


def suite_report(runs: DataFrame, preparation_ms: float = 0.0) -> DataFrame:
    """Totals over sample runs (frames_processed, elapsed_ms, runtime_version, device) and the single-runtime rule."""
    t = runs.agg(
        F.count(F.lit(1)).alias("samples"), F.sum("frames_processed").alias("total_frames"), F.sum("elapsed_ms").alias("total_elapsed_ms"),
        (F.count_distinct("runtime_version") == 1).alias("single_runtime"), (F.count_distinct("device") == 1).alias("single_device"))
    total = F.col("total_elapsed_ms") + F.lit(float(preparation_ms))
    return t.withColumn("frames_per_second", F.when(F.col("total_elapsed_ms") > 0, F.col("total_frames") * 1000.0 / F.col("total_elapsed_ms"))
                        ).withColumn("frames_per_second_with_preparation", F.when(total > 0, F.col("total_frames") * 1000.0 / total))


def activity_proxy(results: DataFrame) -> DataFrame:
    """Per clip: matches on fall clips, and on normal clips false alerts only where the whole clip is annotated.

    ``results``: clip columns is_fall, annotated_ms (NULL = clip-level label only), duration_ms, matched, missed, events, false_alerts.
    """
    normal, dur, ann = ~F.col("is_fall"), F.col("duration_ms"), F.col("annotated_ms")
    scored = normal & F.coalesce(dur <= ann, F.lit(False))
    hours = dur / 3_600_000.0
    return results.withColumns({
        "fall_matches": F.when(F.col("is_fall"), F.col("matched")), "fall_misses": F.when(F.col("is_fall"), F.col("missed")),
        "normal_events": F.when(normal, F.col("events")), "exposure_ms": F.when(normal, dur),
        "annotated_exposure_ms": F.when(normal, F.least(dur, ann)), "tail_ms": F.when(normal, F.greatest(F.lit(0), dur - ann)),
        "scored_false_alerts": F.when(scored, F.col("false_alerts")), "scored_hours": F.when(scored, hours),
        "scored_false_alert_rate": F.when(scored, F.col("false_alerts") / hours)})


def report_document(row: DataFrame, name: str = "report") -> DataFrame:
    """Each row as one JSON document with names in order."""
    return row.select(F.to_json(F.struct(*sorted(row.columns)), {"ignoreNullFields": "false"}).alias(name))


def binding_problems(cases: DataFrame, annotations: DataFrame) -> DataFrame:
    """(asset_id, problem) where annotations do not belong to the asset they name: hash, size, box count or classes."""
    a = annotations.groupBy("asset_id").agg(
        F.any_value("image_sha256").alias("_sha"), F.any_value("width").alias("_w"), F.any_value("height").alias("_h"),
        F.count("object_id").alias("_n"), F.array_sort(F.collect_set("category")).alias("_c"))
    j = cases.join(a, "asset_id", "left")
    problem = (
        F.when(F.coalesce(F.col("_n"), F.lit(0)) != F.col("annotation_box_count"), "box_count")
        .when(F.col("_sha").isNotNull() & (F.col("_sha") != F.col("sha256")), "hash")
        .when(F.col("_w").isNotNull() & ((F.col("_w") != F.col("width")) | (F.col("_h") != F.col("height"))), "dimensions")
        .when(F.coalesce(F.col("_c"), F.array().cast("array<string>")) != F.array_sort("annotation_classes"), "classes"))
    return j.withColumn("problem", problem).filter("problem is not null").select("asset_id", "problem")
