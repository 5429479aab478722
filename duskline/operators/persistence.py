"""Person-down persistence: missing-frame evidence, qualified runs and candidate events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import iso_ms, person_down_event_id
from .scale import BUCKET, bucketed_lead, with_halo

KEYS = ("source_id", "session_id", "track_id")


@dataclass(frozen=True)
class PersistenceConfig:
    down_duration_ms: int = 3000
    max_gap_ms: int = 750
    min_samples: int = 4
    min_confidence: float = 0.7
    max_unknown_gap_ms: int = 0
    bucket_ms: int = 3_600_000

    @property
    def reach_ms(self) -> int:
        return max(self.max_gap_ms, self.max_unknown_gap_ms)

    @property
    def halo_ms(self) -> int:
        """Look-back after which every run still open has already produced its event."""
        steps = max(self.down_duration_ms, (self.min_samples - 1) * self.reach_ms)
        return steps + 2 * self.reach_ms


# The measured variant with a bounded bridge over unknown posture.
MEASURED = PersistenceConfig(min_confidence=0.10, max_unknown_gap_ms=750)


def missing_markers(frames: DataFrame, observations: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """One marker per track and absence: seen in a frame, not seen in the source's next frame."""
    src = ["source_id", "session_id"]
    times = frames.select(*src, "timestamp_ms").distinct()
    nxt = bucketed_lead(times, src, "timestamp_ms", "next_ms", bucket_ms).filter("next_ms is not null")
    seen = observations.select(*KEYS, "timestamp_ms").distinct()
    due = seen.join(nxt, [*src, "timestamp_ms"]).select(*KEYS, F.col("next_ms").alias("timestamp_ms"))
    return due.join(seen, [*KEYS, "timestamp_ms"], "left_anti")


def _evidence(obs: DataFrame, markers: DataFrame | None, cfg: PersistenceConfig, extra: tuple[str, ...]) -> DataFrame:
    kind = (
        F.when((F.col("posture") == "down") & (F.col("confidence") >= cfg.min_confidence), "D")
        .when(F.col("posture") == "unknown", "U")
        .otherwise("X")
    )
    order = F.col("ordinal") if "ordinal" in obs.columns else F.lit(0)
    rows = obs.select(*KEYS, *extra, "timestamp_ms", kind.alias("kind"), F.col("confidence").cast("double"),
                      F.lit(True).alias("observed"), order.cast("long").alias("_ord"))
    if markers is None:
        return rows
    return rows.unionByName(
        markers.select(*KEYS, *extra, "timestamp_ms", F.lit("U").alias("kind"),
                       F.lit(None).cast("double").alias("confidence"),
                       F.lit(False).alias("observed"), F.lit(0).cast("long").alias("_ord")))


def down_runs(obs: DataFrame, markers: DataFrame | None = None, cfg: PersistenceConfig = PersistenceConfig(),
              extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Qualified down samples with the island they belong to, inside each haloed time bucket.

    A run breaks at conflicting evidence, at an observation gap, or at unknown evidence that is not bridged in time.
    A repeated (track, timestamp) is refused: only the first row counts, as in an ordered feed.
    """
    ev = with_halo(_evidence(obs, markers, cfg, extra_keys), "timestamp_ms", cfg.bucket_ms, cfg.halo_ms)
    part = [*KEYS, *extra_keys, BUCKET]
    w = Window.partitionBy(*part).orderBy("timestamp_ms", "_ord")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    ev = ev.withColumn("_dup", F.lag("timestamp_ms").over(w)).filter(
        F.col("_dup").isNull() | (F.col("_dup") != F.col("timestamp_ms")))
    ev = ev.withColumn("_seen", F.last(F.when(F.col("observed"), F.col("timestamp_ms")), True).over(earlier))
    gap = F.col("observed") & (F.col("timestamp_ms") - F.col("_seen") > cfg.max_gap_ms)
    ev = (
        ev.withColumn("_x", F.count(F.when((F.col("kind") == "X") | gap, 1)).over(so_far))
        .withColumn("_u", F.count(F.when(F.col("kind") == "U", 1)).over(so_far))
        .withColumn("_p", F.last(F.when(F.col("kind") == "D", F.struct("timestamp_ms", "_x", "_u")), True)
                    .over(earlier))
        .filter(F.col("kind") == "D")
    )
    bridged = F.col("timestamp_ms") - F.col("_p.timestamp_ms") <= cfg.max_unknown_gap_ms
    starts = (
        F.col("_p").isNull()
        | (F.col("_x") != F.col("_p._x"))
        | ((F.col("_u") != F.col("_p._u")) & ~bridged)
    )
    return ev.withColumn("_island", F.sum(starts.cast("long")).over(so_far)).select(
        *part, "timestamp_ms", "confidence", "_island")


def person_down_events(obs: DataFrame, markers: DataFrame | None = None,
                       cfg: PersistenceConfig = PersistenceConfig(),
                       extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """At most one candidate per run: the first sample long enough after the run's start.

    One exchange on (source, session, track, hour); every group is bounded by the bucket length because a track has
    one observation per millisecond at most.
    """
    runs = down_runs(obs, markers, cfg, extra_keys)
    w = Window.partitionBy(*KEYS, *extra_keys, BUCKET, "_island").orderBy("timestamp_ms")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = (
        runs.withColumn("start_ms", F.first("timestamp_ms").over(so_far))
        .withColumn("sample_count", F.row_number().over(w).cast("long"))
        .withColumn("min_confidence", F.min("confidence").over(so_far))
        .withColumn("_prev", F.lag("timestamp_ms").over(w))
    )

    def crossed(ts, n):
        return (ts - F.col("start_ms") >= cfg.down_duration_ms) & (n >= cfg.min_samples)

    first = crossed(F.col("timestamp_ms"), F.col("sample_count")) & ~F.coalesce(
        crossed(F.col("_prev"), F.col("sample_count") - 1), F.lit(False))
    own = F.floor(F.col("timestamp_ms") / F.lit(cfg.bucket_ms)).cast("long") == F.col(BUCKET)
    return r.filter(first & own).select(
        *KEYS, *extra_keys, "start_ms", F.col("timestamp_ms").alias("end_ms"), "sample_count",
        F.col("min_confidence").alias("confidence"),
        person_down_event_id(F.col("source_id"), F.col("session_id"), F.col("track_id"), F.col("start_ms"))
        .alias("event_id"),
    )


def event_envelope(events: DataFrame, cfg: PersistenceConfig = PersistenceConfig()) -> DataFrame:
    """The nested candidate-event document, one struct column ``event`` per row."""
    start, end = iso_ms(F.col("start_ms")), iso_ms(F.col("end_ms"))
    empty = F.array().cast("array<string>")

    def text(v):
        return F.lit(v)

    thresholds = F.struct(*[F.lit(getattr(cfg, n)).alias(n) for n in (
        "down_duration_ms", "max_gap_ms", "min_samples", "min_confidence", "max_unknown_gap_ms")])
    # The event vocabulary.
    return events.select(F.struct(
        text("0.1").alias("schema_version"), "event_id",
        text("person_down_persistence").alias("analytic_id"),
        text("person_down_candidate").alias("event_type"),
        "source_id", start.alias("start_time"), end.alias("end_time"), "confidence",
        text("review").alias("severity"), text("candidate").alias("status"),
        F.array(F.struct(text("person").alias("type"), "track_id")).alias("objects"),
        empty.alias("zones"),
        F.array(F.struct(text("down_posture_persistence").alias("type"), "sample_count",
                         start.alias("start_time"), end.alias("end_time"))).alias("observations"),
        F.array(F.struct(text("observation_window").alias("type"), "source_id", "session_id", "track_id",
                         F.col("start_ms").alias("start_timestamp_ms"),
                         F.col("end_ms").alias("end_timestamp_ms"))).alias("evidence"),
        empty.alias("relationships"), empty.alias("recommended_actions"),
        F.struct(
            text("0.0.1").alias("analytic_version"),
            text("minimum_input_score_not_calibrated_probability").alias("confidence_basis"),
            text("synthetic_regression_only").alias("maturity"),
            F.array(*[text(v) for v in ("fall", "injury", "cause", "fault", "intent")])
            .alias("inferences_not_supported"),
            thresholds.alias("thresholds")).alias("metadata"),
    ).alias("event"))
