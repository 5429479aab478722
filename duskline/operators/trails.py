"""Cross-source trails: exact-plate trails and attribute candidate trails."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import CutRules, greedy_segments
from .search import SearchQuery, matching, search


@dataclass(frozen=True)
class TrailConfig:
    max_link_gap_ms: int = 60_000
    max_total_span_ms: int = 300_000
    max_records: int = 32
    max_sources: int = 8
    bucket_ms: int = 3_600_000

    @property
    def rules(self) -> CutRules:
        return CutRules(self.max_link_gap_ms, self.max_total_span_ms, self.max_records, self.max_sources,
                        self.bucket_ms)


def _trails(records: DataFrame, key: str, cfg: TrailConfig) -> DataFrame:
    cut = greedy_segments(records, [key], "timestamp_ms", "source_id", "observation_id", cfg.rules)
    member = F.struct("timestamp_ms", "source_id", "observation_id")
    return (
        cut.groupBy(key, "cut_id", "cut_start_ms")
        .agg(F.sort_array(F.collect_list(member)).alias("members"),
             F.count_distinct("source_id").alias("source_count"),
             F.max("timestamp_ms").alias("end_ms"))
        .filter("source_count >= 2")
        .select(key, F.col("cut_start_ms").alias("start_ms"), "end_ms", "source_count",
                F.size("members").cast("long").alias("record_count"), "members",
                F.lit(False).alias("identity_claim"), F.lit(False).alias("authorizes_action")))


def plate_trails(records: DataFrame, q: SearchQuery | None = None, cfg: TrailConfig = TrailConfig(),
                 apply_limit: bool = False) -> DataFrame:
    """Trails of one exact plate over at least two sources. ``apply_limit`` keeps the query's row limit first."""
    if q is not None:
        records = search(records, q) if apply_limit else matching(records, q)
    plates = records.filter((F.col("category") == "license_plate") & F.col("plate_text").isNotNull())
    return _trails(plates, "plate_text", cfg)


def attribute_trails(records: DataFrame, q: SearchQuery, cfg: TrailConfig = TrailConfig(),
                     apply_limit: bool = False) -> DataFrame:
    """Candidate trails per category of records carrying every required attribute; plates are left out."""
    if not q.attributes:
        raise ValueError("attribute trails need attribute filters")
    found = search(records, q) if apply_limit else matching(records, q)
    required = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"))
                         for n, v in sorted(set(q.attributes))])
    return _trails(found.filter(F.col("category") != "license_plate"), "category", cfg).withColumn(
        "required_attributes", required)
