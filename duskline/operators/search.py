"""Search over observation records: predicates, ordered results and many queries in one scan.

A record has observation_id, source_id, timestamp_ms, category, confidence, track_id, plate_text and
``attributes: array<struct<name, value, ...>>``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import rank_limit

ORDER = ("timestamp_ms", "source_id", "observation_id")
MAX_LIMIT = 1000
MAX_LIST = 256
MAX_ATTRIBUTES = 32
#: Required attributes are broadcast up to so many rows.
BROADCAST_REQUIRED = 100_000


@dataclass(frozen=True)
class SearchQuery:
    """Conjunctive filter; empty members do not constrain."""

    query_id: str = "q"
    start_ms: int | None = None
    end_ms: int | None = None
    source_ids: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    track_ids: tuple[str, ...] = ()
    plate_text: str | None = None
    plate_prefix: str | None = None
    attributes: tuple[tuple[str, str], ...] = ()
    min_confidence: float = 0.0
    limit: int = 100

    def __post_init__(self) -> None:
        if self.plate_text is not None and self.plate_prefix is not None:
            raise ValueError("give an exact plate or a plate prefix")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError("limit must lie in 1..1000")
        if max(map(len, (self.source_ids, self.categories, self.track_ids))) > MAX_LIST:
            raise ValueError("too many filter values")
        if len(self.attributes) > MAX_ATTRIBUTES:
            raise ValueError("too many attribute filters")
        if self.start_ms is not None and self.end_ms is not None and self.end_ms < self.start_ms:
            raise ValueError("the window ends before it starts")

    def predicate(self) -> Column:
        terms: list[Column] = []
        if self.start_ms is not None:
            terms.append(F.col("timestamp_ms") >= self.start_ms)
        if self.end_ms is not None:
            terms.append(F.col("timestamp_ms") <= self.end_ms)
        for name, values in (("source_id", self.source_ids), ("category", self.categories),
                             ("track_id", self.track_ids)):
            if values:
                terms.append(F.col(name).isin(*values))
        if self.min_confidence > 0:
            terms.append(F.col("confidence") >= self.min_confidence)
        if self.plate_text is not None:
            terms.append(F.col("plate_text") == self.plate_text)
        if self.plate_prefix is not None:
            terms.append(F.col("plate_text").startswith(self.plate_prefix))
        terms += [has_attribute(n, v) for n, v in sorted(set(self.attributes))]
        out = F.lit(True)
        for t in terms:
            out = out & t
        return F.coalesce(out, F.lit(False))


def has_attribute(name: str, value: str) -> Column:
    return F.exists("attributes", lambda a: (a["name"] == name) & (a["value"] == value))


def matching(records: DataFrame, q: SearchQuery) -> DataFrame:
    """Every matching record: the scale form used ahead of trails, with no limit."""
    return records.filter(q.predicate())


def search(records: DataFrame, q: SearchQuery) -> DataFrame:
    return matching(records, q).orderBy(*ORDER).limit(q.limit)


def batch_search(records: DataFrame, queries: Sequence[SearchQuery]) -> DataFrame:
    """Many queries answered by one scan: each row is tagged with the queries it satisfies, then ranked per query.

    There is no join; a query matching a large share of the table still moves only ``limit`` rows per task.
    """
    if not queries or len({q.query_id for q in queries}) != len(queries):
        raise ValueError("query ids must be present and unique")
    tags = F.array_compact(F.array(*[
        F.when(q.predicate(), F.struct(F.lit(q.query_id).alias("id"), F.lit(q.limit).alias("lim")))
        for q in queries]))
    tagged = records.withColumn("_q", F.explode(tags)).withColumn("query_id", F.col("_q.id"))
    ranked = rank_limit(tagged, ["query_id"], [F.col(c) for c in ORDER], max(q.limit for q in queries))
    return ranked.filter(F.col("rank") <= F.col("_q.lim")).drop("_q")


def divide(attributes: DataFrame, required: DataFrame) -> DataFrame:
    """(query_id, observation_id) pairs where the record carries every (name, value) its query requires.

    ``attributes``: observation_id, name, value. ``required``: query_id, name, value. Relational division: count
    matched pairs and compare with the number required. A pair that a third of the records carry is no task of its own: up to
    ``BROADCAST_REQUIRED`` required pairs the attributes stay where they are, beyond that Spark splits the hot pairs of the join.
    """
    req = required.select("query_id", "name", "value").distinct()
    need = req.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    if req.limit(BROADCAST_REQUIRED + 1).count() <= BROADCAST_REQUIRED:
        req = F.broadcast(req)
    have = attributes.select("observation_id", "name", "value").distinct()
    hits = have.join(req, ["name", "value"]).groupBy("query_id", "observation_id").agg(
        F.count(F.lit(1)).alias("have"))
    return hits.join(need, "query_id").filter("have = need").select("query_id", "observation_id")


def record_from_track(tracks: DataFrame) -> DataFrame:
    """Track rows with observation_id and evidence as records."""
    return tracks.withColumn("plate_text", F.lit(None).cast("string"))


def record_from_plate(reads: DataFrame) -> DataFrame:
    """Plate reads as records: the weaker of plate and text confidence, fixed category."""
    return (
        reads.withColumn("confidence", F.least("plate_confidence", "text_confidence"))
        .withColumn("category", F.lit("license_plate"))
        .withColumn("track_id", F.lit(None).cast("string"))
        .drop("plate_confidence", "text_confidence")
    )
