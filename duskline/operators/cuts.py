"""Greedy cutting of an ordered timeline: each segment runs until a rule forbids the next row.

The rules (gap to the previous row, span from the segment start, rows and distinct sources in the segment) make every
cut depend on the one before, so a whole key cannot be cut by plain windows and must not be collected either. Instead:

1. each (key, time bucket) works out, for every row its first segment could start at, how many rows of the next
   bucket the last segment swallows;
2. these small tables (one row per bucket) are chained per key, giving each bucket its true first segment start;
3. each bucket cuts its rows from that start.

A segment never outlives one bucket boundary because the span limit is below the bucket length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import BUCKET, Columns, map_sorted_groups

NO_LIMIT = 2**62


@dataclass(frozen=True)
class CutRules:
    max_gap_ms: int = NO_LIMIT
    max_span_ms: int = NO_LIMIT
    max_rows: int = NO_LIMIT
    max_sources: int = NO_LIMIT
    bucket_ms: int = 3_600_000

    def __post_init__(self) -> None:
        if self.max_span_ms >= self.bucket_ms:
            raise ValueError("the span limit must be below the bucket length")


def _segment_end(ts: np.ndarray, src: np.ndarray, start: int, rules: CutRules) -> int:
    """First row after ``start`` that may not join its segment."""
    stop = int(np.searchsorted(ts, ts[start] + rules.max_span_ms, side="right"))
    stop = min(stop, start + min(rules.max_rows, len(ts)), len(ts))
    window = ts[start:stop]
    wide = np.flatnonzero(np.diff(window) > rules.max_gap_ms)
    if len(wide):
        stop = start + int(wide[0]) + 1
    if rules.max_sources < NO_LIMIT:
        _, first_seen = np.unique(src[start:stop], return_index=True)
        if len(first_seen) > rules.max_sources:
            stop = start + int(np.sort(first_seen)[rules.max_sources])
    return stop


def greedy_segments(df: DataFrame, keys: Sequence[str], ts: str, source: str, row_id: str,
                    rules: CutRules) -> DataFrame:
    """(keys, row_id, ts, source, cut_id, cut_start_ms) for every row; cut_id is its first row's id."""
    size = rules.bucket_ms
    rows = df.select(*keys, F.col(ts).cast("long").alias("_ts"), F.col(source).alias("_src"),
                     F.col(row_id).cast("string").alias("_id"))
    own = F.floor(F.col("_ts") / F.lit(size)).cast("long")
    borrowed = F.col("_ts") - own * F.lit(size) <= rules.max_span_ms
    spread = rows.withColumn(BUCKET, F.explode(F.when(borrowed, F.array(own, own - 1)).otherwise(F.array(own))))
    spread = spread.withColumn("_own", F.floor(F.col("_ts") / F.lit(size)).cast("long") == F.col(BUCKET))
    part, order = [*keys, BUCKET], ["_ts", "_src", "_id"]
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def arrays(cols: Columns) -> tuple[np.ndarray, np.ndarray, int]:
        return cols["_ts"].astype(np.int64), pd.factorize(cols["_src"])[0], int(cols["_own"].sum())

    def exits(cols: Columns) -> Columns | None:
        t, s, n = arrays(cols)
        if n == 0:  # only borrowed rows: no segment starts here
            return None
        reach = int(np.searchsorted(t[:n], int(cols[BUCKET][0]) * size + rules.max_span_ms, side="right"))
        reach = min(reach, rules.max_rows)
        known: dict[int, int] = {}
        for entry in range(min(reach, n - 1), -1, -1):
            path, at = [], entry
            while at < n and at not in known:
                path.append(at)
                at = _segment_end(t, s, at, rules)
            out = known[at] if at < n else at - n
            known.update((q, out) for q in path)
        table = np.empty(1, dtype=object)
        table[0] = [known.get(e, 0) for e in range(reach + 1)]
        return {**{k: cols[k][:1] for k in part}, "_exits": table}

    def chain(cols: Columns) -> Columns:
        entries, last, carry = [], None, 0
        for b, table in zip(cols[BUCKET].tolist(), cols["_exits"]):
            at = carry if last is not None and b == last + 1 else 0
            entries.append(at)
            carry, last = int(table[at]), b
        return {**{k: cols[k] for k in part}, "_entry": np.array(entries, dtype=np.int64)}

    def cut(cols: Columns) -> Columns | None:
        t, s, n = arrays(cols)
        at, seg = int(cols["_entry"][0]), np.full(len(t), -1)
        while at < n:
            end = _segment_end(t, s, at, rules)
            seg[at:end] = at
            at = end
        taken = seg >= 0
        head = seg[taken]
        return {**{k: cols[k][taken] for k in [*keys, "_id", "_ts", "_src"]},
                "cut_id": cols["_id"][head], "cut_start_ms": t[head]}

    per_bucket = map_sorted_groups(spread, part, order, exits, f"{key_schema}, {BUCKET} long, _exits array<int>")
    entries = map_sorted_groups(per_bucket, keys, [BUCKET], chain, f"{key_schema}, {BUCKET} long, _entry long")
    return map_sorted_groups(
        spread.join(entries, part), part, order, cut,
        f"{key_schema}, _id string, _ts long, _src string, cut_id string, cut_start_ms long",
    ).withColumnsRenamed({"_id": row_id, "_ts": ts, "_src": source})
