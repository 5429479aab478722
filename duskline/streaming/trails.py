"""Cross-source trails over a record stream, greedy sampling, and running segment reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.trails import TrailConfig
from .hosting import AHEAD_MS, keyed, with_event_time


def trail_stream(records: DataFrame, key: str, cfg: TrailConfig = TrailConfig(), delay: str = "10 seconds") -> DataFrame:
    """Closed trails per ``key``: when a record cuts the open segment, or the watermark passes its last link.

    The state holds one open segment, at most ``max_records`` members. Records behind the open segment are left out.
    """
    def closed(k, seg):
        sources = sorted({s for _, s, _ in seg})
        if len(sources) < 2:
            return None
        return (k, seg[0][0], seg[-1][0], len(sources), len(seg), ",".join(o for _, _, o in seg))

    def step(k: tuple, rows: pd.DataFrame, text: str | None, flush: bool):
        seg = [tuple(x) for x in json.loads(text)] if text else []
        out = []
        for ts, src, oid in sorted(zip(*[rows[c].tolist() for c in ("timestamp_ms", "source_id", "observation_id")])) if len(rows) else []:
            if seg and (ts, src, oid) <= seg[-1]:
                continue
            cut = seg and (
                ts - seg[-1][0] > cfg.max_link_gap_ms or ts - seg[0][0] > cfg.max_total_span_ms
                or len(seg) >= cfg.max_records or len({s for _, s, _ in seg} | {src}) > cfg.max_sources)
            if cut:
                out.append(closed(k[0], seg))
                seg = []
            seg.append((int(ts), src, oid))
        if flush:
            out.append(closed(k[0], seg))
            seg = []
        rows_out = [o for o in out if o]
        frame = pd.DataFrame(rows_out, columns=[key, "start_ms", "end_ms", "source_count", "record_count", "member_ids"]) if rows_out else None
        return (frame, json.dumps(seg), seg[-1][0] + cfg.max_link_gap_ms + 1) if seg else (frame, None, None)

    timed = with_event_time(records.select(key, "timestamp_ms", "source_id", "observation_id"), delay)
    return keyed(timed, [key], step, f"{key} string, start_ms long, end_ms long, source_count long, record_count long, member_ids string")


def sample_stream(frames: DataFrame, period_ms: int = 360, segment: Sequence[str] = ("source_id", "segment_id"),
                  delay: str = "10 seconds") -> DataFrame:
    """Frames at least ``period_ms`` after the last one taken, per segment.

    The state of a segment is the time from which the next frame is taken; it goes once the watermark has passed that.
    """
    def step(k: tuple, rows: pd.DataFrame, text: str | None, flush: bool):
        if flush:
            return None, None, None
        due = int(text) if text else -1
        out = []
        for ts, fid in sorted(zip(rows["timestamp_ms"].tolist(), rows["frame_id"].tolist())):
            if ts >= due:
                out.append((*k, fid, int(ts)))
                due = int(ts) + period_ms
        frame = pd.DataFrame(out, columns=[*segment, "frame_id", "timestamp_ms"]) if out else None
        return frame, str(due), max(due, int(rows["timestamp_ms"].max()) + 1)

    timed = with_event_time(frames.select(*segment, "frame_id", "timestamp_ms"), delay)
    return keyed(timed, segment, step, ", ".join([*[f"{s} string" for s in segment], "frame_id string, timestamp_ms long"]))


def segment_counts(frames: DataFrame, segment: Sequence[str] = ("source_id", "segment_id"), minutes: int = 1,
                   delay: str = "1 minute") -> DataFrame:
    """Per segment and minute: frames and detections, given out once the watermark has passed the minute."""
    timed = with_event_time(frames, delay)
    return timed.groupBy(F.window("event_time", f"{minutes} minutes"), *segment).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("detections").alias("detections")).select(
        *segment, (F.unix_millis("window.start") - AHEAD_MS).alias("start_ms"), "frames", "detections")
