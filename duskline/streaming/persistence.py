"""Person-down persistence over a stream: one state per (source, session), at most one event per run."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import person_down_event_id
from ..operators.persistence import PersistenceConfig
from .hosting import keyed, with_event_time

#: Event time after which an idle session gives up its state, unless the gaps of the rule reach further.
IDLE_MS = 30_000
SCHEMA = ("source_id string, session_id string, track_id string, start_ms long, end_ms long, sample_count long, "
          "confidence double, refused string")


@dataclass
class Run:
    """What a track's next piece of evidence has to know: when it was last seen and last judged, and the down samples
    that still link to what comes (first, last, how many, lowest confidence, unknown evidence since, reported)."""

    seen: int
    judged: int
    first: int | None = None
    last: int | None = None
    samples: int = 0
    lowest: float = 1.0
    unknown_since: bool = False
    reported: bool = False


def reach(cfg: PersistenceConfig) -> int:
    """Event time after which evidence can no longer link to a run: no state older than this matters."""
    return max(IDLE_MS, cfg.max_gap_ms, cfg.max_unknown_gap_ms)


def follow(run: Run, cfg: PersistenceConfig, ts: int, posture: str | None, confidence: float) -> tuple | None:
    """Take one piece of evidence (posture None: the track is missing from a frame); the event that it completes.

    Down samples link when the track was seen within ``max_gap_ms`` and, with unknown evidence between them, are at most
    ``max_unknown_gap_ms`` apart. Anything that does not link ends the run; unknown evidence alone adds nothing to it.
    """
    near = run.last is not None and ts - run.last <= cfg.max_unknown_gap_ms
    unknown = posture is None or posture == "unknown"
    down = posture == "down" and confidence >= cfg.min_confidence
    seen_in_time = posture is None or ts - run.seen <= cfg.max_gap_ms
    links = seen_in_time and ((unknown and near and cfg.max_unknown_gap_ms > 0) or (down and (near or not run.unknown_since)))
    kept = run if links and run.last is not None else Run(run.seen, run.judged)
    run.__dict__.update(asdict(kept), judged=ts, seen=run.seen if posture is None else ts)
    if unknown:
        run.unknown_since = run.last is not None
    if not down:
        return None
    run.first = ts if run.first is None else run.first
    run.last, run.samples, run.lowest, run.unknown_since = ts, run.samples + 1, min(run.lowest, confidence), False
    if run.reported or ts - run.first < cfg.down_duration_ms or run.samples < cfg.min_samples:
        return None
    run.reported = True
    return run.first, ts, run.samples, run.lowest


def evidence(rows: pd.DataFrame, clock: int, frame: list[str], missing_frames: bool) -> Iterator[tuple]:
    """(ts, track, posture, confidence) of rows sorted by time; a track of the frame before that a later frame lacks
    comes as (ts, track, None, 0). ``clock`` and ``frame`` are the time and the tracks of the last frame so far."""
    for ts, part in rows.groupby("timestamp_ms", sort=False):
        ts = int(ts)
        there = part[part["track_id"].notna()]
        names = set(there["track_id"])
        if ts > clock:
            if missing_frames:
                yield from ((ts, track, None, 0.0) for track in frame if track not in names)
            clock, frame = ts, []
        frame = list(dict.fromkeys([*frame, *there["track_id"]])) if ts == clock else frame
        yield from zip([ts] * len(there), there["track_id"], there["posture"], there["confidence"].astype(float))


def person_down_stream(obs: DataFrame, cfg: PersistenceConfig = PersistenceConfig(), missing_frames: bool = False,
                       delay: str = "10 seconds", keys: Sequence[str] = ("source_id", "session_id")) -> DataFrame:
    """Events and refusals (``refused`` set) of an observation stream.

    Rows of a micro-batch are taken in time order. Rows behind a track's last evidence, or behind the session clock,
    are refused as "late" and reported. With ``missing_frames`` rows without a track are frame heartbeats, and a track
    of the frame before that is absent from a frame counts as unknown there; a frame then waits until a later one has
    arrived, since its rows may be spread over micro-batches. A session may have any number of tracks; tracks that
    nothing can link to any more are forgotten. Rows older than the watermark are dropped by Spark and counted in the
    query progress.
    """
    order = "ordinal" if "ordinal" in obs.columns else "track_id"
    names = list(dict.fromkeys(["timestamp_ms", "track_id", "posture", "confidence", order]))
    horizon = reach(cfg)

    def step(key: tuple, rows: pd.DataFrame, text: str | None, flush: bool):
        state = json.loads(text) if text else {"clock": -1, "frame": [], "runs": {}, "wait": []}
        runs = {k: Run(*v) for k, v in state["runs"].items()}
        held = pd.DataFrame(state["wait"], columns=names)
        rows = held if not len(rows) else pd.concat([held, rows[names]]) if len(held) else rows[names]
        wait = rows.iloc[:0]
        if missing_frames and not flush and len(rows):
            newest = rows["timestamp_ms"] == rows["timestamp_ms"].max()
            wait, rows = rows[newest], rows[~newest]
        rows = rows.sort_values(["timestamp_ms", order], kind="stable")
        start, clock, frame = state["clock"], state["clock"], state["frame"]
        out = []
        for ts, track, posture, confidence in evidence(rows, start, frame, missing_frames):
            run = runs.get(track)
            if posture is None:
                if run is not None:
                    follow(run, cfg, ts, None, confidence)
            elif ts < clock or (run is not None and ts <= run.judged):
                out.append((*key, track, None, ts, None, None, "late"))
            else:
                clock, frame = (ts, []) if ts > clock else (clock, frame)
                frame.append(track)
                run = runs.setdefault(track, Run(ts, ts))
                if (event := follow(run, cfg, ts, posture, confidence)) is not None:
                    out.append((*key, track, *event, None))
        if len(rows) and int(rows["timestamp_ms"].max()) > clock:  # heartbeats after the last observation
            clock, frame = int(rows["timestamp_ms"].max()), []
        table = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype(
            {"start_ms": "Int64", "end_ms": "Int64", "sample_count": "Int64"}) if out else None
        if flush:
            return table, None, None
        alive = {k: list(asdict(r).values()) for k, r in runs.items() if clock - r.seen <= horizon}
        waiting = wait.astype(object).where(wait.notna(), None).values.tolist()
        latest = int(wait["timestamp_ms"].max()) if len(wait) else clock
        return table, json.dumps({"clock": clock, "frame": frame, "runs": alive, "wait": waiting}), latest + horizon

    timed = with_event_time(obs, delay)
    got = keyed(timed, keys, step, SCHEMA)
    return got.withColumn("event_id", F.when(F.col("refused").isNull(), person_down_event_id(
        F.col("source_id"), F.col("session_id"), F.col("track_id"), F.col("start_ms"))))
