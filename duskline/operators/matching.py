"""Pairing labels with results: gated edges, exact assignment per frame, and interval matching per sample."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assignment import assign_edges
from ..functions.geometry import iou, iou_scaled
from .scale import Columns, fold_sorted, islands, map_sorted_stretches

BOX = ("x_min", "y_min", "x_max", "y_max")


def edges(left: DataFrame, right: DataFrame, frame: Sequence[str], left_id: str, right_id: str, min_iou: float,
          category: bool = True, scaled: bool = False) -> DataFrame:
    """Pairs inside a frame (and category) whose IoU reaches ``min_iou``: an equi-join, then a filter."""
    on = [*frame, *(["category"] if category else [])]
    lt = left.select(*on, F.col(left_id).alias("left_id"), *[F.col(c).alias("l_" + c) for c in BOX])
    rt = right.select(*on, F.col(right_id).alias("right_id"), *[F.col(c).alias("r_" + c) for c in BOX])
    a, b = (tuple(F.col(p + c) for c in BOX) for p in ("l_", "r_"))
    value = (iou_scaled if scaled else iou)(a, b)  # type: ignore[arg-type]
    return lt.join(rt, on).withColumn("weight", value).filter(F.col("weight") >= min_iou).select(
        *on, "left_id", "right_id", "weight")


def best_pairs(edge: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Maximum number of pairs per frame, then maximum total weight.

    An edge whose two ends have no other edge is a pair already and never leaves the JVM. The rest goes through the
    exact solver, one (bounded) frame at a time. Rows are dealt out by frame once, which serves both counts and the
    solver.
    """
    frame = list(frame)
    edge = edge.repartition(*frame)

    def degree(side: str):
        return F.count(F.lit(1)).over(Window.partitionBy(*frame, side))

    d = edge.withColumn("_l", degree("left_id")).withColumn("_r", degree("right_id"))
    alone = (F.col("_l") == 1) & (F.col("_r") == 1)
    cols = [*frame, "left_id", "right_id", "weight"]
    contested = d.filter(~alone).select(cols)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in contested.schema)

    def solve(c: Columns, cuts: list[int]) -> Columns:
        left, right, weight = (c[n].tolist() for n in ("left_id", "right_id", "weight"))
        keep: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            # Rows arrive in (left, right) order, so positions number both sides canonically.
            rows, columns = ({name: n for n, name in enumerate(sorted(set(side[a:b])))} for side in (left, right))
            at = {(rows[left[i]], columns[right[i]]): i for i in range(a, b)}
            found = assign_edges([(rows[left[i]], columns[right[i]], weight[i]) for i in range(a, b)])
            keep += [at[p] for p in found]
        return {n: c[n][np.array(keep, dtype=np.int64)] for n in cols}

    solved = map_sorted_stretches(contested, frame, ["left_id", "right_id"], solve, schema)
    return d.filter(alone).select(cols).unionByName(solved)


def match_intervals(events: DataFrame, labels: DataFrame, tolerance_ms: int = 0, bucket_ms: int = 3_600_000) -> DataFrame:
    """One-to-one event/label pairs per sample, as many as possible, nested intervals included.

    ``events``: sample_id, event_id, start_ms, end_ms. ``labels``: sample_id, label_id, start_ms, end_ms. Samples are
    cut where no interval reaches across, so a long recording is many small groups; a group is read along its time line
    with only those labels in memory that a later event can still reach. Events are taken by end and get, of the open
    labels that close at or after their start, the one that closes first; later events may begin earlier, so labels before
    it stay.
    """
    ev = events.select("sample_id", F.lit(0).alias("kind"), F.col("event_id").cast("string").alias("id"),
                       "start_ms", "end_ms", F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"))
    lb = labels.select("sample_id", F.lit(1).alias("kind"), F.col("label_id").cast("string").alias("id"),
                       "start_ms", "end_ms", (F.col("start_ms") - tolerance_ms).alias("lo"),
                       (F.col("end_ms") + tolerance_ms).alias("hi"))
    groups = islands(ev.unionByName(lb), ["sample_id"], "lo", "hi", "island", bucket_ms).drop("_before")
    w = Window.partitionBy("sample_id", "island")
    mixed = groups.withColumn("_k", F.max("kind").over(w) - F.min("kind").over(w)).filter("_k = 1").drop("_k")
    # One time line: a label counts from where it opens, an event from where it ends, labels first at the same moment.
    line = mixed.select("sample_id", "island", F.when(F.col("kind") == 1, F.col("lo")).otherwise(F.col("end_ms")).alias("moment"),
                        (1 - F.col("kind")).alias("turn"), "start_ms", "id", "end_ms", "hi")
    # The earliest start of all events from a bucket of the time line on: labels that close before it are out of reach.
    line = line.withColumn("part", F.floor(F.col("moment") / F.lit(bucket_ms)).cast("long"))
    onward = Window.partitionBy("sample_id", "island").orderBy("part").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    reach = line.groupBy("sample_id", "island", "part").agg(F.min(F.when(F.col("turn") == 1, F.col("start_ms"))).alias("least"))
    reach = reach.select("sample_id", "island", "part", F.coalesce(F.min("least").over(onward), F.lit((1 << 63) - 1)).alias("reach"))
    line = line.join(reach, ["sample_id", "island", "part"]).drop("part")
    sample_type = events.schema["sample_id"].dataType.simpleString()

    def take(waiting: list, c: Columns) -> Columns | None:
        """``waiting``: labels in reach as (closes, start, id), sorted."""
        got = []
        for turn, start, end, close, name, least in zip(
                *(c[n].tolist() for n in ("turn", "start_ms", "end_ms", "hi", "id", "reach"))):
            if turn == 0:
                bisect.insort(waiting, (close, start, name))
                continue
            del waiting[:bisect.bisect_left(waiting, (least,))]
            at = bisect.bisect_left(waiting, (start,))
            if at < len(waiting):
                _, began, label = waiting.pop(at)
                got.append((c["sample_id"][0], name, label, end - began))
        return dict(zip(("sample_id", "event_id", "label_id", "delay_ms"), zip(*got))) if got else None

    return fold_sorted(line, ["sample_id", "island"], ["moment", "turn", "start_ms", "id"], list, take, lambda waiting: None,
                       f"sample_id {sample_type}, event_id string, label_id string, delay_ms long")


def overlapping_samples(samples: DataFrame, keys: Sequence[str] = ("site_id", "camera_id"),
                        bucket_ms: int = 86_400_000) -> DataFrame:
    """Samples of one camera that begin before an earlier one has ended."""
    return islands(samples, list(keys), "start_ms", "end_ms", "island", bucket_ms).filter(
        F.col("start_ms") < F.col("_before")).drop("_before", "island")
