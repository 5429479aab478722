"""Chunked tracking equals the machine run frame by frame; assignment equals brute force."""

from __future__ import annotations

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskline.functions.assignment import assign, match_most
from duskline.operators import evaluate as ev
from duskline.operators import tracking as tr
from duskline.plans.views import view


def brute(weights, valid):
    n, m = valid.shape
    best = (0, Fraction(0))
    for size in range(1, min(n, m) + 1):
        for rows in itertools.combinations(range(n), size):
            for cols in itertools.permutations(range(m), size):
                if all(valid[r, c] for r, c in zip(rows, cols)):
                    best = max(best, (size, sum(Fraction(float(weights[r, c])) for r, c in zip(rows, cols))))
    return best


def test_assignment_is_exact_on_small_matrices():
    rng = random.Random(5)
    for _ in range(600):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        w = np.array([[rng.choice([0.0, 0.1, 0.3, 0.5, rng.random()]) for _ in range(m)] for _ in range(n)])
        ok = np.array([[rng.random() < 0.6 for _ in range(m)] for _ in range(n)])
        got = assign(w, ok)
        assert len({r for r, _ in got}) == len(got) == len({c for _, c in got})
        assert all(ok[r, c] for r, c in got)
        assert (len(got), sum((Fraction(float(w[r, c])) for r, c in got), Fraction(0))) == brute(w, ok)


def test_assignment_prefers_count_over_weight():
    w = np.array([[1.0, 0.1], [0.9, 0.0]])
    assert assign(w, np.array([[True, True], [True, False]])) == [(0, 1), (1, 0)]


def test_unweighted_pairing_is_maximum():
    rng = random.Random(7)
    for _ in range(400):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        choices = [[c for c in range(m) if rng.random() < 0.5] for _ in range(n)]
        ok = np.array([[c in row for c in range(m)] for row in choices])
        got = match_most(choices, list(range(n)))
        assert all(c in choices[r] for c, r in got.items()) and len(set(got.values())) == len(got)
        assert len(got) == brute(np.zeros(ok.shape), ok)[0]


def in_order(df, machine):
    """The machine over each whole session, on the driver."""
    out = {}
    for session, pdf in df.toPandas().groupby("source_id"):
        m = machine()
        for frame, g in pdf.sort_values(["frame_index", "det_ordinal"]).groupby("frame_index"):
            cols = {c: g[c].to_numpy() for c in g.columns}
            for at, label, flags in m.step(int(frame), int(cols["timestamp_ms"][0]), cols):
                out[(session, frame, int(cols["det_ordinal"][at]))] = int(label[1:])
    return out


@pytest.mark.parametrize("machine", [tr.OverlapTracker, tr.TwoStageTracker, tr.OneFrameTracker])
@pytest.mark.parametrize("chunk,warm", [(10_000, 96), (37, 8)])
def test_chunked_tracking_equals_one_pass(spark, sf, machine, chunk, warm):
    df = view(spark, sf, "v_lanes").repartition(5)
    want = in_order(df, machine)
    got = tr.track(df, machine, chunk_frames=chunk, warm_frames=warm)
    have = {(r.source_id, r.frame_index, r.det_ordinal): int(r.track_id.split("-")[1]) for r in got.collect()}
    assert have == want


def boxes(spark, rows):
    return spark.createDataFrame(
        [("c", "s", f, f * 40, i, "person", conf, *box) for i, (f, conf, box) in enumerate(rows)],
        "source_id string, session_id string, frame_index long, timestamp_ms long, det_ordinal long, category string,"
        "confidence double, x_min double, y_min double, x_max double, y_max double")


A, B = (0.1, 0.1, 0.3, 0.5), (0.6, 0.1, 0.8, 0.5)


def ids(df):
    return [(r.frame_index, r.track_id) for r in df.orderBy("frame_index", "det_ordinal").collect()]


def test_overlap_tracker_memory_is_two_frames(spark):
    frames = boxes(spark, [(i, 0.9, A) for i in range(9)])
    kept = ids(tr.track(boxes(spark, [(0, 0.9, A), (3, 0.9, A)]), tr.OverlapTracker, frames))
    lost = ids(tr.track(boxes(spark, [(0, 0.9, A), (4, 0.9, A)]), tr.OverlapTracker, frames))
    assert kept == [(0, "track-000001"), (3, "track-000001")]
    assert lost == [(0, "track-000001"), (4, "track-000002")]


def test_two_stage_probation_and_low_confidence(spark):
    rows = [(0, 0.9, A), (1, 0.3, A), (2, 0.9, A), (2, 0.9, B), (3, 0.9, B)]
    got = ids(tr.track(boxes(spark, rows), tr.TwoStageTracker))
    # B starts unconfirmed in frame 2 and is reported once confirmed in frame 3.
    assert got == [(0, "bt-000001"), (1, "bt-000001"), (2, "bt-000001"), (3, "bt-000002")]


def test_two_stage_recovers_a_lost_track_after_its_buffer_once(spark):
    rows = [(0, 0.9, A), (1, 0.9, B), (40, 0.9, A)]
    got = ids(tr.track(boxes(spark, rows), tr.TwoStageTracker))
    assert (40, "bt-000001") in got


def test_one_frame_tracker_forgets_at_once(spark):
    rows = [(0, 0.9, A), (1, 0.55, A), (2, 0.9, B), (3, 0.55, A)]
    assert ids(tr.track(boxes(spark, rows), tr.OneFrameTracker)) == [
        (0, "iou-000001"), (1, "iou-000001"), (2, "iou-000002")]


def test_continuity_segments_and_totals(spark):
    rows = [(0, 0.5, A), (0, 0.9, B), (1, 0.4, B), (1, 0.99, A), (3, 0.7, A), (4, 0.8, B)]
    frames = boxes(spark, [(i, 0.9, A) for i in range(5)])
    out = tr.continuity(boxes(spark, rows), frames, chunk_frames=2, warm_frames=1)
    got = [(r.frame_index, r.selected, r.segment, r.starts_segment, r.continuity_lost, r.linked)
           for r in out.orderBy("frame_index").collect()]
    assert got == [
        (0, True, 1, True, False, False), (1, True, 1, False, False, True), (2, False, None, False, True, False),
        (3, True, 2, True, False, False), (4, True, 3, True, True, False)]
    t = tr.continuity_totals(out).first()
    assert (t.frames, t.selected_frames, t.transitions, t.linked_transitions, t.resets) == (5, 4, 2, 1, 1)
    assert t.min_confidence == 0.4


def test_continuity_uses_a_turned_view_only_when_linked(spark):
    rows = [(0, 0.9, A), (1, 0.8, A), (2, 0.9, B), (3, 0.9, B)]
    cand = boxes(spark, rows).withColumn("turn", F.when(F.col("frame_index").isin(1, 2), 1).otherwise(0).cast("long"))
    out = tr.continuity(cand, cand, fallback=True)
    got = [(r.frame_index, r.selected, r.used_fallback) for r in out.orderBy("frame_index").collect()]
    assert got == [(0, True, False), (1, True, True), (2, False, False), (3, True, False)]


def test_switches_and_fragmentations_across_buckets(spark):
    seen = {0: "a", 1: None, 2: "a", 3: "b", 4: None, 5: None, 6: "c"}
    truth = boxes(spark, [(f, 1.0, A) for f in seen]).withColumn("object_id", F.lit("o"))
    tracks = boxes(spark, [(f, 1.0, A) for f, t in seen.items() if t]).withColumn(
        "track_id", F.element_at(F.create_map(*[F.lit(x) for f, t in seen.items() if t for x in (f, t)]), F.col("frame_index").cast("int")))
    for bucket in (1, 2, 3, 100):
        m = ev.tracking_metrics(truth, tracks, bucket_frames=bucket).first()
        assert (m.frames, m.ground_truth_observations, m.matched_observations, m.misses) == (7, 7, 4, 3)
        assert (m.id_switches, m.fragmentations, m.false_track_observations) == (2, 2, 0)
        assert m.mean_matched_iou == 1.0


def test_session_violations(spark):
    rows = boxes(spark, [(0, 0.9, A), (1, 0.9, A), (2, 0.9, A)])
    assert tr.session_violations(rows, bucket_frames=2).count() == 0
    bad = rows.withColumn("timestamp_ms", F.when(F.col("frame_index") == 2, 0).otherwise(F.col("timestamp_ms")))
    assert tr.session_violations(bad, bucket_frames=2).first().violations == 1
