"""Values at and past the edges of what the operators accept, and sequences longer than a batch."""

import hashlib
import random
from fractions import Fraction

from pyspark.sql import functions as F

from duskline.functions.assignment import assign_edges
from duskline.operators import detections as det
from duskline.operators import matching
from duskline.operators.inference import repair_clock
from duskline.sources import live, manifests
from duskline.sources.observations import parse_lines

NAN = float("nan")


def test_face_values_that_are_not_finite_refuse_the_frame(spark):
    good = [1.0, 1.0, 5.0, 5.0, *[0.0] * 10, 0.95]
    bad = [(1, [*good[:14], NAN]), (2, [NAN, *good[1:]]), (3, [1.0, 1.0, float("inf"), 5.0, *good[4:]]), (4, good[:5])]
    rows = [("c", "s", 0, 0, good)] + [r for k, v in bad for r in (("c", "s", k, 0, good), ("c", "s", k, 1, v))]
    raw = spark.createDataFrame(rows, "source_id string, session_id string, frame_index long, row_ordinal long, vals array<double>")
    out = det.landmark_face_detections(raw.withColumns({"width": F.lit(10.0), "height": F.lit(10.0)}))
    assert [r.frame_index for r in out.rows.collect()] == [0]
    assert {(r.frame_index, r.reason) for r in out.refused.collect()} == {
        (1, "not_finite"), (2, "not_finite"), (3, "not_finite"), (4, "bad_length")}


def test_tensor_boxes_must_be_four_finite_numbers(spark):
    boxes = [[.1, .1, .5, .5], [.1, .1, .5, NAN], [.1, .1, .5], [.1, .1, .5, None], None]
    rows = [("c", "s", i, [b], [0.9], [533.0], 1.0) for i, b in enumerate(boxes)]
    out = det.tensor_detections(spark.createDataFrame(
        rows, "source_id string, session_id string, frame_index long, boxes array<array<double>>, scores array<double>, "
              "classes array<double>, num double"), det.SECURITY_CLASSES)
    assert [r.frame_index for r in out.rows.collect()] == [0]
    assert {(r.frame_index, r.reason) for r in out.refused.collect()} == {(i, "bad_box") for i in range(1, 5)}


def test_person_confidence_must_lie_in_the_unit_range(spark):
    rows = [("c", "s", i, 0, 0.0, 1.0, conf, .1, .1, .5, .5) for i, conf in enumerate([1.0, 1.5, -0.1, NAN])]
    raw = spark.createDataFrame(rows, "source_id string, session_id string, frame_index long, row_ordinal long, image_id double, "
                                      "label double, confidence double, x1 double, y1 double, x2 double, y2 double")
    out = det.person_detections(raw)
    assert [r.frame_index for r in out.rows.collect()] == [0]
    assert {(r.frame_index, r.reason) for r in out.refused.collect()} == {
        (1, "bad_confidence"), (2, "bad_confidence"), (3, "not_finite")}


def test_text_after_the_object_is_refused(spark):
    good = '{"timestamp_ms": 1, "track_id": "a", "posture": "down", "confidence": 0.5}'
    lines = [good, " " + good + " ", good + " trailing", good + good, good + "]", good.replace('"a"', '"b}{"')]
    out = parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "c", "s")
    assert out.rows.count() == 2
    assert sorted(r.reason for r in out.quarantine.collect()) == ["not_one_object"] * 3 + ["track_id"]


def test_label_rows_that_repeat_a_track_are_refused(spark):
    row = (0, 1, 7, 10, 10, 20, 20, 1, 0, 0, 0, 0.5)
    rows = spark.createDataFrame([row, row, (1, *row[1:])], manifests_schema())
    got = manifests.label_table(rows, 100, 100)
    assert [r.frame_index for r in got.clean.collect()] == [1]
    assert [(r.frame_number, r.tracking_id, r.rule) for r in got.violations.collect()] == [(0, 7, "repeated")]


def manifests_schema():
    return ", ".join(f"{c} {'double' if c == 'visibility' else 'long'}" for c in manifests._LABEL_COLUMNS)


def test_long_sequences_have_a_digest_and_a_clock(spark):
    n = 120_000
    frames = spark.range(n).select(F.lit("q").alias("sequence_id"), F.col("id").alias("frame_index"),
                                   F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    got = live.frame_manifest_digest(frames.repartition(7)).collect()
    want = hashlib.sha256()
    for i in range(n):
        want.update(f"{i}\t{hashlib.sha256(str(i).encode()).hexdigest()}\n".encode())
    assert [(r.digest, r.frames) for r in got] == [(want.hexdigest(), n)]
    clock = repair_clock(spark.range(n).select(
        F.lit("c").alias("source_id"), F.lit("s").alias("session_id"), F.col("id").alias("frame_index"),
        F.when(F.col("id") % 5 == 0, 0.0).otherwise(F.col("id") * 40.0).alias("position_ms"), F.lit(25.0).alias("fps")))
    assert clock.filter("elapsed_ms = frame_index * 40").count() == n


def test_assignment_by_exhaustion():
    rng = random.Random(1)
    for _ in range(400):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        edges = [(r, c, rng.choice([0.0, .1, .2, .3, rng.random()])) for r in range(n) for c in range(m) if rng.random() < .6]
        weight = {(r, c): Fraction(w) for r, c, w in edges}

        def best(r, used):
            if r == n:
                return (0, Fraction(0))
            ways = [best(r + 1, used)]
            for c in range(m):
                if (r, c) in weight and c not in used:
                    k, w = best(r + 1, used | {c})
                    ways.append((k + 1, w + weight[r, c]))
            return max(ways)

        got = assign_edges(edges)
        assert len({r for r, _ in got}) == len({c for _, c in got}) == len(got)
        assert (len(got), sum((weight[p] for p in got), Fraction(0))) == best(0, frozenset())


def test_one_long_chain_of_intervals(spark):
    """Intervals that all touch are one group; it is read with only the open labels in memory."""
    n = 30_000
    events = spark.range(n).select(F.lit("x").alias("sample_id"), F.col("id").alias("event_id"),
                                   (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + 12).alias("end_ms"))
    labels = events.select("sample_id", F.col("event_id").alias("label_id"), "start_ms", "end_ms")
    got = matching.match_intervals(events, labels)
    assert got.count() == n and got.filter("event_id = label_id and delay_ms = 12").count() == n


def test_a_detection_without_confidence_is_still_a_detection(spark):
    from duskline.operators import tracking

    rows = [("c", "s", 0, 0, 1, "person", None, .1, .1, .3, .3), ("c", "s", 0, 0, 2, "person", .9, .5, .5, .7, .7)]
    dets = spark.createDataFrame(rows, "source_id string, session_id string, frame_index long, timestamp_ms long, det_ordinal long, "
                                       "category string, confidence double, x_min double, y_min double, x_max double, y_max double")
    got = tracking.track(dets, tracking.OverlapTracker).collect()
    assert {r.det_ordinal for r in got} == {1, 2} and len({r.track_id for r in got}) == 2
