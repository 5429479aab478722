"""Persistence: boundaries, batch against a row-by-row machine, and batch against the stream."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from duskline.functions.ids import iso_ms, person_down_event_id, uuid5
from duskline.operators.persistence import PersistenceConfig, event_envelope, missing_markers, person_down_events
from duskline.sources.observations import event_lines, parse_lines
from duskline.streaming.hosting import drain
from duskline.streaming.persistence import Run, follow, person_down_stream
from duskline.streaming.trails import sample_stream

SCHEMA = "source_id string, session_id string, track_id string, timestamp_ms long, posture string, confidence double"
CFG = PersistenceConfig(bucket_ms=20_000)


def obs(spark, rows, track="t"):
    return spark.createDataFrame([("c", "s", track, t, p, c) for t, p, c in rows], SCHEMA)


def run(spark, rows, cfg=CFG):
    return [(r.start_ms, r.end_ms, r.sample_count, r.confidence)
            for r in person_down_events(obs(spark, rows), None, cfg).orderBy("start_ms").collect()]


def down(*times, conf=0.9):
    return [(t, "down", conf) for t in times]


def test_duration_and_gap_are_inclusive(spark):
    assert run(spark, down(0, 750, 1500, 2250, 3000)) == [(0, 3000, 5, 0.9)]
    assert run(spark, down(0, 750, 1500, 2250, 2999)) == []
    assert run(spark, down(0, 751, 1501, 2251, 3001)) == []


def test_needs_enough_samples(spark):
    wide = PersistenceConfig(max_gap_ms=1500, bucket_ms=20_000)
    assert run(spark, down(0, 1500, 3000), wide) == []
    assert run(spark, down(0, 1000, 2000, 3000), wide) == [(0, 3000, 4, 0.9)]


def test_one_event_per_episode_and_again_after_a_break(spark):
    rows = down(*range(0, 8000, 500)) + [(8000, "upright", 0.9)] + down(*range(8500, 12501, 500), conf=0.8)
    assert run(spark, rows) == [(0, 3000, 7, 0.9), (8500, 11500, 7, 0.8)]


def test_unknown_is_bridged_only_within_its_bound(spark):
    rows = down(0, 500, 1000) + [(1300, "unknown", 0.0)] + down(1700, 2200, 2700, 3200)
    assert run(spark, rows) == []
    assert run(spark, rows, PersistenceConfig(max_unknown_gap_ms=700, bucket_ms=20_000)) == [(0, 3200, 7, 0.9)]
    assert run(spark, rows, PersistenceConfig(max_unknown_gap_ms=699, bucket_ms=20_000)) == []


def test_markers_are_given_once_per_absence(spark):
    frames = spark.createDataFrame([("c", "s", t) for t in (0, 100, 200, 300)], "source_id string, session_id string, timestamp_ms long")
    seen = obs(spark, down(0, 300))
    for bucket in (100, 150, 10_000):
        assert [r.timestamp_ms for r in missing_markers(frames, seen, bucket).collect()] == [100]


@pytest.mark.parametrize("bridge", [0, 400, 750])
def test_batch_equals_the_row_by_row_machine(spark, bridge):
    rng = random.Random(11 + bridge)
    cfg = PersistenceConfig(max_unknown_gap_ms=bridge, bucket_ms=9_000)
    rows, want = [], []
    for k in range(60):
        t, state = rng.randint(0, 4000), None
        for _ in range(120):
            t += rng.choice([100, 250, 400, 500, 750, 751, 900])
            p = rng.choices(["down", "unknown", "upright"], [0.93, 0.06, 0.01])[0]
            c = rng.choice([0.69, 0.7, 0.8, 0.9, 0.95, 0.99])
            rows.append(("c", f"s{k}", "t", t, p, c))
            state = state or Run(t, t)
            event = follow(state, cfg, t, p, c)
            if event:
                want.append((f"s{k}", *event))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = person_down_events(df, None, cfg)
    assert sorted((r.session_id, r.start_ms, r.end_ms, r.sample_count, r.confidence) for r in got.collect()) == sorted(want)
    assert len(want) > 10


@pytest.mark.parametrize("heartbeats", [False, True])
def test_stream_equals_batch_over_many_files(spark, tmp_path, heartbeats):
    rng = random.Random(3)
    cfg = PersistenceConfig(max_unknown_gap_ms=600, bucket_ms=30_000)
    rows = []
    for t in range(3_600_000, 3_640_000, 250):
        for k in range(4):
            if rng.random() < 0.9:
                rows.append(("c", "s", f"t{k}", t, rng.choices(["down", "unknown"], [0.9, 0.1])[0], 0.9))
        rows.append(("c", "s", None, t, None, None))
    for i in range(0, len(rows), 97):
        spark.createDataFrame(rows[i:i + 97], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.createDataFrame(rows, SCHEMA)
    seen = whole.filter("track_id is not null")
    want = person_down_events(seen, missing_markers(whole, seen, 5_000) if heartbeats else None, cfg)
    # One file per micro-batch, in the order written; frames are split over batches.
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(person_down_stream(src, cfg, heartbeats), spark, "t")

    def key(df):
        return sorted((r.track_id, r.start_ms, r.end_ms, r.sample_count) for r in df.filter("track_id is not null").collect())

    done = want.filter("end_ms < 3639750")  # the newest frame still waits for a later one
    assert key(got.filter("refused is null")) == key(done) and done.count() > 0


def test_event_id_is_a_version_five_uuid(spark):
    df = spark.createDataFrame([("cam", "ses", "t1", 42)], "a string, b string, c string, d long")
    got = df.select(person_down_event_id(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x"), uuid5(F.lit("abc")).alias("y"),
                    iso_ms(F.lit(1_700_000_000_123)).alias("z")).first()
    assert got.x == str(uuid.uuid5(uuid.NAMESPACE_URL, '["person_down/0.0.1","cam","ses","t1",42]'))
    assert got.y == str(uuid.uuid5(uuid.NAMESPACE_URL, "abc"))
    assert got.z == "2023-11-14T22:13:20.123Z"


def test_lines_in_and_events_out(spark):
    good = '{"timestamp_ms":5,"track_id":"a","posture":"down","confidence":0.5}'
    lines = spark.createDataFrame([(v,) for v in (
        good, "  ", "[1]", "{}", good.replace("5,", '"5",', 1), good.replace("down", "prone"), good.replace("0.5", "1.5"),
        good.replace('"a"', '"a b"'), good[:-1] + ',"x":1}', good.replace('"a"', '"' + "a" * 17_000 + '"'))], "value string")
    parsed = parse_lines(lines, "c", "s")
    assert [r.track_id for r in parsed.rows.collect()] == ["a"]
    assert sorted(r.reason for r in parsed.quarantine.collect()) == sorted(
        ["not_an_object", "wrong_fields", "wrong_types", "posture", "confidence", "track_id", "wrong_fields", "too_long"])
    text = event_lines(event_envelope(person_down_events(obs(spark, down(0, 750, 1500, 2250, 3000)), None, CFG))).first().value
    assert text.startswith('{"analytic_id":"person_down_persistence"') and '"status":"candidate"' in text


def test_any_number_of_tracks_in_a_live_session(spark, tmp_path):
    rows = [("c", "s", f"t{k}", 3_600_000 + t, "down", 0.9) for k in range(1100) for t in range(0, 3500, 500)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / "in"))
    got = drain(person_down_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), CFG), spark, "many")
    assert got.filter("refused is null").count() == 1100 and got.filter("refused is not null").count() == 0


def test_streamed_sampling_keeps_its_period_over_batches(spark, tmp_path):
    """Frames of one segment far apart, with another segment between them, each file a micro-batch."""
    rows = [("A", 0), ("B", 1_500_000), ("A", 3_000_000), ("B", 5_000_000), ("A", 7_200_000), ("B", 9_000_000)]
    for i, (segment, ts) in enumerate(rows):
        spark.createDataFrame([("c", segment, f"f{ts}", 10_000_000 + ts)],
                              "source_id string, segment_id string, frame_id string, timestamp_ms long").coalesce(1).write.mode(
            "append").json(str(tmp_path / "in"))
    frames = (spark.readStream.schema("source_id string, segment_id string, frame_id string, timestamp_ms long")
              .option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    got = drain(sample_stream(frames, 7_200_000), spark, "sampled").collect()
    assert {(r.segment_id, r.timestamp_ms - 10_000_000) for r in got} == {("A", 0), ("A", 7_200_000), ("B", 1_500_000), ("B", 9_000_000)}
