"""Groups stay whole where a join on their keys comes first and Spark broadcasts its other side."""

import pytest
from pyspark.sql import functions as F

from duskline.operators.detections import sampled_frames
from duskline.operators.scale import map_sorted_groups
from duskline.operators.trails import TrailConfig, plate_trails


@pytest.fixture(autouse=True)
def many_tasks_and_a_small_side_to_broadcast(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "100000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def spread_rows(spark, n=40_000):
    """Rows of every key in every one of three tasks."""
    return spark.range(0, n, 1, 3).selectExpr(
        "concat('cam-', id % 3) as source_id", "concat('P', id % 5) as plate_text", "id * 7919 % 40000 * 100 as timestamp_ms",
        "concat('o', id) as observation_id", "'license_plate' as category")


def test_sorted_groups_after_a_join_are_whole(spark):
    rows = spread_rows(spark).selectExpr("plate_text", "timestamp_ms")
    other = map_sorted_groups(rows, ["plate_text"], ["timestamp_ms"], lambda c: {"plate_text": c["plate_text"][:1]}, "plate_text string")
    got = map_sorted_groups(rows.join(other, ["plate_text"]), ["plate_text"], ["timestamp_ms"],
                            lambda c: {"plate_text": c["plate_text"][:1], "n": c["timestamp_ms"][:1] * 0 + len(c["timestamp_ms"])},
                            "plate_text string, n long")
    assert sorted(map(tuple, got.collect())) == [(f"P{i}", 8_000) for i in range(5)]


def test_trails_of_rows_in_many_tasks(spark):
    rows = spread_rows(spark)
    cfg = TrailConfig(max_link_gap_ms=2_000, max_total_span_ms=20_000, max_records=8, max_sources=3, bucket_ms=400_000)
    want, seg = set(), []
    for p, t, s, o in [*sorted(map(tuple, rows.select("plate_text", "timestamp_ms", "source_id", "observation_id").collect())), (None,) * 4]:
        if seg and (p != seg[0][0] or t - seg[-1][1] > 2_000 or t - seg[0][1] > 20_000 or len(seg) == 8 or len({x[2] for x in seg} | {s}) > 3):
            if len({x[2] for x in seg}) > 1:
                want.add((seg[0][0], ",".join(x[3] for x in seg)))
            seg = []
        seg.append((p, t, s, o))
    got = plate_trails(rows, None, cfg).select("plate_text", F.array_join(F.col("members.observation_id"), ",")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 1_000


def test_sampling_of_rows_in_many_tasks(spark):
    rows = spread_rows(spark).withColumnRenamed("observation_id", "frame_id")
    want, last = set(), {}
    for s, t, f in sorted(map(tuple, rows.select("source_id", "timestamp_ms", "frame_id").collect())):
        if s not in last or t - last[s] >= 1_000:
            want.add((s, f, t))
            last[s] = t
    got = sampled_frames(rows, 1_000, ["source_id"], bucket_ms=400_000).select("source_id", "frame_id", "timestamp_ms").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 500
