"""Counting and colours without a task that holds ids of a whole input split, or whole frames in Python."""

import hashlib

import numpy as np
import pytest

from duskline.operators import inference
from duskline.plans.ingest import camera_problems, store_audit
from duskline.sources import live, store


def text_of_plan(df):
    return df._jdf.queryExecution().toString()


def test_audit_counts_ids_after_they_are_dealt_out(spark, sf):
    plan = text_of_plan(store_audit(spark, sf)).split("== Physical Plan ==")[1]
    assert plan.count("Join") == 1 and plan.count("Expand") == 0


def test_audit_finds_holes_beyond_64_ordinals(spark):
    sound, twice, hole = [("a", i) for i in range(130)], [("b", i) for i in [*range(129), 7, 130]], [("c", 1)]
    attrs = spark.createDataFrame([(k, i, "x") for k, i in [*sound, *twice, *hole]] + [("d", 0, "x  y"), ("e", 0, None)],
                                  "observation_id string, ordinal int, value string")
    records = spark.createDataFrame([(k,) for k in "abceef"], "observation_id string")
    got = sorted((r.observation_id, r.problem) for r in store.audit(records, attrs).collect())
    assert got == [("b", "ordinal_holes"), ("c", "ordinal_holes"), ("d", "orphan_attribute"), ("d", "text_not_canonical"),
                   ("e", "repeated_id")]


def test_cameras_are_counted_before_they_meet(spark, sf):
    assert text_of_plan(camera_problems(spark, sf)).split("== Physical Plan ==")[1].count("Join") == 1
    listed = spark.createDataFrame([(1, "a", "true"), (2, "b", "true"), (2, "b", "true"), (3, "x", "true"), (4, "d", "false"), (6, None, "true")],
                                   "index long, name string, in_service string")
    wanted = spark.createDataFrame([(i, n) for i, n in enumerate("abcdef", 1)], "index long, name string")
    assert sorted(r["index"] for r in live.camera_problems(listed, wanted).collect()) == [2, 3, 4, 5, 6]


def frame(spark, payload, stride, width, height, box):
    return spark.createDataFrame(
        [("o", "object", payload, width, height, stride, hashlib.sha256(payload).hexdigest(), *box)],
        "observation_id string, category string, payload binary, width int, height int, stride_bytes int, frame_sha256 string, "
        "x_min double, y_min double, x_max double, y_max double")


@pytest.mark.parametrize("width,height,box", [(1, 1, (0, 0, 1, 1)), (200, 90, (0.1, 0.2, 0.93, 1.0)), (70, 3, (0.5, 0, 0.51, 1))])
def test_only_pixels_that_count_travel(spark, width, height, box):
    stride = width * 3 + 5
    payload = np.random.default_rng(3).integers(0, 256, stride * height, dtype=np.uint8).tobytes()
    got, refused = inference.histograms(frame(spark, payload, stride, width, height, tuple(map(float, box))))
    plan = text_of_plan(got).split("== Physical Plan ==")[1]
    assert "MapInArrow" in plan and refused.count() == 0
    lo, hi = (int(np.floor(box[0] * width)), int(np.floor(box[1] * height))), (int(np.ceil(box[2] * width)), int(np.ceil(box[3] * height)))
    xs, ys = ([a + ((2 * i + 1) * (b - a)) // (2 * min(b - a, 64)) for i in range(min(b - a, 64))] for a, b in zip(lo, hi))
    want = np.zeros(64)
    for y in ys:
        for x in xs:
            b, g, r = (v >> 6 for v in payload[y * stride + 3 * x:y * stride + 3 * x + 3])
            want[16 * r + 4 * g + b] += 1
    row = got.first()
    assert row.sample_count == len(xs) * len(ys) and row.vals == list(want / row.sample_count)
