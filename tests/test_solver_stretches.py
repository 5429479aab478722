"""Frames reach the solver many at a time: they stay whole across batches, and every frame is solved once."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from duskline.operators import evaluate as ev
from duskline.operators import scale
from duskline.operators.matching import edges
from duskline.operators import tracking as tr
from test_tracking import boxes, in_order


def test_groups_stay_whole_whatever_the_batches(spark):
    rng = random.Random(2)
    rows = [(k, i) for k in range(60) for i in range(rng.choice([1, 2, 7, 40]))]
    df = spark.createDataFrame(rows, "k long, i long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = scale.map_sorted_stretches(df, ["k"], ["i"], lambda c, cuts: {
            "k": c["k"][cuts[:-1]], "n": np.diff(cuts)}, "k long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.k, r.n) for r in got) == sorted(pd.DataFrame(rows).groupby(0).size().items())


def test_metrics_solve_every_frame_once(spark):
    df = boxes(spark, [(f, 0.9, (x, 0.1, x + 0.4, 0.5)) for f in range(50) for x in (0.1, 0.15)])
    truth, tracks = df.withColumn("object_id", F.col("det_ordinal")), df.withColumn("track_id", F.col("det_ordinal").cast("string"))
    m = ev.tracking_metrics(truth, tracks)
    assert m._jdf.queryExecution().toString().count("MapInPandas") == 0
    assert m.first().matched_observations == 100 and edges(
        truth, tracks, ["frame_index"], "object_id", "track_id", 0.5).count() == 200


def test_only_pairs_that_mattered_run_chunks_again(spark):
    """A swap of two old tracks that never compete leaves the chunk as it is."""
    m = tr.TwoStageTracker()
    far = [("a", [0.0, 0.0, 0.25, 0.25]), ("a", [0.25, 0.0, 0.5, 0.25]), ("a", [0.75, 0.75, 0.875, 0.875])]
    m.live = [{"category": c, "box": b, "last": 0, "state": "tracked", "label": f"i{i}"} for i, (c, b) in enumerate(far)]
    m.started = True
    between = [0.125, 0.0, 0.375, 0.25]  # half of the first and half of the second track
    d = {"det_ordinal": np.array([1.0, 2.0]), "category": np.array(["a", "a"], dtype=object), "confidence": np.array([0.9, 0.9]),
         "class_id": np.array([0.0, 0.0]), **{n: np.array([between[i], far[2][1][i]]) for i, n in enumerate(("x_min", "y_min", "x_max", "y_max"))}}
    m.step(1, 40, d)
    assert m.ties == {(0, 1)}
