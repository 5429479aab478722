"""Many short keys in a slice make one frame, not one each."""

import pandas as pd
from pyspark.sql import functions as F

from duskline.operators import scale


def test_a_slice_of_short_keys_makes_one_frame(spark):
    df = spark.range(0, 3_000).select((F.col("id") / 3).cast("long").alias("k"), "id")
    counted = spark.sparkContext.accumulator(0)

    def begin():
        return []

    def take(state, c):
        # Frames made so far in this task, seen from within it.
        if not hasattr(pd.DataFrame, "_counted"):
            made = pd.DataFrame.__init__

            def init(self, *a, **k):
                counted.add(1)
                made(self, *a, **k)

            pd.DataFrame.__init__, pd.DataFrame._counted = init, made
        state += c["id"].tolist()
        return {"k": c["k"], "v": [str(i) for i in c["id"]], "n": c["id"] + 1}

    def end(state):
        made = pd.DataFrame.__dict__.get("_counted")
        return {"v": ["end"], "n": [len(state)]} if state and made else None

    got = scale.fold_sorted(df, ["k"], ["id"], begin, take, end, "k long, v string, n long").collect()
    assert sorted((r.k, r.n) for r in got if r.v != "end") == sorted((i // 3, i + 1) for i in range(3_000))
    assert sorted((r.k, r.n) for r in got if r.v == "end") == [(k, 3) for k in range(1_000)]
    assert counted.value < 500
