"""Exact order statistics against plain Python."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from duskline.operators.compare import runtime_metrics
from duskline.operators.quantiles import order_statistics, with_order_statistics

WANTED = {"median": ("between", 0.5), "q10": ("between", 0.1), "p95": ("nearest", 0.95), "least": ("nearest", 0.0),
          "most": ("nearest", 1.0)}


def plain(values, how, fraction):
    values = sorted(values)
    if not values:
        return None
    if how == "nearest":
        return values[max(math.ceil(fraction * len(values)) - 1, 0)]
    at = fraction * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return float(low) if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


@pytest.mark.parametrize("kind,ranges", [("double", 4), ("long", 64)])
def test_order_statistics_equal_a_sorted_list(spark, kind, ranges):
    rng = random.Random(5)
    rows = []
    for k, n in (("hot", 3000), ("tied", 400), ("two", 2), ("one", 1), (None, 57), ("empty", 0)):
        for i in range(n):
            v = rng.choice([1, 2, 2, 7]) if k == "tied" else rng.randint(-10**6, 10**6)
            rows.append((k, i % 2, v if kind == "long" else v / 7))
    rows += [("empty", 0, None), ("one", 1, None), ("hot", 0, None)]
    df = spark.createDataFrame(rows, f"k string, half int, v {kind}").repartition(5)
    want: dict[tuple, list] = defaultdict(list)
    for k, h, v in rows:
        want[k, h] += [] if v is None else [v]
    got = with_order_statistics(df.groupBy("k", "half").agg(F.count("v").alias("n")), df, ["k", "half"], "v", WANTED, ranges)
    assert dict(got.dtypes)["p95"] == {"long": "bigint", "double": "double"}[kind]
    have = {(r.k, r.half): r for r in got.collect()}
    assert have.keys() == want.keys()
    for key, values in want.items():
        assert have[key].n == len(values)
        for name, (how, fraction) in WANTED.items():
            assert have[key][name] == plain(values, how, fraction), (key, name)
    alone = order_statistics(df, ["k", "half"], "v", WANTED, ranges)
    assert alone.columns == ["k", "half", "n", *WANTED]
    assert {(r.k, r.half): r.asDict() for r in alone.collect()} == {k: r.asDict() for k, r in have.items() if r.n}


def test_one_group_and_no_rows(spark):
    df = spark.range(101).select(F.col("id").alias("v"))
    got = with_order_statistics(df.agg(F.count("v").alias("n")), df, [], "v", WANTED).first()
    assert (got.n, got.median, got.p95, got.least, got.most) == (101, 50.0, 95, 0, 100)
    empty = df.filter("v < 0")
    assert with_order_statistics(empty.agg(F.count("v").alias("n")), empty, [], "v", WANTED).first().median is None


def test_runtime_metrics_hold_no_group(spark):
    rows = spark.range(500).selectExpr("'t' tracker", "cast(id as double) latency_ms", "id retained_tracks")
    made = runtime_metrics(rows, ["tracker"])
    r = made.first()
    assert (r.median_latency_ms, r.p95_latency_ms, r.max_latency_ms, r.frames) == (249.5, 474.0, 499.0, 500)
    plan = made._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "median(" not in plan and "percentile_disc" not in plan
