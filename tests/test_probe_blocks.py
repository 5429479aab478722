"""Probes meet their candidates many at a time, with the sums of one at a time, and only the first rows are sorted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskline.operators import appearance


def test_many_probes_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    probes, others = (x / x.sum(axis=1, keepdims=True) for x in (rng.random((7, 12)), rng.random((50, 12))))
    others[:7] = probes
    calls = []
    least = np.minimum
    want = []
    for p in probes:
        acc = np.zeros(len(others))
        for value, column in zip(p, others.T):
            acc += least(value, column)
        want.append(np.where((acc > 1.0) & (np.abs(acc - 1.0) <= appearance.TOLERANCE), 1.0, acc))
    monkeypatch.setattr(appearance.np, "minimum", lambda *a, **k: calls.append(1) or least(*a, **k))
    got = appearance.similarities(probes, np.ascontiguousarray(others.T))
    assert np.array_equal(got, np.stack(want)) and len(calls) == 12


def test_first_of_keeps_ties_in_place():
    rng = np.random.default_rng(6)
    for n, limit in ((0, 3), (3, 3), (40, 1), (40, 10), (40, 40), (500, 10)):
        values = rng.integers(0, 12, n) / 7
        assert appearance.first_of(values, limit).tolist() == np.argsort(-values, kind="stable")[:limit].tolist()
        assert appearance.first_of(values, None).tolist() == np.argsort(-values, kind="stable").tolist()


def test_block_pairs_keep_their_tasks(spark):
    """Few bytes, but all pairs: they don't meet in one task."""
    vals = F.array(F.lit(0.25), F.lit(0.75))
    d = spark.range(60).select(F.concat(F.lit("v"), "id").alias("observation_id"), F.lit("cam").alias("source_id"),
                               F.col("id").alias("timestamp_ms"), F.concat(F.lit("class-"), F.col("id") % 20).alias("category"),
                               vals.alias("vals"))
    ranked = appearance.rank_similarity(d, d, limit=5)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < 2:
        pytest.skip("one task anyway")
    assert plan.count("REPARTITION_BY_NUM") == 2 and ranked.count() == 60 * 2
