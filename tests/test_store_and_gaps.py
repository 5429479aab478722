"""Gaps as intervals, and what a store refuses."""

import random

from duskline.sources import manifests, store


def test_gaps_equal_the_unfolded_plan(spark):
    rng = random.Random(5)
    frames = [(rng.choice(["a", "b", "c", "x", None]), rng.choice([rng.randrange(40), rng.randrange(9000, 9020)])) for _ in range(150)]
    plans = [("a", 3, 9010), ("b", 0, 25), ("b", 20, 10), ("c", 7, 0), ("d", 5, 4), (None, 1, 2)]
    got = manifests.frame_gaps(spark.createDataFrame(frames, "sequence_id string, frame_index long"),
                               spark.createDataFrame(plans, "sequence_id string, first_frame long, frame_count long")).collect()
    have = set(frames)
    want = [(k, f, "missing") for k, first, n in plans for f in range(first, first + n) if k is None or (k, f) not in have]
    want += [(k, f, "unexpected") for k, f in have
             if k is None or not any(k == p and first <= f < first + n for p, first, n in plans)]
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_refused_rows_come_back(spark, tmp_path):
    path = str(tmp_path / "store")
    ddl = "observation_id string, source_id string, timestamp_ms long, category string, confidence double, evidence string"

    def rows(*given):
        return spark.createDataFrame([(i, "c", 1, "car", x, e) for i, x, e in given], ddl)

    def refused(*given):
        return sorted((r.observation_id or "", r.reason) for r in store.append(spark, rows(*given), path).collect())

    assert refused(("a", 0.5, "e"), ("a", 0.5, "e"), ("b", 0.1, None), (None, 0.2, "e")) == [("", "no_id"), ("b", "no_evidence")]
    assert refused(("a", 0.6, "e"), ("b", 0.1, "e"), ("d", 0.1, "e"), ("d", 0.2, "e")) == [("a", "conflict"), ("d", "conflict")]
    assert sorted((r.observation_id, r.confidence) for r in spark.read.parquet(path).collect()) == [("a", 0.5), ("b", 0.1)]
