"""Retrieval measures where a category holds more candidates than a ranking keeps."""

from pyspark.sql import functions as F

from duskline.operators import appearance
from duskline.plans import search


def test_relevance_beyond_a_thousand_candidates(spark, monkeypatch):
    """v1 and v4 alone have residue 1 and are least alike: the first relevant rank comes after all others."""
    n = F.col("id")
    desc = spark.range(1800).filter((n % 3 != 1) | (n < 6)).select(
        F.concat(F.lit("v"), n).alias("observation_id"), F.lit("cam").alias("source_id"), n.alias("timestamp_ms"),
        F.lit("a").alias("category"), F.when(n == 1, F.array(F.lit(1.0), F.lit(0.0))).when(
            n == 4, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(0.5), F.lit(0.5))).alias("vals"))
    monkeypatch.setattr(search, "view", lambda *a: desc)
    got = {r.probe_id: r for r in search._benchmark(spark, "").collect()}
    assert len(got) == 1202 and {r.candidate_count for r in got.values()} == {1201}
    assert got["v0"].relevant_count == got["v2"].relevant_count == 599 and got["v1"].relevant_count == 1
    assert got["v1"].reciprocal_rank == 1 / 1201 and got["v1"].relevant_retrieved == 0
    assert got["v0"].recall_at_k == got["v0"].relevant_retrieved / 599


def test_first_relevant_rank_in_small_blocks(spark):
    n = F.col("id")
    desc = spark.range(120).select(
        F.concat(F.lit("v"), n).alias("observation_id"), F.lit("cam").alias("source_id"), n.alias("timestamp_ms"),
        F.lit("a").alias("category"), (n % 11).alias("mark"),
        F.array((n * 37 % 101) / 101.0, 1 - (n * 37 % 101) / 101.0).alias("vals"))
    whole = appearance.rank_similarity(desc, desc, limit=1000).collect()
    number = {r: int(r[1:]) for r in {r.probe_id for r in whole}}
    first = {}
    for r in whole:
        if number[r.probe_id] % 11 == number[r.candidate_id] % 11:
            first[r.probe_id] = min(first.get(r.probe_id, 1000), r["rank"])
    want = {(r.probe_id, r.candidate_id, r["rank"]) for r in whole if r["rank"] <= max(3, first[r.probe_id])}
    for rows in (16, 2048):
        got = appearance.rank_similarity(desc, desc, limit=3, block_rows=rows, until="mark").collect()
        assert {(r.probe_id, r.candidate_id, r["rank"]) for r in got} == want
