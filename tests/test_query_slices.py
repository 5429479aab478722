"""Queries of a table answered part by part of slices of time."""

import pytest
from pyspark.sql import functions as F

from duskline.operators import query_table as qt
from duskline.plans.search import search_query_table
from test_query_table import QUERY, RECORD, compared, made


@pytest.fixture
def slices(monkeypatch):
    for name, value in {"JOINED": -1, "PART": 40, "ASKED": 30, "GIVEN": 2000}.items():
        monkeypatch.setattr(qt, name, value)


def test_slices_against_a_plain_scan(spark, slices):
    compared(spark, *made(4, 500, 200))


def test_keys_that_tasks_do_not_know(spark, slices, monkeypatch):
    monkeypatch.setattr(qt, "BROADCAST_KEYS", -1)
    compared(spark, *made(5, 300, 120))


def test_one_moment_and_no_time(spark, slices):
    records, queries = made(6, 400, 100)
    records = [(*r[:2], None if i % 5 == 0 else 777 if i % 3 else r[2], *r[3:]) for i, r in enumerate(records)]
    compared(spark, records, queries)


def test_confidence_that_is_no_number(spark, slices):
    records = [(f"o{i}", "c", i, "p", [0.2, float("nan"), None, 0.9][i % 4], None, None, None) for i in range(200)]
    queries = [(f"q{i}", None, None, None, ["p"], None, None, None, None, least, 7) for i, least in enumerate((None, -1.0, 0.0, 0.5, 2.0))]
    got = qt.search_table(spark.createDataFrame(records, RECORD), spark.createDataFrame(queries, QUERY)).groupBy("query_id").agg(
        F.sort_array(F.collect_list("observation_id"))).collect()
    want = {"q0": range(7), "q1": range(7), "q2": range(7), "q3": [1, 3, 5, 7, 9, 11, 13], "q4": range(1, 28, 4)}
    assert {k: v for k, v in got} == {k: sorted(f"o{i}" for i in v) for k, v in want.items()}


def test_an_empty_prefix_wants_a_plate(spark, slices):
    records = [(f"o{i}", "c", i, "p", 1.0, None, "A" if i >= 300 else None, None) for i in range(310)]
    compared(spark, records, [("q", None, None, None, None, None, None, "", None, None, 5)])


def test_records_are_not_copied_for_every_shape(spark, sf, monkeypatch):
    monkeypatch.setattr(qt, "JOINED", -1)
    plan = search_query_table(spark, sf)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "_z" not in plan and plan.count("CoGroup") == 1
