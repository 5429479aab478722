"""Broad queries meet only the stretch of time in which their first rows lie."""

from pyspark.sql import functions as F

from duskline.operators import query_table as qt
from test_query_table import QUERY, RECORD


def test_broad_queries_meet_few_records(spark):
    rows = spark.range(20_000).selectExpr(
        "concat('o', id) observation_id", "concat('c', id % 3) source_id", "id * 10 timestamp_ms", "'p' category",
        "if(id % 50 = 0, null, (id % 101) / 100d) confidence", "cast(null as string) track_id", "cast(null as string) plate_text",
        "cast(null as array<struct<name:string,value:string>>) attributes")
    assert [f.name for f in rows.schema] == [f.split(" ")[0] for f in RECORD.split(", ")]
    asked = [("all", None, None, None, None, None, None, None, None, None, 5),
             ("late", 150_005, None, ["c1", "c2"], ["p"], None, None, None, None, 0.9, 4),
             ("none", 150_001, 150_002, None, ["p"], None, None, None, None, None, 4),
             ("until", None, 199_990, None, None, None, None, None, None, 2.0, 4)]
    queries = qt.together(spark.createDataFrame(asked, QUERY))
    shapes = [r["_shape"] for r in queries.select("_shape").distinct().collect()]
    placed, stretch = qt.stretches(qt.postings(rows, shapes), queries)
    met = {r[0]: r[1] for r in placed.join(stretch, ["_key", "_block"]).groupBy("query_id").agg(F.count(F.lit(1))).collect()}
    assert met["all"] <= 100 and met["late"] <= 800, met
    got = qt.search_table(rows, spark.createDataFrame(asked, QUERY)).orderBy("query_id", "rank").collect()
    late = [i for i in range(15_001, 20_000) if i % 3 and i % 50 and i % 101 >= 90][:4]
    assert [(r.query_id, r.observation_id) for r in got] == [("all", f"o{i}") for i in range(5)] + [("late", f"o{i}") for i in late]
