"""Class counts and their SQL measure overlap alike, also where it lies at the threshold."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["class_metrics", "class_summary"])
def test_a_pair_at_the_threshold(spark, tmp_path, name):
    # Scaled to the larger extents this overlap is 0.15, by plain areas it is 0.14999999999999994.
    con = duckdb.connect()
    con.sql(f"""copy (select 880428::bigint as l_orderkey, partkey::bigint as l_partkey, suppkey::bigint as l_suppkey, line::int as l_linenumber,
        quantity::double as l_quantity, 'N' as l_returnflag from (values (140833, 561, 4, 15), (28204, 8503, 7, 38))
        v(partkey, suppkey, line, quantity)) to '{tmp_path}/lineitem.parquet' (format parquet)""")
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted(want, key=repr) and any(r.true_positives == 1 for r in df.collect())
