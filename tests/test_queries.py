"""Every registered query against its DuckDB oracle on the smallest driver table, and partition invariance."""
import os

import duckdb
import pytest

from oracle_check import digest  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = ["pages", "documents", "labels", "benchmark", "events"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _names():
    from __spark_entry__ import oracle_sql
    return sorted(oracle_sql())


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    df = queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(rel.columns, orows)


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0 and df.columns[0] == "page_id"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", ["field_h1_title", "link_edges", "candidate_cards"])
def test_partition_invariance(spark, name):
    from __spark_entry__ import queries
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(map(tuple, queries()[name](spark, SF).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = sorted(map(tuple, queries()[name](spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == eight
