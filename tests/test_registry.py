"""The registered queries: complete, consistent, and equal to their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# One query per family keeps the suite quick; tools/check_oracle.py compares all of them.
SAMPLE = ["a3_flag_calibration", "a15_exact_quantiles", "j16_prompts_by_hash", "g2_edge_counts", "r2_weighted_terms", "j9_prediction_verdicts", "a16_retrieval_metrics", "w6_verify_ledger", "s11_read_added_lines"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 150


def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 7


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    from tools.check_oracle import rows_of

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())
