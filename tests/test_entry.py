"""Every query of the core runs over the smallest tables, and every SQL belongs to a query."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["normalize_number", "field_score", "auroc", "trigram_top5", "rate_asof", "stream_last_state", "vector_top5", "match_findings", "gate_verdict", "routing_ladder", "row_score", "monthly_export", "retried_calls", "corrections_fold", "transitions", "error_classes"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    ours, theirs = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda df: sorted(str(tuple(None if pd.isna(x) else float(x) if isinstance(x, (int, float)) else str(x) for x in r)) for r in df[columns].itertuples(index=False))
    assert rows(ours) == rows(theirs)
