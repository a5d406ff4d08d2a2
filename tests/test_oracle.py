"""Queries against their SQL in DuckDB on the smallest test data, where it is present."""

from __future__ import annotations

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["flagship", "lines", "headings", "check_em_dash_semicolon", "check_banned_phrases", "check_sentence_concision", "check_heading_length", "check_acronym_first_use", "candidates_routing_only"]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import duckdb

    from lectern.plans.catalog import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    theirs = con.sql(ORACLE_SQL[name])
    columns = sorted(theirs.columns)
    ours = QUERIES[name](spark, SF)
    assert sorted(ours.columns) == columns
    order = [theirs.columns.index(c) for c in columns]
    expected = sorted(str(tuple(r[i] for i in order)) for r in theirs.fetchall())
    assert expected and sorted(str(tuple(r)) for r in ours.select(*columns).collect()) == expected
