"""Every registered query against its DuckDB oracle on the smallest data set."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import TABLES, rows_of, type_diffs  # noqa: E402

from __spark_entry__ import entry  # noqa: E402
from seatledger import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:4] == ["id", "name", "icon", "color"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    rel = duck.sql(catalog.ORACLE[name])
    o_cols, o_rows = rel.columns, rel.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert type_diffs(df, rel) == []
    assert len(s_rows) == len(o_rows)
    assert rows_of(s_cols, s_rows) == rows_of(o_cols, o_rows)


def test_summary_after_reset_matches_oracle(spark, duck):
    """C9 then R8: the summary of reset tables (zeros, platforms kept)."""
    from seatledger import oracle_sql as O
    from seatledger.catalog import AS_OF
    from seatledger.operators import changes as C
    from seatledger.operators import reports as R
    from seatledger.sources.bindings import bind_tables

    df = R.summary(C.reset_data(bind_tables(spark, SF, AS_OF)), AS_OF)
    rel = duck.sql(O.with_bindings(O.RESET_SUMMARY))
    assert type_diffs(df, rel) == []
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
