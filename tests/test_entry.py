"""Every registered query of the library against its SQL on the small tables."""

from pathlib import Path

import duckdb
import pytest

from delimlake.plans import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")


def told(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = queries.queries()[name](spark, f"file://{DIR}")
    cols = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(told(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(told(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
