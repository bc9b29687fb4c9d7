"""The queries of the subpackage against their SQL."""

from pathlib import Path

import pytest

from leafmill.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_same_as_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    r = c.execute(sql.SQL[name])
    at = {d[0]: k for k, d in enumerate(r.description)}
    assert sorted(at) == columns
    assert sorted(repr(tuple(x[at[c]] for c in columns)) for x in r.fetchall()) == got
