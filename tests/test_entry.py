"""The driver's contract, and the results of the core queries against SQL."""

import datetime as dt
import math
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from leafmill.plans import registry

ROOT = Path(__file__).resolve().parents[1]


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x.replace(tzinfo=None) if isinstance(x, dt.datetime) else x


@pytest.mark.parametrize("name", sorted(registry.core_sql()))
def test_same_as_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    r = c.execute(registry.core_sql()[name])
    at = {d[0]: k for k, d in enumerate(r.description)}
    assert sorted(at) == columns
    assert sorted(repr(tuple(plain(x[at[c]]) for c in columns)) for x in r.fetchall()) == got


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_and_columns(spark):
    assert set(registry.core_sql()) <= set(registry.core_queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_optional_part():
    for p in (ROOT / "leafmill").rglob("*.py"):
        if "llm" not in p.parts:
            assert "leafmill.llm" not in p.read_text() and "from leafmill import llm" not in p.read_text(), p
    code = "import sys; sys.modules['leafmill.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('p1') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 30 and out[1] == "False"
