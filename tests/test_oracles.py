"""Every query with an oracle gives the same rows in DuckDB."""

import datetime
import decimal
import functools
import math
from pathlib import Path

import duckdb
import pytest

from moundworks.operators import boosting
from moundworks.plans import catalog

SEARCH = boosting.search
SF = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    return x.isoformat() if isinstance(x, datetime.date) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, db, name):
    df = catalog.QUERIES[name](spark, str(SF))
    want = db.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, df.collect()), rows(columns, want.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name, monkeypatch):
    # minutes of trees as registered; here fewer of them (test_boosting.py has them against plain loops)
    monkeypatch.setattr(boosting, "fit", functools.partial(boosting.fit, trees=2))
    monkeypatch.setattr(boosting, "search", lambda *a, trees, **k: SEARCH(*a, trees=(1, 2), depths=(1, 2), **k))
    assert catalog.QUERIES[name](spark, str(SF)).count() > 0
