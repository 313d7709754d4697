"""Every registered query that has an oracle gives the oracle's rows."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from termloom import catalog


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_oracle(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
