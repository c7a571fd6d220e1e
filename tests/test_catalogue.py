"""Every catalogue query against its DuckDB statement: names, row counts and values."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from weftline.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v.replace(tzinfo=None)) if hasattr(v, "replace") and hasattr(v, "tzinfo") else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    out = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(df.columns) == sorted(names)
    theirs = Counter(tuple(map(plain, r)) for r in out.fetchall())
    ours = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert ours == theirs
