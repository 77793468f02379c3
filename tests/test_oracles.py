"""Every query with SQL gives the rows that DuckDB gives on the same files."""

import datetime
from pathlib import Path

import duckdb
import pytest

from rowloom import plans

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.select(*cols).collect()), key=repr)
    if name not in plans.oracle_sql():
        assert rows
        return
    sql = plans.oracle_sql()[name]
    assert cols == sorted(duck.sql(sql).columns)
    want = sorted((tuple(plain(v) for v in r) for r in duck.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()), key=repr)
    assert rows == want
