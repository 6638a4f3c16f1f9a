"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from auditloom.plans import rawlog, reports  # noqa: F401  (register their queries)
from auditloom.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def plain(frame, columns):
    value = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    frame = frame[columns].astype(object).where(frame[columns].notna(), None).map(value).astype(str)
    return frame.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns).equals(plain(want, columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
