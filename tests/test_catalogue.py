"""Each query of the catalogue against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from textforge.plans import jobs, rendered, reporting, stores  # noqa: F401  they add their queries
from textforge.plans.catalogue import ORACLE_SQL, QUERIES

#: Of the queries over jobs, those that together use every rule.
WHOLE = ("q_market_funnel", "q_market_filtered", "q_recheck_reasons", "q_market_queue", "q_queue_gates", "q_reason_text", "q_location_focus", "q_preview_only", "q_small_casts", "q_market_document_hits", "q_blocked_text")
NAMES = [n for n in QUERIES if QUERIES[n].__module__ != jobs.__name__ or n in WHOLE]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df, columns):
    value = lambda v: "-" if v is None or v != v else str(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(value, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(n for n in NAMES if n in ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(NAMES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
