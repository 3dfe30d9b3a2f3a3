"""A subset of the DuckDB oracle comparisons, on sf0.001 (the full set runs in scripts/check_oracle.py)."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from scripts.check_oracle import TABLES, rows_of

NAMES = ["merchant_failure_rate", "rev_monthly_cumulative", "spend_deciles", "velocity_bursts", "latency_sla",
         "tag_rollup", "guarded_refunds", "stage_transactions", "feature_drift", "documents_with_cards"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL).toPandas()
    ddf = con.execute(E.oracle_sql()[name]).df()
    sc, sr = rows_of(sdf)
    dc, dr = rows_of(ddf)
    assert sc == dc
    assert sr == dr
