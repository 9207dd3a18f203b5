"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols, got = rows_of(df.columns, df.collect())
    cur = db.execute(entry.oracle_sql()[name])
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert cols == want_cols
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_fragments_have_covariates(spark):
    got = entry.queries()["p_09_fragment_covariates"](spark, SF).collect()
    assert any(r["covariate"] is not None for r in got)
