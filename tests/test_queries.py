"""Queries beside their SQL, as the driver compares them; the slow screens run in tools/verify.py."""

import glob
import os

import duckdb
import pytest

from plumbline import queries as engine
from plumbline import queries_tables
from tools.verify import same

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in queries_tables.SQL] + ["screen_ship_years", "half_splits", "matrix_distances", "kernel_discrepancy"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, db, name):
    assert not same(engine.queries()[name](spark, DATA).toPandas(), db.execute(engine.oracle_sql()[name]).df())
    spark.catalog.clearCache()


def test_entry_module_has_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "screen_ship_years" in e.queries()
