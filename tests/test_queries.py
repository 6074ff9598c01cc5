"""Every query of the measurement and image workflows against its SQL on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from lumispark.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def test_each_query_but_the_iterative_ones_has_sql():
    assert set(queries()) - set(oracle_sql()) == {"q36_linking", "q76_smoothed_outlines"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    got = queries()[name](spark, SF)
    result = oracle.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(columns)
    order = [columns.index(c) for c in got.columns]
    assert sorted(tuple(map(plain, r)) for r in got.collect()) == sorted(tuple(plain(r[k]) for k in order) for r in result.fetchall())


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert set(queries()) <= set(__spark_entry__.queries()) and __spark_entry__.entry(spark).count() == 30
