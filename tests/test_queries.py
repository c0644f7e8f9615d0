"""Every query with SQL gives the SQL's rows on the smallest tables."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpusmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, numbers.Real) and not isinstance(v, bool | np.bool_):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted(tuple(plain(v) for v in row) for row in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_sql(spark, sql, name):
    got = canonical(registry.queries()[name](spark, SF).toPandas())
    assert got == canonical(sql.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_run(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 1


@pytest.mark.parametrize("name", ["leaderboard", "running_best", "status_runs", "nearest_tracks"])
def test_rows_do_not_depend_on_partitions(spark, name):
    rows = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(canonical(registry.queries()[name](spark, SF).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]
