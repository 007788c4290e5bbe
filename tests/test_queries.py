"""Every query against its oracle at the smallest scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillfold import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, ([None if pd.isna(x) else (int(x) if isinstance(x, bool) or float(x).is_integer() else round(float(x), 9)) if not isinstance(x, str) else x for x in r] for r in df[cols].astype(object).values.tolist())))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_oracle(spark, duck, name):
    got, want = rows(catalog.queries()[name](spark, SF).toPandas()), rows(duck.sql(catalog.oracle_sql()[name]).df())
    assert got == want


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) and set(catalog.queries()) <= set(entry.queries())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for p in glob.glob(f"{SF}/*.parquet"):
        spark.read.parquet(p).limit(0).write.parquet(f"{path}/{os.path.basename(p)}")
    return path


#: Queries with one row a meter, a root or a total on empty tables too.
TOTALS = {"dedup_savings", "metrics_actions", "reachable", "image_merged_count", "metrics_meters", "metrics_exposition", "pdf_meters"}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_queries_on_empty_tables(spark, empty, name):
    n = catalog.queries()[name](spark, empty).count()
    assert n > 0 if name in TOTALS else n == 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_admission_takes_no_slot_for_the_rejected(spark):
    from quillfold.operators.jobs import admit

    jobs = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 1, 100), ("a", 3, 2, 5), ("a", 4, 10, 20), ("b", 5, 0, 1)], "lane string, job_id long, start long, finish long")
    assert {r.job_id: r.admitted for r in admit(jobs, 2).collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}
