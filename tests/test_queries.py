"""Every registered query of the table operators: the rows of its SQL, or rows at all."""

import os

import duckdb
import pandas as pd
import pytest

from sparkloom.jobs import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if pd.isna(v):
        return None
    return round(float(v), 5) if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else str(v)


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1).astype(object)
    return list(frame.columns), sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, con, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_can_be_written(spark, name, tmp_path):
    """Their operators meet brute force in test_models; here the whole result is written and read."""
    catalog.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
