"""Every query of the library proper against DuckDB over the smallest tables."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from vouch import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None or isinstance(x, (str, bool)):
        return x
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (float, decimal.Decimal)):
        return None if x != x else round(float(x), 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, datetime.date):
        return datetime.datetime(x.year, x.month, x.day)
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_like_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    told = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in told.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows(frame.columns, frame.collect()) == rows(columns, told.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry_alone():
    """The entry module names the library's queries whether or not the llm part is there."""
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_partitions_do_not_matter(spark):
    name = "j1_screen_sanctions"
    first = sorted(map(tuple, queries.QUERIES[name](spark, SF).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        assert sorted(map(tuple, queries.QUERIES[name](spark, SF).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
