"""Every registered query of the loading operators against DuckDB."""

import datetime
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from lakeferry import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    own = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in own.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(map(plain, r)) for r in own.fetchall()), key=repr)
    got = sorted((tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_are_what_they_should_be(spark, tmp_path):
    """A probe reads keys alone, its ranges reach the scan, and no Python runs in casts."""
    from lakeferry.deltalog.table import Table

    text = lambda df: df._jdf.queryExecution().toString()
    own, table = queries.t(spark, DATA, "orders"), Table(spark, str(tmp_path / "t"))
    table.overwrite(own)
    staged = table.stage_merge(own.where("o_orderkey between 100 and 200"), ["o_orderkey"])
    plan = text(table.probe(table.log.snapshot(), staged.adds, staged.keys))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,100), LessThanOrEqual(o_orderkey,200)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,_tmp_metadata_row_index:bigint>" in plan
    for name in ("cast_uuid_roundtrip", "cast_int_to_decimal", "path_pattern_extract", "file_stats_orders"):
        assert "Python" not in text(queries.QUERIES[name](spark, DATA))
