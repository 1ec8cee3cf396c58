import datetime
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeferry.deltalog.table import Table
from lakeferry.operators import stats, strategies
from lakeferry.operators.strategies import MergeError

KEY = st.none() | st.integers(0, 4)
ROWS = st.lists(st.tuples(KEY, KEY, st.integers(0, 99)), max_size=8)
SCHEMA = "a int, b int, v int"


def frames(spark, *rows):
    return [spark.createDataFrame(r, SCHEMA) for r in rows]


def bag(df):
    return Counter(map(tuple, df.collect()))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS, ROWS)
def test_merge_equation(spark, tmp_path_factory, target, source):
    t, s = (x.coalesce(1) for x in frames(spark, target, source))
    for keys, width in ((["a"], 1), (["a", "b"], 2)):
        have = {r[:width] for r in source}
        table = Table(spark, str(tmp_path_factory.mktemp("t") / "t"))
        table.overwrite(t)
        got = table.merge(s, keys, allow_null_keys=True)
        assert bag(table.read()) == Counter(r for r in target if r[:width] not in have) + Counter(source)
        hit = sum(r[:width] in have for r in target)
        assert (got.source_rows, got.matched_rows, got.inserted_rows) == ((len(source), hit, max(0, len(source) - hit)) if source else (0, 0, 0))
        full = {k for k in have if None not in k}
        assert bag(strategies.matched_rows(t, s, keys)) == Counter(r for r in target if r[:width] in full)


def test_refusals(spark):
    t, s = frames(spark, [(1, 1, 1)], [(1, 1, 2), (1, 1, 3)])
    with pytest.raises(MergeError, match="unknown key"):
        strategies.matched_rows(t, s, ["nope"])
    with pytest.raises(MergeError, match="2 source rows have a null in key 'b'"):
        strategies.refuse_nulls(["a", "b"], [0, 2])
    strategies.refuse_nulls(["a"], [None])


def test_statistics(spark):
    df = spark.createDataFrame([(1, "b", None, datetime.datetime(2024, 10, 8, 17, 22)), (3, "a", 2.5, datetime.datetime(2024, 10, 8, 17, 22))], "i int, s string, d double, t timestamp_ntz")
    r = stats.file_stats(df).first()
    assert (r.num_records, r.null_count_d, r.min_i, r.max_i, r.min_s, r.min_d, r.max_d) == (2, 1, 1, 3, "a", 2.5, 2.5)
    assert stats.watermark(df, "t").first()[0] == 1728408120000000 and stats.watermark(df, "i").first()[0] == 3
    assert stats.stat_text(r.min_t, df.schema["t"].dataType) == "2024-10-08T17:22:00.000"
    with pytest.raises(ValueError):
        stats.watermark(df, "s")
    assert stats.watermark(df.select(F.col("t").cast("date").alias("t")), "t").first()[0] == 20004
    assert stats.is_stale(5, 5) and not stats.is_stale(6, 5) and not stats.is_stale(1, None)
