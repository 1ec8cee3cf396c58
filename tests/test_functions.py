import datetime
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeferry.functions.binary import from_hex, hex_text, json_key
from lakeferry.functions.casts import CastError, apply_casts, plan_cast
from lakeferry.functions.paths import PathPattern, PatternError, join_url, resolve_url, url_parts
from lakeferry.functions.types import ColumnSpec, SchemaError, from_field, from_footer, from_schema, from_warehouse
from lakeferry.operators.schema import SchemaChange, layered

S = ColumnSpec
U = "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"


def cast_one(spark, values, spark_type, target, source=None):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("c", spark_type)]))
    out, specs = apply_casts(df, [target], source=[source] if source else None)
    return [r[0] for r in out.collect()], out.schema[0].dataType, specs


@pytest.mark.parametrize("values,held,target,source,want,kind", [
    ([U, None], T.StringType(), S("c", "uuid"), None, [uuid.UUID(U).bytes, None], T.BinaryType()),
    ([uuid.UUID(U).bytes], T.BinaryType(), S("c", "text"), S("c", "uuid"), [U], T.StringType()),
    ([100], T.LongType(), S("c", "double"), S("c", "numeric", precision=18, scale=2), [1.0], T.DoubleType()),
    (["1"], T.StringType(), S("c", "integer"), None, [1], T.IntegerType()),
    ([100], T.IntegerType(), S("c", "numeric", precision=9, scale=2), S("c", "numeric", precision=9, scale=2), [Decimal("1.00")], T.DecimalType(9, 2)),
    ([100], T.LongType(), S("c", "text"), S("c", "numeric", precision=18, scale=2), ["1.00"], T.StringType()),
    ([Decimal("12345.00000")], T.DecimalType(38, 5), S("c", "numeric", precision=38, scale=2), None, [Decimal("12345.00")], T.DecimalType(38, 2)),
    ([7], T.ByteType(), S("c", "numeric", precision=4, scale=0), S("c", "numeric", precision=2, scale=0), [7], T.ShortType()),
    ([5], T.IntegerType(), S("c", "bigint"), None, [5], T.LongType()),
    ([Decimal("0.125"), Decimal("-0.125")], T.DecimalType(10, 3), S("c", "numeric", precision=10, scale=2), None, [Decimal("0.13"), Decimal("-0.13")], T.DecimalType(10, 2)),
    ([datetime.datetime(2024, 6, 1, 12, 34, 56, 789123)], T.TimestampNTZType(), S("c", "timestamp", time_unit="Millis"), None, [datetime.datetime(2024, 6, 1, 12, 34, 56, 789000)], T.TimestampNTZType()),
    ([datetime.datetime(2024, 6, 1, 12)], T.TimestampNTZType(), S("c", "date"), None, [datetime.date(2024, 6, 1)], T.DateType()),
])
def test_casts(spark, values, held, target, source, want, kind):
    assert cast_one(spark, values, held, target, source)[:2] == (want, kind)


@pytest.mark.parametrize("value,held,target", [("zz", T.StringType(), S("c", "uuid")), ("x", T.StringType(), S("c", "integer")), (70000, T.IntegerType(), S("c", "smallint")), (Decimal("1000.0"), T.DecimalType(5, 1), S("c", "numeric", precision=3, scale=1))])
def test_bad_values_fail(spark, value, held, target):
    with pytest.raises(Exception, match="(?i)uuid|cast|overflow|invalid|represent"):
        cast_one(spark, [value], held, target)


@pytest.mark.parametrize("source,target,held", [(S("c", "numeric", precision=9, scale=2), S("c", "bigint"), T.DecimalType(9, 2)), (S("c", "bigint"), S("c", "uuid"), T.LongType()), (S("c", "boolean"), S("c", "date"), T.BooleanType()), (S("c", "bytea"), S("c", "double"), T.BinaryType())])
def test_pairs_without_a_cast(source, target, held):
    with pytest.raises(CastError):
        plan_cast(source, target, held)


def test_names_come_from_specs_only_with_a_cast(spark):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    assert apply_casts(df, [S("ID", "integer")])[0].columns == ["id", "t"]
    assert apply_casts(df, [S("ID", "bigint"), S("nope", "text")])[0].columns == ["ID", "t"]


def test_specs():
    assert S.parse({"type": "INT8", "name": "a"}).kind == "bigint" and S.parse({"type": "numeric", "name": "a", "precision": 9, "scale": 0}).spark_type() == T.IntegerType()
    for bad in ({"type": "text", "name": "a", "length": 3}, {"type": "varchar", "name": "a"}, {"type": "Text", "name": "a"}, {"name": "a"}, {"type": "timestamp", "name": "a", "time_unit": "Hours"}):
        with pytest.raises(SchemaError):
            S.parse(bad)
    assert [S("a", "numeric", precision=p, scale=0).delta_type() for p in (2, 4, 9, 12)] == ["byte", "short", "integer", "decimal(12,0)"]
    assert from_field(S("a", "uuid").field()) == S("a", "uuid")
    with pytest.raises(SchemaError):
        from_field(T.StructField("e", T.ArrayType(T.FloatType())))
    field = lambda **m: T.StructField("c", T.StringType(), True, m)
    assert from_warehouse(field(logicalType="FIXED", precision=10, scale=2)) == S("c", "numeric", precision=10, scale=2)
    assert from_warehouse(field(logicalType="TEXT", charLength=16777216)).kind == "text" and from_warehouse(field(logicalType="TEXT", charLength=9)).length == 9
    assert from_warehouse(field()) is None


def test_layers_and_changes():
    base = [S("A", "bigint"), S("b", "text")]
    assert layered(base, [[S("a", "integer"), S("a", "uuid")], [S("B", "jsonb"), S("x", "date")]]) == [S("a", "integer"), S("B", "jsonb")]
    change = SchemaChange.between([S("a", "text"), S("b", "integer"), S("c", "date")], [S("A", "text"), S("b", "bigint"), S("d", "uuid")])
    assert change.changes == ["modified", "modified", "removed"] and [c.name for c in change.additions] == ["A", "b", "d"]
    assert change.ddl() == "A text, b bigint, d uuid"


def test_footer(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pa.table({"u": pa.array([b"x" * 16], pa.uuid()), "s": ["a"], "d": pa.array([Decimal("1.50")], pa.decimal128(10, 2)), "t": pa.array([0], pa.timestamp("ms")), "z": pa.array([0], pa.timestamp("us", "UTC")), "i": pa.array([1], pa.int32()), "n": [[1]]})
    pq.write_table(t, tmp_path / "f.parquet")
    got = from_footer(str(tmp_path / "f.parquet"))
    assert [(c.kind if c else None) for c in got] == ["uuid", "text", "numeric", "timestamp", "timestamptz", "integer", None] and got[3].time_unit == "Millis"


@pytest.mark.parametrize("pattern,path,want", [
    ("{db}/{schema}/{table}.parquet", "/a/b/c.parquet", {"db": "a", "schema": "b", "table": "c"}),
    ("{a}/*", "x/y/z", {"a": "x"}), ("{_}/{b}", "x/y/extra", {"b": "y"}), ("v-{n}-{m}.csv", "v-1-2.csv", {"n": "1", "m": "2"}), ("{a}_{b}", "x_y_z", {"a": "x", "b": "y_z"}), ("{a}", "x.y", {"a": "x.y"}),
])
def test_patterns(spark, pattern, path, want):
    p = PathPattern(pattern)
    assert p.parse(path) == want
    row = spark.createDataFrame([(path,), ("",)], "p string").select(p.extract(F.col("p")).alias("x")).collect()
    assert row[0].x.asDict() == want and set(row[1].x.asDict().values()) == {None}


@pytest.mark.parametrize("pattern", ["{a}{b}", "{a", "a//b", ""])
def test_bad_patterns(pattern):
    with pytest.raises(PatternError):
        PathPattern(pattern).regex  # noqa: B018


def test_paths_that_do_not_fit():
    for pattern, path in (("a/{b}", "x/y"), ("{a}/{b}", "x"), ("v-{n}.csv", "v-1.txt")):
        with pytest.raises(PatternError):
            PathPattern(pattern).parse(path)


def test_urls(spark, tmp_path):
    assert resolve_url("s3://b/k") == "s3://b/k" and resolve_url("/a/b") == "file:///a/b" and resolve_url("x", "s3://b/") == "s3://b/x"
    assert join_url("az://c/", "/a//b") == "az://c/a/b" and resolve_url("rel").startswith("file:///")
    got = spark.createDataFrame([("https://h.example.com:8/a/b/f.tar.gz?x=1#y",)], "u string").select(url_parts(F.col("u")).alias("p")).first().p
    assert (got.scheme, got.host, got.path, got.filename, got.stem, got.extension, got.base_name, got.full_extension) == ("https", "h.example.com:8", "/a/b/f.tar.gz", "f.tar.gz", "f.tar", ".gz", "f", "tar.gz")


def test_binary(spark):
    df = spark.createDataFrame([(bytearray(b"\xde\xad"), "dead", '{"k": 5}')], "b binary, h string, j string")
    r = df.select(hex_text(df.b).alias("h"), from_hex(df.h).alias("b"), json_key(df.j, "k").alias("k")).first()
    assert (r.h, bytes(r.b), r.k) == ("dead", b"\xde\xad", "5")
    with pytest.raises(Exception, match="hexadecimal"):
        df.select(from_hex(F.lit("xyz"))).collect()


def test_nested_columns_are_refused(spark):
    with pytest.raises(SchemaError, match="embedding"):
        from_schema(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").schema)
