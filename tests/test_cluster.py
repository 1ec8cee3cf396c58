"""What works on executors that are processes of their own."""

import subprocess
import sys
from pathlib import Path

ROWS = """
import datetime, sys
from decimal import Decimal
from pyspark.sql import SparkSession
from lakeferry.functions.types import from_schema
from lakeferry.sinks.jdbc import JdbcSink
from lakeferry.sources import readers

folder = sys.argv[1]
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{folder}/shared").getOrCreate()
moment = datetime.datetime(2024, 10, 8, 17, 22, 0, 123456)
odd = [(1, "", 1.5, Decimal("0.10"), moment, True), (2, None, None, None, None, None), (3, 'a "b", c', -1e-300, Decimal("-9.99"), moment, False), (4, "two\\nlines ", 1e300, Decimal("0.00"), moment, True), (5, " \\u00e9\\u4e2d", 0.0, None, moment, None), (6, "NULL", 0.0, None, None, None)]
schema = "k bigint, v string, d double, n decimal(9,2), t timestamp, b boolean"
url = f"jdbc:derby:{folder}/db;create=true"


def same(got, want):
    assert got == want, f"{got} is not {want}"


def load(rows, kind, schema=schema, **more):
    df = spark.createDataFrame(rows, schema).repartition(2)
    sink = JdbcSink(spark, url, "S.T", kind, **more)
    sink.prepare(df, from_schema(df.schema))
    assert sink.source_rows == len(rows)
    sink.publish()
    return sorted(map(tuple, readers.jdbc(spark, url, "S.T").df.collect()))


same(load(odd, "drop_replace"), odd)
same(load(odd[:4], "truncate_insert"), odd[:4])
same(load(odd[4:], "delete_insert", delete_values={"k": 1}), odd[1:])
merged = load([(2, "new"), (9, "more")], "merge", "k bigint, v string", keys=["k"])
same(merged, [(2, "new", None, None, None, None), *odd[2:], (9, "more", None, None, None, None)])
same(load([], "truncate_insert"), [])
spark.stop()
print("all is well")
"""


def test_embedded_database_beside_executors(tmp_path):
    (tmp_path / "own.py").write_text(ROWS)
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, str(tmp_path / "own.py"), str(tmp_path)], cwd=tmp_path, env={**__import__("os").environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert "all is well" in done.stdout, [x for x in done.stderr.splitlines() if "Error" in x][:20]
