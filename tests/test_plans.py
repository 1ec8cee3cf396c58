import datetime
import io
import json
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakeferry import cli
from lakeferry.deltalog.log import TableLog
from lakeferry.deltalog.table import Table
from lakeferry.functions.types import from_schema
from lakeferry.plans import config as C
from lakeferry.plans.config import ConfigError
from lakeferry.plans.environment import Environment
from lakeferry.plans.outcome import TaskError, as_rows
from lakeferry.plans.runner import captured, run, split_role
from lakeferry.plans.templates import TemplateError, context, render, shouty
from lakeferry.sinks.parquet import FileNameError
from lakeferry.sources import readers
from lakeferry.sources.readers import SourceError

DATA = "/root/testdata/sf0.001"


def test_templates():
    ctx = context("public.users", {"PUBLIC_USERS_X": "own", "X": "all", "Y": "y"}, index=3)
    assert render("{{x}}-{{ y }}-{{ pad index 5 }}-{{ table_of name }}-{{ schema_of name }}-{{ shoutySnakeCase name }}", ctx) == "own-y-00003-users-public-PUBLIC_USERS"
    assert render("{{ ensure_trailing 'a' }}b", ctx) == "a/b" and len(ctx["YYYY"]) == 4 and abs(int(render("{{ now_timestamp_ms }}", ctx)) // 1000 - int(render("{{ now_timestamp }}", ctx))) <= 1
    assert [shouty(x) for x in ("public.users", "fooBar", "HTTPServer2x", "a-b c")] == ["PUBLIC_USERS", "FOO_BAR", "HTTP_SERVER2X", "A_B_C"]
    for bad in ("{{ nope }}", "{{ pad index }}", "{{ }}", "{{ x y }}"):
        with pytest.raises(TemplateError, match="helpers"):
            render(bad, ctx)


def test_environment():
    env = Environment({"FERRY_SRC": "file:///a", "FERRY_SRC_public.users": "file:///b", "FERRY_DEST_PUBLIC_USERS": "file:///c", "FERRY_DEST_DELTA": "delta+file:///d", "FERRY_PARAM_P2_INT": "5", "FERRY_PARAM_P1": "x", "FERRY_PARAM_PUBLIC_USERS_DAY_DATE": "2024-01-02", "OTHER": "1"})
    assert env.location("SRC", "public.users", "file") == "file:///b" and env.location("SRC", "x", "file") == "file:///a"
    assert env.location("DEST", "public.users", "pq") == "file:///c" and env.location("DEST", "x", "delta") == "delta+file:///d"
    with pytest.raises(KeyError, match="FERRY_DEST_X.Y, FERRY_DEST_X_Y, FERRY_DEST_PQ, FERRY_DEST".replace("FERRY_DEST_X.Y", "FERRY_DEST_x.y")):
        env.location("DEST", "x.y", "pq")
    assert [(p.name, p.typed()) for p in env.parameters_for("other")] == [("P1", "x"), ("P2", 5)]
    assert [p.typed() for p in env.parameters_for("public.users")] == [datetime.date(2024, 1, 2)]
    assert [p.value for p in env.parameters_named(["p2", "P1"])] == ["5", "x"] and env.key_value("public.users", "day").kind == "date"
    with pytest.raises(KeyError):
        env.parameters_named(["nope"])
    kinds = {"snowflake://x": "sf", "delta+s3://b": "delta", "postgres://h/d": "pg", "s3://b/k": "file", "ftp://x": None}
    assert {u: Environment({"FERRY_SRC": u}).kind_of("SRC") for u in kinds} == kinds


FLAT = """
src: file
dest: pq
dest_defaults: {filename: "{{ name }}.parquet", pq.max_rows: 7}
tables:
  - {name: nation, filname: x}
  - {name: region, filename: r.parquet, dest: delta.merge, merge_keys: [r_regionkey]}
"""
NESTED = """
version: 2
destinations: [{dest: arrow}]
tables:
  - name: orders
    src: duckdb
    sql: select 1
    columns: [{type: text, name: a}]
    destinations:
      - {dest: pg, target: s.t, merge_keys: [k], columns: [{type: date, name: b}]}
      - {dest: delta.overwrite, max_row: 3}
  - {name: t, src: sf}
"""


def test_flat_and_nested():
    a, b = C.parse(FLAT)
    assert a.destinations[0].get("filename") == "{{ name }}.parquet" and a.destinations[0].get("max_rows") == 7
    assert [(u.key, u.suggestions) for u in a.unknown] == [("filname", ("filename",))] and "did you mean 'filename'" in str(a.unknown[0])
    assert b.source.get("filename") == "r.parquet" and b.destinations[0].kind == "delta.merge" and b.destinations[0].get("app_id")
    a, b = C.parse(NESTED)
    assert a.source.kind == "duckdb.query" and [d.kind for d in a.destinations] == ["pg.merge", "delta.overwrite"]
    assert [d.columns[0].name for d in a.destinations] == ["b", "a"] and a.unknown[0].suggestions == ("max_rows",)
    assert b.source.kind == "sf.table" and b.destinations[0].kind == "arrow"
    assert [t.name for t in C.selected([a, b], ["T"])] == ["t"]
    with pytest.raises(ConfigError, match="at most one"):
        C.validate([b, b])


@pytest.mark.parametrize("text,match", [
    ("version: 1\ntables: [{name: a, src: file, destinations: []}]", "version 1"), ("version: 2\ntables: [{name: a, src: file}]", "version 2"), ("version: 3\ntables: [{name: a, src: file}]", "unsupported"),
    ("tables: [{name: a}]", "src is not set"), ("tables: [{name: a, src: pg}]", "destination"), ("tables: [{name: a, src: file, dest: pg}]", "tag"),
    ("tables: [{name: a, src: file, dest: pg, merge_keys: [x], delete_keys: [x]}]", "both"), ("tables: [{name: a, src: file, dest: delta.merge, merge_keys: []}]", "empty"),
    ("tables: [{name: a, src: file, dest: delta.merge, merge_keys: [k], txn_mode: source_watermark}]", "watermark_column"), ("tables: [{name: a, src: file, dest: delta.overwrite, merge_keys: [k]}]", "no merge_keys"),
    ("tables: [{name: a, src: file, dest: pq}]", "filename"), ("tables: [{name: a, src: file, destinations: [{dest: arrow, name: b}]}]", "must not set name"), ("tables: 3", "list of tables"),
])
def test_bad_configurations(text, match):
    with pytest.raises(ConfigError, match=match):
        C.parse(text)


def env_for(tmp_path, **more):
    return {"FERRY_SRC": f"file://{DATA}", "FERRY_DEST": f"file://{tmp_path}/out", **more}


def test_ld(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(
        """
version: 2
tables:
  - name: orders
    src: file
    filename: orders.parquet
    destinations:
      - {dest: pq, filename: "{{ target }}/part-{{ pad index 3 }}.parquet", max_rows: 500, target: o}
      - {dest: delta.merge, merge_keys: [o_orderkey], target: d, txn_mode: source_watermark, watermark_column: o_orderdate, columns: [{type: text, name: O_CUSTKEY}]}
      - {dest: arrow}
"""
    )
    out = io.BytesIO()
    for turn in range(2):
        out = io.BytesIO()
        assert cli.main(["ld", "--config", str(tmp_path / "c.yaml"), "--report", str(tmp_path / "r.jsonl")], spark=spark, environment=env_for(tmp_path), out=out) == 0
        line = json.loads((tmp_path / "r.jsonl").read_text())
        n = line["rows"]
        pq_out, delta, arrow = line["destinations"]
        assert all(f["rows"] <= 500 for f in pq_out["files"]) and sum(f["rows"] for f in pq_out["files"]) == n and len(pq_out["files"]) >= n // 500
        assert delta["commit"]["skipped"] == bool(turn)
        assert pa.ipc.open_stream(out.getvalue()).read_all().num_rows == n
    assert sorted(p.name for p in (tmp_path / "out/o").glob("*.parquet"))[0] == "part-000.parquet"
    t = Table(spark, f"file://{tmp_path}/out/d").read()
    assert t.count() == n and dict(t.dtypes)["O_CUSTKEY"] == "string"
    assert cli.main(["delta", "vacuum", "--config", str(tmp_path / "c.yaml"), "--dry-run"], spark=spark, environment=env_for(tmp_path)) == 0
    assert cli.main(["delta", "vacuum-table", f"file://{tmp_path}/nope"], spark=spark, environment={}) == 1


def test_run_command_and_parameters(spark, tmp_path):
    spark.read.parquet(f"{DATA}/nation.parquet").createOrReplaceTempView("nation_view")
    env = env_for(tmp_path, FERRY_PARAM_LOW_INT="20")
    args = ["run", "--src", "sql", "--dest", "pq", "--name", "n", "--sql", "select * from nation_view where n_nationkey >= :low", "--opt", "filename={{ name }}-{{ YYYY }}.parquet"]
    assert cli.main(args, spark=spark, environment=env) == 0
    [f] = (tmp_path / "out").glob("n-*.parquet")
    assert pq.read_table(f).num_rows == 5
    assert cli.run_block("{a: 1, b: 2}", ["b=3", "c=[x]"], {"d": None, "a": 9}) == {"a": 9, "b": 3, "c": ["x"]}
    positional = C.TableConfig(C.parse_source({"name": "n", "src": "sf.query", "sql": "select * from nation_view where n_nationkey < ?", "param_keys": ["low"]}, None), [C.parse_destination({"name": "n", "dest": "pq", "filename": "p.parquet"}, None)])
    assert run(spark, [positional], Environment(env))[0].rows == 20


def test_one_file_or_an_index(spark, tmp_path):
    bad = C.parse("src: table\ndest: pq\ntables: [{name: nation_view, filename: x.parquet, max_rows: 3}]")
    spark.read.parquet(f"{DATA}/nation.parquet").createOrReplaceTempView("nation_view")
    with pytest.raises(FileNameError, match="index"):
        run(spark, bad, Environment(env_for(tmp_path)))


def test_empty_loads(spark, tmp_path):
    spark.read.parquet(f"{DATA}/nation.parquet").where("false").createOrReplaceTempView("none_view")
    text = "tables: [{name: none_view, src: table, destinations: [{dest: pq, filename: e.parquet}, {dest: delta.overwrite, target: eo}, {dest: delta.merge, target: em, merge_keys: [n_nationkey]}]}]"
    phase = run(spark, C.parse(text), Environment(env_for(tmp_path)))[0]
    assert phase.rows == 0 and pq.read_table(tmp_path / "out/e.parquet").num_rows == 0 and pq.read_table(tmp_path / "out/e.parquet").num_columns == 3
    assert phase.destinations[2].commit["source_rows"] == 0 and Table(spark, f"{tmp_path}/out/eo").read().count() == 0


def test_bad_rows_leave_nothing(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "text_value string").createOrReplaceTempView("bad_view")
    text = "tables: [{name: bad_view, src: table, columns: [{type: uuid, name: text_value}], destinations: [{dest: pq, filename: a.parquet}, {dest: pq, filename: b.parquet, columns: []}]}]"
    with pytest.raises(Exception, match="uuid"):
        run(spark, C.parse(text), Environment(env_for(tmp_path)))
    left = [p for p in (tmp_path / "out").rglob("*") if p.is_file()] if (tmp_path / "out").exists() else []
    assert left == []


def test_a_bad_row_of_one_destination_stops_all(spark, tmp_path):
    spark.createDataFrame([("1",), ("b",)], "v string").createOrReplaceTempView("half_bad")
    text = "tables: [{name: half_bad, src: table, destinations: [{dest: pq, filename: ok.parquet}, {dest: delta.overwrite, target: d, columns: [{type: integer, name: v}]}, {dest: delta.merge, target: m, merge_keys: [v]}]}]"
    with pytest.raises(Exception, match="(?i)cast"):
        run(spark, C.parse(text), Environment(env_for(tmp_path)))
    assert [p for p in (tmp_path / "out").rglob("*.parquet")] == [] and Table(spark, f"{tmp_path}/out/d").read().count() == 0


def test_failures_are_independent_and_reported(spark, tmp_path, monkeypatch):
    spark.range(5).createOrReplaceTempView("five")
    text = "tables: [{name: five, src: table, finalize: [{run: hook}], destinations: [{dest: pq, filename: ok.parquet}, {dest: delta.merge, target: d, merge_keys: [id]}]}]"
    monkeypatch.setattr(TableLog, "commit", lambda self, version, actions, old=TableLog.commit: old(self, version, actions) if version == 0 else (_ for _ in ()).throw(OSError("disk full")))
    report, seen = io.StringIO(), []

    def hook(phase):
        seen.append(phase)
        return ["select 1", "select broken from nowhere"]

    with pytest.raises(TaskError, match="1 load, 1 finalize"):
        run(spark, C.parse(text), Environment(env_for(tmp_path)), report=report, hooks={"hook": hook})
    line = json.loads(report.getvalue())
    assert [d["error"] is None for d in line["destinations"]] == [True, False] and (tmp_path / "out/ok.parquet").exists()
    assert seen[0].outputs_of("pq") == [f"file://{tmp_path}/out/ok.parquet"] and seen[0].outputs_of("delta") == []
    assert [(r.kind, r.ok) for r in as_rows(spark, seen).collect()] == [("pq", True), ("delta.merge", False)]
    assert captured(spark, ["select * from five"], 3)[0]["truncated"]


SCRIPT = """
import sys, pyarrow as pa
sys.stdin.read()
s = pa.schema([("a", pa.int64())])
with pa.ipc.new_stream(sys.stdout.buffer, s) as w:
    for k in range(50):
        w.write_batch(pa.record_batch([pa.array(range(1000))], schema=s))
    if "{mode}" == "bad":
        sys.stderr.write("broke"); sys.exit(3)
sys.stderr.write("x" * 300000)
"""


def test_processes(spark, tmp_path):
    got = readers.spawned(spark, [sys.executable, "-c", SCRIPT.replace("{mode}", "good")], stdin=b"y" * 500_000)
    assert got.df.count() == 50_000
    got.settle()
    got.close()
    bad = [sys.executable, "-c", SCRIPT.replace("{mode}", "bad")]
    text = {"tables": [{"name": "p", "src": "process", "command": bad, "destinations": [{"dest": "pq", "filename": "p.parquet"}]}]}
    import yaml

    with pytest.raises(SourceError, match="status 3.*broke"):
        run(spark, C.parse(yaml.safe_dump(text)), Environment(env_for(tmp_path)))
    assert not (tmp_path / "out/p.parquet").exists()
    with pytest.raises(SourceError, match="status 1"):
        readers.spawned(spark, [sys.executable, "-c", "import sys; sys.exit(1)"])


def test_csv(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f'id,"Body Mass (g)",Sex,day\n{k},NA,NA,2024-01-0{k + 1}\n1{k},3.5,"a, b",NA\n')
    got = readers.csv(spark, f"{tmp_path}/*.csv", null="NA").df
    assert got.count() == 6 and dict(got.dtypes) == {"id": "int", "Body Mass (g)": "double", "Sex": "string", "day": "date"} and got.where(F.col("Sex").isNull()).count() == 3


def test_statements():
    assert readers.statements("a; 'x;y'; -- c;d\n b /* ; */;;") == ["a", "'x;y'", "-- c;d\n b /* ; */"]
    with pytest.raises(SourceError):
        readers.query(None, "a; b", utc=False)


def test_roles():
    assert split_role("postgres://h/d?role=x&a=b") == ("postgres://h/d?a=b", "x")
    assert split_role("postgres://h/d?options=-c%20role%3Dx%20-c%20role%3Dy")[1] == "y" and split_role("postgres://h/d")[1] is None


def test_object_store_conf():
    got = readers.object_store_conf({"AWS_ENDPOINT_URL": "http://h:9000", "AWS_SECRET_ACCESS_KEY": "s", "AWS_SKIP_SIGNATURE": "true"})
    assert got["fs.s3a.endpoint"] == "http://h:9000" and "s" not in got.values() and "Anonymous" in got["fs.s3a.aws.credentials.provider"]


def test_jdbc_strategies(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    env = Environment({"FERRY_DEST": url, "FERRY_SRC": url, "FERRY_PARAM_S_T_K_INT": "2"})

    def load(rows, kind, **more):
        spark.createDataFrame(rows, "k int, v string").createOrReplaceTempView("jdbc_rows")
        block = {"name": "jdbc_rows", "src": "table", "destinations": [{"dest": kind, "target": "S.T", "columns": [], **more}]}
        run(spark, [C.parse_table(block, {}, None, None)], env)
        return sorted(tuple(r) for r in readers.jdbc(spark, url, "S.T").df.collect())

    assert load([(1, "a"), (2, "b")], "pg.drop_replace") == [(1, "a"), (2, "b")]
    assert load([(2, "c"), (3, "d")], "pg.merge", merge_keys=["k"]) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(TaskError, match="more than one"):
        load([(2, "x"), (2, "y")], "pg.merge", merge_keys=["k"])
    assert load([(9, "e")], "pg.delete_insert", delete_keys=["k"]) == [(1, "a"), (3, "d"), (9, "e")]
    with pytest.raises(TaskError):
        load([(5, "z")], "pg.truncate_insert", post_sql='insert into nowhere values (1)')
    assert sorted(r.k for r in readers.jdbc(spark, url, "S.T").df.collect()) == [1, 3, 9]
    assert load([(5, "z")], "pg.truncate_insert", post_sql='insert into S.T values (6, \'p\')') == [(5, "z"), (6, "p")]
    read = C.parse("tables: [{name: q, src: jdbc, sql: 'select \"k\" from S.T', dest: pq, filename: q.parquet}]")
    assert run(spark, read, Environment({"FERRY_SRC": url, "FERRY_DEST": f"file://{tmp_path}/out"}))[0].rows == 2


def test_schema_command(capsys):
    assert cli.main(["schema", "delta"]) == 0
    assert [k["title"] for k in json.loads(capsys.readouterr().out)["oneOf"]] == ["delta.overwrite", "delta.merge"]


def test_stream(spark, tmp_path):
    from lakeferry.streaming.microbatch import upsert_stream

    for k, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (2, "d", 3), (3, "e", 1)]]):
        spark.createDataFrame(rows, "k int, v string, o int").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("k int, v string, o int").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = upsert_stream(stream, f"{tmp_path}/t", ["k"], app_id="s", checkpoint=f"{tmp_path}/c", order="o")
    q.awaitTermination()
    assert sorted((r.k, r.v) for r in Table(spark, f"{tmp_path}/t").read().collect()) in ([(1, "a"), (2, "d"), (3, "e")], [(1, "a"), (2, "b"), (3, "e")])


def test_ingest(spark, tmp_path, capsys):
    from lakeferry.functions.paths import PathPattern
    from lakeferry.plans.ingest import IngestError, find_hook, module_paths, storage_data, url_data

    p = PathPattern("{schema}_{table}/v/{_}/*")
    assert module_paths(p, "m") == ["m/schema_table/v/__init__.py", "m/schema_table/v.py", "m/schema_table_v.py"]
    (tmp_path / "schema_table_v.py").write_text("from lakeferry.plans.ingest import Plan\ndef process(url, storage, parts, schema, context):\n    return Plan([f\"select '{parts['table']}' as t, '{url['base_name']}' as b\"], post_sql=['select 1 as one'])\n")
    assert cli.main(["ingest", "file:///a_b/v/x/f.tar.gz", "--pattern", p.pattern, "--modules", str(tmp_path)], spark=spark, environment={}) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["rows"] for x in lines] == [[{"t": "b", "b": "f"}], [{"one": 1}]]
    with pytest.raises(IngestError):
        find_hook(["nowhere.py"])
    u = url_data("https://h.x/a/f.tar.gz?q#z")
    assert (u["filename"], u["file_stem"], u["extension"], u["base_name"], u["full_extension"], u["query"], u["fragment"]) == ("f.tar.gz", "f.tar", "gz", "f", "tar.gz", "q", "z")
    assert storage_data("abfss://c@acc.dfs.core.windows.net/a/b") == {"type": "azure", "storage_account": "acc", "container": "c", "path": "a/b"}


def test_catalog_types(spark, tmp_path):
    from lakeferry.functions.catalog import from_jdbc
    from lakeferry.sinks.jdbc import Connection

    assert [from_jdbc("c", *x).ddl() for x in ((5, 5, 0), (2, 18, 4), (12, 10, 0), (12, 2147483647, 0), (1111, 0, 0, "jsonb"), (93, 29, 3, "timestamptz"))] == ["smallint", "numeric(18, 4)", "varchar(10)", "text", "jsonb", "timestamptz"]
    assert from_jdbc("c", 93, 29, 9).time_unit == "Micros" and from_jdbc("c", 93, 19, 0).time_unit == "Second" and from_jdbc("c", 1111, 0, 0, "point") is None
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    with Connection(spark, url) as c:
        for name in ("S.T", "R.T"):
            c.run(f"create table {name} (a int, b varchar(7), d decimal(9,2), w timestamp" + (", more int)" if name == "R.T" else ")"))
        assert [(x.name, x.ddl()) for x in c.columns("s", "t")] == [("A", "integer"), ("B", "varchar(7)"), ("D", "numeric(9, 2)"), ("W", "timestamp")]
    assert [c.kind for c in readers.jdbc(spark, url, "S.T").columns] == ["integer", "varchar", "numeric", "timestamp"]


def test_merge_updates_in_place(spark, tmp_path):
    from lakeferry.sinks.jdbc import Connection, JdbcSink

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    with Connection(spark, url) as c:
        c.run('create table S.T ("k" int, "v" varchar(9), "extra" int)')
        c.run("insert into S.T values (1, 'a', 10), (2, 'b', 20)")
        c.run("create table S.GONE (n int)")
        c.run("create trigger S.ondelete after delete on S.T for each row insert into S.GONE values (1)")
    sink = JdbcSink(spark, url, "S.T", "merge", keys=["k"])
    df = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    sink.prepare(df, from_schema(df.schema))
    sink.publish()
    assert sink.source_rows == 2 and sorted(map(tuple, readers.jdbc(spark, url, "S.T").df.collect())) == [(1, "a", 10), (2, "B", 20), (3, "C", None)]
    assert readers.jdbc(spark, url, "S.GONE").df.count() == 0
    only = JdbcSink(spark, url, "S.T", "merge", keys=["k"])
    only.prepare(df.select("k"), from_schema(df.select("k").schema))
    only.publish()
    assert readers.jdbc(spark, url, "S.T").df.count() == 3


def test_each_row_of_a_source_is_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def passed(rows):
        for b in rows:
            seen.add(b.num_rows)
            yield b

    spark.range(100).mapInArrow(passed, "id long").createOrReplaceTempView("counted_rows")
    env = Environment({"FERRY_DEST": f"file://{tmp_path}/out"})
    for k, more in enumerate(({"dest": "pq", "filename": "a-{{ index }}.parquet"}, {"dest": "pq", "filename": "b.parquet"}, {"dest": "delta.merge", "merge_keys": ["id"]}, {"dest": "delta.overwrite", "max_bytes": 300}), 1):
        [phase] = run(spark, [C.parse_table({"name": "counted_rows", "src": "table", **more}, {}, None, None)], env)
        assert (phase.rows, seen.value) == (100, 100 * k)


def test_finalize_hooks_of_the_command_line(spark, tmp_path):
    (tmp_path / "hooks").mkdir()
    (tmp_path / "hooks/note.py").write_text(f"def finalize(phase):\n    return [f\"create or replace temp view noted as select '{{phase.name}}' as name, {{phase.rows}} as n\"]\n")
    text = "modules: hooks\ntables: [{name: r, src: sql, sql: 'select 1 as a', finalize: [{run: note}], destinations: [{dest: pq, filename: r.parquet}]}]"
    (tmp_path / "load.yaml").write_text(text)
    own = {"FERRY_DEST": f"file://{tmp_path}/out"}
    assert cli.main(["ld", "--config", str(tmp_path / "load.yaml")], spark=spark, environment=own) == 0
    assert tuple(spark.table("noted").first()) == ("r", 1)
    (tmp_path / "load.yaml").write_text(text.replace("run: note", "run: nowhere"))
    with pytest.raises(C.ConfigError, match="unknown finalize hook"):
        cli.main(["ld", "--config", str(tmp_path / "load.yaml")], spark=spark, environment=own)


def test_footers_of_files_in_other_stores(spark, tmp_path, monkeypatch):
    table = pa.table({"doc": pa.array(["{}"], pa.json_()), "n": pa.array([1], pa.int32()), "w": pa.array([0], pa.timestamp("ms", "UTC"))})
    pq.write_table(table, tmp_path / "a.parquet")
    near = [c.ddl() for c in readers.parquet(spark, str(tmp_path / "a.parquet")).columns]
    monkeypatch.setattr(readers, "local_path", lambda url: None)
    far = readers.parquet(spark, str(tmp_path / "a.parquet"))
    assert [c.ddl() for c in far.columns] == near and [c.kind for c in far.columns] == ["jsonb", "integer", "timestamptz"]
    assert readers.parquet(spark, str(tmp_path / "*.parquet")).df.count() == 1 and readers.parquet(spark, str(tmp_path)).df.count() == 1
