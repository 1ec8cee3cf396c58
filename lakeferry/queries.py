"""The registered queries of the loading operators, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeferry.deltalog.table import Table, Txn
from lakeferry.deltalog.vacuum import classify, vacuum
from lakeferry.functions.binary import hex_text, json_key
from lakeferry.functions.casts import apply_casts
from lakeferry.functions.paths import PathPattern, resolve_url, url_parts
from lakeferry.functions.types import ColumnSpec as S
from lakeferry.functions.types import SchemaError, from_schema
from lakeferry.operators import stats
from lakeferry.operators.schema import SchemaChange, layered
from lakeferry.plans.config import parse
from lakeferry.plans.environment import Environment
from lakeferry.plans.outcome import as_rows
from lakeferry.plans.runner import run
from lakeferry.sources import readers
from lakeferry.sources.scratch import scratch
from lakeferry.streaming.microbatch import upsert_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return readers.parquet(spark, f"{sf_dir}/{name}.parquet").df


def cast(df: DataFrame, *columns: S, source: list[S] | None = None) -> DataFrame:
    return apply_casts(df, list(columns), source=source)[0]


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        t(spark, sf_dir, n).createOrReplaceTempView(n)


def dec(p: int, s: int, name: str) -> S:
    return S(name, "numeric", precision=p, scale=s)


# Sources


@query("src_file_passthrough", "SELECT * FROM nation")
def _(spark, d):
    return readers.parquet(spark, f"{d}/nation.parquet").df


@query("src_table", "SELECT * FROM region")
def _(spark, d):
    views(spark, d, "region")
    return readers.table(spark, "region").df


JOIN_AGG = "SELECT n_name, c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS decimal(18,2))) AS double) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= timestamp '1995-01-01' GROUP BY n_name, c_mktsegment"


@query("src_sql_join_agg", JOIN_AGG)
def _(spark, d):
    views(spark, d, "customer", "orders", "nation")
    return readers.query(spark, JOIN_AGG).df


WINDOW = "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), -1) AS before FROM orders"


@query("src_sql_window", WINDOW)
def _(spark, d):
    views(spark, d, "orders")
    return readers.query(spark, WINDOW).df


SETS = "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS decimal(18,2))) AS double) AS quantity, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"


@query("src_sql_grouping_sets", SETS)
def _(spark, d):
    views(spark, d, "lineitem")
    return readers.query(spark, SETS).df


SETOPS = "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)"


@query("src_sql_setops", SETOPS)
def _(spark, d):
    views(spark, d, "customer", "supplier", "nation")
    return readers.query(spark, SETOPS).df


@query("src_sql_named_params", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey < 5000")
def _(spark, d):
    views(spark, d, "orders")
    return readers.query(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :status AND o_orderkey < :below", args={"status": "F", "below": 5000}).df


@query("src_sql_positional_params", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey > 100")
def _(spark, d):
    views(spark, d, "orders")
    return readers.query(spark, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = ? AND o_custkey > ?", args=["1-URGENT", 100]).df


@query("src_sql_pre_statements", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def _(spark, d):
    views(spark, d, "customer")
    return readers.query(spark, "SELECT c_mktsegment, count(*) AS n FROM solvent GROUP BY c_mktsegment", pre_sql="CREATE OR REPLACE TEMP VIEW solvent AS SELECT * FROM customer WHERE c_acctbal > 0; -- and no more").df


@query("src_sql_semi_anti", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)")
def _(spark, d):
    views(spark, d, "customer", "orders")
    return readers.query(spark, "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') p ON p.o_custkey = c_custkey LEFT ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000) f ON f.o_custkey = c_custkey").df


TOP = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"


@query("src_sql_topk", TOP)
def _(spark, d):
    views(spark, d, "orders")
    return readers.query(spark, TOP).df


def both(name: str, sql: str, *tables: str) -> None:
    """A query whose text both engines understand."""
    query(name, sql)(lambda spark, d: (views(spark, d, *tables), readers.query(spark, sql).df)[1])


both("src_sql_cube", "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")
both("src_sql_rollup", "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, max(l_shipdate) AS latest FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
both("src_sql_full_join", "SELECT coalesce(c.k, -1) AS customer, coalesce(o.k, -1) AS orderer, coalesce(o.n, 0) AS n FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) c FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) o ON c.k = o.k", "customer", "orders")
both("src_sql_range_join", "SELECT n_nationkey, count(*) AS n FROM nation JOIN customer ON c_acctbal >= n_nationkey * 100 AND c_acctbal < n_nationkey * 100 + 50 GROUP BY n_nationkey", "nation", "customer")
# The last earlier event of the user: one pass over each user's rows in time order instead of a join.
both("src_sql_asof", "SELECT event_id, coalesce(max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS seen FROM events", "events")
both("src_sql_exists_scalar", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders i WHERE i.o_orderpriority = o.o_orderpriority)", "orders")
both("src_sql_strings", "SELECT p_partkey, upper(p_name) AS u, length(p_brand) AS n, replace(p_type, ' ', '_') AS t, substring(p_name, 2, 3) AS s, concat(p_brand, '/', p_type) AS c, trim(concat(' ', p_brand, ' ')) AS r FROM part", "part")
both("src_sql_dates", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q FROM orders", "orders")
both("src_sql_distinct_having", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 5", "lineitem")
both("src_sql_running", "SELECT event_id, sum(CAST(value AS decimal(18,4))) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 200 AS high, ntile(4) OVER (PARTITION BY event_type ORDER BY event_id) AS quarter FROM events", "events")


both("src_sql_math", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, CAST(floor(p_retailprice / 7) AS BIGINT) AS sevenths, abs(p_size - 25) AS off, power(2, p_size % 8) AS two, CAST(sign(p_size - 25) AS INTEGER) AS s FROM part", "part")
# Each event with the last order that its user placed before: rows of both tables meet in one pass over each user's in time order,
# instead of a join of ranges.
ASOF = "SELECT event_id, coalesce(seen, -1) AS seen FROM (SELECT event_id, {} OVER (PARTITION BY k ORDER BY moment, side, o, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM (SELECT user_id AS k, ts AS moment, 1 AS side, CAST(NULL AS BIGINT) AS o, event_id FROM events UNION ALL SELECT o_custkey, o_orderdate, 0, o_orderkey, CAST(NULL AS BIGINT) FROM orders) x) y WHERE event_id IS NOT NULL"


@query("src_sql_asof_join", ASOF.format("last_value(o IGNORE NULLS)"))
def _(spark, d):
    views(spark, d, "events", "orders")
    return readers.query(spark, ASOF.format("last_value(o) IGNORE NULLS")).df


@query("src_sql_udf", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS band, c_acctbal * 2 AS doubled FROM customer")
def _(spark, d):
    """Functions that a load's statements define."""
    views(spark, d, "customer")
    pre = "CREATE OR REPLACE TEMPORARY FUNCTION band_of(x DOUBLE) RETURNS STRING RETURN CASE WHEN x < 0 THEN 'debt' WHEN x < 5000 THEN 'some' ELSE 'rich' END; CREATE OR REPLACE TEMPORARY FUNCTION twice(x DOUBLE) RETURNS DOUBLE RETURN x * 2"
    return readers.query(spark, "SELECT c_custkey, band_of(c_acctbal) AS band, twice(c_acctbal) AS doubled FROM customer", pre_sql=pre).df


@query("src_sql_approximate", "SELECT true AS near_count, true AS near_median FROM orders HAVING count(*) > 0")
def _(spark, d):
    """Sketches within their error bounds of the exact values."""
    views(spark, d, "orders")
    return readers.query(spark, "SELECT abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.15 * count(DISTINCT o_custkey) AS near_count, abs(approx_percentile(o_totalprice, 0.5, 10000) - percentile(o_totalprice, 0.5)) <= 0.02 * percentile(o_totalprice, 0.5) AS near_median FROM orders").df


@query("src_csv_nulls", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, c_nationkey FROM customer")
def _(spark, d):
    folder = scratch(spark)
    own = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey")
    own.repartition(3).write.option("header", True).option("nullValue", "NA").csv(folder)
    return readers.csv(spark, f"{folder}/*.csv", null="NA", schema="c_custkey bigint, c_mktsegment string, c_nationkey int").df


@query("src_arrow_stream", "SELECT * FROM supplier")
def _(spark, d):
    import io

    from lakeferry.sinks.arrow import ArrowSink

    out, own = io.BytesIO(), t(spark, d, "supplier")
    sink = ArrowSink(out, "supplier")
    sink.prepare(own, from_schema(own.schema))
    sink.publish()
    out.seek(0)
    return readers.arrow_stream(spark, out, scratch(spark))[0]


# Casts


@query("cast_widen_int", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def _(spark, d):
    return cast(t(spark, d, "nation"), S("n_nationkey", "bigint"), S("n_regionkey", "bigint"))


@query("cast_narrow_int", "SELECT p_partkey, CAST(p_size AS SMALLINT) AS p_size FROM part")
def _(spark, d):
    return cast(t(spark, d, "part").select("p_partkey", "p_size"), S("p_size", "smallint"))


@query("cast_text_to_int", "SELECT o_orderkey, CAST(CAST(o_custkey AS VARCHAR) AS BIGINT) AS c FROM orders")
def _(spark, d):
    return cast(t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("c")), S("c", "bigint"))


@query("cast_int_to_text", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def _(spark, d):
    return cast(t(spark, d, "orders").select("o_orderkey", "o_custkey"), S("o_custkey", "text"))


@query("cast_int_to_decimal", "SELECT l_orderkey, l_linenumber, CAST(CAST(CAST(l_suppkey AS decimal(20,0)) * 0.01 AS decimal(18,2)) AS VARCHAR) AS cents FROM lineitem")
def _(spark, d):
    own = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("cents"))
    own = cast(own, dec(18, 2, "cents"), source=[dec(18, 2, "cents")])
    return own.withColumn("cents", F.col("cents").cast("string"))


@query("cast_int_backed_to_double", "SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS DOUBLE) / 100.0 AS cents FROM lineitem")
def _(spark, d):
    own = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("cents"))
    return cast(own, S("cents", "double"), source=[dec(18, 2, "cents")])


@query("cast_rescale_decimal", "SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS decimal(38,5)) AS decimal(18,2)) AS VARCHAR) AS price FROM orders")
def _(spark, d):
    own = cast(t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), dec(38, 5, "price"))
    return cast(own, dec(18, 2, "price")).withColumn("price", F.col("price").cast("string"))


@query("cast_numeric_to_text", "SELECT o_orderkey, CAST(CAST(o_totalprice AS decimal(18,2)) AS VARCHAR) AS price FROM orders")
def _(spark, d):
    own = cast(t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), dec(18, 2, "price"))
    return cast(own, S("price", "text"))


@query("cast_uuid_roundtrip", "SELECT c_custkey, md5(c_name)[1:8] || '-' || md5(c_name)[9:12] || '-' || md5(c_name)[13:16] || '-' || md5(c_name)[17:20] || '-' || md5(c_name)[21:32] AS id FROM customer")
def _(spark, d):
    own = t(spark, d, "customer").select("c_custkey", F.upper(F.md5("c_name")).alias("id"))
    own, specs = apply_casts(own, [S("id", "uuid")])
    return cast(own, S("id", "text"), source=specs)


@query("cast_ts_to_tz", "SELECT event_id, epoch_us(ts) AS us FROM events")
def _(spark, d):
    own = cast(t(spark, d, "events").select("event_id", "ts"), S("ts", "timestamptz", time_unit="Micros"))
    return own.select("event_id", F.unix_micros("ts").alias("us"))


@query("cast_ts_millis", "SELECT event_id, CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS ts FROM events")
def _(spark, d):
    return cast(t(spark, d, "events").select("event_id", "ts"), S("ts", "timestamp", time_unit="Millis"))


@query("cast_ts_to_date", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS ts FROM events")
def _(spark, d):
    return cast(t(spark, d, "events").select("event_id", "ts"), S("ts", "date")).withColumn("ts", F.col("ts").cast("string"))


@query("cast_names_from_specs", "SELECT CAST(r_regionkey AS BIGINT) AS \"R_RegionKey\", r_name FROM region")
def _(spark, d):
    return cast(t(spark, d, "region"), S("R_RegionKey", "bigint"))


# Schemas


@query("schema_layers", "SELECT * FROM (VALUES (0, 'r_regionkey', 'bigint'), (1, 'r_name', 'jsonb')) v(place, name, kind)")
def _(spark, d):
    own = layered(from_schema(t(spark, d, "region").schema), [[S("R_NAME", "text"), S("other", "date")], [S("r_regionkey", "bigint"), S("r_name", "jsonb")]])
    return spark.createDataFrame([(k, c.name, c.kind) for k, c in enumerate(own)], "place int, name string, kind string")


@query("schema_change", "SELECT * FROM (VALUES ('r_regionkey', 'modified'), ('r_name', NULL), ('gone', 'removed')) v(name, change)")
def _(spark, d):
    now = [*from_schema(t(spark, d, "region").schema), S("gone", "date")]
    change = SchemaChange.between(now, [S("r_name", "text"), S("r_regionkey", "bigint"), S("more", "uuid")])
    return spark.createDataFrame([(c.name, x) for c, x in zip(now, change.changes, strict=True)], "name string, change string")


@query("reject_nested", "SELECT 'SchemaError' AS error, 'embedding' AS named")
def _(spark, d):
    try:
        from_schema(t(spark, d, "embeddings").schema)
        found = ("none", "none")
    except SchemaError as e:
        found = (type(e).__name__, str(e).split("'")[1])
    return spark.createDataFrame([found], "error string, named string")


# Strategies: what loads run, against Derby as the database and against tables under a log. Sides are shares of the key range, so
# that they grow with the table: the target holds keys below six tenths of the greatest, the source those from four tenths on.

LO, HI = "(SELECT max({0}) * 4 // 10 FROM {1})", "(SELECT max({0}) * 6 // 10 FROM {1})"


def sided(sql: str, key: str, table: str) -> str:
    """SQL with the bounds in place of LO and HI."""
    return sql.replace("LO", LO.format(key, table)).replace("HI", HI.format(key, table))


def sides(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    most = df.agg(F.max(key)).first()[0]
    return df.where(F.col(key) < most * 6 // 10), df.where(F.col(key) >= most * 4 // 10)


def in_database(spark: SparkSession, target: DataFrame, source: DataFrame, strategy: str, **more) -> DataFrame:
    """The table after the target was put there and the source loaded over it. The database is on the driver's disk: its heap is too small
    for large ones."""
    import atexit
    import shutil
    import tempfile

    from lakeferry.sinks.jdbc import JdbcSink

    folder = tempfile.mkdtemp(prefix="lakeferry-derby-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    url = f"jdbc:derby:{folder}/db;create=true"
    for df, kind, own in ((target, "drop_replace", {}), (source, strategy, more)):
        sink = JdbcSink(spark, url, "S.T", kind, **own)
        sink.prepare(df, from_schema(df.schema))
        sink.publish()
    return readers.jdbc(spark, url, "S.T").df


def merged(spark: SparkSession, target: DataFrame, source: DataFrame, keys: list[str], **more) -> DataFrame:
    """The rows of a table under a log after the source was merged into the target."""
    table = log_table(spark)
    table.overwrite(target)
    table.merge(source, keys, **more)
    return table.read()


@query("strategy_drop_replace", sided("SELECT c_custkey, upper(c_mktsegment) AS segment FROM customer WHERE c_custkey >= LO", "c_custkey", "customer"))
def _(spark, d):
    target, source = sides(t(spark, d, "customer"), "c_custkey")
    return in_database(spark, target, source.select("c_custkey", F.upper("c_mktsegment").alias("segment")), "drop_replace")


@query("strategy_truncate_insert", sided("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer WHERE c_custkey >= LO", "c_custkey", "customer"))
def _(spark, d):
    target, source = sides(t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("c_nationkey")), "c_custkey")
    return in_database(spark, target, source.select("c_nationkey", "c_custkey"), "truncate_insert")


@query("strategy_delete_insert", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') UNION ALL SELECT o_orderkey, o_orderstatus, 0.0, o_orderpriority FROM orders WHERE o_orderstatus = 'O'")
def _(spark, d):
    own = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    source = own.where("o_orderstatus = 'O'").withColumn("o_totalprice", F.lit(0.0))
    return in_database(spark, own, source, "delete_insert", delete_values={"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query("strategy_jdbc_merge", sided("SELECT c_custkey AS k, CASE WHEN c_custkey >= LO THEN 'new ' ELSE 'old ' END || c_name AS v, CASE WHEN c_custkey < HI THEN c_acctbal END AS kept FROM customer", "c_custkey", "customer"))
def _(spark, d):
    """The source lacks a column of the target, which keeps what it holds."""
    target, source = sides(t(spark, d, "customer"), "c_custkey")
    named = lambda df, word: df.select(F.col("c_custkey").alias("k"), F.concat(F.lit(word), "c_name").alias("v"), F.col("c_acctbal").alias("kept"))
    return in_database(spark, named(target, "old "), named(source, "new ").drop("kept"), "merge", keys=["k"])


@query("upsert_basic", sided("SELECT o_orderkey, o_custkey, o_totalprice + CASE WHEN o_orderkey >= LO THEN 1 ELSE 0 END AS o_totalprice FROM orders", "o_orderkey", "orders"))
def upsert_basic(spark, d):
    target, source = sides(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")
    return merged(spark, target, source.withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"])


@query("upsert_string_key", sided("SELECT c_name, CASE WHEN c_custkey >= LO THEN -c_custkey ELSE c_custkey END AS c_custkey FROM customer", "c_custkey", "customer"))
def _(spark, d):
    target, source = sides(t(spark, d, "customer").select("c_name", "c_custkey"), "c_custkey")
    return merged(spark, target, source.withColumn("c_custkey", -F.col("c_custkey")), ["c_name"])


@query("upsert_timestamp_key", sided("SELECT event_id, ts FROM events e WHERE event_id < HI AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id >= LO AND s.ts = e.ts) UNION ALL SELECT -event_id, ts FROM events WHERE event_id >= LO", "event_id", "events"))
def _(spark, d):
    target, source = sides(t(spark, d, "events").select("event_id", "ts"), "event_id")
    return merged(spark, target, source.withColumn("event_id", -F.col("event_id")), ["ts"])


@query("upsert_decimal_key", sided("SELECT CAST(k AS VARCHAR) AS k, v FROM (SELECT CAST(o_orderkey AS decimal(18,2)) AS k, CASE WHEN o_orderkey >= LO THEN 'new' ELSE o_orderstatus END AS v FROM orders)", "o_orderkey", "orders"))
def _(spark, d):
    own = t(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_orderkey").cast("decimal(18,2)").alias("k"), F.col("o_orderstatus").alias("v"))
    target, source = (x.drop("o_orderkey") for x in sides(own, "o_orderkey"))
    return merged(spark, target, source.withColumn("v", F.lit("new")), ["k"]).withColumn("k", F.col("k").cast("string"))


@query("upsert_composite_key", sided("WITH s AS (SELECT * FROM lineitem WHERE l_suppkey >= LO) SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem x WHERE l_suppkey < HI AND NOT EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = x.l_orderkey AND s.l_linenumber = x.l_linenumber) UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey FROM s", "l_suppkey", "lineitem"))
def _(spark, d):
    target, source = sides(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey")
    return merged(spark, target, source, ["l_orderkey", "l_linenumber"])


@query("upsert_payload", "SELECT doc_id, CASE WHEN lang <> 'en' THEN upper(lang) || ' ' || source ELSE text END AS text, lang FROM documents")
def _(spark, d):
    own = t(spark, d, "documents")
    return merged(spark, own.select("doc_id", "text", "lang"), own.where("lang <> 'en'").select("doc_id", F.concat(F.upper("lang"), F.lit(" "), "source").alias("text"), "lang"), ["doc_id"])


@query("upsert_conversations", "SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'edited' ELSE role END AS role, text FROM conversations")
def _(spark, d):
    own = t(spark, d, "conversations")
    return merged(spark, own, own.where("turn = 1").withColumn("role", F.lit("edited")), ["conv_id", "turn"])


@query("upsert_all_match", "SELECT o_orderkey, 'X' AS o_orderstatus FROM orders")
def _(spark, d):
    own = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return merged(spark, own, own.withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("upsert_empty_target", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, d):
    own = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return merged(spark, own.where("false"), own, ["o_orderkey"])


@query("upsert_twice", sided("SELECT o_orderkey, CASE WHEN o_orderkey >= LO THEN 'B' WHEN o_orderkey < HI THEN 'A' END AS o_orderstatus FROM orders", "o_orderkey", "orders"))
def _(spark, d):
    own, table = t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), log_table(spark)
    table.overwrite(own)
    for df, word in zip(sides(own, "o_orderkey"), "AB", strict=True):
        table.merge(df.withColumn("o_orderstatus", F.lit(word)), ["o_orderkey"])
    return table.read()


@query("upsert_null_keys", sided("WITH x AS (SELECT CASE WHEN c_nationkey > 2 THEN c_custkey END AS k, c_custkey AS v FROM customer) SELECT coalesce(k, -1) AS k, v FROM x a WHERE v < HI AND NOT EXISTS (SELECT 1 FROM x s WHERE s.v >= LO AND s.k IS NOT DISTINCT FROM a.k) UNION ALL SELECT coalesce(k, -1), v FROM x WHERE v >= LO", "c_custkey", "customer"))
def _(spark, d):
    own = t(spark, d, "customer").select(F.when(F.col("c_nationkey") > 2, F.col("c_custkey")).alias("k"), F.col("c_custkey").alias("v"))
    return merged(spark, *sides(own, "v"), ["k"], allow_null_keys=True).withColumn("k", F.coalesce("k", F.lit(-1)))


def counted(spark: SparkSession, target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    table = log_table(spark)
    table.overwrite(target)
    s = table.merge(source, keys)
    return spark.createDataFrame([(s.source_rows, s.matched_rows, s.inserted_rows)], "source_rows long, matched_rows long, inserted_rows long")


@query("upsert_dup_target_stats", "WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'), m AS (SELECT count(*) AS n FROM lineitem x JOIN s USING (l_orderkey, l_linenumber)) SELECT (SELECT count(*) FROM s) AS source_rows, n AS matched_rows, greatest(0, (SELECT count(*) FROM s) - n) AS inserted_rows FROM m")
def _(spark, d):
    own = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return counted(spark, own.drop("l_returnflag"), own.where("l_returnflag = 'R'").drop("l_returnflag").distinct(), ["l_orderkey", "l_linenumber"])


@query("merge_stats", sided("SELECT count(*) FILTER (o_orderkey >= LO) AS source_rows, count(*) FILTER (o_orderkey >= LO AND o_orderkey < HI) AS matched_rows, count(*) FILTER (o_orderkey >= HI) AS inserted_rows FROM orders", "o_orderkey", "orders"))
def _(spark, d):
    return counted(spark, *sides(t(spark, d, "orders").select("o_orderkey"), "o_orderkey"), ["o_orderkey"])


# Tables under a log


def log_table(spark) -> Table:
    return Table(spark, scratch(spark))


@query("delta_overwrite_read", sided("SELECT c_custkey, c_name FROM customer WHERE c_custkey >= LO", "c_custkey", "customer"))
def _(spark, d):
    table = log_table(spark)
    for df in sides(t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey"):
        table.overwrite(df)
    return table.read()


@query("delta_merge_on_read", sided("SELECT o_orderkey, o_totalprice * CASE WHEN o_orderkey >= LO THEN 2 ELSE 1 END AS o_totalprice FROM orders", "o_orderkey", "orders"))
def _(spark, d):
    target, source = sides(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return merged(spark, target, source.withColumn("o_totalprice", F.col("o_totalprice") * 2), ["o_orderkey"])


@query("delta_partitioned", sided("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey >= LO THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders", "o_orderkey", "orders"))
def _(spark, d):
    """A table partitioned by one column, merged by it and another."""
    target, source = sides(t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderkey")
    table = log_table(spark)
    table.log.create(from_schema(target.schema), ["o_orderpriority"])
    table.overwrite(target)
    table.merge(source.withColumn("o_orderstatus", F.lit("new")), ["o_orderpriority", "o_orderkey"])
    return table.read()


@query("dv_apply", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'D' FROM orders WHERE o_orderkey % 7 = 0")
def _(spark, d):
    own, table = t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), log_table(spark)
    table.overwrite(own.repartition(3))
    for word, by in (("C", 14), ("D", 7)):
        table.merge(own.where(F.col("o_orderkey") % by == 0).withColumn("o_orderstatus", F.lit(word)), ["o_orderkey"])
    return table.read()


@query("delta_time_sequence", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'third' WHEN c_custkey % 2 = 0 THEN 'second' ELSE 'first' END AS v FROM customer")
def _(spark, d):
    own, table = t(spark, d, "customer").select("c_custkey"), log_table(spark)
    for word, by in (("first", 1), ("second", 2), ("third", 3)):
        table.merge(own.where(F.col("c_custkey") % by == 0).withColumn("v", F.lit(word)), ["c_custkey"])
    return table.read()


@query("delta_log_actions", "SELECT * FROM (VALUES (0, 'commitInfo,metaData,protocol'), (1, 'add,commitInfo,metaData,protocol'), (2, 'add,commitInfo,metaData,protocol,remove,txn')) v(version, actions)")
def _(spark, d):
    own, table = t(spark, d, "nation"), log_table(spark)
    table.overwrite(own.coalesce(1))
    table.merge(own.coalesce(1).where("n_nationkey < 5"), ["n_nationkey"], txn=Txn("a", batch_version=1))
    return spark.createDataFrame([(v, ",".join(sorted({k for a in table.log.actions(v) for k in a}))) for v in table.log.versions()], "version int, actions string")


@query("delta_merge_stats", sided("SELECT count(*) FILTER (o_orderkey >= LO) AS source_rows, count(*) FILTER (o_orderkey >= LO AND o_orderkey < HI) AS matched_rows, count(*) FILTER (o_orderkey >= HI) AS inserted_rows, 1 AS files_removed FROM orders", "o_orderkey", "orders"))
def _(spark, d):
    (target, source), table = sides(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"), log_table(spark)
    table.overwrite(target.repartition(1))
    s = table.merge(source, ["o_orderkey"])
    return spark.createDataFrame([(s.source_rows, s.matched_rows, s.inserted_rows, s.files_removed)], "source_rows long, matched_rows long, inserted_rows long, files_removed int")


@query("txn_watermark_skip", "SELECT event_id, 'first' AS v FROM events")
def _(spark, d):
    own, table = t(spark, d, "events").select("event_id", "ts"), log_table(spark)
    for word in ("first", "second"):  # the second load is not newer than what the first one committed
        table.merge(own.withColumn("v", F.lit(word)), ["event_id"], txn=Txn("events", watermark_column="ts"))
    return table.read().select("event_id", "v")


@query("txn_batch_version_skip", "SELECT n_nationkey, 'third' AS v FROM nation")
def _(spark, d):
    own, table = t(spark, d, "nation").select("n_nationkey"), log_table(spark)
    for word, version in (("first", 7), ("second", 7), ("third", 8)):
        table.merge(own.withColumn("v", F.lit(word)), ["n_nationkey"], txn=Txn("nations", batch_version=version))
    return table.read()


@query("watermark_value", "SELECT epoch_us(max(ts)) AS watermark FROM events")
def _(spark, d):
    return stats.watermark(t(spark, d, "events"), "ts")


@query("checkpoint_replay", "SELECT o_orderkey FROM orders")
def _(spark, d):
    """Twelve merges that together bring all orders."""
    own, table = t(spark, d, "orders").select("o_orderkey"), log_table(spark)
    most = own.agg(F.max("o_orderkey")).first()[0]
    for k in range(12):
        table.merge(own.where((F.col("o_orderkey") >= (most + 1) * k // 12) & (F.col("o_orderkey") < (most + 1) * (k + 1) // 12)), ["o_orderkey"])
    if table.log.snapshot().checkpoint != 10:
        raise AssertionError("no checkpoint at version 10")
    return table.read()


@query("stream_upsert", "SELECT event_id, event_type, value FROM events")
def _(spark, d):
    folder, own = scratch(spark), t(spark, d, "events").select("event_id", "event_type", "value")
    own.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    upsert_stream(stream, f"{folder}/table", ["event_id"], app_id="events", checkpoint=f"{folder}/progress").awaitTermination()
    return Table(spark, f"{folder}/table").read()


# Statistics


@query("file_stats_orders", "SELECT count(*) AS num_records, count(*) FILTER (o_orderkey IS NULL) AS null_count_o_orderkey, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey, count(*) FILTER (o_orderstatus IS NULL) AS null_count_o_orderstatus, min(o_orderstatus) AS min_o_orderstatus, max(o_orderstatus) AS max_o_orderstatus, count(*) FILTER (o_totalprice IS NULL) AS null_count_o_totalprice, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice, count(*) FILTER (o_orderdate IS NULL) AS null_count_o_orderdate, min(o_orderdate) AS min_o_orderdate, max(o_orderdate) AS max_o_orderdate FROM orders")
def _(spark, d):
    return stats.file_stats(t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"))


@query("file_stats_events", "SELECT event_type, count(*) AS num_records, count(*) FILTER (value IS NULL) AS null_count_value, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY event_type")
def _(spark, d):
    own = t(spark, d, "events")
    return stats.file_stats(own.select("event_type", "value"), [F.col("event_type")]).select("event_type", "num_records", "null_count_value", "min_value", "max_value")


def in_files(spark: SparkSession, df: DataFrame, key: str, n: int = 15) -> Table:
    """A table of files by ranges of a key."""
    table = log_table(spark)
    table.overwrite(df.repartitionByRange(n, key).sortWithinPartitions(key))
    return table


@query("key_bounds", sided("SELECT CAST(min(l_orderkey) AS VARCHAR) AS least_order, CAST(max(l_orderkey) AS VARCHAR) AS greatest_order, min(l_shipdate) AS least_date, max(l_shipdate) + INTERVAL 1 MILLISECOND AS greatest_date FROM lineitem WHERE l_suppkey >= LO", "l_suppkey", "lineitem"))
def _(spark, d):
    """The ranges of a merge's keys, from the statistics of what it has staged. Times are known to the millisecond, rounded up."""
    _, source = sides(t(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_suppkey"), "l_suppkey")
    table = log_table(spark)
    staged = table.stage_merge(source, ["l_orderkey", "l_shipdate"])
    own = table.ranges(table.log.snapshot(), staged.adds, staged.keys)
    return spark.createDataFrame([(*map(str, own["l_orderkey"]), *own["l_shipdate"])], "least_order string, greatest_order string, least_date timestamp_ntz, greatest_date timestamp_ntz")


@query("candidate_files", sided("SELECT count(*) AS matched, true AS pruned FROM orders WHERE o_orderkey >= HI", "o_orderkey", "orders"))
def _(spark, d):
    """Live rows that a probe reads of the files whose range meets the source's: here those are the same."""
    own = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    hi = own.agg(F.max("o_orderkey")).first()[0] * 6 // 10
    table = in_files(spark, own, "o_orderkey")
    now, staged = table.log.snapshot(), table.stage_merge(own.where(F.col("o_orderkey") >= hi), ["o_orderkey"])
    few = len(table.candidates(now, staged.adds, staged.keys)) < len(now.files)
    return table.probe(now, staged.adds, staged.keys).agg(F.count("*").alias("matched")).withColumn("pruned", F.lit(few))


@query("vacuum_classify", "SELECT * FROM (VALUES ('a.parquet', 'keep'), ('b.parquet', 'delete'), ('c.parquet', 'keep'), ('_delta_log/0.json', 'skip'), ('x/.hidden/d.parquet', 'skip'), ('_change_data/e.parquet', 'delete'), ('_p=1/f.parquet', 'delete'), ('_q=1/g.parquet', 'skip'), ('deletion_vector_1.bin', 'keep')) v(path, verdict)")
def _(spark, d):
    files = [("a.parquet", 1), ("b.parquet", 1), ("c.parquet", 99), ("_delta_log/0.json", 1), ("x/.hidden/d.parquet", 1), ("_change_data/e.parquet", 1), ("_p=1/f.parquet", 1), ("_q=1/g.parquet", 1), ("deletion_vector_1.bin", 1)]
    keep = spark.createDataFrame([("a.parquet",), ("deletion_vector_1.bin",)], "path string")
    return classify(spark.createDataFrame(files, "path string, modified_ms long"), keep, 50, ("_p",)).select("path", "verdict")


@query("vacuum_run", sided("SELECT 1 AS selected, 1 AS deleted, count(*) AS left_rows FROM orders WHERE o_orderkey >= LO", "o_orderkey", "orders"))
def _(spark, d):
    table = log_table(spark)
    for df in sides(t(spark, d, "orders"), "o_orderkey"):
        table.overwrite(df.repartition(1))
    r = vacuum(spark, table.store.url, retention="0 seconds", unchecked=True)
    return table.read().agg(F.count("*").alias("left_rows")).select(F.lit(r.selected).alias("selected"), F.lit(r.deleted).alias("deleted"), "left_rows")


# Functions


@query("path_pattern_extract", r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/?#]+)/([^/?#.]+)', 1) AS lang FROM pages")
def _(spark, d):
    own = t(spark, d, "pages").select("page_id", url_parts(F.col("url")).alias("u"))
    return own.select("page_id", F.col("u.host").alias("host"), PathPattern("{lang}/*").extract(F.col("u.path"))["lang"].alias("lang"))


@query("url_parts", r"WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, url FROM pages), n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS filename FROM p) SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, path, filename, split_part(filename, '.', 1) AS base_name, regexp_extract(filename, '^[^.]*\.(.*)$', 1) AS full_extension FROM n")
def _(spark, d):
    u = F.col("u")
    own = t(spark, d, "pages").select("page_id", url_parts(F.col("url")).alias("u"))
    return own.select("page_id", *(u[n].alias(n) for n in ("scheme", "path", "filename", "base_name", "full_extension")))


@query("jsonb_passthrough", "SELECT event_id, props FROM events")
def _(spark, d):
    return cast(t(spark, d, "events").select("event_id", "props"), S("props", "jsonb"))


@query("json_key", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", json_key(F.col("props"), "k").alias("k"))


@query("binary_hex_text", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", hex_text(F.unhex(F.md5("text"))).alias("digest"))


# Whole tasks


def loaded(spark, d, text, **env):
    folder = scratch(spark)
    phases = run(spark, parse(text), Environment({"FERRY_SRC": resolve_url(d), "FERRY_DEST": resolve_url(folder), **env}))
    return folder, phases


@query("fanout_shared", "SELECT 'a' AS tag, o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders UNION ALL SELECT 'b', o_orderkey, CAST(o_custkey AS VARCHAR) FROM orders")
def _(spark, d):
    folder, _ = loaded(spark, d, "tables: [{name: orders, src: file, filename: orders.parquet, columns: [{type: text, name: o_custkey}], destinations: [{dest: pq, filename: 'a-{{ index }}.parquet'}, {dest: pq, filename: 'b-{{ index }}.parquet'}]}]")
    own = lambda tag: spark.read.parquet(f"{folder}/{tag}-*.parquet").select(F.lit(tag).alias("tag"), "o_orderkey", "o_custkey")
    return own("a").unionByName(own("b"))


@query("fanout_per_dest", "SELECT 'a' AS tag, o_orderkey, CAST(o_custkey AS VARCHAR) AS v FROM orders UNION ALL SELECT 'b', o_orderkey, CAST(CAST(o_totalprice AS decimal(18,2)) AS VARCHAR) FROM orders")
def _(spark, d):
    folder, _ = loaded(spark, d, "tables: [{name: orders, src: file, filename: orders.parquet, destinations: [{dest: pq, filename: 'a-{{ index }}.parquet', columns: [{type: text, name: o_custkey}]}, {dest: delta.overwrite, target: b, columns: [{type: numeric, name: o_totalprice, precision: 18, scale: 2}]}]}]")
    a = spark.read.parquet(f"{folder}/a-*.parquet").select(F.lit("a").alias("tag"), "o_orderkey", F.col("o_custkey").alias("v"))
    return a.unionByName(Table(spark, f"{folder}/b").read().select(F.lit("b").alias("tag"), "o_orderkey", F.col("o_totalprice").cast("string").alias("v")))


@query("parquet_rotation", "SELECT 'rows' AS what, CAST(count(*) AS BIGINT) AS n FROM customer UNION ALL SELECT 'too long', 0")
def _(spark, d):
    folder, phases = loaded(spark, d, "tables: [{name: customer, src: file, filename: customer.parquet, destinations: [{dest: pq, filename: 'c-{{ pad index 4 }}.parquet', max_rows: 100}]}]")
    files = phases[0].destinations[0].files
    return spark.createDataFrame([("rows", sum(f["rows"] for f in files)), ("too long", sum(f["rows"] > 100 for f in files))], "what string, n long")


@query("report_rows", "SELECT 'orders' AS task, count(*) AS rows, kind, true AS ok FROM orders, (VALUES ('pq'), ('delta.overwrite')) k(kind) GROUP BY kind")
def _(spark, d):
    _, phases = loaded(spark, d, "tables: [{name: orders, src: file, filename: orders.parquet, destinations: [{dest: pq, filename: 'a-{{ index }}.parquet'}, {dest: delta.overwrite, target: b}]}]")
    return as_rows(spark, phases).select("task", "rows", "kind", "ok")


@query("empty_load", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE false")
def _(spark, d):
    views(spark, d, "orders")
    folder, _ = loaded(spark, d, "tables: [{name: none, src: sql, sql: 'select o_orderkey, o_custkey, o_orderstatus from orders where false', dest: pq, filename: e.parquet}]")
    return spark.read.parquet(f"{folder}/e.parquet")


@query("config_templates", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _(spark, d):
    text = "tables: [{name: nation, src: duckdb, pre_sql: \"create or replace temp view n as select * from parquet.`{{ ensure_trailing src_url }}nation.parquet`\", sql: 'select n_nationkey, n_name from n where n_regionkey = {{ region }}', dest: pq, filename: '{{ shoutySnakeCase name }}/{{ pad region 3 }}.parquet'}]"
    folder, _ = loaded(spark, d, text, FERRY_TEMPL_REGION="9", FERRY_TEMPL_NATION_REGION="2")
    return spark.read.parquet(f"{folder}/NATION/002.parquet")


