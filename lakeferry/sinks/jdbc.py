"""Database tables as destinations. Rows go into a staging table by parallel inserts; then one transaction on one connection
turns it into the target's new state, together with the user's statements, or leaves all as it was.

An embedded Derby database lives in one JVM, the driver's, where executors of their own don't reach it: rows pass between them and
the database as files of text, which Derby imports and exports by itself.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from lakeferry.functions.catalog import from_jdbc
from lakeferry.functions.types import ColumnSpec
from lakeferry.plans.outcome import Outcome
from lakeferry.sources.scratch import scratch
from lakeferry.sources.store import Store

STRATEGIES = ("drop_replace", "truncate_insert", "delete_insert", "merge")


class Connection:
    """A JDBC connection of the driver, as a context that commits or rolls back."""

    def __init__(self, spark: SparkSession, url: str, properties: Mapping[str, str] | None = None):
        jvm = spark.sparkContext._jvm
        props = jvm.java.util.Properties()
        for k, v in (properties or {}).items():
            props.setProperty(k, v)
        jvm.java.lang.Class.forName(driver_of(url))
        self.own = jvm.java.sql.DriverManager.getConnection(url, props)

    def __enter__(self) -> Connection:
        self.own.setAutoCommit(False)
        return self

    def __exit__(self, kind, *_) -> None:
        try:
            self.own.commit() if kind is None else self.own.rollback()
        finally:
            self.own.close()

    def run(self, sql: str, values: Sequence[Any] = ()) -> int:
        s = self.own.prepareStatement(sql)
        try:
            for k, v in enumerate(values):
                s.setObject(k + 1, v)
            return s.executeUpdate()
        finally:
            s.close()

    def value(self, sql: str) -> Any:
        """The first column of the first row, None without one."""
        s = self.own.createStatement()
        try:
            rows = s.executeQuery(sql)
            return rows.getObject(1) if rows.next() else None
        finally:
            s.close()

    def columns(self, schema: str, table: str) -> list[ColumnSpec]:
        """A table's columns, by what the driver says of them; those of a type without a logical one are left out."""
        rows, out = self.own.getMetaData().getColumns(None, None, self.tables(schema).get(table.lower(), table), None), []
        while rows.next():
            if (rows.getString("TABLE_SCHEM") or "").lower() != schema.lower():
                continue
            own = from_jdbc(rows.getString("COLUMN_NAME"), rows.getInt("DATA_TYPE"), rows.getInt("COLUMN_SIZE"), rows.getInt("DECIMAL_DIGITS"), rows.getString("TYPE_NAME"))
            out += [own] if own else []
        return out

    def tables(self, schema: str) -> dict[str, str]:
        """Names of the schema's tables, by their lower-case form."""
        rows, out = self.own.getMetaData().getTables(None, None, None, None), {}
        while rows.next():
            if (rows.getString("TABLE_SCHEM") or "").lower() == schema.lower():
                out[rows.getString("TABLE_NAME").lower()] = rows.getString("TABLE_NAME")
        return out


DRIVERS = {"jdbc:derby:": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "jdbc:postgresql:": "org.postgresql.Driver"}


def driver_of(url: str) -> str:
    for prefix, name in DRIVERS.items():
        if url.startswith(prefix):
            return name
    raise ValueError(f"no driver for {url}")


def jdbc_url(url: str) -> str:
    """postgres:// and postgresql:// as JDBC writes them; a jdbc: URL as it is."""
    for prefix in ("postgres://", "postgresql://"):
        if url.lower().startswith(prefix):
            return f"jdbc:postgresql://{url[len(prefix):]}"
    return url


def out_of_reach(spark: SparkSession, url: str) -> bool:
    """Is this a database inside the driver's JVM, and are executors other processes?"""
    master = spark.sparkContext.master
    return url.startswith("jdbc:derby:") and not url.startswith("jdbc:derby://") and master != "local" and not master.startswith("local[")


def import_rows(c: Connection, df: DataFrame, schema: str, table: str) -> None:
    """df's rows into an embedded table of the same columns: executors write texts, Derby reads them file by file."""
    def text(f: StructField) -> Column:
        own = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType):  # in quotes, so that an empty text isn't a null
            return F.coalesce(F.concat(F.lit('"'), F.replace(own, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))
        return F.coalesce(F.hex(own) if isinstance(f.dataType, BinaryType) else own.cast("string"), F.lit(""))

    store = Store(df.sparkSession, scratch(df.sparkSession))
    local = tempfile.mkdtemp(prefix="lakeferry-import-")
    try:
        df.select(F.concat_ws(",", *map(text, df.schema.fields)).alias("line")).write.text(store.url)
        names = c.tables(schema)
        for x in store.list():
            if not x.path.endswith(".txt") or not x.size:
                continue
            path = os.path.join(local, "rows.txt")
            store.fetch(x.path, path)
            c.run("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(?, ?, ?, ',', '\"', 'UTF-8', 0)", [schema.upper(), names[table.lower()], path])
            os.unlink(path)
    finally:
        shutil.rmtree(local, ignore_errors=True)
        store.delete("")


def exported(spark: SparkSession, c: Connection, table_or_query: str, schema: StructType) -> DataFrame:
    """Rows of an embedded database as a file of texts where executors read it."""
    store, local = Store(spark, scratch(spark)), tempfile.mkdtemp(prefix="lakeferry-export-")
    try:
        path = os.path.join(local, "rows.csv")
        # A letter before each text, as Spark reads an empty one as a null.
        columns = ", ".join(f"""'v' || "{f.name}\"""" if isinstance(f.dataType, StringType) else f'"{f.name}"' for f in schema.fields)
        c.run("CALL SYSCS_UTIL.SYSCS_EXPORT_QUERY(?, ?, ',', '\"', 'UTF-8')", [f"SELECT {columns} FROM {table_or_query}", path])
        store.put(path, "rows.csv")
    finally:
        shutil.rmtree(local, ignore_errors=True)
    texts = StructType([StructField(f.name, StringType()) for f in schema.fields])
    df = spark.read.schema(texts).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).option("mode", "FAILFAST").csv(store.full("rows.csv"))

    def typed(f: StructField) -> Column:
        own = F.col(f"`{f.name}`")
        if isinstance(f.dataType, BinaryType):
            return F.unhex(own)
        return F.substr(own, F.lit(2)) if isinstance(f.dataType, StringType) else own.cast(f.dataType)

    return df.select(*(typed(f).alias(f.name) for f in schema.fields))


class JdbcSink:
    """target is schema.table. delete_values: for delete_insert, a typed value for each key."""

    def __init__(self, spark: SparkSession, url: str, target: str, strategy: str, columns: Sequence[ColumnSpec] = (), *, keys: Sequence[str] = (), delete_values: Mapping[str, Any] | None = None, pre_sql: str | None = None, post_sql: str | None = None, role: str | None = None, properties: Mapping[str, str] | None = None):
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r}")
        if target.count(".") != 1:
            raise ValueError(f"a database target is schema.table, not {target!r}")
        if strategy == "merge" and not keys or strategy == "delete_insert" and not delete_values:
            raise ValueError(f"{strategy} needs keys")
        self.kind, self.spark, self.url, self.target, self.strategy = f"pg.{strategy}", spark, jdbc_url(url), target, strategy
        self.columns, self.keys, self.values, self.properties = list(columns), list(keys), dict(delete_values or {}), dict(properties or {})
        self.pre, self.post, self.role = pre_sql, post_sql, role
        self.schema, self.table = target.split(".")
        self.staging = f"{self.table}_{uuid.uuid4().hex[:12]}"
        self.source_rows: int | None = None
        self.derby = self.url.startswith("jdbc:derby:")

    def _connect(self) -> Connection:
        return Connection(self.spark, self.url, self.properties)

    def prepare(self, df: DataFrame, columns: list[ColumnSpec]) -> None:
        self.names = df.columns
        types = ", ".join(f"{self._name(n)} {self._type(c)}" for n, c in zip(df.columns, columns, strict=True))
        with self._connect() as c:
            if not self.derby:  # Derby makes a schema along with its first table
                c.run(f"CREATE SCHEMA IF NOT EXISTS {self.schema}")
            c.run(f"CREATE TABLE {self.schema}.{self.staging} ({types})")
        if out_of_reach(self.spark, self.url):
            with self._connect() as c:
                import_rows(c, df, self.schema, self.staging)
        else:
            df.write.mode("append").jdbc(self.url, f"{self.schema}.{self.staging}", properties=self.properties)
        with self._connect() as c:
            self.source_rows = c.value(f"SELECT COUNT(*) FROM {self.schema}.{self.staging}")

    def _name(self, column: str) -> str:
        return f'"{column}"'

    def _type(self, c: ColumnSpec) -> str:
        """The column's type; Derby, our stand-in for tests, has no text, json or zoned times."""
        if not self.derby:
            return c.ddl()
        return {"text": "varchar(32672)", "jsonb": "varchar(32672)", "timestamptz": "timestamp", "bytea": "blob", "uuid": "blob", "fixedsizebinary": "blob"}.get(c.kind, c.ddl())

    def publish(self) -> Outcome:
        from lakeferry.sources.readers import statements

        name = self._name
        cols = ", ".join(map(name, self.names))
        staging = f"{self.schema}.{self.staging}"
        with self._connect() as c:
            if self.role:
                c.run(f"SET ROLE {self.role}")
            for s in statements(self.pre or ""):
                c.run(s)
            there = c.tables(self.schema)
            exists = self.table.lower() in there
            if self.strategy == "drop_replace":
                if exists:
                    c.run(f"DROP TABLE {self.target}")
                c.run(f"RENAME TABLE {staging} TO {self.table}" if self.derby else f"ALTER TABLE {staging} RENAME TO {self.table}")
            else:
                if not exists:
                    c.run(f"CREATE TABLE {self.target} AS SELECT * FROM {staging} WITH NO DATA")
                if self.strategy == "truncate_insert":
                    c.run(f"DELETE FROM {self.target}" if self.derby else f"TRUNCATE TABLE {self.target}")
                elif self.strategy == "delete_insert":
                    c.run(f"DELETE FROM {self.target} WHERE " + " AND ".join(f"{name(k)} = ?" for k in self.values), list(self.values.values()))
                else:
                    indexed = self._indexed(c) if self.derby else None
                    on = " AND ".join(f"t.{name(k)} = s.{name(k)}" for k in self.keys)
                    keys = ", ".join(f"s.{name(k)}" for k in self.keys)
                    if c.value(f"SELECT 1 FROM {staging} s WHERE EXISTS (SELECT 1 FROM {self.target} t WHERE {on}) GROUP BY {keys} HAVING COUNT(*) > 1") is not None:
                        raise ValueError("a target row is matched by more than one source row")
                    others = ", ".join(f"{name(n)} = s.{name(n)}" for n in self.names if n not in self.keys)
                    values = ", ".join(f"s.{name(n)}" for n in self.names)
                    # In place: columns that the source lacks keep what they hold, and rows of the target stay the same rows.
                    matched = f" WHEN MATCHED THEN UPDATE SET {others}" if others else ""
                    c.run(f"MERGE INTO {self.target} AS t USING {staging} AS s ON {on}{matched} WHEN NOT MATCHED THEN INSERT ({cols}) VALUES ({values})")
                    if indexed:
                        c.run(f"DROP INDEX {self.schema}.{indexed}")
                if self.strategy != "merge":
                    c.run(f"INSERT INTO {self.target} ({cols}) SELECT {cols} FROM {staging}")
                c.run(f"DROP TABLE {staging}")
            for s in statements(self.post or ""):
                c.run(s)
        return Outcome(self.kind, self.target, commit={"strategy": self.strategy})

    def _indexed(self, c: Connection) -> str | None:
        """An index of the target's keys for this transaction, as Derby compares all pairs of rows without one. None if there is one already
        (Derby only warns then) or keys are too long for it."""
        own = f"{self.staging}_k".upper()
        try:
            c.run(f"CREATE INDEX {self.schema}.{own} ON {self.target} ({', '.join(map(self._name, self.keys))})")
        except Exception:
            return None
        return own if c.value(f"SELECT CONGLOMERATENAME FROM SYS.SYSCONGLOMERATES WHERE CONGLOMERATENAME = '{own}'") else None

    def abort(self) -> None:
        with self._connect() as c:
            if self.staging.lower() in c.tables(self.schema):
                c.run(f"DROP TABLE {self.schema}.{self.staging}")
