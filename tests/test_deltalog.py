import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeferry.deltalog import vectors
from lakeferry.deltalog.log import Conflict, LogError, TableLog, interval_ms
from lakeferry.deltalog.table import Table, Txn
from lakeferry.deltalog.vacuum import VacuumError, vacuum
from lakeferry.functions.types import from_schema
from lakeferry.operators.strategies import MergeError


def rows(spark, ids, offset=0, base=1767225600):
    ids = list(ids)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(2)
    return df.select("id", (F.col("id") + offset).alias("value"), F.format_string("row-%06d", "id").alias("name"), F.timestamp_seconds(F.lit(base) + F.col("id") * 60).alias("updated_at"))


def held(t):
    return sorted((r.id, r.value) for r in t.read().collect())


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 1 << 40)) | st.sets(st.integers(0, 200_000)))
def test_vectors_round_trip(x):
    own = np.array(sorted(x), np.int64)
    assert vectors.decode(vectors.encode(own)).tolist() == own.tolist()


def test_vectors_format():
    dense = np.arange(0, 70_000)
    assert vectors.decode(vectors.encode(dense)).tolist() == dense.tolist()
    data = vectors.encode(np.array([1, 2, 5]))
    assert int.from_bytes(data[:4], "little") == 1681511377 and int.from_bytes(data[4:12], "little") == 1 and int.from_bytes(data[16:20], "little") == 12346
    assert vectors.unz85(vectors.z85(bytes(range(16)))) == bytes(range(16))
    assert vectors.z85(bytes.fromhex("864FD26FB559F75B")) == "HelloWorld"


def test_merge_matrix(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    s = t.merge(rows(spark, range(1, 1001)), ["id"])
    assert (s.matched_rows, s.inserted_rows) == (0, 1000)
    s = t.merge(rows(spark, range(501, 1501), 10_000), ["id"])
    assert (s.matched_rows, s.inserted_rows) == (500, 500)
    assert held(t) == [(i, i if i <= 500 else i + 10_000) for i in range(1, 1501)]
    s = t.merge(rows(spark, range(1, 1501), 5), ["id", "name"])
    assert (s.matched_rows, s.inserted_rows) == (1500, 0) and held(t) == [(i, i + 5) for i in range(1, 1501)]
    s = t.merge(rows(spark, range(1000, 1002), 7), ["updated_at"])
    assert (s.matched_rows, s.inserted_rows) == (2, 0)
    s = t.merge(rows(spark, [3, 3], 9), ["name"])
    assert s.matched_rows == 1 and sum(i == 3 for i, _ in held(t)) == 2
    assert t.merge(rows(spark, []), ["id"]).source_rows == 0


def test_vectors_in_the_log_and_beside_it(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.overwrite(rows(spark, range(1, 2001)).coalesce(1))
    t.merge(rows(spark, range(100, 110), 1), ["id"])
    t.merge(rows(spark, range(200, 210), 1), ["id"])
    dv = [a["deletionVector"] for a in t.log.snapshot().files.values() if a.get("deletionVector")]
    assert [(d["storageType"], d["cardinality"]) for d in dv] == [("i", 20)]
    t.merge(rows(spark, range(2, 2001, 2), 3), ["id"])
    dv = [a["deletionVector"] for a in t.log.snapshot().files.values() if a.get("deletionVector") and a["deletionVector"]["storageType"] == "u"]
    assert len(dv) == 1 and dv[0]["offset"] == 1 and dv[0]["cardinality"] == 1010
    assert held(t) == [(i, i + 3 if i % 2 == 0 else i + 1 if 100 <= i < 110 or 200 <= i < 210 else i) for i in range(1, 2001)]
    actions = t.log.actions(t.log.snapshot().version)
    assert any(a.get("remove", {}).get("deletionVector", {}).get("storageType") == "i" for a in actions)
    assert "deletionVectors" in t.log.snapshot().protocol["readerFeatures"]
    t.overwrite(rows(spark, [1]))
    assert held(t) == [(1, 1)] and "deletionVectors" in t.log.snapshot().protocol["readerFeatures"]


def test_partition_columns(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    df = spark.range(100).select("id", F.when(F.col("id") % 4 != 3, F.concat(F.lit("p/ä="), F.col("id") % 4)).alias("p"), F.lit("old").alias("v"))
    t.log.create(from_schema(df.schema), ["p"])
    t.overwrite(df.repartition(3))
    adds = t.log.snapshot().files.values()
    assert {a["partitionValues"]["p"] for a in adds} == {"p/ä=0", "p/ä=1", "p/ä=2", None} and all("p" not in json.loads(a["stats"])["minValues"] for a in adds)
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    s = t.merge(spark.createDataFrame([(1, "p/ä=1", "new"), (2, "p/ä=1", "new"), (200, "q", "new")], df.schema), ["p", "id"])
    assert (s.matched_rows, s.inserted_rows) == (1, 2) and t.read().count() == 102
    assert sorted((r.id, r.p) for r in t.read().where("v = 'new'").collect()) == [(1, "p/ä=1"), (2, "p/ä=1"), (200, "q")]
    t.merge(spark.createDataFrame([(3, None, "none")], df.schema), ["p"], allow_null_keys=True)
    assert t.read().where("p is null").count() == 1 and t.read().count() == 102 - 25 + 1
    with pytest.raises(MergeError, match="partitioned by 'p'"):
        t.overwrite(df.drop("p"))


@pytest.mark.parametrize("key", ["id", "cast(id as decimal(20,3))", "timestamp_seconds(id * 7) + interval 123456 microseconds", "cast(timestamp_seconds(id) as timestamp_ntz)", "cast(id as string)", "date_add(date '2001-01-01', cast(id as int))", "cast(id as double)"])
def test_files_are_pruned_whatever_the_key(spark, tmp_path, key):
    t = Table(spark, str(tmp_path / "t"))
    own = spark.range(1000, 2000).selectExpr(f"{key} as k", "id as v")
    t.overwrite(own.repartitionByRange(8, "k"))
    some = own.where("v between 1010 and 1020").withColumn("v", -F.col("v"))
    staged = t.stage_merge(some.coalesce(1), ["k"])
    assert len(t.candidates(t.log.snapshot(), staged.adds, ["k"])) == 1
    s = t.commit_merge(staged)
    assert s.matched_rows == 11 and t.read().count() == 1000 and t.read().where("v < 0").count() == 11


def test_the_source_runs_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def passed(rows):
        for b in rows:
            seen.add(b.num_rows)
            yield b

    df = spark.range(100).withColumn("w", F.col("id")).mapInArrow(passed, "id long, w long")
    t = Table(spark, str(tmp_path / "t"))
    t.merge(df, ["id"], txn=Txn("a", watermark_column="w"))
    assert seen.value == 100
    assert t.merge(df, ["id"], txn=Txn("a", watermark_column="w")).skipped and seen.value == 200
    t.stage(df, max_bytes=200)
    assert seen.value == 300


def test_idempotency(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    assert not t.merge(rows(spark, range(10)), ["id"], txn=Txn("a", watermark_column="updated_at")).skipped
    version = t.log.snapshot().version
    s = t.merge(rows(spark, range(10)), ["id"], txn=Txn("a", watermark_column="updated_at"))
    assert s.skipped and s.skipped_version == (1767225600 + 9 * 60) * 10**6 and t.log.snapshot().version == version
    for v, skipped in ((5, False), (5, True), (6, False)):
        assert t.merge(rows(spark, range(3)), ["id"], txn=Txn("b", batch_version=v)).skipped == skipped
    assert len(list((tmp_path / "t").glob("load-*/*.parquet"))) == len(t.log.snapshot().files)


def test_null_keys(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.merge(rows(spark, range(1, 101)), ["id"])
    before = sorted(p.name for p in (tmp_path / "t").iterdir())
    bad = rows(spark, [1, 3]).union(rows(spark, [2]).withColumn("id", F.lit(None).cast("long")))
    with pytest.raises(MergeError, match="null"):
        t.merge(bad, ["id"])
    with pytest.raises(MergeError, match="unknown key"):
        t.merge(bad, ["nope"])
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == before
    t.merge(bad, ["id"], allow_null_keys=True)
    assert t.merge(bad, ["id"], allow_null_keys=True).matched_rows == 3 and t.read().count() == 101


def test_checkpoint_and_properties(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.overwrite(rows(spark, range(100)))
    own = t.log.snapshot()
    meta = own.metadata | {"configuration": {"x": "y"}}
    t.log.commit(own.version + 1, [{"metaData": meta}])
    for k in range(10):
        t.merge(rows(spark, range(100 + 10 * k, 110 + 10 * k)).coalesce(1), ["id"])
    assert json.loads((tmp_path / "t/_delta_log/_last_checkpoint").read_text())["version"] == 10
    for v in range(10):
        (tmp_path / f"t/_delta_log/{v:020d}.json").unlink()
    again = Table(spark, str(tmp_path / "t"))
    assert held(again) == [(i, i) for i in range(200)]
    again.overwrite(rows(spark, []))
    assert again.read().count() == 0 and again.log.snapshot().configuration["x"] == "y" and again.log.snapshot().metadata["id"] == meta["id"]


def test_one_writer_wins(spark, tmp_path):
    log = TableLog(spark, str(tmp_path / "t"))
    log.commit(0, [{"x": 1}])
    with pytest.raises(Conflict):
        log.commit(0, [{"x": 2}])
    t = Table(spark, str(tmp_path / "u"))
    t.overwrite(rows(spark, range(10)))
    commit, tried = t.log.commit, []

    def late(version, actions):
        if not tried:
            tried.append(version)
            commit(version, [{"commitInfo": {}}])
        commit(version, actions)

    t.log.commit = late
    t.merge(rows(spark, range(5, 15), 1), ["id"])
    assert held(t) == [(i, i + (i >= 5)) for i in range(15)]


def test_vacuum(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.overwrite(rows(spark, range(10)).coalesce(1))
    t.overwrite(rows(spark, range(5)).coalesce(1))
    (tmp_path / "t/stray.parquet").write_bytes(b"x")
    url = str(tmp_path / "t")
    assert vacuum(spark, url).selected == 0
    with pytest.raises(VacuumError, match="shorter"):
        vacuum(spark, url, retention="0 seconds")
    dry = vacuum(spark, url, retention="0 seconds", unchecked=True, dry_run=True)
    assert dry.selected == 2 and dry.deleted == 0
    assert vacuum(spark, url, retention="0 seconds", unchecked=True).deleted == 2
    assert held(t) == [(i, i) for i in range(5)] and not (tmp_path / "t/stray.parquet").exists()


@pytest.mark.parametrize("text,ms", [("interval 7 days", 7 * 86_400_000), ("2 weeks", 14 * 86_400_000), ("1 hour", 3_600_000), ("5 milliseconds", 5), ("INTERVAL 10 Minutes", 600_000)])
def test_intervals(text, ms):
    assert interval_ms(text) == ms


@pytest.mark.parametrize("text", ["1 month", "2 years", "-1 days", "1.5 days", "3 days ago", "days", ""])
def test_what_is_no_interval(text):
    with pytest.raises(LogError):
        interval_ms(text)


def test_checkpoints_forget_files_that_vacuum_may_delete(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    for n in (5, 6, 7):
        t.overwrite(rows(spark, range(n)).coalesce(1))
    t.log.checkpoint()
    assert len(t.log.snapshot().removed) == 2
    own = t.log.snapshot()
    t.log.commit(own.version + 1, [{"metaData": own.metadata | {"configuration": {"delta.deletedFileRetentionDuration": "interval 0 days"}}}])
    t.log.checkpoint()
    assert len(held(t)) == 7 and all(r["deletionTimestamp"] > 0 for r in t.log.snapshot().removed.values()) and len(t.log.snapshot().removed) == 0
