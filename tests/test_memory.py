"""What tasks, workers and the driver hold grows no faster than it must."""

from pyspark.sql import functions as F

from lakeferry.operators import stats


def test_statistics_of_groups_sort_no_rows(spark):
    df = spark.range(1000).select((F.col("id") % 300).cast("string").alias("g"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("s"))
    own = stats.file_stats(df.select("g", "s"), [F.col("g").alias("name")])
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "Sort" not in plan
    got = {r.name: (r.num_records, r.null_count_s, r.min_s, r.max_s) for r in own.collect()}
    want = {}
    for k in range(1000):
        want.setdefault(str(k % 300), []).append(str(k) if k % 7 else None)
    assert got == {g: (len(v), v.count(None), min(x for x in v if x), max(x for x in v if x)) for g, v in want.items()}


def test_marks_of_a_file_are_packed_in_pieces(spark, tmp_path, monkeypatch):
    """A file's row numbers never meet in one worker: it packs a few at a time, whatever the order in which they come."""
    import numpy as np

    from lakeferry.deltalog import table as own
    from lakeferry.deltalog import vectors

    monkeypatch.setattr(own, "PACKED", 1000)
    held = np.random.default_rng(1).choice(1 << 33, 20_000, replace=False) // 7
    parts = [vectors.containers(x) for x in np.array_split(held, 7)]
    whole = {k: vectors.joined([p[k] for p in parts if k in p]) for k in {k for p in parts for k in p}}
    assert vectors.assembled(whole) == vectors.encode(held)
    t = own.Table(spark, str(tmp_path / "t"))
    t.overwrite(spark.range(200_000).coalesce(1))
    asked = []
    monkeypatch.setattr(vectors, "encode", lambda rows: asked.append(len(rows)))
    for by, n in ((3, 66_667), (2, 100_000)):
        s = t.merge(spark.range(0, 200_000, by), ["id"])
        assert (s.source_rows, s.matched_rows) == (n, n)
    assert not asked  # neither driver nor workers make vectors of a file's row numbers
    assert sorted(r.id for r in t.read().collect()) == list(range(200_000))
