"""Streams over files: windows with watermarks, de-duplication, keyed state."""

import datetime as dt

import pytest

from lakeloom.operators import relational
from lakeloom.operators.layout import zorder_key
from lakeloom.streaming import windows


@pytest.fixture
def folder(spark, tmp_path):
    """Two files: events in order, then a later one with a late row and a repeat."""
    t = dt.datetime(2024, 1, 1)
    kind = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    first = [(k, t + dt.timedelta(minutes=20 * k), k % 2, "view", float(k)) for k in range(12)]
    second = [(100, t + dt.timedelta(days=1), 0, "view", 1.0), (3, t + dt.timedelta(minutes=60), 1, "view", 3.0)]
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/s{n}")
        next((tmp_path / f"s{n}").glob("part*")).rename(tmp_path / f"{n}.parquet")
    import os
    import time

    os.utime(tmp_path / "0.parquet", (time.time() - 100,) * 2)
    return str(tmp_path), spark.read.parquet(f"{tmp_path}/*.parquet").schema


def stream(spark, folder):
    path, schema = folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "?.parquet").parquet(path)


def test_tumbling_windows_of_a_stream(spark, folder):
    got = windows.drained(windows.tumbling(stream(spark, folder)), f"file://{folder[0]}/out").collect()
    # the watermark that drops late rows is that of the batch before: the row of 01:00 still counts; the last window is open
    assert sorted((r.start.hour, r.n) for r in got) == [(0, 3), (1, 4), (2, 3), (3, 3)]


def test_duplicates_within_the_watermark(spark, folder):
    path, _ = folder
    rows = spark.read.parquet(f"{path}/0.parquet", f"{path}/1.parquet")
    assert windows.deduplicated(rows).count() == 13


def test_running_totals(spark, folder):
    got = windows.drained(windows.running_totals(stream(spark, folder)), f"file://{folder[0]}/out", "update").collect()
    best = {}
    for r in got:
        best[r.user_id] = max(best.get(r.user_id, (0, 0.0)), (r.n, r.total))
    assert best == {0: (7, 31.0), 1: (7, 39.0)}


def test_ties_with_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 5), (4, 7)], "k int, v int")
    ks = lambda d: sorted(r.k for r in d.collect())
    assert ks(relational.with_ties(df, "v", 1)) == [1, 3] and ks(relational.with_ties(df, "v", 4)) == [1, 2, 3, 4]
    assert ks(relational.with_ties(df, "v", 1, True)) == [2] and ks(relational.with_ties(df, "v", 2, True)) == [2, 4]
    assert ks(relational.with_ties(df, "v", 0)) == [] and ks(relational.with_ties(df.limit(0), "v", 3)) == []


def test_zorder_keeps_neighbours_together(spark):
    df = spark.range(0, 1024).selectExpr("id % 32 AS x", "id div 32 AS y")
    rows = df.withColumn("z", zorder_key(df, ["x", "y"])).orderBy("z").collect()
    block = rows[: len(rows) // 4]
    assert (max(r.x for r in block) + 1) * (max(r.y for r in block) + 1) < 0.6 * len(rows)
