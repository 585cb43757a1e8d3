"""Streams against the same operator on a batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from chronoflux.streaming import activity

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def _files(spark, path, seed=1, n=80):
    r = random.Random(seed)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randrange(600)), r.randrange(3), r.choice("ab")) for i in range(n)]
    rows += rows[:10]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(path))
    return rows


def _batch(spark, path):
    return spark.read.parquet(str(path)).withColumn("ts", F.col("ts").cast("timestamp"))


def test_windows_equal_the_batch(spark, tmp_path):
    _files(spark, tmp_path / "in")
    for slide in (None, "30 minutes"):
        got = activity.drained(activity.activity(activity.source(spark, str(tmp_path / "in")), "1 hour", slide), "complete")
        assert sorted(got.collect()) == sorted(activity.activity(_batch(spark, tmp_path / "in"), "1 hour", slide).collect())


def test_first_copies_equal_the_batch(spark, tmp_path):
    _files(spark, tmp_path / "in")
    got = activity.drained(activity.first_copies(activity.source(spark, str(tmp_path / "in")), ["event_id"]), "append")
    assert sorted(r["event_id"] for r in got.collect()) == list(range(80))


def test_matches_equal_a_loop(spark, tmp_path):
    a, b = _files(spark, tmp_path / "a", 2, 30), _files(spark, tmp_path / "b", 3, 30)
    streams = [activity.source(spark, str(tmp_path / x)) for x in "ab"]
    got = activity.drained(activity.matches(*streams, "user_id", "10 MINUTES"), "append")
    want = [(x[0], y[0]) for x in a for y in b if x[2] == y[2] and abs(x[1] - y[1]) <= dt.timedelta(minutes=10)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
