"""Canonical timeline tables, derived from the driver's tables; a unit of t is ten hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: The same derivations for DuckDB.
SQL = """
onsets AS (SELECT user_id AS track_id, event_id AS id, event_type AS kind, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e10 AS t, least(1.0::DOUBLE, value / 100) AS strength,
  CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS low, least(1.0::DOUBLE, value / 100) AS mid, ((event_id * 37) % 101)::DOUBLE / 100 AS high FROM events),
ends AS (SELECT track_id, ceil(max(t))::BIGINT * 2 AS n FROM onsets GROUP BY ALL),
beats AS (SELECT track_id, i AS idx, i * 0.5::DOUBLE AS t, i // 4 + 1 AS bar, i % 4 + 1 AS beat_in_bar FROM (SELECT track_id, unnest(generate_series(0, n)) AS i FROM ends)),
hours AS (SELECT event_type AS track_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS frame, count(*)::DOUBLE AS c FROM events GROUP BY ALL),
frames AS (SELECT k.track_id, f.frame, coalesce(c, 0) AS x FROM (SELECT DISTINCT track_id FROM hours) k CROSS JOIN (SELECT unnest(generate_series(0, (SELECT max(frame) FROM hours))) AS frame) f LEFT JOIN hours h ON h.track_id = k.track_id AND h.frame = f.frame),
pulses AS (SELECT track_id, idx, t, idx // 4 + 1 AS bar, idx % 4 + 1 AS beat_in_bar FROM (SELECT track_id, t, row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS idx FROM (SELECT DISTINCT track_id, t FROM onsets WHERE kind = 'click'))),
marks AS (SELECT track_id, idx, t, idx // 4 + 1 AS bar, idx % 4 + 1 AS beat_in_bar FROM (SELECT track_id, t, row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS idx FROM (SELECT DISTINCT track_id, t FROM onsets WHERE kind = 'view'))),
spectrum AS (SELECT event_type AS track_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 36000000000 AS frame, CAST(json_extract(props, '$.k') AS INT) // 4 * 400.0::DOUBLE + 40 AS freq, sum(value) AS mag FROM events GROUP BY ALL),
segments AS (SELECT *, lead(t0) OVER (PARTITION BY track_id ORDER BY t0, id) AS t1 FROM (SELECT o_custkey AS track_id, o_orderkey AS id, epoch_us(o_orderdate) / 8.64e10 AS t0, o_orderstatus AS family, 60 + o_totalprice % 120 AS bpm FROM orders))
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``track_id, id, kind, t, strength, low, mid, high``."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    strength = F.least(F.lit(1.0), F.col("value") / 100)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (us / 3.6e10).alias("t"), strength.alias("strength"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("low"), strength.alias("mid"), ((F.col("event_id") * 37 % 101).cast("double") / 100).alias("high"))


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beat every half unit: ``track_id, idx, t, bar, beat_in_bar``."""
    ends = onsets(spark, sf_dir).groupBy("track_id").agg((F.ceil(F.max("t")) * 2).alias("n"))
    i = F.col("idx")
    return ends.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("idx")).select("track_id", "idx", (i * 0.5).alias("t"), (F.floor(i / 4) + 1).alias("bar"), (i % 4 + 1).alias("beat_in_bar"))


def grid(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Irregular beats, the events of a kind: ``track_id, idx, t, bar, beat_in_bar``."""
    times = onsets(spark, sf_dir).where(F.col("kind") == kind).select("track_id", "t").distinct()
    idx = F.row_number().over(Window.partitionBy("track_id").orderBy("t")).cast("long") - 1
    i = F.col("idx")
    return times.withColumn("idx", idx).select("track_id", "idx", "t", (F.floor(i / 4) + 1).alias("bar"), (i % 4 + 1).alias("beat_in_bar"))


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir, "click")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir, "view")


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values by ten hours and frequency, a track per event type: ``track_id, frame, freq, mag``."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("track_id"), F.floor(us / 3.6e10).alias("frame"), (F.floor(k / 4) * 400.0 + 40).alias("freq")).agg(F.sum("value").alias("mag"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events an hour, a track per event type: ``track_id, frame, x``."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    hours = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("track_id"), F.floor(us / 3.6e9).alias("frame")).agg(F.count("*").cast("double").alias("c"))
    last = F.broadcast(hours.agg(F.max("frame").alias("last")))  # one row
    every = hours.select("track_id").distinct().crossJoin(last).select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("frame"))
    return every.join(hours, ["track_id", "frame"], "left").select("track_id", "frame", F.coalesce("c", F.lit(0.0)).alias("x"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time between a customer's orders, in days: ``track_id, id, t0, family, bpm, t1``."""
    day = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)") / 8.64e10
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("id"), day.alias("t0"), F.col("o_orderstatus").alias("family"), (F.col("o_totalprice") % 120 + 60).alias("bpm"))
    return rows.withColumn("t1", F.lead("t0").over(Window.partitionBy("track_id").orderBy("t0", "id")))
