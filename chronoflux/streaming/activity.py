"""Streams of events: activity counts, densities, first copies, matches.

Each takes a streaming or a batch DataFrame with a timestamp column; the batch run is
what the stream must equal.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def source(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet file or folder ``path`` as a stream of its own schema; zone-less ``ts`` is read in the session's zone.

    A stream takes a single file only by a pattern, so the last letter is one.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def activity(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """``track_id, start, n``: events in tumbling (``slide``: sliding) windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late).groupBy(F.col("event_type").alias("track_id"), window.alias("w"))
    return rows.agg(F.count("*").alias("n")).select("track_id", F.col("w.start").alias("start"), "n")


def first_copies(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of rows with equal ``keys`` that come within ``late`` of each other."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def matches(left: DataFrame, right: DataFrame, key: str, tol: str, late: str = "1 hour") -> DataFrame:
    """``id, other_id``: events of both streams with one key, at most ``tol`` apart."""
    a = left.withWatermark("ts", late).select(F.col(key).alias("k"), F.col("event_id").alias("id"), "ts")
    b = right.withWatermark("ts", late).select(F.col(key).alias("other_k"), F.col("event_id").alias("other_id"), F.col("ts").alias("other_ts"))
    near = F.expr(f"k = other_k AND ts >= other_ts - INTERVAL {tol} AND ts <= other_ts + INTERVAL {tol}")
    return a.join(b, near).select("id", "other_id")


class Sessions(StatefulProcessor):
    """A session a key, ``start, last, n`` in microseconds; told when the next begins or its timer is up."""

    def __init__(self, gap: int, longest: int) -> None:
        self.gap, self.longest = gap, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "start long, last long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        start, last, n = self.session.get() if self.session.exists() else (0, 0, 0)
        timer, done = last + self.gap, []
        for us in sorted(int(x) for frame in rows for x in frame["us"]):
            if n and us < start - self.gap:  # a late row too far before the open session is one of its own
                done.append((us, 1))
                continue
            if n and us >= last and (us - last > self.gap or us - start > self.longest):
                done.append((start, n))
                n = 0
            start, last, n = (min(start, us), max(last, us), n + 1) if n else (us, us, 1)
        if self.session.exists():
            self.handle.deleteTimer(timer // 1000 + 1)
        self.session.update((start, last, n))
        self.handle.registerTimer((last + self.gap) // 1000 + 1)
        yield self._told(key, done)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        start, _, n = self.session.get()
        self.session.clear()
        yield self._told(key, [(start, n)])

    def _told(self, key: tuple, done: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"track_id": [key[0]] * len(done), "start": [x[0] / 1e6 for x in done], "n": [x[1] for x in done]}).astype({"track_id": "int64", "start": "float64", "n": "int64"})

    def close(self) -> None:
        pass


def capped_sessions(events: DataFrame, gap: float, longest: float, late: str = "1 hour") -> DataFrame:
    """``track_id, start, n``: sessions that end after ``gap`` seconds of silence or ``longest`` seconds from their start.

    Keyed state with a timer per open session, in microseconds; it is told when the
    next one begins, or once the watermark is past its gap.  Rows of one batch are
    taken in order of time.  A row of a later batch from before the last one counts in
    the open session if it is no more than ``gap`` before its start, else it is a
    session of its own: what has been told stays.  Needs the RocksDB state store, which
    is set for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.withWatermark("ts", late).select("track_id", "ts", F.unix_micros("ts").alias("us"))
    keyed = rows.groupBy(F.col("track_id").cast("long").alias("track_id"))
    return keyed.transformWithStateInPandas(Sessions(round(gap * 1e6), round(longest * 1e6)), "track_id long, start double, n long", "Append", "EventTime")


def on_beats(events: DataFrame, beats: DataFrame, width: float) -> DataFrame:
    """Events with ``beat``, the last stored beat at or before their ``t``: a stream joined to a static table by cells of ``width``.

    Each stored beat is copied to the cells up to the next one, so a stream row meets
    the one beat of its cell that holds it, without any state.
    """
    after = F.lead("t").over(Window.partitionBy("track_id").orderBy("t"))
    spans = beats.select("track_id", F.col("t").alias("beat"), F.coalesce(after, F.col("t") + width).alias("next"))
    cells = spans.select("track_id", "beat", "next", F.explode(F.sequence(F.floor(F.col("beat") / width), F.floor(F.col("next") / width))).alias("cell"))
    inside = (F.col("t") >= F.col("beat")) & (F.col("t") < F.col("next"))
    return events.withColumn("cell", F.floor(F.col("t") / width)).join(cells, ["track_id", "cell"]).where(inside).drop("cell", "next")


def _home(spark: SparkSession) -> str:
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not home:
        home = tempfile.mkdtemp(prefix="spark-") if spark.sparkContext.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_streams"
    return f"{home}/stream-{uuid.uuid4().hex}"


def split_late(events: DataFrame, late: str) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and those more than ``late`` behind the newest of their batch or any before: a side table, not lost."""
    spark, path, seconds = events.sparkSession, _home(events.sparkSession), F.expr(f"INTERVAL {late}")

    def write(batch: DataFrame, n: int) -> None:
        top = batch.agg(F.max("ts").alias("top"))
        seen = spark.read.schema("top timestamp").parquet(f"{path}/tops/*") if n else top
        edge = F.broadcast(top.unionByName(seen).agg(F.max("top").alias("edge")))  # one row
        rows = batch.join(edge).withColumn("late", F.col("ts") < F.col("edge") - seconds).drop("edge")
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        top.write.mode("overwrite").parquet(f"{path}/tops/{n}")

    events.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(_with_late(events)).parquet(f"{path}/rows")
    return rows.where("NOT late").drop("late"), rows.where("late").drop("late")


def _with_late(events: DataFrame) -> str:
    return ", ".join(f"`{n}` {k}" for n, k in [*events.dtypes, ("late", "boolean")])


#: Parts of an upserted table.
BUCKETS = 16


def upserted(events: DataFrame, keys: list[str], newest: str, path: str | None = None) -> DataFrame:
    """The newest row of every key over all batches; of rows as new as each other the greatest, column by column.

    The table is kept in ``BUCKETS`` parts by a hash of the keys.  A batch rewrites the
    parts it has rows for, as a version numbered like the batch, and then says so in a
    log: readers take the latest version of each part that the log names.  So a batch
    that is run again after a failure gives the same table, and with the same ``path`` a
    new run goes on where the last one stopped.
    """
    spark, path = events.sparkSession, path or _home(events.sparkSession)
    rest = F.struct(*[F.col(c) for c in events.columns if c not in (*keys, newest)])
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(newest), rest.desc())

    def write(batch: DataFrame, n: int) -> None:
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        touched = {r["bucket"] for r in dealt.select("bucket").distinct().collect()}  # BUCKETS at most
        versions = {b: v for b, v in _versions(spark, path, n).items() if b in touched}
        old = _parts(spark, path, batch, versions).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        rows = old.unionByName(dealt).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        rows.withColumn("version", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{path}/parts")
        spark.createDataFrame([(b, n) for b in sorted(touched)], "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/log/batch={n}")

    events.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return _parts(spark, path, events, _versions(spark, path, None))


def _versions(spark: SparkSession, path: str, before: int | None) -> dict[int, int]:
    """Latest version of each part in the log, of batches before ``before`` if given."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return {}
    rows = spark.read.schema("bucket int, version long, batch long").parquet(f"{path}/log")
    rows = rows if before is None else rows.where(F.col("version") < before)
    return {r["bucket"]: r["v"] for r in rows.groupBy("bucket").agg(F.max("version").alias("v")).collect()}  # BUCKETS at most


def _parts(spark: SparkSession, path: str, like: DataFrame, versions: dict[int, int]) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], like.schema)
    chosen = F.lit(False)
    for bucket, version in versions.items():
        chosen = chosen | ((F.col("bucket") == bucket) & (F.col("version") == version))  # prunes folders
    schema = ", ".join(f"`{n}` {k}" for n, k in [*like.dtypes, ("bucket", "int"), ("version", "bigint")])
    return spark.read.schema(schema).parquet(f"{path}/parts").where(chosen).select(*like.columns)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run ``stream`` over all that is there now and read its result.

    Result and checkpoint are in the folder that ``spark.checkpoint.dir`` names (one
    of our own only where it is unset).  ``complete`` replaces the result a batch.
    """
    spark = stream.sparkSession
    path = _home(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/rows"))
    else:
        writer = writer.format("parquet").option("path", f"{path}/rows")
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
