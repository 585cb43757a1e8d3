"""What the operators share: words, scratch tables and row helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; one of fewer parts than there are cores is dealt out to all."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def scratch(spark: SparkSession) -> str:
    """The shared folder for checkpoints; one of our own only where none is set.

    That one is a temporary folder in local mode, where driver and executors are one
    machine, and a folder of the warehouse on a cluster.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        local = spark.sparkContext.master.startswith("local")
        path = tempfile.mkdtemp(prefix="spark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Folder of the run that is under way, if it has one of its own.
_own: ContextVar[str | None] = ContextVar("own", default=None)


@contextmanager
def own_scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside go to a folder of their own, removed at the end.

    What reads them has to be written by then; nobody else's tables are touched.
    """
    path = f"{scratch(spark)}/run-{uuid.uuid4().hex}"
    token = _own.set(path)
    try:
        yield
    finally:
        _own.reset(token)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand Python at most ``rows`` rows at once.

    A batch is held whole by the executor that writes it and by the worker that
    reads it; 10,000 long texts are 50 MB on either side of every running task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    with _set(spark, name, str(min(now, rows) if now > 0 else rows)):  # 0 and less: no limit
        yield


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder; Spark's cleaner removes it later."""
    scratch(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it again.

    Columnar and compressed, so far smaller than ``checkpoint()``.  Within
    ``own_scratch`` the table goes with its run; otherwise it stays as long as the
    cluster keeps its checkpoints.  Shuffle files of the write go with it, not when
    the driver happens to collect its garbage: nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{_own.get() or scratch(spark)}/{name}-{uuid.uuid4().hex}"
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone; null texts become empty, null ids go."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")


def whole_rows(df: DataFrame) -> DataFrame:
    """``(_row, doc_id, text, copy)``: each row with a doc_id as a struct, so no column can clash."""
    rows = df.select(F.struct("*").alias("_row")).where("_row.doc_id IS NOT NULL")
    rows = rows.select("_row", F.col("_row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("_row.text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("copy", F.unhex(F.md5("text")))


def with_text(df: DataFrame) -> list[Column]:
    """The columns of ``df`` out of ``whole_rows``, with ``text`` as it is now and ``n_chars``, if there, counted anew."""
    own = {"text": F.col("text"), **({"n_chars": F.length("text").cast(dict(df.dtypes)["n_chars"])} if "n_chars" in df.columns else {})}
    return [own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in df.columns]


def words(text: Column) -> Column:
    """Array of the words of a text."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def flat(column: pa.ListArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every (start, length), one after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def whole_groups(batches: Iterable[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches of one partition sorted by column ``key``."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if kept and kept[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield pa.Table.from_batches([*kept, batch.slice(0, last)])
            kept = []
        kept.append(batch.slice(last))
    if kept:
        yield pa.Table.from_batches(kept)


def sorted_groups(df: DataFrame, key: str) -> DataFrame:
    """Rows of a group in one partition, next to each other."""
    return df.repartition(key).sortWithinPartitions(key)


def looked_up(big: DataFrame, small: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``big`` joined to ``small``, of one row a key and in ``weight`` the rows of ``big`` with it.

    A key that holds over a thousandth of all rows is hot: no more than 1,000 are, so
    they are broadcast and none is shuffled to one task.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    hot = small.where((F.col(weight) * 1000 > total) & (F.col(weight) > 1000))
    if not hot.head(1):
        return big.join(small, keys)
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small, keys)
    return big.join(F.broadcast(hot), keys).unionByName(rest)
