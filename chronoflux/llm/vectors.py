"""What the two vector searches share: clean vectors, samples, cells cut into blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a cell and queries to it that meet at once, and queries where a solver takes them in steps.
ROWS, ASKED, STEPPED = 4096, 1024, 16_384
#: Most of a sample that comes to the driver.
SAMPLE_MB = 64


def clean(df: DataFrame, zero: bool = True) -> DataFrame:
    """``(row, vec_id, v array<double>)`` of vectors without null or non-finite components."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & (F.size("v") > 0))
    return rows if zero else rows.where(F.exists(v, lambda x: x != 0))


def queries(rows: DataFrame, every: int) -> DataFrame:
    """``(vec_id, v)`` of rows with vec_id divisible by ``every``; of one id with several vectors the least."""
    return rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))


def sample(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """At most ``n`` different vectors and ``SAMPLE_MB`` of them, the same for the same rows: least hashes of the ids."""
    one = rows.select(F.size("v").alias("d")).first()
    if one is None:
        return np.empty((0, 0))
    n = max(1, min(n, (SAMPLE_MB << 20) // (8 * one["d"])))
    got = rows.select("v", F.xxhash64("vec_id", F.lit(seed)).alias("r"), "vec_id").orderBy("r", "vec_id").limit(n).select("v").toArrow()
    return np.unique(matrix(got.column(0).combine_chunks()).astype(float), axis=0)


def matrix(column: pa.ListArray) -> np.ndarray:
    values, offsets = common.flat(column)
    return values.reshape(len(offsets) - 1, -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def meet(rows: DataFrame, asked: DataFrame, solve: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]], score_type: str) -> DataFrame:
    """Solve every (cell, query) locally: ``(query_id, row, vec_id, score)``.

    ``rows(cell, row, vec_id, v)`` are the data, ``asked(cell, vec_id, v)`` the queries
    a cell gets; ``solve(q, qv, ids, v)`` gives places in both and scores.  What columns
    both have besides follow as pairs (of the queries, of the rows), and then ``solve``
    takes its queries in steps.  A cell of more than ``ROWS`` rows is cut into blocks by
    hash, its queries likewise, and each pair of blocks is a group: none is unbounded.
    """
    more = [c for c in asked.columns if c not in ("cell", "vec_id", "v")]
    most = STEPPED if more else ASKED
    sizes = common.written(rows.groupBy("cell").agg(F.count("*").alias("n")).join(asked.groupBy("cell").agg(F.count("*").alias("q")), "cell").select("cell", F.ceil(F.col("n") / ROWS).cast("int").alias("rb"), F.ceil(F.col("q") / most).cast("int").alias("qb")), "cells")

    def dealt(df: DataFrame, own: str, other: str, query: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("row"), F.col(own)).cast("int")
        df = df.join(sizes, "cell").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        r, q = ("other", "own") if query else ("own", "other")
        return df.select("row", "vec_id", "v", F.lit(query).alias("query"), F.xxhash64("cell", r, q).alias("group"), *more)

    both = dealt(rows, "rb", "qb", False).unionByName(dealt(asked.withColumn("row", F.col("vec_id")), "qb", "rb", True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.whole_groups(batches, 4):
            row, ids, query, group = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_numpy()
            v = matrix(part.column(2).combine_chunks())
            at = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            others = [part.column(5 + n).to_numpy() for n in range(len(more))]
            out = []
            for s, e in zip(at[:-1], at[1:], strict=True):
                q = query[s:e]
                if q.any() and not q.all():
                    i, j, score = solve(ids[s:e][q], v[s:e][q], ids[s:e][~q], v[s:e][~q], *[(x[s:e][q], x[s:e][~q]) for x in others])
                    out.append((ids[s:e][q][i], row[s:e][~q][j], ids[s:e][~q][j], score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "row", "vec_id", "score"])

    return common.sorted_groups(both, "group").mapInArrow(run, f"query_id long, row long, vec_id long, score {score_type}")


def best(score: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the ``k`` greatest scores of each query, ties to smaller ids, rows of its own id left out."""
    order = np.argsort(ids, kind="stable")
    ids, score = ids[order], score[:, order]
    least = -(1 << 62) if score.dtype.kind == "i" else -np.inf
    score = np.where(ids[None, :] == q[:, None], least, score)
    if k + 1 < len(ids):  # keep all that tie with the k-th
        edge = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero((score >= edge[:, None]) & (score > least))
    else:
        i, j = np.nonzero(score > least)
    by = np.lexsort((ids[j], -score[i, j], i))
    i, j = i[by], j[by]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    i, j = i[rank < k], j[rank < k]
    return i, order[j], score[i, j]


def ranked(found: DataFrame, k: int, ascending: bool) -> DataFrame:
    score = F.col("score").asc() if ascending else F.col("score").desc()
    w = Window.partitionBy("query_id").orderBy(score, "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
