"""Exact top-k by inner product: a Voronoi join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors


#: Rings of a cell: rows by distance to their pivot, each ring with a bound of its own.
RINGS = 8
#: Rows or queries that meet all pivots or a cell at once.
STEP = 128
#: No bound: below any score.
NONE = -(1 << 62)


def top_k(df: DataFrame, k: int = 5, every: int = 50, pivots: int = 1024, first: int = 2, seed: int = 11) -> DataFrame:
    """Each query's ``k`` highest integer inner products, exactly.

    Components become floor(256 x).  A bounded sample gives the pivots, at most
    ``pivots`` and about the square root of the rows; every row belongs to the cell
    of its nearest one and to a ring of it.  A ring's summary is its greatest
    distance r to the pivot p and its greatest length, so it holds nothing above
    min(q.p + |q| r, |q| length).  A query first meets the ``first`` cells with the
    highest q.p, and the k-th score there is a bound; it is sent once to each cell
    with rings that may reach it, as a mask of these, and only scores that reach it
    come back.  Groups of (cell block, query block) are solved locally and merged.
    A task holds a group and ``STEP`` queries against all pivots, whatever the input;
    where no bound prunes, queries sent grow as rows times pivots.

    Queries are rows with vec_id divisible by ``every`` (of one id with several
    vectors the least), candidates all rows but those of the query's id; fewer than
    ``k`` candidates: all.  Ties go to the smaller vec_id; repeated rows are
    candidates each.  Vectors that are null, empty or hold null or non-finite
    components take no part; all must have one length, or the query fails.  An empty
    table gives no rows.
    """
    return vectors.ranked(_pairs(df, k, every, pivots, first, seed), k, False)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``STEP`` rows: what is made of them is many times as wide."""
    return (batch.slice(at, STEP) for batch in batches for at in range(0, batch.num_rows, STEP))


def _pairs(df: DataFrame, k: int, every: int, pivots: int, first: int, seed: int) -> DataFrame:
    spark = df.sparkSession
    rows = vectors.clean(df).withColumn("v", F.transform("v", lambda x: F.floor(x * 256)))
    rows = common.written(rows, "vectors")
    one = rows.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.max(F.size("v")).alias("d"), F.count("*").alias("n")).first()
    kind = "smallint" if (one["most"] or 0) < 1 << 15 else "long"
    rows = rows.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    pivot = vectors.sample(rows, min(pivots, max(16, int(one["n"] ** 0.5))), seed)
    if not len(pivot):
        return spark.createDataFrame([], "query_id long, row long, vec_id long, score long")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            v = vectors.matrix(part.column(2)).astype(float)
            d = vectors.squared(v, pivot)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *part.columns, pa.array(np.sqrt(d[np.arange(len(v)), cell]) + 1e-3), pa.array(np.sqrt((v * v).sum(1)) + 1e-3)], ["pivot", "row", "vec_id", "v", "away", "size"])

    rows = common.written(rows.mapInArrow(nearest, f"pivot int, row long, vec_id long, v array<{kind}>, away double, size double"), "voronoi")
    widest = np.full(len(pivot), -1.0)
    for r in rows.groupBy("pivot").agg(F.max("away").alias("r")).collect():  # a row per pivot
        widest[r["pivot"]] = r["r"]
    step = F.element_at(F.array(*[F.lit(float(max(w, 1e-3) / RINGS)) for w in widest]), F.col("pivot") + 1)
    ringed = rows.withColumn("ring", F.least(F.floor(F.col("away") / step), F.lit(RINGS - 1)).cast("int")).withColumn("cell", F.col("pivot") * RINGS + F.col("ring"))
    radius, length = np.full(len(pivot) * RINGS, -1.0), np.zeros(len(pivot) * RINGS)
    for r in ringed.groupBy("cell").agg(F.max("away").alias("r"), F.max("size").alias("s")).collect():  # RINGS rows a pivot
        radius[r["cell"]], length[r["cell"]] = r["r"], r["s"]
    radius, length = radius.reshape(-1, RINGS), length.reshape(-1, RINGS)
    data = ringed.select(F.col("pivot").alias("cell"), "row", "vec_id", "v", F.col("ring").alias("rings"), F.lit(NONE).alias("bound"))
    asked = common.written(vectors.queries(rows, every), "queries")
    live = np.flatnonzero(widest >= 0)

    def homes(v: np.ndarray) -> np.ndarray:
        """Pivots of a query's first cells."""
        return live[np.argsort(-(v @ pivot[live].T), axis=1, kind="stable")[:, :first]]

    def to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            cells = homes(vectors.matrix(part.column(1)).astype(float))
            i = np.repeat(np.arange(len(cells)), cells.shape[1])
            full = np.full(len(i), (1 << RINGS) - 1, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), *(c.take(pa.array(i)) for c in part.columns[:2]), pa.array(full), pa.array(np.full(len(i), NONE))], ["cell", "vec_id", "v", "rings", "bound"])

    def solve(q: np.ndarray, qv: np.ndarray, ids: np.ndarray, v: np.ndarray, rings: tuple[np.ndarray, np.ndarray], bound: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        exact = max(abs(int(e)) for x in (qv, v) for e in (x.min(), x.max())) < 1e6 and v.shape[1] < 9000  # sums below 2^53
        v, found = v.astype(float if exact else np.int64), []
        for mask in np.unique(rings[0]).tolist():
            all_q, to = np.flatnonzero(rings[0] == mask), np.flatnonzero(mask >> rings[1] & 1)
            x, their = v[to].T, ids[to]
            for at in range(0, len(all_q), STEP):
                own = all_q[at : at + STEP]
                score, least = qv[own].astype(v.dtype) @ x, bound[0][own]
                score = np.rint(score).astype(np.int64) if exact else score
                some = np.flatnonzero((score >= least[:, None]).any(0))
                i, j, s = vectors.best(score[:, some], q[own], their[some], k)
                keep = s >= least[i]
                found.append((own[i[keep]], to[some[j[keep]]], s[keep]))
        return tuple(np.concatenate(f) for f in zip(*found, strict=True))

    schema = f"cell int, vec_id long, v array<{kind}>, rings int, bound long"
    home = common.written(vectors.meet(data, asked.mapInArrow(to_first, schema), solve, "long"), "home")
    bound = vectors.ranked(home, k, False).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = asked.join(bound, "vec_id", "left").select("vec_id", "v", F.coalesce("bound", F.lit(NONE)).alias("bound"))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            v, bound = vectors.matrix(part.column(1)).astype(float), part.column(2).to_numpy()
            size = np.sqrt((v * v).sum(1))[:, None, None]
            reach = (np.minimum((v @ pivot.T)[:, :, None] + size * radius, size * length) + 1e-3 >= bound[:, None, None]) & (radius >= 0)
            reach[np.arange(len(v))[:, None], homes(v)] = False
            rings = (reach << np.arange(RINGS)).sum(2).astype(np.int32)
            i, j = np.nonzero(rings)
            yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), *(c.take(pa.array(i)) for c in part.columns[:2]), pa.array(rings[i, j]), pa.array(bound[i])], ["cell", "vec_id", "v", "rings", "bound"])

    others = bounded.mapInArrow(replicate, schema)
    return home.unionByName(vectors.meet(data, others, solve, "long"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"))
