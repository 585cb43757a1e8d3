"""Approximate nearest neighbours: balanced posting lists."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors


#: Nearest lists whose farthest is the measure of a query's reach.
BASE = 9


def balanced_centroids(points: np.ndarray, n: int, rounds: int = 8, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """k-means on a bounded sample, and the price of each cluster that evens their sizes."""
    rng = np.random.default_rng(seed)
    n = min(n, len(points))
    centre = points[rng.choice(len(points), n, replace=False)]
    price = np.zeros(n)
    for turn in range(2 * rounds):  # the second half moves prices only
        d = vectors.squared(points, centre)
        cell = (d + price[None, :]).argmin(1)
        size = np.bincount(cell, minlength=n)
        price += 0.1 * d.min(1).mean() * np.clip(size * n / len(points) - 1, -1, 1)
        if turn < rounds:
            total = np.zeros_like(centre)
            np.add.at(total, cell, points)
            centre = np.where((size > 0)[:, None], total / np.maximum(size, 1)[:, None], centre)
    return centre, price


class Graph:
    """Centroids as a graph of near neighbours, searched best first."""

    def __init__(self, centre: np.ndarray, degree: int = 24) -> None:
        self.centre = centre
        near = np.argsort(vectors.squared(centre, centre), axis=1)[:, : degree + 1]
        self.edges: list[set[int]] = [set(map(int, row)) - {k} for k, row in enumerate(near)]
        for k, row in enumerate(near):  # both ways, so nothing is out of reach
            for j in row:
                self.edges[int(j)].add(k)
        self.entries = list(range(0, len(centre), max(1, len(centre) // 8)))

    def search(self, q: np.ndarray, ratio: float, width: int, sizes: np.ndarray, least: int) -> np.ndarray:
        """Centroids that the walk finds within ``ratio`` times the distance of the nearest few (the ``BASE``-th).

        Best first; it ends when what is nearest of the rest is out of reach,
        ``width`` centroids have been walked from and the lists have ``least`` postings.
        """
        away = lambda ids: np.sqrt(((self.centre[ids] - q) ** 2).sum(1)).tolist()
        seen, found, nearest = set(self.entries), [], []
        heap = list(zip(away(self.entries), self.entries, strict=True))
        heapq.heapify(heap)
        postings = 0
        while heap and (len(found) < width or heap[0][0] <= nearest[-1] * ratio or postings < least):
            d, k = heapq.heappop(heap)
            postings += sizes[k]
            bisect.insort(nearest, d)
            del nearest[BASE:]
            found.append((d, k))
            new = [j for j in self.edges[k] if j not in seen]
            seen.update(new)
            for x in zip(away(new) if new else [], new, strict=True):
                heapq.heappush(heap, x)
        found.sort()
        before = np.cumsum([0, *(sizes[k] for _, k in found[:-1])])
        return np.array([k for (d, k), n in zip(found, before, strict=True) if d <= nearest[-1] * ratio or n < least])


def posted(v: np.ndarray, centre: np.ndarray, price: np.ndarray, copies: int, boundary: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and lists of all postings: the list of least distance and price, and those at whose boundary a row is."""
    d = vectors.squared(v, centre)
    own = (d + price[None, :]).argmin(1)
    d = np.sqrt(d)
    near = np.argsort(d, axis=1)[:, :copies]
    close = np.take_along_axis(d, near, 1)
    i, j = np.nonzero((close <= close[:, :1] * boundary) & (near != own[:, None]))
    return np.concatenate([np.arange(len(v)), i]), np.concatenate([own, near[i, j]])


def fitted_ratio(points: np.ndarray, centre: np.ndarray, price: np.ndarray, copies: int, boundary: float, k: int, recall: float, asked: int = 256) -> float:
    """The ratio at which ``recall`` of the sample's own nearest neighbours are in lists that are read."""
    q = points[:: max(1, len(points) // asked)]
    d = vectors.squared(q, points)
    i, j = np.nonzero(d <= np.partition(d, min(k, len(points) - 1), axis=1)[:, [min(k, len(points) - 1)]])  # the query itself, and k
    rows, lists = posted(points, centre, price, copies, boundary)
    away = np.sqrt(vectors.squared(q, centre))
    away /= np.maximum(np.sort(away, axis=1)[:, [min(BASE, len(centre)) - 1]], 1e-12)
    order = np.argsort(rows, kind="stable")
    first = np.searchsorted(rows[order], np.arange(len(points) + 1))
    needed = [away[a, lists[order[first[b] : first[b + 1]]]].min() for a, b in zip(i.tolist(), j.tolist(), strict=True) if d[a, b] > 0]
    return float(np.quantile(needed, recall)) + 1e-9 if needed else 1.0


def search(df: DataFrame, k: int = 10, every: int = 100, lists: int = 2048, a_list: int = 16, copies: int = 2, boundary: float = 1.1, recall: float = 0.96, width: int = 32, fit: int = 16384, seed: int = 5) -> DataFrame:
    """Each query's ``k`` nearest found by Euclidean distance.

    Lists are clusters fitted on at most ``fit`` rows by k-means with prices that even
    their sizes, a list for every ``a_list`` rows of the sample, ``lists`` at most;
    every row is indexed: it is posted to the list of least squared distance plus
    price and, at a boundary, to up to ``copies`` lists whose centroid is within
    ``boundary`` times the nearest one's distance.  A query walks the graph of
    centroids in memory and reads the lists within a ratio of the nearest one's
    distance, which is fitted on the sample: the least at which ``recall`` of its own
    neighbours are read.  A long list is cut into blocks, so none is unbounded.
    Distances are exact, on the vectors.

    Queries are rows with vec_id divisible by ``every`` (of one id with several
    vectors the least), candidates all rows but those of the query's id; repeated
    rows are candidates each, ties go to the smaller vec_id.  Vectors that are null,
    zero, empty or hold null or non-finite components take no part; all must have one
    length, or the query fails.  An empty table gives no rows.
    """
    found = scored(df, k, every, lists, a_list, copies, boundary, recall, width, fit, seed)
    once = found.groupBy("query_id", "row").agg(F.first("vec_id").alias("vec_id"), F.min("score").alias("score"))
    return vectors.ranked(once, k, True)


def scored(df: DataFrame, k: int, every: int, lists: int, a_list: int, copies: int, boundary: float, recall: float, width: int, fit: int, seed: int) -> DataFrame:
    spark = df.sparkSession
    rows = common.written(vectors.clean(df, zero=False), "vectors")
    points = vectors.sample(rows, fit, seed)
    if not len(points):
        return spark.createDataFrame([], "query_id long, row long, vec_id long, score double")
    centre, price = balanced_centroids(points, min(lists, 1 + len(points) // a_list))
    ratio = fitted_ratio(points, centre, price, copies, boundary, k, recall)
    graph = spark.sparkContext.broadcast(Graph(centre))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                i, j = posted(vectors.matrix(part.column(2)), graph.value.centre, price, copies, boundary)
                yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), *(c.take(pa.array(i)) for c in part.columns)], ["cell", "row", "vec_id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [graph.value.search(q, ratio, width, sizes, (copies + 1) * (k + 1)) for q in vectors.matrix(batch.column(1))] if batch.num_rows else []
            take = pa.array(np.repeat(np.arange(len(cells)), [len(c) for c in cells]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, int), *cells]).astype(np.int32)), *(c.take(take) for c in batch.columns)], ["cell", "vec_id", "v"])

    def solve(q: np.ndarray, qv: np.ndarray, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, _ = vectors.best(-vectors.squared(qv, v), q, ids, 2 * k)  # rounding may swap neighbours
        gap = qv[i] - v[j]
        return i, j, np.sqrt((gap * gap).sum(1))

    data = common.written(rows.mapInArrow(post, "cell int, row long, vec_id long, v array<double>"), "posted")
    sizes = np.zeros(len(centre), np.int64)
    for r in data.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row per list
        sizes[r["cell"]] = r["n"]
    asked = common.written(vectors.queries(rows, every).mapInArrow(ask, "cell int, vec_id long, v array<double>"), "asked")
    return vectors.meet(data, asked, solve, "double")


def op10_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))
