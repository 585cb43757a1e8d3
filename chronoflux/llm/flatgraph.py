"""Near duplicates among vectors: a robust-pruned flat graph over overlapping shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, common, graph, vectors

#: Vectors of a shard's block, and how many a cluster is meant to hold.
BLOCK, MEANT = 2048, 1024
#: Out-neighbours kept, length of the walk's list, and how much nearer a detour has to be to drop an edge.
DEGREE, BEAM, ALPHA = 24, 32, 1.2
#: Walks that advance together.
TOGETHER = 256


class FlatGraph:
    """A directed graph of near neighbours among unit vectors, grown by batches and searched greedily."""

    def __init__(self, v: np.ndarray) -> None:
        self.v = v.astype(np.float32)
        self.edges = np.full((len(v), 2 * DEGREE), -1, np.int32)
        centre = self.v.mean(0)
        self.medoids = np.array([int((self.v @ centre).argmax())])

    def near(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own row of ``ids``."""
        return 2 - 2 * np.einsum("qd,qnd->qn", q, self.v[ids])

    def walk(self, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy search from the medoids: each query's list of nearest found, nearest first, and all that were seen."""
        seen = np.zeros((len(q), len(self.v)), bool)
        at = np.arange(len(q))[:, None]
        ids = np.repeat(self.medoids[None, :], len(q), 0)
        away, done = self.near(q, ids), np.zeros(ids.shape, bool)
        seen[at, ids] = True
        while True:
            turn = np.where(done | (ids < 0), np.inf, away).argmin(1)
            live = np.flatnonzero(~done[np.arange(len(q)), turn] & (ids[np.arange(len(q)), turn] >= 0))
            if not len(live):
                return ids, away, seen
            done[live, turn[live]] = True
            new = self.edges[ids[live, turn[live]]]
            fresh = (new >= 0) & ~seen[live[:, None], new]
            x, y = np.nonzero(fresh)
            seen[live[x], new[x, y]] = True
            d = np.full((len(q), new.shape[1]), np.inf, np.float32)
            d[live[x], y] = 2 - 2 * np.einsum("nd,nd->n", q[live[x]], self.v[new[x, y]])
            more = np.full((len(q), new.shape[1]), -1, ids.dtype)
            more[live[x], y] = new[x, y]
            ids, away, done = np.concatenate([ids, more], 1), np.concatenate([away, d], 1), np.concatenate([done, np.zeros(more.shape, bool)], 1)
            best = np.argsort(away, axis=1, kind="stable")[:, :beam]
            ids, away, done = ids[at, best], away[at, best], done[at, best]

    def pruned(self, own: np.ndarray, ids: np.ndarray, away: np.ndarray) -> np.ndarray:
        """Robust pruning: of each row's candidates the nearest stay that no kept one is ``ALPHA`` times nearer to."""
        order = np.argsort(np.where((ids < 0) | (ids == own[:, None]), np.inf, away), axis=1, kind="stable")
        ids, away = np.take_along_axis(ids, order, 1), np.take_along_axis(away, order, 1)
        alive = (ids >= 0) & (ids != own[:, None])
        alive[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        x = self.v[ids]
        between = 2 - 2 * np.einsum("bnd,bmd->bnm", x, x)
        kept, rows = np.full((len(own), DEGREE), -1, np.int32), np.arange(len(own))
        for k in range(DEGREE):
            first = alive.argmax(1)
            some = alive[rows, first]
            if not some.any():
                break
            kept[some, k] = ids[rows[some], first[some]]
            alive &= ~((ALPHA * ALPHA * between[rows, first] <= away) & some[:, None])
            alive[rows, first] = False
        return kept

    def link(self, own: np.ndarray, kept: np.ndarray) -> None:
        """Set the edges of ``own`` and their reverses; lists that overflow are pruned again."""
        self.edges[own, :DEGREE], self.edges[own, DEGREE:] = kept, -1
        x, y = np.nonzero(kept >= 0)
        to, back = kept[x, y], own[x]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1]) if len(to) else np.empty(0, int)
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(to)], strict=True):
            node = int(to[s])
            have = self.edges[node]
            have = have[have >= 0]
            all_ = np.union1d(have, back[s:e])
            if len(all_) > 2 * DEGREE:
                d = 2 - 2 * self.v[all_] @ self.v[node]
                all_ = self.pruned(np.array([node]), all_[None, :].astype(np.int64), d[None, :])[0]
                all_ = all_[all_ >= 0]
            self.edges[node] = -1
            self.edges[node, : len(all_)] = all_

    def build(self) -> FlatGraph:
        """Insert the rest by batches that grow with the graph: walk, prune, link both ways."""
        order = np.random.default_rng(9).permutation(len(self.v))
        order = np.concatenate([self.medoids, order[order != self.medoids[0]]])
        at = 1
        while at < len(order):
            batch = order[at : at + min(max(1, at // 2), TOGETHER)]
            ids, away, _ = self.walk(self.v[batch])
            each = 2 - 2 * self.v[batch] @ self.v[batch].T
            near = np.argsort(each, axis=1, kind="stable")[:, : DEGREE // 2 + 1]  # those of one batch do not see each other yet
            ids = np.concatenate([ids, batch[near]], 1)
            away = np.concatenate([away, np.take_along_axis(each, near, 1)], 1)
            self.link(batch, self.pruned(batch, ids, away))
            at += len(batch)
        return self

    def within(self, q: np.ndarray, least: float, slack: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of cosine ``least`` or more: the walk, then everything around what is in range.

        The walk's list is the first range; whatever is in range, or short of it by
        ``slack``, is expanded until nothing new is, so a range of any size is whole
        as far as its graph is connected.  Cosines are single precision here; what is
        near the edge is kept for the check in double precision.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        reach = np.float32(2 - 2 * (least - slack))
        for s in range(0, len(q), TOGETHER):
            part = q[s : s + TOGETHER].astype(np.float32)
            ids, away, seen = self.walk(part)
            seen[:] = False  # what fell off the list may be in range
            x, y = np.nonzero(ids >= 0)
            seen[x, ids[x, y]] = True
            x, y = np.nonzero((away <= reach) & (ids >= 0))
            front, node, d = x, ids[x, y], away[x, y]
            while len(front):
                keep = d <= np.float32(2 - 2 * least + 1e-4)
                found.append((front[keep] + s, node[keep]))
                sides, ends = [], []
                for t in range(0, len(front), 1 << 15):
                    to = self.edges[node[t : t + (1 << 15)]]
                    i, j = np.nonzero(to >= 0)
                    side, end = front[t : t + (1 << 15)][i], to[i, j]
                    fresh = ~seen[side, end]
                    side, end = side[fresh], end[fresh]
                    code = np.unique(side.astype(np.int64) * len(self.v) + end)
                    side, end = code // len(self.v), code % len(self.v)
                    seen[side, end] = True
                    sides.append(side)
                    ends.append(end)
                front, node = np.concatenate(sides), np.concatenate(ends)
                d = np.concatenate([np.empty(0, np.float32), *(2 - 2 * np.einsum("nd,nd->n", part[front[t : t + (1 << 15)]], self.v[node[t : t + (1 << 15)]]) for t in range(0, len(front), 1 << 15))])
                near = d <= reach
                front, node, d = front[near], node[near], d[near]
        return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.empty(0, int), np.empty(0, int))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, whatever the size of their components."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def fitted_copies(points: np.ndarray, centre: np.ndarray, least: float, share: float) -> int:
    """Clusters a vector has to be in so that ``share`` of all pairs just ``least`` alike meet in one.

    Measured on the sample with a random neighbour at that cosine for each vector.
    """
    x = points[:: max(1, len(points) // 1024)]
    turn = np.random.default_rng(13).normal(size=x.shape)
    turn -= (turn * x).sum(1, keepdims=True) * x
    length = np.sqrt((turn * turn).sum(1, keepdims=True))
    other = least * x + np.sqrt(1 - least * least) * turn / np.where(length > 0, length, 1)
    a, b = (np.argsort(vectors.squared(p, centre), axis=1, kind="stable") for p in (x, other))
    for copies in range(1, len(centre)):
        if (a[:, :copies, None] == b[:, None, :copies]).any((1, 2)).mean() >= share:
            return copies
    return len(centre)


def distinct(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members(vec_id, copy)`` of usable vectors and ``nodes(node, copy, m, lo, v)``, equal vectors being one node."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors.matrix(batch.column(1)) + 0.0 if batch.num_rows else np.empty((0, 1))  # no negative zero
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.md5(x.tobytes()).digest() for x in v], pa.binary()), batch.column(1)], ["vec_id", "copy", "v"])

    rows = common.written(vectors.clean(df, zero=False).select("vec_id", "v").mapInArrow(digested, "vec_id long, copy binary, v array<double>"), "vectors")
    nodes = rows.groupBy("copy").agg(F.count("*").alias("m"), F.min("vec_id").alias("lo"), F.first("v").alias("v"))
    return rows.select("vec_id", "copy"), common.written(nodes.select(F.monotonically_increasing_id().alias("node"), "copy", "m", "lo", "v"), "nodes")


def posted(nodes: DataFrame, centre: np.ndarray, copies: int) -> DataFrame:
    """``(node, m, v, cells, cell, block)``: each vector in the shards of its ``copies`` nearest clusters."""
    at = nodes.sparkSession.sparkContext.broadcast(centre)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                v = unit(vectors.matrix(part.column(2)))
                near = np.sort(np.argsort(vectors.squared(v, at.value), axis=1, kind="stable")[:, :copies].astype(np.int32), axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), flat, lists], ["node", "m", "v", "cells"])

    rows = nodes.select("node", "m", "v").mapInArrow(post, "node long, m long, v array<double>, cells array<int>")
    rows = common.written(rows.select("*", F.explode("cells").alias("cell")), "posted")
    blocks = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row per cluster
    return rows.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("node", "cell"), F.col("blocks")).cast("int"))


def adjacency(shards: DataFrame) -> DataFrame:
    """``(node, near)``: neighbour lists of the graphs built on each shard, united over the shards of a vector."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.whole_groups(batches, 0):
            shard, node = part.column(0).to_numpy(), part.column(1).to_numpy()
            v = vectors.matrix(part.column(2).combine_chunks())
            at = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for s, e in zip(at[:-1], at[1:], strict=True):
                edges = FlatGraph(v[s:e]).build().edges
                ends = np.concatenate([[0], np.cumsum((edges >= 0).sum(1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node[s:e]), pa.ListArray.from_arrays(pa.array(ends), pa.array(node[s:e][edges[edges >= 0]]))], ["node", "near"])

    keyed = shards.select(F.xxhash64("cell", "block").alias("shard"), "node", "v")
    lists = common.sorted_groups(keyed, "shard").mapInArrow(build, "node long, near array<long>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # degree times copies at most


def matched(shards: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """``(node, links, root)`` per shard pair: rows linked to, and a node of the same local component.

    Two blocks of a cluster, or one with itself, are a group.  The graph of a group
    is the united lists as far as they stay in it; every vector of it is searched
    from the blocks' medoids.  A pair counts in the smallest cluster both are in, and
    there in the group of their two blocks, so nothing is counted twice and no pair
    leaves its task.
    """
    rows = shards.join(lists, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.select(F.xxhash64("cell", low, high).alias("group"), "cell", "block", "node", "m", "v", "cells", "near")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.whole_groups(batches, 0):
            group, cell, block, node, m = (part.column(k).to_numpy() for k in range(5))
            v, cells = vectors.matrix(part.column(5).combine_chunks()), vectors.matrix(part.column(6).combine_chunks())
            near, ends = common.flat(part.column(7))
            at = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            for s, e in zip(at[:-1], at[1:], strict=True):
                n, own = e - s, v[s:e]
                g = FlatGraph(own)
                g.medoids = np.unique([int(np.flatnonzero(block[s:e] == b)[(own[block[s:e] == b] @ own[block[s:e] == b].mean(0)).argmax()]) for b in np.unique(block[s:e])])
                order = np.argsort(node[s:e])
                to, by = near[ends[s] : ends[e]], np.repeat(np.arange(n), np.diff(ends[s : e + 1]))
                place = order[np.searchsorted(node[s:e][order], to).clip(0, n - 1)]
                inside = node[s:e][place] == to
                place, by = place[inside], by[inside]
                slot = np.arange(len(by)) - np.searchsorted(by, by)
                g.edges = np.full((n, max(1, slot.max(initial=0) + 1)), -1, np.int32)
                g.edges[by, slot] = place
                i, j = g.within(own, least)
                code = np.unique(np.minimum(i, j) * n + np.maximum(i, j))
                i, j = code // n, code % n
                both = len(np.unique(block[s:e])) > 1
                keep = (i != j) & ((block[s:e][i] != block[s:e][j]) if both else np.ones(len(i), bool))
                i, j = i[keep], j[keep]
                sure = []
                for t in range(0, len(i), 1 << 14):  # exact, and counted in one cluster only
                    x, y = i[t : t + (1 << 14)], j[t : t + (1 << 14)]
                    common_cell = np.where((cells[s:e][x][:, :, None] == cells[s:e][y][:, None, :]).any(2), cells[s:e][x], np.iinfo(np.int32).max).min(1)
                    sure.append(((own[x] * own[y]).sum(1) >= least) & (common_cell == cell[s]))
                ok = np.concatenate(sure) if sure else np.empty(0, bool)
                i, j = i[ok], j[ok]
                links = np.bincount(i, m[s:e][j], n) + np.bincount(j, m[s:e][i], n)
                root = np.arange(n)
                while True:  # least label of the local component
                    before = root.copy()
                    np.minimum.at(root, i, root[j])
                    np.minimum.at(root, j, root[i])
                    root = root[root]
                    if (root == before).all():
                        break
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[s:e][some]), pa.array(links[some].astype(np.int64)), pa.array(node[s:e][root[some]])], ["node", "links", "root"])

    return common.sorted_groups(rows, "group").mapInArrow(search, "node long, links long, root long")


def audited(nodes: DataFrame, links: DataFrame, least: float, asked: int = 256) -> float:
    """Recall: of ``asked`` nodes (least hashes of their digests) the links found over those of a full scan."""
    q = nodes.orderBy(F.xxhash64("copy"), "node").limit(asked).select("node", "v").toArrow()
    if not q.num_rows:
        return 1.0
    ids, qv = q.column(0).to_numpy(), unit(vectors.matrix(q.column(1).combine_chunks()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i, j = np.nonzero((unit(vectors.matrix(batch.column(2))) @ qv.T >= least) & (batch.column(0).to_numpy()[:, None] != ids[None, :]))
                n = np.bincount(j, batch.column(1).to_numpy()[i], len(ids)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["node", "links"])

    true = nodes.select("node", "m", "v").mapInArrow(scan, "node long, links long").groupBy("node").agg(F.sum("links").alias("t"))
    got = true.join(links.groupBy("node").agg(F.sum("links").alias("l")), "node", "left").agg(F.sum("t"), F.sum(F.least("t", F.coalesce("l", F.lit(0))))).first()
    return got[1] / got[0] if got[0] else 1.0


def near_duplicates(df: DataFrame, least: float = 0.9, recall: float = 0.98, lists: int = 2048, fit: int = 16384, seed: int = 17) -> DataFrame:
    """One row per vector: ``(vec_id, n_links, component_id, kept)`` of links at cosine ``least`` or more.

    Equal vectors are one node.  Clusters are fitted on at most ``fit`` rows, one for
    about ``MEANT`` nodes and ``lists`` at most; every vector is in the shards of its
    nearest few clusters, as many as make pairs just at ``least`` meet (measured on
    the sample).  A graph is built on each shard (greedy search, robust pruning,
    reverse edges), the lists of a vector are united, and range-expanding searches
    from the medoids find what is alike; cosines are checked in double precision.
    Recall is audited against a full scan for 256 vectors: below ``recall`` the
    overlap is doubled and the shards are searched again, until a vector is in all.

    Null, empty and zero vectors and those with null or non-finite components link
    with nothing; rows without a vec_id are left out; repeated rows are a row each
    and link as equal vectors do (a repeated vec_id keeps each of its rows).  Usable
    vectors must have one length, or the query fails.  No rows give no rows.
    """
    spark = df.sparkSession
    ids = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL")
    bad = F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) | ~F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    alone = ids.where(bad).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    members, nodes = distinct(df)
    points = vectors.sample(nodes.select("v", F.col("node").alias("vec_id")), fit, seed)
    if not len(points):
        return alone
    points = unit(points)
    clusters = min(lists, 1 + nodes.count() // MEANT, 1 + len(points) // 8)
    centre, _ = ann.balanced_centroids(points, clusters)
    copies = fitted_copies(points, centre, least, recall)
    while True:
        shards = posted(nodes, centre, copies)
        links = common.written(matched(shards, adjacency(shards), least), "links")
        if copies >= len(centre) or audited(nodes, links, least) >= recall:
            break
        copies = min(len(centre), 2 * copies)
    n_links = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = graph.components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    lows = roots.join(nodes.select("node", "lo"), "node").groupBy("root").agg(F.min("lo").alias("component"))
    placed = roots.join(lows, "root").select("node", "component")
    found = nodes.select("node", "copy", "m", "lo").join(n_links, "node", "left").join(placed, "node", "left")
    found = common.written(found.select("copy", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.least("lo", F.coalesce("component", "lo")).alias("component_id")), "found")
    rows = common.looked_up(members, found, ["copy"], "m")
    return rows.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)


def op12_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of ``embeddings`` with their links, component and whether they stay."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


#: Exact links by a self join; fine for small tables.
ORACLE = """WITH RECURSIVE rows AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL),
good AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, vec_id, v FROM rows WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT r AS a, r AS b FROM good UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT reach.a AS r, min(good.vec_id) AS component_id FROM reach JOIN good ON good.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM good JOIN least USING (r) LEFT JOIN n USING (r)
UNION ALL SELECT vec_id, 0, vec_id, true FROM rows WHERE NOT coalesce(len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0, false)"""
