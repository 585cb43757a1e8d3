"""SimHash fingerprints and exact near-duplicate links through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

#: Rows that a split of a shard ends at.
LEAF = 1024
#: Rows of a shard that meet in one task; larger shards are split, and if nothing splits them cut and their cuts paired.
CUT = 4096
#: Levels that a round adds to the trees, and rows of a leaf that they are fitted to.
DEPTH, FIT = 6, 4096
#: So many leaves or trees are sent to all tasks (half a megabyte); more are joined by a shuffle.
SMALL = 1024
#: A node of a tree: its vantage point and the median distance, or that it is an end.
NODE, END = np.dtype([("point", "<u4"), ("middle", "u1")]), 255


def fingerprint(text: str, size: int) -> int:
    """SimHash of one text, as a signed integer."""
    parts = text.encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    if not parts:
        return 0
    joined, at, n = b" ".join(parts), np.cumsum([0] + [len(p) + 1 for p in parts]).tolist(), min(size, len(parts))
    hashed = np.array([xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(at, at[n:], strict=False)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashed), 4096):
        ones += np.unpackbits(hashed[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashed), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, fp)``: 64-bit SimHash of the shingles of ``size`` words.

    Lower-cases A-Z, hashes every shingle of the whole text with XXH64 (seed 42),
    repeats included, and sets the bits set in over half of them.  Fewer words
    than ``size``: the whole sequence is the one shingle; none: zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return common.documents(docs).mapInArrow(run, "doc_id long, fp long")


def _fitted(x: np.ndarray, n: int, reach: int, leaf: int) -> np.ndarray:
    """Vantage points and medians of a tree over ``n`` rows, from a sample ``x`` of them; node k has the children 2k and 2k + 1.

    Of a few candidates of its own rows a node takes the point that splits them best
    at its median distance, boundary included; a node of about ``leaf`` rows, or whose
    rows no candidate splits, ends.
    """
    tree = np.array([(0, END)] * (1 << DEPTH), NODE)
    parts = {1: np.sort(x)}
    for k in range(1, 1 << DEPTH):
        own = parts.pop(k, None)
        if own is None or len(own) < 2 or len(own) * n <= leaf * len(x):
            continue
        best = (0.9 * len(own), 0, 0)
        for v in own[:: max(len(own) // 8, 1)][:8]:
            d = np.bitwise_count(own ^ v)
            for m in {int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2]) - e for e in (0, 1)} - {-1}:
                best = min(best, (max(np.count_nonzero(d <= m + reach), np.count_nonzero(d > m)), int(v), m))
        size, v, m = best
        if size < 0.9 * len(own):
            d = np.bitwise_count(own ^ np.uint32(v))
            tree[k], parts[2 * k], parts[2 * k + 1] = (v, m), own[d <= m + reach], own[d > m]
    return tree


def _descended(x: np.ndarray, tree: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, node)``: every end node that each row of ``x`` comes to."""
    row, at = np.arange(len(x)), np.ones(len(x), np.int64)
    for _ in range(DEPTH):
        node = tree[at]
        far = np.bitwise_count(x[row] ^ node["point"]).astype(np.int16) - node["middle"]
        open_, out = node["middle"] != END, far > 0
        edge = open_ & out & (far <= reach)
        row, at = np.concatenate([row, row[edge]]), np.concatenate([np.where(open_, 2 * at + out, at), 2 * at[edge]])
    return row, at


def shards(fps: DataFrame, radius: int, bands: int) -> DataFrame:
    """``fps(id, fp)`` with ``band`` and ``leaf``, a row for every leaf that a fingerprint is in.

    Each node of a band's tree has a vantage point of its own and splits at its own
    median distance m to it.  What is farther than m but within m + reach of it lies
    at the boundary and goes down both ways: by the triangle inequality whatever is
    within ``reach`` of a row inside is there too, so both meet in a leaf.

    Trees grow in rounds, for as long as a leaf has more than twice ``LEAF`` rows and can
    be split.  A round fits ``DEPTH`` levels to a sample of about ``FIT`` rows of each
    such leaf, one leaf at a time in a task, and sends all its rows down; a round adds
    no join while there are few leaves.
    """
    reach, width, most = radius // bands, 64 // bands, LEAF
    going = common.written(fps.select("id", "fp", F.explode(F.array(*map(F.lit, range(bands)))).alias("band"), F.col("band").cast("long").alias("leaf")), "level")

    def key(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        fp, band = rows.column("fp").to_numpy().view(np.uint64), rows.column("band").to_numpy().astype(np.uint64)
        return (fp >> (band * np.uint64(width)) & np.uint64((1 << width) - 1)).astype(np.uint32)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.whole_groups(batches, 0):
            leaf, n, x = rows.column("leaf").to_numpy(), rows.column("n").to_numpy(), key(rows)
            starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
            trees = [(leaf[s], _fitted(x[s:e], int(n[s]), reach, most)) for s, e in zip(starts, [*starts[1:], len(leaf)], strict=True)]
            trees = [(k, t.tobytes()) for k, t in trees if t["middle"][1] != END]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in trees], pa.int64()), pa.array([t for _, t in trees], pa.binary())], ["leaf", "tree"])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, leaf, found = key(batch), batch.column("leaf").to_numpy(), []
            order = np.argsort(leaf, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1) if len(leaf) else []:
                tree = batch.column("tree")[int(rows[0])].as_py() if known is None else known.value.get(int(leaf[rows[0]]))
                row, at = (np.arange(len(rows)), np.zeros(len(rows), np.int64)) if tree is None else _descended(x[rows], np.frombuffer(tree, NODE), reach)
                found.append((rows[row], at))
            if found:
                rows, at = (np.concatenate(f) for f in zip(*found, strict=True))
                part = batch.select(["id", "fp", "band", "leaf"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(at), part.column("leaf")], ["id", "fp", "band", "node", "leaf"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes = sized.value
        for batch in batches:
            pos = np.minimum(np.searchsorted(names, batch.column("leaf").to_numpy()), len(names) - 1)
            n = pa.array(sizes[pos])
            yield batch.append_column("n", n).filter(pa.array((names[pos] == batch.column("leaf").to_numpy()) & (batch.column("draw").to_numpy() % sizes[pos] < FIT)))

    context = fps.sparkSession.sparkContext
    drawn = lambda rows: rows.withColumn("draw", F.xxhash64("fp", "leaf").bitwiseAND(F.lit((1 << 62) - 1)))
    while True:
        large = common.written(going.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * LEAF), "large")
        count = large.count()
        if not count:
            break
        if count <= SMALL:
            sized = context.broadcast(tuple(c.to_numpy() for c in large.orderBy("leaf").toArrow().columns))  # at most SMALL rows
            some = drawn(going).mapInArrow(chosen, "id long, fp long, band int, leaf long, draw long, n long")
        else:
            some = drawn(going.join(large, "leaf")).where(F.col("draw") % F.col("n") < FIT)
        trees = common.written(common.sorted_groups(some.select("leaf", "n", "fp", "band"), "leaf").mapInArrow(fit, "leaf long, tree binary"), "trees")
        count = trees.count()
        if not count:
            break
        known = context.broadcast({r["leaf"]: bytes(r["tree"]) for r in trees.collect()}) if count <= SMALL else None  # at most SMALL rows
        down = going.mapInArrow if known is not None else going.join(trees, "leaf", "left").mapInArrow
        down = down(descend, "id long, fp long, band int, node long, leaf long")
        going = common.written(down.select("id", "fp", "band", F.when(F.col("node") == 0, F.col("leaf")).otherwise(F.xxhash64("leaf", "node")).alias("leaf")), "level")
    return going


def _links(fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (left, right) within ``radius``, pruned by distances to one vantage point."""
    d = np.bitwise_count(fp ^ fp[0]).astype(np.int16)
    order = right[np.argsort(d[right], kind="stable")]
    rings, found = d[order], []
    left = left[np.argsort(d[left], kind="stable")]
    for k in range(0, len(left), 256):
        own = left[k : k + 256]
        lo, hi = np.searchsorted(rings, d[own[0]] - radius, "left"), np.searchsorted(rings, d[own[-1]] + radius, "right")
        near = np.bitwise_count(fp[own][:, None] ^ fp[order[lo:hi]][None, :]) <= radius
        i, j = np.nonzero(near)
        found.append((own[i], order[lo:hi][j]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))
    return i[i != j], j[i != j]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row by the links (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        np.minimum.at(root, a, b)
        np.minimum.at(root, b, a)
        while not np.array_equal(root, root[root]):
            root = root[root]
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
    return root


def links(fps: DataFrame, radius: int = 3, bands: int = 2) -> DataFrame:
    """Links ``(a, b)`` that connect whatever is within ``radius`` bits, through trees.

    ``fps(fp, id)`` has a row per fingerprint, ids distinct.  Two words at most
    ``radius`` bits apart are at most ``radius`` / ``bands`` apart in one of the bands,
    so each band of 32 bits has a vantage-point tree of its own, with boundaries of
    that width (see ``shards``).  Inside a shard, distances over all 64 bits to one
    more vantage point prune by the triangle bound with the full radius, and what is
    left is compared exactly.

    A shard of more than ``CUT`` rows is cut by hash, and every pair of cuts is a
    group of its own, so no task holds an unbounded shard and no row is left out.
    Each group reports a spanning forest, at most a link a row, not all pairs.
    """
    rows = common.written(shards(fps.select("id", "fp"), radius, bands), "shards")
    sizes = common.written(rows.groupBy("band", "leaf").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    cut = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    rows = (
        rows.join(sizes, ["band", "leaf"])
        .withColumn("cuts", F.ceil(F.col("n") / CUT).cast("int"))
        .withColumn("cut", cut)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select("id", "fp", "cut", F.xxhash64("band", "leaf", F.least("cut", "other"), F.greatest("cut", "other")).alias("shard"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(solved, common.whole_groups(batches, 3))

    def solved(rows: pa.Table) -> pa.RecordBatch:
        ids, fp, cuts, shard = (rows.column(k).to_numpy() for k in range(4))
        fp = fp.astype(np.int64).view(np.uint64)
        at = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        out_a, out_b = [], []
        for s, e in zip(at[:-1], at[1:], strict=True):
            if e - s < 2:
                continue
            own, parts = np.arange(e - s), np.unique(cuts[s:e])
            split = [own[cuts[s:e] == p] for p in parts]
            i, j = _links(fp[s:e], split[0], split[-1], radius)
            root = _forest(e - s, i, j)
            moved = np.flatnonzero(root != own)
            out_a.append(ids[s:e][moved])
            out_b.append(ids[s:e][root[moved]])
        both = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (out_a, out_b)]
        return pa.RecordBatch.from_arrays(both, ["a", "b"])

    return common.sorted_groups(rows, "shard").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per document, with its group's smallest id.

    Equal fingerprints are one node from the start, pre-aggregated, so groups of
    copies cost one row.  Null and empty texts have fingerprint zero and link like
    any other; repeated rows give a row each; an empty table gives no rows.
    """
    fps = common.written(fingerprints(docs, size), "fingerprints")
    nodes = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "nodes")
    roots = graph.components(links(nodes.select(F.col("fp"), F.col("id")), radius))
    named = common.written(nodes.select("fp", "id").join(roots, nodes["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id")), "groups")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")
