"""Near duplicates by the Jaccard similarity of whole texts' word shingles, exact."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, simhash, trie

#: log2 of the counters that tell how often shingles come, and the bytes of counters in a row.
MOST_BITS, LEAST_BITS, PIECE = 22, 12, 1 << 18
#: Nodes of a group that meet in a task; larger groups are cut and their cuts paired.
CUT = 1024
#: Shingles of a set to a bucket of its sketch, about; buckets of a sketch, at least and at most.
LOAD, LEAST_BUCKETS, MOST_BUCKETS = 8, 64, 2048
#: Shingles of whole sets that meet in a task, about, and rows handed to it at once.
SHINGLES, ROWS = 1 << 18, 512
#: log2 of the counters in a row of the sketch that keeps texts of no pair from being moved.
FILTER = 22


def shingles(text: str, size: int) -> np.ndarray:
    """Distinct hashes, ascending, of the runs of ``size`` words; fewer words are one run, none have none."""
    parts = text.encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    if not parts:
        return np.empty(0, np.int64)
    joined, at, n = b" ".join(parts), np.cumsum([0] + [len(p) + 1 for p in parts]).tolist(), min(size, len(parts))
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a : b - 1]) for a, b in zip(at, at[n:], strict=False)], np.uint64).view(np.int64))


def _counted(docs: DataFrame, size: int) -> np.ndarray:
    """How often shingles come in all texts, by the first bits of their hash: one table of at most 2^``MOST_BITS`` counters.

    What else falls on a counter adds about the same to each, so a shingle of many
    texts stands out at every size.  This orders shingles and leaves none out.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * docs.count()).bit_length()))

    def packed(pieces: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int64()), pa.array([zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in pieces.values()], pa.binary())], ["piece", "counters"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                place, n = np.unique(_places(np.concatenate([shingles(t, size) for t in batch.column(1).slice(at, 200).to_pylist()]), bits), return_counts=True)
                counter[place] += n.astype(np.uint32)
        own = {k: counter[k : k + PIECE] for k in range(0, len(counter), PIECE)}
        yield packed({k: x for k, x in own.items() if x.any()})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces[k] = pieces.get(k, 0) + np.frombuffer(zlib.decompress(raw), np.uint32)
        yield packed(pieces)

    out, schema = np.zeros(1 << bits, np.uint32), "piece long, counters binary"
    for row in common.documents(docs).mapInArrow(count, schema).repartition("piece").mapInArrow(merge, schema).collect():  # 2^bits / PIECE rows
        new = np.frombuffer(zlib.decompress(row["counters"]), np.uint32)
        out[row["piece"] : row["piece"] + len(new)] = new
    return out


def _places(x: np.ndarray, bits: int) -> np.ndarray:
    return (x.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(x: np.ndarray) -> bytes:
    """How many shingles of a set are in each of its buckets, by the last bits; 255 is 255 or more."""
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (max(len(x), 1) // LOAD).bit_length()))
    return np.minimum(np.bincount(x & (buckets - 1), minlength=buckets), 255).astype(np.uint8).tobytes()


def _most(one: pa.Array, other: pa.Array) -> np.ndarray:
    """Shingles that two sets share at most, by their sketches; of two lengths the longer is folded."""
    lengths = [pc.binary_length(k).to_numpy() for k in (one, other)]
    out = np.zeros(len(one), np.int64)
    for pair in sorted(set(zip(*map(np.ndarray.tolist, lengths), strict=True))):
        rows, counts = np.flatnonzero((lengths[0] == pair[0]) & (lengths[1] == pair[1])), []
        for k, buckets in zip((one, other), pair, strict=True):
            x = np.frombuffer(b"".join(k.take(pa.array(rows)).to_pylist()), np.uint8).astype(np.int32)
            counts.append(np.where(x == 255, 1 << 20, x).reshape(len(rows), buckets // min(pair), min(pair)).sum(1))
        out[rows] = np.minimum(*counts).sum(1)
    return out


def _firsts(docs: DataFrame, size: int, least: float) -> DataFrame:
    """``(doc_id, copy, node, n, fp, k, p)``: each text's set as a number, its size, its SimHash, its sketch and its prefix ``p``.

    Two sets of similarity ``least`` share a shingle among the first
    n - ceil(least n) + 1 of each, in any one order of all shingles; the order is
    by frequency, then hash, so what many texts share hardly gets there.
    """
    counter = docs.sparkSession.sparkContext.broadcast(_counted(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = counter.value
        bits = len(times).bit_length() - 1
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column(1).to_pylist()
                sets, prefixes = [shingles(t, size) for t in texts], []
                for x in sets:
                    rank = times[_places(x, bits)]
                    prefixes.append(x[np.argsort(rank, kind="stable")][: len(x) - math.ceil(least * len(x) - 1e-9) + 1])
                node = np.array([int.from_bytes(hashlib.md5(x.tobytes()).digest()[:8], "little", signed=True) for x in sets], np.int64)
                fp = pa.array([simhash.fingerprint(t, size) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(node), pa.array([len(x) for x in sets], pa.int32()), fp, pa.array(map(_sketch, sets), pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "copy", "node", "n", "fp", "k", "p"])

    docs = common.documents(docs).withColumn("copy", F.unhex(F.md5("text")))
    return docs.mapInArrow(run, "doc_id long, copy binary, node long, n int, fp long, k binary, p array<long>")


def _only(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``texts(doc_id, copy, ...)`` that may be among ``asked(doc_id, copy)``, others left out where they are read.

    A sketch of bounded size tells most others apart whatever the number of texts; what
    it lets through too much finds no partner in the join that follows.
    """
    key, other = F.xxhash64("doc_id", "copy"), F.xxhash64("copy", "doc_id")
    bits = min(FILTER, max(LEAST_BITS, (8 * asked.count()).bit_length()))
    counter = texts.sparkSession.sparkContext.broadcast(trie.sketch(asked.select(key.alias("k1"), other.alias("k2")), bits))

    @F.arrow_udf("boolean")
    def there(one: pa.Array, two: pa.Array) -> pa.Array:
        return pa.array(counter.value[trie.places(one.to_numpy(), two.to_numpy(), bits)].min(0, initial=2) > 0)

    return texts.where(there(key, other))


def _alike(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int, least: float, repeated: bool) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole sets have a similarity of ``least``.

    What pairs connect meets in one task, so a text is moved once and its set made
    there, not moved for every pair; where that is over about ``SHINGLES`` shingles
    it is cut by hash, and the pairs of two cuts are a group of their own.
    """
    named = graph.components(pairs).join(nodes.select("node", "n"), "node")
    cuts = named.groupBy("root").agg(F.ceil(F.sum("n") / SHINGLES).cast("int").alias("cuts"))
    cut = common.written(named.join(cuts, "root").select("node", "root", F.when(F.col("cuts") > 1, F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")).otherwise(0).alias("cut")), "cuts")
    both = pairs.join(cut.select(F.col("node").alias("a"), "root", F.col("cut").alias("cut1")), "a").join(cut.select(F.col("node").alias("b"), F.col("cut").alias("cut2")), "b")
    shard = F.xxhash64("root", F.least("cut1", "cut2"), F.greatest("cut1", "cut2"))
    ends = both.select(shard.alias("shard"), F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("other")))).alias("x"))
    asked = ends.groupBy("shard", "x.node").agg(F.collect_list("x.other").alias("others"))  # no more than a group's nodes
    asked = common.written(asked.join(nodes.select("node", "doc_id", "copy"), "node"), "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.whole_groups(batches, 0):
            shard, node = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(rows)]])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                sets = {k: shingles(t, size) for k, t in zip(node[s:e].tolist(), rows.column(3).slice(s, e - s).to_pylist(), strict=True)}
                found = []
                for a, others in zip(node[s:e].tolist(), rows.column(2).slice(s, e - s).to_pylist(), strict=True):
                    for b in others:
                        x, y = sets[a], sets[b]
                        shared = len(np.intersect1d(x, y, assume_unique=True))
                        if shared / (len(x) + len(y) - shared) >= least:
                            found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    texts = _only(common.documents(docs).withColumn("copy", F.unhex(F.md5("text"))), asked)
    texts = texts.dropDuplicates(["doc_id", "copy"]) if repeated else texts
    rows = texts.join(asked, ["doc_id", "copy"]).select("shard", "node", "others", "text")
    with common.few_rows(docs.sparkSession, ROWS):
        return common.written(common.sorted_groups(rows, "shard").mapInArrow(run, "a long, b long"), "links")


def _shared(prefix: DataFrame) -> DataFrame:
    """Rows ``(p, node, n, at)``, each once, whose ``p`` more than one node has: one shuffle, then neighbours compared.

    A ``p`` of all nodes is one row of the about n / 5 of each, so no partition is
    much larger for it, and a task holds a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shared = None, False  # the row before, and whether the one before it has its p
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
            p, node = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            rows = rows.filter(pa.array(np.concatenate([[True], (p[1:] != p[:-1]) | (node[1:] != node[:-1])])))
            p = rows.column(0).to_numpy()
            equal = p[1:] == p[:-1]
            before = np.concatenate([[shared], equal])
            out = rows.slice(0, len(p) - 1).filter(pa.array((before[:-1] | equal)))
            last, shared = rows.slice(len(p) - 1), bool(before[-1])
            if out.num_rows:
                yield out
        if last is not None and shared:
            yield last

    return prefix.repartition("p").sortWithinPartitions("p", "node").mapInArrow(run, "p long, node long, n int, at int")


def _across(hits: DataFrame, least: float) -> DataFrame:
    """Candidate pairs ``(a, b)`` within each group ``p`` whose nodes are not connected yet."""
    open_groups = hits.groupBy("p").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("p", F.ceil(F.col("m") / CUT).cast("int").alias("cuts"))
    rows = (
        hits.join(open_groups, "p")
        .withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select("node", "comp", "n", "at", "cut", F.xxhash64("p", F.least("cut", "other"), F.greatest("cut", "other")).alias("shard"))
    )

    def solved(node: np.ndarray, comp: np.ndarray, n: np.ndarray, at: np.ndarray, cut: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, right = np.flatnonzero(cut == cut.min()), np.flatnonzero(cut == cut.max())
        for k in range(0, len(left), 256):
            i = left[k : k + 256, None]
            most = 1 + np.minimum((n - at - 1)[i], (n - at - 1)[right])  # of what they share, if this is the first
            near = (comp[i] != comp[right]) & (most * (1 + least) >= least * (n[i] + n[right]) - 1e-6)
            x, y = np.nonzero(near)
            yield node[i[x, 0]], node[right[y]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.whole_groups(batches, 5):
            columns = [rows.column(k).to_numpy() for k in range(6)]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(columns[5])) + 1, [len(rows)]])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                for a, b in solved(*[c[s:e] for c in columns[:5]]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return common.sorted_groups(rows, "shard").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8, radius: int = 3) -> DataFrame:
    """``(doc_id, copy, n_rows, component)``: what is linked by a Jaccard similarity of ``least`` or more.

    Similarity is that of the sets of ``size``-word shingles of the whole texts, A-Z
    in lower case; every pair at or above ``least`` links, none below.  ``copy`` is
    the text's MD5, so one doc_id with two texts is two rows, and equal rows are one
    of ``n_rows``.  Texts with equal sets are one node from the start; null, empty
    and white texts have the empty set.  An empty table gives no rows.

    Candidates come from SimHash first: fingerprints within ``radius`` bits, by
    vantage-point trees (``simhash.links``); they join most near copies.  Fingerprints
    of sets as far apart as ``least`` allows differ in about ten bits, out of reach of
    any exact Hamming index, so pairs that are still apart come from shared prefix
    shingles: each group's nodes with three pivots of it, the one whose prefix is
    shared most (an original among its edited copies) and two others, then whatever
    is left unconnected.  Sketches bound what a pair can share, and pairs within that bound
    have their whole sets compared.
    """
    first = common.written(_firsts(docs, size, least), "firsts")
    nodes = common.written(first.groupBy("node").agg(F.min(F.struct("doc_id", "copy")).alias("x"), *[F.min(c).alias(c) for c in ("fp", "n", "k")]).select("node", "x.*", "fp", "n", "k"), "nodes")
    hits = common.written(_shared(first.select("node", "n", F.posexplode("p").alias("at", "p")).select("p", "node", "n", "at")), "hits")

    by_fp = common.written(nodes.groupBy("fp").agg(F.min("node").alias("id")), "fingerprints")
    equal = nodes.join(by_fp, "fp").where("node <> id").select(F.least("node", "id").alias("a"), F.greatest("node", "id").alias("b"))
    near = simhash.links(by_fp, radius)
    near = common.written(equal.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "near")

    rows = common.written(first.groupBy("doc_id", "copy", "node").agg(F.count("*").alias("n_rows")), "rows")
    repeated = bool(rows.where("n_rows > 1").head(1))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n = part.column(2).to_numpy().astype(float) + part.column(3).to_numpy()
                yield part.select(["a", "b"]).filter(pa.array(_most(part.column(4), part.column(5)) * (1 + least) >= least * n - 1e-6))

    def links(pairs: DataFrame) -> DataFrame:
        for end, side in (("a", "1"), ("b", "2")):
            pairs = (pairs.distinct() if end == "a" else pairs).join(nodes.select(F.col("node").alias(end), F.col("n").alias("n" + side), F.col("k").alias("k" + side)), end)
        close = pairs.select("a", "b", "n1", "n2", "k1", "k2").mapInArrow(bounded, "a long, b long")
        return _alike(docs, common.written(close, "close"), nodes, size, least, repeated)

    sizes = hits.groupBy("p").agg(F.count("*").alias("m"))
    known = hits.join(sizes, "p").groupBy("node").agg(F.sum("m").alias("known"))
    graded = common.written(hits.join(known, "node"), "graded")
    pivots = graded.groupBy("p").agg(F.array(F.max_by(F.struct("node", "n"), F.struct("known", "node")), *[F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(seed))) for seed in range(2)]).alias("x"))
    stars = hits.join(pivots, "p").select("node", "n", F.explode(F.array_distinct("x")).alias("v")).where((F.col("node") != F.col("v.node")) & (F.least("n", "v.n") >= least * F.greatest("n", "v.n") - 1e-6))
    done = links(near.unionByName(stars.select(F.least("node", "v.node").alias("a"), F.greatest("node", "v.node").alias("b"))))
    joined = hits.join(graph.components(done), "node", "left").withColumn("comp", F.coalesce("root", "node"))
    rest = links(_across(common.written(joined.select("p", "node", "n", "at", "comp"), "open"), least))
    roots = graph.components(done.unionByName(rest))
    return rows.join(roots, "node", "left").select("doc_id", "copy", "n_rows", F.coalesce("root", "node").alias("component"))
