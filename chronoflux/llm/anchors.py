"""Places where a long passage may repeat: content-chosen anchors, and passages around them.

Every window of ``length`` units has one anchor, the leftmost least hash among its
k-grams, so equal windows have equal anchors, as far from their starts.  Windows
whose anchor hash comes once repeat nowhere; the others are gathered by anchor
hash, each in exactly one passage.  Passages of one content are one from then on.
An anchor with too many different passages is split by how far a window starts
before it, and by the units that all windows of such a range have; ranges are
halved until no group is too large, at the latest when a range is one window.
So work grows with the passages of an anchor, never with pairs of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = [np.random.default_rng(9 + salt).integers(1, 1 << 64, 256, dtype=np.uint64) for salt in range(4)]
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16) * 2, base)]))
        if len(have) < 1 << 23:
            _powers[str(base)] = have
    return have[:n]


def byte_units(data: np.ndarray, salt: int = 0) -> np.ndarray:
    return _BYTES[salt][data]


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` units."""
    n = len(units) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * _power(_ODD, len(units)))])
    g = (total[k:] - total[:n]) * _power(_INVERSE, n)
    g ^= g >> np.uint64(32)
    g *= _MIX
    g ^= g >> np.uint64(29)
    return g


def _leftmost_least(g: np.ndarray, width: int) -> np.ndarray:
    """Where the least of g[s : s + width] stands first, for every s."""
    value, place, have = g, np.arange(len(g), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        less = value[step:] < value[:-step]
        value, place = np.where(less, value[step:], value[:-step]), np.where(less, place[step:], place[:-step])
        have += step
    return place


def find(units: np.ndarray, offsets: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor hash: row, h, first and last start, anchors in it."""
    empty = {"row": np.empty(0, np.int64), "h": np.empty(0, np.int64), "a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "m": np.empty(0, np.int64)}
    if len(units) < length:
        return empty
    g = grams(units, k)
    place = _leftmost_least(g, length - k + 1)
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    starts = common.spread(offsets[:-1], counts)  # windows within one row
    if not len(starts):
        return empty
    row, p = np.repeat(np.arange(len(counts)), counts), place[starts]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (row[1:] != row[:-1])])
    h = g[p]
    run = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([run[1:], [len(starts)]]) - 1
    return {"row": row[run], "h": h[run].view(np.int64), "a": starts[run] - offsets[row[run]], "b": starts[last] - offsets[row[run]], "m": np.add.reduceat(new.astype(np.int64), run)}


#: First pass over documents: what ``first_pass`` returns.
FIRST = "doc_id long, copy binary, n long, whole binary, h array<long>, a array<int>, b array<int>, m array<int>"


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with a hash of 128 bits by which copies are known."""
    return common.documents(docs).withColumn("copy", F.unhex(F.md5("text")))


def first_pass(docs: DataFrame, read: Callable[[list[str]], tuple[np.ndarray, np.ndarray, list[bytes]]], length: int, k: int) -> DataFrame:
    """A row per document: size, hash of the whole and its anchor runs.

    ``read`` turns texts into units, row offsets and a hash of each whole text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                units, offsets, whole = read(part.column(1).to_pylist())
                found = find(units, offsets, length, k)
                cuts = np.searchsorted(found["row"], np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(found[c].astype(np.int64 if c == "h" else np.int32))) for c in "habm"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(offsets)), pa.array(whole, pa.binary()), *lists], ["doc_id", "copy", "n", "whole", "h", "a", "b", "m"])

    return keyed(docs).mapInArrow(run, FIRST)


@dataclass(frozen=True)
class Search:
    """What tells bytes from words, and which windows go."""

    length: int
    k: int
    #: Different passages of a group that meet in a task; groups of more are split.
    cut: int
    #: Condition on an anchor hash's ``n`` (occurrences), ``low`` and ``high`` (doc_id).
    repeated: str
    #: Units of a text as they are compared, and units (hashes) of such a passage.
    read: Callable[[str], np.ndarray]
    units: Callable[[bytes], np.ndarray]
    #: Condition on ``n``, ``lo`` of a content and ``own`` (doc_id): all its windows go.
    whole: str
    #: Batches of whole groups ``(key, cid, data, n, lo)`` to ``(cid, starts)`` of windows that go.
    solve: Callable[[Iterator[pa.Table]], Iterator[tuple[bytes, np.ndarray]]]


def _passages(docs: DataFrame, first: DataFrame, search: Search) -> DataFrame:
    """``(doc_id, copy, off, own, n, key, data)``: passages whose anchor repeats, from the first window's start to the last one's end."""
    runs = first.select("doc_id", "copy", F.explode(F.arrays_zip("h", "a", "b", "m")).alias("x")).select("doc_id", "copy", "x.*")
    known = common.written(runs.groupBy("h").agg(F.sum("m").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where(search.repeated).select("h"), "anchors")
    hits = runs.join(known, "h").groupBy("doc_id", "copy").agg(F.collect_list(F.struct("h", "a", "b")).alias("x"))
    joined = keyed(docs).join(hits, ["doc_id", "copy"]).select("doc_id", "copy", "text", "x.h", "x.a", "x.b")
    length = search.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out: list[list] = [[], [], [], [], []]
                for doc_id, copy, text, *lists in zip(*(batch.slice(at, 500).column(c).to_pylist() for c in range(6)), strict=True):
                    units = search.read(text)
                    for h, a, b in zip(*lists, strict=True):
                        for column, v in zip(out, (doc_id, copy, a, h, units[a : b + length].tobytes()), strict=True):
                            column.append(v)
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "copy", "off", "key", "data"])

    return joined.mapInArrow(run, "doc_id long, copy binary, off int, key long, data binary").withColumn("own", F.col("doc_id")).withColumn("n", F.lit(1).cast("long"))


def _split(contents: DataFrame, search: Search, level: int) -> DataFrame:
    """Passages ``(root, off, own, n, key, data)`` of the contents' windows by 2^``level`` ranges of distance to their anchor."""
    length, k = search.length, search.k
    width = -(-(length - k + 1) // 2**level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for cid, data, n, lo in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                units = search.units(data)
                size, starts = len(data) // len(units), np.arange(len(units) - length + 1)
                place = _leftmost_least(grams(units, k), length - k + 1)[: len(starts)]
                part = (place - starts) // width
                new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (part[1:] != part[:-1])]))
                for a, b in zip(new.tolist(), [*new[1:].tolist(), len(starts)], strict=True):
                    p, r = int(place[a]), int(part[a])
                    core = data[(p - r * width) * size : (p - min((r + 1) * width - 1, length - k) + length) * size]
                    key = xxhash.xxh64_intdigest(core, r) - (1 << 63)
                    for column, v in zip(out, (cid, a, lo, n, key, data[a * size : (b - 1 + length) * size]), strict=True):
                        column.append(v)
            kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["root", "off", "own", "n", "key", "data"])

    return contents.select("cid", "data", "n", "lo").mapInArrow(run, "root binary, off int, own long, n long, key long, data binary")


def _matched(items: DataFrame, roots: list[str], search: Search, level: int = 0) -> DataFrame:
    """``(*roots, s, e)``: spans of each root that windows which go cover (not yet joined up).

    ``items`` are passages: ``off`` in their root, ``own`` (the root's smallest
    doc_id), ``n`` (how often the root comes), ``key`` of the group and ``data``.
    """
    length = search.length
    items = common.written(items.withColumn("cid", F.unhex(F.md5("data"))), "passages")
    contents = common.written(items.groupBy("cid").agg(F.first("key").alias("key"), F.first("data").alias("data"), F.sum("n").alias("n"), F.min("own").alias("lo")), "contents")
    large = common.written(contents.groupBy("key").agg(F.count("*").alias("different")).where(F.col("different") > search.cut).select("key"), "large")
    split = 2 ** (level - 1) < length - search.k + 1 and bool(large.head(1))
    ready = contents.join(large, "key", "left_anti") if split else contents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cid, starts in search.solve(common.whole_groups(batches, 0)):
            s, e = spans_of(starts, length)
            yield pa.RecordBatch.from_arrays([pa.array([cid] * len(s), pa.binary()), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["cid", "s", "e"])

    spans = common.sorted_groups(ready.select("key", "cid", "data", "n", "lo"), "key").mapInArrow(batched(run), "cid binary, s int, e int")
    if split:
        deeper = _matched(_split(contents.join(large, "key", "left_semi"), search, level + 1), ["root"], search, level + 1)
        spans = spans.unionByName(deeper.withColumnRenamed("root", "cid"))
    where = items.select(*roots, "off", "own", "cid", (F.length("data") / F.lit(len(search.read("a").tobytes()))).cast("int").alias("size"))
    parts = where.join(spans, "cid").select(*roots, (F.col("off") + F.col("s")).alias("s"), (F.col("off") + F.col("e")).alias("e"))
    gone = where.join(contents.select("cid", "n", "lo"), "cid").where(search.whole).select(*roots, F.col("off").alias("s"), (F.col("off") + F.col("size")).alias("e"))
    return parts.unionByName(gone)


def batched(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with its small results put together."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in run(batches):
            kept.append(batch)
            if len(kept) >= 5000:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept = []
        if kept and sum(b.num_rows for b in kept):
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    return together


def matches(docs: DataFrame, first: DataFrame, search: Search) -> DataFrame:
    """``(doc_id, copy, s, e)``: what goes of the documents in ``first``."""
    return _matched(_passages(docs, first, search), ["doc_id", "copy"], search)


def spans_of(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by windows of ``length`` at ascending ``starts``."""
    if not len(starts):
        return starts, starts
    new = np.concatenate([[True], starts[1:] > starts[:-1] + length])
    last = np.concatenate([np.flatnonzero(new)[1:], [len(starts)]]) - 1
    return starts[new], starts[last] + length


def kept_mask(n: int, starts: list[int], ends: list[int]) -> np.ndarray:
    """Which of ``n`` units no span covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) == 0


def digests(docs: DataFrame, spans: DataFrame, cut: Callable[[str, list[int], list[int]], tuple[int, int, str]]) -> DataFrame:
    """``(doc_id, copy, removed, runs, kept)`` of the documents that have spans."""
    lists = spans.groupBy("doc_id", "copy").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    joined = keyed(docs).join(lists, ["doc_id", "copy"]).select("doc_id", "copy", "text", "s", "e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut(*r) for r in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            removed, runs, kept = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "copy", "removed", "runs", "kept"])

    return joined.mapInArrow(run, "doc_id long, copy binary, removed long, runs long, kept string").dropDuplicates(["doc_id", "copy"])
