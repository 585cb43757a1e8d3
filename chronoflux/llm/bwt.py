"""Repeated byte strings by merging shard Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, common

EMPTY = hashlib.sha256(b"").hexdigest()
#: Different passages of a group that meet in a task; groups of more are split.
CUT = 2000
#: Bytes of a shard whose transform is built on its own, and of shards merged at once.
SHARD, MERGED = 1 << 19, 1 << 20
#: Letters of the transforms' alphabet are blocks of a fourth of the string's length.
DEPTH = 4


def _same(data: np.ndarray, letter: np.ndarray, valid: np.ndarray, block: int) -> bool:
    """Whether equal letters are equal blocks, byte for byte.

    A block is held against the first one of its letter.  Where the blocks a byte
    before also have one letter, both are equal to a third, and only the last byte
    is left to compare.
    """
    at = np.flatnonzero(valid)
    order = at[np.argsort(letter[at], kind="stable")]
    new = np.concatenate([[True], letter[order][1:] != letter[order][:-1]]) if len(order) else np.empty(0, bool)
    first = np.empty(len(data), np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    x = at[first[at] != at]
    r = first[x]
    chained = (x > 0) & (r > 0)
    chained &= valid[x - 1] & valid[r - 1] & (letter[x - 1] == letter[r - 1])
    if (data[x[chained] + block - 1] != data[r[chained] + block - 1]).any():
        return False
    x, r, step = x[~chained], r[~chained], np.arange(block)
    return all((data[x[k : k + 4096, None] + step] == data[r[k : k + 4096, None] + step]).all() for k in range(0, len(x), 4096))


def _letters(passages: list[bytes], block: int) -> np.ndarray:
    """A letter for the block at every byte of all passages; equal letters are equal bytes."""
    data = np.frombuffer(b"".join(passages), np.uint8)
    sizes = np.array([len(p) for p in passages])
    valid = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) <= np.repeat(sizes, sizes) - block
    for salt in range(4):
        letter = anchors.grams(anchors.byte_units(data, salt), block) | np.uint64(1 << 63)
        letter = np.concatenate([letter, np.zeros(len(data) - len(letter) + 1, np.uint64)])
        if _same(data, letter, valid, block):
            return letter
    raise ArithmeticError("no hash tells the blocks apart")


def _transform(sizes: np.ndarray, letter: np.ndarray, block: int, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's transform over blocks: letter before each suffix, suffix in order, row of each.

    A suffix starts at any byte and goes on block by block; one with less than a
    block left is an end, and ends are all different.  Letters are block hashes;
    numbers below 2^63 stand for ends: the shard's number.
    """
    row = np.repeat(np.arange(len(sizes)), sizes + 1)  # each passage has an end of no bytes too
    starts = np.cumsum(sizes) - sizes
    place = common.spread(np.zeros(len(sizes), np.int64), sizes + 1)
    left, where = sizes[row] - place, starts[row] + place
    own = np.arange(len(row)).astype(np.uint64)
    keys = [np.where(left >= (j + 1) * block, letter[np.minimum(where + j * block, len(letter) - 1)], own) for j in range(DEPTH)]
    order = np.lexsort(keys[::-1])
    before = np.where(place >= block, letter[np.maximum(where - block, 0)], np.uint64(shard))
    return before[order], place[order], row[order]


def _merge(transforms: list[np.ndarray]) -> list[np.ndarray]:
    """Interval number of every suffix of every shard: equal where ``DEPTH`` blocks are.

    The interleave of the shards starts as one after another; each refinement reads
    the letters in the present order and deals suffixes out by letter, keeping order
    among equals, so it is sorted by one more block.  Two neighbours share a prefix
    one block longer where the letters are equal and the suffixes behind them stood
    in one interval: common prefixes come with the interleave, and no suffix is
    compared or sorted again.
    """
    source = np.repeat(np.arange(len(transforms), dtype=np.int32), [len(t) for t in transforms])
    interval, ends = np.zeros(len(source), np.int64), np.uint64(len(transforms))
    for _ in range(DEPTH):
        letters = np.empty(len(source), np.uint64)
        for k, t in enumerate(transforms):
            letters[source == k] = t
        order = np.argsort(letters, kind="stable")
        letters, behind, source = letters[order], interval[order], source[order]
        new = (letters[1:] != letters[:-1]) | (behind[1:] != behind[:-1]) | (letters[1:] < ends)
        interval = np.concatenate([[0], np.cumsum(new)])
    return [interval[source == k] for k in range(len(transforms))]


def repeated(passages: list[bytes], times: list[int], length: int) -> list[np.ndarray]:
    """Starts of the ``length``-byte strings of each passage that start anywhere else too.

    Passages are different, and each occurs ``times`` times.
    """
    shards: list[list[int]] = [[]]
    size = 0
    for k, p in enumerate(passages):
        if size + len(p) > SHARD and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(k)
        size += len(p)
    letter, sizes = _letters(passages, length // DEPTH), np.array([len(p) for p in passages])
    ends = np.cumsum(sizes)
    built = [_transform(sizes[s], letter[ends[s[0]] - sizes[s[0]] : ends[s[-1]] + 1], length // DEPTH, n) for n, s in enumerate(shards)]
    intervals = _merge([b[0] for b in built])
    often = np.array(times)
    count = np.bincount(np.concatenate(intervals), np.concatenate([often[s][row] for s, (_, _, row) in zip(shards, built, strict=True)]))
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(passages)
    for own, (_, place, row), interval in zip(shards, built, intervals, strict=True):
        hit = np.flatnonzero((count[interval] > 1) & (place <= sizes[own][row] - length))
        hit = hit[np.lexsort((place[hit], row[hit]))]
        cuts = np.searchsorted(row[hit], np.arange(len(own) + 1))
        for n, k in enumerate(own):
            out[k] = place[hit[cuts[n] : cuts[n + 1]]]
    return out


def _read(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data], dtype=np.int64)])
    return anchors.byte_units(np.frombuffer(b"".join(data), np.uint8)), offsets, [hashlib.sha256(d).digest() for d in data]


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _cut(text: str, starts: list[int], ends: list[int]) -> tuple[int, int, str]:
    data = _bytes(text)
    keep = anchors.kept_mask(len(data), starts, ends)
    runs = int((np.diff(np.concatenate([[True], keep]).astype(int)) < 0).sum())
    return int((~keep).sum()), runs, hashlib.sha256(data[keep].tobytes()).hexdigest()


def dedup(docs: DataFrame, length: int = 400, k: int = 32) -> DataFrame:
    """Bytes covered by a string of ``length`` bytes that also starts anywhere else.

    One pass finds the anchors of all strings.  Passages whose anchor comes more
    than once are dealt out by anchor, groups of too many are split (see
    ``anchors``); a task takes its passages in shards, builds each shard's
    Burrows-Wheeler transform and merges the transforms by refining their
    interleave.  The alphabet is blocks of ``length`` / 4 bytes at every phase, so
    four refinements sort by ``length`` bytes; only equal prefixes count, so blocks
    are ordered by hash, and blocks of one hash are compared byte by byte.
    Passages equal as a whole are merged once and all their strings repeat.  Texts
    with a copy repeat as a whole, known by hash.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, a row per input
    row.  Null, empty and short texts lose nothing; repeated rows are copies of each
    other; an empty table gives no rows.  ``length`` has to divide by 4.
    """
    if length % DEPTH:
        raise ValueError("length has to be a multiple of 4")
    first = common.written(anchors.first_pass(docs, _read, length, k), "bytes")
    copies = common.written(first.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "copies")
    first = first.join(copies, "copy")

    def solve(groups: Iterator[pa.Table]) -> Iterator[tuple[bytes, np.ndarray]]:
        def solved(cid: list[bytes], data: list[bytes], n: list[int]) -> Iterator[tuple[bytes, np.ndarray]]:
            return ((c, starts) for c, starts in zip(cid, repeated(data, n, length), strict=True) if len(starts))

        own: tuple[list, list, list] = ([], [], [])
        size = 0
        for rows in groups:
            key = rows.column(0).to_numpy()
            ends = [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip([0, *ends], ends, strict=False):
                for column, k in zip(own, (1, 2, 3), strict=True):
                    column.extend(rows.column(k).slice(a, b - a).to_pylist())
                size += sum(map(len, own[1][a - b :]))
                if size > MERGED:
                    yield from solved(*own)
                    own, size = ([], [], []), 0
        if own[0]:
            yield from solved(*own)

    search = anchors.Search(length, k, CUT, "n > 1", _bytes, lambda d: anchors.byte_units(np.frombuffer(d, np.uint8)), "n > 1", solve)
    spans = anchors.matches(docs, first.where("doc_id = rep"), search)
    cut = common.written(anchors.digests(docs, spans, _cut), "cut")
    whole_copy = (F.col("copies") > 1) & (F.col("n") >= length)
    zero = F.lit(0)
    return first.select("doc_id", "copy", "n", "whole", "copies").join(cut, ["doc_id", "copy"], "left").select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(whole_copy, F.col("n")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(whole_copy, F.lit(1)).otherwise(F.coalesce("runs", zero)).cast("long").alias("n_spans"),
        F.when(whole_copy, F.lit(EMPTY)).otherwise(F.coalesce("kept", F.lower(F.hex("whole")))).alias("kept_sha256"),
    )


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"))
