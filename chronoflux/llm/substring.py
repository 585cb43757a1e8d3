"""Substring dedup by suffix automata of reference passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, common

EMPTY = hashlib.sha256(b"").hexdigest()
#: Different passages of a reference shard; shards of more are split.
CUT = 1000


class Automaton:
    """Suffix automaton over integers; passages are kept apart by symbols of their own."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last, self.apart = [-1], [0], 0, 0

    def add(self, passage: list[int]) -> None:
        self.apart += 1
        for symbol in (*passage, ("|", self.apart)):
            self._extend(symbol)

    def _extend(self, symbol: object) -> None:
        nxt, link, length = self.next, self.link, self.length
        now, p = len(nxt), self.last
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = clone
                    p = link[p]
                link[q] = link[now] = clone
        self.last = now

    def matched(self, passage: list[int]) -> list[int]:
        """Matching statistics: the longest suffix of passage[: i + 1] that occurs, for every i."""
        nxt, link, length = self.next, self.link, self.length
        state, have, found = 0, 0, []
        for symbol in passage:
            while state and symbol not in nxt[state]:
                state = link[state]
                have = length[state]
            if symbol in nxt[state]:
                state = nxt[state][symbol]
                have += 1
            found.append(have)
        return found


def repeated(rows: list[tuple[int, bytes]], length: int) -> list[np.ndarray]:
    """For each (doc_id, passage), starts of windows that a smaller doc_id's passage has too."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(rows)
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    automaton, seen, waiting, at = Automaton(), set(), [], 0
    while at < len(order):
        end = at
        while end < len(order) and rows[order[end]][0] == rows[order[at]][0]:
            end += 1
        own = [(k, rows[k][1]) for k in order[at:end]]
        for k, data in own:
            n = len(data) // 8 - length + 1
            if data in seen:
                out[k] = np.arange(n)
            elif seen:
                for d in waiting:
                    automaton.add(np.frombuffer(d, np.int64).tolist())
                waiting = []
                ends = np.flatnonzero(np.array(automaton.matched(np.frombuffer(data, np.int64).tolist())) >= length)
                out[k] = ends - length + 1
        for data in dict.fromkeys(d for _, d in own):
            if data not in seen:
                seen.add(data)
                waiting.append(data)
        at = end
    return out


def _hashes(text: str) -> np.ndarray:
    parts = text.encode().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))


def _read(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    split = [t.encode().split() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in split], dtype=np.int64)])
    units = np.fromiter((xxhash.xxh64_intdigest(w) for s in split for w in s), np.uint64, int(offsets[-1]))
    return units, offsets, [hashlib.sha256(b" ".join(s)).digest() for s in split]


def _cut(text: str, starts: list[int], ends: list[int]) -> tuple[int, int, str]:
    parts = text.encode().split()
    keep = anchors.kept_mask(len(parts), starts, ends)
    kept = b" ".join([p for p, k in zip(parts, keep.tolist(), strict=True) if k])
    runs = int((np.diff(np.concatenate([[True], keep]).astype(int)) < 0).sum())
    return int((~keep).sum()), runs, hashlib.sha256(kept).hexdigest()


def dedup(docs: DataFrame, length: int = 50, k: int = 8) -> DataFrame:
    """Words covered by a window of ``length`` words that starts in a smaller doc_id too.

    One pass finds the anchors of all windows.  Passages around anchors that more
    than one document has are the references: a shard is the passages of an anchor,
    and in it each document, smallest id first, is streamed through the suffix
    automaton of those before it; wherever the matching statistic reaches
    ``length``, a window repeats.  Shards are sent to the task that streams them by
    a shuffle, not to every task: all references together have no size bound.
    Passages of one content are one reference with its smallest doc_id, and shards
    of too many are split (see ``anchors``).  Copies of a whole text are known by
    their hash, and only the smallest id is searched.

    Returns ``doc_id, n_words, n_removed, kept_sha256``, a row per input row.  Null,
    empty and short texts lose nothing; rows that share a doc_id are not smaller
    than each other; an empty table gives no rows.
    """
    first = common.written(anchors.first_pass(docs, _read, length, k), "substring")
    copies = common.written(first.groupBy("copy").agg(F.min("doc_id").alias("rep")), "copies")
    first = first.join(copies, "copy")

    def solve(groups: Iterator[pa.Table]) -> Iterator[tuple[bytes, np.ndarray]]:
        for rows in groups:
            key, cid, data, lo = (rows.column(c).to_pylist() for c in (0, 1, 2, 4))
            at = 0
            while at < len(key):
                end = at
                while end < len(key) and key[end] == key[at]:
                    end += 1
                for i, starts in enumerate(repeated(list(zip(lo[at:end], data[at:end], strict=True)), length), at):
                    if len(starts):
                        yield cid[i], starts
                at = end

    search = anchors.Search(length, k, CUT, "low < high", _hashes, lambda d: np.frombuffer(d, np.uint64), "own > lo", solve)
    spans = anchors.matches(docs, first.where("doc_id = rep"), search)
    cut = common.written(anchors.digests(docs, spans, _cut), "cut")
    whole_copy = (F.col("doc_id") > F.col("rep")) & (F.col("n") >= length)
    return first.select("doc_id", "copy", "n", "whole", "rep").join(cut, ["doc_id", "copy"], "left").select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(whole_copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole_copy, F.lit(EMPTY)).otherwise(F.coalesce("kept", F.lower(F.hex("whole")))).alias("kept_sha256"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"))
