"""Packing by power-of-two decomposition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Entries of each of a worker's two generations of parts of words, and rows worked on at once: they bound its memory and change no result.
KNOWN, ROWS = 100_000, 512
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
#: Letters that lower case and normal forms map one to one, and marks: the tokenizer cuts between the two.
LETTERS = "".join(chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7))
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class Words:
    """Ids of words, as little-endian unsigned 32-bit integers, kept from batch to batch.

    The tokenizer lower-cases, drops white space, never merges across it and cuts
    a word where letters end, so a text's ids are those of its words in order,
    and a word's are those of its letters and of the marks behind them.  Only these
    parts are kept, in a table of two generations: more than half of a corpus' words
    occur once, and what is not met again goes with the older one.  Words are cut and
    lower-cased by Arrow, each different one of a batch once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of each text's."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        starts, sizes, known = self._words(coded.dictionary)
        word = coded.indices.to_numpy()
        all_ids = known[common.spread(starts[word], sizes[word])]
        ends = np.concatenate([[0], np.cumsum(sizes[word])])
        return all_ids, np.diff(ends[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])])

    def trim(self) -> None:
        if len(self.words) > KNOWN:
            self.words, self.older = {"": b""}, self.words

    def _unknown(self, wanted: set[str]) -> set[str]:
        """What neither generation has; what the older one has moves up."""
        up = wanted & self.older.keys()
        self.words.update((w, self.older[w]) for w in up)
        return wanted - up

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's ids start and how many there are, and the ids."""
        stem = pc.utf8_rtrim(words, MARKS)
        cut = pc.and_(pc.equal(pc.utf8_ltrim(stem, LETTERS), ""), pc.not_equal(stem, ""))
        stem = pc.if_else(cut, pc.utf8_lower(stem), words)
        marks = pc.if_else(cut, pc.utf8_ltrim(words, LETTERS), "")
        coded = pa.concat_arrays([stem, marks]).dictionary_encode()
        different = coded.dictionary.to_pylist()
        found = list(map(self.words.get, different))
        if None in found:
            self._stems(list(self._unknown({p for p, ids in zip(different, found, strict=True) if ids is None})))
            found = list(map(self.words.get, different))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        part = coded.indices.to_numpy().reshape(2, -1).T.ravel()  # a word's letters, then its marks
        ids = np.frombuffer(b"".join(found), dtype="<u4")[common.spread((np.cumsum(sizes) - sizes)[part], sizes[part])]
        sizes = sizes[part].reshape(-1, 2).sum(1)
        return np.cumsum(sizes) - sizes, sizes, ids

    def _stems(self, new: list[str]) -> None:
        alone = [s for s in new if not s.isalpha() or len(s) > 200]
        joined = [s for s in new if s.isalpha() and len(s) <= 200]
        for at in range(0, len(joined), 64):
            part = joined[at : at + 64]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            at_ends = np.flatnonzero(self.ends[ids]) + 1
            if len(at_ends) == len(part) and at_ends[-1] == len(ids):  # one word end each
                self.words.update((s, ids[a:b].tobytes()) for s, a, b in zip(part, [0, *at_ends], at_ends, strict=False))
            else:
                alone += part
        for s in alone:
            self.words[s] = np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()


_kept: dict[str, Words] = {}


def pieces_of(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the pieces of documents of ``sizes`` tokens, one document after another, and how many each has.

    Longest first, each a power of two: whole ones of ``longest``, then the bits of the rest.
    """
    powers = 1 << np.arange(longest.bit_length() - 1, -1, -1, dtype=np.int64)
    times = np.where(powers == longest, sizes[:, None] // longest, sizes[:, None] // powers % 2)
    return np.repeat(np.tile(powers, len(sizes)), times.ravel()), times.sum(1)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ROWS`` rows at a time; a batch is let go before the next one is read."""
    for batch in batches:
        yield from (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))
        del batch


def pack(docs: DataFrame, tokenizer_path: str | None = None, longest: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Cut every document into pieces of power-of-two length; a piece is a sequence.

    A document of n tokens (its ids, then ``end_id``) gives n div ``longest``
    pieces of ``longest`` and one piece for each bit set in the rest.  Sequences
    of one length form a bucket (``bucket`` is its exponent), so batches are made
    of equal lengths, nothing is padded and no sequence crosses documents.  A map
    over rows: no shuffle, memory of one batch.  ``with_ids`` adds the ids.

    Null and empty texts give the one token ``end_id``; repeated rows are packed
    each on its own; an empty table gives no rows.  ``sequence_id`` is unique.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest has to be a power of two")
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
        if path not in _kept:
            _kept[path] = Words(path)
        known = _kept[path]
        for part in _few(batches):
            known.trim()
            ids, sizes = known.ids(part.column(1))
            flat = np.full(len(ids) + len(sizes), end_id, dtype="<u4")
            flat[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
            sizes = sizes + 1
            lengths, pieces = pieces_of(sizes, longest)
            ends = np.cumsum(lengths)
            data = memoryview(flat).cast("B")
            crc = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist(), strict=True)), np.int64, len(ends))
            starts = ends - lengths - np.repeat(np.cumsum(sizes) - sizes, pieces)
            zeros = np.zeros(len(ends), dtype=np.int64)
            cols = [part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), pieces))), *map(pa.array, (starts, lengths, crc, np.repeat(sizes, pieces), zeros, zeros, np.log2(lengths).astype(np.int32)))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32)))] if with_ids else []
            del part  # or it holds its batch while the next one is read
            yield pa.RecordBatch.from_arrays(cols + lists, names + ["ids"] * with_ids)

    return common.documents(docs).mapInArrow(run, schema).withColumn("sequence_id", F.monotonically_increasing_id())


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
