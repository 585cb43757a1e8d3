"""Packing against the tokenizer itself on odd strings."""

import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from chronoflux.llm import packing

ODD = [" ", "\n", "\t", "\r", "\x0b", "\x0c", "\x00", "\x1f", " ", " ", "​", "﻿", "́", "İ", "ß", "Σ", "ς", "É", "é", "ñ", "漢", "字", "한", "😀", "👩‍💻", "a", "b", "THE", "the", "Ing", "x", ".", ",", "-", "'", "...", "<", ">", "</w>", "0", "12", "٠", "½", "퟿", "ﬁ", "Ⅷ"]


def test_ids_of_odd_strings_are_the_tokenizers(spark):
    r, tok = random.Random(8), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["".join(r.choice(ODD) for _ in range(r.randrange(0, 40))) for _ in range(3000)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), longest=16, with_ids=True).collect()
    got = {}
    for x in sorted(rows, key=lambda x: x["start"]):
        assert x["start"] == len(got.setdefault(x["doc_id"], [])) and x["length"] == len(x["ids"]) and x["length"].bit_count() == 1
        got[x["doc_id"]] += x["ids"]
    for i, t in enumerate(texts):
        assert got[i] == [*tok.encode(t, add_special_tokens=False).ids, 1]


def test_words_are_kept_once_and_what_recurs_stays(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    known, tok = packing.Words(path), Tokenizer.from_file(path)
    known.ids(pa.array(["alpha beta gamma"]))
    assert sum(len(d) for d in vars(known).values() if isinstance(d, dict)) == 4  # and the empty one

    monkeypatch.setattr(packing, "KNOWN", 8)
    asked = []
    known = packing.Words(path)
    stems = known._stems
    monkeypatch.setattr(known, "_stems", lambda new: (asked.extend(new), stems(new)))
    for i in range(40):
        text = f"always, the same w{i} x{i}. y{i}!"
        known.trim()
        ids, _ = known.ids(pa.array([text]))
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids
        assert len(known.words) + len(known.older) < 40
    assert asked.count("always") == asked.count("same") == 1


def test_letters_and_marks_are_kept_and_not_the_words_of_them():
    path = public_tokenizers.path("word_bpe_49k.json")
    known, tok = packing.Words(path), Tokenizer.from_file(path)
    text = "Alpha alpha, ALPHA! (alpha) É é. x1, 'tis don't alpha,! beta beta,"
    ids, _ = known.ids(pa.array([text]))
    assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids
    assert set(known.words) == {"", "alpha", ",", "!", "(alpha)", "é", ".", "x1,", "'tis", "don't", ",!", "beta"}
