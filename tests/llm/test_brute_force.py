"""Operators that SQL cannot express, against plain loops on a small seeded corpus."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoflux.llm import ann, bwt, knn, lm, packing, simhash, substring, vectors


def corpus(seed=4, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice(["tha", "ne", "é", "ri", "so"]) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    passage = [r.choice(words) for _ in range(120)]
    out = []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randrange(0, 250))]
        if i % 4 == 0:
            at, a, b = r.randrange(len(own) + 1), r.randrange(40), r.randrange(60, 120)
            own[at:at] = passage[a:b]
        text = " ".join(own)
        if i % 9 == 8:
            text = out[-1][1] + (" tail" if i % 2 else "")
        out.append((i, text))
    return out + [(n, "go " * 700), (n + 1, ""), (n + 2, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("cut", [1, 1000])
def test_substring(docs, monkeypatch, cut):
    monkeypatch.setattr(substring, "CUT", cut)
    split = {i: (t or "").encode().split() for i, t in corpus()}
    first = {}
    for i in sorted(split):
        for s in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][s : s + 50]), i)
    want = []
    for i, w in split.items():
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    assert sum(x[2] for x in want) > 500
    assert sorted(map(tuple, substring.dedup(docs).collect())) == sorted(want)




@pytest.mark.parametrize(("shard", "cut"), [(1 << 19, 1000), (2000, 1000), (1 << 19, 2)])
def test_bwt(docs, monkeypatch, shard, cut):
    monkeypatch.setattr(bwt, "SHARD", shard)
    monkeypatch.setattr(bwt, "CUT", cut)
    data = [(i, (t or "").encode()) for i, t in corpus()]
    count = Counter(b[s : s + 400] for _, b in data for s in range(len(b) - 399))
    want = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - 399):
            if count[b[s : s + 400]] > 1:
                gone[s : s + 400] = b"\1" * 400
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert sorted(map(tuple, bwt.dedup(docs).collect())) == sorted(want)


@pytest.mark.parametrize("cut", [1, 3, 1000])
def test_bwt_around_lines_of_every_length(spark, monkeypatch, cut):
    """Shared lines just short of, at and over the length, at text edges too, in groups above the cut."""
    monkeypatch.setattr(bwt, "CUT", cut)
    r = random.Random(7)
    own = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    texts, hit = [], []
    for size in (150, 391, 399, 400, 401, 450, 900):
        line = own(size)
        for k in range(7):
            texts.append(own(r.randrange(0, 300) if k else 0) + line + own(r.randrange(0, 300) if k != 1 else 0))
            hit.append(None if size == 399 else size >= 400)  # neighbours may be equal by chance
    texts += [own(700), "ab" * 900, "xyz" + "ab" * 900, own(450) * 2]
    count = Counter(t[s : s + 400] for t in texts for s in range(len(t) - 399))
    want = []
    for i, t in enumerate(texts):
        gone = {k for s in range(len(t) - 399) if count[t[s : s + 400]] > 1 for k in range(s, s + 400)}
        want.append((i, len(gone), hashlib.sha256("".join(c for k, c in enumerate(t) if k not in gone).encode()).hexdigest()))
    assert all(h is None or (x[1] > 0) == h for x, h in zip(want, hit, strict=False))
    rows = bwt.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["n_removed"], x["kept_sha256"]) for x in rows) == want


def smallest_reachable(n, near):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if near(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


@pytest.mark.parametrize(("leaf", "cut"), [(1024, 4096), (8, 4096), (8, 3)])
def test_simhash_links(spark, monkeypatch, leaf, cut):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "CUT", cut)
    r = np.random.default_rng(5)
    base = r.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64).tolist()
    masks = [0, 1, 1 << 63, (1 << 20) | (1 << 40), 0b111 << 30, 0b1111 << 50, *(sum(1 << int(k) for k in r.choice(64, n, replace=False)) for n in (1, 2, 3, 3, 3, 4, 5))]
    fps = sorted({b ^ int(np.uint64(m).view(np.int64)) for b in base for m in masks})
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, id long")
    got = {frozenset(x) for x in simhash.links(df).collect()}
    near = lambda a, b: ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 3
    assert smallest_reachable(len(fps), lambda a, b: frozenset((a, b)) in got) == smallest_reachable(len(fps), near)
    if leaf == 8:  # the trees split, and no more rows cross a boundary than have to
        sizes = simhash.shards(df, 3, 2).groupBy("band", "leaf").count().toPandas()["count"]
        assert sizes.max() < len(fps) / 3 and sizes.sum() < 12 * len(fps)


@pytest.mark.parametrize("small", [0, 1024])
def test_simhash_leaves_are_balanced(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "LEAF", 64)
    monkeypatch.setattr(simhash, "SMALL", small)
    r = np.random.default_rng(8)
    centres = r.integers(-(1 << 63), 1 << 63, 30, dtype=np.int64)
    noise = np.packbits(r.random((6000, 64)) < 0.15, axis=1).view(np.int64)[:, 0]
    fps = np.unique(np.concatenate([centres[r.integers(0, 30, 6000)] ^ noise, r.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64)]))
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps.tolist())], "fp long, id long")
    sizes = simhash.shards(df, 3, 2).groupBy("band", "leaf").count().toPandas()["count"]
    assert sizes.max() <= 2 * 64 and sizes.sum() < 12 * len(fps)


def test_simhash_components_of_texts(spark):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    texts = []
    for _ in range(25):
        own = [r.choice(words) for _ in range(r.randrange(40, 300))]
        for edits in (0, 0, 1, 1, 2, 4):
            copy = list(own)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy).upper() if edits == 1 else " ".join(copy))
    texts += ["", "  ", "one", "One two"]
    r.shuffle(texts)
    fp = []
    for t in texts:
        w = t.lower().split()
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        fp.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    want = smallest_reachable(len(texts), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert 30 < len(set(want)) < 120
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_simhash_fingerprints(docs):
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(docs).collect()}
    for i, t in corpus():
        w = (t or "").lower().split()
        hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        assert got[i] == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_language_model(docs):
    p = {r["doc_id"]: r for r in lm.score(docs, frequent=100).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in corpus()}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        base = sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert p[i]["base_score"] == pytest.approx(base) and p[i]["n_tokens"] == len(ws) and p[i]["n_known"] == sum(count[w] > 0 for w in ws)
        assert p[i]["train_tokens"] == n and p[i]["score"] < 0


def test_packing_round_trip(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs, longest=64, with_ids=True).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["length"] == len(r["ids"]) and r["length"].bit_count() == 1 and r["length"] <= 64 for r in rows)
    for i, t in corpus():
        own = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == i)
        assert [x for _, ids in own for x in ids] == [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def test_vector_search(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    ints = np.floor(x.astype(float) * 256).astype(np.int64)
    want = []
    for q in range(0, 400, 50):
        s = ints[q] @ ints.T
        order = [j for j in np.lexsort((np.arange(400), -s)).tolist() if j != q][:5]
        want += [(q, k + 1, j, int(s[j])) for k, j in enumerate(order)]
    assert sorted(map(tuple, knn.top_k(df).collect())) == want


@pytest.mark.parametrize("clusters", [0, 60])
def test_approximate_search_finds_most_and_reads_few_lists(spark, monkeypatch, clusters):
    """Recall against brute force where far more lists are there than are read, on noise and on clusters."""
    r = np.random.default_rng(6)
    x = (r.normal(size=(6000, 12)) + (5 * r.normal(size=(clusters, 12))[r.integers(0, clusters, 6000)] if clusters else 0)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    met, plain = [], vectors.meet

    def counted(rows, asked, solve, kind):
        q = asked.groupBy("cell").agg(F.count("*").alias("q"))
        met.append(rows.groupBy("cell").agg(F.count("*").alias("n")).join(q, "cell").agg(F.sum(F.col("n") * F.col("q")), F.max("n")).first())
        return plain(rows, asked, solve, kind)

    monkeypatch.setattr(vectors, "meet", counted)
    near = {}
    for row in ann.search(df).collect():
        near.setdefault(row["query_id"], set()).add(row["vec_id"])
        assert row["score"] == pytest.approx(np.sqrt(((x[row["query_id"]].astype(float) - x[row["vec_id"]].astype(float)) ** 2).sum()))
    hits = 0
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(near[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 600 and met[0][0] < 0.25 * 60 * 6000 and met[0][1] < 8 * 16
    met.clear()
    if clusters:  # and the exact join prunes
        knn.top_k(df).count()
        assert sum(m[0] or 0 for m in met) < 0.5 * 120 * 6000


def test_exact_search_sends_a_query_once_to_a_cell(spark, monkeypatch):
    """Where no bound prunes, queries sent grow with pivots and not rings, in small batches, and only scores that reach the bound come back."""
    r = np.random.default_rng(7)
    x = r.normal(size=(6000, 16))
    x[100:140] = x[3000]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    met, plain = [], vectors.meet

    def meet(rows, asked, *more):
        sizes = asked.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
        found = plain(rows, asked, *more)
        met.append((sum(r["n"] for r in sizes.collect()), found.count()))
        return found

    monkeypatch.setattr(vectors, "meet", meet)
    got = sorted(map(tuple, knn.top_k(df, every=50, pivots=32).collect()))
    ints = np.floor(x * 256).astype(np.int64)
    want = []
    for q in range(0, 6000, 50):
        s = ints[q] @ ints.T
        want += [(q, k + 1, j, int(s[j])) for k, j in enumerate([j for j in np.lexsort((np.arange(6000), -s)).tolist() if j != q][:5])]
    assert got == want
    assert met[0][0] == 120 * 2 and met[1][0] <= 120 * 30 and met[1][1] < 120 * 30  # queries sent; pairs returned


def test_exact_search_of_large_components(spark):
    """Components that no short integer holds."""
    x = np.random.default_rng(8).normal(size=(200, 4)) * 1e5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ints = np.floor(x * 256).astype(np.int64)
    for row in knn.top_k(df, k=1).collect():
        s = ints[row["query_id"]] @ ints.T
        s[row["query_id"]] = -(1 << 62)
        assert (row["vec_id"], row["score"]) == (int(s.argmax()), int(s.max()))
