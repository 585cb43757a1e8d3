"""Spelling variants, vector near duplicates and the prefix trie against plain loops and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chronoflux.llm import flatgraph, trie, variants

WORD = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(texts):
    n = Counter()
    for i, t in texts:
        for run in WORD.findall(t or "") if i is not None else []:
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    close = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in close.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(close[w]), n[form[w]] if w in form else None) for w in n)


@pytest.mark.parametrize(("rows", "asked"), [(2048, 4096), (3, 5)])
def test_spelling_variants(spark, monkeypatch, rows, asked):
    monkeypatch.setattr(variants, "ROWS", rows)
    monkeypatch.setattr(variants, "ASKED", asked)
    r = random.Random(5)
    base = ["".join(r.choice("abcdeéÿÀ") for _ in range(r.randrange(6, 10))) for _ in range(40)]
    base += [base[0] + "a", "a" + base[0], base[1][::-1], "x" * 40, "x" * 41, "abcdefg" * 300, "abcdefg" * 300 + "h"]
    texts = [(i, " ".join(w.upper() if r.random() < 0.1 else w for w in r.choices(base, [1 + (k % 7 == 0) * 60 for k in range(len(base))], k=90)) + "5x") for i in range(60)]
    texts += [(100, None), (101, ""), (None, base[0]), (102, " ".join([base[0]] * 200)), (102, " ".join([base[0]] * 200))]
    want = plain_variants(texts)
    assert sum(w[1] is not None for w in want) > 5 and any(w[4] > 1 for w in want)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, word string, n int").repartition(3)
    got = sorted(map(tuple, variants.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == want


def test_forms_follow_to_the_last(spark):
    words = [("a" * 7, 2), ("a" * 8, 30), ("a" * 9, 400), ("a" * 10, 5000)]
    df = spark.createDataFrame([(0, " ".join(w for w, n in words for _ in range(n)))], "doc_id long, text string")
    got = {x["word"]: x["root"] for x in variants.variants(df).collect() if zlib.crc32(f"0:{x['word']}".encode()) % 31}
    assert got["a" * 7] == "a" * 10


@pytest.mark.parametrize("block", [2048, 40])
def test_vector_links(spark, monkeypatch, block):
    """Noise, pairs about the threshold, a chain, a dense group, copies and unusable rows."""
    monkeypatch.setattr(flatgraph, "BLOCK", block)
    monkeypatch.setattr(flatgraph, "MEANT", 120)
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 16))
    turned = [c * v / np.linalg.norm(v) + np.sqrt(1 - c * c) * (u := np.linalg.qr(np.stack([v, w], 1))[0][:, 1]) / np.linalg.norm(u) for c, v, w in zip(np.tile([0.89, 0.92, 0.97], 20), x, r.normal(size=(60, 16)), strict=False)]
    dense = x[100] + 0.15 * r.normal(size=(80, 16))
    chain = [np.concatenate([[np.cos(0.3 * k), np.sin(0.3 * k)], np.zeros(14)]) for k in range(12)]
    v = [*x, *turned, *dense, *chain, *[x[7]] * 30, x[7] * 1e200, x[8] * 1e-200]
    rows = [(i, a.tolist()) for i, a in enumerate(v)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, []), (2004, [None] * 16), (None, x[0].tolist()), (3, x[3].tolist())]
    df = spark.createDataFrame([(i, a, 1, "x") for i, a in rows], "vec_id long, embedding array<double>, node int, copy string").repartition(3)
    ids = np.array([*range(len(v)), 3])
    u = flatgraph.unit(np.array([*v, x[3]]))
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    root = ids.copy()
    while True:
        new = np.minimum(root, np.where(link, root[None, :], 1 << 40).min(1))
        if (new == root).all():
            break
        root = new
    got = sorted(map(tuple, flatgraph.near_duplicates(df).collect()))
    want = sorted([*zip(ids.tolist(), link.sum(1).tolist(), root.tolist(), (ids == root).tolist(), strict=True), *((i, 0, i, True) for i in range(2000, 2005))])
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) > 0.97
    assert flatgraph.near_duplicates(df.where("vec_id < 0")).collect() == []


def test_flat_graph_walks_find_the_nearest():
    r = np.random.default_rng(3)
    v = flatgraph.unit(r.normal(size=(1500, 24)) + 2 * r.normal(size=(30, 24))[r.integers(0, 30, 1500)])
    g = flatgraph.FlatGraph(v).build()
    ids, _, seen = g.walk(v[:200].astype(np.float32))
    assert (ids[:, 0] == np.arange(200)).mean() > 0.97 and seen.mean() < 0.4
    true = v[:200] @ v.T >= 0.9
    i, j = g.within(v[:200], 0.9)
    assert len(set(zip(i.tolist(), j.tolist(), strict=True))) >= 0.97 * true.sum()


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    nodes = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        ended = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], sum(not kids[q] for q in below), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "most"), [(14, 22), (2, 2)])
def test_prefix_trie(spark, monkeypatch, least, most):
    """With counters to spare, and with so few that nearly everything looks shared."""
    monkeypatch.setattr(trie, "LEAST_BITS", least)
    monkeypatch.setattr(trie, "MOST_BITS", most)
    r = random.Random(3)
    rows = []
    for c in [0, 1, 2, 3, 7, 55, 100, 101, 150, 199, 250, 251, 252, 300, 333, 401, 402]:
        same = r.random() < 0.5
        for k in range(r.randrange(1, 9)):
            rows.append((c, k, "user" if k % 2 == 0 else "bot", f"hi {k}" if same else r.choice(["a", "bb", "ccc"])))
    rows += [(c, 0, "user", "one") for c in range(500, 540)]
    rows += [(600, None, "u", "null first"), (600, 1, None, None), (600, 1, "u", "é𝒳"), (600, 1, "u", "é𝒳"), (600, 0, "", ""), (None, 1, "u", "gone"), (601, None, None, None)]
    rows += [(c, k, "u", f"long {k}") for c in (700, 701, 702) for k in range(60)] + [(701, 60, "u", "more")]
    want = plain_trie(rows)
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "conv_id long, turn long, role string, text string, depth int, part string").repartition(3)
    assert sorted(map(tuple, trie.trie(df).collect()), key=repr) == want
    assert trie.trie(df.where("conv_id < 0")).collect() == []


def test_prefix_trie_of_one_conversation(spark):
    rows = [(301, k, "u", "x") for k in range(9)]
    got = trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == plain_trie(rows)
