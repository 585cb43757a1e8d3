"""Operators without SQL against plain loops, and the edges of the joins."""

import random

from chronoflux.operators import evidence, joins, matching

SCHEMA = "track_id long, id long, t double"


def _events(spark, seed, n, tracks=3):
    r = random.Random(seed)
    return spark.createDataFrame([(r.randrange(tracks), i, round(r.uniform(0, 12), 2)) for i in range(n)], SCHEMA)


def test_asof_carries_over_empty_cells_and_ties(spark):
    facts = spark.createDataFrame([(1, 5, 0.5), (1, 6, 90.0)], SCHEMA)
    asked = spark.createDataFrame([(1, 1, 0.5), (1, 2, 80.0), (1, 3, 0.1), (2, 4, 1.0)], SCHEMA)
    back = {r["id"]: r["f"]["id"] if r["f"] else None for r in joins.asof(asked, facts, "f").collect()}
    ahead = {r["id"]: r["f"]["id"] if r["f"] else None for r in joins.asof(asked, facts, "f", forward=True, strict=True).collect()}
    assert back == {1: 5, 2: 5, 3: None, 4: None}
    assert ahead == {1: 6, 2: 6, 3: 5, 4: None}


def test_two_pointer_matches_a_loop(spark):
    a, b = _events(spark, 1, 60), _events(spark, 2, 70)
    got = {r["track_id"]: r["matched"] for r in evidence.match_counts(a, b, 0.15).collect()}
    for track in got:
        x, y = (sorted(r["t"] for r in d.collect() if r["track_id"] == track) for d in (a, b))
        i = j = n = 0
        while i < len(x) and j < len(y):
            if abs(x[i] - y[j]) <= 0.15:
                i, j, n = i + 1, j + 1, n + 1
            elif x[i] < y[j]:
                i += 1
            else:
                j += 1
        assert got[track] == n


def test_capped_groups_match_a_loop(spark):
    rows = _events(spark, 3, 200)
    got = sorted((r["track_id"], r["t0"], r["n"]) for r in evidence.capped_groups(rows, 0.18, 0.5, 2).collect())
    want = []
    for track in range(3):
        ts = sorted(r["t"] for r in rows.collect() if r["track_id"] == track)
        groups = []
        for t in ts:
            if groups and t - groups[-1][-1] <= 0.18 and t - groups[-1][0] <= 0.5:
                groups[-1].append(t)
            else:
                groups.append([t])
        want += [(track, g[0], len(g)) for g in groups if len(g) >= 2]
    assert got == sorted(want)


def _tracks(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["track_id"], []).append((r["t"], r["id"]))
    return {k: sorted(v) for k, v in out.items()}


def test_one_to_one_matches_equal_loops(spark):
    a, b, tol = _events(spark, 4, 90), _events(spark, 5, 110), 0.17
    x, y = _tracks(a), _tracks(b)
    for by in ("distance", "earlier", "later"):
        got = sorted((r["track_id"], r["id"], r["other_id"]) for r in matching.match(a, b, tol, by).collect())
        want = []
        for track in x:
            pairs = [(abs(t - u), t, i, u, j) for t, i in x[track] for u, j in y.get(track, []) if abs(t - u) <= tol]
            sign = -1 if by == "later" else 1
            pairs.sort(key=(lambda p: p) if by == "distance" else lambda p, s=sign: (p[1], p[2], p[0], s * p[3], p[4]))
            left, right = set(), set()
            for _, _, i, _, j in pairs:
                if i not in left and j not in right:
                    left.add(i)
                    right.add(j)
                    want.append((track, i, j))
        assert got == sorted(want), by


def test_suppression_and_collapse_equal_loops(spark):
    r = random.Random(6)
    rows = [(r.randrange(2), float(t), float(r.randrange(6))) for t in r.sample(range(300), 120)]
    got = sorted(map(tuple, matching.suppress_close(spark.createDataFrame(rows, "track_id long, t double, x double"), 4.0).collect()))
    want = []
    for track in range(2):
        kept = []
        for _, t, x in sorted((p for p in rows if p[0] == track), key=lambda p: (-p[2], -p[1])):
            if all(abs(t - k) > 4 for k, _ in kept):
                kept.append((t, x))
        want += [(track, *k) for k in kept]
    assert got == sorted(want)
    marks = _events(spark, 7, 150)
    got = sorted(map(tuple, matching.collapse_simultaneous(marks, 0.2).collect()))
    want = []
    for track, ts in _tracks(marks).items():
        last = None
        for t, _ in ts:
            if last is None or t - last > 0.2:
                want.append((track, t))
                last = t
    assert got == sorted(want)
