"""Folds and streams that SQL does not express, against plain loops."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from chronoflux.operators import corpora, forms, scores, tempo
from chronoflux.sources import projects
from chronoflux.streaming import activity


def times(seed=1, n=120, tracks=3, step=1.0):
    r = random.Random(seed)
    out = []
    for k in range(tracks):
        t = 0.0
        for _ in range(n if k else 2):
            t = round(t + r.choice([0.3, 0.6, 1.0, 1.0, 1.0, 1.1, 2.0, 2.1, 5.0]) * step, 3)
            out.append((k, t))
    return out


def by_track(rows):
    out = {}
    for k, *v in rows:
        out.setdefault(k, []).append(v[0] if len(v) == 1 else tuple(v))
    return out


def test_repair_beats(spark):
    rows = times()
    got = sorted(map(tuple, tempo.repair_beats(spark.createDataFrame([*rows, rows[0]], "track_id long, t double"), 1.0).collect()))
    want = []
    for k, ts in by_track(rows).items():
        kept = []
        for t in sorted(set(ts)):
            if not kept or t - kept[-1] >= 0.55:
                kept.append(t)
        want += [(k, t, False) for t in kept] + [(k, a + (b - a) / 2, True) for a, b in zip(kept, kept[1:], strict=False) if 1.65 < b - a < 2.35]
    assert got == [pytest.approx(w) for w in sorted(want)]


def median(xs):
    s = sorted(xs)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


def plain_curve(logs, change, longest):
    n, hub = len(logs), lambda u: u * u / 2 if u <= 1 else u - 0.5
    best = {0: (0.0, 0, [])}
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            if 0 < i and j < n and j - i < 4 or i not in best:
                continue
            m = median(logs[i:j])
            cost = best[i][0] + sum(hub(abs(x - m) / 0.05) for x in logs[i:j]) + (1.5 * (1 - 0.8 * change[i]) if i else 0)
            own = (cost, best[i][1] + 1, [*best[i][2], (i, j)])
            if j not in best or own[0] < best[j][0] - 1e-12 or (own[0] <= best[j][0] + 1e-12 and own[1] < best[j][1]):
                best[j] = own
    return best[n][2]


@pytest.mark.parametrize("longest", [256, 7])
def test_tempo_segments(spark, monkeypatch, longest):
    monkeypatch.setattr(tempo, "LONGEST", longest)
    r = random.Random(2)
    rows, want = [], []
    for k in range(4):
        t, ts = 0.0, [0.0]
        for bpm, n in ((120, 12), (121, 6), (90, 15), (60 * (1 + k), 9))[: k + 1]:
            for _ in range(n):
                t += 60 / bpm * r.choice([1, 1, 1.01, 0.99, 1.2])
                ts.append(round(t, 4))
        change, emit = [r.random() for _ in ts], [r.random() * 1.2 for _ in ts]
        rows += [(k, x, c, e) for x, c, e in zip(ts, change, emit, strict=True)]
        bpm = [60 / (b - a) for a, b in zip(ts, ts[1:], strict=False)]
        logs = [math.log2(median(bpm[max(0, i - 1) : i + 2])) for i in range(len(bpm))]
        merged = []
        for i, j in plain_curve(logs, change, longest):
            merged.append([i, j])
            while len(merged) > 1 and abs(median(logs[merged[-1][0] : merged[-1][1]]) - median(logs[merged[-2][0] : merged[-2][1]])) < 0.02:
                last = merged.pop()
                merged[-1][1] = last[1]
        for n, (i, j) in enumerate(merged, 1):
            want.append((k, n, 0.0 if i == 0 else ts[i], 99.0 if j == len(bpm) else ts[j], 2 ** median(logs[i:j]), round(sum(min(1, e) for e in emit[i:j]) / (j - i), 4)))
    df = spark.createDataFrame([*rows, (0, None, 0.5, 0.5), rows[0], (9, 1.0, 0.1, 0.1)], "track_id long, t double, change double, emission double").repartition(3)
    ends = spark.createDataFrame([(k, 99.0) for k in range(10)], "track_id long, duration double")
    got = [tuple(x) for x in tempo.tempo_segments(df, ends).orderBy("track_id", "n").collect()]
    assert got == [pytest.approx(w) for w in want] and any(w[1] > 1 for w in want)


def test_long_tracks_take_time_in_proportion(spark):
    """A track of many beats: state is a window, so twenty times the beats may not take much over twenty times the time."""
    import time

    def took(n):
        df = spark.range(n).select(F.lit(1).alias("track_id"), (F.col("id") * 0.5 + (F.col("id") % 7) * 0.001).alias("t")).cache()
        df.count()
        began = time.time()
        assert tempo.repair_beats(df, 0.5).count() == n
        assert tempo.beat_chain(df.select("track_id", F.floor(F.col("t") * 100).alias("frame"), F.lit(0.5).alias("support")), 50.0).count() == n
        assert tempo.tempo_segments(df).count() >= 1
        return time.time() - began

    took(1000)
    short, long = took(1000), took(20000)
    assert long < 25 * short + 10


def test_tempo_path_is_the_cheapest_of_all(spark):
    r = random.Random(3)
    rows = [(0, 10 * a, float(b), r.random(), 0) for a in range(5) for b in r.sample(range(60, 200, 7), 3)]
    got = [x["bpm"] for x in tempo.tempo_path(spark.createDataFrame(rows, "track_id long, anchor long, bpm double, score double, origin int"), 120.0).orderBy("anchor").collect()]
    steps = [[(b, s) for _, a, b, s, _ in rows if a == 10 * i] for i in range(5)]
    best = [max(s, key=lambda c: (c[1], -abs(math.log2(c[0] / 120)), -c[0]))[0] for s in steps]
    raw = [0.0] * 5
    for i in range(1, 5):
        left, right = sorted(best[max(0, i - 2) : i]), sorted(best[i : i + 3])
        med = lambda x: (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
        a, b = med(left), med(right)
        agree = lambda xs, m: sum(abs(math.log2(x / m)) <= 0.06 for x in xs)
        raw[i] = min(1, max(0, (abs(math.log2(b / a)) - 0.025) / 0.12)) * min(1, min(agree(left, a), agree(right, b)) / 2)
    lam = [0.6 * (1 - 0.75 * (min(raw[i], raw[i - 1]) if i else 0)) for i in range(5)]

    def cost(path):
        c = 2 * abs(math.log2(path[0][0] / 120)) - path[0][1]
        for i in range(1, 5):
            d = abs(math.log2(path[i][0] / path[i - 1][0]))
            x = d / 0.06
            c += lam[i] * (x * x / 2 if x <= 1 else x - 0.5) + (1.5 if abs(d - 1) < 0.08 else 0) + (1000 if d > math.log2(1.75) else 0) - path[i][1]
        return c

    import itertools

    assert got == [b for b, _ in min(itertools.product(*steps), key=cost)]


def test_beat_chain(spark):
    r = random.Random(4)
    frames = sorted(r.sample(range(200), 60))
    rows = [(0, f, r.random()) for f in frames]
    got = [x["frame"] for x in tempo.beat_chain(spark.createDataFrame(rows, "track_id long, frame long, support double"), 8.0).orderBy("frame").collect()]
    best = {}
    for _, f, s in rows:
        options = [(best[g][0] - 55 * math.log((f - g) / 8) ** 2 + s, [*best[g][1], f]) for g in best if 0.67 * 8 <= f - g <= 1.5 * 8]
        top = max(options, key=lambda o: o[0], default=None)
        best[f] = top if top and top[0] > s + 1 else (s + 1, [f])
    ends = [f for f in frames if f >= frames[-1] - 12]
    assert got == max((best[f] for f in ends), key=lambda v: v[0])[1]


def test_snap_beats(spark):
    r = random.Random(5)
    frames = [(0, f, float(r.randrange(9))) for f in range(120)]
    beats = [(0, t) for t in range(4, 118, 7)]
    got = {x["t"]: x["snapped"] for x in tempo.snap_beats(spark.createDataFrame(beats, "track_id long, t long"), spark.createDataFrame(frames, "track_id long, frame long, x double"), 7.0, 2).collect()}
    x, done = {f: v for _, f, v in frames}, []
    for i, (_, t) in enumerate(beats):
        to = min((f for f in range(t - 2, t + 3) if f in x), key=lambda f: (-x[f], abs(f - t), f))
        ok = lambda g: 0.67 * 7 <= g <= 1.5 * 7
        nxt = beats[i + 1][1] if i + 1 < len(beats) else None
        fits = (not done or (to > done[-1] and ok(to - done[-1]))) and (nxt is None or (to < nxt and ok(nxt - to)))
        done.append(to if fits else t)
        assert got[t] == done[-1]


def test_segment_dp_and_families(spark):
    r = random.Random(6)
    costs = [(0, a, b, round(r.random(), 3)) for a in range(1, 13) for b in range(a + 1, min(a + 5, 13)) if r.random() < 0.9]
    bars = spark.createDataFrame([(0, 12)], "track_id long, bars long")
    got = [(x["start_bar"], x["end_bar"]) for x in forms.segment_dp(spark.createDataFrame(costs, "track_id long, a long, b long, cost double"), bars).orderBy("start_bar").collect()]
    best = {0: (0.0, 0, [])}
    for end in range(1, 13):
        options = [(best[a - 1][0] + c, best[a - 1][1] + 1, [*best[a - 1][2], (a, end)]) for _, a, b, c in costs if b == end and a - 1 in best]
        if options:
            best[end] = min(options, key=lambda o: (round(o[0], 9), o[1]))
    assert got == best[12][2]
    sims = [(0, a, b, round(r.random(), 3)) for b in range(1, 9) for a in range(1, b)]
    segments = [(0, n, n == 4) for n in range(1, 9)]
    fam = {x["n"]: (x["family"], x["variant"]) for x in forms.assign_families(spark.createDataFrame(segments, "track_id long, n long, break_like boolean"), spark.createDataFrame(sims, "track_id long, a long, b long, sim double"), 0.6, 0.8).collect()}
    heads, want, s = [], {}, {(a, b): v for _, a, b, v in sims}
    for _, n, broken in segments:
        top = max(((s[h, n], -i) for i, h in enumerate(heads)), default=None)
        if broken:
            want[n] = (0, 0)
        elif top and top[0] >= 0.6:
            want[n] = (1 - top[1], int(top[0] < 0.8))
        else:
            heads.append(n)
            want[n] = (len(heads), 0)
    assert fam == want


def test_boundary_candidates_and_bar_groups(spark):
    r = random.Random(7)
    curve = [(0, b, round(r.random() ** 3, 4)) for b in range(60)]
    got = [x["bar"] for x in forms.boundary_candidates(spark.createDataFrame(curve, "track_id long, bar long, novelty double")).orderBy("bar").collect()]
    v = [x for _, _, x in curve]
    mid = lambda x: (sorted(x)[(len(x) - 1) // 2] + sorted(x)[len(x) // 2]) / 2
    bed = [x for x in v if x <= mid(v)]
    floor = mid(bed) + 1.25 * mid([abs(x - mid(bed)) for x in bed])
    want = []
    for b, x in enumerate(v):
        if x >= floor and all(x > v[o] for o in range(max(0, b - 2), min(60, b + 3)) if o != b) and (not want or b - want[-1] >= 4):
            want.append(b)
    assert got == want
    vec = [(0, b, [r.random() for _ in range(4)]) for b in range(30)]
    got = {x["bar"]: x["group"] for x in forms.bar_groups(spark.createDataFrame(vec, "track_id long, bar long, v array<double>"), 0.9).collect()}
    centres = []
    for _, b, x in vec:
        cos = [round(sum(p * q for p, q in zip(c, x, strict=True)) / math.sqrt(sum(p * p for p in c) * sum(q * q for q in x)), 9) for c in centres]
        k = max(range(len(cos)), key=lambda i: (cos[i], -i), default=None)
        if k is not None and cos[k] >= 0.9:
            centres[k] = [0.8 * p + 0.2 * q for p, q in zip(centres[k], x, strict=True)]
        else:
            centres.append(x)
            k = len(centres) - 1
        assert got[b] == k + 1


def test_spaced_selection_and_capped_pairs(spark):
    r = random.Random(8)
    rows = [(0, i, round(r.random() * 6, 3), round(r.random(), 3)) for i in range(80)]
    df = spark.createDataFrame(rows, "track_id long, id long, t double, relevance double")
    got = sorted(x["id"] for x in scores.select_spaced(df).collect())
    near = [x for x in rows if x[3] >= 0.74 and any(y[3] >= 0.82 and abs(y[2] - x[2]) <= 0.48 for y in rows)]
    kept = []
    for x in sorted(near, key=lambda x: (-x[3], x[2], x[1])):
        if all(abs(x[2] - y[2]) >= 0.16 for y in kept):
            kept.append(x)
    assert got == sorted(x[1] for x in kept)
    labels = df.withColumnRenamed("relevance", "rate")
    got = sorted((x["better"], x["worse"]) for x in corpora.capped_preference_pairs(labels, 1.0, 0.34, 3).collect())
    pairs = sorted(((round(a[3] - b[3], 6), abs(a[2] - b[2]), a[1], b[1]) for a in rows for b in rows if abs(a[2] - b[2]) <= 1.0 and round(a[3] - b[3], 6) >= 0.34), key=lambda p: (-p[0], p[1], p[2], p[3]))
    room, want = {}, []
    for _, _, a, b in pairs:
        if room.get(a, 0) < 3 and room.get(b, 0) < 3:
            want.append((a, b))
            room[a], room[b] = room.get(a, 0) + 1, room.get(b, 0) + 1
    assert got == sorted(want)


def test_pairwise_fit_finds_the_optimum(spark):
    import numpy as np

    r = np.random.default_rng(9)
    x = r.normal(size=(300, 2)) + [0.4, -0.2]
    w = np.array(scores.fit_pairwise(spark.createDataFrame(x.tolist(), "a double, b double"), ["a", "b"], 1.0))
    loss = lambda w: np.log1p(np.exp(-(x @ w))).sum() + 0.5 * w @ w
    assert all(loss(w) <= loss(w + d) for d in 0.01 * np.array([[1, 0], [-1, 0], [0, 1], [0, -1], [1, 1]]))


def test_projects_are_read_and_bad_ones_told(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schema_version": "3.1", "track_id": 1, "name": "x", "beats": [{"t": 0.5, "bar": 0, "beat": 1}], "onsets": [{"id": 4, "t": 0.5, "strength": 1.0, "accent": true}], "cues": [], "segments": []}')
    (tmp_path / "b.json").write_text("{ this is no document")
    good, bad = projects.read_projects(spark, str(tmp_path))
    assert [r["track_id"] for r in good.collect()] == [1] and bad.count() == 1
    new = projects.migrate(good).first()
    assert new["merged"] == 1 and new["beats"][0]["bar"] == 1 and new["cues"][0]["onset_id"] == 4


EVENTS = "event_id long, ts timestamp, track_id long, t double"


def _stream(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(path)
    return activity.source(spark, path)


def test_capped_sessions_of_a_stream(spark, tmp_path):
    r = random.Random(10)
    start, rows, at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), [], 0
    for i in range(150):
        at += r.choice([5, 5, 5, 60])
        rows.append((i, start + dt.timedelta(seconds=at), i % 2, 0.0))
    got = activity.drained(activity.capped_sessions(_stream(spark, f"{tmp_path}/in", rows), 20, 60), "append").collect()
    want = {}
    for k in (0, 1):
        groups = []
        for _, ts, who, _ in rows:
            if who == k:
                if groups and (ts - groups[-1][-1]).total_seconds() <= 20 and (ts - groups[-1][0]).total_seconds() <= 60:
                    groups[-1].append(ts)
                else:
                    groups.append([ts])
        want[k] = sorted(len(g) for g in groups[:-1])  # the last one is still open
    for k in (0, 1):
        assert sorted(x["n"] for x in got if x["track_id"] == k) == want[k]


def test_late_rows_upserts_and_stored_beats(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, start + dt.timedelta(hours=h), i % 2, float(i)) for i, h in enumerate([0, 1, 2, 30, 3, 31, 1])]
    kept, late = activity.split_late(_stream(spark, f"{tmp_path}/a", rows), "10 hours")
    assert sorted(r["event_id"] for r in kept.collect()) == [3, 5] and sorted(r["event_id"] for r in late.collect()) == [0, 1, 2, 4, 6]
    got = activity.upserted(_stream(spark, f"{tmp_path}/b", rows), ["track_id"], "ts")
    assert sorted((r["track_id"], r["event_id"]) for r in got.collect()) == [(0, 4), (1, 5)]
    beats = spark.createDataFrame([(k, float(b)) for k in (0, 1) for b in range(0, 9, 3)], "track_id long, t double")
    out = activity.drained(activity.on_beats(_stream(spark, f"{tmp_path}/c", rows), beats, 3.0), "append").collect()
    assert sorted((r["event_id"], r["beat"]) for r in out) == sorted((i, 3.0 * (int(i) // 3)) for i in range(7))


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Two runs over one folder and one checkpoint: upserts meet the table of the first, ties go to the greatest row."""
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    first = [(i, start + dt.timedelta(hours=h), i % 3, float(i)) for i, h in enumerate([5, 1, 9, 2, 9])]
    second = [(10, start + dt.timedelta(hours=7), 0, 1.0), (11, start + dt.timedelta(hours=9), 2, 9.0), (12, start, 1, 0.0), (13, start, 7, 0.0)]
    spark.createDataFrame(first, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = lambda: spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in/*")
    seen = lambda: {r["track_id"]: r["event_id"] for r in activity.upserted(stream(), ["track_id"], "ts", f"{tmp_path}/store").collect()}
    assert seen() == {0: 0, 1: 4, 2: 2}
    spark.createDataFrame(second, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    assert seen() == {0: 10, 1: 4, 2: 11, 7: 13}
    assert seen() == {0: 10, 1: 4, 2: 11, 7: 13}  # nothing new


def test_sessions_of_several_batches_keep_late_rows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    at = lambda i, s: (i, start + dt.timedelta(seconds=s), 0, 0.0)
    for n, rows in enumerate(([at(0, 100.0), at(1, 110.25)], [at(2, 95.0), at(3, 112.0)], [at(4, 10.0), at(5, 500.0)])):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = sorted((r["start"] - start.timestamp(), r["n"]) for r in activity.drained(activity.capped_sessions(stream, 20, 60), "append").collect())
    assert got == [(10.0, 1), (95.0, 4)]
