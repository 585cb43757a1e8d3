"""Onset picking, structure costs, view families, refined beats and anchors against plain loops."""

import math
import random

import numpy as np
import pytest

from chronoflux.operators import forms, onsets, tempo, timeline


def series(seed, n=160):
    r = random.Random(seed)
    x, out = 0.3, []
    for _ in range(n):
        x = min(1.0, max(0.0, x + r.choice([-0.4, -0.2, -0.1, 0.1, 0.2, 0.4])))
        out.append(round(x, 1))
    return out


def plain_close(v, cands, reach, ratio):
    kept = []
    for c in sorted(cands, key=lambda i: v[i], reverse=True):
        for o in kept:
            if abs(c - o) < reach:
                low, weaker = min(v[min(c, o) : max(c, o) + 1]), min(v[c], v[o])
                if not (weaker > 0 and low <= ratio * weaker):
                    break
        else:
            kept.append(c)
    return sorted(kept)


def tops(v, edge=0.0):
    return [i for i in range(1, len(v) - 1) if v[i] >= v[i - 1] and v[i] > v[i + 1] and v[i] >= edge]


@pytest.mark.parametrize(("reach", "ratio"), [(8, 0.55), (3, 0.55), (20, 0.5), (8, 0.0)])
def test_valleys_tell_close_peaks_apart(spark, reach, ratio):
    curves = {k: series(k) for k in range(3)} | {7: [0.0, 1.0, 0.55, 1.0, 0.0], 8: [0.0, 1.0, 0.5499, 1.0, 0.5501, 1.0, 0.0], 9: [0.0, 0.0, 0.0]}
    frames = spark.createDataFrame([(k, i, x) for k, v in curves.items() for i, x in enumerate(v)], "track_id long, frame long, x double").repartition(3)
    peaks = spark.createDataFrame([(k, i, v[i]) for k, v in curves.items() for i in tops(v)], "track_id long, frame long, x double")
    got = sorted((r["track_id"], r["frame"]) for r in onsets.suppress_with_valley(onsets.valleys(peaks, frames, reach), ratio, reach).collect())
    assert got == sorted((k, i) for k, v in curves.items() for i in plain_close(v, tops(v), reach, ratio))


def novelty(spark, curves):
    rows = [(k, i, x, x, x / 2, 0.0, x > 0.05) for k, v in curves.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "track_id long, frame long, x double, low double, mid double, high double, loud boolean").repartition(3)


def test_both_extractors(spark):
    curves = {k: series(k + 10) for k in range(3)}
    df = novelty(spark, curves)
    one = {(r["track_id"], r["frame"]): r for r in onsets.extract_onsets(df, 10.0, 1, 5).collect()}
    two = {(r["track_id"], r["frame"]): r for r in onsets.extract_onsets(df, 10.0, 2, 5).collect()}
    assert "refined_time" in next(iter(two.values())).asDict() and "refined_time" not in next(iter(one.values())).asDict()
    for k, v in curves.items():
        edge = max(0.10, float(np.percentile(v, 75)))
        kept = []
        for c in sorted(tops(v, edge), key=lambda i: (v[i], i), reverse=True):
            if all(abs(c - o) >= 5 for o in kept):
                kept.append(c)
        assert sorted(f for t, f in one if t == k) == sorted(kept)
        near = [v[max(0, i - 32) : i + 33] for i in range(len(v))]
        local = [max(0.10, float(np.median(w)) + 3 * float(np.median(np.abs(np.array(w) - np.median(w))))) for w in near]
        want = plain_close(v, [i for i in tops(v) if v[i] >= local[i] and v[i] > 0.05], 5, 0.55)
        assert sorted(f for t, f in two if t == k) == want
        for n, f in enumerate(sorted(kept), 1):
            r = one[k, f]
            assert (r["id"], r["raw_time"], r["strength"], r["confidence"]) == (n, round(f / 10, 4), v[f], round(min(1, max(0.05, v[f])), 3))


def test_sweeps_give_what_each_value_alone_gives(spark):
    curves = {k: series(k + 20) for k in range(3)}
    df = novelty(spark, curves)
    truth = spark.createDataFrame([(k, i, float(i)) for k, v in curves.items() for i in range(5, 150, 17)], "track_id long, idx long, t double")
    for parameter, values in (("valley", [0.2, 0.55, 0.9]), ("prominence", [0.0, 0.3])):
        got = {r["value"]: (r["precision"], r["recall"], r["f1"]) for r in onsets.parameter_sweep(df, truth, values, 2.0, parameter, 5).collect()}
        for value in values:
            kept = onsets.picked(df, 2, 5, **{parameter: value}).select("track_id", "frame").collect()
            p, r, f = [], [], []
            for k in curves:
                e, t = sorted(x["frame"] for x in kept if x["track_id"] == k), list(range(5, 150, 17))
                near = lambda a, b: min(range(len(b)), key=lambda i: (abs(b[i] - a), b[i]))
                m = sum(1 for i, a in enumerate(t) if e and abs(e[near(a, e)] - a) <= 2 and near(e[near(a, e)], t) == i)
                p.append(math.floor(m * 10000 / len(e) + 0.5) / 10000 if e else 0)
                r.append(math.floor(m * 10000 / len(t) + 0.5) / 10000)
                f.append(math.floor(2 * m * 10000 / (len(e) + len(t)) + 0.5) / 10000)
            assert got[value] == pytest.approx(tuple(np.mean(x) for x in (p, r, f)), abs=6e-5)
    with pytest.raises(ValueError):
        onsets.parameter_sweep(df, truth, [1.0], 2.0, "loudness")


def test_stages_are_counted(spark):
    df = novelty(spark, {k: series(k + 30) for k in range(2)})
    stages = onsets.ablation_stages(df, df, 5)
    report = {r["track_id"]: r for r in onsets.stage_count_report(stages).collect()}
    for k in (0, 1, None):
        for s in onsets.STAGES:
            own = stages.where((stages.stage == s) & ((stages.track_id == k) if k is not None else stages.track_id.isNotNull())).count()
            assert report[k][s] == own
    assert report[None]["ratio"] == pytest.approx(report[None]["v2"] / max(1, report[None]["v1"]), abs=1e-4)
    assert report[None]["v1"] == report[None]["v2_flux"]  # one curve, so only the picker differs


def sim_matrix(n, r):
    v = np.abs(r.normal(size=(n, 6)))
    v[n // 3 : 2 * n // 3] += 2 * np.abs(r.normal(size=6))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.clip(u @ u.T, 0, 1)
    np.fill_diagonal(s, 1)
    return v, s


def test_band_curves_and_costs(spark):
    r = np.random.default_rng(5)
    n = 40
    v, s = sim_matrix(n, r)
    view = spark.createDataFrame([(0, b + 1, c, float(v[b, c])) for b in range(n) for c in range(6)], "track_id long, bar long, col long, x double")
    bars = spark.createDataFrame([(0, n)], "track_id long, bars long")
    band = forms.similar_within(view, 31)
    got = {(x["i"], x["j"]): x["sim"] for x in band.collect()}
    assert got == {(i + 1, j + 1): pytest.approx(s[i, j]) for i in range(n) for j in range(i, min(n, i + 32))}
    for k in (4, 8):
        h = k // 2
        want = {c + 1: (s[c - h : c, c - h : c].mean() + s[c : c + h, c : c + h].mean()) / 2 - s[c - h : c, c : c + h].mean() for c in range(h, n - h + 1)}
        assert {x["bar"]: x["novelty"] for x in forms.checkerboard(band, bars, k).collect()} == {b: pytest.approx(x) for b, x in want.items()}
    cuts = [(0, b, round(float(x), 3)) for b, x in zip((6, 10, 14, 21, 29, 36), r.random(6), strict=True)]
    cost = {(x["a"], x["b"]): x["cost"] for x in forms.segment_costs(band, spark.createDataFrame(cuts, "track_id long, bar long, novelty double"), bars).collect()}
    at, nov = sorted({0, n, *(b - 1 for _, b, _ in cuts)}), {b - 1: x for _, b, x in cuts}
    want, best = {}, {n: (0.0, 0, [])}
    for a in reversed(at[:-1]):
        for b in at:
            size = b - a
            if 4 <= size <= 32:
                var = min(1, max(0, 1 - (s[a:b, a:b].sum() - size) / (size * (size - 1))))
                edge = 0.2 * (1 - nov[b]) - 0.3 * nov[b] if b < n else 0
                want[a + 1, b] = 0.55 * var + 0.25 * min(abs(size - p) / p for p in (4, 8, 12, 16)) + edge
                if b in best and (a not in best or want[a + 1, b] + best[b][0] < best[a][0]):
                    best[a] = (want[a + 1, b] + best[b][0], best[b][1] + 1, [(a + 1, b), *best[b][2]])
    assert cost == {k: pytest.approx(x) for k, x in want.items()}
    got = forms.segment_dp(spark.createDataFrame([(0, a, b, x) for (a, b), x in cost.items()], "track_id long, a long, b long, cost double"), bars)
    assert [(x["start_bar"], x["end_bar"]) for x in got.orderBy("start_bar").collect()] == best[0][2]


def test_families_by_views(spark):
    r = np.random.default_rng(7)
    kinds = [np.abs(r.normal(size=(8, 4))) for _ in range(3)]
    order, rows, segments, bar = [0, 1, 0, 2, 1, 0, 0], [], [], 1
    for n, k in enumerate(order, 1):
        segments.append((0, n, bar, bar + 7, n == 4))
        for b in range(8):
            for c in range(4):
                rows.append((0, bar + b, c, float(kinds[k][b, c] * (1 + 0.01 * r.random()))))
        bar += 8
    df = spark.createDataFrame(segments, "track_id long, n long, start_bar long, end_bar long, break_like boolean")
    view = spark.createDataFrame(rows, "track_id long, bar long, col long, x double")
    views = {"harmony": view, "timbre": view.where("col > 1"), "rhythm": view.withColumn("block", view.col % 2)}
    vectors = forms.segment_vectors(df, views)
    got = {x["n"]: (x["family"], x["variant"]) for x in forms.assign_view_families(df, vectors).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (1, 0), 4: (0, 0), 5: (2, 0), 6: (1, 0), 7: (1, 0)}
    found = {x["family"]: (x["n"], x["similarity"]) for x in forms.family_repetitions(spark.createDataFrame([(0, n, f) for n, (f, _) in got.items()], "track_id long, n long, family int"), vectors).collect()}
    assert found.keys() == {1, 2} and found[1][0] == 4 and all(0.99 < s <= 1 for _, s in found.values())
    one = (8, {"harmony": np.ones(3), "timbre": np.array([1.0, 0, 0])})
    assert forms.agreement(one, (8, {"harmony": np.ones(3), "timbre": np.array([0.0, 1, 0])})) == 0  # vetoed
    assert forms.agreement(one, (4, one[1])) == pytest.approx(0.75) and forms.agreement(one, (7, one[1])) == pytest.approx(7 / 8)
    assert forms.agreement((4, {"energy": np.zeros(2)}), (4, {"energy": np.zeros(2)})) == 1 and forms.agreement((4, {"energy": np.zeros(2)}), (4, {"energy": np.ones(2)})) == 0


def test_refined_beats(spark):
    r = random.Random(8)
    beats, ons, sup = [], [], []
    for k in range(3):
        t, ts = 0.3, []
        for _ in range(25):
            t += r.choice([0.4, 0.5, 0.6])
            ts.append(round(t, 3))
        beats += [(k, x) for x in ts]
        ons += [(k, round(x + r.choice([0.0, 0.02, -0.08, 0.1, 0.11]), 3)) for x in ts if r.random() < 0.6]
        sup += [(k, f, round(r.random(), 2)) for f in range(int(t * 50) - 20)]
    beats.append((5, 1.0))
    got = {(x["track_id"], x["i"]): x for x in tempo.refine_beats(spark.createDataFrame(beats, "track_id long, t double"), spark.createDataFrame(ons, "track_id long, t double"), spark.createDataFrame(sup, "track_id long, frame long, x double"), 50.0).collect()}
    moved = 0
    for k in range(3):
        ts, os_, s = [t for b, t in beats if b == k], sorted({t for b, t in ons if b == k}), [x for b, _, x in sup if b == k]
        last = None
        for i, t in enumerate(ts):
            left, right = (t - ts[i - 1] if i else None), (ts[i + 1] - t if i + 1 < len(ts) else None)
            period = (left + right) / 2 if left and right else left or right
            at = lambda x: s[round(x * 50)] if 0 <= round(x * 50) < len(s) else 0.0  # noqa: B023, E731
            score = lambda x: max([1 - abs(o - x) / 0.05 for o in os_ if abs(o - x) <= 0.05], default=0.0) + 0.6 * at(x) - 0.8 * abs(x - t) / period  # noqa: B023, E731
            cands = [t, *(o for o in os_ if abs(o - t) <= 0.25 * period)]
            low, high = max(0, round((t - 0.25 * period) * 50)), min(len(s), round((t + 0.25 * period) * 50) + 1)
            if high > low:
                cands.append((low + int(np.argmax(s[low:high]))) / 50)
            best = max(cands, key=score)
            gain, chosen = score(best) - score(t), t
            if gain >= 0.15 and (last is None or best >= last + 0.25 * period) and (i + 1 == len(ts) or best <= ts[i + 1] - 0.25 * period) and best != t:
                chosen = best
                moved += 1
            last = chosen
            x = got[k, i]
            assert (x["chosen"], x["margin"], x["moved"]) == (pytest.approx(chosen), pytest.approx(gain), chosen != t), (k, i)
    assert moved > 5 and got[5, 0]["reason"] == "too-few-beats"


def test_anchors(spark):
    beats = spark.createDataFrame([(0, i, t) for i, t in enumerate([1.0, 2.0, 4.0, 5.0])] + [(1, 0, 1.0)], "track_id long, idx long, t double")
    ons = spark.createDataFrame([(0, 7, 3.0)], "track_id long, id long, t double")
    schema = "track_id long, name string, seconds double, beat long, onset long, moment string, offset double, offset_beats double"
    rows = [
        (0, "s", 2.5, None, None, None, 0.25, None),
        (0, "b", None, 2, None, None, None, 0.5),
        (0, "o", None, None, 7, None, -1.0, 1.0),
        (0, "m", None, None, None, "o", None, -1.0),
        (0, "mm", None, None, None, "m", 1.0, None),
        (0, "early", 0.0, None, None, None, None, 1.0),
        (0, "late", 6.0, None, None, None, None, 1.0),
        (0, "two", 1.0, 1, None, None, None, None),
        (0, "none", None, None, None, None, 1.0, None),
        (0, "far", None, 9, None, None, None, None),
        (0, "who", None, None, None, "nobody", None, None),
        (0, "on far", None, None, None, "far", None, None),
        (0, "c1", None, None, None, "c2", None, None),
        (0, "c2", None, None, None, "c1", None, None),
        (0, "on c", None, None, None, "c1", None, None),
        (0, "nan", 1.0, None, None, None, float("nan"), None),
        (1, "no grid", 1.0, None, None, None, None, 1.0),
        (1, "fine", 1.0, None, None, None, 0.5, 0.0),
    ]
    got = {r["name"]: (r["status"], r["t"]) for r in timeline.resolve_anchors(spark.createDataFrame(rows, schema), beats, ons).collect()}
    ok = {"s": 2.75, "b": 4.5, "o": 3.5, "m": 3.5 - 1.25 + 0.0, "mm": 3.25, "early": 1.0, "late": 7.0, "fine": 1.5}
    ok["m"] = 2.0 - 0.25  # 3.5 is place 1.75; one beat less is .75
    ok["mm"] = ok["m"] + 1
    for name, t in ok.items():
        assert got[name] == ("ok", pytest.approx(t)), name
    assert {n: s for n, (s, _) in got.items() if s != "ok"} == {"two": "invalid", "none": "invalid", "far": "unknown", "who": "unknown", "on far": "unknown", "c1": "cyclic", "c2": "cyclic", "on c": "cyclic", "nan": "invalid", "no grid": "invalid"}


def test_boundaries_bars_and_tempo_of_a_curve(spark):
    from chronoflux.operators import scores

    cut = lambda rows: spark.createDataFrame([(k, float(i), float(i)) for k, i in rows], "track_id long, id double, t double")
    got = {r["track_id"]: tuple(r)[1:] for r in scores.boundary_metrics(cut([(0, 4), (0, 8), (1, 4)]), cut([(0, 5), (0, 30), (0, 9), (2, 1)]), 2.0).collect()}
    assert got[0] == (0.6667, 1.0, 0.8, 1.0, 2, 3, 2) and got[1] == (0.0, 0.0, 0.0, None, 0, 0, 1) and got[2] == (0.0, 0.0, 0.0, None, 0, 1, 0)
    a, b, quiet = [1.0, 0.0, 0.5, 0.0] * 4, [0.0, 1.0, 0.0, 0.2] * 4, [0.0] * 16
    fill = [*a[:12], 1.0, 1.0, 1.0, 1.0]
    bars = [(0, i, v) for i, v in enumerate([a, a, b, quiet, a, [0.2 * x for x in a], fill], 1)]
    got = [(r["label"], r["group"]) for r in forms.bar_overview(spark.createDataFrame(bars, "track_id long, bar long, v array<double>")).orderBy("bar").collect()]
    assert got == [("change", "A"), ("repeat", "A"), ("change", "B"), ("break", "BREAK"), ("change", "A"), ("repeat", "A"), ("fill", "A")]
    pulse = [(0, f, 1.0 if f % 30 == 5 else 0.0) for f in range(600)] + [(1, f, 0.5) for f in range(100)] + [(2, 0, 1.0)] + [(3, f, 1.0 if f in (5, 30, 130, 400) else 0.0) for f in range(600)]
    got = {r["track_id"]: r["bpm"] for r in onsets.tempo_from_novelty(spark.createDataFrame(pulse, "track_id long, frame long, x double"), 50.0).collect()}
    assert got == {0: 100.0, 1: 0.0, 2: 0.0, 3: 0.0}
    bands = spark.createDataFrame([(0, b, f, x) for _, f, x in pulse[:600] for b in ("low", "high")], "track_id long, band string, frame long, x double")
    grid = spark.createDataFrame([(0, 100.0, 0.1)], "track_id long, bpm double, origin double")
    rows = onsets.legacy_band_peaks(bands, grid, 50.0, {"low": 0.12, "high": 0.08}).where("band = 'low'").orderBy("frame").collect()
    assert [(r["frame"], r["nearest_step"], r["bar"], r["beat"], r["step_in_bar"], r["velocity"]) for r in rows] == [(5 + 30 * k, 4 * k, k // 4 + 1, k % 4 + 1, 4 * k % 16 + 1, 127) for k in range(20)]


def test_event_evidence_is_that_of_its_parts(spark):
    from chronoflux.operators import evidence

    r = random.Random(12)
    rows = [(k, 100 * k + i, "x", round(t, 3), r.random(), r.random(), r.random(), r.random()) for k in (0, 1) for i, t in enumerate(sorted(r.uniform(0, 12) for _ in range(40)))]
    ons = spark.createDataFrame(rows, "track_id long, id long, kind string, t double, strength double, low double, mid double, high double")
    beats = spark.createDataFrame([(0, i, i * 0.5) for i in range(25)], "track_id long, idx long, t double")
    bounds = spark.createDataFrame([(0, 4.0, 0.5), (0, 8.0, float("nan"))], "track_id long, t double, novelty double")
    got = {x["id"]: x for x in evidence.event_evidence(ons, beats, bounds, spark.createDataFrame([(0, 12.0), (1, 12.0)], "track_id long, duration double")).collect()}
    assert len(got) == 80
    for k, i, _, t, *_ in rows:
        x, own = got[i], [y for y in rows if y[0] == k]
        near = [y for y in own if abs(y[3] - t) <= 2.0]
        assert x["local"]["sample_count"] == len(near)
        for name, c in (("all", 4), ("low", 5), ("high", 7)):
            v, w = next(y[c] for y in own if y[1] == i), [y[c] for y in near]
            assert x["local"]["rank"][name] == pytest.approx((sum(u < v for u in w) + 0.5 * w.count(v)) / len(w), abs=1e-6)
            a, b = np.percentile(w, [50, 90])
            assert x["local"]["contrast"][name] == pytest.approx(min(4, max(0, (v - a) / max(b - a, 0.08))), abs=1e-6)
        assert x["temporal"]["density"] == pytest.approx(len(near) / (min(12, t + 2) - max(0, t - 2)), abs=1e-6)
        if k == 1:
            assert x["metric"] is None and x["structure"] is None
        else:
            beat = min(range(25), key=lambda n: (abs(n * 0.5 - t), n))
            assert x["metric"]["beat"] == beat and x["metric"]["offset"] == pytest.approx(t - beat * 0.5, abs=1e-6)
            assert x["structure"]["distance"] == pytest.approx(abs(t - 4), abs=1e-6) and x["structure"]["novelty"] == 0.5
    for k in (0, 1):  # greedy groups: gaps of .18, 1.5 long at most, three or more
        ts, at, groups = sorted((y[3], y[1]) for y in rows if y[0] == k), 0, []
        while at < len(ts):
            end = at + 1
            while end < len(ts) and ts[end][0] - ts[end - 1][0] <= 0.18 and ts[end][0] - ts[at][0] <= 1.5:
                end += 1
            groups += [[i for _, i in ts[at:end]]] if end - at >= 3 else []
            at = end
        want = {i: n for n, g in enumerate(groups, 1) for i in g}
        assert {i: got[i]["group_id"] for _, i in ts} == {i: want.get(i) for _, i in ts}


def test_one_segment_meets_all_heads_as_it_meets_each():
    r = np.random.default_rng(11)
    kinds = {"harmony": 24, "timbre": 16, "rhythm:0": 8, "rhythm:1": 8, "energy": 4}
    base = [{p: np.abs(r.normal(size=n)) for p, n in kinds.items()} for _ in range(3)]
    made = [(int(r.integers(3, 20)), {p: v * (k % 5 > 0 or p != "energy") + 0.1 * r.normal(size=len(v)) * (k % 7 > 0) for p, v in base[k % 3].items()}) for k in range(60)]
    heads = forms.Heads()
    assert len(heads.agreements(made[0])) == 0
    for k, own in enumerate(made):
        want = [forms.agreement(m, own) for m in made[:k]]
        assert heads.agreements(own).tolist() == pytest.approx(want)
        heads.add(own)
    assert len({x == 0 for x in want}) == 2


def test_bands_are_made_in_strips_without_pairs_being_joined(spark, monkeypatch):
    monkeypatch.setattr(forms, "STRIP", 8)
    r, reach, weights = np.random.default_rng(12), 5, {"a": 0.7, "b": 0.3}
    x = {n: {b: r.normal(size=3) for b in range(-3, 40) if r.random() < (0.95 if n == "a" else 0.5)} for n in weights}
    views = {n: spark.createDataFrame([(7, b, c, float(v[c])) for b, v in x[n].items() for c in range(3)], "track_id long, bar long, col long, x double") for n in weights}
    views["b"] = views["b"].unionByName(spark.createDataFrame([(7, 50, 0, None), (7, 51, 0, float("nan")), (8, 1, 0, 2.0)], "track_id long, bar long, col long, x double"))
    x["b"] |= {50: np.zeros(3), 51: np.zeros(3)}

    def sim(v, i, j):
        if i not in v or j not in v:
            return None
        size = np.linalg.norm(v[i]) * np.linalg.norm(v[j])
        return 1.0 if i == j else 0.0 if size == 0 else min(1.0, max(0.0, float(v[i] @ v[j]) / size))

    own = {(i, j): [sim(x[n], i, j) for n in weights] for i in range(-3, 52) for j in range(i, i + reach + 1)}
    own = {k: v for k, v in own.items() if v != [None, None]}
    mean = {k: sum(w * s for w, s in zip(weights.values(), v, strict=True) if s is not None) / sum(w for w, s in zip(weights.values(), v, strict=True) if s is not None) for k, v in own.items()}
    middle = {(i, j): float(np.median([mean[i + k, j + k] for k in (-1, 0, 1) if (i + k, j + k) in mean])) for i, j in mean}
    wide = forms.bands_within(views, reach, weights)
    got = wide.collect()
    assert [(g["i"], g["j"], g["sim"], g["b"], g["a"]) for g in got if g["track_id"] == 8] == [(1, 1, 1.0, 1.0, None)]
    got = {(g["i"], g["j"]): g for g in got if g["track_id"] == 7}
    assert {k: [g["a"], g["b"]] for k, g in got.items()} == {k: [s if s is None else pytest.approx(s) for s in v] for k, v in own.items()}
    assert {k: g["sim"] for k, g in got.items()} == {k: pytest.approx(v) for k, v in middle.items()}
    assert "Join" not in wide._jdf.queryExecution().optimizedPlan().toString()


def test_a_long_gap_does_not_make_other_beats_meet_more(spark, monkeypatch):
    ts = [0.5 * k for k in range(200)] + [5000.0, 5000.5, 90_000.0]
    os_ = [t + 0.11 for t in ts] + [2500.0, 4200.0, 60_000.0]
    beats, ons = ([(track, t) for track in (0, 1) for t in rows] for rows in (ts, os_))
    sup = [(0, int(t * 20), 1.0) for t in os_]
    schema = "track_id long, t double"
    found = tempo.refine_beats(spark.createDataFrame(beats, schema), spark.createDataFrame(ons, schema), spark.createDataFrame(sup, "track_id long, frame long, x double"), 20.0)
    got = {(x["track_id"], x["i"]): x for x in found.collect()}
    for track in (0, 1):
        at = {f / 20: 1.0 for k, f, _ in sup if k == track}
        for i, t in enumerate(ts):
            left, right = (t - ts[i - 1] if i else None), (ts[i + 1] - t if i + 1 < len(ts) else None)
            period = (left + right) / 2 if left and right else left or right
            reach = 0.25 * period
            score = lambda x: max(max(1 - abs(o - x) / 0.05 for o in os_), 0.0) + 0.6 * at.get(round(x * 20) / 20, 0.0) - 0.8 * abs(x - t) / period  # noqa: B023, E731
            low, high = round((t - reach) * 20), round((t + reach) * 20)
            cands = [t, *(o for o in os_ if abs(o - t) <= reach), *[min(f / 20 for f in range(max(low, 0), high + 1) if f / 20 in at) for _ in (1,) if any(low <= round(f * 20) <= high for f in at)]]
            assert got[track, i]["score"] == pytest.approx(max(map(score, cands))), (track, i)
    monkeypatch.setattr(tempo.joins, "band", None)  # pairs within the longest reach of all are never made
    assert tempo.refine_beats(spark.createDataFrame(beats, schema), spark.createDataFrame(ons, schema), None, 20.0).count() == 2 * len(ts)
