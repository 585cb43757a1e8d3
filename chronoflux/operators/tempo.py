"""Tempo over time: local autocorrelation, candidates, the best path, beats put in order.

Folds run over what windows have reduced: anchors, peaks or beats of one track, never
frames.  Null or repeated times take no part; tracks without rows give none.
"""

from __future__ import annotations

import math
from array import array
from bisect import insort
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoflux.functions.columns import clip, linear_kernel

from . import joins
from .folds import fold

#: Fixed values of the tempo model: prior weight, smoothness, drift scale, octave band and penalty, greatest jump (log2 of 1.75).
PRIOR, LAMBDA, DRIFT, OCTAVE_BAND, OCTAVE_PENALTY, MOST_JUMP = 2.0, 0.6, 0.06, 0.08, 1.5, 0.8073549220576041
#: Fixed values of a tempo segment: scale of its loss (octaves), cost of a boundary and how far a sure change relaxes it, intervals at least and at most, and octaves under which neighbours merge.
SCALE, BOUNDARY, RELAX, SHORTEST, LONGEST, MERGED = 0.05, 1.5, 0.8, 4, 256, 0.02
#: Lags of a beat chain in periods, and its tightness.
LAGS, TIGHT = (0.67, 1.5), 55.0


def local_autocorrelation(frames: DataFrame, window: int, hop: int, low: int, high: int) -> DataFrame:
    """``track_id, anchor, lag, r``: cosine of a window's mean-free frames with themselves ``lag`` later.

    Windows of ``window`` frames are centred on every ``hop``-th frame and cut, never
    padded, at the ends; those not longer than ``high`` give nothing.  A frame joins
    its own window / hop windows, so work is frames * windows * lags.
    """
    anchors = frames.where(F.col("frame") % hop == 0).select("track_id", F.col("frame").alias("anchor"), F.greatest(F.col("frame") - window // 2, F.lit(0)).alias("start"))
    cell = lambda c: F.floor(c / window)
    near = anchors.select("*", F.explode(F.array(cell(F.col("start")), cell(F.col("start")) + 1)).alias("cell"))
    inside = near.join(frames.withColumn("cell", cell(F.col("frame"))), ["track_id", "cell"]).where((F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("start") + window))
    w = Window.partitionBy("track_id", "anchor")
    rows = inside.withColumn("n", F.count("*").over(w)).where(F.col("n") > high).select("track_id", "anchor", "frame", (F.col("x") - F.avg("x").over(w)).alias("y"))
    left = rows.select("track_id", "anchor", "y", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lag"), "frame").withColumn("frame", F.col("frame") + F.col("lag"))
    both = left.join(rows.withColumnRenamed("y", "z"), ["track_id", "anchor", "frame"])
    r = F.sum(F.col("y") * F.col("z")) / (F.sqrt(F.sum(F.col("y") * F.col("y")) * F.sum(F.col("z") * F.col("z"))) + 1e-9)
    return both.groupBy("track_id", "anchor", "lag").agg(r.alias("r"))


def candidates(correlation: DataFrame, rate: float, prior: float, low: float, high: float, k: int = 5) -> DataFrame:
    """``track_id, anchor, bpm, score, origin``: the ``k`` best local maxima, and their octaves within ``low`` to ``high``.

    bpm is ``rate`` / lag.  Equal bpm (six decimals): the higher score, then the
    measured one (origin 0) before its double (1) and half (2).
    """
    w = Window.partitionBy("track_id", "anchor").orderBy("lag")
    before, after = F.lag("r").over(w), F.lead("r").over(w)
    tops = correlation.withColumn("p", before).withColumn("n", after).where((F.col("r") > 0) & (F.col("p").isNull() | (F.col("r") > F.col("p"))) & (F.col("n").isNull() | (F.col("r") >= F.col("n"))))
    bpm = F.lit(rate) / F.col("lag")
    rank = F.row_number().over(Window.partitionBy("track_id", "anchor").orderBy(F.desc("r"), F.abs(F.log2(bpm / prior)), "lag"))
    best = tops.withColumn("rank", rank).where(F.col("rank") <= k)
    options = F.array(*[F.struct((bpm * f).alias("bpm"), F.lit(o).alias("origin")) for o, f in enumerate((1.0, 2.0, 0.5))])
    rows = best.select("track_id", "anchor", F.col("r").alias("score"), F.inline(options)).where((F.col("origin") == 0) | F.col("bpm").between(low, high))
    one = Window.partitionBy("track_id", "anchor", F.round("bpm", 6)).orderBy(F.desc("score"), "origin")
    return rows.withColumn("one", F.row_number().over(one)).where("one = 1").select("track_id", "anchor", "bpm", "score", "origin")


def change_scores(anchors: DataFrame, onset: float = 0.025, full: float = 0.12, band: float = 0.06, support: int = 2) -> DataFrame:
    """``track_id, i, change``: how sure the tempo changes at anchor i, on two anchors running.

    The medians of two anchors before and three from it on are compared in octaves;
    the step counts as far as both sides agree with their own median.
    """
    w = Window.partitionBy("track_id").orderBy("i")
    rows = anchors.select("track_id", "i", F.collect_list("bpm").over(w.rowsBetween(-2, -1)).alias("l"), F.collect_list("bpm").over(w.rowsBetween(0, 2)).alias("r"))

    def median(xs: Column) -> Column:
        s, n = F.array_sort(xs), F.size(xs)
        return (F.try_element_at(s, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int")) + F.try_element_at(s, F.greatest(F.floor(n / 2 + 1), F.lit(1)).cast("int"))) / 2

    rows = rows.withColumn("a", median(F.col("l"))).withColumn("b", median(F.col("r")))
    agree = lambda xs, m: F.size(F.filter(xs, lambda x: F.abs(F.log2(x / F.col(m))) <= band))
    score = clip((F.abs(F.log2(F.col("b") / F.col("a"))) - onset) / full) * clip(F.least(agree("l", "a"), agree("r", "b")) / support)
    rows = rows.withColumn("s", F.when(F.size("l") > 0, score).otherwise(0.0))
    return rows.select("track_id", "i", F.coalesce(F.least("s", F.lag("s").over(w)), F.lit(0.0)).alias("change")).withColumn("change", F.when(F.col("i") == 0, 0.0).otherwise(F.col("change")))


def tempo_path(found: DataFrame, prior: float) -> DataFrame:
    """``track_id, anchor, bpm``: one candidate an anchor, of least total cost.

    Cost: ``PRIOR`` * octaves from the prior at the start, smooth (Huber) steps, made
    cheaper where the anchors' best tempos change for good, a penalty near an octave,
    less each score; jumps above ``MOST_JUMP`` octaves count 1000 more, so they are
    taken only where nothing else goes.  One pass
    over a track's anchors keeps the costs of the last one's candidates and gives each
    candidate its back link, a second one backwards reads the path off them; ties go to
    the smaller step, then the lower tempo.
    """
    cand = F.struct(F.round("bpm", 9).alias("bpm"), F.col("score").alias("score"))
    best = F.max_by("bpm", F.struct("score", (-F.abs(F.log2(F.col("bpm") / prior))).alias("near"), (-F.col("bpm")).alias("low")))
    steps = found.groupBy("track_id", "anchor").agg(F.sort_array(F.collect_list(cand)).alias("c"), best.alias("bpm"))
    steps = steps.withColumn("i", F.row_number().over(Window.partitionBy("track_id").orderBy("anchor")) - 1)
    steps = steps.join(change_scores(steps), ["track_id", "i"]).withColumn("lam", LAMBDA * (1 - 0.75 * F.col("change")))
    def start() -> list:
        return [None]

    def step(state: list, i: int, anchor: int, c: list, lam: float) -> list[tuple]:
        before, rows = state[0], []
        for x in c:
            if before is None:
                rows.append((abs(math.log2(x["bpm"] / prior)) * PRIOR - x["score"], None))
                continue
            options = []
            for k, (bpm, cost) in enumerate(before):
                d = abs(math.log2(x["bpm"] / bpm))
                u = d / DRIFT
                move = lam * (u * u / 2 if u <= 1 else u - 0.5) + (OCTAVE_PENALTY if abs(d - 1) < OCTAVE_BAND else 0.0) + (1000.0 if d > MOST_JUMP else 0.0)
                options.append((cost + move - x["score"], d, bpm, k))
            cost, _, _, k = min(options)
            rows.append((cost, k))
        state[0] = [(x["bpm"], cost) for x, (cost, _) in zip(c, rows, strict=True)]
        return [(i, anchor, [x["bpm"] for x in c], [r[0] for r in rows], [r[1] for r in rows])]

    linked = fold(steps.select("track_id", "i", "anchor", "c", "lam"), ["track_id"], ["i"], "i int, anchor long, bpm array<double>, cost array<double>, back array<int>", start, step)

    def back(state: list, i: int, anchor: int, bpm: list, cost: list, link: list) -> list[tuple]:
        at = state[0] if state[0] is not None else min(range(len(bpm)), key=lambda k: (cost[k], bpm[k]))
        state[0] = link[at]
        return [(anchor, bpm[at])]

    return fold(linked, ["track_id"], [F.desc("i")], "anchor long, bpm double", start, back)


def period_guide(frames: DataFrame, anchors: DataFrame) -> DataFrame:
    """Frames with ``period`` = 60 / bpm, the log of bpm linear between anchors ``(frame, bpm)``, flat at the ends."""
    w = Window.partitionBy("track_id").orderBy("frame")
    facts = anchors.select("track_id", F.col("frame").cast("double").alias("t"), F.ln("bpm").alias("v"), F.lead(F.col("frame")).over(w).alias("f1"), F.lead(F.ln("bpm")).over(w).alias("v1"))
    first = anchors.groupBy("track_id").agg(F.min_by(F.ln("bpm"), "frame").alias("v0"))
    found = joins.asof(frames.withColumn("t", F.col("frame").cast("double")), facts, "a", width=512.0).join(first, "track_id")
    u = (F.col("t") - F.col("a.ft")) / (F.col("a.f1") - F.col("a.ft"))
    log = F.coalesce(F.col("a.v") + (F.col("a.v1") - F.col("a.v")) * u, F.col("a.v"), F.col("v0"))
    return found.select(*frames.columns, (60 / F.exp(log)).alias("period"))


def timing_risk(segments: DataFrame, bpm: float, least: float = 0.25, away: float = 0.2) -> DataFrame:
    """Weak segments whose tempo is more than ``away`` octaves off: ``ratio`` (log2) and the nearest ``alias`` of 1/2, 2/3, 3/2 and 2."""
    ratio = F.log2(F.col("bpm") / bpm)
    names = F.array(*[F.struct(F.abs(ratio - F.log2(F.lit(a))).alias("d"), F.lit(a).alias("a")) for a in (0.5, 2.0 / 3, 1.5, 2.0)])
    return segments.where((F.col("score") < least) & (F.abs(ratio) > away)).select("track_id", "id", ratio.alias("ratio"), F.array_min(names)["a"].alias("alias"))


def segment_violations(segments: DataFrame, most: float) -> DataFrame:
    """``track_id, t0, rule`` where tempo segments do not tile a track or have a tempo out of range; nothing is repaired."""
    w = Window.partitionBy("track_id").orderBy("t0", F.col("t1").asc_nulls_first())
    before = F.lag("t1").over(w)
    rows = segments.withColumn("p", before).withColumn("n", F.row_number().over(w))
    rules = F.array(
        F.when((F.col("n") > 1) & (F.col("p").isNull() | (F.abs(F.col("p") - F.col("t0")) > 1e-6)), "not_contiguous"),
        F.when(F.col("t1") <= F.col("t0"), "empty"),
        F.when((F.col("bpm") <= 0) | (F.col("bpm") > most), "bpm"),
    )
    return rows.select("track_id", "t0", F.explode(F.array_compact(rules)).alias("rule"))


def beat_chain(peaks: DataFrame, period: float, bonus: float = 1.0) -> DataFrame:
    """``track_id, frame``: the chain of peaks ``(frame, support)`` of the highest score.

    A step of ``lag`` within ``LAGS`` periods costs ``TIGHT`` ln(lag / period)^2, each
    peak gives its support, a chain's first ``bonus``; ties go to the lag closest to
    the period, then the shorter.  The best end within the last 1.5 periods counts.
    Nodes are peaks, not frames, so what lies between two of them is for ``repair_beats``.
    One pass keeps the peaks of the last 1.5 periods and gives each its back link; a
    second one backwards reads the chain off them.
    """
    rows = peaks.where("frame IS NOT NULL").groupBy("track_id", F.col("frame").cast("double").alias("f")).agg(F.max(F.col("support").cast("double")).alias("s"))

    def forward(live: deque, f: float, s: float) -> list[tuple]:
        while live and live[0][0] < f - LAGS[1] * period:
            live.popleft()
        options = [(-(v - TIGHT * math.log((f - g) / period) ** 2 + s), abs(f - g - period), f - g, g) for g, v in live if LAGS[0] * period <= f - g <= LAGS[1] * period]
        best = min(options, default=None)
        v, link = (-best[0], best[3]) if best and -best[0] > s + bonus else (s + bonus, None)
        live.append((f, v))
        return [(f, v, link)]

    linked = fold(rows, ["track_id"], ["f"], "f double, v double, link double", deque, forward)

    def walked(state: dict, found: list[tuple]) -> list[tuple]:
        out = []
        for f, link in found:
            if f == state["at"]:
                out.append((int(f),))
                state["at"] = link
        return out

    def chosen(state: dict) -> list[tuple]:
        held, state["held"] = state["held"], None
        state["at"] = max((v, f) for f, v, _ in held)[1]
        return walked(state, [(f, link) for f, _, link in held])

    def backward(state: dict, f: float, v: float, link: float | None) -> list[tuple]:
        state.setdefault("last", f)
        if state["held"] is not None and f >= state["last"] - LAGS[1] * period:
            state["held"].append((f, v, link))
            return []
        out = chosen(state) if state["held"] is not None else []
        return out + walked(state, [(f, link)])

    return fold(linked, ["track_id"], [F.desc("f")], "frame long", lambda: {"held": []}, backward, lambda state: chosen(state) if state["held"] is not None else [])


def snap_beats(beats: DataFrame, frames: DataFrame, period: float, radius: int) -> DataFrame:
    """``track_id, t, snapped``: each beat moved to the greatest frame at most ``radius`` away, if order and lags allow.

    Of equal frames the closest counts, then the earlier.  One pass over a track's beats,
    with the last one as its state, accepts a move only beyond the beat before as it is now and before the next one,
    both gaps within ``LAGS`` periods.
    """
    near = beats.select("track_id", "t", F.explode(F.sequence(F.col("t") - radius, F.col("t") + radius)).alias("frame")).join(frames, ["track_id", "frame"])
    best = near.groupBy("track_id", "t").agg(F.min(F.struct((-F.col("x")).alias("x"), F.abs(F.col("frame") - F.col("t")).alias("d"), "frame"))["frame"].alias("to"))
    best = best.withColumn("next", F.lead("t").over(Window.partitionBy("track_id").orderBy("t")))
    ok = lambda gap: LAGS[0] * period <= gap <= LAGS[1] * period

    def step(last: list, t: int, to: int, following: int | None) -> list[tuple]:
        fits = (last[0] is None or (to > last[0] and ok(to - last[0]))) and (following is None or (to < following and ok(following - to)))
        last[0] = to if fits else t
        return [(t, last[0])]

    return fold(best.select("track_id", F.col("t").cast("long").alias("t"), F.col("to").cast("long").alias("to"), F.col("next").cast("long").alias("next")), ["track_id"], ["t"], "t long, snapped long", lambda: [None], step)


def repair_beats(beats: DataFrame, period: float) -> DataFrame:
    """``track_id, t, added``: beats closer than .55 periods to the one kept go; in gaps of 1.65 to 2.35 periods one is put in.

    A beat goes to the middle of such a gap.  One pass over a track's beats, with the
    last one kept as its state, drops; a window adds.
    """

    def step(last: list, t: float) -> list[tuple]:
        if last[0] is not None and t - last[0] < 0.55 * period:
            return []
        last[0] = t
        return [(t,)]

    rows = fold(beats.where("t IS NOT NULL").select("track_id", F.col("t").cast("double").alias("t")), ["track_id"], ["t"], "t double", lambda: [None], step)
    gap = F.lead("t").over(Window.partitionBy("track_id").orderBy("t")) - F.col("t")
    middle = F.when((gap > 1.65 * period) & (gap < 2.35 * period), F.col("t") + gap / 2)
    rows = rows.withColumn("m", middle)
    return rows.select("track_id", F.inline(F.array(F.struct("t", F.lit(False).alias("added")), F.struct(F.col("m").alias("t"), F.lit(True).alias("added"))))).where("t IS NOT NULL")


def _fits(runs: pd.Series) -> pd.Series:
    """Per run of at most ``LONGEST`` values the cost of each of its tails (1, 2, ... values) about the tail's median."""
    out = []
    for run in runs:
        back = np.asarray(run, float)[::-1]
        seen: list[float] = []
        middle = np.empty(len(back))
        for k, x in enumerate(back):
            insort(seen, x)
            middle[k] = (seen[k // 2] + seen[(k + 1) // 2]) / 2
        u = np.abs(back[None, :] - middle[:, None]) / SCALE
        out.append(np.tril(np.where(u <= 1, u * u / 2, u - 0.5)).sum(1).tolist())
    return pd.Series(out)


def segment_tempo_curve(intervals: DataFrame) -> DataFrame:
    """``track_id, a, b``: intervals a (in) to b (out) of one tempo, tiling a track at the least total cost.

    ``intervals(track_id, i, bpm)`` count from 0, ``change`` (0 to 1, how sure the tempo
    changes at i) may be there.  A span of at most ``LONGEST`` costs the Huber losses of
    its log tempos about their median, and ``BOUNDARY`` for its start unless that is the
    track's, less where a change is sure; spans inside a track have ``SHORTEST``
    intervals or more.  Ties: fewer spans, then the earlier boundary.

    Costs of all spans are made in parallel, a row per end; one pass over the ends
    keeps the last ``LONGEST`` ways and gives each its back link, a second one backwards
    reads the boundaries off.  Work is linear in the intervals.
    """
    change = clip(F.coalesce(F.col("change").cast("double"), F.lit(0.0))) if "change" in intervals.columns else F.lit(0.0)
    w = Window.partitionBy("track_id").orderBy("i")
    rows = intervals.select("track_id", "i", F.log2("bpm").alias("y"), change.alias("change"))
    rows = rows.select("track_id", "i", "change", F.lead("i").over(w).isNull().alias("last"), F.collect_list("y").over(w.rowsBetween(1 - LONGEST, 0)).alias("run"))
    fits = F.pandas_udf(_fits, "array<double>")
    rows = rows.select("track_id", F.col("i").cast("long").alias("i"), "change", "last", fits("run").alias("costs"))

    def start() -> dict:
        return {"ways": deque([(0.0, 0)], LONGEST), "entry": deque([], LONGEST)}

    def forward(state: dict, i: int, change: float, last: bool, costs: list[float]) -> list[tuple]:
        ways, entry = state["ways"], state["entry"]
        entry.append(BOUNDARY * max(0.0, 1 - RELAX * change) if i else 0.0)
        best = None
        for a in range(i + 1 - len(costs), i + 1):  # earlier starts first
            length = i + 1 - a
            if 0 < a and not last and length < SHORTEST:
                continue
            cost, n = ways[len(ways) - length]
            own = (cost + costs[length - 1] + entry[len(entry) - length], n + 1, a)
            if best is None or own[0] < best[0] - 1e-12 or (own[0] <= best[0] + 1e-12 and own[1:] < best[1:]):
                best = own
        if best is None:  # no legal span ends here
            best = (math.inf, 0, i)
        ways.append(best[:2])
        return [(i + 1, best[2])]

    linked = fold(rows, ["track_id"], ["i"], "b long, a long", start, forward)

    def backward(state: list, b: int, a: int) -> list[tuple]:
        if state[0] is not None and b != state[0]:
            return []
        state[0] = a
        return [(a, b)]

    return fold(linked, ["track_id"], [F.desc("b")], "a long, b long", lambda: [None], backward)


def tempo_segments(beats: DataFrame, duration: DataFrame | None = None) -> DataFrame:
    """``track_id, n, t0, t1, bpm, score``: tempo segments of beats ``(track_id, t)`` in order.

    Tempos are those of the intervals, smoothed by the median of three, segmented by
    ``segment_tempo_curve``; neighbours whose medians are less than ``MERGED`` octaves apart
    become one, again and again, each refitted to the median of all its intervals.
    The first starts at 0 and the last ends with the track (``duration(track_id,
    duration)``, else at the last beat).  ``beats`` may carry ``change`` and ``emission`` of the
    interval that starts there; ``score`` is a segment's mean emission, four decimals.
    Null and repeated times take no part; under two beats give nothing.
    """
    extra = [c for c in ("change", "emission") if c in beats.columns]
    w = Window.partitionBy("track_id").orderBy("t")
    one = beats.where("t IS NOT NULL").groupBy("track_id", F.col("t").cast("double").alias("t")).agg(F.lit(1).alias("_"), *[F.max(c).alias(c) for c in extra]).drop("_")
    rows = one.select("*", F.lead("t").over(w).alias("end"), (F.row_number().over(w).cast("long") - 1).alias("i")).where("end IS NOT NULL")
    rows = rows.withColumn("bpm", 60 / (F.col("end") - F.col("t")))
    rows = rows.withColumn("bpm", F.percentile("bpm", F.lit(0.5)).over(Window.partitionBy("track_id").orderBy("i").rowsBetween(-1, 1)))
    cuts = segment_tempo_curve(rows.select("track_id", "i", "bpm", *[c for c in extra if c == "change"]))
    rows = rows.join(cuts.select("track_id", F.col("a").alias("i"), F.lit(True).alias("opens")), ["track_id", "i"], "left")
    if duration is not None:
        rows = rows.join(duration.select("track_id", F.col("duration").cast("double").alias("duration")), "track_id", "left")
    emission = F.col("emission").cast("double") if "emission" in extra else F.lit(None).cast("double")
    rows = rows.select("track_id", "i", "t", "end", F.log2("bpm").alias("y"), clip(emission).alias("emission"), F.coalesce("opens", F.lit(False)).alias("opens"), (F.col("duration") if duration is not None else F.lit(None).cast("double")).alias("duration"))
    apart = lambda a, b: abs(float(np.median(a["y"])) - float(np.median(b["y"])))

    def settled(done: list[dict]) -> None:
        while len(done) > 1 and apart(done[-1], done[-2]) < MERGED:
            last = done.pop()
            done[-1]["y"].extend(last["y"])
            done[-1].update(t1=last["t1"], sum=done[-1]["sum"] + last["sum"], scored=done[-1]["scored"] + last["scored"])

    def step(done: list[dict], i: int, t: float, end: float, y: float, emission: float | None, opens: bool, duration: float | None) -> list[tuple]:
        if opens or not done:
            settled(done)
            done.append({"t0": 0.0 if i == 0 else t, "y": array("d"), "sum": 0.0, "scored": 0})
        own = done[-1]
        own["y"].append(y)
        own.update(t1=end, duration=duration)
        if emission is not None:
            own["sum"] += emission
            own["scored"] += 1
        return []

    def finish(done: list[dict]) -> list[tuple]:
        total = done[-1]["duration"]
        settled(done)
        if total is not None:
            done[-1]["t1"] = total
        return [(n, x["t0"], x["t1"], 2.0 ** float(np.median(x["y"])), round(x["sum"] / x["scored"], 4) if x["scored"] else None) for n, x in enumerate(done, 1)]

    return fold(rows, ["track_id"], ["i"], "n long, t0 double, t1 double, bpm double, score double", list, step, finish)


#: Fixed values of a beat's refinement: window and least gap in periods, weights of onset and support, cost of a period's move, gain it takes, reach of an onset.
WINDOW, LEAST_GAP, BY_ONSET, BY_SUPPORT, MOVE, MARGIN, CLOSE = 0.25, 0.25, 1.0, 0.6, 0.8, 0.15, 0.05

#: Width of the cells in which beats meet onsets, and how much wider those of the next level are.
SPAN, WIDER = 1.0, 16.0


def refine_beats(beats: DataFrame, onsets: DataFrame, support: DataFrame | None, rate: float, close: float = CLOSE) -> DataFrame:
    """``track_id, i, original, chosen, moved, reason, score, margin``: what became of each beat ``(track_id, t)``, in order.

    A beat may stay, go to an onset, or go to the highest ``support(track_id, frame, x)``
    (``rate`` frames a unit), each within ``WINDOW`` periods; its period is the mean of both
    intervals, the one there is at an end.  A place scores ``BY_ONSET`` times the nearness
    of an onset (1 there, 0 from ``close`` on), ``BY_SUPPORT`` times the support, less ``MOVE`` a
    period of way.  The best place (first of equal ones: the beat, onsets in order, the
    peak) is taken if it gains ``MARGIN`` and keeps ``LEAST_GAP`` periods to the beat before, as
    it is now, and to the next one.  ``reason``: moved, stay, no-local-period,
    too-few-beats.  One pass over a track's beats keeps the last one.

    Onsets and support meet a beat in the cells its own reach covers, ``SPAN`` wide or, for long
    reaches, ``WIDER`` times that and so on, so one long gap makes no other beat meet more.
    """
    w = Window.partitionBy("track_id").orderBy("t")
    rows = beats.where("t IS NOT NULL").select("track_id", F.col("t").cast("double").alias("t"))
    left, right = F.col("t") - F.lag("t").over(w), F.lead("t").over(w) - F.col("t")
    rows = rows.select("track_id", (F.row_number().over(w).cast("long") - 1).alias("i"), "t", F.lead("t").over(w).alias("next"), F.greatest(F.coalesce((left + right) / 2, left, right, F.lit(0.0)), F.lit(0.0)).alias("period"), (left.isNull() & right.isNull()).alias("alone"))
    rows = rows.withColumn("reach", F.col("period") * WINDOW)
    places = rows.select("track_id", "i", F.lit(0).alias("rank"), F.col("t").alias("at"), "t", "period")
    level = F.floor(F.log(F.greatest(F.col("reach") / SPAN, F.lit(1.0))) / F.log(F.lit(WIDER))).cast("long")
    spans = rows.where("period > 0").withColumn("level", level).withColumn("width", SPAN * F.pow(F.lit(WIDER), "level"))
    most = spans.agg(F.max("level")).first()[0] or 0
    cells = lambda low, high: F.explode(F.sequence(F.floor(low), F.floor(high)))
    dealt = lambda df, at: df.withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long")))).withColumn("cell", F.floor(at / (SPAN * F.pow(F.lit(WIDER), "level"))))
    keys = ["track_id", "level", "cell"]
    onset = dealt(onsets.where("t IS NOT NULL").select("track_id", F.col("t").cast("double").alias("at")), F.col("at"))
    near = spans.withColumn("cell", cells((F.col("t") - F.col("reach")) / F.col("width") - 1e-6, (F.col("t") + F.col("reach")) / F.col("width") + 1e-6)).join(onset, keys).where(F.abs(F.col("at") - F.col("t")) <= F.col("reach"))
    places = places.unionByName(near.select("track_id", "i", F.lit(1).alias("rank"), "at", "t", "period"))
    if support is not None:
        frames = support.groupBy("track_id", F.col("frame").cast("long").alias("frame")).agg(F.max("x").alias("x"))
        low, high = F.greatest(F.bround((F.col("t") - F.col("reach")) * rate).cast("long"), F.lit(0)), F.bround((F.col("t") + F.col("reach")) * rate).cast("long")
        window = spans.select("track_id", "i", "t", "period", "level", "width", low.alias("low"), high.alias("high")).where("low <= high")
        window = window.withColumn("cell", cells(F.col("low") / rate / F.col("width") - 1e-6, F.col("high") / rate / F.col("width") + 1e-6))
        peak = window.join(dealt(frames, F.col("frame") / rate), keys).where("frame BETWEEN low AND high")
        peak = peak.groupBy("track_id", "i", "t", "period").agg(F.max_by("frame", F.struct("x", -F.col("frame"))).alias("frame"))
        places = places.unionByName(peak.select("track_id", "i", F.lit(2).alias("rank"), (F.col("frame") / rate).alias("at"), "t", "period"))
    asked = joins.nearest(places.select("track_id", "i", "rank", "t", "period", F.col("at").alias("place")).withColumnRenamed("t", "own").withColumnRenamed("place", "t"), onsets.where("t IS NOT NULL").select("track_id", "t"), "o")
    asked = asked.select("track_id", "i", "rank", F.col("t").alias("at"), "own", "period", F.coalesce(linear_kernel(F.col("o.ft") - F.col("t"), close), F.lit(0.0)).alias("onset"))
    if support is not None:
        asked = asked.withColumn("frame", F.bround(F.col("at") * rate).cast("long")).join(frames, ["track_id", "frame"], "left")
    evidence = BY_ONSET * F.col("onset") + (BY_SUPPORT * F.coalesce("x", F.lit(0.0)) if support is not None else 0.0)
    scored = asked.where("period > 0").withColumn("score", evidence - MOVE * F.abs(F.col("at") - F.col("own")) / F.col("period"))
    best = scored.groupBy("track_id", "i").agg(F.min(F.struct((-F.col("score")).alias("s"), "rank", "at")).alias("b"), F.max(F.when(F.col("rank") == 0, F.col("score"))).alias("stay"))
    found = rows.join(best, ["track_id", "i"], "left").select("track_id", "i", "t", "next", "period", "alone", F.col("b.at").alias("at"), (-F.col("b.s")).alias("score"), (-F.col("b.s") - F.col("stay")).alias("margin"))

    def step(last: list, i: int, t: float, following: float | None, period: float, alone: bool, at: float | None, score: float | None, margin: float | None) -> list[tuple]:
        chosen, reason = t, "stay"
        if alone or not period > 0:
            reason, score, margin = "too-few-beats" if alone else "no-local-period", 0.0, 0.0
        else:
            gap = LEAST_GAP * period
            fits = (last[0] is None or at >= last[0] + gap) and (following is None or at <= following - gap)
            if margin >= MARGIN and fits and at != t:
                chosen, reason = at, "moved"
        last[0] = chosen
        return [(i, t, chosen, chosen != t, reason, score, margin)]

    return fold(found, ["track_id"], ["i"], "i long, original double, chosen double, moved boolean, reason string, score double, margin double", lambda: [None], step)
