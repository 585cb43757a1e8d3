"""Scores of matched events, tempo and structure; gates; ranking figures.

Scores are null where nothing can be scored.  ``pairs`` are ``track_id, r, e, rt, et``:
index and time of a reference and of the estimate matched to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins, matching


#: Width of the cells in which windows meet events.
CELL = 8.0


def _by(*order: str, key: tuple[str, ...] = ("track_id",)) -> object:
    return Window.partitionBy(*key).orderBy(*order)


def mutual_pairs(reference: DataFrame, estimate: DataFrame, tol: float) -> DataFrame:
    """Pairs within ``tol`` that are each other's nearest; of two as near the earlier counts."""
    r, e = reference.select("track_id", F.col("idx").alias("id"), "t"), estimate.select("track_id", F.col("idx").alias("id"), "t")
    rows = joins.band(r, e, tol).withColumn("d", F.abs(F.col("t") - F.col("other_t")))
    rows = rows.withColumn("a", F.row_number().over(_by("d", "other_t", key=("track_id", "id")))).withColumn("b", F.row_number().over(_by("d", "t", key=("track_id", "other_id"))))
    return rows.where("a = 1 AND b = 1").select("track_id", F.col("id").alias("r"), F.col("other_id").alias("e"), F.col("t").alias("rt"), F.col("other_t").alias("et"))


def ratio(a: Column, b: Column) -> Column:
    """a / b to four decimals, null where b is 0; halves go up on both engines' terms."""
    return F.when(b > 0, F.floor(a * 10000 / b + 0.5) / 10000)


def prf(pairs: DataFrame, reference: DataFrame, estimate: DataFrame) -> DataFrame:
    """``track_id, matched, precision, recall, f1, mae``: tracks of either side."""
    r = reference.groupBy("track_id").agg(F.count("*").alias("r"))
    e = estimate.groupBy("track_id").agg(F.count("*").alias("e"))
    m = pairs.groupBy("track_id").agg(F.count("*").alias("matched"), F.avg(F.abs(F.col("rt") - F.col("et"))).alias("mae"))
    rows = r.join(e, "track_id", "full").join(m, "track_id", "left").fillna(0, ["r", "e", "matched"])
    n = F.col("matched")
    return rows.select("track_id", n.alias("matched"), ratio(n, F.col("e")).alias("precision"), ratio(n, F.col("r")).alias("recall"), ratio(2 * n, F.col("r") + F.col("e")).alias("f1"), "mae")


def boundary_metrics(truth: DataFrame, predicted: DataFrame, tol: float) -> DataFrame:
    """``track_id, precision, recall, f1, mae, matched, predicted, truth`` of boundaries ``(track_id, id, t)`` in bars.

    Pairs go closest first, one to one.  Sides that are empty score 0; tracks without a
    boundary on either side have no row; mae is null without a pair.
    """
    pairs = matching.match(truth, predicted, tol).groupBy("track_id").agg(F.count("*").alias("matched"), F.avg("distance").alias("mae"))
    n = lambda rows, c: rows.groupBy("track_id").agg(F.count("*").alias(c))
    rows = n(truth, "truth").join(n(predicted, "predicted"), "track_id", "full").join(pairs, "track_id", "left").fillna(0, ["truth", "predicted", "matched"])
    share = lambda c: F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col(c)), F.lit(0.0))
    p, r = share("predicted"), share("truth")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return rows.select("track_id", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"), F.round("mae", 3).alias("mae"), "matched", "predicted", "truth")


def beat_in_bar_accuracy(pairs: DataFrame, reference: DataFrame, estimate: DataFrame) -> DataFrame:
    """Share of matched pairs whose places in the bar are equal."""
    a = reference.select("track_id", F.col("idx").alias("r"), F.col("beat_in_bar").alias("x"))
    b = estimate.select("track_id", F.col("idx").alias("e"), F.col("beat_in_bar").alias("y"))
    rows = pairs.join(a, ["track_id", "r"]).join(b, ["track_id", "e"])
    return rows.groupBy("track_id").agg(ratio(F.sum((F.col("x") == F.col("y")).cast("long")), F.count("*")).alias("accuracy"))


def bpm_at(queries: DataFrame, segments: DataFrame, width: float) -> DataFrame:
    """Queries with ``predicted``: bpm of the first segment that holds t, both ends in."""
    first = segments.groupBy("track_id").agg(F.min(F.struct("t0", "bpm")).alias("first"))
    found = joins.asof(queries, segments.select("track_id", F.col("t0").alias("t"), "t1", "bpm"), "s", strict=True, width=width).join(first, "track_id", "left")
    inside = F.when(F.col("t") <= F.col("s.t1"), F.col("s.bpm")).when(F.col("first.t0") == F.col("t"), F.col("first.bpm"))
    return found.select(*queries.columns, inside.alias("predicted"))


def tempo_segment_errors(truth: DataFrame, predicted: DataFrame, width: float = 256.0) -> DataFrame:
    """``track_id, merged, change_error, bpm_error``: first change point, and mean error of bpm at the truth's middles."""
    ends = lambda rows: rows.groupBy("track_id").agg(F.count("*").alias("n"), F.min_by("t1", "t0").alias("end"))
    middles = truth.where("t1 IS NOT NULL").select("track_id", "id", ((F.col("t0") + F.col("t1")) / 2).alias("t"), "bpm")
    errors = bpm_at(middles, predicted, width).groupBy("track_id").agg(F.avg(F.abs(F.col("predicted") - F.col("bpm"))).alias("bpm_error"))
    rows = ends(truth).select("track_id", F.col("end").alias("te")).join(ends(predicted), "track_id", "left").join(errors, "track_id", "left")
    merged = F.coalesce("n", F.lit(0)) < 2
    return rows.select("track_id", merged.alias("merged"), F.when(~merged, F.abs(F.col("end") - F.col("te"))).alias("change_error"), "bpm_error")


def tempo_curve_errors(anchors: DataFrame, predicted: DataFrame, width: float = 256.0) -> DataFrame:
    """``track_id, n, mae, direction, octaves`` over anchors ``(id, t, bpm)`` that a segment covers.

    ``direction``: of steps where the truth moves by .5 or more, how many the estimate makes the same way.
    """
    rows = bpm_at(anchors, predicted, width).where("predicted IS NOT NULL")
    w = _by("t", "id")
    a, b = F.col("bpm") - F.lag("bpm").over(w), F.col("predicted") - F.lag("predicted").over(w)
    rows = rows.withColumn("a", a).withColumn("b", b)
    moves = F.count_if(F.abs("a") >= 0.5)
    return rows.groupBy("track_id").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("predicted") - F.col("bpm"))).alias("mae"), ratio(F.count_if((F.abs("a") >= 0.5) & (F.col("a") * F.col("b") > 0)), moves).alias("direction"), F.max(F.abs(F.log2(F.col("predicted") / F.col("bpm")))).alias("octaves"))


def octave_errors(pairs: DataFrame, least: float = 0.75) -> DataFrame:
    """``track_id, n``: neighbouring matched intervals that are off by more than ``least`` octaves."""
    w = _by("r")
    rows = pairs.select("track_id", "r", F.lead("r").over(w).alias("r2"), (F.lead("rt").over(w) - F.col("rt")).alias("a"), (F.lead("et").over(w) - F.col("et")).alias("b"))
    wrong = (F.col("r2") == F.col("r") + 1) & (F.col("a") > 0) & (F.col("b") / F.col("a") > 0) & (F.abs(F.log2(F.col("b") / F.col("a"))) > least)
    return rows.groupBy("track_id").agg(F.count_if(wrong).alias("n"))


def seams(changes: DataFrame, reference: DataFrame, estimate: DataFrame, pairs: DataFrame, tol: float, before: int = 8, after: int = 16) -> DataFrame:
    """``track_id, change, matched, missing, extra, mae`` around each change (index of its first beat).

    The window is ``before`` reference beats and ``after`` from the change on, so no
    estimate can choose it; estimates in it, by time, that match nothing are extra.
    """
    spans = changes.select("track_id", F.col("idx").alias("change"), F.explode(F.sequence(F.col("idx") - before, F.col("idx") + after - 1)).alias("idx"))
    inside = spans.join(reference.select("track_id", "idx", "t"), ["track_id", "idx"])
    hits = inside.join(pairs.select("track_id", F.col("r").alias("idx"), "rt", "et"), ["track_id", "idx"], "left")
    rows = hits.groupBy("track_id", "change").agg(F.count("*").alias("n"), F.count("et").alias("matched"), (F.min("t") - tol).alias("w0"), (F.max("t") + tol).alias("w1"), F.avg(F.abs(F.col("rt") - F.col("et"))).alias("mae")).where("n >= 2")
    cell = lambda c: F.floor(F.col(c) / CELL)
    spread = rows.select("track_id", "change", "w0", "w1", F.explode(F.sequence(cell("w0"), cell("w1"))).alias("cell"))
    in_window = spread.join(estimate.select("track_id", "t", cell("t").alias("cell")), ["track_id", "cell"]).where(F.col("t").between(F.col("w0"), F.col("w1"))).groupBy("track_id", "change").agg(F.count("*").alias("p"))
    rows = rows.join(in_window, ["track_id", "change"], "left").fillna(0, ["p"])
    return rows.select("track_id", "change", "matched", (F.col("n") - F.col("matched")).alias("missing"), F.greatest(F.col("p") - F.col("matched"), F.lit(0)).alias("extra"), "mae")


def worst_seams(rows: DataFrame, most: int) -> DataFrame:
    """``track_id, missing, extra, failed``: the worst seam of each track against a limit."""
    return rows.groupBy("track_id").agg(F.max("missing").alias("missing"), F.max("extra").alias("extra")).withColumn("failed", (F.col("missing") > most) | (F.col("extra") > most))


def beat_scores(reference: DataFrame, estimate: DataFrame, trim: float = 5.0, tol: float = 0.07, sigma: float = 0.04, share: float = 0.175) -> DataFrame:
    """``track_id, f, cemgil, cmlc, cmlt, amlc, amlt`` by the published definitions (Davies and others, 2009).

    Events before ``trim`` go; under two on either side every score is 0.  A beat is
    right if it is within ``share`` of the reference interval from its nearest
    reference and its own interval as near the reference's; the first of a track has no
    interval.  cmlc is the longest right run, cmlt all of them, over the longer of both
    lists.  aml takes the best of the reference, its off-beats, both together, and
    every other one of it from the first or the second on.
    """
    r, e = reference.where(F.col("t") >= trim).select("track_id", "t"), estimate.where(F.col("t") >= trim).select("track_id", "t")
    ordered = lambda rows: rows.withColumn("idx", F.row_number().over(_by("t"))).withColumn("gap", F.col("t") - F.lag("t").over(_by("t")))
    r, e = ordered(r), ordered(e)
    nr, ne = r.groupBy("track_id").agg(F.count("*").alias("nr")), e.groupBy("track_id").agg(F.count("*").alias("ne"))
    both = nr.join(ne, "track_id", "full").fillna(0, ["nr", "ne"])
    hits = mutual_pairs(r, e, tol).groupBy("track_id").agg(F.count("*").alias("hits"))
    near = joins.nearest(r.select("track_id", "t"), e.select("track_id", "t"), "x")
    gauss = near.groupBy("track_id").agg(F.sum(F.exp(-F.pow(F.col("t") - F.col("x.ft"), F.lit(2.0)) / (2 * sigma * sigma))).alias("gauss"))
    off = r.select("track_id", (F.col("t") - F.col("gap") / 2).alias("t")).where("t IS NOT NULL")
    plain = r.select("track_id", "t")
    variants = [plain, off, plain.unionByName(off), r.where("idx % 2 = 1").select("track_id", "t"), r.where("idx % 2 = 0").select("track_id", "t")]
    every = None
    for n, v in enumerate(variants):
        v = v.select(F.struct("track_id", F.lit(n).alias("v")).alias("track_id"), "t")
        every = v if every is None else every.unionByName(v)
    every = every.select("track_id", "t", F.coalesce(F.col("t") - F.lag("t").over(_by("t")), F.lead("t").over(_by("t")) - F.col("t")).alias("step"), (F.col("t") - F.lag("t").over(_by("t"))).alias("gap"))
    asked = e.select(F.explode(F.sequence(F.lit(0), F.lit(len(variants) - 1))).alias("v"), F.col("track_id").alias("own"), "t", "idx", F.col("gap").alias("mine")).select(F.struct(F.col("own").alias("track_id"), "v").alias("track_id"), "t", "idx", "mine")
    found = joins.nearest(asked, every, "x")
    right = (F.abs(F.col("t") - F.col("x.ft")) <= share * F.col("x.step")) & (F.col("mine").isNull() | F.col("x.gap").isNull() | (F.abs(F.col("mine") - F.col("x.gap")) <= share * F.col("x.gap")))
    rows = found.select("track_id", "idx", F.coalesce(right, F.lit(False)).alias("right"))
    rows = rows.withColumn("run", F.sum((~F.col("right")).cast("int")).over(_by("idx"))).where("right")
    runs = rows.groupBy("track_id", "run").agg(F.count("*").alias("n")).groupBy("track_id").agg(F.max("n").alias("c"), F.sum("n").alias("all"))
    best = runs.groupBy(F.col("track_id.track_id").alias("track_id")).agg(*[F.max(F.when(F.col("track_id.v") == 0, F.col(c))).alias(f"cml_{c}") for c in ("c", "all")], *[F.max(c).alias(f"aml_{c}") for c in ("c", "all")])
    out = both.join(hits, "track_id", "left").join(gauss, "track_id", "left").join(best, "track_id", "left").fillna(0)
    ok, longer = (F.col("nr") >= 2) & (F.col("ne") >= 2), F.greatest("nr", "ne")
    per = lambda c, n: F.when(ok, c / n).otherwise(0.0)
    return out.select("track_id", per(2 * F.col("hits"), F.col("nr") + F.col("ne")).alias("f"), per(2 * F.col("gauss"), F.col("nr") + F.col("ne")).alias("cemgil"), *[per(F.col(f"{m}ml_{c}"), longer).alias(f"{m}ml{k}") for m in ("c", "a") for k, c in (("c", "c"), ("t", "all"))])


def quantization_error(pairs: DataFrame, quantized: DataFrame) -> DataFrame:
    """Mean distance of each matched estimate's grid time from its reference: ``quantized(track_id, e, q)``."""
    return pairs.join(quantized, ["track_id", "e"]).groupBy("track_id").agg(F.avg(F.abs(F.col("q") - F.col("rt"))).alias("error"), F.count("*").alias("n"))


def gates(cases: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``cases`` with ``failed``: names of the rules that do not hold, comma-joined; a null condition does not fail."""
    return cases.withColumn("failed", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])), ","))


def case_gates(cases: DataFrame) -> DataFrame:
    """Absolute limits of a case ``(bpm_error, f1, false_events, invalid, fixed)``."""
    return gates(cases, {"invalid-schema": F.col("invalid"), "fixed-bpm": F.col("bpm_error") > 5, "beat-f1-floor": F.col("fixed") & (F.col("f1") < 0.5), "silence": F.col("false_events") > 20})


def baseline_gates(cases: DataFrame, accepted: DataFrame) -> DataFrame:
    """Cases against accepted figures ``(track_id, base_f1, base_mae, f1_min)``: f1 down by over .03, mae up by over 15 ms, below the declared least."""
    rows = cases.join(accepted, "track_id", "left")
    return gates(rows, {"f1-regression": F.col("f1") < F.col("base_f1") - 0.03, "mae-regression": F.col("mae") > F.col("base_mae") + 0.015, "f1-below-minimum": F.col("f1") < F.col("f1_min")})


def baseline_state(cases: DataFrame, accepted: DataFrame, least: float) -> DataFrame:
    """``track_id, state``: ``missing`` or ``stale`` entries, ``invalid`` figures, ``refused`` (a case below ``least``) or ``ok``."""
    rows = cases.select("track_id", F.lit(True).alias("case"), "f1").join(accepted, "track_id", "full")
    state = F.when(F.col("base_f1").isNull() & F.col("case").isNotNull(), "missing").when(F.col("case").isNull(), "stale").when(~F.col("base_f1").between(0, 1), "invalid").when(F.col("f1") < least, "refused").otherwise("ok")
    return rows.select("track_id", state.alias("state"))


def structure_gates(cases: DataFrame) -> DataFrame:
    """Limits of a structure case ``(truth_bounds, f1, mae_bars, family_f1, predicted_bounds, gaps)``."""
    some = F.col("truth_bounds") > 0
    return gates(cases, {"boundary-f1": some & (F.col("f1") < 0.8), "boundary-mae": some & (F.col("mae_bars") > 1), "monotony": ~some & (F.col("predicted_bounds") > 0), "family-f1": F.col("family_f1") < 0.8, "coverage": F.col("gaps") > 0})


# ranking ---------------------------------------------------------------------------------


def rank_features(evidence: DataFrame, base: list[str]) -> DataFrame:
    """``track_id, id, feature, x`` in long form: each base column, 0 where missing, its flag, and its square."""
    one = lambda c: [F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("x")), F.struct(F.lit(f"{c}_missing").alias("feature"), F.col(c).isNull().cast("double").alias("x")), F.struct(F.lit(f"{c}_squared").alias("feature"), F.coalesce(F.col(c).cast("double") * F.col(c), F.lit(0.0)).alias("x"))]
    return evidence.select("track_id", "id", F.inline(F.array(*[s for c in base for s in one(c)])))


def ablated(features: DataFrame, dropped: list[str]) -> DataFrame:
    """Features in long form without those whose base is among ``dropped``."""
    return features.where(~F.regexp_replace("feature", "_(missing|squared)$", "").isin(dropped))


def score_trees(rows: DataFrame, model: dict, digits: int | None = 6) -> DataFrame:
    """``relevance`` = sigmoid(base + anchor * strength + rate * sum of trees), six decimals.

    ``by`` of the model names another column than strength; ``digits`` None leaves the
    sum as it is, for ranking.

    A tree is a leaf value or ``(column, threshold, left, right)``; values up to the
    threshold go left, missing ones count as 0.  Trees are summed a dozen at a time, so
    that no generated method grows too large to be compiled.
    """

    def tree(node: object) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        column, threshold, left, right = node
        return F.when(F.coalesce(F.col(column), F.lit(0.0)) <= float(threshold), tree(left)).otherwise(tree(right))

    rows = rows.withColumn("sum", F.lit(0.0))
    for at in range(0, len(model["trees"]), 12):
        for t in model["trees"][at : at + 12]:
            rows = rows.withColumn("sum", F.col("sum") + tree(t))
    z = model["base"] + model["anchor"] * F.coalesce(F.col(model.get("by", "strength")), F.lit(0.0)) + model["rate"] * F.col("sum")
    return rows.withColumn("relevance", z if digits is None else F.round(1 / (1 + F.exp(-z)), digits)).drop("sum")


def fit_pairwise(pairs: DataFrame, columns: list[str], penalty: float = 1.0, rounds: int = 50) -> list[float]:
    """Weights of a pairwise logistic model by Newton's method: ``pairs`` hold differences (better less worse).

    Gradient and Hessian are one aggregate of a row a round, whose size is the square
    of the columns, whatever the pairs; the step is solved on the driver.  The pairs
    are made once and read from the cache in all rounds.
    """
    cached = pairs.is_cached
    held = pairs if cached else pairs.select(*columns).persist()
    try:
        return _newton(held, columns, penalty, rounds)
    finally:
        if not cached:
            held.unpersist()


def _newton(pairs: DataFrame, columns: list[str], penalty: float, rounds: int) -> list[float]:
    import numpy as np

    w = np.zeros(len(columns))
    xs = [F.col(c) for c in columns]
    for _ in range(rounds):
        z = sum((x * float(v) for x, v in zip(xs, w, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(z))  # chance of the pair being the wrong way round
        rows = pairs.select(*xs, p.alias("_p"))
        sums = [F.sum(-F.col("_p") * x) for x in xs] + [F.sum(F.col("_p") * (1 - F.col("_p")) * a * b) for a in xs for b in xs]
        got = np.array([v or 0.0 for v in rows.agg(*sums).first()], float)
        n = len(w)
        gradient, hessian = got[:n] + penalty * w, got[n:].reshape(n, n) + penalty * np.eye(n)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(gradient).max() < 1e-8 or gradient @ step < 1e-12:
            break
    return w.tolist()


def select_spaced(rows: DataFrame, anchor: float = 0.82, support: float = 0.74, neighbour: float = 0.48, apart: float = 0.16) -> DataFrame:
    """``track_id, id, t, relevance``: the most relevant first, none within ``apart`` of one chosen.

    Eligible are events of ``anchor`` or more, and those of ``support`` or more that have
    an anchor within ``neighbour``.  The fold runs inside islands of eligible events.
    """
    anchors = rows.where(F.col("relevance") >= anchor)
    close = joins.band(rows.where(F.col("relevance") >= support), anchors, neighbour).select("track_id", "id").distinct()
    fit = rows.join(close, ["track_id", "id"], "left_semi")
    w = _by("t", "id")
    fit = fit.withColumn("island", F.sum(F.when(F.col("t") - F.lag("t").over(w) < apart, 0).otherwise(1)).over(w))
    lists = fit.groupBy("track_id", "island").agg(F.sort_array(F.collect_list(F.struct((-F.col("relevance")).alias("r"), "t", "id"))).alias("xs"))
    kind = fit.select(F.struct((-F.col("relevance")).alias("r"), "t", "id").alias("x")).schema["x"].dataType.simpleString()
    step = lambda kept, x: F.when(F.exists(kept, lambda k: F.abs(k["t"] - x["t"]) < apart), kept).otherwise(F.concat(kept, F.array(x)))
    return lists.select("track_id", F.inline(F.aggregate("xs", F.array().cast(f"array<{kind}>"), step))).select("track_id", "id", "t", (-F.col("r")).alias("relevance"))


def cut_intervals(events: DataFrame, boundaries: DataFrame, tracks: DataFrame, apart: float) -> DataFrame:
    """``track_id, t0, t1, kind``: the start, boundaries, and events at least ``apart`` from the start and every boundary; the last ends with the track."""
    near = joins.band(events.select("track_id", "id", "t"), boundaries.select("track_id", F.col("t").alias("id"), "t"), apart).where(F.abs(F.col("t") - F.col("other_t")) < apart).select("track_id", "id").distinct()
    free = events.where(F.col("t") >= apart).join(near, ["track_id", "id"], "left_anti").select("track_id", "t", F.lit(2).alias("o"))
    rows = tracks.select("track_id", F.lit(0.0).alias("t"), F.lit(0).alias("o")).unionByName(boundaries.select("track_id", "t", F.lit(1).alias("o"))).unionByName(free)
    one = rows.groupBy("track_id", "t").agg(F.min("o").alias("o")).join(tracks.select("track_id", "duration"), "track_id")
    kind = F.element_at(F.array(F.lit("start"), F.lit("boundary"), F.lit("onset")), F.col("o") + 1)
    return one.select("track_id", F.col("t").alias("t0"), F.coalesce(F.lead("t").over(_by("t")), "duration").alias("t1"), kind.alias("kind"))


def top_support_precision(scored: DataFrame, support: str, k: int) -> DataFrame:
    """Of the ``k`` most relevant events of a track, how many are among its ``k`` best supported."""
    rows = scored.withColumn("a", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("relevance"), "id"))).withColumn("b", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc(support), "id")))
    return rows.groupBy("track_id").agg(ratio(F.count_if((F.col("a") <= k) & (F.col("b") <= k)), F.least(F.count("*"), F.lit(k))).alias("precision"))


def macro(rows: DataFrame, metric: str) -> DataFrame:
    """``mean, n`` over tracks whose figure is finite."""
    fine = rows.where(F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(F.col(metric)) != float("inf")))
    return fine.agg(F.avg(metric).alias("mean"), F.count("*").alias("n"))


def paired_bootstrap(deltas: DataFrame, metric: str, replicates: int, seed: str) -> DataFrame:
    """``low, mean, high``: the 2.5 and 97.5 percentiles of the mean of ``deltas(track_id, metric)`` drawn with replacement.

    Draw s of replicate r is row md5(seed:r:s) mod n in order of track_id, so the same
    rows give the same interval anywhere.  Rows are numbered by one window over tracks, a
    figure each.
    """
    rows = deltas.withColumn("i", F.row_number().over(Window.orderBy("track_id")) - 1)
    n = F.broadcast(deltas.agg(F.count("*").alias("n")))  # one row
    slots = rows.select("i").join(n).select(F.col("i").alias("s"), "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r"))
    pick = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(seed), "r", "s")), F.lit(8)), 16, 10).cast("long") % F.col("n")
    means = slots.withColumn("i", pick).join(rows.select("i", metric), "i").groupBy("r").agg(F.avg(metric).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.avg("m").alias("mean"), F.percentile("m", F.lit(0.975)).alias("high"))


def slices(rows: DataFrame, tags: dict[str, Column], metric: str) -> DataFrame:
    """``slice, n, mean``: a row counts in every slice whose condition holds."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tags.items()]))
    return rows.select(F.explode(named).alias("slice"), F.col(metric).alias("m")).groupBy("slice").agg(F.count("*").alias("n"), F.avg("m").alias("mean"))


def promotion_gates(figures: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """``name, value, passed`` of ``figures(name, value)`` against ``(side, limit)``; a figure that is null or not there fails."""
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("side"), F.lit(float(v)).alias("at")) for n, (s, v) in limits.items()]))
    table = figures.sparkSession.range(1).select(wanted.alias("g")).select("g.*")
    ok = F.when(F.col("side") == "min", F.col("value") >= F.col("at")).otherwise(F.col("value") <= F.col("at"))
    return table.join(figures, "name", "left").select("name", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


def select_candidate(rows: DataFrame, eligible: Column, *order: Column) -> DataFrame:
    """The one best eligible candidate."""
    return rows.where(eligible).orderBy(*order).limit(1)


def leave_one_out(rows: DataFrame, source: str, figure: str) -> DataFrame:
    """Per source: ``error`` of its mean ``figure`` as the mean of all other sources' rows predicts it; each row is validated once."""
    own = rows.groupBy(source).agg(F.sum(figure).alias("s"), F.count("*").alias("n"))
    total = F.broadcast(own.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn")))  # one row
    left = F.col("tn") - F.col("n")
    return own.join(total).select(source, "n", F.when(left > 0, F.abs(F.col("s") / F.col("n") - (F.col("ts") - F.col("s")) / left)).alias("error"))
