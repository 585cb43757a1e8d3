"""Charts of a track, their labels and splits; edits against pictures; rules that rows have to keep.

Rules give ``track_id, rule, detail`` rows for what they find; a clean table gives none.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoflux.functions.columns import fixed

from . import joins
from .evidence import hash_ranked
from .folds import fold


def marker_hash(charts: DataFrame) -> DataFrame:
    """``track_id, chart, n, hash``: SHA-256 of a chart's times as a JSON list of six decimals."""
    written = charts.select("track_id", "chart", "t", fixed(F.col("t"), 6).alias("text"))
    rows = written.groupBy("track_id", "chart").agg(F.sort_array(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "text")))).alias("x"))
    text = F.concat(F.lit("["), F.array_join("x.text", ","), F.lit("]"))
    return rows.select("track_id", "chart", F.size("x").alias("n"), F.sha2(text, 256).alias("hash"), F.col("x.t").alias("ts"))


def group_charts(charts: DataFrame, least_markers: int = 2, least_charts: int = 3) -> DataFrame:
    """``track_id, chart, place, reason``: charts by density, or why one is out.

    Under ``least_markers`` different times: ``few_markers``; the same times as a chart of
    a smaller name: ``duplicate``; tracks left with under ``least_charts``: ``few_charts``.
    """
    rows = marker_hash(charts).withColumn("unique", F.size(F.array_distinct("ts")))
    span = F.element_at("ts", -1) - F.element_at("ts", 1)
    density = F.when((F.col("n") < 2) | (span <= 0), float("inf")).otherwise(F.col("n") / span)
    enough = F.col("unique") >= least_markers
    first = F.row_number().over(Window.partitionBy("track_id", "hash", enough).orderBy("chart"))
    rows = rows.withColumn("density", density).withColumn("reason", F.when(~enough, "few_markers").when(first > 1, "duplicate"))
    rows = rows.withColumn("kept", F.count_if(F.col("reason").isNull()).over(Window.partitionBy("track_id")))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("kept") < least_charts, "few_charts")))
    place = F.row_number().over(Window.partitionBy("track_id", F.col("reason").isNull()).orderBy("density", "chart"))
    return rows.select("track_id", "chart", F.when(F.col("reason").isNull(), place).alias("place"), "reason")


def song_offset(matches: DataFrame, charts: DataFrame, least_rate: float = 0.6, least_charts: int = 3, most: float = 0.035, spread: float = 0.01) -> DataFrame:
    """``track_id, charts, mad, applied, shift``: the median of the charts' median residuals.

    ``matches(track_id, chart, residual)``, ``charts(track_id, chart, n)``.  Only charts with
    two matches or more and ``least_rate`` of their markers matched count; it applies from
    ``least_charts`` on, if it is at most ``most`` and the MAD at most ``spread``.
    """
    own = matches.groupBy("track_id", "chart").agg(F.count("*").alias("m"), F.percentile("residual", F.lit(0.5)).alias("r"))
    good = charts.join(own, ["track_id", "chart"]).where((F.col("m") >= 2) & (F.col("m") / F.col("n") >= least_rate))
    centre = good.groupBy("track_id").agg(F.percentile("r", F.lit(0.5)).alias("c"), F.count("*").alias("k"))
    mad = good.join(centre, "track_id").groupBy("track_id", "c", "k").agg(F.percentile(F.abs(F.col("r") - F.col("c")), F.lit(0.5)).alias("mad"))
    rows = charts.select("track_id").distinct().join(mad, "track_id", "left")
    enough = F.coalesce(F.col("k") >= least_charts, F.lit(False))
    applied = enough & (F.abs("c") <= most) & (F.col("mad") <= spread)
    return rows.select("track_id", F.coalesce("k", F.lit(0)).alias("charts"), F.when(enough, F.col("mad")).alias("mad"), applied.alias("applied"), F.when(applied, F.col("c")).otherwise(0.0).alias("shift"))


def alignment_verdict(charts: DataFrame, least_rate: float = 0.6, most_p95: float = 0.04, drift: float = 0.25) -> DataFrame:
    """Charts ``(n, matched, p95, last, duration)`` with ``reason``: ``match_rate``, ``residual``, ``drift`` or null."""
    low = (F.col("n") == 0) | (F.col("matched") / F.greatest("n", F.lit(1)) < least_rate)
    return charts.withColumn("reason", F.when(low, "match_rate").when(F.col("p95") > most_p95, "residual").when(F.col("last") > F.col("duration") + drift, "drift"))


def weak_labels(onsets: DataFrame, hits: DataFrame, charts: DataFrame) -> DataFrame:
    """``track_id, id, support, rate, sparse, dense`` of every onset: charts that hit it, of the sparse and the dense half.

    ``hits(track_id, id, chart)``, ``charts(track_id, chart, place)`` by density from 1; the
    middle one of an odd number is dense.
    """
    n = charts.groupBy("track_id").agg(F.count("*").alias("n"))
    told = hits.distinct().join(charts, ["track_id", "chart"]).join(n, "track_id")
    half = F.floor(F.col("n") / 2)
    sums = told.groupBy("track_id", "id").agg(F.count("*").alias("support"), F.count_if(F.col("place") <= half).alias("sparse"))
    rows = onsets.select("track_id", "id").join(sums, ["track_id", "id"], "left").join(n, "track_id", "left").fillna(0, ["support", "sparse", "n"])
    return rows.select("track_id", "id", "support", F.when(F.col("n") > 0, F.round(F.col("support") / F.col("n"), 6)).otherwise(0.0).alias("rate"), "sparse", (F.col("support") - F.col("sparse")).alias("dense"))


def capped_preference_pairs(labels: DataFrame, near: float = 4.0, least: float = 0.34, most: int = 8) -> DataFrame:
    """``track_id, better, worse, margin``: pairs within ``near``, greatest margins first, ``most`` an event.

    ``labels(track_id, id, t, rate)``; with a column ``segment`` also pairs further apart in one
    segment (null is none).  Order: margin, then closeness, then ids; a pair is taken
    while both its events have room.  One pass over the pairs of an island of events no
    further apart than ``near`` or in one segment counts what each event has.
    """
    w = Window.partitionBy("track_id").orderBy("t", "id")
    together = F.col("t") - F.lag("t").over(w) <= near
    own = labels.select("track_id", "id", "rate")
    pairs = joins.band(labels.select("track_id", "id", "t"), labels.select("track_id", "id", "t"), near).select("track_id", "id", "t", "other_id", "other_t")
    if "segment" in labels.columns:
        together = together | F.coalesce(F.col("segment") == F.lag("segment").over(w), F.lit(False))
        other = labels.select("track_id", "segment", F.col("id").alias("other_id"), F.col("t").alias("other_t"))
        pairs = pairs.unionByName(labels.join(other, ["track_id", "segment"]).select("track_id", "id", "t", "other_id", "other_t").where(F.abs(F.col("t") - F.col("other_t")) > near))
    isle = labels.select("track_id", "id", F.sum(F.when(together, 0).otherwise(1)).over(w).alias("island"))
    pairs = pairs.join(own, ["track_id", "id"]).join(own.select("track_id", F.col("id").alias("other_id"), F.col("rate").alias("other")), ["track_id", "other_id"])
    pairs = pairs.withColumn("margin", F.round(F.col("rate") - F.col("other"), 6)).where(F.col("margin") >= least).join(isle, ["track_id", "id"])
    rows = pairs.select("track_id", "island", F.col("id").cast("long").alias("a"), F.col("other_id").cast("long").alias("b"), "margin", F.abs(F.col("t") - F.col("other_t")).alias("d"))

    def step(taken: Counter, a: int, b: int, margin: float, _: float) -> list[tuple]:
        if taken[a] >= most or taken[b] >= most:
            return []
        taken[a] += 1
        taken[b] += 1
        return [(a, b, margin)]

    return fold(rows, ["track_id", "island"], [F.desc("margin"), "d", "a", "b"], "better long, worse long, margin double", Counter, step).drop("island")


def stratified_split(rows: DataFrame, key: str, strata: list[str], density: str, salt: str, frozen: DataFrame | None = None, test: float = 0.15, validation: float = 0.15) -> DataFrame:
    """``key, split`` in strata of ``strata`` and the tertile of ``density`` within them, by salted SHA-256.

    Groups under six have one tertile.  A stratum's new rows give ``test`` and
    ``validation`` of themselves, rounded, at least one (two from eight rows on) as far
    as they go; ``frozen(key, split)`` never move.  With ``test`` 0 that part is training.

    Ranks come from counts per leading hash digits, so a stratum of any size is ranked
    in cells and not in one task.
    """
    w = Window.partitionBy(*strata)
    n = F.count("*").over(w)
    cells = rows.groupBy(*strata, density).agg(F.count("*").alias("c"))
    below = cells.withColumn("below", F.sum("c").over(w.orderBy(density)) - F.col("c")).drop("c")
    ranked = rows.join(below, [*strata, density]).withColumn("r", F.col("below") + F.row_number().over(Window.partitionBy(*strata, density).orderBy(key)) - 1)
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("n"))
    tiles = ranked.join(sizes, strata).withColumn("tile", F.when(F.col("n") < 6, 0).otherwise(F.least(F.floor(F.col("r") * 3 / F.col("n")), F.lit(2)))).drop("n", "r", "below")
    open_rows = tiles if frozen is None else tiles.join(frozen.select(key), key, "left_anti")
    open_rows = open_rows.withColumn("h", F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)).withColumn("cell", F.left("h", F.lit(2)))
    by = [*strata, "tile"]
    counts = open_rows.groupBy(*by, "cell").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy(*by).orderBy("cell")) - F.col("c")).withColumn("total", F.sum("c").over(Window.partitionBy(*by))).drop("c")
    placed = open_rows.join(before, [*by, "cell"]).withColumn("p", F.col("before") + F.row_number().over(Window.partitionBy(*by, "cell").orderBy("h")) - 1)
    least = F.when(F.col("total") >= 8, 2).otherwise(1)
    part = lambda share: F.greatest(F.rint(F.col("total") * share).cast("long"), least)
    v = F.least(part(validation), F.col("total") - 1)
    t = F.least(part(test), F.greatest(F.col("total") - v, F.lit(1))) if test else F.lit(0)
    split = F.when(F.col("p") < t, "test").when(F.col("p") < t + v, "validation").otherwise("train")
    out = placed.select(key, split.alias("split"))
    return out if frozen is None else out.unionByName(rows.select(key).join(frozen.select(key, "split"), key))


def holdout_split(splits: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    """``splits`` with the holdout as the only test: what was test is train."""
    rows = splits.join(holdout.select(key, F.lit(True).alias("out")), key, "left")
    return rows.select(key, F.when(F.col("out"), "test").when(F.col("split") == "test", "train").otherwise(F.col("split")).alias("split"))


def consumed(rows: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose key no earlier test used."""
    return rows.join(used.select(key), key, "left_anti")


def license_gate(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """``source, n, reason``: of each source, ``unknown_license``, ``no_note``, ``mixed`` (several licenses) or null."""
    g = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("license").alias("k"), F.max(F.coalesce(~F.col("license").isin(allowed), F.lit(True))).alias("bad"), F.max(F.col("note").isNull() | (F.col("note") == "")).alias("bare"))
    return g.select("source", "n", F.when(F.col("bad"), "unknown_license").when(F.col("k") > 1, "mixed").when(F.col("bare"), "no_note").alias("reason"))


def manifest_split(rows: DataFrame, group: str, key: str, every: int = 5) -> DataFrame:
    """``key, place, split``: round-robin over groups by SHA-256 of the key; each ``every``-th row is test.

    Ranks in a group come from cells of hashes; the rows of earlier turns are the sum of
    all groups' sizes, each at most the turns so far, which bends only at a size: a row a
    size is looked up as of the turn.  So no task orders all rows or all turns.
    """
    turns = hash_ranked(rows.select(key, group), group, key).select(key, group, F.col("r").alias("turn"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c"))  # a row a size
    total = sizes.agg(F.sum("c")).first()[0] or 0
    up = Window.orderBy("n")
    bends = sizes.select(F.lit(0).alias("track_id"), F.col("n").cast("double").alias("t"), F.sum(F.col("n") * F.col("c")).over(up).alias("full"), F.sum("c").over(up).alias("done"))
    asked = turns.select("turn").distinct().select(F.lit(0).alias("track_id"), (F.col("turn") - 1).cast("double").alias("t"), "turn")
    found = joins.asof(asked, bends, "b", width=4096.0)
    before = found.select("turn", (F.coalesce("b.full", F.lit(0)) + (total - F.coalesce("b.done", F.lit(0))) * (F.col("turn") - 1)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("turn").orderBy(group))
    out = turns.join(before, "turn").select(key, place.alias("place"))
    return out.withColumn("split", F.when((F.col("place") - 1) % every == 0, "test").otherwise("train"))


def dataset(songs: DataFrame, events: DataFrame, pairs: DataFrame) -> DataFrame:
    """One typed table ``kind, track_id, id, other_id, value, split``: song rows, and the events and pairs of songs that have a split."""
    split = songs.select("track_id", "split")
    song = songs.select(F.lit("song").alias("kind"), "track_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("other_id"), F.lit(None).cast("double").alias("value"), "split")
    event = events.join(split, "track_id").select(F.lit("event").alias("kind"), "track_id", F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("other_id"), F.col("rate").alias("value"), "split")
    pair = pairs.join(split, "track_id").select(F.lit("pair").alias("kind"), "track_id", F.col("better").cast("long").alias("id"), F.col("worse").cast("long").alias("other_id"), F.col("margin").alias("value"), "split")
    return song.unionByName(event).unionByName(pair)


def timed_fingerprint(onsets: DataFrame, width: float = 5.0) -> DataFrame:
    """SHA-256 of the counts in cells of ``width`` and of the duration in half units, so equal counts of other lengths differ."""
    cells = onsets.groupBy("track_id", F.floor(F.col("t") / width).alias("cell")).agg(F.count("*").alias("n"), F.max("t").alias("end"))
    rows = cells.groupBy("track_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"), F.max("cell").alias("last"), F.max("end").alias("end"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return rows.select("track_id", F.sha2(F.concat(F.array_join(dense.cast("array<string>"), ","), F.lit(";"), F.floor(F.col("end") * 2).cast("string")), 256).alias("fingerprint"))


# edits -----------------------------------------------------------------------------------


def block_switches(cuts: DataFrame, blocks: DataFrame, width: float) -> DataFrame:
    """``track_id, w, visits, switches, longest`` of blocks ``(w, w0, w1)``: cuts ``(id, kind, t0, t1)`` they see, changes of kind, longest stay."""
    rows = joins.overlapping(cuts, blocks, width)
    by = Window.partitionBy("track_id", "w").orderBy("t0", "id")
    change = F.coalesce((F.col("kind") != F.lag("kind").over(by)).cast("long"), F.lit(0))
    stay = F.least("t1", "w1") - F.greatest("t0", "w0")
    return rows.withColumn("change", change).groupBy("track_id", "w").agg(F.count("*").alias("visits"), F.sum("change").alias("switches"), F.max(stay).alias("longest"))


def sync_offsets(declared: DataFrame, cues: DataFrame, changes: DataFrame, tol: float) -> DataFrame:
    """``track_id, id, binding, observed``: a declared time is ``matched``, ``shifted`` or ``missing`` by its cue, and ``seen`` if a picture change is within ``tol``.

    ``declared(track_id, id, cue, t)``, ``cues(track_id, cue, cue_t)``, ``changes(track_id, t)``.
    """
    rows = joins.nearest(declared.join(cues, ["track_id", "cue"], "left"), changes.select("track_id", "t", F.lit(1).alias("c")), "x")
    off = F.abs(F.col("t") - F.col("cue_t"))
    binding = F.when(F.col("cue_t").isNull(), "missing").when(off < 1e-9, "matched").otherwise("shifted")
    seen = F.coalesce(F.abs(F.col("t") - F.col("x.ft")) <= tol, F.lit(False))
    return rows.select("track_id", "id", binding.alias("binding"), F.when(seen, "seen").otherwise("unverified").alias("observed"))


def explain_cuts(queries: DataFrame, cuts: DataFrame, sections: DataFrame, context: int = 2) -> DataFrame:
    """``track_id, id, cut, kind, section, place, first, last``: the cut that owns a time, its cause, and the places of its neighbours.

    ``cuts(track_id, id, kind, t0, t1)`` half-open; before the first cut all is null.
    """
    w = Window.partitionBy("track_id").orderBy("t0", "id")
    placed = cuts.select("track_id", "t0", F.col("id").alias("cut"), "kind", "t1", F.row_number().over(w).alias("place"), F.count("*").over(Window.partitionBy("track_id")).alias("n"))
    rows = joins.contained(queries, placed, "c")
    rows = joins.contained(rows, sections.select("track_id", "t0", "section", "t1"), "s")
    held = lambda x: F.when(F.col("c.place").isNotNull(), x).cast("int")
    return rows.select("track_id", "id", "c.cut", "c.kind", "s.section", "c.place", held(F.greatest(F.col("c.place") - context, F.lit(1))).alias("first"), held(F.least(F.col("c.place") + context, F.col("c.n"))).alias("last"))


# rules -----------------------------------------------------------------------------------


def _told(rows: DataFrame, detail: Column, rules: dict[str, Column]) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return rows.select("track_id", F.explode(names).alias("rule"), detail.cast("string").alias("detail"))


def segment_rules(segments: DataFrame, bars: DataFrame) -> DataFrame:
    """Segments ``(n, start_bar, end_bar)`` have to tile bars 1 to ``bars``."""
    w = Window.partitionBy("track_id").orderBy("n")
    rows = segments.join(bars, "track_id").withColumn("p", F.lag("end_bar").over(w)).withColumn("more", F.lead("n").over(w))
    first = F.col("p").isNull()
    return _told(rows, F.col("n"), {"first_bar": first & (F.col("start_bar") != 1), "gap": F.col("start_bar") > F.col("p") + 1, "overlap": F.col("start_bar") <= F.col("p"), "empty": F.col("end_bar") < F.col("start_bar"), "last_bar": F.col("more").isNull() & (F.col("end_bar") != F.col("bars"))})


def boundary_rules(segments: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Boundaries ``(bar, novelty)`` and the starts of all segments but the first have to pair off."""
    starts = segments.where("n > 1").select("track_id", F.col("start_bar").alias("bar"), F.lit(True).alias("start"))
    counts = boundaries.groupBy("track_id", "bar").agg(F.count("*").alias("k"), F.max("novelty").alias("novelty"))
    rows = starts.join(counts, ["track_id", "bar"], "full")
    return _told(rows, F.col("bar"), {"no_boundary": F.col("k").isNull(), "no_segment": F.col("start").isNull(), "duplicated": F.col("k") > 1, "novelty": ~F.col("novelty").between(0, 1)})


def repetition_rules(repetitions: DataFrame, segments: DataFrame) -> DataFrame:
    """Repetitions ``(r, family, ids array)``: two known segments or more, of the family, each claimed once."""
    few = _told(repetitions, F.col("r"), {"few": F.size("ids") < 2})
    one = repetitions.select("track_id", "r", F.col("family").alias("own"), F.explode("ids").alias("n")).join(segments.select("track_id", "n", "family"), ["track_id", "n"], "left")
    one = one.withColumn("claims", F.count("*").over(Window.partitionBy("track_id", "n")))
    return few.unionByName(_told(one, F.concat_ws("/", "r", "n"), {"unknown": F.col("family").isNull(), "family": F.col("family") != F.col("own"), "claimed": F.col("claims") > 1}))


def forbidden_keys(rows: DataFrame, column: str, names: list[str], deepest: int = 64) -> DataFrame:
    """JSON texts with a key among ``names`` at any depth: ``track_id, rule, detail``, a row a key.

    Texts are parsed; each round walks one level down all objects and lists, until
    nothing nested is left (``deepest`` at most), so a key inside a string is none.  Null
    and broken texts have no keys.
    """
    tvf = rows.sparkSession.tvf
    level = rows.select("track_id", F.try_parse_json(column).alias("v")).where("v IS NOT NULL")
    found = None
    for _ in range(deepest):
        walked = level.lateralJoin(tvf.variant_explode(F.col("v").outer())).select("track_id", "key", "value").persist()
        own = walked.where(F.col("key").isin(names)).select("track_id", "key")
        found = own if found is None else found.unionByName(own)
        level = walked.where(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")).select("track_id", F.col("value").alias("v"))
        if not level.head(1):
            break
    return found.distinct().select("track_id", F.lit("forbidden").alias("rule"), F.col("key").alias("detail"))


def evidence_rules(evidence: DataFrame, onsets: DataFrame) -> DataFrame:
    """Evidence ``(id)`` has a row for every onset, none for others, none twice."""
    counts = evidence.groupBy("track_id", "id").agg(F.count("*").alias("k"))
    rows = onsets.select("track_id", "id", F.lit(True).alias("known")).join(counts, ["track_id", "id"], "full")
    return _told(rows, F.col("id"), {"missing": F.col("k").isNull(), "unknown": F.col("known").isNull(), "repeated": F.col("k") > 1})


def edit_plan_rules(boundaries: DataFrame, cues: DataFrame, tracks: DataFrame) -> DataFrame:
    """Edit plans: boundaries ``(place, t)`` rise strictly within the track, cues ``(id, t, known)`` lie in it and name known events or their own."""
    w = Window.partitionBy("track_id").orderBy("place")
    b = boundaries.join(tracks, "track_id").withColumn("p", F.coalesce(F.lag("t").over(w), F.lit(0.0)))
    c = cues.join(tracks, "track_id")
    first = _told(b, F.col("place"), {"boundary-order": ~((F.col("p") < F.col("t")) & (F.col("t") < F.col("duration")))})
    return first.unionByName(_told(c, F.col("id"), {"cue-time": ~((F.col("t") >= 0) & (F.col("t") < F.col("duration"))), "unknown-onset": ~F.col("known")}))


def product_rules(tracks: DataFrame) -> DataFrame:
    """Tracks ``(bpm, numerator, bars, beats, label)``: a meter of 1 to 12, bars that fit the beats, a label of the tempo."""
    label = F.when(F.col("bpm") < 90, "slow").when(F.col("bpm") < 140, "medium").otherwise("fast")
    return _told(tracks, F.col("bpm"), {"meter": ~F.col("numerator").between(1, 12), "bars": F.abs(F.col("bars") - F.ceil(F.col("beats") / F.greatest("numerator", F.lit(1)))) > 1, "tempo-label": F.col("label") != label})


def model_rules(nodes: DataFrame, features: list[str], most_trees: int = 72, deepest: int = 2) -> DataFrame:
    """Model nodes ``(track_id, tree, depth, feature, threshold, value)``: finite figures, known features, few shallow trees."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    own = _told(nodes, F.concat_ws("/", "tree", "depth"), {"not_finite": F.coalesce(bad("threshold"), F.lit(False)) | F.coalesce(bad("value"), F.lit(False)), "feature": F.col("feature").isNotNull() & ~F.col("feature").isin(features), "too_deep": F.col("depth") > deepest, "no_figure": F.col("threshold").isNull() & F.col("value").isNull()})
    many = nodes.groupBy("track_id").agg(F.count_distinct("tree").alias("k"))
    return own.unionByName(_told(many, F.col("k"), {"too_many": F.col("k") > most_trees}))


def coverage_rules(intervals: DataFrame, windows: DataFrame, events: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Intervals ``(id, t0, t1, trigger)`` cover each track's window without gap or overlap, each trigger is an event's time."""
    w = Window.partitionBy("track_id").orderBy("t0", "id")
    rows = intervals.join(windows, "track_id").withColumn("p", F.lag("t1").over(w)).withColumn("last", F.lead("id").over(w).isNull())
    rows = joins.nearest(rows.withColumn("t", F.col("trigger")), events.select("track_id", "t", F.lit(1).alias("e")), "x")
    start, off = F.coalesce("p", "w0"), F.abs(F.col("trigger") - F.col("x.ft"))
    return _told(rows, F.col("id"), {"gap": F.col("t0") > start + tol, "overlap": F.col("t0") < start - tol, "short": F.col("last") & (F.abs(F.col("t1") - F.col("w1")) > tol), "trigger": F.col("x").isNull() | (off > tol)})
