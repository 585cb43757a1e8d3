"""Timeline maps, sections, keyframes, and the edits a user lays over a timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoflux.sources.store import stored

from . import joins, query


def _by(*order: str) -> object:
    return Window.partitionBy("track_id").orderBy(*order)


def timing_events(onsets: DataFrame, beats: DataFrame, first: int, last: int) -> DataFrame:
    """``track_id, n, kind, id, t``: places ``first`` to ``last`` of a track's onsets and beats by (t, kind, id)."""
    both = onsets.select("track_id", F.lit("onset").alias("kind"), "id", "t").unionByName(beats.select("track_id", F.lit("beat").alias("kind"), F.col("idx").alias("id"), "t"))
    return both.withColumn("n", F.row_number().over(_by("t", "kind", "id"))).where(F.col("n").between(first, last))


def spans_overlapping(spans: DataFrame, start: float, end: float) -> DataFrame:
    """Spans that share time with [start, end); an open span goes on for ever."""
    return spans.where((F.col("t0") < end) & (F.col("t1").isNull() | (F.col("t1") > start)))


def bar_phase_at(queries: DataFrame, beats: DataFrame) -> DataFrame:
    """Queries with ``bar`` and ``phase`` in it; past the last bar its length repeats."""
    found = joins.asof(queries, query.bar_spans(beats).withColumnRenamed("t0", "t"), "b")
    at = (F.col("t") - F.col("b.ft")) / (F.col("b.t1") - F.col("b.ft"))
    return found.withColumn("bar", F.col("b.bar") + F.floor(at)).withColumn("phase", at - F.floor(at)).drop("b")


def repeated_segments(segments: DataFrame) -> DataFrame:
    """Segments whose family comes more than once on their track."""
    n = F.count("*").over(Window.partitionBy("track_id", "family"))
    return segments.withColumn("n", n).where("n > 1").drop("n")


def time_to_step(queries: DataFrame, knots: DataFrame) -> DataFrame:
    """Queries with ``step``, linear between the knots ``(track_id, t, step)``.

    A knot not later than all before it is left out.  Past the last knot its
    interval's slope goes on; before the first, or with one knot only, step is null.
    """
    before = F.max("t").over(_by("t", "step").rowsBetween(Window.unboundedPreceding, -1))
    kept = knots.withColumn("top", before).where("top IS NULL OR t > top").drop("top")
    slope = lambda f, g: (f("step").over(_by("t")) - F.col("step")) / (g("t").over(_by("t")) - F.col("t"))
    kept = kept.withColumn("slope", F.coalesce(slope(F.lead, F.lead), slope(F.lag, F.lag)))
    found = joins.asof(queries, kept, "k", width=256.0)
    return found.withColumn("step", F.col("k.step") + (F.col("t") - F.col("k.ft")) * F.col("k.slope")).drop("k")


def to_ticks(queries: DataFrame, segments: DataFrame, tpq: int = 480, width: float = 256.0) -> DataFrame:
    """Queries with ``ticks``: the integral of tempo from the track's first segment on; null before it."""
    spans = segments.where("t1 IS NULL OR t1 > t0")
    done = F.sum((F.col("t1") - F.col("t0")) * F.col("bpm")).over(_by("t0").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("track_id", F.col("t0").alias("t"), "bpm", F.coalesce(done, F.lit(0.0)).alias("done"))
    found = joins.asof(queries, spans, "s", width=width)
    return found.withColumn("ticks", (F.col("s.done") + (F.col("t") - F.col("s.ft")) * F.col("s.bpm")) / 60 * tpq).drop("s")


def default_sections(beats: DataFrame, bars: int = 8) -> DataFrame:
    """``track_id, section, t0, t1``: chunks of ``bars`` bars; the last ends with the track."""
    chunk = F.floor((F.col("bar") - 1) / bars)
    rows = beats.groupBy("track_id", chunk.alias("section")).agg(F.min("t").alias("t0"), F.max("t").alias("end"))
    return rows.select("track_id", "section", "t0", F.coalesce(F.lead("t0").over(_by("t0")), "end").alias("t1"))


def resample(queries: DataFrame, keys: DataFrame, ease: str = "linear") -> DataFrame:
    """Queries with ``value`` of the keyframes ``(track_id, t, value)``; ends are held.

    ``ease``: linear, hold or smooth between two keys.  Null on a track without keys.
    """
    keys = keys.select("track_id", "t", "value", F.lead("t").over(_by("t", "value")).alias("t1"), F.lead("value").over(_by("t", "value")).alias("v1"))
    found = joins.asof(joins.asof(queries, keys, "a"), keys, "b", forward=True)
    u = (F.col("t") - F.col("a.ft")) / (F.col("a.t1") - F.col("a.ft"))
    u = {"linear": u, "hold": F.lit(0.0), "smooth": u * u * (3 - 2 * u)}[ease]
    inside = F.coalesce(F.col("a.value") + (F.col("a.v1") - F.col("a.value")) * u, F.col("a.value"))
    return found.withColumn("value", F.when(F.col("a").isNull(), F.col("b.value")).otherwise(inside)).drop("a", "b")


def last_new_family(segments: DataFrame) -> DataFrame:
    """``track_id, family, t0``: the family that a track shows last for the first time."""
    first = segments.groupBy("track_id", "family").agg(F.min("t0").alias("t0"))
    return first.groupBy("track_id").agg(F.max(F.struct("t0", "family")).alias("x")).select("track_id", "x.family", "x.t0")


def default_plan(segments: DataFrame) -> DataFrame:
    """``track_id, place, t``: distinct segment starts but a track's first."""
    starts = segments.select("track_id", F.col("t0").alias("t")).distinct()
    return starts.withColumn("place", F.row_number().over(_by("t")) - 1).where("place > 0")


def resolve_plan(onsets: DataFrame, edits: DataFrame) -> DataFrame:
    """Cues after ``edits`` ``(track_id, id, action, at)``: ``track_id, id, t, source_t, strength``.

    ``delete`` takes an onset out, ``move`` sets its time and keeps its source time;
    an ``add`` is a new cue of strength 1 without a source.  One edit an onset.
    """
    both = onsets.select("track_id", "id", F.col("t").alias("source_t"), "strength").join(edits, ["track_id", "id"], "full")
    kept = both.where("action IS NULL OR action = 'add' OR (action = 'move' AND source_t IS NOT NULL)")
    return kept.select("track_id", "id", F.coalesce("at", "source_t").alias("t"), "source_t", F.coalesce("strength", F.lit(1.0)).alias("strength"))


def visit_history(cuts: DataFrame) -> DataFrame:
    """Cuts ``(track_id, id, kind, t)`` with ``visit``, ``first_seen`` and ``seen_before`` of their shot.

    A cut shows until the next one on its track; ``seen_before`` is the time the
    same shot showed earlier.
    """
    shot = Window.partitionBy("track_id", "kind").orderBy("t", "id")
    earlier = shot.rowsBetween(Window.unboundedPreceding, -1)
    rows = cuts.withColumn("shows", F.coalesce(F.lead("t").over(_by("t", "id")) - F.col("t"), F.lit(0.0)))
    return rows.withColumn("visit", F.row_number().over(shot)).withColumn("first_seen", F.min("t").over(shot)).withColumn("seen_before", F.coalesce(F.sum("shows").over(earlier), F.lit(0.0)))


def subframe_visits(cuts: DataFrame, fps: float) -> DataFrame:
    """Cuts that end before a frame at ``fps`` shows them."""
    rows = cuts.withColumn("end", F.lead("t").over(_by("t", "id")))
    return rows.where(F.ceil(F.col("end") * fps) <= F.ceil(F.col("t") * fps)).drop("end")


def _intervals(beats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intervals ``track_id, t, b, next`` of a grid, and per track the ``first`` of them and the last one's number ``most``."""
    w = Window.partitionBy("track_id").orderBy("t")
    spans = stored(beats.select("track_id", "t", (F.row_number().over(w).cast("long") - 1).alias("b"), F.lead("t").over(w).alias("next")).where("next IS NOT NULL"))
    first = F.min(F.when(F.col("b") == 0, F.struct(F.col("t").alias("ft"), "b", "next"))).alias("first")
    return spans, stored(spans.groupBy("track_id").agg(first, F.max("b").alias("most")))


def _on_grid(rows: DataFrame, spans: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows(track_id, name, t, beats_on)`` with ``t`` moved by ``beats_on`` beats of the real grid, ends going on at their interval.

    A grid's file is far smaller than its rows, so a join must not send it whole to
    the driver and all tasks: all joins are merges.  Rows not moved need no grid.
    """
    rest, rows = rows.where("beats_on = 0"), rows.where("beats_on <> 0")
    near = spans.join(rows.select("track_id").distinct().hint("merge"), "track_id", "left_semi")
    found = joins.asof(rows, near, "s").join(ends.hint("merge"), "track_id", "left").withColumn("s", F.coalesce("s", "first"))
    place = F.col("s.b") + (F.col("t") - F.col("s.ft")) / (F.col("s.next") - F.col("s.ft")) + F.col("beats_on")
    found = found.withColumn("place", place).withColumn("b", F.greatest(F.lit(0), F.least(F.floor("place"), F.col("most"))))
    to = spans.select("track_id", "b", F.col("t").alias("t0"), F.col("next").alias("t1"))
    moved = found.drop("s", "first").join(to.hint("merge"), ["track_id", "b"], "left")
    return rest.unionByName(moved.withColumn("t", F.col("t0") + (F.col("place") - F.col("b")) * (F.col("t1") - F.col("t0"))).select(*rows.columns))


def resolve_anchors(anchors: DataFrame, beats: DataFrame, onsets: DataFrame, deepest: int = 64) -> DataFrame:
    """``track_id, name, t, status``: times of named anchors.

    ``anchors(track_id, name, seconds, beat, onset, moment, offset, offset_beats)``: exactly one of
    a time, a beat's index, an onset's id and another anchor's name, moved by
    ``offset_beats`` beats of the grid and then by ``offset``.  ``status`` is ok; invalid (none or
    several of the four, or an offset that is not finite, or beats without a grid of
    two); unknown (no such beat, onset or name, or one that failed); cyclic (names
    that lead back, or deeper than ``deepest``).  Names are taken level by level: each round
    joins those whose anchor the last one resolved, so rounds are as many as levels.
    """
    of = [F.col(c).isNotNull().cast("int") for c in ("seconds", "beat", "onset", "moment")]
    fine = lambda c: F.col(c).isNull() | ~(F.isnan(c) | (F.abs(c) == float("inf")))
    rows = anchors.withColumn("beats_on", F.coalesce(F.col("offset_beats").cast("double"), F.lit(0.0))).withColumn("later", F.coalesce(F.col("offset").cast("double"), F.lit(0.0)))
    rows = stored(rows.select("track_id", "name", "seconds", "beat", "onset", "moment", "beats_on", "later", (sum(of[1:], of[0]) == 1).alias("one")))
    rows = rows.withColumn("valid", F.col("one") & fine("beats_on") & fine("later") & F.coalesce(fine("seconds"), F.lit(True)))
    number = beats.select("track_id", F.col("t").alias("beat_t"), (F.row_number().over(Window.partitionBy("track_id").orderBy("t")).cast("long") - 1).alias("beat"))
    own = rows.where("valid AND moment IS NULL").join(number.hint("merge"), ["track_id", "beat"], "left").join(onsets.select("track_id", F.col("id").alias("onset"), F.col("t").alias("onset_t")).hint("merge"), ["track_id", "onset"], "left")
    spans, ends = _intervals(beats)
    own = own.select("track_id", "name", F.coalesce(F.col("seconds").cast("double"), "beat_t", "onset_t").alias("t"), "beats_on", "later")

    def moved(found: DataFrame) -> DataFrame:
        shifted = _on_grid(found.where("t IS NOT NULL").select("track_id", "name", "t", "beats_on", "later"), spans, ends)
        done = shifted.select("track_id", "name", (F.col("t") + F.col("later")).alias("t"), F.when(F.col("t").isNull(), "invalid").otherwise("ok").alias("status"))
        return done.unionByName(found.where("t IS NULL").select("track_id", "name", F.lit(None).cast("double").alias("t"), F.lit("unknown").alias("status")))

    level = moved(own).unionByName(rows.where("NOT valid").select("track_id", "name", F.lit(None).cast("double").alias("t"), F.lit("invalid").alias("status")))
    pending = rows.where("valid AND moment IS NOT NULL").select("track_id", "name", "moment", "beats_on", "later")
    nowhere = pending.join(rows.select("track_id", F.col("name").alias("moment")).hint("merge"), ["track_id", "moment"], "left_anti")
    level = stored(level.unionByName(nowhere.select("track_id", "name", F.lit(None).cast("double").alias("t"), F.lit("unknown").alias("status"))))
    pending = stored(pending)
    levels = [level]
    for _ in range(deepest):
        parents = level.select("track_id", F.col("name").alias("moment"), F.col("t"))
        level = moved(pending.join(parents.hint("merge"), ["track_id", "moment"]).select("track_id", "name", "t", "beats_on", "later"))
        level = stored(level)
        if not level.head(1):
            break
        levels.append(level)
    done = levels[0]
    for level in levels[1:]:
        done = done.unionByName(level)
    rest = rows.select("track_id", "name").join(done.select("track_id", "name").hint("merge"), ["track_id", "name"], "left_anti")
    return done.unionByName(rest.select("track_id", "name", F.lit(None).cast("double").alias("t"), F.lit("cyclic").alias("status")))
