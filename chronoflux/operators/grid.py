"""Irregular beat grids: positions before, between and after real beats, and what hangs on them.

Tables are ``track_id, idx, t, bar, beat_in_bar`` with distinct times; null times and
tracks take no part.  Where a track has no beats, or before its first, the plain grid
of ``bpm`` from ``origin`` on counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoflux.functions.columns import clip

from . import joins, query


def _along() -> object:
    return Window.partitionBy("track_id").orderBy("t")


def stepped(beats: DataFrame, bpm: float) -> DataFrame:
    """Beats with ``step``, the way to the next one; the last repeats the one before, a single one has 60 / bpm."""
    step = F.coalesce(F.lead("t").over(_along()) - F.col("t"), F.col("t") - F.lag("t").over(_along()), F.lit(60.0 / bpm))
    return beats.withColumn("step", step)


def position(queries: DataFrame, beats: DataFrame, bpm: float = 60.0, origin: float = 0.0, numerator: int = 4) -> DataFrame:
    """Queries with ``bar, beat, beat_phase`` on the real beats; past the last one its interval and count go on."""
    facts = stepped(beats, bpm).select("track_id", "t", "idx", "bar", "beat_in_bar", "step")
    ahead = F.greatest((F.col("t") - origin) * bpm / 60, F.lit(0.0))
    along = (F.col("t") - F.col("b.ft")) / F.col("b.step")
    count = F.col("b.beat_in_bar") - 1 + F.floor(along)
    plain = F.col("b").isNull()
    found = joins.asof(queries, facts, "b")
    return found.select(
        *queries.columns,
        F.when(plain, F.floor(F.floor(ahead) / numerator) + 1).otherwise(F.col("b.bar") + F.floor(count / numerator)).alias("bar"),
        F.when(plain, F.floor(ahead) % numerator + 1).otherwise(count % numerator + 1).alias("beat"),
        F.when(plain, ahead - F.floor(ahead)).otherwise(along - F.floor(along)).alias("beat_phase"),
    )


def bar_phase(placed: DataFrame, beats: DataFrame, bpm: float = 60.0, origin: float = 0.0) -> DataFrame:
    """``placed`` (with ``bar``) with ``bar_phase``: where in its bar, 0 to 1.

    Bars past the last span have its length; before the first span, and in a bar
    without an end, the phase is 0; on a track without bars the plain grid counts.
    """
    spans = query.bar_spans(beats).select("track_id", "bar", "t0", "t1")
    last = spans.groupBy("track_id").agg(F.max(F.struct("bar", "t0", "t1")).alias("last"))
    rows = placed.join(spans, ["track_id", "bar"], "left").join(last, "track_id", "left")
    length = F.greatest(F.col("last.t1") - F.col("last.t0"), F.lit(1e-6))
    beyond = (F.col("t") - (F.col("last.t1") + (F.col("bar") - F.col("last.bar") - 1) * length)) / length
    plain = (F.col("t") - origin) * bpm / 240
    phase = (
        F.when(F.col("last").isNull(), plain - F.floor(plain))
        .when(F.col("t1") > F.col("t0"), clip((F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))))
        .when((F.col("bar") > F.col("last.bar")) & F.col("last.t1").isNotNull(), clip(beyond))
        .otherwise(0.0)
    )
    return rows.select(*placed.columns, phase.alias("bar_phase"))


def quantize(onsets: DataFrame, beats: DataFrame, subdivision: int = 16, bpm: float = 60.0, origin: float = 0.0) -> DataFrame:
    """Nearest grid step in four cases: ``quantized_time, offset_ms, bar, beat, step_in_bar, pre_grid``.

    Without beats: the plain grid from ``origin``.  Before the first beat: its
    interval goes back, bar, beat and step are 0.  Between two beats: the nearest of
    the parts of their interval, the first of two as near.  From the last beat on: its
    interval goes on.  Steps of a bar count from 1.
    """
    parts = subdivision // 4
    facts = stepped(beats, bpm).withColumn("more", F.lead("t").over(_along()).isNotNull()).withColumn("next", F.struct(F.lead("bar").over(_along()).alias("bar"), F.lead("beat_in_bar").over(_along()).alias("beat")))
    first = facts.groupBy("track_id").agg(F.min(F.struct("t", "step")).alias("first"))
    found = joins.asof(onsets.select("track_id", "id", "t"), facts.select("track_id", "t", "bar", "beat_in_bar", "step", "more", "next"), "b").join(first, "track_id", "left")
    t, half = F.col("t"), F.lit(0.5)
    plain_step = F.rint((t - origin) / (60.0 / bpm / parts))
    back = F.rint((F.col("first.t") - t) / (F.col("first.step") / parts))
    along = (t - F.col("b.ft")) / F.col("b.step") * parts
    part = F.when(F.col("b.more"), F.ceil(along - half)).otherwise(F.rint(along)).cast("long")  # halves: the earlier part between beats, the even one after
    case = F.when(F.col("first").isNull(), 0).when(F.col("b").isNull(), 1).otherwise(2)
    rows = found.withColumn("case", case).withColumn("part", part).withColumn("plain", plain_step.cast("long"))
    count = F.col("b.beat_in_bar") - 1 + F.floor(F.col("part") / parts)
    to_next = F.col("b.more") & (F.col("part") == parts)
    quantized = F.when(F.col("case") == 0, F.col("plain") * (60.0 / bpm / parts) + origin).when(F.col("case") == 1, F.col("first.t") - back * F.col("first.step") / parts).otherwise(F.col("b.ft") + F.col("part") * F.col("b.step") / parts)
    in_grid = (F.col("case") == 0) & (F.col("plain") >= 0)
    pick = lambda plain, real: F.when(in_grid, plain).when(F.col("case") == 2, real).otherwise(F.lit(0)).cast("long")
    bar = pick(F.floor(F.col("plain") / subdivision) + 1, F.when(to_next, F.col("b.next.bar")).otherwise(F.col("b.bar") + F.floor(count / 4)))
    beat = pick(F.floor(F.col("plain") % subdivision / parts) + 1, F.when(to_next, F.col("b.next.beat")).otherwise(count % 4 + 1))
    step = pick(F.col("plain") % subdivision + 1, F.when(to_next, (F.col("b.next.beat") - 1) * parts + 1).otherwise(count % 4 * parts + F.col("part") % parts + 1))
    rows = rows.select("track_id", "id", "t", quantized.alias("quantized_time"), bar.alias("bar"), beat.alias("beat"), step.alias("step_in_bar"), (bar == 0).alias("pre_grid"))
    return rows.withColumn("offset_ms", (F.col("t") - F.col("quantized_time")) * 1000)


def bar_windows(requests: DataFrame, beats: DataFrame) -> DataFrame:
    """``requests(track_id, id, first, last)`` as ``[t0, t1)`` of whole bars, or an ``error``.

    ``bad_range``: first above last or below 1; ``no_bars``: an unknown track;
    ``out_of_range``: a bar that the track does not have.  The last bar ends with the
    track's last beat.
    """
    spans = query.bar_spans(beats)
    ends = beats.groupBy("track_id").agg(F.max("t").alias("end"), F.max("bar").alias("bars"))
    a = spans.select("track_id", F.col("bar").alias("first"), F.col("t0").alias("a"))
    b = spans.select("track_id", F.col("bar").alias("last"), F.col("t1").alias("b"))
    rows = requests.join(ends, "track_id", "left").join(a, ["track_id", "first"], "left").join(b, ["track_id", "last"], "left")
    error = F.when((F.col("first") > F.col("last")) | (F.col("first") < 1), "bad_range").when(F.col("bars").isNull(), "no_bars").when((F.col("last") > F.col("bars")) | F.col("a").isNull(), "out_of_range")
    t1 = F.when(F.col("last") == F.col("bars"), F.col("end")).otherwise(F.col("b"))
    return rows.select("track_id", "id", F.when(error.isNull(), F.col("a")).alias("t0"), F.when(error.isNull(), t1).alias("t1"), error.alias("error"))


def boundary_impulse(queries: DataFrame, boundaries: DataFrame, decay: float = 2.0, max_age: float = 4.0) -> DataFrame:
    """exp(-age * decay) since the last boundary, 0 from ``max_age`` on and before the first."""
    found = joins.asof(queries, boundaries.select("track_id", "t"), "b")
    age = F.col("t") - F.col("b.ft")
    return found.select(*queries.columns, F.coalesce(F.when(age < max_age, F.exp(-age * decay)), F.lit(0.0)).alias("impulse"))


def energy(queries: DataFrame, frames: DataFrame, scale: float = 1.0) -> DataFrame:
    """``x`` / scale, interpolated between frames, within 0 and 1; 0 on a track without frames."""
    found = query.energy_at(queries, frames).withColumn("x", clip(F.col("x") / scale))
    none = queries.join(frames.select("track_id").distinct(), "track_id", "left_anti").withColumn("x", F.lit(0.0))
    return found.unionByName(none)


def state(queries: DataFrame, beats: DataFrame, onsets: DataFrame, sections: DataFrame, bpm: float = 60.0, accent: float = 0.6, decay: float = 16.0, max_age: float = 0.24) -> DataFrame:
    """All that holds at a time: position, bar phase, the last onset's impulse and accent, the section.

    Times that are not finite or negative count as 0, positive infinity as the
    track's last beat.  Each join keeps the partitioning by track and cell.
    """
    ends = beats.groupBy("track_id").agg(F.max("t").alias("end"))
    t = F.col("t")
    clean = F.when(t == float("inf"), F.coalesce("end", F.lit(0.0))).when(F.isnan(t) | t.isNull() | (t < 0), 0.0).otherwise(t)
    rows = queries.join(ends, "track_id", "left").withColumn("t", clean).select(*queries.columns)
    rows = bar_phase(position(rows, beats, bpm), beats, bpm)
    rows = joins.asof(rows, onsets.select("track_id", "t", "id", "strength"), "o")
    age = F.col("t") - F.col("o.ft")
    rows = rows.withColumn("impulse", F.coalesce(F.when(age < max_age, F.col("o.strength") * F.exp(-age * decay)), F.lit(0.0)))
    rows = rows.withColumn("accent", (F.col("impulse") > 0) & (F.col("o.strength") >= accent)).drop("o")
    return joins.contained(rows, sections.select("track_id", "t0", "section", "t1"), "s").withColumn("section", F.col("s.section")).drop("s")


def note_events(onsets: DataFrame, bpm: float = 60.0, tpq: int = 480, length: int = 30) -> DataFrame:
    """``track_id, place, tick, kind, id, velocity``: on and off rows by tick, off before on at one tick."""
    tick = F.rint(F.col("t") * bpm / 60 * tpq).cast("long")
    on = F.struct(tick.alias("tick"), F.lit(1).alias("o"), F.lit("on").alias("kind"), query.velocity(F.col("strength")).alias("velocity"))
    off = F.struct((tick + length).alias("tick"), F.lit(0).alias("o"), F.lit("off").alias("kind"), F.lit(0).alias("velocity"))
    rows = onsets.select("track_id", "id", F.inline(F.array(on, off)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("track_id").orderBy("tick", "o", "id"))).drop("o")


def anchor_spans(anchors: DataFrame, bpm: Column, origin: Column, numerator: int = 4) -> DataFrame:
    """Anchors ``(kind, a, b)`` in bars or seconds as ``[t0, t1)``: bar n starts at origin + (n - 1) bars; bars include the last."""
    length = F.lit(60.0 * numerator) / bpm
    bar = F.col("kind") == "bar"
    return anchors.withColumn("t0", F.when(bar, origin + (F.col("a") - 1) * length).otherwise(F.col("a"))).withColumn("t1", F.when(bar, origin + F.col("b") * length).otherwise(F.col("b")))


def default_sections(tracks: DataFrame, segments: DataFrame, beats: DataFrame, bars: int = 8, seconds: float = 30.0) -> DataFrame:
    """``track_id, section, t0, t1, origin``: a track's segments, else chunks of ``bars`` bars, else of ``seconds``; the last ends with the track."""
    by_segment = segments.select("track_id", F.col("t0").alias("t"), F.lit("segments").alias("origin"))
    chunk = beats.groupBy("track_id", F.floor((F.col("bar") - 1) / bars).alias("c")).agg(F.min("t").alias("t")).select("track_id", "t", F.lit("bars").alias("origin")).join(segments.select("track_id").distinct(), "track_id", "left_anti")
    bare = tracks.join(segments.select("track_id").distinct(), "track_id", "left_anti").join(beats.select("track_id").distinct(), "track_id", "left_anti")
    by_time = bare.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("duration") / seconds) - 1, F.lit(0)))).alias("c")).select("track_id", (F.col("c") * seconds).alias("t"), F.lit("time").alias("origin"))
    rows = by_segment.unionByName(chunk).unionByName(by_time).join(tracks.select("track_id", "duration"), "track_id")
    number = F.row_number().over(_along())
    return rows.select("track_id", number.alias("section"), F.col("t").alias("t0"), F.coalesce(F.lead("t").over(_along()), "duration").alias("t1"), "origin")


def number_beats(beats: DataFrame, numerator: int = 4) -> DataFrame:
    """``track_id, t, bar, beat_in_bar`` by order of time."""
    i = F.row_number().over(_along()) - 1
    return beats.select("track_id", "t", i.alias("i")).select("track_id", "t", (F.floor(F.col("i") / numerator) + 1).alias("bar"), (F.col("i") % numerator + 1).alias("beat_in_bar"))


def markers_to_grid(markers: DataFrame, numerator: int = 4) -> DataFrame:
    """``markers(track_id, t, beat)`` with ``bar`` (ones so far; 0 before the first) and ``gap``: neither the next beat nor a one."""
    before = F.lag("beat").over(_along())
    bar = F.sum((F.col("beat") == 1).cast("long")).over(_along().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    gap = before.isNotNull() & (F.col("beat") != before % numerator + 1) & (F.col("beat") != 1)
    return markers.select("track_id", "t", "beat", bar.alias("bar"), gap.alias("gap"))


def grid_summary(marked: DataFrame, bpm: float, subdivision: int = 16) -> DataFrame:
    """``track_id, origin, bars, step, gaps`` of ``markers_to_grid``: first one (else first beat), bars of 4 beats at ``bpm`` to the last beat."""
    rows = marked.groupBy("track_id").agg(F.coalesce(F.min(F.when(F.col("beat") == 1, F.col("t"))), F.min("t")).alias("origin"), F.max("t").alias("end"), F.count_if("gap").alias("gaps"))
    bars = F.greatest(F.ceil(F.greatest(F.col("end") - F.col("origin"), F.lit(0.0)) / (240.0 / bpm)), F.lit(1))
    return rows.select("track_id", "origin", bars.alias("bars"), F.lit(60.0 / bpm / (subdivision / 4)).alias("step"), "gaps")


def estimate_bpm(beats: DataFrame) -> DataFrame:
    """``track_id, bpm, confidence, variable``: median interval without outliers; 120 and 0 below two beats.

    Outliers are further from the median than max(3 MAD, .03); the rest's population
    deviation sets ``variable`` (above .015) and confidence (within .2 and .99).
    """
    gaps = beats.withColumn("gap", F.col("t") - F.lag("t").over(_along()))
    med = gaps.groupBy("track_id").agg(F.percentile("gap", F.lit(0.5)).alias("m"))
    away = gaps.join(med, "track_id").withColumn("d", F.abs(F.col("gap") - F.col("m")))
    mad = away.groupBy("track_id").agg(F.percentile("d", F.lit(0.5)).alias("mad"))
    near = away.join(mad, "track_id").where(F.col("d") <= F.greatest(F.col("mad") * 3, F.lit(0.03)))
    got = near.groupBy("track_id", "m").agg(F.percentile("gap", F.lit(0.5)).alias("g"), F.stddev_pop("gap").alias("s"))
    rows = beats.select("track_id").distinct().join(got, "track_id", "left")
    ok = F.coalesce(F.col("m") > 0, F.lit(False))
    return rows.select("track_id", F.when(ok, 60 / F.col("g")).otherwise(120.0).alias("bpm"), F.when(ok, clip(1 - F.col("s") / F.col("m"), 0.2, 0.99)).otherwise(0.0).alias("confidence"), (ok & (F.col("s") > 0.015)).alias("variable"))


def timeline_sections(beats: DataFrame, bars: int) -> DataFrame:
    """``track_id, section, t0, t1``: chunks of ``bars`` bars, numbered from 0; the last ends with the last beat."""
    rows = beats.groupBy("track_id", F.floor((F.col("bar") - 1) / bars).alias("section")).agg(F.min("t").alias("t0"), F.max("t").alias("end"))
    return rows.select("track_id", "section", "t0", F.coalesce(F.lead("t0").over(Window.partitionBy("track_id").orderBy("t0")), "end").alias("t1"))
