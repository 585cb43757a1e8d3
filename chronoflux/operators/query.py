"""Point-in-time and window queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoflux.functions.columns import clip, smoothstep

from . import joins


def events_between(onsets: DataFrame, start: float, end: float) -> DataFrame:
    """Events in (start, end]."""
    return onsets.where((F.col("t") > start) & (F.col("t") <= end))


def bar_spans(beats: DataFrame) -> DataFrame:
    """``track_id, bar, t0, t1``: bars from downbeat to downbeat; the last repeats the length before."""
    w = Window.partitionBy("track_id").orderBy("t0")
    down = beats.where("beat_in_bar = 1").select("track_id", "bar", F.col("t").alias("t0"))
    return down.withColumn("t1", F.coalesce(F.lead("t0").over(w), F.col("t0") * 2 - F.lag("t0").over(w)))


def bar_window(beats: DataFrame, first: int, last: int) -> DataFrame:
    """``track_id, t0, t1`` of bars ``first`` to ``last``, both included."""
    return bar_spans(beats).where(F.col("bar").between(first, last)).groupBy("track_id").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))


def position_at(queries: DataFrame, beats: DataFrame, numerator: int = 4) -> DataFrame:
    """Queries with ``bar, beat_in_bar, phase``; past the last beat the last interval goes on."""
    w = Window.partitionBy("track_id").orderBy("t")
    step = F.coalesce(F.lead("t").over(w) - F.col("t"), F.col("t") - F.lag("t").over(w))
    facts = beats.withColumn("step", step).select("track_id", "t", "idx", "step")
    found = joins.asof(queries, facts, "b")
    past = F.floor((F.col("t") - F.col("b.ft")) / F.col("b.step"))
    idx = F.col("b.idx") + past
    phase = (F.col("t") - F.col("b.ft")) / F.col("b.step") - past
    return found.select(*queries.columns, (F.floor(idx / numerator) + 1).alias("bar"), (idx % numerator + 1).alias("beat_in_bar"), phase.alias("phase"))


def energy_at(queries: DataFrame, frames: DataFrame) -> DataFrame:
    """Queries (t in frames) with ``x`` interpolated linearly, clamped at both ends."""
    ends = frames.groupBy("track_id").agg(F.max("frame").alias("last"))
    at = queries.join(ends, "track_id").withColumn("pos", F.least(F.greatest("t", F.lit(0.0)), F.col("last").cast("double"))).withColumn("frame", F.floor("pos"))
    right = frames.select("track_id", (F.col("frame") - 1).alias("frame"), F.col("x").alias("x1"))
    both = at.join(frames.withColumnRenamed("x", "x0"), ["track_id", "frame"]).join(right, ["track_id", "frame"], "left")
    f = F.col("pos") - F.col("frame")
    return both.select(*queries.columns, (F.col("x0") + (F.coalesce("x1", "x0") - F.col("x0")) * f).alias("x"))


def previous_onset(queries: DataFrame, onsets: DataFrame) -> DataFrame:
    found = joins.asof(queries, onsets.select("track_id", "t", "id", "strength"), "o")
    return found.select(*queries.columns, F.col("o.id").alias("onset_id"), (F.col("t") - F.col("o.ft")).alias("age"), F.col("o.strength").alias("strength"))


def nearest_onset(queries: DataFrame, onsets: DataFrame) -> DataFrame:
    found = joins.nearest(queries, onsets.select("track_id", "t", "id"), "o")
    return found.select(*queries.columns, F.col("o.id").alias("onset_id"), F.abs(F.col("t") - F.col("o.ft")).alias("distance"))


def onset_impulse(queries: DataFrame, onsets: DataFrame, decay: float = 16.0, max_age: float = 0.24) -> DataFrame:
    """``impulse`` = strength * exp(-age * decay), 0 from ``max_age`` on."""
    live = F.col("age") < max_age
    return previous_onset(queries, onsets).select(*queries.columns, F.coalesce(F.when(live, F.col("strength") * F.exp(-F.col("age") * decay)), F.lit(0.0)).alias("impulse"))


def structure_at(queries: DataFrame, segments: DataFrame, width: float = 8.0) -> DataFrame:
    """Queries with ``segment_id, family, phase, to_boundary, lead``."""
    found = joins.contained(queries, segments.select("track_id", "t0", "id", "family", "t1"), "s", width)
    left = F.col("s.t1") - F.col("t")
    return found.select(*queries.columns, F.col("s.id").alias("segment_id"), F.col("s.family").alias("family"), ((F.col("t") - F.col("s.ft")) / (F.col("s.t1") - F.col("s.ft"))).alias("phase"), left.alias("to_boundary"), smoothstep((4 - left) / 4).alias("lead"))


def next_event(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """First fact strictly after each query."""
    found = joins.asof(queries, facts.select("track_id", "t", "id"), "n", forward=True, strict=True)
    return found.select(*queries.columns, F.col("n.id").alias("next_id"), (F.col("n.ft") - F.col("t")).alias("wait"))


def quantize(onsets: DataFrame, beats: DataFrame, subdivision: int = 4, numerator: int = 4) -> DataFrame:
    """Nearest grid step: ``quantized_time, offset_ms, bar, beat, step_in_bar``.

    Steps cut the interval between two beats; past the last beat its interval goes
    on.  Half a step goes to the even side, as the reference rounds.
    """
    w = Window.partitionBy("track_id").orderBy("t")
    step = F.coalesce(F.lead("t").over(w) - F.col("t"), F.col("t") - F.lag("t").over(w))
    found = joins.asof(onsets.select("track_id", "id", "t"), beats.withColumn("step", step).select("track_id", "t", "idx", "step"), "b")
    steps = F.col("b.idx") * subdivision + F.rint((F.col("t") - F.col("b.ft")) / F.col("b.step") * subdivision).cast("long")
    rows = found.withColumn("steps", steps).withColumn("quantized_time", F.col("b.ft") + (F.col("steps") - F.col("b.idx") * subdivision) * F.col("b.step") / subdivision)
    bar = numerator * subdivision
    return rows.select("track_id", "id", "t", "quantized_time", F.round((F.col("t") - F.col("quantized_time")) * 1000, 3).alias("offset_ms"), (F.floor(F.col("steps") / bar) + 1).alias("bar"), (F.floor(F.col("steps") / subdivision) % numerator + 1).alias("beat"), (F.col("steps") % bar).alias("step_in_bar"))


def grid_affinity(onsets: DataFrame, beats: DataFrame) -> DataFrame:
    """Which of the two grids, 4 or 8 steps a beat, is nearer to each onset."""
    a = quantize(onsets, beats, 4).select("track_id", "id", F.abs("offset_ms").alias("a"))
    b = quantize(onsets, beats, 8).select("track_id", "id", F.abs("offset_ms").alias("b"))
    return a.join(b, ["track_id", "id"]).select("track_id", "id", F.when(F.col("a") <= F.col("b"), "1/16").otherwise("1/32").alias("grid"))


def strongest(onsets: DataFrame, start: float, end: float, band: str) -> DataFrame:
    w = Window.partitionBy("track_id").orderBy(F.desc(band), "t", "id")
    return events_between(onsets, start, end).withColumn("rank", F.row_number().over(w)).where("rank = 1").select("track_id", "id", "t", F.col(band).alias("value"))


def dominant_band(low: Column, mid: Column, high: Column) -> Column:
    best = F.greatest(low, mid, high)
    return F.when(low == best, "low").when(mid == best, "mid").otherwise("high")


def velocity(strength: Column) -> Column:
    return clip(F.rint(strength * 126) + 1, 1.0, 127.0).cast("int")
