"""Bars as vectors, their similarity near each other, and where a track changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import joins, query


def bar_vectors(onsets: DataFrame, beats: DataFrame, steps: int = 4) -> DataFrame:
    """``track_id, bar, step, x``: greatest strength in each step of a bar, each bar of length one.

    Long form; steps without an onset have no row.  Onsets past the last bar and
    bars without strength are left out.
    """
    found = joins.contained(onsets.select("track_id", "t", "strength"), query.bar_spans(beats), "b").where("b IS NOT NULL")
    step = F.floor((F.col("t") - F.col("b.ft")) / (F.col("b.t1") - F.col("b.ft")) * steps)
    rows = found.groupBy("track_id", F.col("b.bar").alias("bar"), step.alias("step")).agg(F.max("strength").alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("track_id", "bar")))
    return rows.withColumn("n", length).where("n > 1e-9").select("track_id", "bar", "step", (F.col("x") / F.col("n")).alias("x"))


def bar_density(onsets: DataFrame, beats: DataFrame) -> DataFrame:
    """``track_id, bar, n``: onsets in every bar, none as 0."""
    spans = query.bar_spans(beats)
    found = joins.contained(onsets.select("track_id", "t"), spans, "b").where("b IS NOT NULL")
    counts = found.groupBy("track_id", F.col("b.bar").alias("bar")).agg(F.count("*").alias("n"))
    return spans.select("track_id", "bar").join(counts, ["track_id", "bar"], "left").select("track_id", "bar", F.coalesce("n", F.lit(0)).alias("n"))


def fold_bars(vectors: DataFrame) -> DataFrame:
    """Bars averaged two by two; a step that one of them lacks counts as 0 there, and an odd last bar stays."""
    last = F.max("bar").over(Window.partitionBy("track_id"))
    rows = vectors.withColumn("pair", F.floor((F.col("bar") - 1) / 2) + 1).withColumn("size", F.when((F.col("bar") == last) & (last % 2 == 1), 1).otherwise(2))
    return rows.groupBy("track_id", F.col("pair").alias("bar"), "step").agg((F.sum("x") / F.first("size")).alias("x"))


def similar_bars(vectors: DataFrame, reach: int) -> DataFrame:
    """``track_id, a, b, cosine`` of bars at most ``reach`` apart that share a step, a < b.

    Each bar meets its ``reach`` followers by equal keys, so the work grows with the
    bars and not with their square.
    """
    left = vectors.select("track_id", F.col("bar").alias("a"), F.explode(F.sequence(F.col("bar") + 1, F.col("bar") + reach)).alias("b"), "step", F.col("x").alias("y"))
    both = left.join(vectors.withColumnRenamed("bar", "b"), ["track_id", "b", "step"])
    return both.groupBy("track_id", "a", "b").agg(F.least(F.lit(1.0), F.sum(F.col("x") * F.col("y"))).alias("cosine"))


def novelty(vectors: DataFrame, beats: DataFrame, half: int = 4) -> DataFrame:
    """``track_id, cut, novelty`` for each cut with ``half`` bars on both sides; ``cut`` bars lie before it.

    Mean similarity within the bars before and within those after (a bar is like
    itself by 1), less that across.  A pair adds to or takes from each cut it is near.
    """
    n = beats.groupBy("track_id").agg(F.max("bar").alias("n"))
    pairs = similar_bars(vectors, 2 * half - 1).join(n, "track_id")
    first, last = F.greatest(F.lit(half), F.col("b") - half), F.least(F.col("n") - half, F.col("a") - 1 + half)
    near = pairs.where(first <= last).select("track_id", "a", "b", "cosine", F.explode(F.sequence(first, last)).alias("cut"))
    across = (F.col("a") <= F.col("cut")) & (F.col("b") > F.col("cut"))
    sums = near.groupBy("track_id", "cut").agg(F.sum(F.when(across, -F.col("cosine")).otherwise(F.col("cosine"))).alias("s"))
    cuts = n.where(F.col("n") >= 2 * half).select("track_id", F.explode(F.sequence(F.lit(half).cast("long"), F.col("n") - half)).alias("cut"))
    return cuts.join(sums, ["track_id", "cut"], "left").select("track_id", "cut", ((half + F.coalesce("s", F.lit(0.0))) / (half * half)).alias("novelty"))


def minmax(rows: DataFrame, column: str) -> DataFrame:
    """``column`` from 0 to 1 on each track; 0 where it does not vary."""
    w = Window.partitionBy("track_id")
    low, high = F.min(column).over(w), F.max(column).over(w)
    return rows.withColumn(column, F.when(high - low > 1e-9, (F.col(column) - low) / (high - low)).otherwise(0.0))


def track_summary(segments: DataFrame) -> DataFrame:
    """``track_id, n, families, form``: the families in the order in which they first come."""
    rows = segments.groupBy("track_id", "family").agg(F.count("*").alias("n"), F.min("t0").alias("t0"))
    form = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t0", "family"))), lambda x: x["family"]), "")
    return rows.groupBy("track_id").agg(F.sum("n").alias("n"), F.count("*").alias("families"), form.alias("form"))
