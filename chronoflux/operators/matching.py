"""One-to-one matches, spacing rules and tempo over a whole track."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import joins
from .folds import fold


def _islands(rows: DataFrame, gap: float, *order: str) -> DataFrame:
    """``island``: rows of one track chained by gaps of at most ``gap``."""
    w = Window.partitionBy("track_id").orderBy("t", *order)
    return rows.withColumn("new", F.when(F.col("t") - F.lag("t").over(w) <= gap, 0).otherwise(1)).withColumn("island", F.sum("new").over(w)).drop("new")


def match(reference: DataFrame, estimate: DataFrame, tol: float, by: str = "distance") -> DataFrame:
    """``track_id, id, other_id, distance``: pairs within ``tol``, every row in one at most.

    ``by`` distance: the closest pair of all goes first, then earlier ones;
    later / earlier: each reference in order of time takes the nearest that is
    left, and of two as near the later / earlier.  All three are one pass over sorted
    candidates that takes a pair if both are free; it runs inside an island of rows no
    further apart than ``tol``, keeps the ids taken, and is linear in the candidates.
    """
    rows = reference.select("track_id", "id", "t", F.lit(0).alias("side")).unionByName(estimate.select("track_id", "id", "t", F.lit(1).alias("side")))
    island = _islands(rows, tol, "side", "id").where("side = 0").select("track_id", "id", "island")
    pairs = joins.band(reference, estimate, tol).withColumn("d", F.abs(F.col("t") - F.col("other_t")))
    order = {"distance": ["d", "t", "id", "other_t", "other_id"], "earlier": ["t", "id", "d", "other_t", "other_id"], "later": ["t", "id", "d", "late", "other_id"]}[by]
    rows = pairs.withColumn("late", -F.col("other_t")).join(island, ["track_id", "id"]).select("track_id", "island", "id", "other_id", "d", "t", "other_t", "late")
    kinds = dict(rows.dtypes)

    def step(taken: tuple[set, set], id_: object, other: object, d: float, *_: object) -> list[tuple]:
        if id_ in taken[0] or other in taken[1]:
            return []
        taken[0].add(id_)
        taken[1].add(other)
        return [(id_, other, d)]

    found = fold(rows, ["track_id", "island"], order, f"id {kinds['id']}, other_id {kinds['other_id']}, distance double", lambda: (set(), set()), step)
    return found.drop("island")


def suppress_close(peaks: DataFrame, apart: float) -> DataFrame:
    """``track_id, t, x`` of peaks kept: the highest first, unless within ``apart`` of one kept; ties: the later."""
    def step(kept: list[float], t: float, x: float) -> list[tuple]:
        at = bisect_left(kept, t)
        if any(abs(k - t) <= apart for k in kept[max(0, at - 1) : at + 1]):
            return []
        kept.insert(at, t)
        return [(t, x)]

    rows = _islands(peaks, apart, "x").select("track_id", "island", "t", "x")
    return fold(rows, ["track_id", "island"], [F.desc("x"), F.desc("t")], "t double, x double", list, step).drop("island")


def collapse_simultaneous(markers: DataFrame, tol: float) -> DataFrame:
    """``track_id, t``: markers later by more than ``tol`` than the last one kept."""
    def step(last: list, t: float) -> list[tuple]:
        if last[0] is not None and t - last[0] <= tol:
            return []
        last[0] = t
        return [(t,)]

    rows = _islands(markers.select("track_id", "t"), tol).select("track_id", "island", "t")
    return fold(rows, ["track_id", "island"], ["t"], "t double", lambda: [None], step).drop("island")


def global_bpm(onsets: DataFrame) -> DataFrame:
    """``track_id, bpm, n``: 60 n / the sum of the n intervals within a factor 1.5 of the median one."""
    w = Window.partitionBy("track_id").orderBy("t", "id")
    gaps = onsets.select("track_id", (F.col("t") - F.lag("t").over(w)).alias("gap")).where("gap > 0")
    med = gaps.groupBy("track_id").agg(F.percentile("gap", F.lit(0.5)).alias("m"))
    kept = gaps.join(med, "track_id").where(F.abs(F.log2(F.col("gap") / F.col("m"))) <= F.log2(F.lit(1.5)))
    return kept.groupBy("track_id").agg((60 * F.count("*") / F.sum("gap")).alias("bpm"), F.count("*").alias("n"))


def grid_summary(beats: DataFrame) -> DataFrame:
    """``track_id, origin, bars, n``: first downbeat, bars and beats from it on."""
    origin = F.min(F.when(F.col("beat_in_bar") == 1, F.col("t"))).over(Window.partitionBy("track_id"))
    rows = beats.withColumn("origin", origin).where(F.col("t") >= F.col("origin"))
    return rows.groupBy("track_id", "origin").agg(F.count_distinct("bar").alias("bars"), F.count("*").alias("n"))


def false_in_silence(selected: DataFrame, truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """``track_id, n``: estimates on the selected tracks that have no truth at all."""
    silent = selected.select("track_id").distinct().join(truth, "track_id", "left_anti")
    counts = estimate.groupBy("track_id").agg(F.count("*").alias("n"))
    return silent.join(counts, "track_id", "left").select("track_id", F.coalesce("n", F.lit(0)).alias("n"))


def exclusion_report(rows: DataFrame, reason: str, source: str) -> DataFrame:
    """Counts by reason and source, by reason, and of all: null stands for every value."""
    return rows.rollup(reason, source).agg(F.count("*").alias("n"))
