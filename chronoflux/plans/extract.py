"""Queries of onset extraction, its sweeps and stage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoflux.operators import forms, onsets, scores
from chronoflux.plans.catalog import _add, _r
from chronoflux.sources import tables as t


def _spectrum(s: SparkSession, d: str) -> DataFrame:
    """Event values by hour and frequency, a track per event type and tenth of the users."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("int")
    return t.read(s, d, "events").groupBy(F.concat_ws(":", "event_type", (F.col("user_id") % 10).cast("string")).alias("track_id"), F.floor(us / 3.6e9).alias("frame"), (F.floor(k / 4) * 400.0 + 40).alias("freq")).agg(F.sum("value").alias("mag"))


def _novelty(s: SparkSession, d: str, per_bin: bool = True) -> DataFrame:
    return onsets.band_novelty(_spectrum(s, d), per_bin)


def _truth(s: SparkSession, d: str) -> DataFrame:
    """Frames among the loudest tenth of a track."""
    loud = _spectrum(s, d).groupBy("track_id", "frame").agg(F.sum("mag").alias("mag"))
    edge = loud.groupBy("track_id").agg(F.percentile("mag", F.lit(0.9)).alias("edge"))
    return loud.join(edge, "track_id").where("mag >= edge").select("track_id", F.col("frame").alias("idx"), F.col("frame").cast("double").alias("t"))


_add("n2_band_novelty", lambda s, d: _r(_novelty(s, d, False).drop("loud"), "x", "low", "mid", "high"))
_add("n9_suppress_with_valley", lambda s, d: _r(onsets.suppress_with_valley(onsets.valleys(onsets.candidates(_novelty(s, d)), _novelty(s, d), 8), 0.55, 8), "x"))
_add("n12_extract_onsets_v1", lambda s, d: onsets.extract_onsets(_novelty(s, d, False), 1.0, 1))
_add("n13_extract_onsets_v2", lambda s, d: onsets.extract_onsets(_novelty(s, d), 1.0, 2))
_add("m23_sweep_valley", lambda s, d: onsets.parameter_sweep(_novelty(s, d), _truth(s, d), [0.25, 0.55, 0.85], 1.0))
_add("m23_sweep_prominence", lambda s, d: onsets.parameter_sweep(_novelty(s, d), _truth(s, d), [0.0, 0.2, 0.4], 1.0, "prominence"))
_add("m24_ablation_stages", lambda s, d: onsets.ablation_stages(_novelty(s, d, False), _novelty(s, d)))
_add("m25_stage_counts", lambda s, d: onsets.stage_count_report(onsets.ablation_stages(_novelty(s, d, False), _novelty(s, d))))


def _bar_steps(s: SparkSession, d: str) -> DataFrame:
    """Bars of four units: the greatest strength in each of 16 steps."""
    rows = t.onsets(s, d).groupBy("track_id", (F.floor(F.col("t") / 4) + 1).alias("bar"), F.floor(F.col("t") % 4 * 4).alias("step")).agg(F.max("strength").alias("x"))
    bars = rows.groupBy("track_id", "bar").agg(F.map_from_entries(F.collect_list(F.struct(F.col("step").cast("int"), "x"))).alias("m"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit(0.0)))
    return bars.select("track_id", "bar", steps.alias("v"))


def _bands(s: SparkSession, d: str) -> DataFrame:
    return _novelty(s, d).select("track_id", "frame", F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("x")) for b in ("low", "mid", "high")])))


def _bounds(s: SparkSession, d: str, kind: str) -> DataFrame:
    return t.onsets(s, d).where(F.col("kind") == kind).select("track_id", "id", F.floor("t").cast("double").alias("t")).dropDuplicates(["track_id", "t"])


_add("n15_tempo_from_novelty", lambda s, d: onsets.tempo_from_novelty(_novelty(s, d), 20.0, 0.3))
_add("n16_legacy_band_peaks", lambda s, d: onsets.legacy_band_peaks(_bands(s, d), onsets.tempo_from_novelty(_novelty(s, d), 20.0, 0.3).withColumn("origin", F.lit(0.0)), 20.0, {"low": 0.12, "mid": 0.12, "high": 0.08}))
_add("s20_bar_overview", lambda s, d: forms.bar_overview(_bar_steps(s, d)))
_add("m14_boundary_metrics", lambda s, d: scores.boundary_metrics(_bounds(s, d, "click").drop("id").withColumn("id", F.col("t")), _bounds(s, d, "view").drop("id").withColumn("id", F.col("t")), 2.0))
