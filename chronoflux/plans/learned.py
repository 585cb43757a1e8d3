"""Queries of rankers that are fitted, and of charts aligned to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoflux.operators import alignment, boosting, corpora, evidence, joins, scores
from chronoflux.plans.catalog import _add, _kind, _r
from chronoflux.sources import tables as t

FEATURES = ["low", "mid", "high", "before", "after", "isolated"]
#: Kinds of events from what is wanted least to most.
RANKS = ("error", "view", "click", "signup", "purchase")


def _events(s: SparkSession, d: str) -> DataFrame:
    rows = t.onsets(s, d)
    return rows.join(evidence.gaps(rows), ["track_id", "id"]).select("track_id", "id", "strength", *FEATURES)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Events of a track at most .5 apart, the wanted kind first."""
    rank = F.array_position(F.array(*[F.lit(k) for k in RANKS]), F.col("kind"))
    rows = t.onsets(s, d).select("track_id", "id", "t", rank.alias("rank"))
    near = joins.band(rows.select("track_id", "id", "t"), rows.select("track_id", "id", "t"), 0.5).select("track_id", F.col("id").alias("better"), F.col("other_id").alias("worse"))
    own = lambda k, r: rows.select("track_id", F.col("id").alias(k), F.col("rank").alias(r))
    return near.join(own("better", "a"), ["track_id", "better"]).join(own("worse", "b"), ["track_id", "worse"]).where("a > b").select("track_id", "better", "worse")


def _sources(s: SparkSession, d: str) -> DataFrame:
    """The region of each track's customer."""
    nations = t.read(s, d, "nation").join(t.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.read(s, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("track_id"), F.col("r_name").alias("source"))


def _model(s: SparkSession, d: str) -> dict:
    return boosting.fit_pairwise_trees(_events(s, d), _pairs(s, d), FEATURES, "strength", trees=6, depth=2, rate=0.3)


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(boosting.nodes(_model(s, d)), "tree int, node int, feature string, threshold double, value double")


def _penalties(s: SparkSession, d: str) -> DataFrame:
    held = _sources(s, d).where("source = 'ASIA'")
    model, table = boosting.select_penalty(_events(s, d), _pairs(s, d), held, FEATURES)
    return _r(s.createDataFrame([(p, a, q, p == model["penalty"]) for p, a, q in table], "penalty double, accuracy double, ndcg double, chosen boolean"), "accuracy", "ndcg")


_add("r6_pairwise_trees", _nodes)
_add("r6_fitted_relevance", lambda s, d: scores.score_trees(_events(s, d), _model(s, d)).select("track_id", "id", "relevance"))
_add("r20_cross_source_trees", lambda s, d: _r(boosting.leave_one_source_out(_events(s, d), _pairs(s, d), _sources(s, d), FEATURES, "strength", trees=2, depth=2, rate=0.3), "accuracy", "base", "delta"))
_add("r22_select_penalty", _penalties)


# charts ----------------------------------------------------------------------------------

TOL = 0.3


def _charts(s: SparkSession, d: str) -> DataFrame:
    """Markers of a track's charts: what one kind of event says about where the purchases are."""
    return t.onsets(s, d).where("kind <> 'purchase'").select("track_id", F.col("kind").alias("chart"), "id", "t")


def _clusters(s: SparkSession, d: str) -> DataFrame:
    """Clusters of the purchases, once for each chart of their track."""
    found = alignment.clusters(_kind(s, d, "purchase"), 0.01)
    return found.join(_charts(s, d).select("track_id", "chart").distinct(), "track_id").select("track_id", "chart", "id", "t")


def _aligned(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return alignment.align_monotone(_clusters(s, d), _charts(s, d), ["track_id", "chart"], TOL)


def _report(s: SparkSession, d: str) -> DataFrame:
    matches, counts = _aligned(s, d)
    return alignment.chart_report(matches, _charts(s, d), counts, ["track_id", "chart"])


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    ends = _charts(s, d).groupBy("track_id", "chart").agg(F.max("t").alias("last"))
    duration = t.onsets(s, d).groupBy("track_id").agg(F.max("t").alias("duration"))
    rows = _report(s, d).join(ends, ["track_id", "chart"]).join(duration, "track_id")
    return corpora.alignment_verdict(rows.select("track_id", "chart", "n", "matched", "p95", "last", "duration"), 0.3, 0.25).select("track_id", "chart", "matched", "reason")


def _weak_labels(s: SparkSession, d: str) -> DataFrame:
    """Support of each purchase by the charts that hit its cluster."""
    hits = _aligned(s, d)[0].select("track_id", "id", "chart")
    places = corpora.group_charts(_charts(s, d).select("track_id", "chart", "t")).where("reason IS NULL").select("track_id", "chart", "place")
    return corpora.weak_labels(_kind(s, d, "purchase"), hits, places)


_add("m4_align_monotone", lambda s, d: _r(_aligned(s, d)[0], "residual"))
_add("m4_chart_report", lambda s, d: _r(_report(s, d), "rate", "median", "p95", "most"))
_add("c6_song_offset_aligned", lambda s, d: _r(corpora.song_offset(_aligned(s, d)[0], _charts(s, d).groupBy("track_id", "chart").agg(F.count("*").alias("n")), 0.3, 3, 0.05, 0.1), "mad", "shift"))
_add("c7_verdict_aligned", _verdicts)
_add("c8_weak_labels_aligned", _weak_labels)
_add("c9_pairs_aligned", lambda s, d: corpora.capped_preference_pairs(_weak_labels(s, d).join(_kind(s, d, "purchase").select("track_id", "id", "t", F.floor(F.col("t") / 8).alias("segment")), ["track_id", "id"]), 4.0, 0.25))
