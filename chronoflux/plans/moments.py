"""Queries of named anchors, refined beats and chart files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoflux.operators import evidence, tempo, timeline
from chronoflux.plans.catalog import _add, _r
from chronoflux.sources import charts
from chronoflux.sources import tables as t
from chronoflux.sources.store import stored


def _anchors(s: SparkSession, d: str) -> DataFrame:
    """An anchor per event: views are times, clicks onsets, errors beats, and the rest hang on the event before."""
    before = F.lag(F.col("id").cast("string")).over(Window.partitionBy("track_id").orderBy("t", "id"))
    of = lambda k, x: F.when(F.col("kind") == k, x)
    hangs = F.col("kind").isin("purchase", "signup")
    return t.onsets(s, d).select("track_id", F.col("id").cast("string").alias("name"), of("view", F.col("t")).alias("seconds"), of("error", F.floor(F.col("t")).cast("long")).alias("beat"), of("click", F.col("id")).alias("onset"), F.when(hangs, before).alias("moment"), F.col("low").alias("offset"), F.when(hangs, F.col("high") * 4).alias("offset_beats"))


_add(
    "q24_resolve_anchors",
    lambda s, d: _r(timeline.resolve_anchors(_anchors(s, d), t.beats(s, d), t.onsets(s, d)), "t"),
    """WITH RECURSIVE a AS (SELECT track_id, id, kind, t, low, CASE WHEN kind IN ('purchase', 'signup') THEN high * 4 * 0.5::DOUBLE ELSE 0 END AS moved, CASE WHEN kind IN ('purchase', 'signup') THEN lag(id) OVER (PARTITION BY track_id ORDER BY t, id) END AS moment FROM onsets),
r AS (SELECT track_id, id, CASE kind WHEN 'view' THEN t WHEN 'error' THEN floor(t)::BIGINT * 0.5::DOUBLE ELSE t END + low AS t FROM a WHERE kind IN ('view', 'click', 'error') UNION ALL SELECT a.track_id, a.id, r.t + moved + low FROM a JOIN r ON r.track_id = a.track_id AND r.id = a.moment)
SELECT a.track_id, a.id::VARCHAR AS name, round(r.t, 6) AS t, CASE WHEN r.t IS NOT NULL THEN 'ok' WHEN f.first = a.id THEN 'invalid' ELSE 'unknown' END AS status FROM a LEFT JOIN r USING (track_id, id) JOIN (SELECT track_id, arg_min(id, (t, id)) AS first FROM onsets GROUP BY ALL) f ON f.track_id = a.track_id""",
)
_add("t17_refine_beats", lambda s, d: _r(tempo.refine_beats(t.pulses(s, d).select("track_id", "t"), t.onsets(s, d).where("kind = 'view'"), t.onsets(s, d).groupBy("track_id", F.floor(F.col("t") * 20).alias("frame")).agg(F.max("strength").alias("x")), 20.0, 0.4), "original", "chosen", "score", "margin"))

ROWS = 16


def _step_files(s: SparkSession, d: str) -> DataFrame:
    """A step file per track: a measure is four units of t, an event a tap in one of 16 rows; tempo doubles at beat 40."""
    taps = t.onsets(s, d).select("track_id", F.floor(F.col("t") / 4).alias("measure"), F.floor(F.col("t") % 4 * 4).alias("row"), (F.col("kind") == "error").cast("int").alias("mine"))
    lanes = taps.groupBy("track_id", "measure", "row").agg(F.concat(F.when(F.min("mine") == 1, "M").otherwise("1"), F.lit("0")).alias("lane"))
    last = taps.groupBy("track_id").agg(F.max("measure").alias("last"))
    every = last.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("measure")).select("track_id", "measure", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ROWS - 1).cast("long"))).alias("row"))
    rows = every.join(lanes, ["track_id", "measure", "row"], "left").withColumn("lane", F.coalesce("lane", F.lit("00")))
    measures = rows.groupBy("track_id", "measure").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "lane"))), lambda x: x["lane"]), "\n").alias("text"))
    body = measures.groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("measure", "text"))), lambda x: x["text"]), "\n,\n").alias("body"))
    head = "#TITLE:{};\n#OFFSET:-0.5;\n#BPMS:0=60,40=120;\n#STOPS:8=0.25;\n#NOTES:\nsingle:events:Hard:3:0,0:\n"
    return body.select(F.col("track_id").cast("string").alias("path"), F.concat(F.lit(head), "body", F.lit("\n;\n")).alias("body"))


_STEP = f"tp AS (SELECT track_id, floor(t / 4)::BIGINT * 4 + floor(t % 4 * 4) / 4 AS b, min((kind = 'error')::INT) AS mine FROM onsets GROUP BY ALL), mk AS (SELECT track_id, b, mine, 0.5::DOUBLE + CASE WHEN b > 40 THEN 40 + (b - 40) / 2 ELSE b END + CASE WHEN b > 8 THEN 0.25::DOUBLE ELSE 0 END AS s FROM tp)"
_add("src7_step_markers", lambda s, d: charts.step_charts(stored(_step_files(s, d)))[0], f"WITH {_STEP} SELECT track_id::VARCHAR AS path, 0 AS chart, round(s, 6) AS t FROM mk WHERE mine = 0")
_add("src7_step_charts", lambda s, d: charts.step_charts(stored(_step_files(s, d)))[1], f"WITH {_STEP} SELECT track_id::VARCHAR AS path, 0 AS chart, 'single' AS mode, 'Hard' AS difficulty, count(*) AS objects, 0::BIGINT AS tails, sum(mine)::BIGINT AS hazards, count(*) FILTER (mine = 0) AS markers, NULL::VARCHAR AS reason FROM mk GROUP BY track_id")


def _hit_files(s: SparkSession, d: str) -> DataFrame:
    """A hit-object file per track: each event a circle, slider, spinner or hold by its kind; tracks with errors first go back in time."""
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("click", 1, "view", 2, "error", 8, "purchase", 128, "signup", 5)]), F.col("kind"))
    rows = t.onsets(s, d).select("track_id", F.floor(F.col("t") * 1000).alias("ms"), "id", kind.alias("bits"))
    line = F.concat_ws(",", F.lit("256"), F.lit("192"), F.col("x.ms").cast("string"), F.col("x.bits").cast("string"), F.lit("0"))
    body = rows.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("ms", "id", "bits"))).alias("xs"))
    lines = body.select("track_id", F.posexplode("xs").alias("k", "x")).select("track_id", "k", line.alias("line"))
    text = lines.groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = F.concat(F.lit("osu file format v14\n\n[General]\nMode: "), (F.col("track_id") % 4).cast("string"), F.lit("\n\n[Metadata]\nVersion:Events\n\n[Difficulty]\nCircleSize:4\n\n[HitObjects]\n"))
    return text.select(F.col("track_id").cast("string").alias("path"), F.concat(head, "body", F.lit("\n")).alias("body"))


_HIT = "ho AS (SELECT track_id, track_id % 4 AS m, floor(t * 1000) / 1000 AS s, CASE kind WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 8 WHEN 'purchase' THEN 128 ELSE 5 END AS b FROM onsets), hs AS (SELECT *, b & 8 = 0 AND (b & 1 > 0 OR b & 2 > 0 AND m = 0 OR b & 128 > 0 AND m = 3) AS starts FROM ho)"
_add("src8_hit_markers", lambda s, d: charts.hit_object_charts(_hit_files(s, d))[0], f"WITH {_HIT} SELECT track_id::VARCHAR AS path, 0 AS chart, round(s, 6) AS t FROM hs WHERE starts AND m <> 2")
_add("src8_hit_charts", lambda s, d: charts.hit_object_charts(_hit_files(s, d))[1], f"WITH {_HIT} SELECT track_id::VARCHAR AS path, 0 AS chart, CASE m WHEN 0 THEN 'standard' WHEN 1 THEN 'taiko' WHEN 3 THEN 'mania' END AS mode, 'Events' AS difficulty, CASE WHEN m = 2 THEN 0 ELSE count(*) END AS objects, CASE WHEN m = 2 THEN 0 ELSE count(*) FILTER (b & 8 = 0 AND NOT starts) END AS tails, CASE WHEN m = 2 THEN 0 ELSE count(*) FILTER (b & 8 > 0) END AS hazards, CASE WHEN m = 2 THEN 0 ELSE count(*) FILTER (starts) END AS markers, CASE WHEN m = 2 THEN 'unsupported_mode' END AS reason FROM hs GROUP BY track_id, m")


def _evidence(s: SparkSession, d: str) -> DataFrame:
    found = evidence.event_evidence(t.onsets(s, d), t.pulses(s, d), t.marks(s, d).where("beat_in_bar = 1").join(t.onsets(s, d).groupBy("track_id", "t").agg(F.max("low").alias("novelty")), ["track_id", "t"]).select("track_id", "t", "novelty"))
    local = [F.col("local.rank")[b].alias(f"rank_{b}") for b in ("all", "low", "high")] + [F.col("local.contrast")[b].alias(f"contrast_{b}") for b in ("all", "low", "high")]
    return found.select("track_id", "id", F.col("local.sample_count").cast("long").alias("n"), *local, "spectral.*", "temporal.*", "metric.*", "structure.*", "group_id")


_add("e11_event_evidence", _evidence)
