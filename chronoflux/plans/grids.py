"""Queries over irregular beats, bars and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoflux.operators import grid, tempo
from chronoflux.plans.catalog import _add, _kind, _r
from chronoflux.sources import tables as t

_W = "(PARTITION BY track_id ORDER BY t)"
STEPPED = f"p AS (SELECT *, coalesce(lead(t) OVER {_W} - t, t - lag(t) OVER {_W}, 1.0::DOUBLE) AS step, lead(t) OVER {_W} IS NOT NULL AS more, lead(bar) OVER {_W} AS nb, lead(beat_in_bar) OVER {_W} AS nn FROM pulses)"
SPANS = f"sp AS (SELECT track_id, bar, t AS t0, coalesce(lead(t) OVER {_W}, 2 * t - lag(t) OVER {_W}) AS t1 FROM pulses WHERE beat_in_bar = 1), la AS (SELECT track_id, max_by(t0, bar) AS l0, max_by(t1, bar) AS l1, max(bar) AS lb FROM sp GROUP BY ALL)"
VIEWS = "v AS (SELECT track_id, id, t FROM onsets WHERE kind = 'view')"
POSITION = """po AS (SELECT v.track_id, v.id, v.t,
  (CASE WHEN p.t IS NULL THEN floor(v.t)::BIGINT // 4 + 1 ELSE p.bar + (p.beat_in_bar - 1 + floor((v.t - p.t) / step)::BIGINT) // 4 END) AS bar,
  (CASE WHEN p.t IS NULL THEN floor(v.t)::BIGINT % 4 + 1 ELSE (p.beat_in_bar - 1 + floor((v.t - p.t) / step)::BIGINT) % 4 + 1 END) AS beat,
  CASE WHEN p.t IS NULL THEN v.t - floor(v.t) ELSE (v.t - p.t) / step - floor((v.t - p.t) / step) END AS beat_phase
  FROM v ASOF LEFT JOIN p ON v.track_id = p.track_id AND v.t >= p.t)"""
PHASE = """ph AS (SELECT po.*, CASE WHEN lb IS NULL THEN t / 4 - floor(t / 4) WHEN t1 > t0 THEN least(1, greatest(0, (t - t0) / (t1 - t0)))
  WHEN po.bar > lb AND l1 IS NOT NULL THEN least(1, greatest(0, (t - (l1 + (po.bar - lb - 1) * greatest(l1 - l0, 1e-6))) / greatest(l1 - l0, 1e-6))) ELSE 0 END AS bar_phase
  FROM po LEFT JOIN sp ON po.track_id = sp.track_id AND po.bar = sp.bar LEFT JOIN la ON po.track_id = la.track_id)"""


def _views(s: SparkSession, d: str) -> DataFrame:
    return _kind(s, d, "view").select("track_id", "id", "t")


_add("q4_irregular_bar_spans", lambda s, d: t.pulses(s, d).transform(lambda p: grid.query.bar_spans(p)), f"WITH {SPANS} SELECT track_id, bar, t0, t1 FROM sp")
_add("q6_position_irregular", lambda s, d: _r(grid.position(_views(s, d), t.pulses(s, d)), "beat_phase").drop("t"), f"WITH {STEPPED}, {VIEWS}, {POSITION} SELECT track_id, id, bar, beat, round(beat_phase, 6) AS beat_phase FROM po")
_add("q7_bar_phase_irregular", lambda s, d: _r(grid.bar_phase(grid.position(_views(s, d), t.pulses(s, d)), t.pulses(s, d)), "bar_phase").select("track_id", "id", "bar_phase"), f"WITH {STEPPED}, {SPANS}, {VIEWS}, {POSITION}, {PHASE} SELECT track_id, id, round(bar_phase, 6) AS bar_phase FROM ph")
_add(
    "q16_quantize_irregular",
    lambda s, d: _r(grid.quantize(t.onsets(s, d), t.pulses(s, d)), "quantized_time").drop("t", "offset_ms"),
    f"""WITH {STEPPED}, f AS (SELECT track_id, min(t) AS f0, min_by(step, t) AS fs FROM p GROUP BY ALL),
a AS (SELECT o.track_id, o.id, o.t, p.t AS ft, p.bar AS b, p.beat_in_bar AS n, step, more, nb, nn FROM onsets o ASOF LEFT JOIN p ON o.track_id = p.track_id AND o.t >= p.t),
k AS (SELECT a.*, f0, fs, (t - ft) / step * 4 AS x, CASE WHEN f0 IS NULL THEN 0 WHEN ft IS NULL THEN 1 ELSE 2 END AS c FROM a LEFT JOIN f USING (track_id)),
m AS (SELECT *, (CASE WHEN more THEN ceil(x - 0.5) ELSE round_even(x, 0) END)::BIGINT AS part, round_even(t / 0.25, 0)::BIGINT AS plain FROM k),
r AS (SELECT *, n - 1 + part // 4 AS cnt, more AND part = 4 AS nx FROM m)
SELECT track_id, id, round(CASE c WHEN 0 THEN plain * 0.25 WHEN 1 THEN f0 - round_even((f0 - t) / (fs / 4), 0) * fs / 4 ELSE ft + part * step / 4 END, 6) AS quantized_time,
 CASE c WHEN 0 THEN plain // 16 + 1 WHEN 1 THEN 0 ELSE CASE WHEN nx THEN nb ELSE b + cnt // 4 END END AS bar,
 CASE c WHEN 0 THEN plain % 16 // 4 + 1 WHEN 1 THEN 0 ELSE CASE WHEN nx THEN nn ELSE cnt % 4 + 1 END END AS beat,
 CASE c WHEN 0 THEN plain % 16 + 1 WHEN 1 THEN 0 ELSE CASE WHEN nx THEN (nn - 1) * 4 + 1 ELSE cnt % 4 * 4 + part % 4 + 1 END END AS step_in_bar,
 c = 1 AS pre_grid FROM r""",
)
_add(
    "q5_bar_windows_checked",
    lambda s, d: grid.bar_windows(t.onsets(s, d).select("track_id", "id", (F.col("id") % 9).alias("first"), (F.col("id") % 7 + 1).alias("last")), t.pulses(s, d)),
    f"WITH {SPANS}, en AS (SELECT track_id, max(t) AS e, max(bar) AS bars FROM pulses GROUP BY ALL), q AS (SELECT o.track_id, o.id, id % 9 AS f, id % 7 + 1 AS l, a.t0 AS a, b.t1 AS b, e, bars FROM onsets o LEFT JOIN en ON o.track_id = en.track_id LEFT JOIN sp a ON a.track_id = o.track_id AND a.bar = id % 9 LEFT JOIN sp b ON b.track_id = o.track_id AND b.bar = id % 7 + 1), x AS (SELECT *, CASE WHEN f > l OR f < 1 THEN 'bad_range' WHEN bars IS NULL THEN 'no_bars' WHEN l > bars OR a IS NULL THEN 'out_of_range' END AS error FROM q) SELECT track_id, id, CASE WHEN error IS NULL THEN a END AS t0, CASE WHEN error IS NULL THEN CASE WHEN l = bars THEN e ELSE b END END AS t1, error FROM x",
)
_add("q10_boundary_impulse", lambda s, d: _r(grid.boundary_impulse(_views(s, d), t.pulses(s, d).where("beat_in_bar = 1")), "impulse").drop("t"), f"WITH {VIEWS} SELECT v.track_id, v.id, round(coalesce(CASE WHEN v.t - p.t < 4 THEN exp(-(v.t - p.t) * 2) END, 0), 6) AS impulse FROM v ASOF LEFT JOIN (SELECT * FROM pulses WHERE beat_in_bar = 1) p ON v.track_id = p.track_id AND v.t >= p.t")
_add(
    "q8_energy_clamped",
    lambda s, d: _r(grid.energy(t.onsets(s, d).select(F.when(F.col("id") % 5 == 0, F.lit("none")).otherwise(F.col("kind")).alias("track_id"), "id", (F.col("t") * 10 - 3).alias("t")), t.frames(s, d), 6.0), "x").select("id", "x"),
    "WITH q AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'none' ELSE kind END AS k, least(greatest(t * 10 - 3, 0), (SELECT max(frame) FROM frames)) AS p FROM onsets) SELECT q.id, round(coalesce(least(1, greatest(0, (a.x + (coalesce(b.x, a.x) - a.x) * (p - floor(p))) / 6)), 0), 6) AS x FROM q LEFT JOIN frames a ON a.track_id = k AND a.frame = floor(p) LEFT JOIN frames b ON b.track_id = k AND b.frame = floor(p) + 1",
)
_SECTIONS = f"se AS (SELECT track_id, c AS section, t0, coalesce(lead(t0) OVER (PARTITION BY track_id ORDER BY t0), e) AS t1 FROM (SELECT track_id, (bar - 1) // 2 AS c, min(t) AS t0, max(t) AS e FROM pulses GROUP BY ALL))"
_add(
    "q15_state_at",
    lambda s, d: _r(grid.state(_views(s, d), t.pulses(s, d), _kind(s, d, "purchase"), grid.timeline_sections(t.pulses(s, d), 2)), "bar_phase", "impulse").select("track_id", "id", "bar", "beat", "bar_phase", "impulse", "accent", "section"),
    f"WITH {STEPPED}, {SPANS}, {VIEWS}, {POSITION}, {PHASE}, {_SECTIONS}, o AS (SELECT ph.*, u.t AS ot, u.strength AS os FROM ph ASOF LEFT JOIN (SELECT * FROM onsets WHERE kind = 'purchase') u ON ph.track_id = u.track_id AND ph.t >= u.t), i AS (SELECT *, coalesce(CASE WHEN t - ot < 0.24 THEN os * exp(-(t - ot) * 16) END, 0) AS imp FROM o) SELECT i.track_id, i.id, bar, beat, round(bar_phase, 6) AS bar_phase, round(imp, 6) AS impulse, imp > 0 AND coalesce(os >= 0.6, false) AS accent, CASE WHEN i.t < se.t1 THEN section END AS section FROM i ASOF LEFT JOIN se ON i.track_id = se.track_id AND i.t >= se.t0",
)
_add("q20_note_events", lambda s, d: grid.note_events(t.onsets(s, d)), "WITH n AS (SELECT track_id, id, round_even(t * 480, 0)::BIGINT AS k, CAST(least(127, greatest(1, round_even(strength * 126, 0) + 1)) AS INT) AS velocity FROM onsets), r AS (SELECT track_id, id, k AS tick, 1 AS o, 'on' AS kind, velocity FROM n UNION ALL SELECT track_id, id, k + 30, 0, 'off', 0 FROM n) SELECT track_id, id, tick, kind, velocity, row_number() OVER (PARTITION BY track_id ORDER BY tick, o, id)::INT AS place FROM r")
_add("q21_anchor_spans", lambda s, d: _r(grid.anchor_spans(t.segments(s, d).select("track_id", "id", F.when(F.col("id") % 2 == 0, "bar").otherwise("time").alias("kind"), (F.col("id") % 9 + 1.0).alias("a"), (F.col("id") % 9 + 3.0).alias("b"), "bpm"), F.col("bpm"), F.lit(0.5)), "t0", "t1").select("id", "t0", "t1"), "SELECT id, round(CASE WHEN id % 2 = 0 THEN 0.5 + (id % 9) * 240 / bpm ELSE id % 9 + 1 END, 6) AS t0, round(CASE WHEN id % 2 = 0 THEN 0.5 + (id % 9 + 3) * 240 / bpm ELSE id % 9 + 3 END, 6) AS t1 FROM segments")


def _tracks(s: SparkSession, d: str) -> DataFrame:
    return t.onsets(s, d).groupBy("track_id").agg(F.max("t").alias("duration"))


_add(
    "q22_default_sections_full",
    lambda s, d: grid.default_sections(_tracks(s, d), t.segments(s, d).where("track_id % 3 = 0").select("track_id", (F.col("t0") % 40).alias("t0")).distinct(), t.pulses(s, d).where("track_id % 3 = 1")),
    "WITH tr AS (SELECT track_id, max(t) AS e FROM onsets GROUP BY ALL), sg AS (SELECT DISTINCT track_id, t0 % 40 AS t FROM segments WHERE track_id % 3 = 0), ch AS (SELECT track_id, min(t) AS t FROM pulses WHERE track_id % 3 = 1 AND track_id NOT IN (SELECT track_id FROM sg) GROUP BY track_id, (bar - 1) // 8), ti AS (SELECT track_id, c * 30.0::DOUBLE AS t FROM (SELECT track_id, unnest(generate_series(0, greatest(ceil(e / 30)::BIGINT - 1, 0))) AS c FROM tr WHERE track_id NOT IN (SELECT track_id FROM sg) AND track_id NOT IN (SELECT track_id FROM pulses WHERE track_id % 3 = 1))), u AS (SELECT *, 'segments' AS origin FROM sg UNION ALL SELECT *, 'bars' FROM ch UNION ALL SELECT *, 'time' FROM ti) SELECT u.track_id, row_number() OVER w::INT AS section, t AS t0, coalesce(lead(t) OVER w, e) AS t1, origin FROM u JOIN tr ON u.track_id = tr.track_id WINDOW w AS (PARTITION BY u.track_id ORDER BY t)",
)
_add("t11_number_beats", lambda s, d: grid.number_beats(t.marks(s, d), 3), "SELECT track_id, t, idx // 3 + 1 AS bar, (idx % 3 + 1)::INT AS beat_in_bar FROM marks")
_MARKERS = "mk AS (SELECT track_id, t, (min(id) % 4 + 1) AS beat FROM onsets WHERE kind = 'click' GROUP BY ALL)"


def _markers(s: SparkSession, d: str) -> DataFrame:
    return _kind(s, d, "click").groupBy("track_id", "t").agg((F.min("id") % 4 + 1).alias("beat"))


_GAPS = f"g AS (SELECT track_id, t, beat, sum((beat = 1)::BIGINT) OVER {_W}::BIGINT AS bar, coalesce(beat <> lag(beat) OVER {_W} % 4 + 1 AND beat <> 1, false) AS gap FROM mk)"
_add("src6_markers_to_grid", lambda s, d: grid.markers_to_grid(_markers(s, d)), f"WITH {_MARKERS}, {_GAPS} SELECT track_id, t, beat, bar, gap FROM g")
_add("t16_grid_summary_full", lambda s, d: grid.grid_summary(grid.markers_to_grid(_markers(s, d)), 60.0), f"WITH {_MARKERS}, {_GAPS} SELECT track_id, coalesce(min(CASE WHEN beat = 1 THEN t END), min(t)) AS origin, greatest(ceil(greatest(max(t) - coalesce(min(CASE WHEN beat = 1 THEN t END), min(t)), 0) / 4)::BIGINT, 1) AS bars, 0.25::DOUBLE AS step, count(*) FILTER (gap) AS gaps FROM g GROUP BY track_id")
_add(
    "t12_estimate_bpm_full",
    lambda s, d: _r(grid.estimate_bpm(t.pulses(s, d)), "bpm", "confidence"),
    f"WITH g AS (SELECT track_id, t - lag(t) OVER {_W} AS gap FROM pulses), m AS (SELECT track_id, quantile_cont(gap, 0.5) AS m FROM g GROUP BY ALL), a AS (SELECT track_id, gap, m, abs(gap - m) AS dd FROM g JOIN m USING (track_id) WHERE gap IS NOT NULL), x AS (SELECT track_id, quantile_cont(dd, 0.5) AS mad FROM a GROUP BY ALL), n AS (SELECT track_id, any_value(m) AS m, quantile_cont(gap, 0.5) AS q, stddev_pop(gap) AS sd FROM a JOIN x USING (track_id) WHERE dd <= greatest(3 * mad, 0.03) GROUP BY ALL) SELECT p.track_id, round(CASE WHEN m > 0 THEN 60 / q ELSE 120 END, 6) AS bpm, round(CASE WHEN m > 0 THEN least(0.99, greatest(0.2, 1 - sd / m)) ELSE 0 END, 6) AS confidence, coalesce(m > 0 AND sd > 0.015, false) AS variable FROM (SELECT DISTINCT track_id FROM pulses) p LEFT JOIN n USING (track_id)",
)

# tempo -----------------------------------------------------------------------------------
_ANCH = "an AS (SELECT track_id, id, row_number() OVER (PARTITION BY track_id ORDER BY t0, id) - 1 AS i, bpm FROM segments)"


def _anchors(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("track_id").orderBy("t0", "id")) - 1
    return t.segments(s, d).select("track_id", i.alias("i"), "bpm")


_add(
    "t3_change_scores",
    lambda s, d: _r(tempo.change_scores(_anchors(s, d)), "change"),
    f"WITH {_ANCH}, l AS (SELECT *, list(bpm) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS ls, list(bpm) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS rs FROM an), m AS (SELECT *, list_median(ls) AS lm, list_median(rs) AS rm FROM l), s AS (SELECT track_id, i, CASE WHEN ls IS NULL OR len(ls) = 0 THEN 0 ELSE least(1, greatest(0, (abs(log2(rm / lm)) - 0.025) / 0.12)) * least(1, least(len(list_filter(ls, lambda x: abs(log2(x / lm)) <= 0.06)), len(list_filter(rs, lambda x: abs(log2(x / rm)) <= 0.06))) / 2.0::DOUBLE) END AS sc FROM m) SELECT track_id, i::INT AS i, round(CASE WHEN i = 0 THEN 0 ELSE least(sc, lag(sc) OVER (PARTITION BY track_id ORDER BY i)) END, 6) AS change FROM s",
)
_add(
    "t5_period_guide",
    lambda s, d: _r(tempo.period_guide(t.frames(s, d).select("track_id", "frame"), _frame_anchors(s, d)), "period").select("track_id", "frame", "period"),
    "WITH a AS (SELECT track_id, frame, 60 + x * 7 AS bpm FROM frames WHERE frame % 50 = 10), n AS (SELECT *, lead(frame) OVER w AS f1, lead(bpm) OVER w AS b1 FROM a WINDOW w AS (PARTITION BY track_id ORDER BY frame)), f AS (SELECT track_id, min(frame) AS f0, min_by(bpm, frame) AS b0 FROM a GROUP BY ALL) SELECT q.track_id, q.frame, round(60 / CASE WHEN n.frame IS NULL THEN b0 WHEN f1 IS NULL THEN n.bpm ELSE exp(ln(n.bpm) + (ln(b1) - ln(n.bpm)) * (q.frame - n.frame) / (f1 - n.frame)) END, 6) AS period FROM frames q ASOF LEFT JOIN n ON q.track_id = n.track_id AND q.frame >= n.frame LEFT JOIN f ON q.track_id = f.track_id",
)


def _frame_anchors(s: SparkSession, d: str) -> DataFrame:
    return t.frames(s, d).where("frame % 50 = 10").select("track_id", "frame", (F.col("x") * 7 + 60).alias("bpm"))


_add(
    "t1_windowed_autocorrelation",
    lambda s, d: _r(tempo.local_autocorrelation(t.frames(s, d), 48, 24, 3, 12), "r"),
    "WITH an AS (SELECT DISTINCT track_id, frame AS a, greatest(frame - 24, 0) AS s0 FROM frames WHERE frame % 24 = 0), w AS (SELECT an.track_id, a, f.frame, x - avg(x) OVER (PARTITION BY an.track_id, a) AS y, count(*) OVER (PARTITION BY an.track_id, a) AS n FROM an JOIN frames f ON an.track_id = f.track_id AND f.frame >= s0 AND f.frame < s0 + 48) SELECT p.track_id, p.a AS anchor, lag, round(sum(p.y * q.y) / (sqrt(sum(p.y * p.y) * sum(q.y * q.y)) + 1e-9), 6) AS r FROM w p CROSS JOIN (SELECT unnest(generate_series(3, 12))::INT AS lag) JOIN w q ON p.track_id = q.track_id AND p.a = q.a AND q.frame = p.frame + lag WHERE p.n > 12 GROUP BY ALL",
)
_PEAKS = "c AS (SELECT track_id, anchor, lag, r, lag(r) OVER (PARTITION BY track_id, anchor ORDER BY lag) AS p, lead(r) OVER (PARTITION BY track_id, anchor ORDER BY lag) AS n FROM ac), k AS (SELECT *, row_number() OVER (PARTITION BY track_id, anchor ORDER BY -r, abs(log2(720.0::DOUBLE / lag / 120)), lag) AS rk FROM c WHERE r > 0 AND (p IS NULL OR r > p) AND (n IS NULL OR r >= n))"
_add(
    "t2_tempo_candidates",
    lambda s, d: _r(tempo.candidates(_r(tempo.local_autocorrelation(t.frames(s, d), 48, 24, 3, 12), "r"), 720.0, 120.0, 60.0, 240.0), "bpm"),
    f"WITH an AS (SELECT DISTINCT track_id, frame AS a, greatest(frame - 24, 0) AS s0 FROM frames WHERE frame % 24 = 0), w AS (SELECT an.track_id, a, f.frame, x - avg(x) OVER (PARTITION BY an.track_id, a) AS y, count(*) OVER (PARTITION BY an.track_id, a) AS n FROM an JOIN frames f ON an.track_id = f.track_id AND f.frame >= s0 AND f.frame < s0 + 48), ac AS (SELECT p.track_id, p.a AS anchor, lag, round(sum(p.y * q.y) / (sqrt(sum(p.y * p.y) * sum(q.y * q.y)) + 1e-9), 6) AS r FROM w p CROSS JOIN (SELECT unnest(generate_series(3, 12))::INT AS lag) JOIN w q ON p.track_id = q.track_id AND p.a = q.a AND q.frame = p.frame + lag WHERE p.n > 12 GROUP BY ALL), {_PEAKS}, v AS (SELECT track_id, anchor, r, 720.0::DOUBLE / lag AS bpm, 0 AS o FROM k WHERE rk <= 5 UNION ALL SELECT track_id, anchor, r, 1440.0::DOUBLE / lag, 1 FROM k WHERE rk <= 5 AND 1440.0 / lag BETWEEN 60 AND 240 UNION ALL SELECT track_id, anchor, r, 360.0::DOUBLE / lag, 2 FROM k WHERE rk <= 5 AND 360.0 / lag BETWEEN 60 AND 240) SELECT track_id, anchor, round(bpm, 6) AS bpm, r AS score, o::INT AS origin FROM v QUALIFY row_number() OVER (PARTITION BY track_id, anchor, round(bpm, 6) ORDER BY r DESC, o) = 1",
)
_add("t18_timing_risk", lambda s, d: _r(tempo.timing_risk(t.segments(s, d).select("track_id", "id", "bpm", (F.col("id") % 100 / 100).alias("score")), 120.0), "ratio").select("id", "ratio", "alias"), "WITH r AS (SELECT id, abs(log2(bpm / 120)) AS dev, log2(bpm / 120) AS l FROM segments WHERE id % 100 / 100 < 0.25), a AS (SELECT *, list_sort([{'d': abs(l - log2(0.5::DOUBLE)), 'a': 0.5::DOUBLE}, {'d': abs(l - log2(2.0::DOUBLE / 3)), 'a': 2.0::DOUBLE / 3}, {'d': abs(l - log2(1.5::DOUBLE)), 'a': 1.5::DOUBLE}, {'d': abs(l - 1), 'a': 2.0::DOUBLE}])[1] AS best FROM r WHERE dev > 0.2) SELECT id, round(l, 6) AS ratio, best.a AS alias FROM a")
_add("t19_canonical_segments", lambda s, d: tempo.segment_violations(t.segments(s, d).where("id % 11 <> 0").select("track_id", "t0", F.col("t1"), "bpm"), 150.0), "WITH s AS (SELECT track_id, t0, t1, bpm, lag(t1) OVER (PARTITION BY track_id ORDER BY t0, t1 NULLS FIRST) AS p, row_number() OVER (PARTITION BY track_id ORDER BY t0, t1 NULLS FIRST) AS n FROM segments WHERE id % 11 <> 0) SELECT track_id, t0, rule FROM (SELECT track_id, t0, unnest([CASE WHEN n > 1 AND (p IS NULL OR abs(p - t0) > 1e-6) THEN 'not_contiguous' END, CASE WHEN t1 <= t0 THEN 'empty' END, CASE WHEN bpm <= 0 OR bpm > 150 THEN 'bpm' END]) AS rule FROM s) WHERE rule IS NOT NULL")
_add("t4_tempo_path", lambda s, d: _r(tempo.tempo_path(tempo.candidates(_r(tempo.local_autocorrelation(t.frames(s, d), 48, 24, 3, 12), "r"), 720.0, 120.0, 60.0, 240.0), 120.0), "bpm"))
_add("t10_repair_beats", lambda s, d: tempo.repair_beats(t.pulses(s, d).select("track_id", "t"), 1.0))
_add("t15_tempo_segments", lambda s, d: _r(tempo.tempo_segments(t.pulses(s, d)), "bpm", "t0", "t1"))
_add("t8_beat_chain", lambda s, d: tempo.beat_chain(t.frames(s, d).where("x >= 3").select("track_id", "frame", (F.col("x") / 10).alias("support")), 8.0))
_add("t9_snap_beats", lambda s, d: tempo.snap_beats(t.frames(s, d).select("track_id", F.col("frame").alias("t")).where("t % 7 = 3"), t.frames(s, d), 7.0, 2))


def _intervals(s: SparkSession, d: str) -> DataFrame:
    """Intervals of the pulses: their tempo, and how much stronger the event at their start is than the weakest."""
    w = Window.partitionBy("track_id").orderBy("t")
    rows = t.pulses(s, d).join(t.onsets(s, d).groupBy("track_id", "t").agg(F.max("strength").alias("change")), ["track_id", "t"])
    rows = rows.select("track_id", F.col("idx").alias("i"), (60 / (F.lead("t").over(w) - F.col("t"))).alias("bpm"), "change")
    return rows.where("bpm IS NOT NULL")


_add("t14_segment_tempo_curve", lambda s, d: tempo.segment_tempo_curve(_intervals(s, d)))
