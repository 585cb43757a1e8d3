"""Registered queries and their SQL: each applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoflux.operators import evidence, joins, matching, metrics, query, signal, structure, timeline
from chronoflux.sources import tables as t
from chronoflux.streaming import activity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        own = sql.lstrip()
        head = next((h for h in ("WITH RECURSIVE", "WITH") if own.startswith(h)), "")
        ORACLES[name] = f"{head or 'WITH'} {t.SQL.strip()},\n{own[len(head):].lstrip()}" if head else f"WITH {t.SQL.strip()}\n{sql}"


def _r(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _kind(s: SparkSession, d: str, kind: str) -> DataFrame:
    return t.onsets(s, d).where(F.col("kind") == kind)


def _at(s: SparkSession, d: str) -> DataFrame:
    """Query times: the clicks of each track."""
    return _kind(s, d, "click").select("track_id", "id", "t")


CLICK, VIEW = "(SELECT * FROM onsets WHERE kind = 'click')", "(SELECT * FROM onsets WHERE kind = 'view')"

_add("q1_events_between", lambda s, d: query.events_between(t.onsets(s, d), 10.0, 20.0).select("track_id", "id"), "SELECT track_id, id FROM onsets WHERE t > 10 AND t <= 20")
_add("q4_bar_spans", lambda s, d: query.bar_spans(t.beats(s, d)), "SELECT track_id, bar, t AS t0, coalesce(lead(t) OVER w, 2 * t - lag(t) OVER w) AS t1 FROM beats WHERE beat_in_bar = 1 WINDOW w AS (PARTITION BY track_id ORDER BY t)")
_add("q5_bar_window", lambda s, d: query.bar_window(t.beats(s, d), 3, 7), "WITH b AS (SELECT track_id, bar, t AS t0, coalesce(lead(t) OVER w, 2 * t - lag(t) OVER w) AS t1 FROM beats WHERE beat_in_bar = 1 WINDOW w AS (PARTITION BY track_id ORDER BY t)) SELECT track_id, min(t0) AS t0, max(t1) AS t1 FROM b WHERE bar BETWEEN 3 AND 7 GROUP BY ALL")
_add("q6_position_at", lambda s, d: _r(query.position_at(_at(s, d), t.beats(s, d)), "phase").select("track_id", "id", "bar", "beat_in_bar", "phase"), f"SELECT track_id, id, floor(t * 2)::BIGINT // 4 + 1 AS bar, floor(t * 2)::BIGINT % 4 + 1 AS beat_in_bar, round(t * 2 - floor(t * 2), 6) AS phase FROM {CLICK}")
_add("q8_energy_at", lambda s, d: _r(query.energy_at(_kind_rows(s, d), t.frames(s, d)), "x").select("id", "x"), "SELECT o.id, round(a.x + (coalesce(b.x, a.x) - a.x) * (p - floor(p)), 6) AS x FROM (SELECT id, kind, least(greatest(t * 10, 0), (SELECT max(frame) FROM frames)) AS p FROM onsets) o JOIN frames a ON a.track_id = kind AND a.frame = floor(p) LEFT JOIN frames b ON b.track_id = kind AND b.frame = floor(p) + 1")
_add("q9_previous_onset", lambda s, d: _r(query.previous_onset(_at(s, d), _kind(s, d, "view")), "age").select("track_id", "id", "onset_id", "age"), f"SELECT c.track_id, c.id, v.id AS onset_id, round(c.t - v.t, 6) AS age FROM {CLICK} c ASOF LEFT JOIN {VIEW} v ON c.track_id = v.track_id AND c.t >= v.t")
_add(
    "q9_nearest_onset",
    lambda s, d: _r(query.nearest_onset(_at(s, d), _kind(s, d, "view")), "distance").select("track_id", "id", "onset_id", "distance"),
    f"WITH b AS (SELECT c.*, v.id AS bi, v.t AS bt FROM {CLICK} c ASOF LEFT JOIN {VIEW} v ON c.track_id = v.track_id AND c.t >= v.t), f AS (SELECT b.*, v.id AS fi, v.t AS ft FROM b ASOF LEFT JOIN {VIEW} v ON b.track_id = v.track_id AND b.t <= v.t) SELECT track_id, id, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t - bt <= ft - t) THEN bi ELSE fi END AS onset_id, round(CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t - bt <= ft - t) THEN t - bt ELSE ft - t END, 6) AS distance FROM f",
)
_add("q10_onset_impulse", lambda s, d: _r(query.onset_impulse(_at(s, d), _kind(s, d, "view")), "impulse").select("track_id", "id", "impulse"), f"SELECT c.track_id, c.id, round(coalesce(CASE WHEN c.t - v.t < 0.24 THEN v.strength * exp(-(c.t - v.t) * 16) END, 0), 6) AS impulse FROM {CLICK} c ASOF LEFT JOIN {VIEW} v ON c.track_id = v.track_id AND c.t >= v.t")
_SHIPPED = "WITH q AS (SELECT o_custkey AS track_id, l_orderkey * 10 + l_linenumber AS id, epoch_us(l_shipdate) / 8.64e10 AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT q.*, s.id AS sid, s.family, s.t0, s.t1 FROM q ASOF LEFT JOIN segments s ON q.track_id = s.track_id AND q.t >= s.t0)"


def _shipped(s: SparkSession, d: str) -> DataFrame:
    day = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)") / 8.64e10
    lines = t.read(s, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), day.alias("t"))
    return lines.join(t.read(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("track_id")), F.col("l_orderkey") == F.col("o_orderkey")).select("track_id", "id", "t")


def _kind_rows(s: SparkSession, d: str) -> DataFrame:
    return t.onsets(s, d).select(F.col("kind").alias("track_id"), "id", (F.col("t") * 10).alias("t"))


_add("q11_structure_at", lambda s, d: _r(query.structure_at(_shipped(s, d), t.segments(s, d), 256.0), "phase", "to_boundary", "lead").select("id", "to_boundary", "lead"), _SHIPPED + " SELECT id, round(t1 - t, 6) AS to_boundary, round(l * l * (3 - 2 * l), 6) AS lead FROM (SELECT *, least(1, greatest(0, (4 - (t1 - t)) / 4)) AS l FROM s)")
_add("q13_next_event", lambda s, d: _r(query.next_event(_at(s, d), _kind(s, d, "purchase")), "wait").select("track_id", "id", "next_id", "wait"), f"SELECT c.track_id, c.id, v.id AS next_id, round(v.t - c.t, 6) AS wait FROM {CLICK} c ASOF LEFT JOIN (SELECT * FROM onsets WHERE kind = 'purchase') v ON c.track_id = v.track_id AND c.t < v.t")
_Q = "SELECT track_id, id, t, CAST(CASE WHEN abs(t * {n} - floor(t * {n}) - 0.5) < 1e-12 THEN 2 * round(floor(t * {n}) / 2.0 + 0.25) ELSE round(t * {n}) END AS BIGINT) AS k FROM onsets"
_add("q16_quantize", lambda s, d: query.quantize(t.onsets(s, d), t.beats(s, d)).select("track_id", "id", "quantized_time", "offset_ms", "bar", "beat", "step_in_bar"), f"WITH q AS ({_Q.format(n=8)}) SELECT track_id, id, k / 8.0::DOUBLE AS quantized_time, round((t - k / 8.0::DOUBLE) * 1000, 3) AS offset_ms, k // 16 + 1 AS bar, k // 4 % 4 + 1 AS beat, k % 16 AS step_in_bar FROM q")
_add("q17_grid_affinity", lambda s, d: query.grid_affinity(t.onsets(s, d), t.beats(s, d)), f"WITH a AS ({_Q.format(n=8)}), b AS ({_Q.format(n=16)}) SELECT a.track_id, a.id, CASE WHEN abs(round((a.t - a.k / 8.0::DOUBLE) * 1000, 3)) <= abs(round((b.t - b.k / 16.0::DOUBLE) * 1000, 3)) THEN '1/16' ELSE '1/32' END AS grid FROM a JOIN b USING (track_id, id)")
_add("q20_note_velocity", lambda s, d: t.onsets(s, d).select("track_id", "id", query.velocity(F.col("strength")).alias("velocity")), "SELECT track_id, id, CAST(least(127, greatest(1, round_even(strength * 126, 0) + 1)) AS INT) AS velocity FROM onsets")
_add("q25_compare_counts", lambda s, d: query.events_between(t.onsets(s, d), 0.0, 24.0).groupBy("track_id").agg(F.count("*").alias("n")), "SELECT track_id, count(*) AS n FROM onsets WHERE t > 0 AND t <= 24 GROUP BY ALL")
_add("q27_strongest_in_window", lambda s, d: query.strongest(t.onsets(s, d), 5.0, 30.0, "low").select("track_id", "id", "value"), "SELECT track_id, id, low AS value FROM onsets WHERE t > 5 AND t <= 30 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY low DESC, t, id) = 1")
_add("q29_dominant_band", lambda s, d: t.onsets(s, d).select("id", query.dominant_band(F.col("low"), F.col("mid"), F.col("high")).alias("band")), "SELECT id, CASE WHEN low = greatest(low, mid, high) THEN 'low' WHEN mid = greatest(low, mid, high) THEN 'mid' ELSE 'high' END AS band FROM onsets")
_add("q30_downbeats_in_window", lambda s, d: query.events_between(t.beats(s, d), 4.0, 12.0).where("beat_in_bar = 1").select("track_id", "idx"), "SELECT track_id, idx FROM beats WHERE beat_in_bar = 1 AND t > 4 AND t <= 12")
_add("j4_band_join", lambda s, d: joins.band(_at(s, d), _kind(s, d, "view"), 0.2).select("track_id", "id", "other_id"), f"SELECT c.track_id, c.id, v.id AS other_id FROM {CLICK} c JOIN {VIEW} v ON c.track_id = v.track_id AND abs(c.t - v.t) <= 0.2")
_add("j5_containment", lambda s, d: joins.contained(_shipped(s, d), t.segments(s, d), "s", 256.0).groupBy(F.coalesce("s.family", F.lit("none")).alias("family")).agg(F.count("*").alias("n")), _SHIPPED + " SELECT coalesce(CASE WHEN t1 IS NULL OR t < t1 THEN family END, 'none') AS family, count(*) AS n FROM s GROUP BY ALL")
_add("j6_overlap", lambda s, d: joins.overlapping(t.segments(s, d).where("t1 > t0").select("track_id", "id", "t0", "t1"), _month_windows(s, d), 64.0).select("id", "w"), "WITH w AS (SELECT track_id, id AS w, t0 AS w0, t0 + 30 AS w1 FROM segments) SELECT s.id, w FROM segments s JOIN w ON s.track_id = w.track_id AND s.t0 < w1 AND s.t1 > w0 WHERE s.t1 > s.t0")
_add("j8_anti_join", lambda s, d: t.onsets(s, d).join(_kind(s, d, "purchase").where("strength > 0.9").select("track_id"), "track_id", "left_anti").select("track_id", "id"), "SELECT track_id, id FROM onsets WHERE track_id NOT IN (SELECT track_id FROM onsets WHERE kind = 'purchase' AND strength > 0.9)")
_add("j9_semi_join", lambda s, d: t.onsets(s, d).join(_kind(s, d, "purchase").where("strength > 0.9").select("track_id"), "track_id", "left_semi").select("track_id", "id"), "SELECT track_id, id FROM onsets WHERE track_id IN (SELECT track_id FROM onsets WHERE kind = 'purchase' AND strength > 0.9)")


def _month_windows(s: SparkSession, d: str) -> DataFrame:
    return t.segments(s, d).select("track_id", F.col("id").alias("w"), F.col("t0").alias("w0"), (F.col("t0") + 30).alias("w1"))


_W = "WINDOW w AS (PARTITION BY track_id ORDER BY frame)"
_add("n2_flux", lambda s, d: _r(signal.flux(t.frames(s, d)), "flux").select("track_id", "frame", "flux"), f"SELECT track_id, frame, round(coalesce(greatest(ln(1 + x) - ln(1 + lag(x) OVER w), 0), 0), 6) AS flux FROM frames {_W}")
_add("n4_normalize", lambda s, d: _r(signal.normalize(t.frames(s, d)), "y").select("track_id", "frame", "y"), "WITH q AS (SELECT track_id, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.995) AS hi FROM frames GROUP BY ALL) SELECT track_id, frame, round(sqrt(least(1, greatest(0, (x - lo) / greatest(hi - lo, 1e-8)))), 6) AS y FROM frames JOIN q USING (track_id)")
_add("n5_noise_gate", lambda s, d: signal.noise_gate(t.frames(s, d), 3.0), "SELECT track_id, frame, x FROM frames WHERE x >= 3")
_add("n6_local_median", lambda s, d: signal.local_median(t.frames(s, d)).select("track_id", "frame", "med"), "SELECT track_id, frame, quantile_cont(x, 0.5) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 32 PRECEDING AND 32 FOLLOWING) AS med FROM frames")
_add("n7_peaks", lambda s, d: signal.peaks(t.frames(s, d), 3.0), f"SELECT track_id, frame, x FROM frames {_W} QUALIFY x >= lag(x) OVER w AND x > lead(x) OVER w AND x >= 3")
_add("n10_prominence", lambda s, d: signal.prominent(t.frames(s, d)), "SELECT track_id, frame, x FROM (SELECT *, min(x) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS l, min(x) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS r FROM frames) WHERE x > 0 AND x - greatest(l, r) >= x * 0.4")
_RANGE = "(PARTITION BY track_id ORDER BY t RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
_add("n14_accents", lambda s, d: signal.accents(t.onsets(s, d)), f"SELECT track_id, id, strength >= CASE WHEN n < 4 THEN 0.72 ELSE greatest(0.6, p) END AS accent FROM (SELECT *, quantile_cont(strength, 0.85) OVER {_RANGE.format(r='8.0::DOUBLE')} AS p, count(*) OVER {_RANGE.format(r='8.0::DOUBLE')} AS n FROM onsets)")
_add("n17_runs", lambda s, d: signal.pitch_runs(t.onsets(s, d)).select("track_id", "run", "kind", "n"), "WITH a AS (SELECT *, coalesce((kind <> lag(kind) OVER (PARTITION BY track_id ORDER BY t, id))::INT, 1) AS new FROM onsets), b AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY t, id)::BIGINT AS run FROM a) SELECT track_id, run, any_value(kind) AS kind, count(*) AS n FROM b GROUP BY track_id, run")
_add("n21_activity_bins", lambda s, d: signal.activity_bins(t.onsets(s, d), 72.0, 12), "SELECT track_id, floor(t * 12 / 72)::BIGINT AS bin, ((2 * sum(round(strength * 1e6)::BIGINT) + count(*)) // (2 * count(*)))::DOUBLE / 1e6 AS mean, max(strength) AS most FROM onsets WHERE t >= 0 AND t < 72 GROUP BY ALL")
_add("t1_autocorrelation", lambda s, d: _r(signal.autocorrelation(t.frames(s, d), range(1, 25)), "r"), "WITH y AS (SELECT track_id, frame, x - avg(x) OVER (PARTITION BY track_id) AS y FROM frames) SELECT a.track_id, lag, round(sum(a.y * b.y) / sqrt(sum(a.y * a.y) * sum(b.y * b.y)), 6) AS r FROM y a CROSS JOIN (SELECT unnest(generate_series(1, 24))::INT AS lag) JOIN y b ON a.track_id = b.track_id AND b.frame = a.frame + lag GROUP BY ALL")
_add("t6_beat_support", lambda s, d: _r(signal.beat_support(t.frames(s, d)), "support"), "WITH m AS (SELECT track_id, frame, x - quantile_cont(x, 0.5) OVER (PARTITION BY track_id) AS d FROM frames), p AS (SELECT track_id, quantile_cont(abs(d), 0.9) AS p FROM m GROUP BY ALL) SELECT track_id, frame, round(least(1, greatest(0, d / greatest(p, 1e-9))), 6) AS support FROM m JOIN p USING (track_id)")
_add("t7_first_strong", lambda s, d: signal.first_strong(t.frames(s, d)), "SELECT track_id, min(frame) AS frame FROM (SELECT *, max(x) OVER (PARTITION BY track_id) AS top, max(x) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM frames) WHERE x >= top * 0.4 AND x = near GROUP BY ALL")
_add("t12_estimate_bpm", lambda s, d: _r(signal.estimate_bpm(t.onsets(s, d)), "bpm", "spread"), "WITH g AS (SELECT track_id, t - lag(t) OVER (PARTITION BY track_id ORDER BY t, id) AS gap FROM onsets), f AS (SELECT track_id, gap, abs(gap - quantile_cont(gap, 0.5) OVER (PARTITION BY track_id)) AS d FROM g WHERE gap IS NOT NULL), k AS (SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY track_id) AS mad FROM f) SELECT track_id, round(60 / quantile_cont(gap, 0.5), 6) AS bpm, round(stddev_pop(gap), 6) AS spread, count(*) AS n FROM k WHERE d <= greatest(mad * 3, 0.03) GROUP BY ALL")
_add(
    "e1_local_view",
    lambda s, d: _r(evidence.local_view(t.onsets(s, d)), "midrank", "contrast", "density"),
    f"WITH q AS (SELECT *, list(strength) OVER {_RANGE.format(r='2.0::DOUBLE')} AS xs, quantile_cont(strength, 0.5) OVER {_RANGE.format(r='2.0::DOUBLE')} AS a, quantile_cont(strength, 0.9) OVER {_RANGE.format(r='2.0::DOUBLE')} AS b FROM onsets) SELECT track_id, id, round((len(list_filter(xs, lambda x: x < strength)) + 0.5::DOUBLE * len(list_filter(xs, lambda x: x = strength))) / len(xs), 6) AS midrank, round(least(4, greatest(0, (strength - a) / greatest(b - a, 0.08))), 6) AS contrast, round(len(xs) / greatest(least(t + 2, max(t) OVER (PARTITION BY track_id)) - greatest(t - 2, 0), 1e-9)::DOUBLE, 6) AS density FROM q",
)
_add("e4_spectral", lambda s, d: _r(evidence.spectral(t.onsets(s, d)), "focus").select("id", "focus"), "WITH s AS (SELECT id, low / greatest(low + mid + high, 1e-9) AS a, mid / greatest(low + mid + high, 1e-9) AS b, high / greatest(low + mid + high, 1e-9) AS c FROM onsets) SELECT id, round(1 - (CASE WHEN a > 0 THEN -a * ln(a) ELSE 0 END + CASE WHEN b > 0 THEN -b * ln(b) ELSE 0 END + CASE WHEN c > 0 THEN -c * ln(c) ELSE 0 END) / ln(3.0::DOUBLE), 6) AS focus FROM s")
_add("e5_gaps", lambda s, d: _r(evidence.gaps(t.onsets(s, d)), "before", "after", "isolated"), "SELECT track_id, id, round(b, 6) AS before, round(a, 6) AS after, round(least(1, greatest(0, least(coalesce(b, 2), coalesce(a, 2)))), 6) AS isolated FROM (SELECT *, t - lag(t) OVER w AS b, lead(t) OVER w - t AS a FROM onsets WINDOW w AS (PARTITION BY track_id ORDER BY t, id))")
_add("e6_metric_context", lambda s, d: _r(evidence.metric_context(t.onsets(s, d), t.beats(s, d)), "offset").select("id", "offset"), "SELECT id, round(t - ceil(t * 2 - 0.5) / 2, 6) AS \"offset\" FROM onsets")
_SESSIONS = "WITH a AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY track_id ORDER BY t, id) <= {gap} THEN 0 ELSE 1 END AS new FROM onsets), b AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY t, id)::BIGINT AS session FROM a)"
_add("e10_sessions", lambda s, d: evidence.sessions(t.onsets(s, d), 0.5, 3).select("track_id", "session", "n"), _SESSIONS.format(gap=0.5) + " SELECT track_id, session, count(*) AS n FROM b GROUP BY track_id, session HAVING count(*) >= 3")
_add("e8_capped_groups", lambda s, d: _r(evidence.capped_groups(t.onsets(s, d)), "t0", "t1"))
_add("m1_two_pointer", lambda s, d: evidence.match_counts(_kind(s, d, "click"), _kind(s, d, "view"), 0.2))
_add("r2_robust_scale", lambda s, d: _r(evidence.robust_scale(t.onsets(s, d), "low"), "scaled").select("id", "scaled"), "WITH q AS (SELECT quantile_cont(low, 0.25) AS a, quantile_cont(low, 0.5) AS b, quantile_cont(low, 0.75) AS c FROM onsets) SELECT id, round((low - b) / greatest(c - a, 1e-6), 6) AS scaled FROM onsets, q")
_SCORE = "(SELECT *, round(1 / (1 + exp(-(low * 0.5 + mid * 2.0 + high * -0.25))), 6) AS relevance FROM onsets)"
_WEIGHTS = {"low": 0.5, "mid": 2.0, "high": -0.25}
_add("r3_score_linear", lambda s, d: evidence.score_linear(t.onsets(s, d), _WEIGHTS).select("id", "relevance"), f"SELECT id, relevance FROM {_SCORE}")
_add("r8_select_budget", lambda s, d: evidence.select_budget(t.onsets(s, d).withColumn("relevance", F.col("mid")), 8).select("track_id", "id", "rank", "place"), "WITH b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY mid DESC, id)::INT AS rank FROM onsets QUALIFY rank <= 8) SELECT track_id, id, rank, row_number() OVER (PARTITION BY track_id ORDER BY t, id)::INT AS place FROM b")
_add("r13_ndcg", lambda s, d: _r(evidence.ndcg(t.onsets(s, d).withColumn("relevance", F.col("mid")), "low"), "ndcg"), "WITH r AS (SELECT track_id, low, row_number() OVER (PARTITION BY track_id ORDER BY mid DESC, id) AS r, row_number() OVER (PARTITION BY track_id ORDER BY low DESC, id) AS i FROM onsets), g AS (SELECT track_id, sum(CASE WHEN r <= 10 THEN low / log2(r + 1) ELSE 0 END) AS d, sum(CASE WHEN i <= 10 THEN low / log2(i + 1) ELSE 0 END) AS best FROM r GROUP BY ALL) SELECT track_id, round(CASE WHEN best > 0 THEN d / best ELSE 0 END, 6) AS ndcg FROM g")
_add("c3_fingerprint", lambda s, d: evidence.fingerprint(t.onsets(s, d)), "WITH c AS (SELECT track_id, floor(t / 5)::BIGINT AS cell, count(*) AS n FROM onsets GROUP BY ALL), e AS (SELECT track_id, unnest(generate_series(0, max(cell))) AS cell FROM c GROUP BY track_id) SELECT track_id, sha256(string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY cell)) AS fingerprint FROM e LEFT JOIN c USING (track_id, cell) GROUP BY track_id")
_add("c9_preference_pairs", lambda s, d: _r(evidence.preference_pairs(t.onsets(s, d), 0.3, 0.34), "margin"), "SELECT a.track_id, a.id AS better, b.id AS worse, round(a.strength - b.strength, 6) AS margin FROM onsets a JOIN onsets b ON a.track_id = b.track_id AND abs(a.t - b.t) <= 0.3 WHERE a.strength - b.strength >= 0.34")
_add("c10_salted_split", lambda s, d: evidence.salted_split(t.read(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", "v1:"), "SELECT doc_id, lang, CASE WHEN p <= 0.15 THEN 'test' WHEN p <= 0.3 THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('v1:' || doc_id)) / count(*) OVER (PARTITION BY lang) AS p FROM documents)")
_add("c12_leakage", lambda s, d: evidence.leakage(t.read(s, d, "documents").select(F.md5("text").alias("key"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split")), "key"), "SELECT md5(text) AS key, count(DISTINCT doc_id % 5 = 0) AS splits, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 5 = 0) > 1")
_add("c17_balanced_subset", lambda s, d: evidence.balanced_subset(t.read(s, d, "documents").select("doc_id", "source"), "source", "doc_id", 60), "SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR))::INT AS turn FROM documents) ORDER BY turn, source LIMIT 60")


def _scored(s: SparkSession, d: str) -> DataFrame:
    return t.onsets(s, d).withColumn("relevance", F.col("mid"))


def _edits(s: SparkSession, d: str) -> DataFrame:
    """Purchases are deleted, strong clicks moved on, and every strong view gets a cue beside it."""
    rows = t.onsets(s, d)
    strong = F.col("strength") > 0.5
    moved = rows.where((F.col("kind") == "click") & strong).select("track_id", "id", F.lit("move").alias("action"), (F.col("t") + 0.25).alias("at"))
    gone = rows.where("kind = 'purchase'").select("track_id", "id", F.lit("delete").alias("action"), F.lit(None).cast("double").alias("at"))
    added = rows.where((F.col("kind") == "view") & strong).select("track_id", (-F.col("id") - 1).alias("id"), F.lit("add").alias("action"), F.col("t").alias("at"))
    return moved.unionByName(gone).unionByName(added)


_add("q2_timing_events", lambda s, d: timeline.timing_events(t.onsets(s, d), t.beats(s, d), 11, 40).select("track_id", "n", "kind", "id"), "WITH u AS (SELECT track_id, 'onset' AS kind, id, t FROM onsets UNION ALL SELECT track_id, 'beat', idx, t FROM beats) SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t, kind, id)::INT AS n, kind, id FROM u QUALIFY n BETWEEN 11 AND 40")
_add("q3_spans_overlapping", lambda s, d: timeline.spans_overlapping(t.segments(s, d), 9500.0, 9600.0).select("track_id", "id"), "SELECT track_id, id FROM segments WHERE t0 < 9600 AND (t1 IS NULL OR t1 > 9500)")
_add("q7_bar_phase", lambda s, d: _r(timeline.bar_phase_at(_at(s, d), t.beats(s, d)), "phase").select("track_id", "id", "bar", "phase"), f"SELECT track_id, id, floor(t / 2)::BIGINT + 1 AS bar, round(t / 2 - floor(t / 2), 6) AS phase FROM {CLICK}")
_add("q14_repeated_segments", lambda s, d: timeline.repeated_segments(t.segments(s, d)).select("track_id", "id", "family"), "SELECT track_id, id, family FROM segments QUALIFY count(*) OVER (PARTITION BY track_id, family) > 1")


def _knots(s: SparkSession, d: str) -> DataFrame:
    return t.segments(s, d).select("track_id", F.col("t0").alias("t"), F.row_number().over(Window.partitionBy("track_id").orderBy("t0", "id")).cast("double").alias("step"))


_add(
    "q18_time_to_step",
    lambda s, d: _r(timeline.time_to_step(_shipped(s, d), _knots(s, d)), "step").select("id", "step"),
    "WITH q AS (SELECT o_custkey AS track_id, l_orderkey * 10 + l_linenumber AS id, epoch_us(l_shipdate) / 8.64e10 AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT track_id, t0, row_number() OVER (PARTITION BY track_id ORDER BY t0, id)::DOUBLE AS step FROM segments), k AS (SELECT track_id, t0, min(step) AS step FROM n GROUP BY ALL), m AS (SELECT *, coalesce((lead(step) OVER w - step) / (lead(t0) OVER w - t0), (step - lag(step) OVER w) / (t0 - lag(t0) OVER w)) AS slope FROM k WINDOW w AS (PARTITION BY track_id ORDER BY t0)) SELECT q.id, round(m.step + (q.t - m.t0) * m.slope, 6) AS step FROM q ASOF LEFT JOIN m ON q.track_id = m.track_id AND q.t >= m.t0",
)
_add(
    "q19_to_ticks",
    lambda s, d: timeline.to_ticks(_shipped(s, d), t.segments(s, d)).select("id", F.round("ticks", 3).alias("ticks")),
    "WITH q AS (SELECT o_custkey AS track_id, l_orderkey * 10 + l_linenumber AS id, epoch_us(l_shipdate) / 8.64e10 AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey), m AS (SELECT *, coalesce(sum((t1 - t0) * bpm) OVER (PARTITION BY track_id ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM segments WHERE t1 IS NULL OR t1 > t0) SELECT q.id, round((m.done + (q.t - m.t0) * m.bpm) / 60 * 480, 3) AS ticks FROM q ASOF LEFT JOIN m ON q.track_id = m.track_id AND q.t >= m.t0",
)
_add("q22_default_sections", lambda s, d: timeline.default_sections(t.beats(s, d)), "WITH c AS (SELECT track_id, (bar - 1) // 8 AS section, min(t) AS t0, max(t) AS e FROM beats GROUP BY ALL) SELECT track_id, section, t0, coalesce(lead(t0) OVER (PARTITION BY track_id ORDER BY t0), e) AS t1 FROM c")
_add(
    "q23_resample",
    lambda s, d: _r(timeline.resample(_at(s, d), _kind(s, d, "view").withColumnRenamed("strength", "value")), "value").select("track_id", "id", "value"),
    f"WITH k AS (SELECT track_id, t, strength AS v, lead(t) OVER w AS t1, lead(strength) OVER w AS v1 FROM {VIEW} WINDOW w AS (PARTITION BY track_id ORDER BY t, strength)), f AS (SELECT track_id, arg_min(v, t) AS first FROM k GROUP BY ALL), a AS (SELECT c.track_id, c.id, CASE WHEN k.t IS NOT NULL THEN coalesce(k.v + (k.v1 - k.v) * ((c.t - k.t) / (k.t1 - k.t)), k.v) END AS value FROM {CLICK} c ASOF LEFT JOIN k ON c.track_id = k.track_id AND c.t >= k.t) SELECT a.track_id, id, round(coalesce(value, first), 6) AS value FROM a LEFT JOIN f ON a.track_id = f.track_id",
)
_add("q26_nearest_cue", lambda s, d: _r(query.nearest_onset(_at(s, d), _kind(s, d, "purchase")), "distance").select("track_id", "id", "onset_id", "distance"), ORACLES["q9_nearest_onset"].replace(f"WITH {t.SQL.strip()},\n", "WITH ", 1).replace("kind = 'view'", "kind = 'purchase'"))
_add("q28_last_new_family", lambda s, d: timeline.last_new_family(t.segments(s, d)), "WITH f AS (SELECT track_id, family, min(t0) AS t0 FROM segments GROUP BY ALL) SELECT track_id, family, t0 FROM f QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY t0 DESC, family DESC) = 1")
_NEAR = "(PARTITION BY track_id ORDER BY frame ROWS BETWEEN 32 PRECEDING AND 32 FOLLOWING)"
_add("n6_local_threshold", lambda s, d: _r(signal.local_threshold(t.frames(s, d)), "threshold").select("track_id", "frame", "threshold"), f"WITH m AS (SELECT track_id, frame, quantile_cont(x, 0.5) OVER {_NEAR} AS med, list(x) OVER {_NEAR} AS xs FROM frames) SELECT track_id, frame, round(greatest(0.1::DOUBLE, med + 3 * list_aggregate(list_transform(xs, lambda v: abs(v - med)), 'median')), 6) AS threshold FROM m")
_add("n11_attack_start", lambda s, d: signal.attack_start(t.frames(s, d), 1.0).select("track_id", "frame", "start"), f"WITH b AS (SELECT track_id, frame, CASE WHEN NOT coalesce(lag(x) OVER w > 1 AND lag(x) OVER w <= x, false) THEN frame END AS f0 FROM frames {_W}) SELECT track_id, frame, greatest(max(f0) OVER w, frame - 64) AS start FROM b {_W}")


def _between_peaks(s: SparkSession, d: str) -> DataFrame:
    peaks = signal.peaks(t.frames(s, d), 3.0).select("track_id", F.col("frame").cast("double").alias("t0"))
    return peaks.withColumn("t1", F.lead("t0").over(Window.partitionBy("track_id").orderBy("t0")))


_add("n19_span_means", lambda s, d: _r(signal.span_means(t.frames(s, d), _between_peaks(s, d)), "mean"), f"WITH p AS (SELECT *, CASE WHEN x >= lag(x) OVER w AND x > lead(x) OVER w AND x >= 3 THEN frame END AS f0 FROM frames {_W}), g AS (SELECT x, track_id, max(f0) OVER w AS t0 FROM p {_W}) SELECT track_id, t0::DOUBLE AS t0, round(avg(x), 6) AS mean, count(*) AS n FROM g WHERE t0 IS NOT NULL GROUP BY track_id, t0")
_PAIRED = ORACLES["q9_nearest_onset"].replace(f"WITH {t.SQL.strip()},\n", "WITH ", 1).replace(" SELECT track_id, id, CASE", ", g AS (SELECT track_id, id, CASE", 1) + ")"


def _paired(s: SparkSession, d: str) -> DataFrame:
    return _r(query.nearest_onset(_at(s, d), _kind(s, d, "view")), "distance").where("distance IS NOT NULL")


_add("m6_timing_error", lambda s, d: _r(metrics.timing_error(_paired(s, d)), "mae_ms", "median", "most"), _PAIRED + " SELECT track_id, round(avg(distance) * 1000, 6) AS mae_ms, round(quantile_cont(distance, 0.5), 6) AS median, max(distance) AS most FROM g WHERE distance IS NOT NULL GROUP BY ALL")
_add("m15_pair_family_f1", lambda s, d: _r(metrics.pair_family_f1(t.onsets(s, d).withColumn("band", query.dominant_band(F.col("low"), F.col("mid"), F.col("high"))), "kind", "band"), "f1"), "WITH o AS (SELECT track_id, kind, CASE WHEN low = greatest(low, mid, high) THEN 'low' WHEN mid = greatest(low, mid, high) THEN 'mid' ELSE 'high' END AS band FROM onsets), c AS (SELECT track_id, kind, band, count(*) AS n FROM o GROUP BY GROUPING SETS ((track_id, kind, band), (track_id, kind), (track_id, band))), p AS (SELECT track_id, sum(n * (n - 1) / 2) FILTER (kind IS NOT NULL AND band IS NOT NULL) AS p, sum(n * (n - 1) / 2) FILTER (band IS NULL) AS a, sum(n * (n - 1) / 2) FILTER (kind IS NULL) AS b FROM c GROUP BY ALL) SELECT track_id, CASE WHEN a + b > 0 THEN round(2 * p / (a + b), 6) END AS f1 FROM p")
_add("m18_macro", lambda s, d: _r(metrics.macro(t.onsets(s, d), metrics.timing_error(_paired(s, d)), "mae_ms"), "mean", "median"), _PAIRED + ", e AS (SELECT track_id, avg(distance) * 1000 AS v FROM g WHERE distance IS NOT NULL GROUP BY ALL) SELECT count(*) AS selected, count(v) AS scored, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median FROM (SELECT DISTINCT track_id FROM onsets) s LEFT JOIN e USING (track_id)")
_add("m16_tiling", lambda s, d: metrics.tiling_rules(_month_windows(s, d).select("track_id", F.col("w").alias("id"), F.col("w0").alias("t0"), F.col("w1").alias("t1"))), "WITH s AS (SELECT track_id, id, t0 - (lag(t0) OVER (PARTITION BY track_id ORDER BY t0, id) + 30) AS off FROM segments) SELECT track_id, id, CASE WHEN off > 1e-6 THEN 'gap' ELSE 'overlap' END AS rule FROM s WHERE abs(off) > 1e-6")
_RULES = "WITH s AS (SELECT *, t - lag(t) OVER (PARTITION BY track_id ORDER BY t, id) AS gap FROM onsets) SELECT track_id, id, 'time' AS rule FROM s WHERE t < 0 UNION ALL SELECT track_id, id, 'strength' FROM s WHERE strength NOT BETWEEN 0 AND 1 UNION ALL SELECT track_id, id, 'bands' FROM s WHERE NOT (low BETWEEN 0 AND 1 AND mid BETWEEN 0 AND 1 AND high BETWEEN 0 AND 1) UNION ALL SELECT track_id, id, 'spacing' FROM s WHERE gap <= 0.1"
_add("v1_onset_rules", lambda s, d: metrics.onset_rules(t.onsets(s, d), 0.1), _RULES)
_add("v7_coverage", lambda s, d: metrics.coverage_rules(t.onsets(s, d), _kind(s, d, "click").unionByName(_kind(s, d, "view")).withColumn("relevance", F.col("strength") * 1.25)), "SELECT track_id, id, CASE WHEN kind IN ('click', 'view') THEN 'range' ELSE 'missing' END AS rule FROM onsets WHERE kind NOT IN ('click', 'view') OR strength * 1.25 > 1 OR strength * 1.25 < 0")
_add("r7_rank_ids", lambda s, d: metrics.rank_ids(_scored(s, d)).select("track_id", "id", "rank"), "SELECT track_id, id, row_number() OVER (PARTITION BY track_id ORDER BY mid DESC, id)::INT AS rank FROM onsets")
_add("r9_band_budget", lambda s, d: metrics.select_band_budget(_scored(s, d), "low", 5).select("track_id", "id", "rank"), "WITH r AS (SELECT * FROM onsets QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY mid DESC, id) <= 20) SELECT track_id, id, row_number() OVER (PARTITION BY track_id ORDER BY low DESC, mid DESC, t, id)::INT AS rank FROM r QUALIFY rank <= 5")
_add("r12_pair_accuracy", lambda s, d: _r(metrics.pair_accuracy(evidence.preference_pairs(t.onsets(s, d), 0.3, 0.34), t.onsets(s, d).withColumn("relevance", F.col("low"))), "accuracy"), "SELECT a.track_id, round(avg(CASE WHEN a.low > b.low THEN 1.0::DOUBLE WHEN a.low = b.low THEN 0.5 ELSE 0 END), 6) AS accuracy FROM onsets a JOIN onsets b ON a.track_id = b.track_id AND abs(a.t - b.t) <= 0.3 WHERE a.strength - b.strength >= 0.34 GROUP BY ALL")
_add("r14_recall_at_k", lambda s, d: _r(metrics.recall_at_k(_scored(s, d), F.col("low") >= 0.7), "recall"), "WITH r AS (SELECT track_id, low, count(*) FILTER (low >= 0.7) OVER (PARTITION BY track_id) AS k, row_number() OVER (PARTITION BY track_id ORDER BY mid DESC, id) AS r FROM onsets) SELECT track_id, k, round(count(*) FILTER (low >= 0.7 AND r <= k) / k, 6) AS recall FROM r WHERE k > 0 GROUP BY track_id, k")
_add("c5_clusters", lambda s, d: metrics.clusters(t.onsets(s, d), 0.1), _SESSIONS.format(gap=0.1).replace("AS session", "AS cluster") + " SELECT track_id, cluster, min(t) AS t0, count(*) AS n FROM b GROUP BY track_id, cluster")
_add("c19_density_tertiles", lambda s, d: metrics.density_tertiles(t.onsets(s, d)), "WITH q AS (SELECT track_id, round(count(*) / greatest(max(t), 1e-9), 9) AS density FROM onsets GROUP BY ALL), p AS (SELECT track_id, row_number() OVER (ORDER BY density, track_id) AS r, count(*) OVER () AS n FROM q) SELECT track_id, CASE WHEN r <= greatest(1, n // 3) THEN 'low' WHEN r > n - greatest(1, n // 3) THEN 'high' ELSE 'middle' END AS tertile FROM p")
_add("o1_default_plan", lambda s, d: timeline.default_plan(t.segments(s, d)), "SELECT track_id, t0 AS t, row_number() OVER (PARTITION BY track_id ORDER BY t0)::INT - 1 AS place FROM (SELECT DISTINCT track_id, t0 FROM segments) QUALIFY place > 0")
_add("o2_resolve_plan", lambda s, d: _r(timeline.resolve_plan(t.onsets(s, d), _edits(s, d)), "t", "source_t"), "SELECT track_id, id, round(t + CASE WHEN kind = 'click' AND strength > 0.5 THEN 0.25 ELSE 0 END, 6) AS t, round(t, 6) AS source_t, strength FROM onsets WHERE kind <> 'purchase' UNION ALL SELECT track_id, -id - 1, round(t, 6), NULL, 1.0 FROM onsets WHERE kind = 'view' AND strength > 0.5")
_add("o3_visit_history", lambda s, d: _r(timeline.visit_history(t.onsets(s, d)), "seen_before").select("track_id", "id", "visit", "seen_before"), "WITH s AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY track_id ORDER BY t, id) - t, 0) AS shows FROM onsets) SELECT track_id, id, row_number() OVER w AS visit, round(coalesce(sum(shows) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS seen_before FROM s WINDOW w AS (PARTITION BY track_id, kind ORDER BY t, id)")
_add("o5_subframe_visits", lambda s, d: timeline.subframe_visits(t.onsets(s, d), 2.0).select("track_id", "id"), "SELECT track_id, id FROM onsets QUALIFY ceil(lead(t) OVER (PARTITION BY track_id ORDER BY t, id) * 2) <= ceil(t * 2)")


def _stream(s: SparkSession, d: str, width: str, slide: str | None) -> DataFrame:
    got = activity.drained(activity.activity(activity.source(s, f"{d}/events.parquet"), width, slide), "complete")
    return got.withColumn("start", F.unix_seconds("start"))


_add("st1_activity", lambda s, d: _stream(s, d, "1 day", None), "SELECT event_type AS track_id, epoch_us(ts) // 86400000000 * 86400 AS start, count(*) AS n FROM events GROUP BY ALL")
_add("st2_density", lambda s, d: _stream(s, d, "2 hours", "1 hour"), "SELECT event_type AS track_id, epoch_us(ts) // 3600000000 * 3600 - back * 3600 AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS back) GROUP BY ALL")


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return structure.bar_vectors(t.onsets(s, d), t.beats(s, d))


_BARS = "WITH v0 AS (SELECT track_id, floor(t / 2)::BIGINT + 1 AS bar, floor((t / 2 - floor(t / 2)) * 4)::BIGINT AS step, max(strength) AS x FROM onsets GROUP BY ALL), v AS (SELECT track_id, bar, step, x / sqrt(sum(x * x) OVER (PARTITION BY track_id, bar)) AS x FROM v0 QUALIFY sqrt(sum(x * x) OVER (PARTITION BY track_id, bar)) > 1e-9)"
_PAIRS = _BARS + ", c AS (SELECT p.track_id, p.bar AS a, q.bar AS b, least(1, sum(p.x * q.x)) AS cosine FROM v p JOIN v q ON p.track_id = q.track_id AND p.step = q.step AND q.bar > p.bar AND q.bar <= p.bar + 7 GROUP BY ALL), n AS (SELECT track_id, max(bar) AS n FROM beats GROUP BY ALL), k AS (SELECT track_id, unnest(generate_series(4, n - 4)) AS cut FROM n), s AS (SELECT k.track_id, cut, (4 + coalesce(sum(CASE WHEN a <= cut AND b > cut THEN -cosine ELSE cosine END), 0)) / 16 AS novelty FROM k LEFT JOIN c ON c.track_id = k.track_id AND a > cut - 4 AND b <= cut + 4 GROUP BY ALL)"
_add("s6_bar_vectors", lambda s, d: _r(_vectors(s, d), "x"), _BARS + " SELECT track_id, bar, step, round(x, 6) AS x FROM v")
_add("s7_similar_bars", lambda s, d: _r(structure.similar_bars(_vectors(s, d), 7), "cosine"), _PAIRS + " SELECT track_id, a, b, round(cosine, 6) AS cosine FROM c")
_add("s9_novelty", lambda s, d: _r(structure.novelty(_vectors(s, d), t.beats(s, d)), "novelty"), _PAIRS + " SELECT track_id, cut, round(novelty, 6) AS novelty FROM s")
_add(
    "s10_minmax",
    lambda s, d: _r(structure.minmax(structure.novelty(_vectors(s, d), t.beats(s, d)), "novelty"), "novelty"),
    _PAIRS + " SELECT track_id, cut, round(CASE WHEN max(novelty) OVER w - min(novelty) OVER w > 1e-9 THEN (novelty - min(novelty) OVER w) / (max(novelty) OVER w - min(novelty) OVER w) ELSE 0 END, 6) AS novelty FROM s WINDOW w AS (PARTITION BY track_id)",
)
_add("s21_bar_density", lambda s, d: structure.bar_density(t.onsets(s, d), t.beats(s, d)), "WITH o AS (SELECT track_id, floor(t / 2)::BIGINT + 1 AS bar, count(*) AS n FROM onsets GROUP BY ALL) SELECT b.track_id, b.bar, coalesce(n, 0) AS n FROM (SELECT DISTINCT track_id, bar FROM beats WHERE beat_in_bar = 1) b LEFT JOIN o ON o.track_id = b.track_id AND o.bar = b.bar")
_add("s22_fold_bars", lambda s, d: _r(structure.fold_bars(_vectors(s, d)), "x"), _BARS + ", l AS (SELECT *, max(bar) OVER (PARTITION BY track_id) AS last FROM v) SELECT track_id, (bar - 1) // 2 + 1 AS bar, step, round(sum(x) / max(CASE WHEN last % 2 = 1 AND bar = last THEN 1 ELSE 2 END), 6) AS x FROM l GROUP BY track_id, (bar - 1) // 2, step")
_add("src12_track_summary", lambda s, d: structure.track_summary(t.segments(s, d)), "WITH f AS (SELECT track_id, family, count(*) AS n, min(t0) AS t0 FROM segments GROUP BY ALL) SELECT track_id, sum(n)::BIGINT AS n, count(*) AS families, string_agg(family, '' ORDER BY t0, family) AS form FROM f GROUP BY ALL")
_add("t13_global_bpm", lambda s, d: _r(matching.global_bpm(t.onsets(s, d)), "bpm"), "WITH g AS (SELECT track_id, t - lag(t) OVER (PARTITION BY track_id ORDER BY t, id) AS gap FROM onsets), m AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY track_id) AS m FROM g WHERE gap > 0) SELECT track_id, round(60 * count(*) / sum(gap), 6) AS bpm, count(*) AS n FROM m WHERE abs(log2(gap / m)) <= log2(1.5) GROUP BY ALL")
_add("t16_grid_summary", lambda s, d: matching.grid_summary(t.beats(s, d)), "SELECT track_id, 0.0::DOUBLE AS origin, count(DISTINCT bar) AS bars, count(*) AS n FROM beats GROUP BY ALL")
_add("m13_false_in_silence", lambda s, d: matching.false_in_silence(t.onsets(s, d), _kind(s, d, "purchase").where("strength > 0.5"), _kind(s, d, "click")), "SELECT track_id, count(*) FILTER (kind = 'click') AS n FROM onsets GROUP BY ALL HAVING count(*) FILTER (kind = 'purchase' AND strength > 0.5) = 0")
_add(
    "c16_exclusion_report",
    lambda s, d: matching.exclusion_report(metrics.onset_rules(t.onsets(s, d), 0.1).join(t.onsets(s, d).select("track_id", "id", "kind"), ["track_id", "id"]), "rule", "kind"),
    _RULES.replace(" SELECT track_id, id, 'time'", ", x AS (SELECT track_id, id, 'time'", 1) + ") SELECT rule, kind, count(*) AS n FROM x JOIN onsets USING (track_id, id) GROUP BY ROLLUP (rule, kind)",
)
_add("m2_match_later", lambda s, d: _r(matching.match(_kind(s, d, "click"), _kind(s, d, "view"), 0.2, "later"), "distance"))
_add("m2b_match_earlier", lambda s, d: _r(matching.match(_kind(s, d, "click"), _kind(s, d, "view"), 0.2, "earlier"), "distance"))
_add("m3_match_by_distance", lambda s, d: _r(matching.match(_kind(s, d, "click"), _kind(s, d, "view"), 0.2), "distance"))
_add("n8_suppress_close", lambda s, d: matching.suppress_close(signal.peaks(t.frames(s, d), 3.0).select("track_id", F.col("frame").cast("double").alias("t"), "x"), 4.0))
_add("c1_collapse_simultaneous", lambda s, d: _r(matching.collapse_simultaneous(t.onsets(s, d), 0.1), "t"))

from chronoflux.plans import corpora, extract, forms, grids, learned, moments, records, scores, shapes  # noqa: E402, F401  (they register their own)
