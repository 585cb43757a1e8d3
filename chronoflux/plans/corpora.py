"""Queries of charts, labels, splits, edits and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronoflux.operators import corpora, grid
from chronoflux.plans.catalog import _add, _kind, _r
from chronoflux.sources import tables as t


def _charts(s: SparkSession, d: str) -> DataFrame:
    return t.onsets(s, d).where("id % 3 <> 0").select("track_id", F.col("kind").alias("chart"), "t")


_HASH = "mh AS (SELECT track_id, kind AS chart, count(*) AS n, sha256('[' || string_agg(printf('%.6f', t), ',' ORDER BY t) || ']') AS hash, count(DISTINCT t) AS u, max(t) - min(t) AS span FROM onsets WHERE id % 3 <> 0 GROUP BY ALL)"
_GROUPED = "gc AS (SELECT track_id, chart, CASE WHEN reason IS NULL AND kept >= 3 THEN row_number() OVER (PARTITION BY track_id, reason IS NULL AND kept >= 3 ORDER BY dn, chart) END::INT AS place, coalesce(reason, CASE WHEN kept < 3 THEN 'few_charts' END) AS reason FROM (SELECT *, count(*) FILTER (reason IS NULL) OVER (PARTITION BY track_id) AS kept FROM (SELECT *, CASE WHEN n < 2 OR span <= 0 THEN 'inf'::DOUBLE ELSE n / span END AS dn, CASE WHEN u < 2 THEN 'few_markers' WHEN row_number() OVER (PARTITION BY track_id, hash, u >= 2 ORDER BY chart) > 1 THEN 'duplicate' END AS reason FROM mh)))"
_add("c2_marker_hash", lambda s, d: corpora.marker_hash(_charts(s, d)).drop("ts"), f"WITH {_HASH} SELECT track_id, chart, n::INT AS n, hash FROM mh")
_add("c4_group_charts", lambda s, d: corpora.group_charts(_charts(s, d)), f"WITH {_HASH}, {_GROUPED} SELECT track_id, chart, place, reason FROM gc")
_MATCH = "ma AS (SELECT track_id, kind AS chart, (id % 41 - 20) / 1000.0::DOUBLE AS residual FROM onsets WHERE id % 3 <> 0 AND id % 4 <> 0)"


def _matches(s: SparkSession, d: str) -> DataFrame:
    return t.onsets(s, d).where("id % 3 <> 0 AND id % 4 <> 0").select("track_id", F.col("kind").alias("chart"), ((F.col("id") % 41 - 20) / 1000.0).alias("residual"))


_add("c6_song_offset", lambda s, d: _r(corpora.song_offset(_matches(s, d), corpora.marker_hash(_charts(s, d)).select("track_id", "chart", "n")), "mad", "shift"), f"WITH {_HASH}, {_MATCH}, o AS (SELECT track_id, chart, count(*) AS m, quantile_cont(residual, 0.5) AS r FROM ma GROUP BY ALL), g AS (SELECT track_id, r FROM mh JOIN o USING (track_id, chart) WHERE m >= 2 AND m / n >= 0.6), c AS (SELECT track_id, quantile_cont(r, 0.5) AS c, count(*) AS k FROM g GROUP BY ALL), x AS (SELECT track_id, any_value(c) AS c, any_value(k) AS k, quantile_cont(abs(r - c), 0.5) AS mad FROM g JOIN c USING (track_id) GROUP BY track_id), y AS (SELECT q.track_id, c, k, mad, coalesce(k >= 3 AND abs(c) <= 0.035 AND mad <= 0.01, false) AS ap FROM (SELECT DISTINCT track_id FROM mh) q LEFT JOIN x USING (track_id)) SELECT track_id, coalesce(k, 0) AS charts, round(CASE WHEN k >= 3 THEN mad END, 6) AS mad, ap AS applied, round(CASE WHEN ap THEN c ELSE 0 END, 6) AS shift FROM y")
_add("c7_alignment_verdict", lambda s, d: corpora.alignment_verdict(corpora.marker_hash(_charts(s, d)).select("track_id", "chart", "n", F.floor(F.col("n") * (F.col("track_id") % 5) / 4).alias("matched"), ((F.col("track_id") % 7) / 100).alias("p95"), F.element_at("ts", -1).alias("last"), F.lit(70.0).alias("duration"))).select("track_id", "chart", "reason"), "SELECT track_id, kind AS chart, CASE WHEN floor(count(*) * (track_id % 5) / 4) / count(*) < 0.6 THEN 'match_rate' WHEN track_id % 7 / 100 > 0.04 THEN 'residual' WHEN max(t) > 70.25 THEN 'drift' END AS reason FROM onsets WHERE id % 3 <> 0 GROUP BY track_id, kind")


def _hits(s: SparkSession, d: str) -> DataFrame:
    charts = F.array(*[F.lit(k) for k in ("click", "view", "purchase")])
    return t.onsets(s, d).select("track_id", "id", F.explode(F.slice(charts, F.lit(1), (F.col("id") % 4).cast("int"))).alias("chart"))


_HITS = "hi AS (SELECT track_id, id, unnest(['click', 'view', 'purchase'][1:id % 4]) AS chart FROM onsets)"


def _labels(s: SparkSession, d: str) -> DataFrame:
    charts = corpora.group_charts(_charts(s, d)).where("reason IS NULL").select("track_id", "chart", "place")
    return corpora.weak_labels(t.onsets(s, d), _hits(s, d), charts)


_LABELS = f"{_HASH}, {_GROUPED}, {_HITS}, nn AS (SELECT track_id, count(*) AS n FROM gc WHERE reason IS NULL GROUP BY ALL), su AS (SELECT track_id, id, count(*) AS support, count(*) FILTER (place <= n // 2) AS sparse FROM hi JOIN gc USING (track_id, chart) JOIN nn USING (track_id) WHERE reason IS NULL GROUP BY ALL), wl AS (SELECT o.track_id, o.id, coalesce(support, 0) AS support, coalesce(CASE WHEN n > 0 THEN round(coalesce(support, 0) / n, 6) END, 0) AS rate, coalesce(sparse, 0) AS sparse, coalesce(support, 0) - coalesce(sparse, 0) AS dense FROM onsets o LEFT JOIN su USING (track_id, id) LEFT JOIN nn ON nn.track_id = o.track_id)"
_add("c8_weak_labels", lambda s, d: _labels(s, d), f"WITH {_LABELS} SELECT track_id, id, support, rate, sparse, dense FROM wl")
_add("c9_capped_pairs", lambda s, d: corpora.capped_preference_pairs(_labels(s, d).join(t.onsets(s, d).select("track_id", "id", "t"), ["track_id", "id"])))


def _documents(s: SparkSession, d: str) -> DataFrame:
    return t.read(s, d, "documents").select("doc_id", "lang", "source", "n_chars")


def _frozen(s: SparkSession, d: str) -> DataFrame:
    return t.read(s, d, "labels").where("doc_id % 3 = 0").groupBy("doc_id").agg(F.when(F.max("quality") == 1, "train").otherwise("validation").alias("split"))


def _split_sql(strata: str, test: float, frozen: bool) -> str:
    part = "CASE WHEN p < tn THEN 'test' WHEN p < tn + vn THEN 'validation' ELSE 'train' END"
    return f"""dc AS (SELECT doc_id, {strata}, n_chars FROM documents), fz AS (SELECT doc_id, CASE WHEN max(quality) = 1 THEN 'train' ELSE 'validation' END AS split FROM labels WHERE doc_id % 3 = 0 GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER (PARTITION BY {strata}) AS n FROM dc), tl AS (SELECT *, CASE WHEN n < 6 THEN 0 ELSE least(2, r * 3 // n) END AS tile FROM rk), op AS (SELECT * FROM tl {'WHERE doc_id NOT IN (SELECT doc_id FROM fz)' if frozen else ''}), pl AS (SELECT *, row_number() OVER (PARTITION BY {strata}, tile ORDER BY sha256('salt' || doc_id)) - 1 AS p, count(*) OVER (PARTITION BY {strata}, tile) AS tt FROM op), vv AS (SELECT *, least(greatest(round_even(tt * {0.15 if test else 0.25}::DOUBLE, 0)::BIGINT, CASE WHEN tt >= 8 THEN 2 ELSE 1 END), tt - 1) AS vn FROM pl), ww AS (SELECT *, {f'least(greatest(round_even(tt * {test}::DOUBLE, 0)::BIGINT, CASE WHEN tt >= 8 THEN 2 ELSE 1 END), greatest(tt - vn, 1))' if test else '0'} AS tn FROM vv), sp AS (SELECT doc_id, {part} AS split FROM ww {'UNION ALL SELECT doc_id, split FROM fz SEMI JOIN dc USING (doc_id)' if frozen else ''})"""


_add("c10_stratified_split", lambda s, d: corpora.stratified_split(_documents(s, d), "doc_id", ["lang"], "n_chars", "salt", _frozen(s, d)), f"WITH {_split_sql('lang', 0.15, True)} SELECT doc_id, split FROM sp")
_add("c11_development_split", lambda s, d: corpora.stratified_split(_documents(s, d), "doc_id", ["lang", "source"], "n_chars", "salt", None, 0.0, 0.25), f"WITH {_split_sql('lang, source', 0, False)} SELECT doc_id, split FROM sp")
_add("c11_holdout_split", lambda s, d: corpora.holdout_split(corpora.stratified_split(_documents(s, d), "doc_id", ["lang"], "n_chars", "salt", _frozen(s, d)), _documents(s, d).where("doc_id % 11 = 0"), "doc_id"), f"WITH {_split_sql('lang', 0.15, True)} SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'test' WHEN split = 'test' THEN 'train' ELSE split END AS split FROM sp")
_add("c13_consumed", lambda s, d: corpora.consumed(_documents(s, d), t.read(s, d, "labels").where("toxic = 1"), "doc_id").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
_add("c14_license_gate", lambda s, d: corpora.license_gate(t.read(s, d, "part").select(F.col("p_brand").alias("source"), F.when(F.col("p_partkey") % 97 == 0, None).otherwise(F.substring("p_type", 1, 1)).alias("license"), F.when(F.col("p_size") > 45, "").otherwise("x").alias("note")), ["S", "M", "P", "E", "L"]), "SELECT p_brand AS source, count(*) AS n, CASE WHEN max(coalesce(l NOT IN ('S', 'M', 'P', 'E', 'L'), true)::INT) = 1 THEN 'unknown_license' WHEN count(DISTINCT l) > 1 THEN 'mixed' WHEN max((p_size > 45)::INT) = 1 THEN 'no_note' END AS reason FROM (SELECT *, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE left(p_type, 1) END AS l FROM part) GROUP BY p_brand")
_add("c18_manifest_split", lambda s, d: corpora.manifest_split(_documents(s, d), "lang", "doc_id"), "WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) AS turn FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY turn, lang) AS place FROM a) SELECT doc_id, place, CASE WHEN (place - 1) % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM b")
_add("c15_dataset", lambda s, d: corpora.dataset(t.onsets(s, d).select("track_id").distinct().where("track_id % 4 <> 0").withColumn("split", F.when(F.col("track_id") % 5 == 0, "test").otherwise("train")), _labels(s, d), _kind(s, d, "click").select("track_id", F.col("id").alias("better"), (F.col("id") + 1).alias("worse"), F.col("low").alias("margin"))).groupBy("kind", "split").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")), f"WITH {_LABELS}, so AS (SELECT DISTINCT track_id, CASE WHEN track_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM onsets WHERE track_id % 4 <> 0), al AS (SELECT 'song' AS kind, split, NULL::DOUBLE AS v FROM so UNION ALL SELECT 'event', split, rate FROM wl JOIN so USING (track_id) UNION ALL SELECT 'pair', split, low FROM onsets JOIN so USING (track_id) WHERE onsets.kind = 'click') SELECT kind, split, count(*) AS n, round(sum(v), 4) AS value FROM al GROUP BY ALL")
_add("c3_timed_fingerprint", lambda s, d: corpora.timed_fingerprint(t.onsets(s, d)), "WITH c AS (SELECT track_id, floor(t / 5)::BIGINT AS cell, count(*) AS n, max(t) AS e FROM onsets GROUP BY ALL), m AS (SELECT track_id, unnest(generate_series(0, max(cell))) AS cell FROM c GROUP BY track_id), g AS (SELECT track_id, max(e) AS e FROM c GROUP BY ALL) SELECT m.track_id, sha256(string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY m.cell) || ';' || floor(any_value(g.e) * 2)::BIGINT) AS fingerprint FROM m LEFT JOIN c ON c.track_id = m.track_id AND c.cell = m.cell JOIN g ON g.track_id = m.track_id GROUP BY m.track_id")


def _cuts(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("track_id").orderBy("t", "id")
    return t.onsets(s, d).select("track_id", "id", "kind", F.col("t").alias("t0"), F.coalesce(F.lead("t").over(w), F.lit(80.0)).alias("t1")).where("t1 > t0")


_CUTS = "cu AS (SELECT * FROM (SELECT track_id, id, kind, t AS t0, coalesce(lead(t) OVER (PARTITION BY track_id ORDER BY t, id), 80) AS t1 FROM onsets) WHERE t1 > t0)"
_BLOCKS = "bl AS (SELECT track_id, section AS w, t0 AS w0, t1 AS w1 FROM (SELECT track_id, c AS section, t0, coalesce(lead(t0) OVER (PARTITION BY track_id ORDER BY t0), e) AS t1 FROM (SELECT track_id, (bar - 1) // 2 AS c, min(t) AS t0, max(t) AS e FROM pulses GROUP BY ALL)))"


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return grid.timeline_sections(t.pulses(s, d), 2).select("track_id", F.col("section").alias("w"), F.col("t0").alias("w0"), F.col("t1").alias("w1"))


_add("o4_block_switches", lambda s, d: _r(corpora.block_switches(_cuts(s, d), _blocks(s, d), 8.0), "longest"), f"WITH {_CUTS}, {_BLOCKS}, x AS (SELECT b.track_id, w, least(t1, w1) - greatest(t0, w0) AS stay, coalesce((kind <> lag(kind) OVER (PARTITION BY b.track_id, w ORDER BY t0, id))::INT, 0) AS ch FROM bl b JOIN cu ON cu.track_id = b.track_id AND t0 < w1 AND t1 > w0) SELECT track_id, w, count(*) AS visits, sum(ch)::BIGINT AS switches, round(max(stay), 6) AS longest FROM x GROUP BY ALL")
_add("o6_sync_offsets", lambda s, d: corpora.sync_offsets(_kind(s, d, "view").select("track_id", "id", (F.col("id") % 97).alias("cue"), "t"), _kind(s, d, "view").groupBy("track_id", (F.col("id") % 97).alias("cue")).agg(F.min("t").alias("cue_t")).where("cue % 5 <> 0"), _kind(s, d, "click"), 0.3), "WITH v AS (SELECT track_id, id, id % 97 AS cue, t FROM onsets WHERE kind = 'view'), c AS (SELECT track_id, cue, min(t) AS ct FROM v WHERE cue % 5 <> 0 GROUP BY ALL), k AS (SELECT track_id, t FROM onsets WHERE kind = 'click') SELECT v.track_id, v.id, CASE WHEN ct IS NULL THEN 'missing' WHEN abs(v.t - ct) < 1e-9 THEN 'matched' ELSE 'shifted' END AS binding, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.track_id = v.track_id AND abs(k.t - v.t) <= 0.3) THEN 'seen' ELSE 'unverified' END AS observed FROM v LEFT JOIN c ON c.track_id = v.track_id AND c.cue = v.cue")
_add("o7_explain_cuts", lambda s, d: corpora.explain_cuts(_kind(s, d, "view").select("track_id", "id", (F.col("t") - 0.05).alias("t")), _cuts(s, d), grid.timeline_sections(t.pulses(s, d), 2)), f"WITH {_CUTS}, {_BLOCKS}, p AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t0, id) AS place, count(*) OVER (PARTITION BY track_id) AS n FROM cu), v AS (SELECT track_id, id, t - 0.05::DOUBLE AS t FROM onsets WHERE kind = 'view'), x AS (SELECT v.*, CASE WHEN v.t < p.t1 THEN p.id END AS cut, CASE WHEN v.t < p.t1 THEN p.kind END AS kind, CASE WHEN v.t < p.t1 THEN place END AS place, CASE WHEN v.t < p.t1 THEN n END AS n FROM v ASOF LEFT JOIN p ON v.track_id = p.track_id AND v.t >= p.t0) SELECT x.track_id, x.id, cut, kind, CASE WHEN x.t < w1 THEN w END AS section, place::INT AS place, (CASE WHEN place IS NOT NULL THEN greatest(place - 2, 1) END)::INT AS first, (CASE WHEN place IS NOT NULL THEN least(place + 2, n) END)::INT AS last FROM x ASOF LEFT JOIN bl ON x.track_id = bl.track_id AND x.t >= w0")

# rules
_SEGR = "sr AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t0, id) AS n, id FROM segments), sg AS (SELECT track_id, n, n * 4 - 3 + CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS start_bar, n * 4 - CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END AS end_bar FROM sr), bs AS (SELECT track_id, max(n) * 4 + track_id % 2 AS bars FROM sr GROUP BY track_id)"


def _rule_segments(s: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("track_id").orderBy("t0", "id")).cast("long")
    rows = t.segments(s, d).select("track_id", "id", n.alias("n"))
    return rows.select("track_id", "n", (F.col("n") * 4 - 3 + (F.col("id") % 17 == 0).cast("int")).alias("start_bar"), (F.col("n") * 4 - (F.col("id") % 13 == 0).cast("int")).alias("end_bar"))


def _rule_bars(s: SparkSession, d: str) -> DataFrame:
    return _rule_segments(s, d).groupBy("track_id").agg(F.max("n").alias("n")).select("track_id", (F.col("n") * 4 + F.col("track_id") % 2).alias("bars"))


_UN = "SELECT track_id, rule, detail FROM ({}) WHERE rule IS NOT NULL"
_add("v2_segment_rules", lambda s, d: corpora.segment_rules(_rule_segments(s, d), _rule_bars(s, d)), f"WITH {_SEGR}, x AS (SELECT *, lag(end_bar) OVER w AS p, lead(n) OVER w AS more FROM sg JOIN bs USING (track_id) WINDOW w AS (PARTITION BY track_id ORDER BY n)) " + _UN.format("SELECT track_id, n::VARCHAR AS detail, unnest([CASE WHEN p IS NULL AND start_bar <> 1 THEN 'first_bar' END, CASE WHEN start_bar > p + 1 THEN 'gap' END, CASE WHEN start_bar <= p THEN 'overlap' END, CASE WHEN end_bar < start_bar THEN 'empty' END, CASE WHEN more IS NULL AND end_bar <> bars THEN 'last_bar' END]) AS rule FROM x"))
_BO = "bo AS (SELECT track_id, n * 4 - 3 AS bar, (n * 31 % 120) / 100.0::DOUBLE AS nv FROM sr WHERE n > 1 AND id % 7 <> 0 UNION ALL SELECT track_id, n * 4 - 3, 0.5 FROM sr WHERE id % 19 = 0 AND n > 1)"


def _boundaries(s: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("track_id").orderBy("t0", "id")).cast("long")
    rows = t.segments(s, d).select("track_id", "id", n.alias("n")).where("n > 1").withColumn("bar", F.col("n") * 4 - 3)
    return rows.where("id % 7 <> 0").select("track_id", "bar", (F.col("n") * 31 % 120 / 100.0).alias("novelty")).unionByName(rows.where("id % 19 = 0").select("track_id", "bar", F.lit(0.5).alias("novelty")))


_add("v3_boundary_rules", lambda s, d: corpora.boundary_rules(_rule_segments(s, d), _boundaries(s, d)), f"WITH {_SEGR}, {_BO}, st AS (SELECT track_id, start_bar AS bar, true AS st FROM sg WHERE n > 1), co AS (SELECT track_id, bar, count(*) AS k, max(nv) AS nv FROM bo GROUP BY ALL), x AS (SELECT track_id, bar, st, k, nv FROM st FULL JOIN co USING (track_id, bar)) " + _UN.format("SELECT track_id, bar::VARCHAR AS detail, unnest([CASE WHEN k IS NULL THEN 'no_boundary' END, CASE WHEN st IS NULL THEN 'no_segment' END, CASE WHEN k > 1 THEN 'duplicated' END, CASE WHEN nv NOT BETWEEN 0 AND 1 THEN 'novelty' END]) AS rule FROM x"))
_add("v4_repetition_rules", lambda s, d: corpora.repetition_rules(_rule_segments(s, d).groupBy("track_id", (F.col("n") % 4).alias("r")).agg(F.sort_array(F.collect_list(F.col("n") + (F.col("n") % 9 == 0).cast("int"))).alias("ids")).withColumn("family", F.concat(F.lit("F"), F.col("r").cast("string"))), _rule_segments(s, d).select("track_id", "n", F.concat(F.lit("F"), (F.col("n") % 4).cast("string")).alias("family"))), f"WITH {_SEGR}, r AS (SELECT track_id, n % 4 AS r, list(n + CASE WHEN n % 9 = 0 THEN 1 ELSE 0 END) AS ids FROM sg GROUP BY ALL), o AS (SELECT track_id, r, unnest(ids) AS n FROM r), x AS (SELECT o.track_id, o.r, o.n, CASE WHEN sg.n IS NOT NULL THEN 'F' || sg.n % 4 END AS f, 'F' || o.r AS own, count(*) OVER (PARTITION BY o.track_id, o.n) AS k FROM o LEFT JOIN sg ON sg.track_id = o.track_id AND sg.n = o.n) " + _UN.format("SELECT track_id, r::VARCHAR AS detail, CASE WHEN len(ids) < 2 THEN 'few' END AS rule FROM r UNION ALL SELECT track_id, r || '/' || n AS detail, unnest([CASE WHEN f IS NULL THEN 'unknown' END, CASE WHEN f <> own THEN 'family' END, CASE WHEN k > 1 THEN 'claimed' END]) FROM x"))


def _json(s: SparkSession, d: str) -> DataFrame:
    """Texts with a wanted key in a list, one only inside a string, and the event's own object."""
    text = F.concat(F.lit('{"a": [{"'), F.when(F.col("event_type") == "error", "confidence").otherwise("x"), F.lit('" : 1}, {"vocal": {"b": "\\"instrument\\": 1"}}], "props": '), "props", F.lit("}"))
    return t.read(s, d, "events").select(F.col("event_id").alias("track_id"), text.alias("j"))


_add("v5_forbidden_keys", lambda s, d: corpora.forbidden_keys(_json(s, d), "j", ["confidence", "instrument", "k"]), "SELECT event_id AS track_id, 'forbidden' AS rule, 'k' AS detail FROM events UNION ALL SELECT event_id, 'forbidden', 'confidence' FROM events WHERE event_type = 'error'")
_add("v6_evidence_rules", lambda s, d: corpora.evidence_rules(t.onsets(s, d).where("id % 10 <> 0").select("track_id", "id").unionByName(t.onsets(s, d).where("id % 15 = 0").select("track_id", (F.col("id") + 3).alias("id"))), t.onsets(s, d)), "WITH e AS (SELECT track_id, id FROM onsets WHERE id % 10 <> 0 UNION ALL SELECT track_id, id + 3 FROM onsets WHERE id % 15 = 0), c AS (SELECT track_id, id, count(*) AS k FROM e GROUP BY ALL), x AS (SELECT track_id, id, k, o.known FROM (SELECT track_id, id, true AS known FROM onsets) o FULL JOIN c USING (track_id, id)) " + _UN.format("SELECT track_id, id::VARCHAR AS detail, unnest([CASE WHEN k IS NULL THEN 'missing' END, CASE WHEN known IS NULL THEN 'unknown' END, CASE WHEN k > 1 THEN 'repeated' END]) AS rule FROM x"))
_add("v8_edit_plan_rules", lambda s, d: corpora.edit_plan_rules(t.pulses(s, d).select("track_id", F.col("idx").alias("place"), F.when(F.col("idx") % 9 == 8, F.lit(1.0)).otherwise(F.col("t")).alias("t")), t.onsets(s, d).select("track_id", "id", (F.col("t") - 1).alias("t"), (F.col("id") % 23 != 0).alias("known")), t.onsets(s, d).groupBy("track_id").agg((F.max("t") - 2).alias("duration"))), "WITH du AS (SELECT track_id, max(t) - 2 AS d FROM onsets GROUP BY ALL), b AS (SELECT track_id, idx, CASE WHEN idx % 9 = 8 THEN 1.0::DOUBLE ELSE t END AS t FROM pulses), x AS (SELECT b.*, d, coalesce(lag(t) OVER (PARTITION BY track_id ORDER BY idx), 0) AS p FROM b JOIN du USING (track_id)) " + _UN.format("SELECT track_id, idx::VARCHAR AS detail, CASE WHEN NOT (p < t AND t < d) THEN 'boundary-order' END AS rule FROM x UNION ALL SELECT track_id, id::VARCHAR, unnest([CASE WHEN NOT (t - 1 >= 0 AND t - 1 < d) THEN 'cue-time' END, CASE WHEN id % 23 = 0 THEN 'unknown-onset' END]) FROM onsets JOIN du USING (track_id)"))
_add("v9_product_rules", lambda s, d: corpora.product_rules(t.segments(s, d).select("track_id", "bpm", (F.col("id") % 14).alias("numerator"), (F.col("id") % 30).alias("bars"), (F.col("id") % 100).alias("beats"), F.when(F.col("id") % 2 == 0, "slow").otherwise("medium").alias("label"))).groupBy("rule").agg(F.count("*").alias("n")), "SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN id % 14 NOT BETWEEN 1 AND 12 THEN 'meter' END, CASE WHEN abs(id % 30 - ceil((id % 100) / greatest(id % 14, 1))) > 1 THEN 'bars' END, CASE WHEN CASE WHEN id % 2 = 0 THEN 'slow' ELSE 'medium' END <> CASE WHEN bpm < 90 THEN 'slow' WHEN bpm < 140 THEN 'medium' ELSE 'fast' END THEN 'tempo-label' END]) AS rule FROM segments) WHERE rule IS NOT NULL GROUP BY rule")
_add("v10_model_rules", lambda s, d: corpora.model_rules(t.read(s, d, "part").select((F.col("p_partkey") % 5).alias("track_id"), (F.col("p_partkey") % 80 * (F.col("p_partkey") % 5 + 1)).alias("tree"), (F.col("p_size") % 4).alias("depth"), F.when(F.col("p_size") % 2 == 0, "low").when(F.col("p_size") % 9 == 1, "odd").alias("feature"), F.when(F.col("p_size") % 2 == 0, F.when(F.col("p_size") == 20, float("nan")).otherwise(0.5)).alias("threshold"), F.when(F.col("p_size") % 3 == 1, 1.0).alias("value")), ["low"]), "WITH n AS (SELECT p_partkey % 5 AS track_id, p_partkey % 80 * (p_partkey % 5 + 1) AS tree, p_size % 4 AS depth, CASE WHEN p_size % 2 = 0 THEN 'low' WHEN p_size % 9 = 1 THEN 'odd' END AS feature, p_size FROM part) " + _UN.format("SELECT track_id, tree || '/' || depth AS detail, unnest([CASE WHEN p_size = 20 THEN 'not_finite' END, CASE WHEN feature <> 'low' THEN 'feature' END, CASE WHEN depth > 2 THEN 'too_deep' END, CASE WHEN p_size % 2 <> 0 AND p_size % 3 <> 1 THEN 'no_figure' END]) AS rule FROM n UNION ALL SELECT track_id, count(DISTINCT tree)::VARCHAR, CASE WHEN count(DISTINCT tree) > 72 THEN 'too_many' END FROM n GROUP BY track_id"))
_add("v11_coverage_rules", lambda s, d: corpora.coverage_rules(_blocks(s, d).select("track_id", F.col("w").alias("id"), (F.col("w0") + F.when(F.col("w") % 3 == 1, 0.1).when(F.col("w") % 5 == 2, -0.1).otherwise(0.0)).alias("t0"), F.col("w1").alias("t1"), (F.col("w0") + F.when(F.col("w") % 2 == 0, 0.0).otherwise(0.013)).alias("trigger")), _blocks(s, d).groupBy("track_id").agg(F.min("w0").alias("w0"), (F.max("w1") + F.when(F.col("track_id") % 2 == 0, 0.5).otherwise(0.0)).alias("w1")), t.pulses(s, d)), f"WITH {_BLOCKS}, wi AS (SELECT track_id, min(w0) AS a, max(w1) + CASE WHEN track_id % 2 = 0 THEN 0.5 ELSE 0 END AS b FROM bl GROUP BY track_id), iv AS (SELECT track_id, w AS id, w0 + CASE WHEN w % 3 = 1 THEN 0.1 WHEN w % 5 = 2 THEN -0.1 ELSE 0 END AS t0, w1 AS t1, w0 + CASE WHEN w % 2 = 0 THEN 0 ELSE 0.013 END AS tr FROM bl), x AS (SELECT iv.*, a, b, lag(t1) OVER w AS p, lead(id) OVER w IS NULL AS la, (SELECT min(abs(pulses.t - tr)) FROM pulses WHERE pulses.track_id = iv.track_id) AS off FROM iv JOIN wi USING (track_id) WINDOW w AS (PARTITION BY track_id ORDER BY t0, id)) " + _UN.format("SELECT track_id, id::VARCHAR AS detail, unnest([CASE WHEN t0 > coalesce(p, a) + 1e-6 THEN 'gap' END, CASE WHEN t0 < coalesce(p, a) - 1e-6 THEN 'overlap' END, CASE WHEN la AND abs(t1 - b) > 1e-6 THEN 'short' END, CASE WHEN off IS NULL OR off > 1e-6 THEN 'trigger' END]) AS rule FROM x"))
