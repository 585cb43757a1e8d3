"""Queries of documents, catalogues and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoflux.functions.columns import fixed
from chronoflux.plans.catalog import _add, _kind, _r
from chronoflux.sources import projects
from chronoflux.sources import tables as t


def _projects(s: SparkSession, d: str) -> DataFrame:
    """A document a track, of every second track in an old version."""
    p, o = t.pulses(s, d), t.onsets(s, d)
    beats = p.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("t", (F.col("bar") - (F.col("idx") == 0).cast("int")).alias("bar"), F.col("beat_in_bar").alias("beat"), F.lit(0.5).alias("confidence")))).alias("beats"))
    onsets = o.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("id", "t", "strength", (F.col("strength") > 0.9).alias("accent")))).alias("onsets"))
    cues = o.where("id % 4 = 0").groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("id") % 8 == 0, "accent").otherwise("mark").alias("type"), F.col("id").alias("onset_id"), "t"))).alias("cues"))
    none = F.array().cast("array<struct<t0:double,t1:double,family:string>>")
    rows = onsets.join(beats, "track_id").join(cues, "track_id")
    return rows.select(F.when(F.col("track_id") % 2 == 0, "3.1").otherwise("4.0").alias("schema_version"), "track_id", F.concat(F.lit("track "), F.col("track_id").cast("string")).alias("name"), F.lit("2024-01-01").alias("created_at"), F.lit(80.0).alias("duration"), "beats", "onsets", "cues", none.alias("segments"))


_add("src2_explode_project", lambda s, d: projects.explode_project(_projects(s, d))["onsets"].select("track_id", F.col("place").cast("long").alias("place"), "id"), "WITH k AS (SELECT track_id FROM pulses INTERSECT SELECT track_id FROM onsets WHERE id % 4 = 0) SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY id) - 1 AS place, id FROM onsets SEMI JOIN k USING (track_id)")
_add("src3_assemble_project", lambda s, d: _whole(s, d), "WITH k AS (SELECT track_id FROM pulses INTERSECT SELECT track_id FROM onsets WHERE id % 4 = 0) SELECT track_id, (SELECT count(*) FROM pulses p WHERE p.track_id = k.track_id)::INT AS beats, (SELECT count(*) FROM onsets o WHERE o.track_id = k.track_id)::INT AS onsets, (SELECT string_agg(id::VARCHAR, ',' ORDER BY id % 8, id) FROM onsets o WHERE o.track_id = k.track_id AND id % 4 = 0) AS cues FROM k")


def _whole(s: SparkSession, d: str) -> DataFrame:
    rows = _projects(s, d)
    back = projects.assemble_project(rows.select("track_id"), projects.explode_project(rows))
    return back.select("track_id", F.size("beats").alias("beats"), F.size("onsets").alias("onsets"), F.array_join(F.transform("cues", lambda c: c["onset_id"].cast("string")), ",").alias("cues"))


_add("src4_migrate", lambda s, d: projects.migrate(_projects(s, d)).select("track_id", "schema_version", "merged", F.size(F.filter("cues", lambda c: c["type"] == "accent")).alias("accents"), F.element_at("beats", 1)["bar"].alias("first_bar")), "WITH k AS (SELECT track_id FROM pulses INTERSECT SELECT track_id FROM onsets WHERE id % 4 = 0) SELECT track_id, '4.0' AS schema_version, 1::INT AS merged, (SELECT count(*) FROM onsets o WHERE o.track_id = k.track_id AND (id % 8 = 0 OR track_id % 2 = 0 AND strength > 0.9))::INT AS accents, 1::BIGINT AS first_bar FROM k")


def _lines(s: SparkSession, d: str) -> DataFrame:
    rows = _kind(s, d, "click").select(F.col("track_id").alias("file"), F.col("id").alias("n"), "t", "id")
    text = F.when(F.col("id") % 50 == 0, "# note").when((F.col("file") % 9 == 0) & (F.col("id") % 5 == 0), "oops").otherwise(F.concat_ws(" ", fixed(F.col("t"), 4), (F.col("id") % 4 + 1).cast("string")))
    return rows.select("file", "n", text.alias("line"), "t")


def _ordered_lines(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("file").orderBy("t", "n")).cast("long")
    return _lines(s, d).withColumn("n", n).drop("t")


_LINES = "li AS (SELECT track_id AS file, row_number() OVER (PARTITION BY track_id ORDER BY t, id) AS n, CASE WHEN id % 50 = 0 THEN NULL ELSE id % 4 + 1 END AS beat, id % 50 = 0 AS note, id % 50 <> 0 AND track_id % 9 = 0 AND id % 5 = 0 AS bad, printf('%.4f', t)::DOUBLE AS t FROM onsets WHERE kind = 'click'), lv AS (SELECT *, lag(CASE WHEN bad THEN NULL ELSE t END) OVER (PARTITION BY file ORDER BY n) AS p FROM li WHERE NOT note), rj AS (SELECT file, min(n) AS n, CASE WHEN arg_min(bad, n) THEN 'bad_row' ELSE 'not_rising' END AS reason FROM lv WHERE bad OR t <= p GROUP BY ALL), fw AS (SELECT file, 0::BIGINT AS n, 'few_rows' AS reason FROM li GROUP BY file HAVING count(*) FILTER (NOT note) < 2), al AS (SELECT * FROM rj UNION ALL SELECT * FROM fw WHERE file NOT IN (SELECT file FROM rj))"
_add("src5_beat_annotations", lambda s, d: projects.beat_annotations(_ordered_lines(s, d))[0], f"WITH {_LINES} SELECT file, t, beat::INT AS beat FROM lv WHERE file NOT IN (SELECT file FROM al)")
_add("src5_rejected_annotations", lambda s, d: projects.beat_annotations(_ordered_lines(s, d))[1], f"WITH {_LINES} SELECT file, n, reason FROM al")
_add(
    "src9_beat_to_seconds",
    lambda s, d: _r(projects.beat_to_seconds(t.onsets(s, d).select("track_id", "id", F.floor(F.col("t")).alias("beat")), t.pulses(s, d).where("idx % 4 = 0").select("track_id", F.floor("t").alias("beat")).unionByName(t.onsets(s, d).select("track_id", F.lit(0).cast("long").alias("beat"))).distinct().withColumn("bpm", 60.0 + F.col("beat") % 7 * 10), t.marks(s, d).where("idx % 5 = 0").select("track_id", F.floor("t").alias("beat"), F.lit(0.25).alias("length"), (F.col("idx") % 2 == 0).alias("before"))), "seconds").select("track_id", "id", "seconds"),
    "WITH q AS (SELECT track_id, id, floor(t)::BIGINT AS b FROM onsets), te AS (SELECT DISTINCT track_id, b, 60.0 + b % 7 * 10 AS bpm FROM (SELECT track_id, floor(t)::BIGINT AS b FROM pulses WHERE idx % 4 = 0 UNION ALL SELECT track_id, 0 FROM onsets)), ts AS (SELECT *, coalesce(sum(st) OVER (PARTITION BY track_id ORDER BY b), 0) AS dn FROM (SELECT *, (b - lag(b) OVER w) * 60 / lag(bpm) OVER w AS st FROM te WINDOW w AS (PARTITION BY track_id ORDER BY b))), sp AS (SELECT track_id, floor(t)::BIGINT AS b, idx % 2 = 0 AS early FROM marks WHERE idx % 5 = 0) SELECT q.track_id, q.id, round(dn + (q.b - ts.b) * 60 / bpm + 0.25 * (SELECT count(*) FROM sp WHERE sp.track_id = q.track_id AND (sp.b < q.b OR sp.b = q.b AND early)), 6) AS seconds FROM q ASOF JOIN ts ON q.track_id = ts.track_id AND q.b >= ts.b",
)
_add("src10_match_catalog", lambda s, d: projects.match_catalog(t.read(s, d, "part").select(F.concat(F.lit("/a/b."), (F.col("p_partkey") % 1800).cast("string"), F.lit(".wav")).alias("path"), F.regexp_replace("p_type", " ", "-").alias("genre")), t.read(s, d, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("/x/b."), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("path"))).select("stem", "genre", "state"), "WITH a AS (SELECT 'b.' || p_partkey % 1800 AS stem, count(*) AS a, min(regexp_extract(replace(p_type, ' ', '-'), '^[^-]*')) AS genre FROM part GROUP BY ALL), b AS (SELECT 'b.' || p_partkey AS stem, count(*) AS b FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL) SELECT stem, genre, CASE WHEN a > 1 OR b > 1 THEN 'duplicate' WHEN b IS NULL THEN 'no_annotation' WHEN a IS NULL THEN 'no_audio' ELSE 'matched' END AS state FROM a FULL JOIN b USING (stem)")
_add("src11_list_catalog", lambda s, d: projects.list_catalog(t.read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("backend"), F.col("p_size").alias("created_at")), "a", None, 20, 15), "WITH f AS (SELECT p_partkey AS id, p_name AS name, p_size FROM part WHERE contains(lower(p_name), 'a') OR contains(p_partkey::VARCHAR, 'a')), c AS (SELECT count(*) AS total FROM f) SELECT id, name, total, total > 35 AS has_more, (CASE WHEN total > 35 THEN 35 END)::INT AS next_offset FROM (SELECT * FROM f ORDER BY p_size DESC, id LIMIT 20 OFFSET 15), c")
_add("src13_active_variants", lambda s, d: projects.active_variants(t.read(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority").withColumn("key", projects.content_key(None, "o_custkey", "o_orderpriority")), ["key"], "o_orderdate", "o_orderkey").select("key", "o_orderkey"), "SELECT sha256(o_custkey || ':' || o_orderpriority) AS key, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
_add("src14_onset_csv", lambda s, d: projects.onset_csv(t.onsets(s, d), t.onsets(s, d).where("strength > 0.9")), "SELECT track_id, id, concat_ws(',', id, printf('%.4f', t), printf('%.4f', strength), printf('%.4f', low), printf('%.4f', mid), printf('%.4f', high), (strength > 0.9)::INT) AS line FROM onsets")
_add("src15_canonical_hash", lambda s, d: projects.canonical_hash(t.onsets(s, d).select("track_id", "id", "kind", "low"), ["track_id", "id", "kind", "low"]), "SELECT count(*) AS n, sha256(sum(('0x' || left(md5(concat_ws('|', id, kind, printf('%.6f', low), track_id)), 12))::BIGINT)::VARCHAR) AS hash FROM onsets")
_add("j1_equi_join", lambda s, d: _r(t.onsets(s, d).select("track_id", "id", "kind").join(_kind(s, d, "click").select("track_id", "id", "low"), ["track_id", "id"], "left"), "low"), "SELECT o.track_id, o.id, o.kind, round(CASE WHEN kind = 'click' THEN low END, 6) AS low FROM onsets o")
_add("j7_self_pairs", lambda s, d: _self_pairs(s, d), "SELECT a.track_id, a.idx AS i, b.idx AS j FROM pulses a JOIN pulses b ON a.track_id = b.track_id AND a.idx < b.idx AND b.idx - a.idx <= 8")


def _self_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of beats of one track at most eight apart: each meets its followers by number, not all of its track."""
    p = t.pulses(s, d)
    ahead = p.select("track_id", F.col("idx").alias("i"), F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + 8)).alias("j"))
    return ahead.join(p.select("track_id", F.col("idx").alias("j")), ["track_id", "j"]).select("track_id", "i", "j")


_add("j11_scalar_per_track", lambda s, d: _r(t.onsets(s, d).join(F.broadcast(t.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")), F.col("track_id") % 25 == F.col("k")).groupBy("n_name").agg(F.sum("low").alias("low")), "low"), "SELECT n_name, round(sum(low), 6) AS low FROM onsets JOIN nation ON track_id % 25 = n_nationkey GROUP BY n_name")


def _first_copies(s: SparkSession, d: str) -> DataFrame:
    from chronoflux.streaming import activity

    rows = activity.source(s, f"{d}/events.parquet").withColumn("key", F.col("event_id") % 5000)
    return activity.drained(activity.first_copies(rows, ["key"], "60 days"), "append").groupBy().agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


def _stream_matches(s: SparkSession, d: str) -> DataFrame:
    from chronoflux.streaming import activity

    rows = lambda kind: activity.source(s, f"{d}/events.parquet").where(F.col("event_type") == kind)
    return activity.drained(activity.matches(rows("click"), rows("view"), "user_id", "30 MINUTES", "60 days"), "append")


_add("st4_first_copies", _first_copies, "SELECT count(DISTINCT event_id % 5000) AS n, count(DISTINCT event_id % 5000) AS keys FROM events")
_add("st7_stream_matches", _stream_matches, "SELECT a.event_id AS id, b.event_id AS other_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 1800000000")


def _activity(s: SparkSession, d: str) -> DataFrame:
    from chronoflux.streaming import activity

    us = F.unix_micros("ts") - 1704067200000000
    return activity.source(s, f"{d}/events.parquet").select(F.col("user_id").alias("track_id"), "event_id", "ts", (us / 3.6e10).alias("t"))


def _gap_sessions(s: SparkSession, d: str) -> DataFrame:
    from chronoflux.streaming import activity

    return activity.drained(activity.capped_sessions(_activity(s, d), 4 * 3600, 1e9, "2 days"), "append")


def _capped_sessions(s: SparkSession, d: str) -> DataFrame:
    from chronoflux.streaming import activity

    return activity.drained(activity.capped_sessions(_activity(s, d), 12 * 3600, 24 * 3600, "2 days"), "append")


def _upserted(s: SparkSession, d: str) -> DataFrame:
    from chronoflux.streaming import activity

    return activity.upserted(_activity(s, d).select("track_id", "event_id", "ts"), ["track_id"], "ts").select("track_id", "event_id")


def _on_beats(s: SparkSession, d: str) -> DataFrame:
    from chronoflux.streaming import activity

    return activity.drained(activity.on_beats(_activity(s, d).select("track_id", "event_id", "t"), t.pulses(s, d).select("track_id", "t"), 1e3).select("event_id", F.round("beat", 6).alias("beat")), "append")


def _late(s: SparkSession, d: str) -> DataFrame:
    from chronoflux.streaming import activity

    kept, late = activity.split_late(_activity(s, d).select("track_id", "event_id", "ts"), "10 days")
    return kept.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


_add("st3_gap_sessions", _gap_sessions, "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 4 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM a), c AS (SELECT user_id, run, min(ts) AS a, max(ts) AS z, count(*) AS n, run = max(run) OVER (PARTITION BY user_id) AS last FROM b GROUP BY user_id, run) SELECT user_id AS track_id, epoch_us(a) / 1e6 AS start, n FROM c WHERE NOT last OR z + INTERVAL 4 HOURS < (SELECT max(ts) FROM events) - INTERVAL 2 DAYS")
_add("st3_capped_sessions", _capped_sessions)
_add("st5_upserted", _upserted, "SELECT user_id AS track_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
_add("st6_on_beats", _on_beats, "WITH p AS (SELECT track_id, t, coalesce(lead(t) OVER (PARTITION BY track_id ORDER BY t), t + 1000) AS n FROM pulses) SELECT o.id AS event_id, round(p.t, 6) AS beat FROM onsets o JOIN p ON o.track_id = p.track_id AND o.t >= p.t AND o.t < p.n")
_add("st8_late_rows", _late, "SELECT event_id, ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAYS AS late FROM events")
