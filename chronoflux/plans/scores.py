"""Queries of matching scores, gates and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoflux.operators import evidence, grid, scores
from chronoflux.plans.catalog import _add, _kind, _r
from chronoflux.sources import tables as t
from chronoflux.sources.store import stored

TOL = 0.3
PAIRS = f"pr AS (SELECT r.track_id, r.idx AS r, e.idx AS e, r.t AS rt, e.t AS et FROM pulses r JOIN marks e ON r.track_id = e.track_id AND abs(r.t - e.t) <= {TOL}::DOUBLE QUALIFY row_number() OVER (PARTITION BY r.track_id, r.idx ORDER BY abs(r.t - e.t), e.t) = 1 AND row_number() OVER (PARTITION BY r.track_id, e.idx ORDER BY abs(r.t - e.t), r.t) = 1)"
PRF = "pf AS (SELECT track_id, coalesce(m, 0) AS matched, CASE WHEN e > 0 THEN floor(coalesce(m, 0) * 10000 / e + 0.5) / 10000 END AS precision, CASE WHEN r > 0 THEN floor(coalesce(m, 0) * 10000 / r + 0.5) / 10000 END AS recall, CASE WHEN coalesce(r, 0) + coalesce(e, 0) > 0 THEN floor(2 * coalesce(m, 0) * 10000 / (coalesce(r, 0) + coalesce(e, 0)) + 0.5) / 10000 END AS f1, mae FROM (SELECT track_id, count(*) AS r FROM pulses GROUP BY ALL) a FULL JOIN (SELECT track_id, count(*) AS e FROM marks GROUP BY ALL) b USING (track_id) LEFT JOIN (SELECT track_id, count(*) AS m, avg(abs(rt - et)) AS mae FROM pr GROUP BY ALL) c USING (track_id))"


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return scores.mutual_pairs(t.pulses(s, d), t.marks(s, d), TOL)


def _prf(s: SparkSession, d: str) -> DataFrame:
    return scores.prf(_pairs(s, d), t.pulses(s, d), t.marks(s, d))


_add("m5_prf", lambda s, d: _r(_prf(s, d), "mae"), f"WITH {PAIRS}, {PRF} SELECT track_id, matched, precision, recall, f1, round(mae, 6) AS mae FROM pf")
_add("m7_beat_in_bar", lambda s, d: scores.beat_in_bar_accuracy(_pairs(s, d), t.pulses(s, d), t.marks(s, d)), f"WITH {PAIRS} SELECT pr.track_id, floor(count(*) FILTER (a.beat_in_bar = b.beat_in_bar) * 10000 / count(*) + 0.5) / 10000 AS accuracy FROM pr JOIN pulses a ON a.track_id = pr.track_id AND a.idx = pr.r JOIN marks b ON b.track_id = pr.track_id AND b.idx = pr.e GROUP BY ALL")
_PRED = "pd AS (SELECT track_id, id, t0, bpm, lead(t0) OVER (PARTITION BY track_id ORDER BY t0, id) AS t1 FROM segments WHERE id % 3 <> 0), pf AS (SELECT track_id, min(t0) AS f0, min_by(bpm, t0) AS fb FROM pd GROUP BY ALL), u AS (SELECT DISTINCT ON (track_id, t0) * FROM pd ORDER BY track_id, t0, bpm DESC)"


def _predicted(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = t.segments(s, d).where("id % 3 <> 0").drop("t1")
    return rows.withColumn("t1", F.lead("t0").over(Window.partitionBy("track_id").orderBy("t0", "id")))


def _distinct(df: DataFrame) -> DataFrame:
    """Tracks whose segments all start at times of their own: ties have no order to compare."""
    tied = df.groupBy("track_id").agg(F.count("*").alias("n"), F.count_distinct("t0").alias("k")).where("n <> k")
    return df.join(tied, "track_id", "left_anti")


_UNTIED = "un AS (SELECT track_id FROM segments GROUP BY ALL HAVING count(*) = count(DISTINCT t0))"
_add(
    "m8_tempo_segments",
    lambda s, d: _r(scores.tempo_segment_errors(_distinct(t.segments(s, d)), _predicted(s, d)), "change_error", "bpm_error"),
    f"WITH {_UNTIED}, pd AS (SELECT track_id, id, t0, bpm, lead(t0) OVER (PARTITION BY track_id ORDER BY t0, id) AS t1 FROM segments WHERE id % 3 <> 0), pq AS (SELECT track_id, count(*) AS n, min_by(t1, t0) AS e, min(t0) AS f0, min_by(bpm, t0) AS fb FROM pd GROUP BY ALL), tr AS (SELECT track_id, min_by(t1, t0) AS te FROM segments SEMI JOIN un USING (track_id) GROUP BY ALL), mi AS (SELECT track_id, (t0 + t1) / 2 AS t, bpm FROM segments SEMI JOIN un USING (track_id) WHERE t1 IS NOT NULL), x AS (SELECT mi.track_id, avg(abs(CASE WHEN mi.t <= pd.t1 THEN pd.bpm WHEN f0 = mi.t THEN fb END - mi.bpm)) AS be FROM mi ASOF LEFT JOIN pd ON mi.track_id = pd.track_id AND mi.t > pd.t0 LEFT JOIN pq ON mi.track_id = pq.track_id GROUP BY ALL) SELECT tr.track_id, coalesce(n, 0) < 2 AS merged, round(CASE WHEN n >= 2 THEN abs(e - te) END, 6) AS change_error, round(be, 6) AS bpm_error FROM tr LEFT JOIN pq USING (track_id) LEFT JOIN x USING (track_id)",
)
_add(
    "m9_tempo_curve",
    lambda s, d: _r(scores.tempo_curve_errors(_distinct(t.segments(s, d)).select("track_id", "id", F.col("t0").alias("t"), "bpm"), _predicted(s, d)), "mae", "octaves"),
    f"WITH {_UNTIED}, pd AS (SELECT track_id, id, t0, bpm, lead(t0) OVER (PARTITION BY track_id ORDER BY t0, id) AS t1 FROM segments WHERE id % 3 <> 0), pq AS (SELECT track_id, min(t0) AS f0, min_by(bpm, t0) AS fb FROM pd GROUP BY ALL), x AS (SELECT a.track_id, a.id, a.t0 AS t, a.bpm, CASE WHEN a.t0 <= pd.t1 THEN pd.bpm WHEN f0 = a.t0 THEN fb END AS p FROM (SELECT * FROM segments SEMI JOIN un USING (track_id)) a ASOF LEFT JOIN pd ON a.track_id = pd.track_id AND a.t0 > pd.t0 LEFT JOIN pq ON a.track_id = pq.track_id), y AS (SELECT *, bpm - lag(bpm) OVER w AS da, p - lag(p) OVER w AS db FROM x WHERE p IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY t, id)) SELECT track_id, count(*) AS n, round(avg(abs(p - bpm)), 6) AS mae, CASE WHEN count(*) FILTER (abs(da) >= 0.5) > 0 THEN floor(count(*) FILTER (abs(da) >= 0.5 AND da * db > 0) * 10000 / count(*) FILTER (abs(da) >= 0.5) + 0.5) / 10000 END AS direction, round(max(abs(log2(p / bpm))), 6) AS octaves FROM y GROUP BY track_id",
)
_add("m10_octave_errors", lambda s, d: scores.octave_errors(_pairs(s, d)), f"WITH {PAIRS}, n AS (SELECT *, lead(r) OVER w AS r2, lead(rt) OVER w - rt AS a, lead(et) OVER w - et AS b FROM pr WINDOW w AS (PARTITION BY track_id ORDER BY r)) SELECT track_id, count(*) FILTER (r2 = r + 1 AND a > 0 AND b / a > 0 AND abs(log2(CASE WHEN b / a > 0 THEN b / a END)) > 0.75) AS n FROM n GROUP BY track_id")
_SEAMS = f"ch AS (SELECT track_id, idx AS c FROM pulses WHERE idx % 12 = 0 AND idx > 0), hi AS (SELECT p.track_id, c, p.t, rt, et FROM ch JOIN pulses p ON p.track_id = ch.track_id AND p.idx >= c - 8 AND p.idx < c + 16 LEFT JOIN pr ON pr.track_id = p.track_id AND pr.r = p.idx), ro AS (SELECT track_id, c, count(*) AS n, count(et) AS matched, min(t) - {TOL} AS w0, max(t) + {TOL} AS w1, avg(abs(rt - et)) AS mae FROM hi GROUP BY ALL HAVING count(*) >= 2), sm AS (SELECT track_id, c AS change, matched, n - matched AS missing, greatest((SELECT count(*) FROM marks m WHERE m.track_id = ro.track_id AND m.t BETWEEN w0 AND w1) - matched, 0) AS extra, mae FROM ro)"


def _seams(s: SparkSession, d: str) -> DataFrame:
    return scores.seams(t.pulses(s, d).where("idx % 12 = 0 AND idx > 0"), t.pulses(s, d), t.marks(s, d), _pairs(s, d), TOL)


_add("m11_seams", lambda s, d: _r(_seams(s, d), "mae"), f"WITH {PAIRS}, {_SEAMS} SELECT track_id, change, matched, missing, extra, round(mae, 6) AS mae FROM sm")
_add("m27_worst_seams", lambda s, d: scores.worst_seams(_seams(s, d), 12), f"WITH {PAIRS}, {_SEAMS} SELECT track_id, max(missing) AS missing, max(extra) AS extra, max(missing) > 12 OR max(extra) > 12 AS failed FROM sm GROUP BY track_id")
_add(
    "m12_quantization_error",
    lambda s, d: _r(scores.quantization_error(_pairs(s, d), grid.quantize(t.marks(s, d).withColumnRenamed("idx", "id"), t.pulses(s, d)).select("track_id", F.col("id").alias("e"), F.col("quantized_time").alias("q"))), "error"),
    f"WITH {PAIRS}, p AS (SELECT *, coalesce(lead(t) OVER w - t, t - lag(t) OVER w, 1) AS step, lead(t) OVER w IS NOT NULL AS more FROM pulses WINDOW w AS (PARTITION BY track_id ORDER BY t)), f AS (SELECT track_id, min(t) AS f0, min_by(step, t) AS fs FROM p GROUP BY ALL), q AS (SELECT m.track_id, m.idx AS e, CASE WHEN f0 IS NULL THEN round_even(m.t / 0.25, 0) * 0.25 WHEN p.t IS NULL THEN f0 - round_even((f0 - m.t) / (fs / 4), 0) * fs / 4 WHEN more THEN p.t + ceil((m.t - p.t) / step * 4 - 0.5) * step / 4 ELSE p.t + round_even((m.t - p.t) / step * 4, 0) * step / 4 END AS q FROM marks m ASOF LEFT JOIN p ON m.track_id = p.track_id AND m.t >= p.t LEFT JOIN f ON m.track_id = f.track_id) SELECT track_id, round(avg(abs(q - rt)), 6) AS error, count(*) AS n FROM pr JOIN q USING (track_id, e) GROUP BY ALL",
)
_add("m17_beat_scores", lambda s, d: _r(scores.beat_scores(t.pulses(s, d), t.marks(s, d), tol=TOL, sigma=0.2), "f", "cemgil", "cmlc", "cmlt", "amlc", "amlt"), f"""WITH r AS (SELECT *, t - lag(t) OVER w AS gap, row_number() OVER w AS i FROM (SELECT track_id, t FROM pulses WHERE t >= 5) WINDOW w AS (PARTITION BY track_id ORDER BY t)), e AS (SELECT *, t - lag(t) OVER w AS mine, row_number() OVER w AS i FROM (SELECT track_id, t FROM marks WHERE t >= 5) WINDOW w AS (PARTITION BY track_id ORDER BY t)),
n AS (SELECT track_id, coalesce(nr, 0) AS nr, coalesce(ne, 0) AS ne FROM (SELECT track_id, count(*) AS nr FROM r GROUP BY ALL) FULL JOIN (SELECT track_id, count(*) AS ne FROM e GROUP BY ALL) USING (track_id)),
h AS (SELECT track_id, count(*) AS hits FROM (SELECT r.track_id FROM r JOIN e ON r.track_id = e.track_id AND abs(r.t - e.t) <= {TOL}::DOUBLE QUALIFY row_number() OVER (PARTITION BY r.track_id, r.i ORDER BY abs(r.t - e.t), e.t) = 1 AND row_number() OVER (PARTITION BY r.track_id, e.i ORDER BY abs(r.t - e.t), r.t) = 1) GROUP BY ALL),
g AS (SELECT track_id, sum(exp(-dd * dd / 0.08)) AS gauss FROM (SELECT r.track_id, r.t, min(abs(r.t - e.t)) AS dd FROM r JOIN e ON r.track_id = e.track_id GROUP BY ALL) GROUP BY ALL),
va AS (SELECT track_id, 0 AS v, t FROM r UNION ALL SELECT track_id, 1, t - gap / 2 FROM r WHERE gap IS NOT NULL UNION ALL SELECT track_id, 2, t FROM r UNION ALL SELECT track_id, 2, t - gap / 2 FROM r WHERE gap IS NOT NULL UNION ALL SELECT track_id, 3, t FROM r WHERE i % 2 = 1 UNION ALL SELECT track_id, 4, t FROM r WHERE i % 2 = 0),
vs AS (SELECT *, coalesce(t - lag(t) OVER w, lead(t) OVER w - t) AS step, t - lag(t) OVER w AS gap FROM va WINDOW w AS (PARTITION BY track_id, v ORDER BY t)),
ne2 AS (SELECT e.track_id, vs.v, e.i, e.t, e.mine, vs.t AS rt, vs.step, vs.gap FROM e JOIN vs ON e.track_id = vs.track_id QUALIFY row_number() OVER (PARTITION BY e.track_id, vs.v, e.i ORDER BY abs(e.t - vs.t), vs.t) = 1),
rg AS (SELECT track_id, v, i, coalesce(abs(t - rt) <= 0.175 * step AND (mine IS NULL OR gap IS NULL OR abs(mine - gap) <= 0.175 * gap), false) AS ok FROM ne2),
ru AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY track_id, v ORDER BY i) AS run FROM rg),
rc AS (SELECT track_id, v, max(k) AS c, sum(k) AS a FROM (SELECT track_id, v, run, count(*) AS k FROM ru WHERE ok GROUP BY ALL) GROUP BY ALL),
be AS (SELECT track_id, coalesce(max(c) FILTER (v = 0), 0) AS cc, coalesce(max(a) FILTER (v = 0), 0) AS ca, max(c) AS ac, max(a) AS aa FROM rc GROUP BY ALL)
SELECT n.track_id, round(CASE WHEN nr >= 2 AND ne >= 2 THEN 2 * coalesce(hits, 0) / (nr + ne) ELSE 0 END, 6) AS f, round(CASE WHEN nr >= 2 AND ne >= 2 THEN 2 * coalesce(gauss, 0) / (nr + ne) ELSE 0 END, 6) AS cemgil, round(CASE WHEN nr >= 2 AND ne >= 2 THEN coalesce(cc, 0) / greatest(nr, ne) ELSE 0 END, 6) AS cmlc, round(CASE WHEN nr >= 2 AND ne >= 2 THEN coalesce(ca, 0) / greatest(nr, ne) ELSE 0 END, 6) AS cmlt, round(CASE WHEN nr >= 2 AND ne >= 2 THEN coalesce(ac, 0) / greatest(nr, ne) ELSE 0 END, 6) AS amlc, round(CASE WHEN nr >= 2 AND ne >= 2 THEN coalesce(aa, 0) / greatest(nr, ne) ELSE 0 END, 6) AS amlt FROM n LEFT JOIN h USING (track_id) LEFT JOIN g USING (track_id) LEFT JOIN be USING (track_id)""")


def _cases(s: SparkSession, d: str) -> DataFrame:
    k = F.col("track_id")
    return _prf(s, d).select("track_id", "f1", "mae", (k % 9).cast("double").alias("bpm_error"), (k % 31).alias("false_events"), (k % 13 == 0).alias("invalid"), (k % 2 == 0).alias("fixed"))


def _accepted(s: SparkSession, d: str) -> DataFrame:
    k = F.col("track_id")
    return _prf(s, d).where("track_id % 5 <> 0").select("track_id", (F.col("f1") + (k % 3 - 1) * 0.05).alias("base_f1"), (F.col("mae") - (k % 4) * 0.01).alias("base_mae"), F.lit(0.3).alias("f1_min"))


_CASES = "cs AS (SELECT track_id, f1, mae, (track_id % 9)::DOUBLE AS bpm_error, track_id % 31 AS false_events, track_id % 13 = 0 AS invalid, track_id % 2 = 0 AS fixed FROM pf), acc AS (SELECT track_id, f1 + (track_id % 3 - 1) * 0.05::DOUBLE AS base_f1, mae - (track_id % 4) * 0.01::DOUBLE AS base_mae, 0.3::DOUBLE AS f1_min FROM pf WHERE track_id % 5 <> 0)"
_add("m19_case_gates", lambda s, d: scores.case_gates(_cases(s, d)).select("track_id", "failed"), f"WITH {PAIRS}, {PRF}, {_CASES} SELECT track_id, array_to_string(list_filter([CASE WHEN invalid THEN 'invalid-schema' END, CASE WHEN bpm_error > 5 THEN 'fixed-bpm' END, CASE WHEN fixed AND f1 < 0.5 THEN 'beat-f1-floor' END, CASE WHEN false_events > 20 THEN 'silence' END], lambda x: x IS NOT NULL), ',') AS failed FROM cs")
_add("m20_baseline_gates", lambda s, d: scores.baseline_gates(_cases(s, d), _accepted(s, d)).select("track_id", "failed"), f"WITH {PAIRS}, {PRF}, {_CASES} SELECT track_id, array_to_string(list_filter([CASE WHEN f1 < base_f1 - 0.03 THEN 'f1-regression' END, CASE WHEN mae > base_mae + 0.015 THEN 'mae-regression' END, CASE WHEN f1 < f1_min THEN 'f1-below-minimum' END], lambda x: x IS NOT NULL), ',') AS failed FROM cs LEFT JOIN acc USING (track_id)")
_add("m21_baseline_state", lambda s, d: scores.baseline_state(_cases(s, d).where("track_id % 7 <> 0"), _accepted(s, d), 0.2), f"WITH {PAIRS}, {PRF}, {_CASES} SELECT track_id, CASE WHEN base_f1 IS NULL AND c THEN 'missing' WHEN c IS NULL THEN 'stale' WHEN base_f1 NOT BETWEEN 0 AND 1 THEN 'invalid' WHEN f1 < 0.2 THEN 'refused' ELSE 'ok' END AS state FROM (SELECT track_id, true AS c, f1 FROM cs WHERE track_id % 7 <> 0) FULL JOIN acc USING (track_id)")
_add("m22_structure_gates", lambda s, d: scores.structure_gates(_prf(s, d).select("track_id", (F.col("track_id") % 4).alias("truth_bounds"), "f1", (F.col("mae") * 10).alias("mae_bars"), F.col("recall").alias("family_f1"), (F.col("track_id") % 3).alias("predicted_bounds"), (F.col("track_id") % 5).alias("gaps"))).select("track_id", "failed"), f"WITH {PAIRS}, {PRF} SELECT track_id, array_to_string(list_filter([CASE WHEN track_id % 4 > 0 AND f1 < 0.8 THEN 'boundary-f1' END, CASE WHEN track_id % 4 > 0 AND mae * 10 > 1 THEN 'boundary-mae' END, CASE WHEN track_id % 4 = 0 AND track_id % 3 > 0 THEN 'monotony' END, CASE WHEN recall < 0.8 THEN 'family-f1' END, CASE WHEN track_id % 5 > 0 THEN 'coverage' END], lambda x: x IS NOT NULL), ',') AS failed FROM pf")

# ranking
_GAPPED = "ev AS (SELECT track_id, id, low, mid, t - lag(t) OVER (PARTITION BY track_id ORDER BY t, id) AS gap FROM onsets)"


def _gapped(s: SparkSession, d: str) -> DataFrame:
    return t.onsets(s, d).select("track_id", "id", "low", "mid").join(evidence.gaps(t.onsets(s, d)).select("track_id", "id", F.col("before").alias("gap")), ["track_id", "id"])


def _features(name: str) -> str:
    return f"SELECT track_id, id, '{name}' AS feature, coalesce({name}, 0)::DOUBLE AS x FROM ev UNION ALL SELECT track_id, id, '{name}_missing', ({name} IS NULL)::INT::DOUBLE FROM ev UNION ALL SELECT track_id, id, '{name}_squared', coalesce({name} * {name}, 0)::DOUBLE FROM ev"


_add("r1_rank_features", lambda s, d: _r(scores.rank_features(_gapped(s, d), ["low", "mid", "gap"]), "x"), f"WITH {_GAPPED} SELECT track_id, id, feature, round(x, 6) AS x FROM (" + " UNION ALL ".join(_features(c) for c in ("low", "mid", "gap")) + ")")
_add("r21_ablations", lambda s, d: _r(scores.ablated(scores.rank_features(_gapped(s, d), ["low", "mid", "gap"]), ["gap"]).groupBy("feature").agg(F.count("*").alias("n"), F.avg("x").alias("mean")), "mean"), f"WITH {_GAPPED} SELECT feature, count(*) AS n, round(avg(x), 6) AS mean FROM (" + " UNION ALL ".join(_features(c) for c in ("low", "mid")) + ") GROUP BY feature")
#: A model of 48 trees by a rule: bands in turn, thresholds that walk through 0 to 1.
MODEL = {"base": -0.4, "anchor": 1.0, "rate": 0.1, "trees": [(c, (k * 7 % 48 + 1) / 49, (("low", "mid", "high")[(k + 1) % 3], (k * 11 % 48 + 1) / 49, (k % 5 - 2) / 4, (k % 3 - 1) / 3), (k % 7 - 3) / 5) for k, c in enumerate(("low", "mid", "high") * 16)]}


def _case(node: object) -> str:
    return f"{float(node)}::DOUBLE" if not isinstance(node, tuple) else f"(CASE WHEN coalesce({node[0]}, 0) <= {float(node[1])}::DOUBLE THEN {_case(node[2])} ELSE {_case(node[3])} END)"


_add("r4_score_trees", lambda s, d: scores.score_trees(t.onsets(s, d), MODEL).select("id", "relevance"), f"SELECT id, round(1 / (1 + exp(-(-0.4::DOUBLE + 1.0 * strength + 0.1::DOUBLE * (0.0::DOUBLE + {' + '.join(_case(x) for x in MODEL['trees'])})))), 6) AS relevance FROM onsets")
_add(
    "r5_pairwise_logistic",
    lambda s, d: _fitted(s, d),
)


def _fitted(s: SparkSession, d: str) -> DataFrame:
    """Pairs within .5 of each other, the stronger wins by .2: accuracy of the fitted weights."""
    from chronoflux.operators import joins

    a = t.onsets(s, d)
    pairs = joins.band(a, a, 0.5).where("id <> other_id")
    x = a.select("track_id", "id", "low", "high", "strength")
    both = pairs.join(x, ["track_id", "id"]).join(x.select("track_id", F.col("id").alias("other_id"), F.col("low").alias("l2"), F.col("high").alias("h2"), F.col("strength").alias("s2")), ["track_id", "other_id"]).where(F.col("strength") - F.col("s2") >= 0.2)
    rows = stored(both.select((F.col("low") - F.col("l2")).alias("low"), (F.col("high") - F.col("h2")).alias("high")))
    w = scores.fit_pairwise(rows, ["low", "high"])
    right = F.col("low") * w[0] + F.col("high") * w[1] > 0
    return rows.agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"))


_add("r10_select_spaced", lambda s, d: scores.select_spaced(t.onsets(s, d).select("track_id", "id", "t", F.col("low").alias("relevance"))))
_add(
    "r11_cut_intervals",
    lambda s, d: scores.cut_intervals(_kind(s, d, "purchase").select("track_id", "id", "t"), t.pulses(s, d).where("beat_in_bar = 1").select("track_id", "t"), t.onsets(s, d).groupBy("track_id").agg((F.max("t") + 1).alias("duration")), 0.4),
    "WITH tr AS (SELECT track_id, max(t) + 1 AS e FROM onsets GROUP BY ALL), b AS MATERIALIZED (SELECT track_id, t FROM pulses WHERE beat_in_bar = 1), x AS MATERIALIZED (SELECT track_id, t FROM onsets o WHERE kind = 'purchase' AND t >= 0.4 AND id NOT IN (SELECT p.id FROM onsets p JOIN b ON b.track_id = p.track_id AND abs(b.t - p.t) < 0.4)), u AS (SELECT track_id, t, min(o) AS o FROM (SELECT track_id, 0.0::DOUBLE AS t, 0 AS o FROM tr UNION ALL SELECT track_id, t, 1 FROM b UNION ALL SELECT track_id, t, 2 FROM x) GROUP BY ALL) SELECT u.track_id, t AS t0, coalesce(lead(t) OVER (PARTITION BY u.track_id ORDER BY t), e) AS t1, ['start', 'boundary', 'onset'][o + 1] AS kind FROM u JOIN tr ON u.track_id = tr.track_id",
)
_add("r14_top_support_precision", lambda s, d: scores.top_support_precision(t.onsets(s, d).withColumn("relevance", F.col("mid")), "low", 10), "WITH r AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY mid DESC, id) AS a, row_number() OVER (PARTITION BY track_id ORDER BY low DESC, id) AS b FROM onsets) SELECT track_id, floor(count(*) FILTER (a <= 10 AND b <= 10) * 10000 / least(count(*), 10) + 0.5) / 10000 AS precision FROM r GROUP BY track_id")
_add("r15_macro", lambda s, d: _r(scores.macro(_prf(s, d), "f1"), "mean"), f"WITH {PAIRS}, {PRF} SELECT round(avg(f1), 6) AS mean, count(f1) AS n FROM pf")
_add("r16_bootstrap", lambda s, d: _r(scores.paired_bootstrap(_prf(s, d).select("track_id", (F.col("precision") - F.col("recall")).alias("delta")).where("delta IS NOT NULL"), "delta", 200, "seed"), "low", "mean", "high"), f"WITH {PAIRS}, {PRF}, rw AS (SELECT row_number() OVER (ORDER BY track_id) - 1 AS i, precision - recall AS delta FROM pf WHERE precision - recall IS NOT NULL), m AS (SELECT r, avg(b.delta) AS m FROM (SELECT i AS s, unnest(generate_series(1, 200)) AS r FROM rw) a JOIN rw b ON b.i = ('0x' || left(md5('seed:' || r || ':' || s), 8))::BIGINT % (SELECT count(*) FROM rw) GROUP BY r) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.975), 6) AS high FROM m")
_add("r17_slices", lambda s, d: _r(scores.slices(t.onsets(s, d), {"loud": F.col("strength") > 0.8, "click": F.col("kind") == "click", "view": F.col("kind") == "view", "high-band": F.col("high") > F.col("low"), "all": F.lit(True)}, "mid"), "mean"), "SELECT slice, count(*) AS n, round(avg(mid), 6) AS mean FROM (SELECT mid, unnest([CASE WHEN strength > 0.8 THEN 'loud' END, CASE WHEN kind = 'click' THEN 'click' END, CASE WHEN kind = 'view' THEN 'view' END, CASE WHEN high > low THEN 'high-band' END, 'all']) AS slice FROM onsets) WHERE slice IS NOT NULL GROUP BY slice")
_LIMITS = {"loud": ("min", 0.5), "click": ("max", 0.2), "view": ("min", 0.01), "nowhere": ("min", 0.0)}
_add("r18_promotion_gates", lambda s, d: _r(scores.promotion_gates(t.onsets(s, d).groupBy(F.col("kind").alias("name")).agg(F.avg("mid").alias("value")), _LIMITS), "value"), "WITH g(name, side, lim) AS (VALUES ('loud', 'min', 0.5), ('click', 'max', 0.2), ('view', 'min', 0.01), ('nowhere', 'min', 0.0)), f AS (SELECT kind AS name, avg(mid) AS value FROM onsets GROUP BY ALL) SELECT name, round(value, 6) AS value, coalesce(CASE WHEN side = 'min' THEN value >= lim ELSE value <= lim END, false) AS passed FROM g LEFT JOIN f USING (name)")
_add("r19_select_candidate", lambda s, d: scores.select_candidate(_prf(s, d), F.col("matched") >= 3, F.desc("f1"), F.col("mae"), F.col("track_id")).select("track_id", "f1"), f"WITH {PAIRS}, {PRF} SELECT track_id, f1 FROM pf WHERE matched >= 3 ORDER BY f1 DESC, mae, track_id LIMIT 1")
_add("r20_leave_one_out", lambda s, d: _r(scores.leave_one_out(t.onsets(s, d), "kind", "mid"), "error"), "WITH o AS (SELECT kind, sum(mid) AS s, count(*) AS n FROM onsets GROUP BY ALL), a AS (SELECT sum(s) AS ts, sum(n) AS tn FROM o) SELECT kind, n, round(CASE WHEN tn > n THEN abs(s / n - (ts - s) / (tn - n)) END, 6) AS error FROM o, a")
