"""Queries of structure, bands and grouped evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronoflux.operators import forms
from chronoflux.plans.catalog import _add, _kind, _r
from chronoflux.plans.grids import SPANS
from chronoflux.sources import tables as t

_DUR = "du AS (SELECT track_id, max(t) + 0.4 AS duration FROM onsets GROUP BY ALL)"
_SS = f"gp AS (SELECT track_id, t, t - lag(t) OVER (PARTITION BY track_id ORDER BY t) AS gap FROM pulses), st AS (SELECT track_id, quantile_cont(gap, 0.5) AS step FROM (SELECT * FROM gp WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY t DESC) <= 8) GROUP BY ALL), dn AS (SELECT track_id, t AS t0, row_number() OVER (PARTITION BY track_id ORDER BY t) AS bar, lead(t) OVER (PARTITION BY track_id ORDER BY t) AS nx FROM pulses WHERE beat_in_bar = 1), ss AS (SELECT * FROM (SELECT dn.track_id, bar, t0, coalesce(nx, least(t0 + 4 * step, duration)) AS t1, nx, step FROM dn LEFT JOIN st USING (track_id) JOIN du USING (track_id)) WHERE t1 - t0 >= CASE WHEN nx IS NULL THEN step ELSE 0 END)"


def _spans(s: SparkSession, d: str) -> DataFrame:
    return forms.structure_spans(t.pulses(s, d), t.onsets(s, d).groupBy("track_id").agg((F.max("t") + 0.4).alias("duration")))


_add("s1_structure_spans", lambda s, d: _r(_spans(s, d), "t0", "t1"), f"WITH {_DUR}, {_SS} SELECT track_id, bar::INT AS bar, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM ss")
_add("s2_median_over_bars", lambda s, d: _r(forms.median_over_bars(t.onsets(s, d).select("track_id", "t", F.col("low").alias("x")), _spans(s, d)), "x"), f"WITH {_DUR}, {_SS}, b AS (SELECT o.track_id, o.t, low, bar, t1 FROM onsets o ASOF JOIN ss ON o.track_id = ss.track_id AND o.t >= ss.t0) SELECT track_id, bar::INT AS bar, round(quantile_cont(low, 0.5), 6) AS x FROM b WHERE t < t1 GROUP BY track_id, bar")
_add("n20_bar_band_means", lambda s, d: _r(forms.band_means(_user_frames(s, d), _spans(s, d), 10.0), "x"), f"WITH {_DUR}, {_SS}, fr AS (SELECT track_id, floor(t * 10)::BIGINT AS frame, sum(mid) AS x FROM onsets GROUP BY ALL), e AS (SELECT track_id, bar, unnest(generate_series(floor(t0 * 10)::BIGINT, greatest(ceil(t1 * 10)::BIGINT - 1, floor(t0 * 10)::BIGINT))) AS frame FROM ss) SELECT track_id, bar::INT AS bar, round(avg(x), 6) AS x FROM e JOIN fr USING (track_id, frame) GROUP BY track_id, bar")


def _user_frames(s: SparkSession, d: str) -> DataFrame:
    return t.onsets(s, d).groupBy("track_id", F.floor(F.col("t") * 10).alias("frame")).agg(F.sum("mid").alias("x"))


_VIEW = "em AS (SELECT label AS track_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS bar, embedding AS v FROM embeddings WHERE vec_id % {k} = 0), vw AS (SELECT track_id, bar, c AS col, v[c]::DOUBLE AS x FROM em, (SELECT unnest(generate_series(1, 8)) AS c))"


def _view(s: SparkSession, d: str, k: int = 5) -> DataFrame:
    bar = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    rows = t.read(s, d, "embeddings").where(F.col("vec_id") % k == 0).select(F.col("label").alias("track_id"), bar.cast("long").alias("bar"), "embedding")
    rows = rows.select("track_id", "bar", F.posexplode(F.slice("embedding", 1, 8)).alias("p", "x"))
    return rows.select("track_id", "bar", (F.col("p") + 1).cast("long").alias("col"), F.col("x").cast("double").alias("x"))


_add("s3_level_normalized", lambda s, d: _r(forms.level_normalized(_view(s, d)), "x"), f"WITH {_VIEW.format(k=5)}, m AS (SELECT track_id, col, quantile_cont(abs(x), 0.5) AS m FROM vw GROUP BY ALL), y AS (SELECT track_id, bar, col, CASE WHEN m > 1e-9 THEN x / m ELSE 0 END AS x FROM vw JOIN m USING (track_id, col)) SELECT track_id, bar, col, round(CASE WHEN n > 1e-9 THEN x / n ELSE 0 END, 6) AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY track_id, bar)) AS n FROM y)")
_add("s4_energy_view", lambda s, d: _r(forms.energy_view(t.onsets(s, d).groupBy("track_id", F.floor("t").alias("bar")).agg(F.avg("mid").alias("rms"), F.avg("low").alias("low"), F.avg("high").alias("high"))), "level").select("track_id", "bar", "level", F.round("low", 9).alias("low"), F.round("high", 9).alias("high")), "WITH b AS (SELECT track_id, floor(t)::BIGINT AS bar, avg(mid) AS rms, avg(low) AS low, avg(high) AS high FROM onsets GROUP BY ALL), m AS (SELECT track_id, quantile_cont(rms, 0.5) AS m FROM b GROUP BY ALL) SELECT track_id, bar, round(least(4, greatest(-4, ln(greatest(rms, 1e-9) / greatest(m, 1e-9)))), 6) AS level, round(low / greatest(low + high, 1e-9) * 0.12::DOUBLE, 9) AS low, round(high / greatest(low + high, 1e-9) * 0.12::DOUBLE, 9) AS high FROM b JOIN m USING (track_id)")
_add("s5_rhythm_view", lambda s, d: forms.rhythm_view(t.onsets(s, d).select("track_id", "t", "low", "mid", "high"), _spans(s, d)), f"WITH {_DUR}, {_SS}, b AS (SELECT o.track_id, o.t, low, mid, high, greatest(low, mid, high) AS top, bar, t0, t1 FROM onsets o ASOF JOIN ss ON o.track_id = ss.track_id AND o.t >= ss.t0), r AS (SELECT track_id, bar, least(floor((t - t0) / (t1 - t0) * 16)::BIGINT, 15) AS step, unnest([CASE WHEN low > 0 AND low >= top * 0.5 THEN 'low' END, CASE WHEN mid > 0 AND mid >= top * 0.5 THEN 'mid' END, CASE WHEN high > 0 AND high >= top * 0.5 THEN 'high' END]) AS band FROM b WHERE t < t1) SELECT DISTINCT track_id, bar::INT AS bar, band, step FROM r WHERE band IS NOT NULL")
_SIM = "pa AS (SELECT a.track_id, a.bar AS i, b.bar AS j, least(1, greatest(0, sum(a.x * b.x) / greatest(sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)), 1e-12))) AS sim FROM vw a JOIN vw b ON a.track_id = b.track_id AND a.col = b.col GROUP BY ALL)"
_add("s8_combined_views", lambda s, d: _r(forms.combined_views(_view(s, d), {"harmony": (1, 8), "timbre": (1, 4)}, {"harmony": 0.34, "timbre": 0.28}), "sim"), f"WITH {_VIEW.format(k=5)}, {_SIM}, {_SIM.replace('pa AS', 'pb AS').replace('vw a', '(SELECT * FROM vw WHERE col <= 4) a').replace('vw b', '(SELECT * FROM vw WHERE col <= 4) b')}, c AS (SELECT track_id, i, j, (0.34::DOUBLE * pa.sim + 0.28::DOUBLE * pb.sim) / 0.62::DOUBLE AS sim FROM pa JOIN pb USING (track_id, i, j)) SELECT track_id, i, j, round(quantile_cont(s, 0.5), 5) AS sim FROM (SELECT c.track_id, c.i, c.j, n.sim AS s FROM c JOIN c n ON n.track_id = c.track_id AND n.i - c.i = n.j - c.j AND n.i - c.i BETWEEN -1 AND 1) GROUP BY ALL".replace("round(quantile_cont(s, 0.5), 5)", "round(quantile_cont(s, 0.5), 6)"))


def _novelty(s: SparkSession, d: str) -> DataFrame:
    return t.frames(s, d).select("track_id", F.col("frame").alias("bar"), (F.col("x") / 10).alias("novelty"))


_add("s11_boundary_candidates", lambda s, d: forms.boundary_candidates(_novelty(s, d)))
_SEG = "sg AS (SELECT track_id, row_number() OVER w AS n, bar AS start_bar, coalesce(lead(bar) OVER w - 1, bars) AS end_bar FROM (SELECT DISTINCT track_id, bar, bars FROM (SELECT track_id, bar FROM em WHERE bar % 7 = 3 UNION ALL SELECT DISTINCT track_id, 1 FROM em) JOIN (SELECT track_id, max(bar) AS bars FROM em GROUP BY ALL) USING (track_id)) WINDOW w AS (PARTITION BY track_id ORDER BY bar))"


def _bars(s: SparkSession, d: str, k: int = 2) -> DataFrame:
    return _view(s, d, k).groupBy("track_id").agg(F.max("bar").alias("bars"))


def _segments(s: SparkSession, d: str, k: int = 2) -> DataFrame:
    return forms.segments_from_cuts(_view(s, d, k).where("bar % 7 = 3").select("track_id", "bar").distinct(), _bars(s, d, k))


_add("s13_segments_from_cuts", lambda s, d: _segments(s, d), f"WITH {_VIEW.format(k=2)}, {_SEG} SELECT track_id, n::INT AS n, start_bar, end_bar FROM sg")
_SEGSIM = "pl AS (SELECT track_id, n, k, start_bar + floor(x)::BIGINT AS bar, x - floor(x) AS u FROM (SELECT *, k * (end_bar - start_bar) / 7.0::DOUBLE AS x FROM sg, (SELECT unnest(generate_series(0, 7)) AS k))), wt AS (SELECT track_id, n, k, bar, 1 - u AS w FROM pl UNION ALL SELECT track_id, n, k, bar + 1, u FROM pl WHERE u > 0), rs AS (SELECT wt.track_id, n, k, col, sum(w * x) AS x FROM wt JOIN vw ON vw.track_id = wt.track_id AND vw.bar = wt.bar GROUP BY ALL), nm AS (SELECT track_id, n, sqrt(sum(x * x)) AS q FROM rs GROUP BY ALL), dt AS (SELECT a.track_id, a.n AS a, b.n AS b, sum(a.x * b.x) AS d FROM rs a JOIN rs b ON a.track_id = b.track_id AND a.k = b.k AND a.col = b.col AND a.n < b.n GROUP BY ALL), sm AS (SELECT dt.track_id, a, b, least(1, greatest(0, d / (p.q * r.q))) * greatest(least(x.end_bar - x.start_bar + 1, y.end_bar - y.start_bar + 1)::DOUBLE / greatest(x.end_bar - x.start_bar + 1, y.end_bar - y.start_bar + 1), 0.75) AS sim FROM dt JOIN nm p ON p.track_id = dt.track_id AND p.n = a JOIN nm r ON r.track_id = dt.track_id AND r.n = b JOIN sg x ON x.track_id = dt.track_id AND x.n = a JOIN sg y ON y.track_id = dt.track_id AND y.n = b)"


def _similar(s: SparkSession, d: str) -> DataFrame:
    return forms.segment_similarity(_segments(s, d), _view(s, d, 2))


def _familied(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, d).withColumn("family", F.concat(F.lit("F"), (F.col("n") % 3).cast("string")))


_add("s14_segment_similarity", lambda s, d: _r(_similar(s, d), "sim"), f"WITH {_VIEW.format(k=2)}, {_SEG}, {_SEGSIM} SELECT track_id, a::INT AS a, b::INT AS b, round(sim, 6) AS sim FROM sm")
_add("s15_assign_families", lambda s, d: forms.assign_families(_segments(s, d).withColumn("break_like", F.col("n") % 5 == 4), _similar(s, d), 0.2, 0.3))
_add(
    "s16_descriptors",
    lambda s, d: forms.descriptors(_segments(s, d).withColumn("novelty", F.when(F.col("n") > 1, (F.col("n") * 37 % 10) / 10)), _view(s, d, 2).groupBy("track_id", "bar").agg(F.sum(F.abs("x")).alias("energy"), F.max("x").alias("density"))),
    f"WITH {_VIEW.format(k=2)}, {_SEG}, b AS (SELECT track_id, bar, sum(abs(x)) AS energy, max(x) AS density FROM vw GROUP BY ALL), fl AS (SELECT track_id, quantile_cont(energy, 0.2) AS e, quantile_cont(density, 0.25) * 0.5 AS d FROM b GROUP BY ALL), x AS (SELECT *, CASE WHEN n > 1 THEN (n * 37 % 10) / 10.0::DOUBLE END AS nv FROM sg), st AS (SELECT track_id, quantile_cont(nv, 0.75) AS p FROM x WHERE n > 1 GROUP BY ALL), i AS (SELECT x.track_id, x.n, avg(energy) AS en, avg(density) AS de FROM x JOIN b ON b.track_id = x.track_id AND b.bar BETWEEN start_bar AND end_bar GROUP BY ALL), r AS (SELECT x.*, lead(nv) OVER w AS nx, lead(n) OVER w IS NULL AS la FROM x WINDOW w AS (PARTITION BY track_id ORDER BY n)) SELECT r.track_id, r.n::INT AS n, array_to_string(list_filter([CASE WHEN r.n = 1 THEN 'opening' END, CASE WHEN la THEN 'ending' END, CASE WHEN en < e THEN 'low-energy' END, CASE WHEN en < e AND de < d THEN 'break-like' END, CASE WHEN end_bar - start_bar + 1 <= 6 AND r.n > 1 AND nv >= p AND nx >= p THEN 'transition-like' END], lambda x: x IS NOT NULL), ',') AS descriptors FROM r LEFT JOIN i USING (track_id, n) LEFT JOIN fl USING (track_id) LEFT JOIN st USING (track_id)",
)
_add("s17_repetitions", lambda s, d: _r(forms.repetitions(_familied(s, d), _similar(s, d)), "similarity"), f"WITH {_VIEW.format(k=2)}, {_SEG}, {_SEGSIM}, z AS (SELECT track_id, 'F' || a % 3 AS family, avg(sim) AS s FROM sm WHERE a % 3 = b % 3 GROUP BY ALL) SELECT track_id, family, n, round(s, 6) AS similarity FROM (SELECT track_id, 'F' || n % 3 AS family, count(*) AS n FROM sg GROUP BY ALL HAVING count(*) > 1) LEFT JOIN z USING (track_id, family)")
_add("s18_bar_families", lambda s, d: forms.bar_families(_familied(s, d), _bars(s, d).select("track_id", (F.col("bars") + 3).alias("bars"))), f"WITH {_VIEW.format(k=2)}, {_SEG}, e AS (SELECT track_id, unnest(generate_series(1, max(bar) + 3)) AS bar FROM em GROUP BY track_id) SELECT e.track_id, e.bar, coalesce('F' || n % 3, tail) AS family FROM e LEFT JOIN sg ON sg.track_id = e.track_id AND e.bar BETWEEN start_bar AND end_bar LEFT JOIN (SELECT track_id, 'F' || max_by(n, end_bar) % 3 AS tail FROM sg GROUP BY ALL) q ON q.track_id = e.track_id")
_add("s12_segment_dp", lambda s, d: forms.segment_dp(_costs(s, d), _bars(s, d, 5)))


def _costs(s: SparkSession, d: str) -> DataFrame:
    """A made cost for every span of 2 to 6 bars: far from four bars is dear, and so is a bar number of its own."""
    bars = _bars(s, d, 5)
    spans = bars.select("track_id", "bars", F.explode(F.sequence(F.lit(1).cast("long"), "bars")).alias("a")).select("track_id", "bars", "a", F.explode(F.sequence(F.col("a") + 1, F.col("a") + 5)).alias("b")).where("b <= bars")
    return spans.select("track_id", "a", "b", (F.abs(F.col("b") - F.col("a") - 3) * 0.3 + (F.col("b") * 7 % 5) / 10).alias("cost"))


_add("s19_bar_groups", lambda s, d: forms.bar_groups(t.read(s, d, "embeddings").where("vec_id % 5 = 0").select(F.col("label").alias("track_id"), F.col("vec_id").alias("bar"), F.transform("embedding", lambda x: x.cast("double")).alias("v")), 0.2))
_add("n1_band_energy", lambda s, d: _r(forms.band_energy(t.spectrum(s, d)), "low", "mid", "high"), "SELECT track_id, frame, round(coalesce(avg(mag) FILTER (freq >= 20 AND freq < 180), 0), 6) AS low, round(coalesce(avg(mag) FILTER (freq >= 180 AND freq < 4000), 0), 6) AS mid, round(coalesce(avg(mag) FILTER (freq >= 4000 AND freq < 16000), 0), 6) AS high FROM spectrum GROUP BY ALL")
_add("n3_bin_flux", lambda s, d: _r(forms.bin_flux(t.spectrum(s, d)), "flux"), "SELECT track_id, frame, round(avg(r), 6) AS flux FROM (SELECT *, coalesce(greatest(ln(1 + mag) - ln(1 + lag(mag) OVER (PARTITION BY track_id, freq ORDER BY frame)), 0), 0) AS r FROM spectrum) GROUP BY ALL")
_add("n18_span_levels", lambda s, d: _r(forms.span_levels(t.onsets(s, d).select("track_id", F.inline(F.array(F.struct(F.lit(0).alias("channel"), "t", (F.col("low") * 2).alias("x")), F.struct(F.lit(1).alias("channel"), "t", (F.col("high") * 2).alias("x"))))), _spans(s, d).withColumnRenamed("bar", "id")), "rms", "peak"), f"WITH {_DUR}, {_SS}, mo AS (SELECT track_id, t, avg(x) AS x FROM (SELECT track_id, t, low * 2 AS x FROM onsets UNION ALL SELECT track_id, t, high * 2 FROM onsets) GROUP BY ALL), lv AS (SELECT track_id, t, CASE WHEN top > 1 THEN x / top ELSE x END AS x FROM (SELECT *, max(abs(x)) OVER (PARTITION BY track_id) AS top FROM mo)), b AS (SELECT lv.*, bar, t1 FROM lv ASOF JOIN ss ON lv.track_id = ss.track_id AND lv.t >= ss.t0) SELECT track_id, bar::INT AS id, round(sqrt(avg(x * x)), 6) AS rms, round(max(abs(x)), 6) AS peak, count(*) AS n FROM b WHERE t < t1 GROUP BY track_id, bar")
_add("e7_structure_context", lambda s, d: _r(forms.structure_context(_kind(s, d, "view"), _kind(s, d, "click").select("track_id", "t", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("low")).alias("novelty"))), "distance").select("id", "distance"), "WITH b AS (SELECT track_id, t, low AS nv FROM onsets WHERE kind = 'click' AND id % 3 <> 0), v AS (SELECT * FROM onsets WHERE kind = 'view'), x AS (SELECT v.id, v.t, v.track_id, b.t AS bt FROM v ASOF LEFT JOIN b ON v.track_id = b.track_id AND v.t >= b.t) SELECT x.id, round(least(coalesce(x.t - bt, 1e18), coalesce(f.t - x.t, 1e18)), 6) AS distance FROM x ASOF LEFT JOIN b f ON x.track_id = f.track_id AND x.t <= f.t WHERE bt IS NOT NULL OR f.t IS NOT NULL UNION ALL SELECT id, NULL FROM v WHERE track_id NOT IN (SELECT track_id FROM b)")
_add("e9_group_shapes", lambda s, d: _r(forms.group_shapes(t.onsets(s, d), 0.5, 3), "span", "slope", "density"), "WITH a AS (SELECT *, t - lag(t) OVER w AS g FROM onsets WINDOW w AS (PARTITION BY track_id ORDER BY t, id)), b AS (SELECT *, sum(CASE WHEN g <= 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY t, id)::BIGINT AS session FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY track_id, session ORDER BY t, id) AS i FROM b) SELECT track_id, session, count(*) AS n, round(max(t) - min(t), 6) AS span, round(CASE WHEN count(*) > 2 THEN regr_slope(CASE WHEN i > 1 THEN g END, CASE WHEN i > 1 THEN i::DOUBLE END) END, 6) AS slope, round(CASE WHEN max(t) > min(t) THEN (count(*) - 1) / (max(t) - min(t)) END, 6) AS density, string_agg(kind, '>' ORDER BY i) AS path FROM c GROUP BY track_id, session HAVING count(*) >= 3")
_add("e12_window_briefs", lambda s, d: _r(forms.window_briefs(_spans(s, d).withColumnRenamed("bar", "id"), t.onsets(s, d).select("track_id", "t", "id", "strength"), t.marks(s, d), 8.0), "density"), f"WITH {_DUR}, {_SS}, b AS (SELECT o.track_id, o.id, o.t, strength, bar, t1 FROM onsets o ASOF JOIN ss ON o.track_id = ss.track_id AND o.t >= ss.t0), h AS (SELECT *, row_number() OVER (PARTITION BY track_id, bar ORDER BY strength DESC, id) AS r FROM b WHERE t < t1), g AS (SELECT track_id, bar, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY r) FILTER (r <= 3) AS a FROM h GROUP BY ALL), f AS (SELECT ss.track_id, ss.bar, ss.t0, ss.t1, m.idx, m.t AS mt FROM ss ASOF LEFT JOIN marks m ON ss.track_id = m.track_id AND ss.t0 <= m.t) SELECT f.track_id, f.bar::INT AS id, coalesce(n, 0) AS n, round(coalesce(n, 0) / (t1 - t0), 6) AS density, CASE WHEN mt < t1 THEN idx END AS first_beat, coalesce(a, '') AS anchors FROM f LEFT JOIN g ON g.track_id = f.track_id AND g.bar = f.bar")
