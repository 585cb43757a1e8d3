"""Structure from end to end over all embeddings: views, similarity within reach, boundaries, segments, families."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoflux.operators import forms
from chronoflux.plans.catalog import _add, _r
from chronoflux.sources import tables as t
from chronoflux.sources.store import stored

#: Views as spans of an embedding's components, both ends in.
VIEWS = {"harmony": (1, 12), "timbre": (13, 38), "rhythm": (39, 60), "energy": (61, 64)}


def _long(s: SparkSession, d: str) -> DataFrame:
    """Every component of every embedding: a label is a track, its rows by id are bars."""
    bar = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long")
    rows = t.read(s, d, "embeddings").select(F.col("label").alias("track_id"), bar.alias("bar"), "embedding")
    return rows.select("track_id", "bar", F.posexplode("embedding").alias("p", "x")).select("track_id", "bar", (F.col("p") + 1).cast("long").alias("col"), F.col("x").cast("double").alias("x"))


def _smoothed(s: SparkSession, d: str, smooth: int = 8) -> DataFrame:
    """All views: each component as the mean of ``smooth`` bars up to its own, so that neighbours are alike."""
    w = Window.partitionBy("track_id", "col").orderBy("bar").rowsBetween(1 - smooth, 0)
    return _long(s, d).withColumn("x", F.avg("x").over(w))


def _bars(s: SparkSession, d: str) -> DataFrame:
    return _long(s, d).groupBy("track_id").agg(F.max("bar").alias("bars"))


class Chain:
    """The stages over one folder of tables, each stored once: what follows reads its table."""

    def __init__(self, s: SparkSession, d: str) -> None:
        self.s, self.d = s, d

    @cached_property
    def bars(self) -> DataFrame:
        return stored(_bars(self.s, self.d))

    @cached_property
    def views(self) -> dict[str, DataFrame]:
        rows = stored(_smoothed(self.s, self.d))
        return {name: rows.where(F.col("col").between(low, high)) for name, (low, high) in VIEWS.items()}

    @cached_property
    def found(self) -> tuple[DataFrame, DataFrame]:
        wide = stored(forms.bands_within(self.views, forms.MOST, forms.WEIGHTS))
        band = wide.select("track_id", "i", "j", "sim")
        bands = {name: wide.where(F.col(name).isNotNull()).select("track_id", "i", "j", F.col(name).alias("sim")) for name in self.views}
        return band, stored(forms.view_boundaries(band, bands, self.bars))

    @cached_property
    def costs(self) -> DataFrame:
        return stored(forms.segment_costs(*self.found, self.bars))

    @cached_property
    def dp(self) -> DataFrame:
        return stored(forms.segment_dp(self.costs, self.bars))

    @cached_property
    def segments(self) -> DataFrame:
        return stored(forms.segments_from_cuts(self.dp.select("track_id", F.col("start_bar").alias("bar")), self.bars))

    @cached_property
    def described(self) -> DataFrame:
        """Segments with descriptors of their own boundaries and of the energy view's level and spread."""
        novelty = self.found[1].select("track_id", F.col("bar").alias("start_bar"), "novelty")
        bars = self.views["energy"].groupBy("track_id", "bar").agg(F.sum(F.abs("x")).alias("energy"), F.max(F.abs("x")).alias("density"))
        return stored(forms.descriptors(self.segments.join(novelty, ["track_id", "start_bar"], "left"), bars))

    @cached_property
    def vectors(self) -> DataFrame:
        rhythm = self.views["rhythm"].withColumn("block", F.floor((F.col("col") - 39) / 8))
        return stored(forms.segment_vectors(self.segments, self.views | {"rhythm": rhythm}))

    @cached_property
    def families(self) -> DataFrame:
        broken = self.described.select("track_id", "n", F.col("descriptors").contains("break-like").alias("break_like"))
        return stored(forms.assign_view_families(broken, self.vectors, 0.6, 0.75))


_VW = "em AS (SELECT label AS track_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS bar, embedding AS v FROM embeddings), vw AS (SELECT track_id, bar, c AS col, avg(v[c]::DOUBLE) OVER (PARTITION BY track_id, c ORDER BY bar ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS x FROM em, (SELECT unnest(generate_series(1, 64)) AS c)), ns AS (SELECT *, CASE WHEN col <= 12 THEN 'harmony' WHEN col <= 38 THEN 'timbre' WHEN col <= 60 THEN 'rhythm' ELSE 'energy' END AS view FROM vw)"
_BAND = "pa AS (SELECT a.view, a.track_id, a.bar AS i, b.bar AS j, CASE WHEN any_value(a.bar = b.bar) THEN 1.0 ELSE least(1, greatest(0, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))))) END AS sim FROM ns a JOIN ns b ON a.track_id = b.track_id AND a.col = b.col AND b.bar - a.bar BETWEEN 0 AND 32 GROUP BY a.view, a.track_id, a.bar, b.bar), cb AS (SELECT track_id, i, j, sum(sim * CASE view WHEN 'harmony' THEN 0.34 WHEN 'timbre' THEN 0.28 WHEN 'rhythm' THEN 0.23 ELSE 0.15 END) AS sim FROM pa GROUP BY ALL), bd AS (SELECT a.track_id, a.i, a.j, quantile_cont(b.sim, 0.5) AS sim FROM cb a JOIN cb b ON a.track_id = b.track_id AND b.i - a.i = b.j - a.j AND abs(b.i - a.i) <= 1 GROUP BY a.track_id, a.i, a.j)"
_add("s8_views_within_reach", lambda s, d: _r(Chain(s, d).found[0], "sim"), f"WITH {_VW}, {_BAND} SELECT track_id, i, j, round(sim, 6) AS sim FROM bd")
_add(
    "s9_checkerboard",
    lambda s, d: _r(forms.checkerboard(Chain(s, d).found[0], _bars(s, d), 8), "novelty"),
    f"WITH {_VW}, {_BAND}, bo AS (SELECT track_id, i, j, sim FROM bd UNION ALL SELECT track_id, j, i, sim FROM bd WHERE i < j), nb AS (SELECT track_id, max(bar) AS n FROM em GROUP BY ALL), ct AS (SELECT track_id, unnest(generate_series(5, n - 3)) AS bar FROM nb WHERE n >= 8) SELECT ct.track_id, bar, round((avg(sim) FILTER (i < bar AND j < bar) + avg(sim) FILTER (i >= bar AND j >= bar)) / 2 - avg(sim) FILTER (i < bar AND j >= bar), 6) AS novelty FROM ct JOIN bo ON bo.track_id = ct.track_id AND i BETWEEN bar - 4 AND bar + 3 AND j BETWEEN bar - 4 AND bar + 3 GROUP BY ALL",
)
_add("s11_view_boundaries", lambda s, d: Chain(s, d).found[1].select("track_id", "bar", "novelty", *[F.col("drivers")[v].alias(v) for v in VIEWS]))
_add("s12_block_sums", lambda s, d: _r(forms.block_sums(Chain(s, d).found[0]), "total"), f"WITH {_VW}, {_BAND}, bo AS (SELECT track_id, i, j, sim FROM bd UNION ALL SELECT track_id, j, i, sim FROM bd WHERE i < j), sp AS (SELECT DISTINCT track_id, i AS a, j AS b FROM bd WHERE j - i < 32) SELECT sp.track_id, a, b, round(sum(sim), 6) AS total FROM sp JOIN bo ON bo.track_id = sp.track_id AND i BETWEEN a AND b AND j BETWEEN a AND b GROUP BY ALL")
_add("s12_segment_costs", lambda s, d: _r(Chain(s, d).costs, "cost"))
_add("s12_segments_by_cost", lambda s, d: Chain(s, d).dp)
_add("s13_segments_chained", lambda s, d: Chain(s, d).segments)
_add("s15_view_families", lambda s, d: _r(Chain(s, d).families, "similarity"))
_add("s16_descriptors_chained", lambda s, d: Chain(s, d).described)


def _repetitions(s: SparkSession, d: str) -> DataFrame:
    chain = Chain(s, d)
    return _r(forms.family_repetitions(chain.families, chain.vectors), "similarity")


def _bar_families(s: SparkSession, d: str) -> DataFrame:
    chain = Chain(s, d)
    return forms.bar_families(chain.segments.join(chain.families.select("track_id", "n", "family"), ["track_id", "n"]), chain.bars)


_add("s17_repetitions_chained", _repetitions)
_add("s18_bar_families_chained", _bar_families)
