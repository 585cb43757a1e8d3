"""Quality figures of matches, families and rankings, and rules that tables must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timing_error(pairs: DataFrame, distance: str = "distance") -> DataFrame:
    """``track_id, mae_ms, median, most`` of matched distances; tracks without any have no row."""
    d = F.abs(distance)
    return pairs.where(F.col(distance).isNotNull()).groupBy("track_id").agg((F.avg(d) * 1000).alias("mae_ms"), F.percentile(d, F.lit(0.5)).alias("median"), F.max(d).alias("most"))


def macro(selected: DataFrame, scores: DataFrame, metric: str) -> DataFrame:
    """Mean and median over the tracks with the metric, with how many were selected and scored."""
    value = F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))
    rows = selected.select("track_id").distinct().join(scores.select("track_id", value.alias("v")), "track_id", "left")
    return rows.agg(F.count("*").alias("selected"), F.count("v").alias("scored"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"))


def pair_family_f1(rows: DataFrame, found: str, truth: str) -> DataFrame:
    """F1 over pairs of one track that share a family, from group sizes: no pair is formed."""
    both = rows.groupBy("track_id", found, truth).agg(F.count("*").alias("n"))
    pairs = lambda df: df.groupBy("track_id").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("p"))
    size = lambda c: pairs(both.groupBy("track_id", c).agg(F.sum("n").alias("n")))
    joined = pairs(both).join(size(found).withColumnRenamed("p", "a"), "track_id").join(size(truth).withColumnRenamed("p", "b"), "track_id")
    return joined.select("track_id", F.when(F.col("a") + F.col("b") > 0, 2 * F.col("p") / (F.col("a") + F.col("b"))).alias("f1"))


def rank_ids(rows: DataFrame) -> DataFrame:
    """``rank`` by relevance, then id."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("relevance"), "id")))


def select_band_budget(rows: DataFrame, band: str, budget: int) -> DataFrame:
    """The ``budget`` best by ``band`` among the min(256, 4 budget) most relevant of a track."""
    few = rank_ids(rows).where(F.col("rank") <= min(256, 4 * budget))
    order = Window.partitionBy("track_id").orderBy(F.desc(band), F.desc("relevance"), "t", "id")
    return few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget)


def pair_accuracy(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``track_id, accuracy``: share of preference pairs that relevance orders rightly; ties count half."""
    own = lambda side: rows.select("track_id", F.col("id").alias(side), F.col("relevance").alias(f"_{side}"))
    both = pairs.join(own("better"), ["track_id", "better"]).join(own("worse"), ["track_id", "worse"])
    right = F.when(F.col("_better") > F.col("_worse"), 1.0).when(F.col("_better") == F.col("_worse"), 0.5).otherwise(0.0)
    return both.groupBy("track_id").agg(F.avg(right).alias("accuracy"))


def recall_at_k(rows: DataFrame, wanted: Column) -> DataFrame:
    """``track_id, k, recall``: k rows are wanted; the share of them among the k most relevant."""
    k = F.count_if(F.coalesce(wanted, F.lit(False))).over(Window.partitionBy("track_id"))
    ranked = rank_ids(rows.withColumn("k", k)).where("k > 0")
    hit = F.coalesce(wanted, F.lit(False)) & (F.col("rank") <= F.col("k"))
    return ranked.groupBy("track_id", "k").agg((F.count_if(hit) / F.first("k")).alias("recall"))


def clusters(onsets: DataFrame, tol: float) -> DataFrame:
    """``track_id, cluster, t0, n``: onsets chained by gaps of at most ``tol``."""
    w = Window.partitionBy("track_id").orderBy("t", "id")
    new = F.coalesce((F.col("t") - F.lag("t").over(w) > tol).cast("int"), F.lit(1))
    rows = onsets.withColumn("new", new).withColumn("cluster", F.sum("new").over(w))
    return rows.groupBy("track_id", "cluster").agg(F.min("t").alias("t0"), F.count("*").alias("n"))


def density_tertiles(onsets: DataFrame) -> DataFrame:
    """``track_id, tertile``: the lowest and highest third of tracks by onsets per unit of time.

    A third is max(1, n div 3) tracks.  Densities fall into cells of their logarithm,
    so the running count goes over a few thousand cells and ranks within a cell are
    dealt over tasks: no window runs over all tracks.
    """
    rate = F.round(F.count("*") / F.greatest(F.max("t"), F.lit(1e-9)), 9)
    rows = onsets.groupBy("track_id").agg(rate.alias("density")).withColumn("cell", F.floor(F.log2(F.greatest("density", F.lit(1e-9))) * 512))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    before = sizes.select("cell", (F.sum("n").over(every.orderBy("cell")) - F.col("n")).alias("before"), F.sum("n").over(every).alias("all"))
    within = F.row_number().over(Window.partitionBy("cell").orderBy("density", "track_id"))
    placed = rows.withColumn("within", within).join(before, "cell").withColumn("place", F.col("before") + F.col("within"))
    third = F.greatest(F.lit(1), F.floor(F.col("all") / 3))
    return placed.select("track_id", F.when(F.col("place") <= third, "low").when(F.col("place") > F.col("all") - third, "high").otherwise("middle").alias("tertile"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``track_id, id, rule``: a row for each rule that a row breaks, in one pass; null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("rule", F.explode(broken)).select("track_id", "id", "rule")


def onset_rules(onsets: DataFrame, least_gap: float = 0.0) -> DataFrame:
    """Onsets outside their ranges, or not later than the one before by more than ``least_gap``."""
    w = Window.partitionBy("track_id").orderBy("t", "id")
    before = F.lag("t").over(w)
    rows = onsets.withColumn("apart", before.isNull() | (F.col("t") - before > least_gap))
    return violations(rows, {"time": F.col("t") >= 0, "strength": F.col("strength").between(0, 1), "bands": (F.col("low").between(0, 1)) & F.col("mid").between(0, 1) & F.col("high").between(0, 1), "spacing": F.col("apart")})


def tiling_rules(spans: DataFrame, tol: float = 1e-6) -> DataFrame:
    """``track_id, id, rule``: spans ``(t0, t1)`` that leave a gap to, or overlap, the one before, or are empty."""
    before = F.lag("t1").over(Window.partitionBy("track_id").orderBy("t0", "id"))
    rows = spans.withColumn("off", F.coalesce(F.col("t0") - before, F.lit(0.0)))
    return violations(rows, {"gap": F.col("off") <= tol, "overlap": F.col("off") >= -tol, "empty": F.col("t1") > F.col("t0")})


def coverage_rules(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """``track_id, id, rule``: rows without exactly one finite score in 0..1, and scores of unknown rows."""
    a = rows.select("track_id", "id", F.lit(True).alias("known"))
    s = F.col("relevance")
    b = scores.groupBy("track_id", "id").agg(F.count("*").alias("n"), F.min(s.between(0, 1) & ~F.isnan(s)).alias("fine"))
    both = a.join(b, ["track_id", "id"], "full")
    return violations(both, {"unknown": F.col("known"), "missing": F.col("n") >= 1, "repeated": F.coalesce(F.col("n"), F.lit(0)) <= 1, "range": F.col("n").isNull() | F.col("fine")})
