"""Frame series: flux, thresholds, peaks, prominence; tempo figures from beats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoflux.functions.columns import clip

from . import joins


def _w() -> object:
    return Window.partitionBy("track_id").orderBy("frame")


def flux(frames: DataFrame) -> DataFrame:
    """``flux``: rise of log1p(x) from frame to frame, 0 where it falls and at the first."""
    rise = F.log1p("x") - F.log1p(F.lag("x").over(_w()))
    return frames.withColumn("flux", F.coalesce(F.greatest(rise, F.lit(0.0)), F.lit(0.0)))


def normalize(frames: DataFrame, low: float = 0.10, high: float = 0.995) -> DataFrame:
    """``y`` = sqrt of x clipped between two exact quantiles of its track."""
    q = frames.groupBy("track_id").agg(F.percentile("x", F.lit(low)).alias("lo"), F.percentile("x", F.lit(high)).alias("hi"))
    return frames.join(q, "track_id").select(*frames.columns, F.sqrt(clip((F.col("x") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8)))).alias("y"))


def noise_gate(frames: DataFrame, least: float) -> DataFrame:
    return frames.where(F.col("x") >= least)


def local_median(frames: DataFrame, half: int = 32) -> DataFrame:
    """``med``: median of the frames up to ``half`` away."""
    return frames.withColumn("med", F.percentile("x", F.lit(0.5)).over(_w().rowsBetween(-half, half)))


def peaks(frames: DataFrame, threshold: float) -> DataFrame:
    """Interior frames at least as high as the one before, higher than the next, and up to ``threshold``."""
    rows = frames.withColumn("p", F.lag("x").over(_w())).withColumn("n", F.lead("x").over(_w()))
    return rows.where((F.col("x") >= F.col("p")) & (F.col("x") > F.col("n")) & (F.col("x") >= threshold)).drop("p", "n")


def prominent(frames: DataFrame, half: int = 8, ratio: float = 0.4) -> DataFrame:
    """Frames that stand out by ``ratio`` of their height over the deeper side's higher valley."""
    rows = frames.withColumn("l", F.min("x").over(_w().rowsBetween(-half, 0))).withColumn("r", F.min("x").over(_w().rowsBetween(0, half)))
    return rows.where((F.col("x") > 0) & (F.col("x") - F.greatest("l", "r") >= F.col("x") * ratio)).drop("l", "r")


def accents(onsets: DataFrame, radius: float = 8.0) -> DataFrame:
    """``accent``: strength at least max(.60, p85 around); under 4 onsets around: .72."""
    frame = f"OVER (PARTITION BY track_id ORDER BY t RANGE BETWEEN {radius}D PRECEDING AND {radius}D FOLLOWING)"
    rows = onsets.select("track_id", "id", "strength", F.expr(f"percentile(strength, 0.85) {frame}").alias("p"), F.expr(f"count(*) {frame}").alias("n"))
    return rows.select("track_id", "id", (F.col("strength") >= F.when(F.col("n") < 4, 0.72).otherwise(F.greatest(F.lit(0.6), "p"))).alias("accent"))


def activity_bins(onsets: DataFrame, end: float, points: int) -> DataFrame:
    """Mean, to six decimals, and greatest strength in ``points`` equal bins of [0, end).

    The mean comes of whole millionths, so no order of summing changes its rounding.
    """
    rows = onsets.where((F.col("t") >= 0) & (F.col("t") < end)).withColumn("bin", F.floor(F.col("t") * points / end))
    sums = rows.groupBy("track_id", "bin").agg(F.sum(F.round(F.col("strength") * 1e6).cast("long")).alias("s"), F.count("*").alias("n"), F.max("strength").alias("most"))
    return sums.select("track_id", "bin", (F.expr("(2 * s + n) div (2 * n)") / 1e6).alias("mean"), "most")


def pitch_runs(onsets: DataFrame) -> DataFrame:
    """Runs of one kind: ``track_id, run, kind, t0, t1, n``."""
    w = Window.partitionBy("track_id").orderBy("t", "id")
    rows = onsets.withColumn("new", F.coalesce((F.col("kind") != F.lag("kind").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    return rows.groupBy("track_id", "run").agg(F.first("kind").alias("kind"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"))


def estimate_bpm(onsets: DataFrame) -> DataFrame:
    """``bpm`` from the median interval, after intervals too far from it are left out."""
    w = Window.partitionBy("track_id").orderBy("t", "id")
    gaps = onsets.select("track_id", (F.col("t") - F.lag("t").over(w)).alias("gap")).where("gap IS NOT NULL")
    med = gaps.groupBy("track_id").agg(F.percentile("gap", F.lit(0.5)).alias("m"))
    far = gaps.join(med, "track_id").withColumn("d", F.abs(F.col("gap") - F.col("m")))
    mad = far.groupBy("track_id").agg(F.percentile("d", F.lit(0.5)).alias("mad"))
    kept = far.join(mad, "track_id").where(F.col("d") <= F.greatest(F.col("mad") * 3, F.lit(0.03)))
    return kept.groupBy("track_id").agg((60 / F.percentile("gap", F.lit(0.5))).alias("bpm"), F.stddev_pop("gap").alias("spread"), F.count("*").alias("n"))


def first_strong(frames: DataFrame) -> DataFrame:
    """First frame of at least .4 of the track's greatest and greatest within two frames."""
    rows = frames.withColumn("top", F.max("x").over(Window.partitionBy("track_id"))).withColumn("near", F.max("x").over(_w().rowsBetween(-2, 2)))
    return rows.where((F.col("x") >= F.col("top") * 0.4) & (F.col("x") == F.col("near"))).groupBy("track_id").agg(F.min("frame").alias("frame"))


def beat_support(frames: DataFrame) -> DataFrame:
    q = frames.groupBy("track_id").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    dev = frames.join(q, "track_id").withColumn("d", F.col("x") - F.col("m"))
    p = dev.groupBy("track_id").agg(F.percentile(F.abs("d"), F.lit(0.9)).alias("p"))
    return dev.join(p, "track_id").select("track_id", "frame", clip(F.col("d") / F.greatest("p", F.lit(1e-9))).alias("support"))


def autocorrelation(frames: DataFrame, lags: range) -> DataFrame:
    """Mean-removed cosine of each series with itself ``lag`` frames on.

    All lags come from one sorted pass: a frame of the window per lag, which holds
    the row with exactly that number or none.
    """
    mean = frames.groupBy("track_id").agg(F.avg("x").alias("mu"))
    rows = frames.join(mean, "track_id").select("track_id", F.col("frame").cast("long").alias("frame"), (F.col("x") - F.col("mu")).alias("y"))
    rows = rows.select("track_id", "y", *[F.first("y").over(_w().rangeBetween(-k, -k)).alias(f"y{k}") for k in lags])
    both = lambda k, a, b: F.sum(F.when(F.col(f"y{k}").isNotNull(), F.col(a) * F.col(b)))
    each = [(both(k, "y", f"y{k}") / F.sqrt(both(k, "y", "y") * both(k, f"y{k}", f"y{k}"))).alias(f"r{k}") for k in lags]
    some = [F.count(f"y{k}").alias(f"n{k}") for k in lags]
    sums = rows.groupBy("track_id").agg(*each, *some)
    stacked = F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r"), F.col(f"n{k}").alias("n")) for k in lags]))
    return sums.select("track_id", stacked).where("n > 0").drop("n")


def local_threshold(frames: DataFrame, half: int = 32, k: float = 3.0, floor: float = 0.1) -> DataFrame:
    """``threshold``: max(floor, median + k MAD) of the frames up to ``half`` away."""
    near = _w().rowsBetween(-half, half)
    rows = frames.withColumn("med", F.percentile("x", F.lit(0.5)).over(near)).withColumn("xs", F.collect_list("x").over(near))
    d = F.sort_array(F.transform("xs", lambda x: F.abs(x - F.col("med"))))
    n = F.size("xs")
    mad = (F.get(d, F.floor((n - 1) / 2).cast("int")) + F.get(d, F.floor(n / 2).cast("int"))) / 2
    return rows.withColumn("threshold", F.greatest(F.lit(floor), F.col("med") + k * mad)).drop("med", "xs")


def attack_start(frames: DataFrame, floor: float, lookback: int = 64) -> DataFrame:
    """``start``: the frame where the rise to each frame begins, at most ``lookback`` before it."""
    p = F.lag("x").over(_w())
    breaks = ~F.coalesce((p > floor) & (p <= F.col("x")), F.lit(False))
    rows = frames.withColumn("at", F.when(breaks, F.col("frame")))
    return rows.withColumn("start", F.greatest(F.max("at").over(_w()), F.col("frame") - lookback)).drop("at")


def span_means(frames: DataFrame, spans: DataFrame, width: float = 64.0) -> DataFrame:
    """``track_id, t0, mean, n`` of the frames in each span ``(track_id, t0, t1)``; spans without frames have no row."""
    found = joins.contained(frames.select("track_id", F.col("frame").cast("double").alias("t"), "x"), spans, "s", width)
    return found.where("s IS NOT NULL").groupBy("track_id", F.col("s.ft").alias("t0")).agg(F.avg("x").alias("mean"), F.count("*").alias("n"))
