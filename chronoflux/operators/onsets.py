"""Onsets of a frame series: two extractors, close peaks told apart by the valley between, and reports over both.

``novelty`` is ``track_id, frame, x, low, mid, high`` (0 to 1; x is all bands) and ``loud`` (whether any
band is above the noise).  ``track_id`` may be a struct, so one pass serves several settings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoflux.functions.columns import clip

from . import matching, scores, signal
from .folds import fold

#: Band edges in Hz, noise floor of a band's raw flux, least threshold, its percentile, valley ratio.
BANDS, NOISE, FLOOR, SHARE, VALLEY = {"low": (20, 180), "mid": (180, 4000), "high": (4000, 16000)}, 1e-6, 0.10, 0.75, 0.55
#: Stages of the second extractor, one mechanism more each.
STAGES = {"v1": None, "v2_flux": {"local": False, "dense": False}, "v2_flux_local": {"local": True, "dense": False}, "v2": {}, "v2_gate_off": {"gate": False}}


def band_novelty(spectrum: DataFrame, per_bin: bool = True, noise: float = NOISE) -> DataFrame:
    """Novelty of ``spectrum(track_id, frame, freq, mag)``: flux by band and of all bands, each scaled by its track's quantiles.

    ``per_bin``: rises of each bin, the mean of the positive parts over a band's bins; else the
    rise of the band's mean.  A frame is loud if a band's raw flux reaches ``noise``.
    """
    w = Window.partitionBy("track_id", "freq").orderBy("frame")
    band = F.lit(None).cast("string")
    for name, (low, high) in BANDS.items():
        band = F.when((F.col("freq") >= low) & (F.col("freq") < high), name).otherwise(band)
    rows = spectrum.withColumn("band", band).where("band IS NOT NULL")
    if per_bin:
        rise = F.coalesce(F.greatest(F.log1p("mag") - F.log1p(F.lag("mag").over(w)), F.lit(0.0)), F.lit(0.0))
        bands = rows.withColumn("rise", rise).groupBy("track_id", "frame", "band").agg(F.avg("rise").alias("flux"))
    else:
        mean = rows.groupBy("track_id", "frame", "band").agg(F.avg("mag").alias("mag"))
        rise = F.log1p("mag") - F.log1p(F.lag("mag").over(Window.partitionBy("track_id", "band").orderBy("frame")))
        bands = mean.select("track_id", "frame", "band", F.coalesce(F.greatest(rise, F.lit(0.0)), F.lit(0.0)).alias("flux"))
    own = lambda b: F.coalesce(F.max(F.when(F.col("band") == b, F.col("flux"))), F.lit(0.0)).alias(f"r_{b}")
    raw = bands.groupBy("track_id", "frame").agg(*[own(b) for b in BANDS]).withColumn("r_x", sum((F.col(f"r_{b}") for b in BANDS), F.lit(0.0)))
    names = ["x", *BANDS]
    edges = raw.groupBy("track_id").agg(*[F.percentile(f"r_{n}", F.array(F.lit(0.10), F.lit(0.995))).alias(f"q_{n}") for n in names])
    scaled = [F.sqrt(clip((F.col(f"r_{n}") - F.col(f"q_{n}")[0]) / F.greatest(F.col(f"q_{n}")[1] - F.col(f"q_{n}")[0], F.lit(1e-8)))).alias(n) for n in names]
    return raw.join(edges, "track_id").select("track_id", "frame", *scaled, (F.greatest(*[f"r_{b}" for b in BANDS]) >= noise).alias("loud"))


def _w(*key: str) -> object:
    return Window.partitionBy(*key).orderBy("frame")


def valleys(peaks: DataFrame, frames: DataFrame, reach: int) -> DataFrame:
    """``peaks(track_id, frame, x)`` with ``near``: the peaks less than ``reach`` frames away, each with its height and the lowest frame between.

    Frames go to the peak at or before them, so one grouping gives the minimum between
    each peak and the next; the valley of two peaks is the least of those between.
    """
    marked = frames.select("track_id", "frame", "x").join(peaks.select("track_id", "frame", F.lit(True).alias("peak")), ["track_id", "frame"], "left")
    cell = F.count("peak").over(_w("track_id").rowsBetween(Window.unboundedPreceding, 0))
    low = marked.withColumn("cell", cell).where("cell > 0").groupBy("track_id", "cell").agg(F.min("x").alias("low"))
    ranked = peaks.withColumn("cell", F.row_number().over(_w("track_id"))).join(low, ["track_id", "cell"])
    w = Window.partitionBy("track_id").orderBy("frame").rangeBetween(1 - reach, -1)
    rows = ranked.withColumn("earlier", F.collect_list(F.struct("frame", "x", "low")).over(w))
    between = F.transform(F.col("earlier"), lambda e, k: F.struct(e["frame"].alias("frame"), e["x"].alias("x"), F.least(F.array_min(F.transform(F.slice(F.col("earlier"), k + 1, F.size("earlier")), lambda y: y["low"])), F.col("x")).alias("valley")))
    pairs = rows.select("track_id", "frame", "x", F.explode(between).alias("o"))
    both = pairs.select("track_id", "frame", F.struct(F.col("o.frame").alias("frame"), F.col("o.x").alias("x"), F.col("o.valley").alias("valley")).alias("o")).unionByName(pairs.select("track_id", F.col("o.frame").alias("frame"), F.struct("frame", "x", F.col("o.valley").alias("valley")).alias("o")))
    near = both.groupBy("track_id", "frame").agg(F.collect_list("o").alias("near"))
    return peaks.join(near, ["track_id", "frame"], "left")


def suppress_with_valley(found: DataFrame, ratio: float | Column = VALLEY, reach: int = 12) -> DataFrame:
    """``track_id, frame, x`` of the peaks of ``valleys`` that stay: the highest first, equal ones earlier first.

    A peak goes if one that stays is less than ``reach`` frames away and the lowest frame
    between is above ``ratio`` of the weaker of both.  ``ratio`` may be a column.  One pass
    over an island of peaks with those that stay as its state.
    """
    new = F.when(F.col("frame") - F.lag("frame").over(_w("track_id")) < reach, 0).otherwise(1)
    ratio = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    rows = found.withColumn("new", new).withColumn("island", F.sum("new").over(_w("track_id"))).select("track_id", "island", F.col("frame").cast("long").alias("frame"), "x", "near", ratio.cast("double").alias("ratio"))

    def step(kept: set, frame: int, x: float, near: list | None, ratio: float) -> list[tuple]:
        for o in near or ():
            weaker = min(x, o["x"])
            if o["frame"] in kept and not (weaker > 0 and o["valley"] <= ratio * weaker):
                return []
        kept.add(frame)
        return [(frame, x)]

    return fold(rows, ["track_id", "island"], [F.desc("x"), "frame"], "frame long, x double", set, step).drop("island")


def candidates(novelty: DataFrame, local: bool = True, gate: bool = True) -> DataFrame:
    """``track_id, frame, x, stands``: interior frames at the threshold or above, not below the one before and above the next.

    The threshold is local (``signal.local_threshold``) or the greater of ``FLOOR`` and the
    track's ``SHARE`` quantile; quiet frames go with ``gate``.  ``stands`` is how far a peak
    rises above the higher of both sides' lowest frames within the spacing.
    """
    rows = _thresholded(novelty, local)
    before, after = F.lag("x").over(_w("track_id")), F.lead("x").over(_w("track_id"))
    rows = rows.withColumn("p", before).withColumn("n", after)
    rows = rows.where((F.col("x") >= F.col("threshold")) & (F.col("x") >= F.col("p")) & (F.col("x") > F.col("n")))
    return (rows.where("loud") if gate else rows).select("track_id", "frame", "x")


def _thresholded(novelty: DataFrame, local: bool) -> DataFrame:
    if local:
        return signal.local_threshold(novelty)
    q = novelty.groupBy("track_id").agg(F.greatest(F.lit(FLOOR), F.percentile("x", F.lit(SHARE))).alias("threshold"))
    return novelty.join(q, "track_id")


def prominences(novelty: DataFrame, half: int) -> DataFrame:
    """``track_id, frame, stands`` of every frame: its height over the higher of the lowest frames up to ``half`` before and behind it."""
    low = lambda a, b: F.min("x").over(_w("track_id").rowsBetween(a, b))
    return novelty.select("track_id", "frame", (F.col("x") - F.greatest(low(-half, 0), low(0, half))).alias("stands"))


def picked(novelty: DataFrame, version: int = 2, spacing: int = 8, local: bool = True, dense: bool = True, gate: bool = True, valley: float = VALLEY, prominence: float = 0.0) -> DataFrame:
    """``track_id, frame, x`` of the onsets' frames, as ``extract_onsets`` picks them."""
    if version == 1 or not dense:
        rows = _thresholded(novelty, local and version == 2)
        first = F.first("threshold").over(_w("track_id"))  # the plain picker takes one threshold for a track
        rows = rows.withColumn("least", first).withColumn("p", F.lag("x").over(_w("track_id"))).withColumn("n", F.lead("x").over(_w("track_id")))
        tops = rows.where((F.col("x") >= F.col("p")) & (F.col("x") > F.col("n")) & (F.col("x") >= F.col("least")))
        kept = matching.suppress_close(tops.select("track_id", F.col("frame").cast("double").alias("t"), "x"), spacing - 1.0)
        return kept.select("track_id", F.col("t").cast("long").alias("frame"), "x")
    found = candidates(novelty, local, gate)
    if prominence > 0:
        found = found.join(prominences(novelty, spacing), ["track_id", "frame"]).where((F.col("x") > 0) & (F.col("stands") >= prominence * F.col("x"))).drop("stands")
    return suppress_with_valley(valleys(found, novelty, spacing), valley, spacing)


def extract_onsets(novelty: DataFrame, rate: float, version: int = 2, spacing: int = 8, **options: object) -> DataFrame:
    """``track_id, id, frame, raw_time, strength, low, mid, high, confidence`` of a track's onsets, numbered in time; version 2 adds ``refined_time``.

    Version 1: one threshold for a track, and of peaks closer than ``spacing`` frames the
    higher stays.  Version 2: a threshold from what is around, quiet frames left out, and
    close peaks stay where the signal falls between them; ``refined_time`` is where the
    rise to the peak begins.  Figures have four decimals, confidence three, .05 to 1.
    """
    if version not in (1, 2):
        raise ValueError(f"no version {version}")
    kept = picked(novelty, version, spacing, **options).select("track_id", "frame")
    rows = novelty if version == 1 else signal.attack_start(novelty, FLOOR)
    rows = rows.join(kept, ["track_id", "frame"])
    r4 = lambda c: F.round(c, 4)
    out = [r4(F.col("frame") / rate).alias("raw_time"), r4(F.col("x")).alias("strength"), *[r4(F.col(b)).alias(b) for b in BANDS], F.round(clip(F.col("x"), 0.05, 1.0), 3).alias("confidence")]
    out += [r4(F.col("start") / rate).alias("refined_time")] if version == 2 else []
    return rows.select("track_id", F.row_number().over(_w("track_id")).alias("id"), "frame", *out)


def parameter_sweep(novelty: DataFrame, truth: DataFrame, values: list[float], tol: float, parameter: str = "valley", spacing: int = 8) -> DataFrame:
    """``value, precision, recall, f1, tracks``: mean scores over tracks of version 2 at each value of ``valley`` or ``prominence``.

    Novelty, thresholds, peaks and valleys are made once; only peaks are fanned out
    over the values.  ``truth(track_id, idx, t)`` is in frames.
    """
    table = F.explode(F.array(*[F.lit(float(v)) for v in values])).alias("value")
    found = candidates(novelty)
    if parameter == "prominence":
        found = found.join(prominences(novelty, spacing), ["track_id", "frame"])
    near = valleys(found.select("track_id", "frame", "x"), novelty, spacing)
    if parameter == "prominence":
        near = near.join(found.select("track_id", "frame", "stands"), ["track_id", "frame"])
    fanned = near.select("*", table)
    if parameter == "prominence":
        fanned = fanned.where((F.col("value") <= 0) | (F.col("x") > 0) & (F.col("stands") >= F.col("value") * F.col("x")))
    elif parameter != "valley":
        raise ValueError(f"no parameter {parameter}")
    both = F.struct("track_id", "value").alias("track_id")
    kept = suppress_with_valley(fanned.withColumn("v", F.col("value")).select(both, "frame", "x", "near", "v"), F.col("v") if parameter == "valley" else VALLEY, spacing)
    estimate = kept.select("track_id", F.col("frame").alias("idx"), F.col("frame").cast("double").alias("t"))
    reference = truth.select("*", table).select(both, "idx", "t")
    rows = scores.prf(scores.mutual_pairs(reference, estimate, tol), reference, estimate)
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 4).alias(c)
    return rows.groupBy(F.col("track_id.value").alias("value")).agg(mean("precision"), mean("recall"), mean("f1"), F.count("*").alias("tracks"))


def ablation_stages(plain: DataFrame, novelty: DataFrame, spacing: int = 8) -> DataFrame:
    """``stage, track_id, frame`` of every stage of ``STAGES``: ``plain`` is the novelty of version 1."""
    out = None
    for name, options in STAGES.items():
        kept = picked(plain, 1, spacing) if options is None else picked(novelty, 2, spacing, **options)
        own = kept.select(F.lit(name).alias("stage"), "track_id", "frame")
        out = own if out is None else out.unionByName(own)
    return out


def stage_count_report(stages: DataFrame) -> DataFrame:
    """``track_id`` (null: all) and the onsets of each stage, ``ratio`` (v2 to v1) and ``gated`` (what the gate takes away)."""
    counts = stages.rollup("track_id").agg(*[F.count_if(F.col("stage") == n).alias(n) for n in STAGES])
    return counts.withColumn("ratio", F.round(F.col("v2") / F.greatest("v1", F.lit(1)), 4)).withColumn("gated", F.col("v2_gate_off") - F.col("v2"))


def tempo_from_novelty(novelty: DataFrame, rate: float, least: float = 0.6, apart: float = 0.12, slow: float = 60.0, fast: float = 180.0) -> DataFrame:
    """``track_id, bpm`` from a novelty curve of ``rate`` frames a second; 0 where it has no steady pulse.

    Peaks are at the greater of ``least`` and the track's 78th percentile, ``apart`` seconds
    or more from a higher one; it takes three of them, and intervals whose MAD is at
    most .3 of their median.  The lag between ``fast`` and ``slow`` of the greatest
    autocorrelation (first of equal ones) gives the tempo, doubled or halved into 80
    to 160, two decimals.  All lags come from one sorted pass.
    """
    q = novelty.groupBy("track_id").agg(F.greatest(F.lit(least), F.percentile("x", F.lit(0.78))).alias("threshold"), F.avg("x").alias("mean"), F.count("*").alias("n"), F.max("x").alias("top"))
    rows = novelty.select("track_id", F.col("frame").cast("long").alias("frame"), "x").join(q, "track_id")
    tops = rows.withColumn("p", F.lag("x").over(_w("track_id"))).withColumn("f", F.lead("x").over(_w("track_id"))).where((F.col("x") >= F.col("p")) & (F.col("x") > F.col("f")) & (F.col("x") >= F.col("threshold")))
    kept = matching.suppress_close(tops.select("track_id", F.col("frame").cast("double").alias("t"), "x"), max(1, int(apart * rate)) - 1.0)
    gaps = kept.select("track_id", (F.col("t") - F.lag("t").over(Window.partitionBy("track_id").orderBy("t"))).alias("gap")).where("gap IS NOT NULL")
    middle = gaps.groupBy("track_id").agg(F.percentile("gap", F.lit(0.5)).alias("m"), F.count("*").alias("gaps"))
    spread = gaps.join(middle, "track_id").groupBy("track_id", "m", "gaps").agg(F.percentile(F.abs(F.col("gap") - F.col("m")), F.lit(0.5)).alias("mad"))
    steady = spread.where("gaps >= 2 AND m > 0 AND mad / m <= 0.3").select("track_id")
    low, high = max(1, int(60 * rate / fast)), int(60 * rate / slow)
    y = rows.select("track_id", "frame", "n", (F.col("x") - F.col("mean")).alias("y"))
    lags = range(low, high + 1)
    each = y.select("track_id", "n", *[(F.col("y") * F.first("y").over(_w("track_id").rangeBetween(-k, -k))).alias(f"y{k}") for k in lags])
    sums = each.groupBy("track_id").agg(F.max("n").alias("n"), *[F.coalesce(F.sum(f"y{k}"), F.lit(0.0)).alias(f"c{k}") for k in lags])
    best = sums.select("track_id", "n", F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("c")) for k in lags]))).where(f"lag <= n - 1 AND least({high}, n - 1) > {low}")
    best = best.groupBy("track_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "lag"))["lag"].alias("lag"))
    raw = 60.0 * rate / F.col("lag")
    up = F.when(raw < 80, raw * F.pow(F.lit(2.0), F.ceil(F.log2(80 / raw)))).otherwise(raw)
    bpm = F.when(up > 160, up / F.pow(F.lit(2.0), F.ceil(F.log2(up / 160)))).otherwise(up)
    found = best.join(steady, "track_id", "left_semi").select("track_id", F.round(bpm, 2).alias("bpm"))
    return q.where("n >= 4 AND top > 0").select("track_id").join(found, "track_id", "left").select("track_id", F.coalesce("bpm", F.lit(0.0)).alias("bpm")).unionByName(q.where("n < 4 OR top <= 0").select("track_id", F.lit(0.0).alias("bpm")))


def legacy_band_peaks(bands: DataFrame, grid: DataFrame, rate: float, spacing: dict[str, float], steps: int = 16) -> DataFrame:
    """``track_id, band, frame, confidence, nearest_step, bar, beat, step_in_bar, velocity`` of each band's peaks.

    ``bands(track_id, band, frame, x)``, ``grid(track_id, bpm, origin)``.  A band's threshold is its
    72nd percentile, .08 at least; peaks rise above the frame before, are not below the
    next one and ``spacing`` seconds from a higher one.  Places on the grid are null
    without a tempo.
    """
    both = F.struct("track_id", "band").alias("track_id")
    rows = bands.select(both, F.col("frame").cast("long").alias("frame"), "x")
    q = rows.groupBy("track_id").agg(F.greatest(F.lit(0.08), F.percentile("x", F.lit(0.72))).alias("threshold"))
    rows = rows.join(q, "track_id").withColumn("p", F.lag("x").over(_w("track_id"))).withColumn("n", F.lead("x").over(_w("track_id")))
    tops = rows.where((F.col("x") > F.col("p")) & (F.col("x") >= F.col("n")) & (F.col("x") >= F.col("threshold")))
    kept = None
    for band, seconds in spacing.items():
        own = matching.suppress_close(tops.where(F.col("track_id.band") == band).select("track_id", F.col("frame").cast("double").alias("t"), "x"), max(1, int(seconds * rate)) - 1.0)
        kept = own if kept is None else kept.unionByName(own)
    confidence = F.round(clip(F.col("x") / (F.col("threshold") + 1e-8), 0.05, 1.0), 3)
    found = kept.join(q, "track_id").select("track_id.track_id", "track_id.band", F.col("t").cast("long").alias("frame"), confidence.alias("confidence")).join(grid, "track_id", "left")
    step = 60 / F.when(F.col("bpm") > 0, F.col("bpm")) / (steps / 4)
    nearest = F.greatest(F.lit(0), F.bround((F.col("frame") / rate - F.col("origin")) / step)).cast("long")
    found = found.withColumn("nearest_step", nearest)
    at = F.col("nearest_step")
    return found.select("track_id", "band", "frame", "confidence", "nearest_step", (F.floor(at / steps) + 1).alias("bar"), (F.floor(at % steps / (steps // 4)) + 1).alias("beat"), (at % steps + 1).alias("step_in_bar"), F.greatest(F.lit(1), F.least(F.lit(127), F.bround(127 * F.col("confidence")))).cast("int").alias("velocity"))
