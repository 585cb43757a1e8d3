"""Bars of a track as views, how alike they are, and the segments and families that follow.

Long form: ``track_id, bar, col, x`` (a view) and ``track_id, i, j, sim`` (pairs of bars).
Null and non-finite values count as 0; a track without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoflux.functions.columns import clip
from chronoflux.sources.store import stored

from . import joins
from .folds import fold


def _fine(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def structure_spans(beats: DataFrame, duration: DataFrame) -> DataFrame:
    """``track_id, bar, t0, t1``: bars between downbeats, numbered anew from 1.

    The last one has four times the median of the track's last eight beat intervals,
    within the track; shorter than one such interval it goes.
    """
    w = Window.partitionBy("track_id").orderBy("t")
    gaps = beats.select("track_id", "t", (F.col("t") - F.lag("t").over(w)).alias("gap")).where("gap IS NOT NULL")
    last = gaps.withColumn("back", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("t")))).where("back <= 8")
    step = last.groupBy("track_id").agg(F.percentile("gap", F.lit(0.5)).alias("step"))
    downs = beats.where("beat_in_bar = 1").select("track_id", F.col("t").alias("t0"), F.row_number().over(w).alias("bar"), F.lead("t").over(w).alias("next"))
    rows = downs.join(step, "track_id", "left").join(duration, "track_id")
    end = F.coalesce("next", F.least(F.col("t0") + 4 * F.col("step"), "duration"))
    rows = rows.withColumn("t1", end)
    return rows.where(F.col("t1") - F.col("t0") >= F.when(F.col("next").isNull(), F.col("step")).otherwise(0.0)).select("track_id", "bar", "t0", "t1")


def median_over_bars(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """``track_id, bar, x``: median of the frames ``(track_id, t, x)`` in each bar."""
    found = joins.contained(frames, spans, "b").where("b.bar IS NOT NULL")
    return found.groupBy("track_id", F.col("b.bar").alias("bar")).agg(F.percentile("x", F.lit(0.5)).alias("x"))


def band_means(frames: DataFrame, spans: DataFrame, rate: float) -> DataFrame:
    """``track_id, bar, x``: mean of frames floor(t0 * rate) to ceil(t1 * rate), at least one."""
    low, high = F.floor(F.col("t0") * rate), F.ceil(F.col("t1") * rate)
    rows = spans.select("track_id", "bar", F.explode(F.sequence(low, F.greatest(high - 1, low))).alias("frame"))
    return rows.join(frames, ["track_id", "frame"]).groupBy("track_id", "bar").agg(F.avg("x").alias("x"))


def level_normalized(view: DataFrame) -> DataFrame:
    """Each column over its median absolute value (0 where that is at most 1e-9), each bar of length one."""
    fine = view.withColumn("x", _fine(F.col("x")))
    level = fine.groupBy("track_id", "col").agg(F.percentile(F.abs("x"), F.lit(0.5)).alias("m"))
    rows = fine.join(level, ["track_id", "col"]).withColumn("x", F.when(F.col("m") > 1e-9, F.col("x") / F.col("m")).otherwise(0.0)).drop("m")
    n = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("track_id", "bar")))
    return rows.withColumn("n", n).withColumn("x", F.when(F.col("n") > 1e-9, F.col("x") / F.col("n")).otherwise(0.0)).drop("n")


def energy_view(bars: DataFrame) -> DataFrame:
    """``track_id, bar, level, low, high``: log level to the track's median within 4, and a little of the band shares."""
    med = bars.groupBy("track_id").agg(F.percentile("rms", F.lit(0.5)).alias("m"))
    total = F.greatest(F.col("low") + F.col("high"), F.lit(1e-9))
    level = F.ln(F.greatest("rms", F.lit(1e-9)) / F.greatest("m", F.lit(1e-9)))
    return bars.join(med, "track_id").select("track_id", "bar", clip(level, -4.0, 4.0).alias("level"), (F.col("low") / total * 0.12).alias("low"), (F.col("high") / total * 0.12).alias("high"))


def rhythm_view(onsets: DataFrame, spans: DataFrame, steps: int = 16) -> DataFrame:
    """``track_id, bar, band, step``: where a band of an onset reaches half the onset's strongest one."""
    found = joins.contained(onsets, spans, "b").where("b.bar IS NOT NULL")
    step = F.floor((F.col("t") - F.col("b.ft")) / (F.col("b.t1") - F.col("b.ft")) * steps)
    top = F.greatest("low", "mid", "high")
    bands = F.array_compact(F.array(*[F.when((F.col(b) > 0) & (F.col(b) >= top * 0.5), F.lit(b)) for b in ("low", "mid", "high")]))
    return found.select("track_id", F.col("b.bar").alias("bar"), F.explode(bands).alias("band"), F.least(step, F.lit(steps - 1)).alias("step")).distinct()


def combined(pairs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``track_id, i, j, sim`` of views ``(view, track_id, i, j, sim)``: weights of the views a track has come to 1,
    then the median with the pairs a bar earlier and a bar later, as far as there are any."""
    w = F.lit(0.0)
    for name, value in weights.items():
        w = F.when(F.col("view") == name, F.lit(value)).otherwise(w)
    rows = pairs.withColumn("w", w).groupBy("track_id", "i", "j").agg((F.sum(F.col("w") * F.col("sim")) / F.sum("w")).alias("sim"))
    moved = rows.select("track_id", F.inline(F.array(*[F.struct((F.col("i") + k).alias("i"), (F.col("j") + k).alias("j"), "sim") for k in (-1, 0, 1)])))
    near = moved.join(rows.select("track_id", "i", "j"), ["track_id", "i", "j"], "left_semi")
    return near.groupBy("track_id", "i", "j").agg(F.percentile("sim", F.lit(0.5)).alias("sim"))


#: Bars along a side of the tiles that pairs are made in.
TILE = 128


def combined_views(view: DataFrame, views: dict[str, tuple[int, int]], weights: dict[str, float]) -> DataFrame:
    """``combined`` of the cosines (0 to 1) of all pairs of a track's bars in the columns, both ends in, of each of ``views``.

    Pairs are as many as the bars squared, but none is dealt out: a tile of ``TILE`` by
    ``TILE`` pairs gets its bars and the one before and behind, from which its medians
    follow.  A pair takes the columns that both bars have; nulls count for nothing.
    """
    columns = sorted({c for low, high in views.values() for c in range(low, high + 1)})
    names, tile, k = list(views), TILE, len(columns)
    member = np.array([[low <= c <= high for c in columns] for low, high in views.values()])
    w = [float(weights[n]) for n in names]

    def laid(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each list its bars, values (null: NaN), which columns are there and which have a value."""
        rows, ends = column.flatten(), np.cumsum(column.value_lengths().to_numpy())
        bars, there, x = rows.field("bar").to_numpy(), rows.field("there").to_numpy(), rows.field("v").flatten()
        values, valid = x.to_numpy(zero_copy_only=False).reshape(-1, k), x.is_valid().to_numpy(zero_copy_only=False).reshape(-1, k)
        return [(bars[p:q], values[p:q], there[p:q], valid[p:q]) for p, q in zip([0, *ends[:-1]], ends, strict=True)]

    def placed(rows: tuple, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, there, valid = np.zeros((tile + 2, k)), np.zeros((tile + 2, k), bool), np.zeros((tile + 2, k), bool)
        at = rows[0] - block * tile + 1
        valid[at] = rows[3]
        x[at] = np.where(rows[3], rows[1], 0.0)
        there[at] = rows[2][:, None] >> np.arange(k) & 1 == 1
        return x, there, valid

    def similar(a: tuple, b: tuple) -> np.ndarray:
        """Weighted mean similarity, NaN where there is no pair."""
        total, weight = np.zeros((tile + 2, tile + 2)), np.zeros((tile + 2, tile + 2))
        for n, own in enumerate(member):
            dot, left, right = (np.zeros_like(total) for _ in range(3))
            pair, both = np.zeros(total.shape, bool), np.zeros(total.shape, bool)
            for c in np.flatnonzero(own):
                x, y, met = a[0][:, c, None], b[0][None, :, c], a[1][:, c, None] & b[1][None, :, c]
                dot += x * y
                left += np.where(met, x * x, 0.0)
                right += np.where(met, y * y, 0.0)
                pair |= met
                both |= a[2][:, c, None] & b[2][None, :, c]
            sim = dot / np.maximum(np.sqrt(left) * np.sqrt(right), 1e-12)
            sim = np.where(np.isnan(sim), 1.0, np.clip(sim, 0.0, 1.0))  # NaN is the greatest value
            total += np.where(pair, w[n] * np.where(both, sim, 0.0), 0.0)
            weight += np.where(pair, w[n], 0.0)
        return np.where(weight > 0, total / np.where(weight > 0, weight, 1.0), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, (p, q, left, right) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), laid(batch.column(3)), laid(batch.column(4)), strict=True)):
                with np.errstate(all="ignore"):
                    sim = similar(placed(left, p), placed(right, q))
                near = np.sort(np.stack([sim[:-2, :-2], sim[1:-1, 1:-1], sim[2:, 2:]]), axis=0)  # NaN last
                n = np.isfinite(near).sum(axis=0)
                middle = np.where(n == 3, near[1], np.where(n == 2, 0.5 * near[0] + 0.5 * near[1], near[0]))
                i, j = np.nonzero(np.isfinite(sim[1:-1, 1:-1]))
                if len(i):
                    track = batch.column(0).take(pa.array(np.full(len(i), r)))
                    yield pa.RecordBatch.from_arrays([track, pa.array(i + p * tile), pa.array(j + q * tile), pa.array(middle[i, j])], names=["track_id", "i", "j", "sim"])

    mask = lambda c: F.max(F.when(F.col("col") == c, F.lit(1 << columns.index(c))).otherwise(0)).cast("long")
    bars = view.where(F.col("col").isin(columns)).groupBy("track_id", F.col("bar").cast("long").alias("bar")).agg(F.array(*[F.max(F.when(F.col("col") == c, F.col("x").cast("double"))) for c in columns]).alias("v"), sum((mask(c) for c in columns), F.lit(0).cast("long")).alias("there"))
    block = lambda d: F.floor((F.col("bar") + d) / tile)
    blocks = bars.select("track_id", F.struct("bar", "there", "v").alias("x"), F.explode(F.array_distinct(F.array(block(-1), block(0), block(1)))).alias("block")).groupBy("track_id", "block").agg(F.collect_list("x").alias("xs"))
    blocks = stored(blocks)
    every = blocks.groupBy("track_id").agg(F.collect_list("block").alias("every"))  # a number a tile's side
    met = blocks.join(every, "track_id").select("track_id", "block", "xs", F.explode("every").alias("other"))
    a = met.select("track_id", F.col("block").alias("a"), F.col("other").alias("b"), F.col("xs").alias("left"))
    b = met.select("track_id", F.col("other").alias("a"), F.col("block").alias("b"), F.col("xs").alias("right"))
    kind = view.schema["track_id"].dataType.simpleString()
    return a.join(b.hint("merge"), ["track_id", "a", "b"]).select("track_id", "a", "b", "left", "right").mapInArrow(run, f"track_id {kind}, i long, j long, sim double")


def boundary_candidates(novelty: DataFrame, apart: int = 4, radius: int = 2, factor: float = 1.25, flat: float = 0.25, driven: DataFrame | None = None) -> DataFrame:
    """``track_id, bar, novelty``: strict maxima within ``radius`` above the bed of the curve, ``apart`` bars from the one kept before.

    The bed is what is at most the median (all, if under four); the floor its median
    plus ``factor`` MAD, or plus ``flat`` if that is 0.  The earlier of two near ones stays;
    maxima that are not in ``driven(track_id, bar)``, if given, count for neither.
    """
    med = novelty.groupBy("track_id").agg(F.percentile("novelty", F.lit(0.5)).alias("m"))
    rows = novelty.join(med, "track_id")
    bed = rows.withColumn("low", F.count_if(F.col("novelty") <= F.col("m")).over(Window.partitionBy("track_id"))).where((F.col("low") < 4) | (F.col("novelty") <= F.col("m")))
    centre = bed.groupBy("track_id").agg(F.percentile("novelty", F.lit(0.5)).alias("c"))
    mad = bed.join(centre, "track_id").groupBy("track_id", "c").agg(F.percentile(F.abs(F.col("novelty") - F.col("c")), F.lit(0.5)).alias("mad"))
    floor = F.when(F.col("mad") > 1e-12, F.col("c") + F.col("mad") * factor).otherwise(F.col("c") + flat)
    w = Window.partitionBy("track_id").orderBy("bar")
    top = F.greatest(F.coalesce(F.max("novelty").over(w.rangeBetween(-radius, -1)), F.lit(-1e9)), F.coalesce(F.max("novelty").over(w.rangeBetween(1, radius)), F.lit(-1e9)))
    tops = novelty.withColumn("top", top).join(mad.select("track_id", floor.alias("floor")), "track_id").where((F.col("novelty") >= F.col("floor")) & (F.col("novelty") > F.col("top")))
    tops = tops if driven is None else tops.join(driven, ["track_id", "bar"], "left_semi")

    def step(last: list, bar: int, x: float) -> list[tuple]:
        if last[0] is not None and bar - last[0] < apart:
            return []
        last[0] = bar
        return [(bar, x)]

    return fold(tops.select("track_id", F.col("bar").cast("long").alias("bar"), F.col("novelty").cast("double").alias("novelty")), ["track_id"], ["bar"], "bar long, novelty double", lambda: [None], step)


def segments_from_cuts(cuts: DataFrame, bars: DataFrame) -> DataFrame:
    """``track_id, n, start_bar, end_bar``: from ``cuts(track_id, bar)`` inside ``bars(track_id, bars)``; the first starts at 1, the last ends with the track."""
    inner = cuts.join(bars, "track_id").where("bar > 1 AND bar <= bars").select("track_id", F.col("bar").cast("long").alias("bar"))
    starts = inner.unionByName(bars.select("track_id", F.lit(1).cast("long").alias("bar"))).distinct().join(bars, "track_id")
    w = Window.partitionBy("track_id").orderBy("bar")
    return starts.select("track_id", F.row_number().over(w).alias("n"), F.col("bar").alias("start_bar"), F.coalesce(F.lead("bar").over(w) - 1, "bars").alias("end_bar"))


def segment_dp(costs: DataFrame, bars: DataFrame) -> DataFrame:
    """``track_id, start_bar, end_bar``: the cheapest tiling of bars 1 to ``bars`` by ``costs(track_id, a, b, cost)``.

    Of equal costs (nine decimals) the one with fewer segments counts, then the later
    last start.  One pass over a track's ends keeps the best cost to each and gives it a
    back link, a second one backwards reads the cuts off; a track that cannot be tiled is
    one segment.
    """
    rows = costs.select("track_id", F.col("b").cast("long").alias("b"), F.col("a").cast("long").alias("a"), F.col("cost").cast("double").alias("cost"))
    edges = rows.groupBy("track_id", "b").agg(F.collect_list(F.struct("a", "cost")).alias("edges"))

    def forward(ways: dict, b: int, edges: list) -> list[tuple]:
        options = [(round(ways[e["a"] - 1][0] + e["cost"], 9), ways[e["a"] - 1][1] + 1, -e["a"]) for e in edges if e["a"] - 1 in ways]
        if not options:
            return []
        cost, n, a = min(options)
        ways[b] = (cost, n)
        return [(b, -a)]

    linked = fold(edges, ["track_id"], ["b"], "b long, a long", lambda: {0: (0.0, 0)}, forward)

    def backward(at: list, b: int, a: int | None, bars: int) -> list[tuple]:
        at[0] = bars if at[0] is None else at[0]
        if b == bars and a is None:  # the last bar is no end: one segment
            at[0] = -1
            return [(1, bars)]
        if b != at[0]:
            return []
        at[0] = a - 1
        return [(a, b)]

    ends = bars.select("track_id", F.col("bars").cast("long").alias("bars"))
    every = linked.join(ends, "track_id").where("b <= bars").select("track_id", "b", "a", "bars")
    lost = ends.join(linked.select("track_id", F.col("b").alias("bars")), ["track_id", "bars"], "left_anti").select("track_id", F.col("bars").alias("b"), F.lit(None).cast("long").alias("a"), "bars")
    return fold(every.unionByName(lost), ["track_id"], [F.desc("b")], "start_bar long, end_bar long", lambda: [None], backward)


#: Fixed values of a segment's cost: weights of variance, length and weak boundary, the boundary's reward, bars at least and at most, preferred lengths.
VARIANCE, LENGTH, WEAK, REWARD, FEWEST, MOST, PREFERRED = 0.55, 0.25, 0.20, 0.30, 4, 32, (4, 8, 12, 16)


def block_sums(similar: DataFrame, most: int = MOST) -> DataFrame:
    """``track_id, a, b, total``: sum of all similarities among bars a to b, at most ``most`` bars.

    ``similar(track_id, i, j, sim)`` with i <= j less than ``most`` apart, the diagonal in.  Two
    running sums make the two-dimensional prefix of the band: up each column from the
    diagonal, and then along each row of those; a block is one entry of it.
    """
    band = similar.where((F.col("i") <= F.col("j")) & (F.col("j") - F.col("i") < most))
    column = F.sum("sim").over(Window.partitionBy("track_id", "j").orderBy(F.desc("i")))
    own = F.when(F.col("i") == F.col("j"), F.col("sim")).otherwise(F.lit(None))
    diagonal = F.first(own, ignorenulls=True).over(Window.partitionBy("track_id", "j").orderBy(F.desc("i")))
    rows = band.withColumn("up", 2 * column - diagonal)
    along = F.sum("up").over(Window.partitionBy("track_id", "i").orderBy("j"))
    return rows.select("track_id", F.col("i").alias("a"), F.col("j").alias("b"), along.alias("total"))


def segment_costs(similar: DataFrame, candidates: DataFrame, bars: DataFrame) -> DataFrame:
    """``track_id, a, b, cost`` of every span of ``FEWEST`` to ``MOST`` bars between candidates, the first and the last bar.

    ``candidates(track_id, bar, novelty)`` are starts of segments (bar from 2 on).  A cost is
    ``VARIANCE`` * mean dissimilarity of its pairs of bars, ``LENGTH`` * distance from the
    nearest preferred length, and, unless it ends the track, ``WEAK`` * (1 - novelty) less
    ``REWARD`` * novelty of the boundary behind it.
    """
    cuts = candidates.select("track_id", F.col("bar").cast("long").alias("bar"), "novelty")
    starts = cuts.select("track_id", F.col("bar").alias("a")).unionByName(bars.select("track_id", F.lit(1).cast("long").alias("a"))).distinct()
    ends = cuts.select("track_id", (F.col("bar") - 1).alias("b"), F.col("novelty").alias("v")).unionByName(bars.select("track_id", F.col("bars").cast("long").alias("b"), F.lit(None).cast("double").alias("v")))
    spans = starts.select("track_id", "a", F.explode(F.sequence(F.col("a") + FEWEST - 1, F.col("a") + MOST - 1)).alias("b")).join(ends, ["track_id", "b"])
    rows = spans.join(block_sums(similar), ["track_id", "a", "b"])
    n = F.col("b") - F.col("a") + 1
    variance = clip(1 - (F.col("total") - n) / (n * (n - 1)))
    length = F.least(*[F.abs(n - p) / F.lit(float(p)) for p in PREFERRED])
    edge = F.coalesce(WEAK * (1 - F.col("v")) - REWARD * F.col("v"), F.lit(0.0))
    return rows.select("track_id", "a", "b", (VARIANCE * variance + LENGTH * length + edge).alias("cost"))


#: Bars a task compares at once, those within reach apart.
STRIP = 512


def bands_within(views: dict[str, DataFrame], reach: int, weights: dict[str, float]) -> DataFrame:
    """``track_id, i, j, sim`` and a column per view: bars i <= j at most ``reach`` apart.

    A view's column is the cosine (0 to 1) of its rows, 1 on the diagonal, null where it lacks
    a bar; ``sim`` is ``combined`` of them by ``weights``.  A strip of ``STRIP`` bars gets the bars
    its pairs and their medians reach, so only bars are dealt out: no pair is joined,
    shuffled or grouped.
    """
    names, strip = list(views), STRIP
    every = None
    for n, view in enumerate(views.values()):
        own = view.where("bar IS NOT NULL").select("track_id", F.col("bar").cast("long").alias("bar"), F.lit(n).alias("view"), "col", _fine(F.col("x").cast("double")).alias("x"))
        every = own if every is None else every.unionByName(own)

    def laid(bar: np.ndarray, col: np.ndarray, x: np.ndarray, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        columns, at = np.unique(col, return_inverse=True)
        there, v = np.zeros(n, bool), np.zeros((n, len(columns)))
        there[bar - first] = True
        v[bar - first, at] = x
        return there, v

    def similar(there: np.ndarray, v: np.ndarray) -> np.ndarray:
        """A row per bar, a column per distance up to ``reach``; NaN where there is no pair."""
        out, norm = np.full((len(v), reach + 1), np.nan), np.sqrt((v * v).sum(1))
        out[there, 0] = 1.0
        for d in range(1, min(reach, len(v) - 1) + 1):
            size = norm[:-d] * norm[d:]
            sim = (v[:-d] * v[d:]).sum(1) / np.where(size == 0, 1.0, size)
            sim = np.where(np.isnan(sim), 1.0, np.clip(np.where(size == 0, 0.0, sim), 0.0, 1.0))  # NaN is the greatest value
            out[:-d, d] = np.where(there[:-d] & there[d:], sim, np.nan)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, strip_no in enumerate(batch.column(1).to_pylist()):
                rows = batch.column(2).slice(r, 1).flatten()
                bar, view, col, x = (rows.field(c).to_numpy() for c in ("bar", "view", "col", "x"))
                first, n = strip_no * strip - 1, strip + reach + 2
                with np.errstate(all="ignore"):
                    own = [similar(*laid(bar[view == k], col[view == k], x[view == k], first, n)) for k in range(len(names))]
                    total = sum(np.where(np.isnan(sim), 0.0, weights[name] * sim) for name, sim in zip(names, own, strict=True))
                    weight = sum(np.where(np.isnan(sim), 0.0, weights[name]) for name, sim in zip(names, own, strict=True))
                    both = np.where(weight > 0, total / weight, np.nan)
                near = np.sort(np.stack([both[:strip], both[1 : strip + 1], both[2 : strip + 2]]), axis=0)  # NaN last
                m = np.isfinite(near).sum(axis=0)
                middle = np.where(m == 3, near[1], np.where(m == 2, 0.5 * near[0] + 0.5 * near[1], near[0]))
                i, d = np.nonzero(np.isfinite(both[1 : strip + 1]))
                if len(i):
                    track = batch.column(0).take(pa.array(np.full(len(i), r)))
                    found = [pa.array(sim[i + 1, d], mask=np.isnan(sim[i + 1, d])) for sim in own]
                    yield pa.RecordBatch.from_arrays([track, pa.array(i + 1 + first), pa.array(i + 1 + first + d), pa.array(middle[i, d]), *found], names=["track_id", "i", "j", "sim", *names])

    block = lambda d: F.floor((F.col("bar") + d) / strip)
    to = F.sequence(block(-reach - 1), block(1))
    dealt = every.select("track_id", F.explode(to).alias("strip"), F.struct("bar", "view", "col", "x").alias("x")).groupBy("track_id", "strip").agg(F.collect_list("x").alias("xs"))
    kind = next(iter(views.values())).schema["track_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"track_id {kind}, i long, j long, sim double, " + ", ".join(f"`{n}` double" for n in names))


def similar_within(view: DataFrame, reach: int) -> DataFrame:
    """``track_id, i, j, sim``: cosine (0 to 1) of bars i <= j at most ``reach`` apart, 1 on the diagonal."""
    return bands_within({"own": view}, reach, {"own": 1.0}).select("track_id", "i", "j", F.col("own").alias("sim"))


def checkerboard(similar: DataFrame, bars: DataFrame, kernel: int) -> DataFrame:
    """``track_id, bar, novelty``: mean similarity within half a kernel before and behind a cut less that across it.

    The cut is before ``bar``; cuts too near an end have none.  ``similar`` is the band of
    ``similar_within``; each pair counts in the cuts that reach it.
    """
    half = kernel // 2
    near = similar.where(F.col("j") - F.col("i") < kernel)
    cut = near.select("track_id", "i", "j", "sim", F.explode(F.sequence(F.col("j") - half + 1, F.col("i") + half)).alias("bar"))
    times = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    side = F.when(F.col("j") < F.col("bar"), 1).when(F.col("i") >= F.col("bar"), 2).otherwise(0)
    part = lambda s, w: F.coalesce(F.sum(F.when(side == s, F.col("sim") * w)), F.lit(0.0)) / (half * half)
    rows = cut.groupBy("track_id", "bar").agg(((part(1, times) + part(2, times)) / 2 - part(0, F.lit(1.0))).alias("novelty"))
    return rows.join(bars, "track_id").where((F.col("bar") - 1 >= half) & (F.col("bar") - 1 <= F.col("bars") - half)).select("track_id", "bar", "novelty")


def scaled(curve: DataFrame) -> DataFrame:
    """A curve from 0 to 1 by track; a flat one is 0."""
    w = Window.partitionBy("track_id")
    low, high = F.min("novelty").over(w), F.max("novelty").over(w)
    return curve.select("track_id", "bar", F.when(high - low < 1e-12, 0.0).otherwise((F.col("novelty") - low) / (high - low)).alias("novelty"))


def view_boundaries(band: DataFrame, bands: dict[str, DataFrame], bars: DataFrame, kernels: tuple[int, int] = (4, 8), least: float = 0.2, edge: int = 2) -> DataFrame:
    """Boundaries ``track_id, bar, novelty, drivers`` of the combined ``band`` of the views' ``bands``.

    Each kernel's curve over the combined band is scaled where the largest kernel fits,
    and their mean is the novelty.  A boundary is one of ``boundary_candidates`` at least
    ``edge`` bars from both ends at which the raw curve of the first kernel of some view
    reaches ``least``; ``drivers`` maps each view to its scaled curve there.
    """
    half = max(kernels) // 2
    inside = lambda rows: rows.join(bars, "track_id").where((F.col("bar") - 1 >= half) & (F.col("bar") - 1 <= F.col("bars") - half)).drop("bars")
    curves = None
    for k in kernels:
        own = scaled(inside(checkerboard(band, bars, k)))
        curves = own if curves is None else curves.unionByName(own)
    mean = curves.groupBy("track_id", "bar").agg((F.sum("novelty") / len(kernels)).alias("novelty"))
    mean = mean.join(bars, "track_id").where((F.col("bar") - 1 >= edge) & (F.col("bar") - 1 <= F.col("bars") - edge)).drop("bars")
    raw = None
    for name, own in bands.items():
        curve = inside(checkerboard(own, bars, kernels[0])).withColumn("view", F.lit(name))
        raw = curve if raw is None else raw.unionByName(curve)
    w = Window.partitionBy("track_id", "view")
    low, high = F.min("novelty").over(w), F.max("novelty").over(w)
    drivers = raw.withColumn("scaled", F.when(high - low < 1e-12, 0.0).otherwise((F.col("novelty") - low) / (high - low)))
    strong = drivers.groupBy("track_id", "bar").agg(F.max("novelty").alias("top"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("view", F.round("scaled", 4).alias("scaled"))))).alias("drivers"))
    found = boundary_candidates(stored(mean), driven=strong.where(F.col("top") >= least).select("track_id", "bar"))
    return found.join(strong, ["track_id", "bar"]).select("track_id", "bar", F.round("novelty", 4).alias("novelty"), "drivers")


def segment_similarity(segments: DataFrame, view: DataFrame, positions: int = 8) -> DataFrame:
    """``track_id, a, b, sim`` of segments ``(n, start_bar, end_bar)`` a < b: cosine of their rows resampled, times their length ratio (.75 at least).

    Rows go linearly onto ``positions`` places.  Two silent segments are alike, a silent
    and another one not.
    """
    at = F.explode(F.sequence(F.lit(0), F.lit(positions - 1)))
    place = segments.select("track_id", "n", "start_bar", "end_bar", at.alias("k"))
    x = F.col("k") * (F.col("end_bar") - F.col("start_bar")) / F.lit(positions - 1.0)
    place = place.withColumn("x", x).withColumn("bar", F.col("start_bar") + F.floor("x")).withColumn("u", F.col("x") - F.floor("x"))
    both = place.select("track_id", "n", "k", F.inline(F.array(F.struct("bar", (1 - F.col("u")).alias("w")), F.struct((F.col("bar") + 1).alias("bar"), F.col("u").alias("w"))))).where("w > 0")
    rows = both.join(view, ["track_id", "bar"]).groupBy("track_id", "n", "k", "col").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    norm = rows.groupBy("track_id", "n").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = rows.withColumnRenamed("n", "a").join(rows.select("track_id", F.col("n").alias("b"), "k", "col", F.col("x").alias("y")), ["track_id", "k", "col"]).where("a < b").groupBy("track_id", "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    sized = segments.join(norm, ["track_id", "n"], "left").select("track_id", "n", (F.col("end_bar") - F.col("start_bar") + 1).alias("bars"), F.coalesce("norm", F.lit(0.0)).alias("norm"))
    pairs = sized.select("track_id", F.col("n").alias("a"), F.col("bars").alias("x"), F.col("norm").alias("p")).join(sized.select("track_id", F.col("n").alias("b"), F.col("bars").alias("y"), F.col("norm").alias("q")), "track_id").where("a < b").join(dots, ["track_id", "a", "b"], "left")
    quiet = lambda c: F.col(c) < 1e-9
    cosine = F.when(quiet("p") & quiet("q"), 1.0).when(quiet("p") | quiet("q"), 0.0).otherwise(clip(F.coalesce("dot", F.lit(0.0)) / (F.col("p") * F.col("q"))))
    return pairs.select("track_id", "a", "b", (cosine * F.greatest(F.least("x", "y") / F.greatest("x", "y"), F.lit(0.75))).alias("sim"))


#: View weights, a view's veto, how many views below what dissent, least length ratio, places of a segment.
WEIGHTS, VETO, DISSENT, DISSENTING, RATIO, PLACES = {"harmony": 0.34, "timbre": 0.28, "rhythm": 0.23, "energy": 0.15}, 0.55, 0.85, 2, 0.75, 8


def segment_vectors(segments: DataFrame, views: dict[str, DataFrame], places: int = PLACES) -> DataFrame:
    """``track_id, n, bars, parts``: each segment's rows of every view, resampled onto ``places`` and laid end to end.

    ``views`` are ``track_id, bar, col, x`` with every column in every bar; with a column ``block``
    a view is cut into parts that are compared on their own.
    """
    every = None
    for name, view in views.items():
        part = F.concat(F.lit(f"{name}:"), F.col("block").cast("string")) if "block" in view.columns else F.lit(name)
        own = view.select("track_id", "bar", part.alias("part"), "col", _fine(F.col("x")).alias("x"))
        every = own if every is None else every.unionByName(own)
    at = F.col("k") * (F.col("end_bar") - F.col("start_bar")) / F.lit(places - 1.0)
    place = segments.select("track_id", "n", "start_bar", "end_bar", F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("k")).withColumn("at", at)
    place = place.withColumn("bar", F.col("start_bar") + F.floor("at")).withColumn("u", F.col("at") - F.floor("at"))
    both = place.select("track_id", "n", "k", F.inline(F.array(F.struct("bar", (1 - F.col("u")).alias("w")), F.struct((F.col("bar") + 1).alias("bar"), F.col("u").alias("w"))))).where("w > 0")
    rows = both.join(every, ["track_id", "bar"]).groupBy("track_id", "n", "part", "k", "col").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    laid = rows.groupBy("track_id", "n", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "col", "x"))), lambda e: e["x"]).alias("v"))
    found = laid.groupBy("track_id", "n").agg(F.array_sort(F.collect_list(F.struct("part", "v"))).alias("parts"))
    return segments.select("track_id", "n", (F.col("end_bar") - F.col("start_bar") + 1).cast("long").alias("bars")).join(found, ["track_id", "n"])


def agreement(a: tuple[int, dict], b: tuple[int, dict]) -> float:
    """How alike two segments ``(bars, part -> vector)`` are: the weighted geometric mean of their views' cosines times the length ratio.

    A view is as alike as its worst part.  One view under ``VETO``, or ``DISSENTING`` under
    ``DISSENT``, make it 0.
    """
    worst: dict[str, float] = {}
    for part, x in a[1].items():
        y = b[1][part]
        p, q = float(np.linalg.norm(x)), float(np.linalg.norm(y))
        same = 1.0 if p < 1e-9 and q < 1e-9 else 0.0 if p < 1e-9 or q < 1e-9 else min(1.0, max(0.0, float(x @ y) / (p * q)))
        name = part.split(":")[0]
        worst[name] = min(worst.get(name, 1.0), same)
    total = sum(WEIGHTS.get(n, 0.0) for n in worst)
    if min(worst.values()) < VETO or sum(s < DISSENT for s in worst.values()) >= DISSENTING or total <= 0:
        return 0.0
    mean = float(np.exp(sum(WEIGHTS.get(n, 0.0) * np.log(max(s, 1e-6)) for n, s in worst.items()) / total))
    return mean * max(min(a[0], b[0]) / max(a[0], b[0]), RATIO)


def _parts(parts: list) -> dict:
    return {p["part"]: np.asarray(p["v"], float) for p in parts}


class Heads:
    """Segments that others are compared with, a matrix a part, so that one meets all of them at once."""

    def __init__(self) -> None:
        self.n, self.bars, self.rows, self.norms = 0, np.zeros(8), {}, {}

    def add(self, own: tuple[int, dict]) -> None:
        if not self.n:
            self.rows = {part: np.zeros((8, len(x))) for part, x in own[1].items()}
            self.norms = {part: np.zeros(8) for part in own[1]}
        elif self.n == len(self.bars):
            self.bars = np.concatenate([self.bars, np.zeros(self.n)])
            self.rows = {part: np.concatenate([x, np.zeros_like(x)]) for part, x in self.rows.items()}
            self.norms = {part: np.concatenate([x, np.zeros(self.n)]) for part, x in self.norms.items()}
        self.bars[self.n] = own[0]
        for part in self.rows:
            self.rows[part][self.n], self.norms[part][self.n] = own[1][part], np.linalg.norm(own[1][part])
        self.n += 1

    def agreements(self, own: tuple[int, dict]) -> np.ndarray:
        """``agreement`` of each with ``own``."""
        n, worst = self.n, {}
        for part in self.rows if n else ():
            p, q = self.norms[part][:n], float(np.linalg.norm(own[1][part]))
            dot = self.rows[part][:n] @ own[1][part]
            same = np.where((p < 1e-9) & (q < 1e-9), 1.0, np.where((p < 1e-9) | (q < 1e-9), 0.0, np.clip(dot / np.maximum(p * q, 1e-300), 0.0, 1.0)))
            name = part.split(":")[0]
            worst[name] = np.minimum(worst.get(name, 1.0), same)
        total = sum(WEIGHTS.get(w, 0.0) for w in worst)
        if total <= 0:
            return np.zeros(n)
        every = np.stack(list(worst.values()))
        mean = np.exp(sum(WEIGHTS.get(w, 0.0) * np.log(np.maximum(x, 1e-6)) for w, x in worst.items()) / total)
        bars = self.bars[:n]
        out = mean * np.maximum(np.minimum(bars, own[0]) / np.maximum(bars, own[0]), RATIO)
        return np.where((every.min(0) < VETO) | ((every < DISSENT).sum(0) >= DISSENTING), 0.0, out)


def assign_view_families(segments: DataFrame, vectors: DataFrame, join: float = 0.82, variant: float = 0.88) -> DataFrame:
    """``track_id, n, family, variant, similarity``: as ``assign_families``, by ``agreement`` with each family's first member.

    One pass over a track's segments keeps the first members' vectors, so no pairs are
    made: work is segments times families.
    """
    rows = segments.select("track_id", "n", "break_like").join(vectors, ["track_id", "n"]).select("track_id", F.col("n").cast("long").alias("n"), "break_like", "bars", "parts")

    def step(heads: Heads, n: int, broken: bool | None, bars: int, parts: list) -> list[tuple]:
        if broken:
            return [(n, 0, 0, None)]
        own = (bars, _parts(parts))
        alike = heads.agreements(own)
        k = int(alike.argmax()) if heads.n else 0  # the first of equal ones
        if heads.n and alike[k] >= join:
            return [(n, k + 1, int(alike[k] < variant), float(alike[k]))]
        heads.add(own)
        return [(n, heads.n, 0, None)]

    return fold(rows, ["track_id"], ["n"], "n long, family int, variant int, similarity double", Heads, step)


def family_repetitions(families: DataFrame, vectors: DataFrame) -> DataFrame:
    """``track_id, family, n, similarity``: families of two segments or more (breaks apart) and the mean agreement of their pairs.

    Members of one family stream through a task with those before them as its state.
    """
    rows = families.where("family > 0").select("track_id", "family", F.col("n").cast("long").alias("n")).join(vectors, ["track_id", "n"]).select("track_id", "family", "n", "bars", "parts")

    def step(state: list, n: int, bars: int, parts: list) -> list[tuple]:
        own = (bars, _parts(parts))
        state[1] += float(state[0].agreements(own).sum())
        state[0].add(own)
        return []

    def end(state: list) -> list[tuple]:
        n = state[0].n
        return [(n, state[1] / (n * (n - 1) / 2))] if n > 1 else []

    return fold(rows, ["track_id", "family"], ["n"], "n long, similarity double", lambda: [Heads(), 0.0], step, end)


def assign_families(segments: DataFrame, similar: DataFrame, join: float = 0.82, variant: float = 0.88) -> DataFrame:
    """``track_id, n, family, variant`` in order: a break is of family 0, others join the most alike family by its first member, or found one.

    ``segments(track_id, n, break_like)``; families count from 1.  One pass over a track's
    segments with the families' first members as its state: linear in the similarities.
    """
    to = similar.groupBy("track_id", F.col("b").alias("n")).agg(F.collect_list(F.struct(F.col("a").cast("long").alias("a"), "sim")).alias("sims"))
    rows = segments.join(to, ["track_id", "n"], "left").select("track_id", F.col("n").cast("long").alias("n"), "break_like", "sims")

    def step(heads: dict, n: int, broken: bool | None, sims: list | None) -> list[tuple]:
        if broken:
            return [(n, 0, 0)]
        options = [(-s["sim"], heads[s["a"]]) for s in sims or () if s["a"] in heads]
        best, family = min([*options, *([(0.0, 1)] if heads else [])], default=(1.0, 0))
        if -best >= join:
            return [(n, family, int(-best < variant))]
        heads[n] = len(heads) + 1
        return [(n, heads[n], 0)]

    return fold(rows, ["track_id"], ["n"], "n long, family int, variant int", dict, step)


def descriptors(segments: DataFrame, bars: DataFrame, longest: int = 6) -> DataFrame:
    """``track_id, n, descriptors``: opening, ending, low-energy, break-like, transition-like.

    ``segments(track_id, n, start_bar, end_bar, novelty)`` (novelty at its start, null at the
    first), ``bars(track_id, bar, energy, density)``.  Low: mean energy under the bars' p20;
    break: also density under half its p25; transition: at most ``longest`` bars between
    two boundaries of at least p75 novelty.
    """
    floors = bars.groupBy("track_id").agg(F.percentile("energy", F.lit(0.2)).alias("e"), (F.percentile("density", F.lit(0.25)) * 0.5).alias("d"))
    inside = segments.select("track_id", "n", F.explode(F.sequence("start_bar", "end_bar")).alias("bar")).join(bars, ["track_id", "bar"]).groupBy("track_id", "n").agg(F.avg("energy").alias("energy"), F.avg("density").alias("density"))
    w = Window.partitionBy("track_id").orderBy("n")
    strong = segments.where("n > 1").groupBy("track_id").agg(F.percentile("novelty", F.lit(0.75)).alias("p"))
    rows = segments.withColumn("next", F.lead("novelty").over(w)).withColumn("last", F.lead("n").over(w).isNull()).join(inside, ["track_id", "n"], "left").join(floors, "track_id", "left").join(strong, "track_id", "left")
    low = F.coalesce(F.col("energy") < F.col("e"), F.lit(False))
    short = (F.col("end_bar") - F.col("start_bar") + 1 <= longest) & (F.col("n") > 1) & (F.col("novelty") >= F.col("p")) & (F.col("next") >= F.col("p"))
    names = [F.when(F.col("n") == 1, "opening"), F.when(F.col("last"), "ending"), F.when(low, "low-energy"), F.when(low & (F.col("density") < F.col("d")), "break-like"), F.when(short, "transition-like")]
    return rows.select("track_id", "n", F.array_join(F.array_compact(F.array(*names)), ",").alias("descriptors"))


def repetitions(segments: DataFrame, similar: DataFrame) -> DataFrame:
    """``track_id, family, n, similarity``: families of two segments or more, and their mean pairwise similarity."""
    a = segments.select("track_id", F.col("n").alias("a"), "family")
    b = segments.select("track_id", F.col("n").alias("b"), "family")
    pairs = similar.join(a, ["track_id", "a"]).join(b, ["track_id", "b", "family"]).groupBy("track_id", "family").agg(F.avg("sim").alias("similarity"))
    sizes = segments.groupBy("track_id", "family").agg(F.count("*").alias("n")).where("n > 1")
    return sizes.join(pairs, ["track_id", "family"], "left")


def bar_families(segments: DataFrame, bars: DataFrame) -> DataFrame:
    """``track_id, bar, family`` of every bar; those past the last segment have its family."""
    own = segments.select("track_id", "family", F.explode(F.sequence("start_bar", "end_bar")).alias("bar"))
    last = segments.groupBy("track_id").agg(F.max_by("family", "end_bar").alias("tail"))
    every = bars.select("track_id", F.explode(F.sequence(F.lit(1).cast("long"), "bars")).alias("bar"))
    return every.join(own, ["track_id", "bar"], "left").join(last, "track_id", "left").select("track_id", "bar", F.coalesce("family", "tail").alias("family"))


def bar_groups(vectors: DataFrame, least: float = 0.86, keep: float = 0.8) -> DataFrame:
    """``track_id, bar, group``: each bar joins the group whose centroid is most alike (cosine of ``least`` or more), else founds one.

    A centroid moves to ``keep`` of itself and the rest of the bar.  ``vectors(track_id, bar, v
    array<double>)``; one pass over a track's bars, with as many centroids as groups.
    """
    def step(centres: list, bar: int, v: list[float]) -> list[tuple]:
        x = np.asarray(v, float)
        if centres:
            c = np.stack(centres)
            cosine = np.round(c @ x / np.maximum(np.sqrt((c * c).sum(1) * (x @ x)), 1e-12), 9)
            k = int(cosine.argmax())
            if cosine[k] >= least:
                centres[k] = centres[k] * keep + x * (1 - keep)
                return [(bar, k + 1)]
        centres.append(x)
        return [(bar, len(centres))]

    return fold(vectors.select("track_id", F.col("bar").cast("long").alias("bar"), "v"), ["track_id"], ["bar"], "bar long, group int", list, step)


def band_energy(spectrum: DataFrame, rate: float = 32000.0) -> DataFrame:
    """``track_id, frame, low, mid, high``: mean magnitude of 20-180, 180-4000 and 4000 to 16000 Hz (half the rate at most); 0 for an empty band."""
    f, top = F.col("freq"), min(16000.0, rate / 2)
    mean = lambda a, b: F.coalesce(F.avg(F.when((f >= a) & (f < b), F.col("mag"))), F.lit(0.0))
    return spectrum.groupBy("track_id", "frame").agg(mean(20, 180).alias("low"), mean(180, 4000).alias("mid"), mean(4000, top).alias("high"))


def bin_flux(spectrum: DataFrame) -> DataFrame:
    """``track_id, frame, flux``: rise of log1p(mag) per bin from its frame before, the mean of the positive parts over bins."""
    w = Window.partitionBy("track_id", "freq").orderBy("frame")
    rise = F.greatest(F.log1p("mag") - F.log1p(F.lag("mag").over(w)), F.lit(0.0))
    return spectrum.withColumn("rise", F.coalesce(rise, F.lit(0.0))).groupBy("track_id", "frame").agg(F.avg("rise").alias("flux"))


def span_levels(samples: DataFrame, spans: DataFrame, width: float = 8.0) -> DataFrame:
    """``track_id, id, rms, peak, n`` of samples ``(track_id, channel, t, x)`` in spans ``(id, t0, t1)``: channels are averaged, a peak above 1 scales the track."""
    mono = samples.groupBy("track_id", "t").agg(F.avg("x").alias("x"))
    top = mono.groupBy("track_id").agg(F.max(F.abs("x")).alias("top"))
    level = mono.join(top, "track_id").withColumn("x", F.when(F.col("top") > 1, F.col("x") / F.col("top")).otherwise(F.col("x"))).drop("top")
    found = joins.contained(level, spans.select("track_id", "t0", "id", "t1"), "s", width).where("s.id IS NOT NULL")
    return found.groupBy("track_id", F.col("s.id").alias("id")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"), F.count("*").alias("n"))


def structure_context(onsets: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``track_id, id, distance, novelty`` of the nearest boundary with a finite novelty; null where there is none."""
    fine = boundaries.where(F.col("novelty").isNotNull() & ~F.isnan("novelty") & (F.abs("novelty") != float("inf")))
    found = joins.nearest(onsets.select("track_id", "id", "t"), fine.select("track_id", "t", "novelty"), "b")
    return found.select("track_id", "id", F.abs(F.col("t") - F.col("b.ft")).alias("distance"), F.col("b.novelty").alias("novelty"))


def group_shapes(onsets: DataFrame, gap: float, least: int) -> DataFrame:
    """``track_id, session, n, span, slope, density, path`` of gap sessions: slope of intervals over their index, the kinds in order."""
    w = Window.partitionBy("track_id").orderBy("t", "id")
    rows = onsets.withColumn("d", F.col("t") - F.lag("t").over(w)).withColumn("new", F.when(F.col("d") <= gap, 0).otherwise(1)).withColumn("session", F.sum("new").over(w).cast("long"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("track_id", "session").orderBy("t", "id"))).withColumn("d", F.when(F.col("i") > 1, F.col("d")))
    n, span = F.count("*"), F.max("t") - F.min("t")
    slope = F.regr_slope("d", F.when(F.col("d").isNotNull(), F.col("i").cast("double")))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "kind"))), lambda x: x["kind"]), ">")
    return rows.groupBy("track_id", "session").agg(n.alias("n"), span.alias("span"), slope.alias("slope"), F.when(span > 0, (n - 1) / span).alias("density"), path.alias("path")).where(F.col("n") >= least)


def window_briefs(windows: DataFrame, onsets: DataFrame, beats: DataFrame, width: float, top: int = 3) -> DataFrame:
    """``track_id, id, n, density, first_beat, anchors`` of windows ``(id, t0, t1)``: the ``top`` strongest onsets' ids, in order."""
    held = joins.contained(onsets, windows.select("track_id", "t0", "id", "t1").withColumnRenamed("id", "w"), "s", width).where("s.w IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("track_id", "s.w").orderBy(F.desc("strength"), "id"))
    rows = held.withColumn("rank", rank).groupBy("track_id", F.col("s.w").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", F.col("id").alias("o"))))), lambda x: x["o"].cast("string")), ",").alias("anchors"))
    beat = joins.asof(windows.withColumnRenamed("t0", "t"), beats.select("track_id", "t", "idx"), "b", forward=True, width=width)
    first = beat.select("track_id", "id", F.col("t").alias("t0"), "t1", F.when(F.col("b.ft") < F.col("t1"), F.col("b.idx")).alias("first_beat"))
    out = first.join(rows, ["track_id", "id"], "left")
    return out.select("track_id", "id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / (F.col("t1") - F.col("t0"))).alias("density"), "first_beat", F.coalesce("anchors", F.lit("")).alias("anchors"))


def bar_overview(bars: DataFrame, least: float = 0.82, quiet: float = 0.05) -> DataFrame:
    """``track_id, bar, label, group, mean_strength, similarity_previous`` of bars ``(track_id, bar, v array<double>)`` of steps.

    A bar whose mean is under ``quiet`` is a break.  Others join the group of the earlier bar
    most like them (cosine of its four-decimal vector, ``least`` or more, the first of
    equal ones), else they found the next of A, B, ...  Labels: break; fill, if the last
    four steps are over .12 and 1.6 times the rest; repeat, if like the bar before; else
    change.  Each bar meets all earlier ones of its track, as its rule asks.
    """

    def cosine(a: np.ndarray, b: np.ndarray) -> float:
        size = float(np.linalg.norm(a) * np.linalg.norm(b))
        return float(a @ b) / size if size > 1e-9 else 0.0

    def step(state: dict, bar: int, v: list[float]) -> list[tuple]:
        x = np.asarray(v, float)
        mean = float(x.mean())
        before = cosine(x, state["last"]) if "last" in state else 0.0
        state["last"] = x
        if mean < quiet:
            return [(bar, "break", "BREAK", round(mean, 4), round(before, 4))]
        size = np.linalg.norm(x)
        group = None
        if state["rows"]:
            m = np.stack(state["rows"])
            norms = np.linalg.norm(m, axis=1) * size
            like = np.where(norms > 1e-9, (m @ x) / np.maximum(norms, 1e-9), 0.0)
            k = int(like.argmax())
            group = state["groups"][k] if like[k] >= least else None
        if group is None:
            state["n"] += 1
            group = chr(64 + state["n"])
        state["rows"].append(np.round(x, 4))
        state["groups"].append(group)
        rest = float(x[:-4].mean()) if len(x) > 4 else 0.0
        label = "fill" if len(x) >= 4 and float(x[-4:].mean()) > max(0.12, rest * 1.6) else "repeat" if before >= least else "change"
        return [(bar, label, group, round(mean, 4), round(before, 4))]

    return fold(bars.select("track_id", F.col("bar").cast("long").alias("bar"), "v"), ["track_id"], ["bar"], "bar long, label string, group string, mean_strength double, similarity_previous double", lambda: {"rows": [], "groups": [], "n": 0}, step)
