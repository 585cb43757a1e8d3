"""A ranker of small regression trees, fitted on preference pairs, and how one is chosen.

The driver loops over trees and nodes; every figure it decides on is one aggregate
over pairs or events, of (features x bins) rows a node.  Gradients are summed as
whole numbers, so neither the order of pairs nor that of tasks changes a model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoflux.sources.store import stored

from . import scores

#: Thresholds tried at a node, and the gain a split has to exceed a better one by.
QUANTILES, EPSILON = tuple(q / 10 for q in range(1, 10)), 1e-12
#: Units of a whole-number gradient, and trees after which margins are written into the pairs.
UNIT, FLUSH = 10**12, 8
#: What a whole number is cut by for sums in two halves, and bits of a double left off for its bucket: 256 to a power of two.
HALF, BUCKET = 10**6, 44

Node = float | tuple


def _value(tree: Node, at: str) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    name, threshold, left, right = tree
    return F.when(F.col(f"{at}{name}") <= float(threshold), _value(left, at)).otherwise(_value(right, at))


def _leaf(open_: Node, at: str) -> Column:
    """Number of the open node a row is in: ``open_`` is a tree whose leaves are node numbers."""
    if not isinstance(open_, tuple):
        return F.lit(int(open_))
    name, threshold, left, right = open_
    return F.when(F.col(f"{at}{name}") <= float(threshold), _leaf(left, at)).otherwise(_leaf(right, at))


def _tally(events: DataFrame, features: list[str], node: Column, wanted: dict[tuple[int, int], list[int]] | None = None) -> DataFrame:
    """``node, f, bucket, x, n``: events in each bucket of a feature; the values of the ``wanted`` buckets, if given.

    A task adds up what it reads before it gives out a row.
    """

    def turned(bits: np.ndarray) -> np.ndarray:
        return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))

    def counted(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, of = np.unique(np.concatenate(parts), return_inverse=True)
        return values, np.bincount(of, weights=np.concatenate(counts), minlength=len(values)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, list]] = {}
        for batch in batches:
            of = batch.column(0).to_numpy()
            for k in np.unique(of).tolist():
                own = of == k
                for f in range(len(features)):
                    keys = turned((batch.column(f + 1).to_numpy()[own] + 0.0).view(np.int64))  # in the order of the values, NaN last
                    if wanted is None:
                        keys = keys >> BUCKET
                    else:
                        keys = keys[np.isin(keys >> BUCKET, wanted.get((k, f), []))]
                    values, n = np.unique(keys, return_counts=True)
                    parts, counts = held.setdefault((k, f), ([], []))
                    parts.append(values)
                    counts.append(n)
                    if len(parts) > 32:
                        values, n = counted(parts, counts)
                        held[k, f] = ([values], [n])
        for (k, f), both in held.items():
            values, n = counted(*both)
            if len(values):
                x = turned(values).view(np.float64) if wanted is not None else np.zeros(len(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(np.full(len(values), f, np.int32)), pa.array(values if wanted is None else values >> BUCKET), pa.array(x), pa.array(n)], names=["node", "f", "bucket", "x", "n"])

    rows = events.select(node.alias("node"), *features).mapInArrow(run, "node int, f int, bucket long, x double, n long")
    return rows.groupBy("node", "f", "bucket", "x").agg(F.sum("n").alias("n"))


def _thresholds(events: DataFrame, features: list[str], node: Column) -> dict[tuple[int, int], tuple[list[float], list[int]]]:
    """Of each feature among the events of each node: its deciles, six decimals, each once, and the events in each bin they cut.

    Exact in two passes: events are counted by buckets of nearly equal values, whose
    sums tell the buckets that hold the ranks asked for, and then by value in those only.
    What is dealt out and collected does not grow with the events, but with the buckets.
    """
    sizes: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in _tally(events, features, node).collect():  # buckets, not values
        sizes.setdefault((r["node"], r["f"]), []).append((r["bucket"], r["n"]))
    places: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    ranks: dict[tuple[int, int], dict[int, set[int]]] = {}
    before: dict[tuple[int, int, int], int] = {}
    total: dict[tuple[int, int], int] = {}
    for key, own in sizes.items():
        own.sort()
        ends = np.cumsum([n for _, n in own])
        total[key] = int(ends[-1])
        places[key] = [(math.floor(p), math.ceil(p), p) for p in ((total[key] - 1) * q for q in QUANTILES)]
        for rank in {r for low, high, _ in places[key] for r in (low, high)}:
            i = int(np.searchsorted(ends, rank, side="right"))
            ranks.setdefault(key, {}).setdefault(own[i][0], set()).add(rank)
            before[*key, own[i][0]] = int(ends[i]) - own[i][1]
    asked = events.sparkSession.createDataFrame([(k, f, b, before[k, f, b], sorted(r)) for (k, f), found in ranks.items() for b, r in found.items()], "node int, f int, bucket long, before long, ranks array<long>")
    up_to = F.col("before") + F.sum("n").over(Window.partitionBy("node", "f", "bucket").orderBy("x"))
    rows = _tally(events, features, node, {key: list(found) for key, found in ranks.items()}).join(F.broadcast(asked), ["node", "f", "bucket"])  # a row a bucket asked for
    hit = rows.withColumn("end", up_to).where(F.exists("ranks", lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("n"))))
    values: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for r in hit.select("node", "f", "x", "n", "end").collect():
        values.setdefault((r["node"], r["f"]), []).append((r["end"], r["n"], r["x"]))
    out = {}
    for key, own in values.items():
        own.sort()
        at = lambda rank, own=own: next(v for v in own if v[0] > rank)
        upto: dict[float, int] = {}
        for low, high, place in places[key]:
            (end_a, n_a, a), (end_b, _, b) = at(low), at(high)
            cut = round(a if low == high or a == b else (high - place) * a + (place - low) * b, 6) + 0.0
            upto.setdefault(cut, total[key] if cut != cut else end_b if cut >= b else end_a if cut >= a else end_a - n_a)
        out[key] = (list(upto), np.diff([0, *upto.values(), total[key]]).tolist())
    return out


def _binned(pulled: DataFrame, features: list[str], open_: Node, found: dict) -> dict[tuple[int, int], list[tuple[float, float, int]]]:
    """Per node and feature the sums of gradient, curvature and events in each bin.

    Whole numbers are summed in two halves, so no sum leaves 64 bits.
    """
    cuts = {key: np.array(c) for key, (c, _) in found.items()}
    width = len(QUANTILES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {key: np.zeros((4, width), np.int64) for key in cuts}
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            for side, sign in ((0, 1), (1, -1)):
                of = columns[2 + side]
                for k in np.unique(of).tolist():
                    own = of == k
                    g, h = sign * columns[0][own], columns[1][own]
                    halves = [half.astype(float) for x in (g, h) for half in np.divmod(x, HALF)]
                    for f in range(len(features)):
                        if (k, f) in cuts:
                            x = columns[4 + side * len(features) + f][own]
                            bins = np.searchsorted(cuts[k, f], x, side="left")
                            sums[k, f] += np.array([np.bincount(bins, weights=half, minlength=width) for half in halves]).astype(np.int64)
        keys = [(*key, i) for key in sums for i in range(width)]
        if keys:
            flat = np.concatenate([sums[key] for key in sums], axis=1)
            yield pa.RecordBatch.from_arrays([*[pa.array([k[j] for k in keys], pa.int32()) for j in range(3)], *map(pa.array, flat)], names=["node", "f", "bin", "g1", "g0", "h1", "h0"])

    side = lambda p: [F.col(f"{p}{c}") for c in features]
    given = pulled.select("g", "h", _leaf(open_, "a_").alias("a"), _leaf(open_, "b_").alias("b"), *side("a_"), *side("b_"))
    rows = given.mapInArrow(run, "node int, f int, bin int, g1 long, g0 long, h1 long, h0 long").groupBy("node", "f", "bin").agg(*[F.sum(c).alias(c) for c in ("g1", "g0", "h1", "h0")])
    out = {key: [(0.0, 0.0, n) for n in counts] for key, (_, counts) in found.items()}
    for r in rows.collect():
        own = out[r["node"], r["f"]]
        if r["bin"] < len(own):
            own[r["bin"]] = (float(r["g1"] * HALF + r["g0"]) / UNIT, float(r["h1"] * HALF + r["h0"]) / UNIT, own[r["bin"]][2])
    return out


def best_split(bins: dict[int, list[tuple[float, float, int]]], cuts: dict[int, list[float]], least: int, penalty: float) -> tuple[float, int, float, tuple, tuple] | None:
    """Greatest gain over all features and thresholds; of equal ones the lower feature, then the lower threshold."""
    best, top = None, 0.0
    for f in sorted(bins):
        total = tuple(map(sum, zip(*bins[f], strict=True)))
        left = (0.0, 0.0, 0)
        for threshold, own in zip(cuts[f], bins[f], strict=False):
            left = tuple(a + b for a, b in zip(left, own, strict=True))
            right = tuple(a - b for a, b in zip(total, left, strict=True))
            if min(left[2], right[2]) < least:
                continue
            gain = 0.5 * (sum(g * g / (h + penalty) for g, h, _ in (left, right)) - total[0] * total[0] / (total[1] + penalty))
            if gain > top + EPSILON:
                best, top = (gain, f, threshold, left, right), gain
    return best


def _newton(sums: tuple[float, float, int], penalty: float, most: float) -> float:
    return round(max(-most, min(most, sums[0] / (sums[1] + penalty))), 6) + 0.0


def fit_tree(events: DataFrame, pulled: DataFrame, features: list[str], depth: int, least: int, penalty: float, most: float, root: dict | None = None) -> Node:
    """One tree, level by level: ``pulled`` are pairs with both events' features and ``g`` and ``h`` in whole units; ``g`` is the better one's."""
    open_: Node = 0
    sums: dict[int, tuple] = {}
    shape: dict[int, tuple[str, float, int, int]] = {}
    level, fresh = [0], 1
    for d in range(depth):
        found = root if d == 0 and root is not None else {k: v for k, v in _thresholds(events, features, _leaf(open_, "")).items() if k[0] in level}
        bins = _binned(pulled, features, open_, found) if found else {}
        following = []
        for node in level:
            own = {f: b for (n, f), b in bins.items() if n == node}
            if not own:
                continue
            sums.setdefault(node, tuple(map(sum, zip(*own[min(own)], strict=True))))
            split = best_split(own, {f: c for (n, f), (c, _) in found.items() if n == node}, least, penalty)
            if split is not None:
                _, f, threshold, sums[fresh], sums[fresh + 1] = split
                shape[node] = (features[f], threshold, fresh, fresh + 1)
                following += [fresh, fresh + 1]
                fresh += 2

        def grown(node: int) -> Node:
            if node not in shape:
                return node
            name, threshold, a, b = shape[node]
            return (name, threshold, grown(a), grown(b))

        level, open_ = following, grown(0)
        if not level:
            break

    def closed(node: Node) -> Node:
        if isinstance(node, tuple):
            return (*node[:2], closed(node[2]), closed(node[3]))
        return _newton(sums[node], penalty, most)

    return closed(open_)


def fit_pairwise_trees(events: DataFrame, pairs: DataFrame, features: list[str], anchor: str, trees: int = 24, depth: int = 2, rate: float = 0.05, least: int = 32, penalty: float = 1.0, most: float = 0.5, weight: float = 1.0) -> dict:
    """Trees that correct ``weight * anchor`` so that the better event of each pair scores higher.

    ``events(track_id, id, features..., anchor)``, ``pairs(track_id, better, worse)``; features
    count at six decimals, missing ones as 0.  Each tree is fitted to the Newton
    steps of the pairwise logistic loss: thresholds are a node's deciles, a split needs
    a positive gain and ``least`` events on both sides, a leaf is the sum of
    gradients over that of curvatures plus ``penalty``, at most ``most`` either way.
    Ends early where no pair pulls or a tree says nothing.  The model is what
    ``scores.score_trees`` takes.  No pairs are an error.
    """
    events, rows = _sided(events, pairs, features, anchor)
    events, rows = events.persist(), rows.persist()
    try:
        return _fit(events, rows, features, anchor, trees, depth, rate, least, penalty, most, weight)
    finally:
        events.unpersist()
        rows.unpersist()


def _sided(events: DataFrame, pairs: DataFrame, features: list[str], anchor: str) -> tuple[DataFrame, DataFrame]:
    """Events with features and anchor at six decimals, and pairs with those of both sides; other columns stay."""
    value = lambda c: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 6)
    names = list(dict.fromkeys([*features, anchor]))
    events = events.select("track_id", "id", *[c for c in events.columns if c == "source"], *[value(c).alias(c) for c in names])
    side = lambda p, k: events.select("track_id", F.col("id").alias(k), *[F.col(c).alias(f"{p}{c}") for c in names])
    both = pairs.join(side("a_", "better"), ["track_id", "better"]).join(side("b_", "worse"), ["track_id", "worse"])
    return events, both.drop("track_id", "better", "worse")


def _fit(events: DataFrame, rows: DataFrame, features: list[str], anchor: str, trees: int = 24, depth: int = 2, rate: float = 0.05, least: int = 32, penalty: float = 1.0, most: float = 0.5, weight: float = 1.0) -> dict:
    rows = rows.withColumn("m", (F.col(f"a_{anchor}") - F.col(f"b_{anchor}")) * weight)
    held = []
    if not rows.head(1):
        raise ValueError("no pairs to fit on")
    root = _thresholds(events, features, F.lit(0))
    model: list[Node] = []
    flushed = 0
    try:
        for _ in range(trees):
            margin = F.col("m")
            for tree in model[flushed:]:
                margin = margin + rate * (_value(tree, "a_") - _value(tree, "b_"))
            if len(model) - flushed == FLUSH:
                rows, flushed = rows.withColumn("m", margin).persist(), len(model)
                held.append(rows)
                rows.count()
                if len(held) > 1:
                    held.pop(0).unpersist()
                margin = F.col("m")
            q = 1 / (1 + F.exp(margin))
            whole = lambda x: F.round(x * UNIT).cast("long")
            pulled = rows.withColumn("q", q).withColumn("g", whole(F.col("q"))).withColumn("h", whole(F.col("q") * (1 - F.col("q"))))
            tree = fit_tree(events, pulled, features, depth, least, penalty, most, root)
            if not _speaks(tree):
                break
            model.append(tree)
    finally:
        for df in held:
            df.unpersist()
    return {"base": 0.0, "anchor": weight, "by": anchor, "rate": rate, "trees": model}


def _speaks(tree: Node) -> bool:
    return any(map(_speaks, tree[2:])) if isinstance(tree, tuple) else abs(tree) >= EPSILON


def nodes(model: dict) -> list[tuple]:
    """``(tree, node, feature, threshold, value)``: a row per node, numbered from the root, left before right."""
    out: list[tuple] = []

    def walk(tree: int, node: Node, at: int) -> None:
        if isinstance(node, tuple):
            out.append((tree, at, node[0], float(node[1]), None))
            walk(tree, node[2], 2 * at)
            walk(tree, node[3], 2 * at + 1)
        else:
            out.append((tree, at, None, None, float(node)))

    for k, tree in enumerate(model["trees"]):
        walk(k, tree, 1)
    return out


def pair_accuracy(scored: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """``track_id, accuracy, n``: share of a track's pairs whose better event has the higher ``column``; a tie is a half."""
    own = lambda k, c: scored.select("track_id", F.col("id").alias(k), F.col(column).alias(c))
    rows = pairs.join(own("better", "x"), ["track_id", "better"]).join(own("worse", "y"), ["track_id", "worse"])
    win = F.when(F.col("x") > F.col("y"), 1.0).when(F.col("x") == F.col("y"), 0.5).otherwise(0.0)
    return rows.groupBy("track_id").agg(F.avg(win).alias("accuracy"), F.count("*").alias("n"))


def leave_one_source_out(events: DataFrame, pairs: DataFrame, sources: DataFrame, features: list[str], anchor: str, **options: object) -> DataFrame:
    """``source, tracks, pairs, accuracy, base, delta``: each source judged by trees fitted on all others.

    ``sources(track_id, source)``; tracks without one take no part.  ``base`` is the anchor
    alone.  Accuracies are means over tracks.  A source without pairs has null figures;
    the only one is not judged, as nothing is left to fit on.
    """
    events, pairs = stored(events.join(sources, "track_id")), stored(pairs.join(sources, "track_id"))
    names = [r["source"] for r in pairs.select("source").distinct().orderBy("source").collect()]  # a row a source
    own, rows = _sided(events, pairs, features, anchor)  # one join of events and pairs for all sources
    own, rows = own.persist(), rows.persist()
    judged = None
    for name in names:
        fit = rows.where(F.col("source") != name)
        if not fit.head(1):
            continue
        model = _fit(own.where(F.col("source") != name), fit, features, anchor, **options)
        scored = scores.score_trees(events.where(F.col("source") == name), model, digits=None)
        held = pairs.where(F.col("source") == name).select("track_id", "better", "worse")
        both = pair_accuracy(scored, held, "relevance").join(pair_accuracy(scored, held, anchor).select("track_id", F.col("accuracy").alias("base")), "track_id")
        row = both.select(F.lit(name).alias("source"), "track_id", "n", "accuracy", "base")
        judged = row if judged is None else judged.unionByName(row)
    own.unpersist()
    rows.unpersist()
    if judged is None:
        judged = pairs.select("source", "track_id", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("accuracy"), F.lit(0.0).alias("base")).limit(0)
    found = judged.groupBy("source").agg(F.count("*").alias("tracks"), F.sum("n").alias("pairs"), F.avg("accuracy").alias("accuracy"), F.avg("base").alias("base"))
    every = sources.select("source").distinct()
    return every.join(found, "source", "left").select("source", F.coalesce("tracks", F.lit(0)).alias("tracks"), F.coalesce("pairs", F.lit(0)).alias("pairs"), "accuracy", "base", (F.col("accuracy") - F.col("base")).alias("delta"))


def select_penalty(events: DataFrame, pairs: DataFrame, held: DataFrame, features: list[str], penalties: tuple[float, ...] = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0), k: int = 10) -> tuple[dict, list[tuple[float, float | None, float | None]]]:
    """The linear pair model whose penalty validates best, refitted on everything.

    ``held(track_id)`` are the tracks to validate on; features are scaled by the mean and
    deviation of the others' events.  All penalties are judged in one pass over the
    validation pairs and one over their events: mean pair accuracy over tracks first,
    then mean NDCG of the first ``k`` events (gain: how often an event was the better one
    less how often the worse, 0 at least), then the larger penalty.
    """
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    events = stored(events.select("track_id", "id", *[value(c).alias(c) for c in features]))
    pairs = stored(pairs.select("track_id", "better", "worse"))
    tracks = stored(held.select("track_id").distinct())

    def differences(rows: DataFrame, own: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
        side = lambda p, n: own.select("track_id", F.col("id").alias(n), *[F.col(c).alias(f"{p}{c}") for c in features])
        both = rows.join(side("a_", "better"), ["track_id", "better"]).join(side("b_", "worse"), ["track_id", "worse"])
        return both.select("track_id", *[((F.col(f"a_{c}") - F.col(f"b_{c}")) / scale[c][1]).alias(c) for c in features])

    def scaled(own: DataFrame) -> dict[str, tuple[float, float]]:
        got = own.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
        return {c: (got[f"m_{c}"] or 0.0, got[f"s_{c}"] or 1.0) for c in features}

    train = events.join(tracks, "track_id", "left_anti")
    scale = scaled(train)
    fit = differences(pairs.join(tracks, "track_id", "left_anti"), train, scale).persist()
    weights = [scores.fit_pairwise(fit, features, p) for p in penalties]
    fit.unpersist()
    own = pairs.join(tracks, "track_id", "left_semi")
    line = lambda w, e=None: sum((F.col(c) * float(x / (scale[c][1] if e else 1.0)) for c, x in zip(features, w, strict=True)), F.lit(0.0))
    gaps = differences(own, events, scale)
    right = [F.avg(F.when(line(w) > 0, 1.0).when(line(w) == 0, 0.5).otherwise(0.0)).alias(f"a{i}") for i, w in enumerate(weights)]
    accuracy = gaps.groupBy("track_id").agg(*right).agg(*[F.avg(f"a{i}").alias(f"a{i}") for i in range(len(weights))]).first()
    gain = own.select("track_id", F.explode(F.array(F.struct(F.col("better").alias("id"), F.lit(1).alias("v")), F.struct(F.col("worse").alias("id"), F.lit(-1).alias("v")))).alias("s")).groupBy("track_id", "s.id").agg(F.greatest(F.sum("s.v"), F.lit(0)).cast("double").alias("gain"))
    judged = events.join(gain, ["track_id", "id"]).select("track_id", "id", "gain", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), line(w, 1).alias("z")) for i, w in enumerate(weights)])).alias("s")).select("track_id", "id", "gain", "s.*")
    ndcg = _ndcg(judged, k).collect()
    quality = {r["i"]: r["ndcg"] for r in ndcg}
    table = [(p, accuracy[f"a{i}"], quality.get(i)) for i, p in enumerate(penalties)]
    best = max(table, key=lambda r: (-1.0 if r[1] is None else round(r[1], 12), -1.0 if r[2] is None else round(r[2], 12), r[0]))
    scale = scaled(events)
    final = scores.fit_pairwise(differences(pairs, events, scale), features, best[0])
    return {"penalty": best[0], "weights": dict(zip(features, final, strict=True)), "scale": scale}, table


def _ndcg(judged: DataFrame, k: int) -> DataFrame:
    """``i, ndcg``: mean over tracks with any gain."""
    rank = lambda c: F.row_number().over(Window.partitionBy("i", "track_id").orderBy(F.desc(c), "id"))
    rows = judged.withColumn("a", rank("z")).withColumn("b", rank("gain"))
    part = lambda r: F.sum(F.when(F.col(r) <= k, (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    tracks = rows.groupBy("i", "track_id").agg(part("a").alias("dcg"), part("b").alias("ideal")).where("ideal > 0")
    return tracks.groupBy("i").agg(F.avg(F.col("dcg") / F.col("ideal")).alias("ndcg"))
