"""Local rank, contrast and density of events; sessions; matching; ranking; corpus splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoflux.functions.columns import clip

from . import joins


def _local(onsets: DataFrame, columns: list[str], radius: float, duration: DataFrame | None) -> DataFrame:
    """``track_id, id, n, density`` and ``rank_c, contrast_c`` of each column c among the onsets at most ``radius`` away, both ends in.

    One window serves all columns, each as one sorted array a row.
    """
    frame = f"OVER (PARTITION BY track_id ORDER BY t RANGE BETWEEN {radius}D PRECEDING AND {radius}D FOLLOWING)"
    arrays = [F.sort_array(F.expr(f"collect_list({c}) {frame}")).alias(f"xs_{c}") for c in columns]
    rows = onsets.select("track_id", "id", "t", *columns, *arrays, F.max("t").over(Window.partitionBy("track_id")).alias("last"))
    rows = rows.join(duration.select("track_id", "duration"), "track_id", "left").withColumn("last", F.coalesce("duration", "last")) if duration is not None else rows

    def quantile(c: str, p: float) -> Column:
        at = p * (F.size(f"xs_{c}") - 1)
        low, high = F.get(f"xs_{c}", F.floor(at).cast("int")), F.get(f"xs_{c}", F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    def views(c: str) -> list[Column]:
        less, same = F.size(F.filter(f"xs_{c}", lambda x: x < F.col(c))), F.size(F.filter(f"xs_{c}", lambda x: x == F.col(c)))
        middle = quantile(c, 0.5)
        return [((less + same * 0.5) / F.size(f"xs_{c}")).alias(f"rank_{c}"), clip((F.col(c) - middle) / F.greatest(quantile(c, 0.9) - middle, F.lit(0.08)), 0.0, 4.0).alias(f"contrast_{c}")]

    n = F.size(f"xs_{columns[0]}")
    seconds = F.greatest(F.least(F.col("t") + radius, "last") - F.greatest(F.col("t") - radius, F.lit(0.0)), F.lit(1e-9))
    return rows.select("track_id", "id", n.alias("n"), (n / seconds).alias("density"), *[v for c in columns for v in views(c)])


def local_view(onsets: DataFrame, radius: float = 2.0, duration: DataFrame | None = None) -> DataFrame:
    """``midrank, contrast, density`` of strength among the onsets at most ``radius`` away, both ends in.

    Density is per unit of the window that lies in the track: from 0 to ``duration(track_id,
    duration)``, else to the last onset.
    """
    return _local(onsets, ["strength"], radius, duration).select("track_id", "id", F.col("rank_strength").alias("midrank"), F.col("contrast_strength").alias("contrast"), "density")


def event_evidence(onsets: DataFrame, beats: DataFrame, boundaries: DataFrame, duration: DataFrame | None = None, radius: float = 2.0) -> DataFrame:
    """All evidence of an onset as one nested row: ``track_id, id, local, spectral, temporal, metric, structure, group_id``.

    ``local``: how many onsets are around, rank and contrast of strength and of each band among
    them; ``spectral``: focus and dominant band; ``temporal``: density, gaps, isolation;
    ``metric``: nearest beat and the signed way from it (null without beats); ``structure``: way to
    the nearest boundary ``(track_id, t, novelty)`` and its novelty (null without one);
    ``group_id``: number of the capped group in its track, from 1, null outside all.
    Figures have six decimals.
    """
    names = ["strength", "low", "mid", "high"]
    r6 = lambda c: F.round(c, 6)
    near = _local(onsets, names, radius, duration)
    per = lambda kind: F.create_map(*[x for c in names for x in (F.lit("all" if c == "strength" else c), r6(F.col(f"{kind}_{c}")))])
    local = near.select("track_id", "id", F.struct(F.col("n").alias("sample_count"), per("rank").alias("rank"), per("contrast").alias("contrast")).alias("local"), r6("density").alias("density"))
    band = spectral(onsets).select("track_id", "id", F.struct(r6("focus").alias("focus"), "dominant").alias("spectral"))
    time = gaps(onsets).select("track_id", "id", "before", "after", "isolated")
    queries = onsets.select("track_id", "id", "t")
    beat = joins.nearest(queries, beats.select("track_id", "t", "idx"), "b")
    metric = beat.select("track_id", "id", F.when(F.col("b").isNotNull(), F.struct(F.col("b.idx").alias("beat"), r6(F.col("t") - F.col("b.ft")).alias("offset"))).alias("metric"))
    fine = boundaries.where(F.col("novelty").isNotNull() & ~F.isnan("novelty") & (F.abs("novelty") != float("inf")))
    bound = joins.nearest(queries, fine.select("track_id", "t", "novelty"), "s")
    structure = bound.select("track_id", "id", F.when(F.col("s").isNotNull(), F.struct(r6(F.abs(F.col("t") - F.col("s.ft"))).alias("distance"), F.col("s.novelty").alias("novelty"))).alias("structure"))
    groups = capped_groups(onsets)
    groups = groups.withColumn("g", F.row_number().over(Window.partitionBy("track_id").orderBy("t0")))
    held = joins.asof(queries, groups.select("track_id", F.col("t0").alias("t"), "t1", "g"), "g")
    grouped = held.select("track_id", "id", F.when(F.col("t") <= F.col("g.t1"), F.col("g.g")).alias("group_id"))
    out = local
    for part in (band, time, metric, structure, grouped):
        out = out.join(part, ["track_id", "id"])
    temporal = F.struct("density", r6("before").alias("before"), r6("after").alias("after"), r6("isolated").alias("isolated"))
    return out.select("track_id", "id", "local", "spectral", temporal.alias("temporal"), "metric", "structure", "group_id")


def hash_ranked(rows: DataFrame, group: str, key: str, salt: str = "") -> DataFrame:
    """``rows`` with ``r``, from 1, the rank in its group by salted SHA-256 of the key, and ``n``, the group's rows.

    Ranks are counts of the cells before (leading digits of the hash) and places
    within a cell, so a group of any size is ranked by many tasks.
    """
    hashed = rows.withColumn("_h", F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)).withColumn("_cell", F.left("_h", F.lit(3)))
    cells = hashed.groupBy(group, "_cell").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group)
    before = cells.select(group, "_cell", (F.sum("_c").over(w.orderBy("_cell")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("n"))
    place = F.row_number().over(Window.partitionBy(group, "_cell").orderBy("_h"))
    return hashed.withColumn("_place", place).join(before, [group, "_cell"]).withColumn("r", F.col("_before") + F.col("_place")).drop("_h", "_cell", "_before", "_place")


def gaps(onsets: DataFrame) -> DataFrame:
    """``before, after`` (null at the ends) and ``isolated``: the smaller one, clipped to 1."""
    w = Window.partitionBy("track_id").orderBy("t", "id")
    rows = onsets.select("track_id", "id", (F.col("t") - F.lag("t").over(w)).alias("before"), (F.lead("t").over(w) - F.col("t")).alias("after"))
    return rows.withColumn("isolated", clip(F.least(F.coalesce("before", F.lit(2.0)), F.coalesce("after", F.lit(2.0)))))


def spectral(onsets: DataFrame) -> DataFrame:
    """``focus`` = 1 - entropy / ln 3 of the band shares, and the dominant band or ``mixed``."""
    total = F.col("low") + F.col("mid") + F.col("high")
    share = {b: F.col(b) / F.greatest(total, F.lit(1e-9)) for b in ("low", "mid", "high")}
    entropy = sum((F.when(s > 0, -s * F.ln(s)).otherwise(0.0) for s in share.values()), F.lit(0.0))
    ordered = F.array_sort(F.array(*share.values()))
    lead = F.element_at(ordered, 3) - F.element_at(ordered, 2)
    name = F.when(lead < 0.05, "mixed")
    for b, s in share.items():
        name = name.when(s == F.element_at(ordered, 3), b)
    return onsets.select("track_id", "id", (1 - entropy / F.ln(F.lit(3.0))).alias("focus"), name.alias("dominant"))


def sessions(onsets: DataFrame, gap: float, least: int) -> DataFrame:
    """Gap sessions of at least ``least`` onsets: ``track_id, session, t0, t1, n``."""
    w = Window.partitionBy("track_id").orderBy("t", "id")
    rows = onsets.withColumn("new", F.when(F.col("t") - F.lag("t").over(w) <= gap, 0).otherwise(1)).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("track_id", "session").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n")).where(F.col("n") >= least)


def capped_groups(onsets: DataFrame, gap: float = 0.18, longest: float = 1.5, least: int = 3) -> DataFrame:
    """Sessions that also end ``longest`` after their start: ``track_id, t0, t1, n``.

    Plain gap sessions come first; the cap is an ordered fold inside one session, so
    no fold sees more than a session.
    """
    w = Window.partitionBy("track_id").orderBy("t", "id")
    rows = onsets.withColumn("new", F.when(F.col("t") - F.lag("t").over(w) <= gap, 0).otherwise(1)).withColumn("session", F.sum("new").over(w))
    lists = rows.groupBy("track_id", "session").agg(F.array_sort(F.collect_list("t")).alias("ts")).where(F.size("ts") >= least)
    start = F.array(F.struct(F.element_at("ts", 1).alias("t0"), F.element_at("ts", 1).alias("t1"), F.lit(1).alias("n")))

    def add(groups: Column, t: Column) -> Column:
        last = F.element_at(groups, -1)
        more = F.struct(last["t0"].alias("t0"), t.alias("t1"), (last["n"] + 1).alias("n"))
        return F.when(t - last["t0"] <= longest, F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(more))).otherwise(F.concat(groups, F.array(F.struct(t.alias("t0"), t.alias("t1"), F.lit(1).alias("n")))))

    return lists.select("track_id", F.explode(F.aggregate(F.slice("ts", F.lit(2), F.size("ts") - 1), start, add)).alias("g")).select("track_id", "g.*").where(F.col("n") >= least)


def metric_context(onsets: DataFrame, beats: DataFrame) -> DataFrame:
    """Nearest beat (the earlier wins) and the signed offset from it."""
    found = joins.nearest(onsets.select("track_id", "id", "t"), beats.select("track_id", "t", "idx"), "b")
    return found.select("track_id", "id", F.col("b.idx").alias("beat"), (F.col("t") - F.col("b.ft")).alias("offset"))


def match_counts(reference: DataFrame, estimate: DataFrame, tol: float) -> DataFrame:
    """Precision, recall and F1 of greedy two-pointer matching, per track.

    Merged streams are cut into islands wider apart than ``tol``; the fold runs in
    an island: an estimate or reference waits for its partner, the earlier one goes.
    """
    both = reference.select("track_id", "t", F.lit(0).alias("side")).unionByName(estimate.select("track_id", "t", F.lit(1).alias("side")))
    w = Window.partitionBy("track_id").orderBy("t", "side")
    both = both.withColumn("new", F.when(F.col("t") - F.lag("t").over(w) <= tol, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    lists = both.groupBy("track_id", "island").agg(F.array_sort(F.collect_list(F.struct("t", "side"))).alias("xs"), F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("e"))
    # what waits is always of one side, in order; the next of the other side takes the first that is near
    empty = F.struct(F.array().cast("array<double>").alias("wait"), F.lit(-1).alias("side"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        near = F.filter(s["wait"], lambda t: x["t"] - t <= tol)
        hit = (s["side"] != x["side"]) & (F.size(near) > 0)
        same = s["side"] == x["side"]
        wait = F.when(hit, F.slice(near, F.lit(2), F.greatest(F.size(near) - 1, F.lit(0)))).when(same, F.concat(near, F.array(x["t"]))).otherwise(F.array(x["t"]))
        return F.struct(wait.alias("wait"), F.when(hit, s["side"]).otherwise(x["side"]).alias("side"), (s["n"] + hit.cast("int")).alias("n"))

    hits = lists.select("track_id", "r", "e", F.aggregate("xs", empty, step)["n"].alias("n"))
    out = hits.groupBy("track_id").agg(F.sum("n").alias("matched"), F.sum("r").alias("references"), F.sum("e").alias("estimates"))
    ratio = lambda a, b: F.round(F.col(a) / F.when(F.col(b) > 0, F.col(b)), 4)
    return out.select("*", ratio("matched", "estimates").alias("precision"), ratio("matched", "references").alias("recall"), F.round(2 * F.col("matched") / (F.col("references") + F.col("estimates")), 4).alias("f1"))


def robust_scale(onsets: DataFrame, column: str) -> DataFrame:
    """(x - median) / IQR, the IQR at least 1e-6, over all rows."""
    q = onsets.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return onsets.crossJoin(F.broadcast(q)).select("track_id", "id", ((F.col(column) - F.col("q")[1]) / F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1e-6))).alias("scaled"))  # q is one row


def score_linear(onsets: DataFrame, weights: dict[str, float]) -> DataFrame:
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return onsets.select("track_id", "id", "t", F.round(1 / (1 + F.exp(-total)), 6).alias("relevance"))


def select_budget(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` most relevant events of each track, ids breaking ties, with their place in time."""
    w = Window.partitionBy("track_id").orderBy(F.desc("relevance"), "id")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.withColumn("place", F.row_number().over(Window.partitionBy("track_id").orderBy("t", "id")))


def ndcg(scored: DataFrame, gain: str, k: int = 10) -> DataFrame:
    """NDCG at ``k`` per track; 0 where the ideal is 0."""
    rank = lambda *by: F.row_number().over(Window.partitionBy("track_id").orderBy(*by))
    rows = scored.withColumn("r", rank(F.desc("relevance"), F.col("id"))).withColumn("i", rank(F.desc(gain), F.col("id")))
    part = lambda c: F.sum(F.when(F.col(c) <= k, F.col(gain) / F.log2(F.col(c) + 1.0)).otherwise(0.0))
    out = rows.groupBy("track_id").agg(part("r").alias("d"), part("i").alias("best"))
    return out.select("track_id", F.when(F.col("best") > 0, F.col("d") / F.col("best")).otherwise(0.0).alias("ndcg"))


def leakage(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one split has."""
    return rows.groupBy(key).agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n")).where("splits > 1")


def balanced_subset(rows: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    """Round-robin over groups, in each by SHA-256 of the key: the first ``limit``."""
    w = Window.partitionBy(group).orderBy("h")
    picked = rows.withColumn("h", F.sha2(F.col(key).cast("string"), 256)).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)
    return picked.orderBy("turn", group).limit(limit).select(key, group, "turn")


def salted_split(rows: DataFrame, group: str, key: str, salt: str) -> DataFrame:
    """15 % test, 15 % validation, the rest train, in every group by salted SHA-256."""
    ranked = hash_ranked(rows, group, key, salt)
    part = F.col("r") / F.col("n")
    return ranked.select(key, group, F.when(part <= 0.15, "test").when(part <= 0.3, "validation").otherwise("train").alias("split"))


def preference_pairs(onsets: DataFrame, near: float, least: float) -> DataFrame:
    """Pairs within ``near`` whose strengths differ by ``least``: ``track_id, better, worse, margin``."""
    s = onsets.select("track_id", "id", "strength")
    pairs = joins.band(onsets, onsets, near).select("track_id", F.col("id").alias("better"), F.col("other_id").alias("worse"))
    a, b = s.select("track_id", F.col("id").alias("better"), F.col("strength").alias("x")), s.select("track_id", F.col("id").alias("worse"), F.col("strength").alias("y"))
    both = pairs.join(a, ["track_id", "better"]).join(b, ["track_id", "worse"])
    return both.where(F.col("x") - F.col("y") >= least).select("track_id", "better", "worse", (F.col("x") - F.col("y")).alias("margin"))


def fingerprint(onsets: DataFrame, width: float = 5.0) -> DataFrame:
    """SHA-256 of the event counts in cells of ``width``, empty ones included."""
    cells = onsets.groupBy("track_id", F.floor(F.col("t") / width).alias("cell")).agg(F.count("*").alias("n"))
    rows = cells.groupBy("track_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"), F.max("cell").alias("last"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return rows.select("track_id", F.sha2(F.array_join(dense.cast("array<string>"), ","), 256).alias("fingerprint"))
