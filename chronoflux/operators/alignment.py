"""Markers aligned to events, one to one and in order, by an exact programme per connected component."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold

#: Fixed value: farthest a marker is from the event it is matched to, in the unit of t.
TOLERANCE = 0.05
#: Residuals are whole millionths.
MICRO = 1_000_000


def components(events: DataFrame, markers: DataFrame, key: list[str], tol: float) -> DataFrame:
    """``key, component, side, pos, t``: both sides of a key (0 events, 1 markers), chained by edges of at most ``tol``.

    In order of time a component ends where no edge crosses: the last event so far is
    too far from the next marker, and the last marker from the next event.  ``pos``
    numbers each side of a key from 0.  Rows without an edge are alone.
    """
    order = Window.partitionBy(*key).orderBy("t", "side", "id")
    rows = events.select(*key, F.lit(0).alias("side"), "id", "t").unionByName(markers.select(*key, F.lit(1).alias("side"), "id", "t"))
    rows = rows.where("t IS NOT NULL")
    back = Window.partitionBy(*key).orderBy(F.desc("t"), F.desc("side"), F.desc("id"))
    so_far, rest = order.rowsBetween(Window.unboundedPreceding, 0), back.rowsBetween(Window.unboundedPreceding, -1)
    own = lambda s: F.when(F.col("side") == s, F.col("t"))
    gap = F.least(*[F.last(own(1 - s), ignorenulls=True).over(rest) - F.last(own(s), ignorenulls=True).over(so_far) for s in (0, 1)])
    rows = rows.withColumn("crossed", F.coalesce(F.round(gap * MICRO) <= round(tol * MICRO), F.lit(False)))
    rows = rows.withColumn("component", F.coalesce(F.sum((~F.col("crossed")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pos = F.row_number().over(Window.partitionBy(*key, "side").orderBy("t", "id")).cast("long") - 1
    return rows.select(*key, "component", "side", pos.alias("pos"), "t", "id")


class _Way:
    """Best alignment from some place on: matches, total residual, and the pairs as a linked list."""

    __slots__ = ("error", "n", "pair", "rest")

    def __init__(self, n: int, error: int, pair: tuple[int, int] | None, rest: _Way | None) -> None:
        self.n, self.error, self.pair, self.rest = n, error, pair, rest

    def pairs(self) -> Iterable[tuple[int, int]]:
        at = self
        while at is not None and at.pair is not None:
            yield at.pair
            at = at.rest


def _earlier(a: _Way, b: _Way) -> _Way:
    """Of two ways as good as each other the one of lesser events, then of lesser markers."""
    x, y, by_marker = a, b, 0
    while x is not y and x is not None and y is not None and x.pair is not None and y.pair is not None:
        if x.pair[0] != y.pair[0]:
            return a if x.pair[0] < y.pair[0] else b
        if not by_marker and x.pair[1] != y.pair[1]:
            by_marker = -1 if x.pair[1] < y.pair[1] else 1
        x, y = x.rest, y.rest
    return b if by_marker > 0 else a


def align(events: list[int], markers: list[int], tol: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs (event, marker) of sorted whole times, and whether the choice was ambiguous.

    Most matches, then the least total residual, then the lexicographically least
    events and markers.  Only cells of a table (event, marker) that have an edge are
    kept: to the right of an event's last marker its row equals the next event's, to
    the left of its first one it is constant, so work is linear in the edges.  It is
    ambiguous if at any cell of the whole table two of skipping the event, skipping
    the marker and matching them give as much; outside the edges that comes down to
    equal neighbours within them.
    """
    none = _Way(0, 0, None, None)
    lows, highs, low = [], [], 0
    for e in events:
        while low < len(markers) and markers[low] < e - tol:
            low += 1
        high = low
        while high < len(markers) and markers[high] <= e + tol:
            high += 1
        lows.append(low)
        highs.append(high)
    ambiguous = bool(events) and bool(markers) and highs[-1] < len(markers)
    below: list[_Way] = []  # row of the next event, from its first marker to one past its last
    below_low = len(markers)
    same = lambda a, b: a.n == b.n and a.error == b.error
    for i in range(len(events) - 1, -1, -1):
        low, high = lows[i], highs[i]

        def under(j: int) -> _Way:
            if not below or j > below_low + len(below) - 1:
                return none
            return below[max(j - below_low, 0)]

        row = [none] * (high - low + 1)
        row[-1] = under(high)
        for j in range(high - 1, low - 1, -1):
            skip_event, skip_marker, tail = under(j), row[j + 1 - low], under(j + 1)
            match = _Way(tail.n + 1, tail.error + abs(events[i] - markers[j]), (i, j), tail)
            options = (match, skip_event, skip_marker)
            n = max(o.n for o in options)
            error = min(o.error for o in options if o.n == n)
            best = [o for o in options if o.n == n and o.error == error]
            ambiguous |= len(best) > 1
            found = best[0]
            for o in best[1:]:
                found = _earlier(found, o)
            row[j - low] = found
        if not ambiguous:
            if low > 0 and same(row[0], under(low)):  # a marker before the row's first, event skipped or not
                ambiguous = True
            if i > 0:  # markers right of an earlier event's last: the same with or without one
                for j in range(max(low, highs[i - 1]), high):
                    if same(row[j - low], row[j + 1 - low]):
                        ambiguous = True
                        break
        below, below_low = row, low
    return (list(below[0].pairs()) if below else []), ambiguous


def align_monotone(events: DataFrame, markers: DataFrame, key: list[str], tol: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Matches ``key, id, marker_id, residual`` (marker less event) and ``key, components, ambiguous``.

    ``events`` and ``markers`` are ``(key, id, t)``; an event stands for all that happen with it.
    Each connected component is aligned on its own, in order and one to one: most
    matches, then least total absolute residual, then the earliest events and
    markers.  Residuals count in millionths.  A component is streamed to one task,
    which keeps the table's cells that have an edge; components never mix.  Null times
    take no part; equal times go by id; a key of one side only has no component.
    """
    rows = components(events, markers, key, tol)
    order = ["side", "pos"]

    def start() -> tuple[list, list]:
        return [], []

    def step(state: tuple[list, list], side: int, pos: int, t: float, id_: object) -> Iterable[tuple]:
        state[side].append((round(t * MICRO), id_))
        return ()

    def end(state: tuple[list, list]) -> Iterable[tuple]:
        e, m = state
        if not e or not m:
            return
        pairs, ambiguous = align([t for t, _ in e], [t for t, _ in m], round(tol * MICRO))
        yield (None, None, None, ambiguous)
        for i, j in pairs:
            yield (e[i][1], m[j][1], (m[j][0] - e[i][0]) / MICRO, None)

    kind = dict(rows.dtypes)["id"]
    found = fold(rows, [*key, "component"], order, f"id {kind}, marker_id {kind}, residual double, ambiguous boolean", start, step, end)
    matches = found.where("id IS NOT NULL").select(*key, "id", "marker_id", "residual")
    counts = found.where("ambiguous IS NOT NULL").groupBy(*key).agg(F.count("*").alias("components"), F.count_if("ambiguous").alias("ambiguous"))
    return matches, counts


def clusters(onsets: DataFrame, tol: float) -> DataFrame:
    """``track_id, id, t, n``: runs of onsets no more than ``tol`` after the one before, by their first; ``n`` of them."""
    w = Window.partitionBy("track_id").orderBy("t", "id")
    rows = onsets.where("t IS NOT NULL").select("track_id", "id", "t", (F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(float("inf"))) > tol).alias("opens"))
    rows = rows.withColumn("run", F.sum(F.col("opens").cast("long")).over(w))
    return rows.groupBy("track_id", "run").agg(F.min(F.struct("t", "id")).alias("x"), F.count("*").alias("n")).select("track_id", F.col("x.id").alias("id"), F.col("x.t").alias("t"), "n")


def chart_report(matches: DataFrame, markers: DataFrame, counts: DataFrame, key: list[str]) -> DataFrame:
    """``key, n, matched, rate, median, p95, most, ambiguous``: residuals are absolute; null without a match."""
    size = F.abs("residual")
    own = matches.groupBy(*key).agg(F.count("*").alias("matched"), F.percentile(size, F.lit(0.5)).alias("median"), F.percentile(size, F.lit(0.95)).alias("p95"), F.max(size).alias("most"))
    rows = markers.groupBy(*key).agg(F.count("*").alias("n")).join(own, key, "left").join(counts.drop("components"), key, "left")
    rows = rows.withColumn("matched", F.coalesce("matched", F.lit(0))).withColumn("ambiguous", F.coalesce("ambiguous", F.lit(0)))
    return rows.select(*key, "n", "matched", (F.col("matched") / F.col("n")).alias("rate"), "median", "p95", "most", "ambiguous")
