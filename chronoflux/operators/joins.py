"""Joins on timelines: as-of, nearest, tolerance band and containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(queries: DataFrame, facts: DataFrame, name: str, forward: bool = False, strict: bool = False, width: float = 8.0) -> DataFrame:
    """Each query row with the last fact at or before its ``t`` (first at or after: ``forward``).

    Both have ``track_id`` and ``t``; the fact comes as struct ``name``, null where
    there is none.  ``strict`` leaves out facts at the same t.  Time is cut into
    cells of ``width``: one window runs within (track, cell), a second one over the
    cells' own last facts carries them on, so a track of any length is spread over
    tasks.  Among facts at one t the greatest struct counts (forward: the least).
    """
    both, order = _dealt(queries, facts, width), _order(strict, forward)
    inside = Window.partitionBy("track_id", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("own", F.last("f", ignorenulls=True).over(inside))
    cells = _carried(both, ["forward" if forward else "back"])
    return both.where("is_q").join(cells.hint("merge"), ["track_id", "cell"]).select("q.*", F.coalesce("own", "forward" if forward else "back").alias(name))


def _dealt(queries: DataFrame, facts: DataFrame, width: float) -> DataFrame:
    """Both sides as ``track_id, t, q, f, is_q, cell``."""
    fact = F.struct(F.col("t").alias("ft"), *[F.col(c) for c in facts.columns if c not in ("track_id", "t")])
    kind = facts.select(fact.alias("f")).schema["f"].dataType
    f = facts.select("track_id", "t", F.lit(None).cast(queries.select(F.struct("*").alias("q")).schema["q"].dataType).alias("q"), fact.alias("f"), F.lit(False).alias("is_q"))
    q = queries.select("track_id", "t", F.struct("*").alias("q"), F.lit(None).cast(kind).alias("f"), F.lit(True).alias("is_q"))
    return f.unionByName(q).withColumn("cell", F.floor(F.col("t") / width))


def _order(strict: bool, forward: bool) -> list:
    side = F.col("is_q") if not strict else ~F.col("is_q")
    return [F.col("t").desc(), side.cast("int"), F.col("f").desc()] if forward else [F.col("t"), side.cast("int"), F.col("f")]


def _carried(both: DataFrame, sides: list[str]) -> DataFrame:
    """Per cell the last fact of the cells before it (``back``) or the first of those behind it (``forward``)."""
    cells = both.groupBy("track_id", "cell").agg(F.max("f").alias("_back"), F.min("f").alias("_forward"))
    along = lambda c: Window.partitionBy("track_id").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    over = {"back": along(F.col("cell")), "forward": along(F.col("cell").desc())}
    return cells.select("track_id", "cell", *[F.last(f"_{s}", ignorenulls=True).over(over[s]).alias(s) for s in sides])


def nearest(queries: DataFrame, facts: DataFrame, name: str, width: float = 8.0) -> DataFrame:
    """Each query row with the nearest fact on either side; the earlier wins ties.

    As two ``asof`` of both directions, but both run in one deal of facts and queries.
    """
    both = _dealt(queries, facts, width)
    inside = lambda forward: Window.partitionBy("track_id", "cell").orderBy(*_order(False, forward)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_b", F.last("f", ignorenulls=True).over(inside(False))).withColumn("_f", F.last("f", ignorenulls=True).over(inside(True)))
    found = both.where("is_q").join(_carried(both, ["back", "forward"]).hint("merge"), ["track_id", "cell"])
    b, f = F.coalesce("_b", "back"), F.coalesce("_f", "forward")
    found = found.select("q", "t", b.alias("_b"), f.alias("_f"))
    before = F.col("_f").isNull() | (F.col("t") - F.col("_b.ft") <= F.col("_f.ft") - F.col("t"))
    return found.select("q.*", F.when(F.col("_b").isNotNull() & before, F.col("_b")).otherwise(F.col("_f")).alias(name))


def band(left: DataFrame, right: DataFrame, tol: float) -> DataFrame:
    """Pairs of one track with |left.t - right.t| <= tol: ``track_id, id, t, other_id, other_t``.

    Equal cells of width ``tol`` and their neighbours meet; the rest is a filter.
    """
    a = left.select("track_id", "id", "t", F.explode(F.array(*[F.floor(F.col("t") / tol) + k for k in (-1, 0, 1)])).alias("cell"))
    b = right.select("track_id", F.col("id").alias("other_id"), F.col("t").alias("other_t"), F.floor(F.col("t") / tol).alias("cell"))
    return a.join(b, ["track_id", "cell"]).where(F.abs(F.col("t") - F.col("other_t")) <= tol).drop("cell")


def contained(queries: DataFrame, spans: DataFrame, name: str, width: float = 8.0) -> DataFrame:
    """Each query row with the span [t0, t1) it falls into; an open last span takes the rest."""
    found = asof(queries, spans.withColumnRenamed("t0", "t"), name, width=width)
    inside = F.col(f"{name}.t1").isNull() | (F.col("t") < F.col(f"{name}.t1"))
    return found.withColumn(name, F.when(inside, F.col(name)))


def overlapping(spans: DataFrame, windows: DataFrame, width: float) -> DataFrame:
    """Pairs (span, window) of one track with t0 < w1 and t1 > w0, met cell by cell, each once."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    a, b = spans.withColumn("cell", cells("t0", "t1")), windows.withColumn("cell", cells("w0", "w1"))
    first = F.greatest(F.floor(F.col("t0") / width), F.floor(F.col("w0") / width)) == F.col("cell")
    return a.join(b, ["track_id", "cell"]).where((F.col("t0") < F.col("w1")) & (F.col("t1") > F.col("w0")) & first).drop("cell")
