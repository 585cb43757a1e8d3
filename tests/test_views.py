"""All pairs of bars in tiles against joins of every pair."""

import random

from pyspark.sql import functions as F

from chronoflux.functions.columns import clip
from chronoflux.operators import forms

WEIGHTS = {"harmony": 0.34, "timbre": 0.28}


def sims(view):
    pairs = view.select("track_id", F.col("bar").alias("i"), "col", "x").join(view.select("track_id", F.col("bar").alias("j"), "col", F.col("x").alias("y")), ["track_id", "col"])
    dot, a, b = F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x")), F.sum(F.col("y") * F.col("y"))
    return pairs.groupBy("track_id", "i", "j").agg(clip(dot / F.greatest(F.sqrt(a) * F.sqrt(b), F.lit(1e-12))).alias("sim"))


def test_tiles_give_what_joined_pairs_give(spark, monkeypatch):
    monkeypatch.setattr(forms, "TILE", 4)
    r = random.Random(5)
    odd = lambda: r.choice([None, 0.0, float("nan")]) if r.random() < 0.06 else r.gauss(0.3, 1)
    rows = [(t, bar, c, odd()) for t in (-1, 7) for bar in range(1, 14 + t) if bar != 9 for c in range(1, 4) if r.random() < 0.9]
    rows += [(8, 5, 3, 1.0)]
    view = spark.createDataFrame(rows, "track_id int, bar long, col long, x double")
    plain = forms.combined(sims(view).withColumn("view", F.lit("harmony")).unionByName(sims(view.where("col <= 2")).withColumn("view", F.lit("timbre"))), WEIGHTS)
    found = forms.combined_views(view, {"harmony": (1, 3), "timbre": (1, 2)}, WEIGHTS)
    of = lambda df: {(x["track_id"], x["i"], x["j"]): round(x["sim"], 9) for x in df.collect()}
    assert of(found) == of(plain) and found.count() == len(of(plain)) > 300


def test_tiles_deal_out_no_pairs(spark):
    view = spark.range(600).select(F.lit(1).alias("track_id"), F.col("id").alias("bar"), F.lit(1).alias("col"), F.rand(1).alias("x"))
    plan = forms.combined_views(view, {"harmony": (1, 1)}, {"harmony": 1.0})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < min(plan.index(x) for x in ("Join", "Relation"))  # nothing is joined or grouped behind the tiles
