"""Decimals of doubles that lie beside a tie are those of the exact binary value."""

import hashlib

from pyspark.sql import functions as F

from chronoflux.functions.columns import fixed
from chronoflux.operators import corpora
from chronoflux.sources import projects

TIES = [k / 1e7 for k in range(5, 40005, 10)] + [71.9999995, 0.0, -1.5e-7, 1e20]


def test_fixed_as_sql_prints(spark):
    import duckdb

    rows = spark.createDataFrame([(x,) for x in [*TIES, None]], "x double")
    got = {r["x"]: (r["a"], r["b"]) for r in rows.select("x", fixed(F.col("x"), 6).alias("a"), fixed(F.col("x"), 4).alias("b")).collect()}
    db = duckdb.connect()
    assert got.pop(None) == (None, None)
    assert all(got[x] == db.execute("SELECT printf('%.6f', ?::DOUBLE), printf('%.4f', ?::DOUBLE)", [x, x]).fetchall()[0] for x in TIES[::20] + TIES[-4:])
    assert any(f"{x:.6f}" != r["t"] for x, r in zip(TIES, spark.createDataFrame([(x,) for x in TIES], "x double").select(F.format_string("%.6f", "x").alias("t")).collect(), strict=True))


def test_marker_hash_at_ties(spark):
    times = TIES[:500]
    rows = spark.createDataFrame([(1, "a", x) for x in reversed(times)] + [(1, "a", None)], "track_id long, chart string, t double")
    (row,) = corpora.marker_hash(rows).collect()
    assert row["hash"] == hashlib.sha256(("[" + ",".join(f"{x:.6f}" for x in times) + "]").encode()).hexdigest()
    assert (row["n"], row["ts"]) == (500, times)


def test_onset_csv_at_ties(spark):
    times = [k / 1e5 for k in range(5, 4005, 10)]
    rows = spark.createDataFrame([(1, n, x, x, x, x, x) for n, x in enumerate(times)], "track_id long, id long, t double, strength double, low double, mid double, high double")
    got = {r["id"]: r["line"] for r in projects.onset_csv(rows, rows.where("id = 3")).collect()}
    assert got == {n: ",".join([str(n), *[f"{x:.4f}"] * 5, str(int(n == 3))]) for n, x in enumerate(times)}
