"""Anchors never send a whole grid through the driver."""

from chronoflux.operators import timeline


def test_no_table_is_broadcast(spark, monkeypatch):
    plans, store = [], timeline.stored

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(timeline, "stored", seen)
    rows = [(1, "a", 0.25, None, None, None, 0.0, 0.0), (1, "b", None, 1, None, None, 0.0, 2.0), (1, "c", None, None, None, "b", 0.5, 1.5), (2, "d", 3.0, None, None, None, 0.0, 1.0)]
    anchors = spark.createDataFrame(rows, "track_id long, name string, seconds double, beat long, onset long, moment string, offset double, offset_beats double")
    beats = spark.createDataFrame([(1, float(k)) for k in range(6)], "track_id long, t double")
    onsets = spark.createDataFrame([(1, 7, 2.0)], "track_id long, id long, t double")
    done = timeline.resolve_anchors(anchors, beats, onsets)
    plans.append(done._jdf.queryExecution().executedPlan().toString())
    assert {r["name"]: (r["t"], r["status"]) for r in done.collect()} == {"a": (0.25, "ok"), "b": (3.0, "ok"), "c": (5.0, "ok"), "d": (None, "invalid")}
    assert [x for p in plans for x in p.splitlines() if "Broadcast" in x] == []
