"""Edges of the timeline maps and metrics that the tables do not show."""

from chronoflux.operators import metrics, timeline


def test_map_leaves_late_knots_out_and_goes_on(spark):
    knots = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 4.0), (1, 2.0, 5.0), (1, 4.0, 6.0), (2, 1.0, 0.0)], "track_id long, t double, step double")
    asked = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0), (1, 3, 6.0), (1, 4, -1.0), (2, 5, 3.0)], "track_id long, id long, t double")
    assert {r["id"]: r["step"] for r in timeline.time_to_step(asked, knots).collect()} == {1: 2.0, 2: 5.0, 3: 8.0, 4: None, 5: None}


def test_keyframes_ease_and_hold_the_ends(spark):
    keys = spark.createDataFrame([(1, 0.0, 1.0), (1, 4.0, 3.0)], "track_id long, t double, value double")
    asked = spark.createDataFrame([(1, 1, -1.0), (1, 2, 1.0), (1, 3, 9.0), (2, 4, 1.0)], "track_id long, id long, t double")
    value = lambda ease: {r["id"]: r["value"] for r in timeline.resample(asked, keys, ease).collect()}
    assert value("linear") == {1: 1.0, 2: 1.5, 3: 3.0, 4: None}
    assert value("hold") == {1: 1.0, 2: 1.0, 3: 3.0, 4: None}
    assert value("smooth") == {1: 1.0, 2: 1.3125, 3: 3.0, 4: None}


def test_rules_name_each_fault(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "track_id long, id long")
    scores = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.5), (1, 2, 1.5), (1, 9, float("nan"))], "track_id long, id long, relevance double")
    assert sorted((r["id"], r["rule"]) for r in metrics.coverage_rules(rows, scores).collect()) == [(1, "repeated"), (2, "range"), (3, "missing"), (9, "range"), (9, "unknown")]
