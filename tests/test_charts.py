"""Chart files: what is read, and every reason to reject one."""

import pytest

from chronoflux.sources import charts

STEP = """#TITLE:x;
#OFFSET:-0.500000;
#BPMS:0=60.000,4=120.000;
#STOPS:4=1.000;
{extra}
#NOTES:
     dance-single:
     author:
     Hard:
     3:
     0,0,0,0,0:
1000
0000
0M00
1000
,
1000 // a comment
L000x
0030
0204
;
""".replace("L000x", "0000")


def rows(spark, bodies):
    return spark.createDataFrame(list(bodies.items()), "path string, body string")


def test_step_charts(spark):
    blocks = "#OFFSET:0;\n#BPMS:0=60;\n#NOTEDATA;\n#STEPSTYPE:pump;#DIFFICULTY:Easy;#METER:2;\n#NOTES:\n10\n0L\n;\n#NOTEDATA:;#BPMS:0=120;#DELAYS:2=.5;#NOTES:\n1\n1\n1\n1;"
    short = STEP.replace("     0,0,0,0,0:\n", "").format(extra="")
    markers, found = charts.step_charts(rows(spark, {"a": STEP.format(extra=""), "b": blocks, "c": short, "none": "#TITLE:x;", "null": None}))
    got = {}
    for r in markers.collect():
        got.setdefault((r["path"], r["chart"]), []).append(r["t"])
    got = {k: sorted(v) for k, v in got.items()}
    want = [0.5, 3.5, 4.5, 0.5 + 4 + 1 + 3 * 0.5]
    assert got[("a", 0)] == want == got[("c", 0)]
    assert got[("b", 0)] == [0.0, 2.0] and got[("b", 1)] == [0.0, 0.5, 1.5, 2.0]
    about = {(r["path"], r["chart"]): r for r in found.collect()}
    a = about[("a", 0)]
    assert (a["mode"], a["difficulty"], a["objects"], a["tails"], a["hazards"], a["markers"], a["reason"]) == ("dance-single", "Hard", 7, 1, 1, 4, None)
    assert (about[("b", 0)]["mode"], about[("b", 0)]["difficulty"]) == ("pump", "Easy") and about[("b", 1)]["difficulty"] == "Unnamed"
    assert about[("none", None)]["reason"] == about[("null", None)]["reason"] == charts.MALFORMED


FAULTS = {
    "no bpms": (STEP.replace("#BPMS:0=60.000,4=120.000;", "").format(extra=""), charts.MALFORMED),
    "late start": (STEP.replace("0=60.000,4", "1=60.000,4").format(extra=""), charts.MALFORMED),
    "unordered": (STEP.replace("4=120", "0=120").format(extra=""), charts.MALFORMED),
    "no number": (STEP.replace("4=120.000", "4=fast").format(extra=""), charts.MALFORMED),
    "no equals": (STEP.replace("4=120.000", "4").format(extra=""), charts.MALFORMED),
    "negative bpm": (STEP.replace("4=120", "4=-120").format(extra=""), charts.TIMING),
    "negative beat": (STEP.replace("0=60", "-1=60").format(extra=""), charts.TIMING),
    "negative stop": (STEP.replace("4=1.000", "4=-1").format(extra=""), charts.TIMING),
    "warp": (STEP.format(extra="#WARPS:4=1;"), charts.TIMING),
    "signature": (STEP.format(extra="#TIMESIGNATURES:0=3=4;"), charts.TIMING),
    "broken signature": (STEP.format(extra="#TIMESIGNATURES:0=4;"), charts.MALFORMED),
    "lift": (STEP.replace("0204", "0L00").format(extra=""), charts.TIMING),
    "symbol": (STEP.replace("0204", "0?00").format(extra=""), charts.MALFORMED),
    "lanes": (STEP.replace("0204", "020").format(extra=""), charts.MALFORMED),
    "before the start": (STEP.replace("-0.500000", "0.5").format(extra=""), charts.TIMING),
    "offset": (STEP.replace("-0.500000", "soon").format(extra=""), charts.MALFORMED),
    "meter": (STEP.replace("     3:", "     hard:").format(extra=""), charts.MALFORMED),
    "fields": ("#OFFSET:0;#BPMS:0=60;#NOTES:a:b:1;", charts.MALFORMED),
}


def test_step_charts_are_rejected_for_what_is_wrong(spark):
    markers, found = charts.step_charts(rows(spark, {k: v[0] for k, v in FAULTS.items()} | {"fine": STEP.format(extra="#TIMESIGNATURES:0=4=4;#WARPS: ;")}))
    assert {r["path"]: r["reason"] for r in found.collect()} == {k: v[1] for k, v in FAULTS.items()} | {"fine": None}
    assert {r["path"] for r in markers.collect()} == {"fine"}


HIT = """osu file format v14
// comment
[General]
Mode: {mode}

[Metadata]
Version:{version}

[Difficulty]
CircleSize:4

[HitObjects]
256,192,500,8,12
256,192,1000,1,0
256,192,1000,2,0
256,192,2000.5,128,0
"""


@pytest.mark.parametrize(("mode", "times", "tails"), [(0, [1.0, 1.0], 1), (1, [1.0], 2), (3, [1.0, 2.0005], 1)])
def test_hit_object_charts(spark, mode, times, tails):
    markers, found = charts.hit_object_charts(rows(spark, {"a": HIT.format(mode=mode, version="Probe")}))
    assert sorted(r["t"] for r in markers.collect()) == times
    r = found.first()
    assert (r["mode"], r["difficulty"], r["objects"], r["tails"], r["hazards"], r["markers"], r["reason"]) == (charts.MODES[mode], "Probe", 4, tails, 1, len(times), None)


def test_hit_object_charts_are_rejected_for_what_is_wrong(spark):
    fine = HIT.format(mode=0, version="")
    bad = {
        "header": (fine.replace("osu file format v14", "something"), charts.FORMAT),
        "catch": (HIT.format(mode=2, version=""), charts.MODE),
        "mode": (HIT.format(mode="two", version=""), charts.MALFORMED),
        "negative": (fine.replace("256,192,500", "256,192,-5"), charts.TIMING),
        "endless": (fine.replace("256,192,500", "256,192,inf"), charts.TIMING),
        "unsorted": (fine.replace("2000.5", "20"), charts.MALFORMED),
        "fields": (fine + "1,2,3000,1\n", charts.MALFORMED),
        "type": (fine + "1,2,3000,round,0\n", charts.MALFORMED),
        "meter": (fine.replace("CircleSize:4", "CircleSize:big"), charts.MALFORMED),
        "null": (None, charts.FORMAT),
    }
    markers, found = charts.hit_object_charts(rows(spark, {k: v[0] for k, v in bad.items()} | {"fine": fine}))
    assert {r["path"]: r["reason"] for r in found.collect()} == {k: v[1] for k, v in bad.items()} | {"fine": None}
    assert {r["path"] for r in markers.collect()} == {"fine"} and {r["difficulty"] for r in found.collect()} == {"Unnamed"}


def test_notes_are_read_once_for_markers_and_in_many_tasks(spark):
    texts = rows(spark, {f"f{k}": STEP.format(extra="") for k in range(6)} | {"late": STEP.format(extra="").replace("0M00", "0Z00")})
    markers, found = charts.step_charts(texts)
    bad = {r["path"] for r in found.collect() if r["reason"]}
    assert bad == {"late"} and {r["path"] for r in markers.select("path").distinct().collect()} == {f"f{k}" for k in range(6)}
    plan = markers._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode(split(notes") == 1
    assert "RepartitionByExpression" in plan
