"""Chart files as text: tagged step charts and sectioned hit-object charts, parsed by columns.

``text(path, body)``, a row a file.  Each gives markers ``path, chart, t`` in seconds and a
row per chart with what is wrong, if anything; a chart that is rejected has no
markers.  Null bodies are files without a chart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reasons, kinds of hit objects by mode (what starts an event), names of modes.
MALFORMED, TIMING, MODE, FORMAT = "malformed_chart", "unsupported_timing", "unsupported_mode", "unsupported_format"
MODES = {0: "standard", 1: "taiko", 3: "mania"}
NUMBER = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def _timing(value: Column) -> Column:
    """``b=v`` entries of a list as structs; what is no number is null."""
    entries = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(F.regexp_replace(x, r"[\r\n\t]", " "))), lambda x: x != "")
    return F.transform(entries, lambda x: F.struct(_number(F.regexp_extract(x, "^([^=]*)=", 1)).alias("beat"), _number(F.regexp_extract(x, "=(.*)$", 1)).alias("value")))


def _broken(entries: Column) -> Column:
    return F.exists(entries, lambda e: e["beat"].isNull() | e["value"].isNull())


def _seconds(beat: Column) -> Column:
    """Audio time of a beat: tempo spans before it, stops before it, delays up to it."""
    spans = F.transform("bpms", lambda e, k: F.struct(e["beat"].alias("a"), F.coalesce(F.get(F.col("bpms"), k + 1)["beat"], F.lit(float("inf"))).alias("b"), e["value"].alias("v")))
    run = F.aggregate(spans, F.lit(0.0), lambda s, e: s + F.when(beat > e["a"], (F.least(beat, e["b"]) - e["a"]) * 60 / e["v"]).otherwise(0.0))
    held = lambda c, at: F.aggregate(c, F.lit(0.0), lambda s, e: s + F.when(at(e["beat"]), e["value"]).otherwise(0.0))
    return run - F.col("offset") + held("stops", lambda b: beat > b) + held("delays", lambda b: beat >= b)


def tags(text: DataFrame) -> DataFrame:
    """``path, k, tag, value`` of ``#TAG:value;`` in order; a tag without a value has an empty one."""
    pattern = r"#([A-Za-z0-9_]+)[ \t\r\n]*(?::([^;]*)(?:;|\z)|;)"
    found = lambda g: F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(pattern), F.lit(g))
    rows = text.select("path", F.posexplode(F.arrays_zip(found(1).alias("tag"), found(2).alias("value"))).alias("k", "x"))
    return rows.select("path", "k", F.upper("x.tag").alias("tag"), F.coalesce("x.value", F.lit("")).alias("value"))


def step_charts(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markers and charts of step files, of both dialects.

    With ``NOTEDATA`` blocks a block's tags override the song's for its own chart, else
    every ``NOTES`` is a chart and its fields are parted by colons.  Measures are parted
    by commas, a measure's rows share its four beats evenly; 1, 2 and 4 start an event, 3
    ends one, M, F and K do nothing, L is an event in block files only.

    Charts: ``path, chart, mode, difficulty, objects, tails, hazards, markers, reason``.
    Reasons: a missing, broken, unordered or late-starting tempo list, a row of odd width
    or an unknown symbol (malformed); negative beats, stops or delays, tempos not above
    0, warps, other signatures than 4/4, lifts in plain files, notes before the start,
    times that go back (timing).  A file without a chart has one row, chart null.
    """
    rows = tags(text)
    order = Window.partitionBy("path").orderBy("k")
    opened = F.max(F.when(F.col("tag") == "NOTEDATA", F.col("k"))).over(order)
    closed = F.max(F.when(F.col("tag") == "NOTES", F.col("k"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opened", opened).withColumn("blocks", F.max("opened").over(Window.partitionBy("path")).isNotNull())
    rows = rows.withColumn("block", F.when(F.col("opened").isNotNull() & (closed.isNull() | (F.col("opened") > closed)), F.col("opened")))
    notes = rows.where("tag = 'NOTES' AND (NOT blocks OR block IS NOT NULL)")
    notes = notes.withColumn("chart", F.row_number().over(Window.partitionBy("path").orderBy("k")) - 1)
    named = ["OFFSET", "BPMS", "STOPS", "DELAYS", "WARPS", "TIMESIGNATURES", "DIFFICULTY", "METER", "STEPSTYPE"]
    last = lambda c: F.max_by(F.when(F.col("tag") == c, F.col("value")), F.when(F.col("tag") == c, F.col("k")))
    song = rows.where("block IS NULL").groupBy("path").agg(*[last(c).alias(f"s_{c}") for c in named])
    own = rows.where("block IS NOT NULL").groupBy("path", "block").agg(*[last(c).alias(f"b_{c}") for c in named])
    charts = notes.select("path", "chart", "block", "blocks", "value").join(song, "path", "left").join(own, ["path", "block"], "left")
    charts = charts.select("path", "chart", "blocks", "value", *[F.coalesce(f"b_{c}", f"s_{c}").alias(c) for c in named])
    fields = F.split(F.col("value"), ":", 6)
    charts = charts.withColumn("fields", fields).withColumn("plain", ~F.col("blocks"))
    size = F.size("fields")
    field = lambda n: F.trim(F.regexp_replace(F.coalesce(F.get("fields", n), F.lit("")), r"[\r\n\t]", " "))
    named_or = lambda x, d: F.when(F.length(x) > 0, x).otherwise(d)
    charts = charts.select(
        "path", "chart", "plain",
        F.when(F.col("plain"), F.get("fields", F.when(size == 6, 5).otherwise(4))).otherwise(F.col("value")).alias("notes"),
        F.when(F.col("plain"), named_or(field(0), F.lit("dance-single"))).otherwise(named_or(F.trim(F.coalesce("STEPSTYPE", F.lit(""))), F.lit("dance-single"))).alias("mode"),
        F.when(F.col("plain"), named_or(field(2), F.lit("Unnamed"))).otherwise(named_or(F.trim(F.coalesce("DIFFICULTY", F.lit(""))), F.lit("Unnamed"))).alias("difficulty"),
        (F.col("plain") & (size < 5)).alias("few"),
        _number(F.when(F.col("plain"), field(3)).otherwise(named_or(F.trim(F.coalesce("METER", F.lit(""))), F.lit("4")))).isNull().alias("no_meter"),
        _timing(F.col("BPMS")).alias("bpms"), F.array_sort(_timing(F.col("STOPS"))).alias("stops"), F.array_sort(_timing(F.col("DELAYS"))).alias("delays"),
        F.coalesce(_number(F.col("OFFSET")), F.lit(0.0)).alias("offset"), (F.col("OFFSET").isNotNull() & _number(F.col("OFFSET")).isNull()).alias("no_offset"),
        (F.length(F.trim(F.coalesce("WARPS", F.lit("")))) > 0).alias("warps"),
        F.filter(F.split(F.coalesce("TIMESIGNATURES", F.lit("")), ","), lambda x: F.length(F.trim(F.col("TIMESIGNATURES"))) > 0).alias("signatures"),
    )
    signed = lambda x: F.split(F.trim(x), "=")
    odd = F.exists("signatures", lambda x: (F.size(signed(x)) != 3) | _number(F.get(signed(x), 1)).isNull() | _number(F.get(signed(x), 2)).isNull())
    other = F.exists("signatures", lambda x: (_number(F.get(signed(x), 1)) != 4) | (_number(F.get(signed(x), 2)) != 4))
    steady = F.forall(F.sequence(F.lit(1), F.greatest(F.size("bpms"), F.lit(1))), lambda k: F.coalesce(F.get("bpms", k)["beat"] > F.get("bpms", k - 1)["beat"], F.lit(True)))
    below = lambda c: F.exists(c, lambda e: (e["beat"] < 0) | (e["value"] < 0))
    reason = (
        F.when(F.col("few") | F.col("no_meter") | (F.size("bpms") == 0) | _broken(F.col("bpms")) | _broken(F.col("stops")) | _broken(F.col("delays")) | F.col("no_offset"), MALFORMED)
        .when(F.exists("bpms", lambda e: e["beat"] < 0), TIMING)
        .when((F.get("bpms", F.lit(0))["beat"] != 0) | ~steady, MALFORMED)
        .when(F.exists("bpms", lambda e: e["value"] <= 0) | below("stops") | below("delays") | F.col("warps"), TIMING)
        .when(odd, MALFORMED)
        .when(other, TIMING)
    )
    charts = charts.withColumn("reason", reason)
    # dealt by number: notes pack so well that a few bytes of shuffle, joined into one task, are much to read
    parts = max(int(text.sparkSession.conf.get("spark.sql.shuffle.partitions")), text.sparkSession.sparkContext.defaultParallelism)
    read = charts.where("reason IS NULL").select("path", "chart", "plain", "bpms", "stops", "delays", "offset", "notes").repartition(parts, "path", "chart")
    measures = read.select("path", "chart", "plain", "bpms", "stops", "delays", "offset", F.posexplode(F.split("notes", ",")).alias("measure", "lines"))
    cleaned = F.filter(F.transform(F.split("lines", r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "//.*$", ""), r"\t", " "))), lambda x: x != "")
    measures = measures.withColumn("lines", cleaned).withColumn("n", F.size("lines"))
    steps = measures.select("path", "chart", "plain", "bpms", "stops", "delays", "offset", "measure", "n", F.posexplode("lines").alias("r", "row"))
    beat = 4.0 * (F.col("measure") + F.col("r") / F.col("n"))
    count = lambda p: F.regexp_count("row", F.lit(p))
    taps = (count("[124]") > 0) | (~F.col("plain") & (count("L") > 0))
    steps = steps.select("path", "chart", "plain", "measure", "r", F.length("row").alias("width"), count("[^0]").alias("objects"), count("3").alias("tails"), count("[MFK]").alias("hazards"), count("[^01234MFKL]").alias("unknown"), count("L").alias("lifts"), F.when(taps, F.round(_seconds(beat), 6)).alias("t"))
    before = F.max("t").over(Window.partitionBy("path", "chart").orderBy("measure", "r").rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumn("back", F.coalesce(F.col("t") < before, F.lit(False))).withColumn("lifted", F.col("plain") & (F.col("lifts") > 0))
    fault = lambda least, most: F.when((least("width") != most("width")) | (most("unknown") > 0), MALFORMED).when(most("lifted") | (least("t") < 0) | most("back"), TIMING)
    total = steps.groupBy("path", "chart").agg(F.sum("objects").alias("objects"), F.sum("tails").alias("tails"), F.sum("hazards").alias("hazards"), F.count("t").alias("markers"), fault(F.min, F.max).alias("fault"))
    judged = charts.select("path", "chart", "mode", "difficulty", "reason").join(total, ["path", "chart"], "left")
    judged = judged.withColumn("reason", F.coalesce("reason", "fault")).drop("fault")
    zero = lambda c: F.coalesce(F.when(F.col("reason").isNull(), F.col(c)), F.lit(0)).alias(c)
    judged = judged.select("path", "chart", "mode", "difficulty", zero("objects"), zero("tails"), zero("hazards"), zero("markers"), "reason")
    without = text.select("path").join(judged.select("path"), "path", "left_anti")
    none = without.select("path", F.lit(None).cast("int").alias("chart"), F.lit(None).cast("string").alias("mode"), F.lit(None).cast("string").alias("difficulty"), *[F.lit(0).cast("long").alias(c) for c in ("objects", "tails", "hazards", "markers")], F.lit(MALFORMED).alias("reason"))
    whole = Window.partitionBy("path", "chart")
    markers = steps.withColumn("fault", fault(lambda c: F.min(c).over(whole), lambda c: F.max(c).over(whole))).where("fault IS NULL AND t IS NOT NULL").select("path", "chart", "t")
    return markers, judged.unionByName(none)


def hit_object_charts(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markers and charts of hit-object files: sections of lines, one object a line ``x,y,milliseconds,type,...``.

    Bits of a type: 1 a circle, 2 a slider, 8 a spinner, 128 a hold.  Circles start an event
    in every mode, sliders in the standard one, holds in mania; spinners are hazards and
    whatever else is left out tails.  Charts as of ``step_charts``, chart 0.  Reasons: no
    header (format), a mode that is not ``MODES`` (mode), times that are negative or not
    finite (timing), a mode, field or type that is no number, under five fields, or times
    that go back (malformed).
    """
    lines = F.transform(F.split(F.coalesce("body", F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"\t", " ")))
    rows = text.select("path", F.posexplode(lines).alias("k", "line")).where("line <> '' AND NOT startswith(line, '//')")
    title = F.when(F.col("line").rlike(r"^\[.*\]$"), F.substring(F.col("line"), F.lit(2), F.length("line") - 2))
    section = F.last(title, ignorenulls=True).over(Window.partitionBy("path").orderBy("k"))
    rows = rows.withColumn("title", title).withColumn("section", section).where("title IS NULL").drop("title")
    key, value = F.trim(F.regexp_extract("line", "^([^:]*):", 1)), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))
    field = lambda s, n: F.min_by(F.when((F.col("section") == s) & F.col("line").contains(":") & (key == n), value), F.when((F.col("section") == s) & F.col("line").contains(":") & (key == n), F.col("k")))
    header = F.max(F.col("section").isNull() & F.col("line").contains("file format"))
    files = text.select("path").distinct().join(rows.groupBy("path").agg(header.alias("header"), field("General", "Mode").alias("mode_text"), field("Metadata", "Version").alias("version"), F.coalesce(field("Difficulty", "KeyCount"), field("Difficulty", "CircleSize")).alias("meter")), "path", "left")
    mode = F.coalesce("mode_text", F.lit("0"))
    files = files.withColumn("m", F.when(mode.rlike(r"^[+-]?[0-9]{1,9}$"), mode.try_cast("int")))
    parts = F.split("line", ",")
    hits = rows.where("section = 'HitObjects'").select("path", "k", F.size(parts).alias("fields"), _number(F.get(parts, F.lit(2))).alias("ms"), F.get(parts, F.lit(2)).rlike(r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$").alias("endless"), F.when(F.get(parts, F.lit(3)).rlike(r"^\s*[+-]?[0-9]{1,9}\s*$"), F.trim(F.get(parts, F.lit(3))).try_cast("int")).alias("bits"))
    hits = hits.join(files.select("path", "m"), "path").withColumn("t", F.round(F.col("ms") / 1000, 6))
    before = F.lag("t").over(Window.partitionBy("path").orderBy("k"))
    bit = lambda n: F.col("bits").bitwiseAND(n) != 0
    spinner = bit(8)
    starts = ~spinner & ((bit(1) & F.col("m").isin(0, 1, 3)) | (bit(2) & (F.col("m") == 0)) | (bit(128) & (F.col("m") == 3)))
    fault = F.when(F.col("fields") < 5, MALFORMED).when(F.col("endless") & F.col("bits").isNotNull(), TIMING).when(F.col("ms").isNull() | F.col("bits").isNull(), MALFORMED).when(F.col("ms") < 0, TIMING).when(F.col("t") < before, MALFORMED)
    hits = hits.withColumn("fault", fault).withColumn("starts", starts).withColumn("spinner", spinner)
    total = hits.groupBy("path").agg(F.count("*").alias("objects"), F.count_if(~F.col("spinner") & ~F.col("starts")).alias("tails"), F.count_if("spinner").alias("hazards"), F.count_if("starts").alias("markers"), F.min_by(F.col("fault"), F.when(F.col("fault").isNotNull(), F.col("k"))).alias("fault"))
    names = F.lit(None).cast("string")
    for number, name in MODES.items():
        names = F.when(F.col("m") == number, name).otherwise(names)
    reason = F.when(~F.coalesce("header", F.lit(False)), FORMAT).when(F.col("m").isNull(), MALFORMED).when(names.isNull(), MODE).when(F.col("meter").isNotNull() & _number(F.col("meter")).isNull(), MALFORMED)
    judged = files.join(total, "path", "left").withColumn("reason", F.coalesce(reason, "fault"))
    zero = lambda c: F.coalesce(F.when(F.col("reason").isNull(), F.col(c)), F.lit(0)).alias(c)
    judged = judged.select("path", F.lit(0).alias("chart"), names.alias("mode"), F.when(F.length("version") > 0, F.col("version")).otherwise("Unnamed").alias("difficulty"), zero("objects"), zero("tails"), zero("hazards"), zero("markers"), "reason")
    markers = hits.where("starts").join(judged.where("reason IS NULL").select("path"), "path", "left_semi").select("path", F.lit(0).alias("chart"), "t")
    return markers, judged
