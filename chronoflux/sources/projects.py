"""Project documents: read, taken apart, put together, brought up to date; catalogue and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoflux.functions.columns import fixed

#: A project: one nested document a track.
SCHEMA = "schema_version string, track_id long, name string, created_at string, duration double, beats array<struct<t:double,bar:long,beat:long,confidence:double>>, onsets array<struct<id:long,t:double,strength:double,accent:boolean>>, cues array<struct<type:string,onset_id:long,t:double>>, segments array<struct<t0:double,t1:double,family:string>>"


def read_projects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents of all JSON files under ``path``, and those that cannot be read: ``file, text``."""
    rows = spark.read.schema(f"{SCHEMA}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("file", F.input_file_name())
    bad = F.col("_corrupt_record").isNotNull() | F.col("track_id").isNull()
    return rows.where(~bad).drop("_corrupt_record", "file"), rows.where(bad).select("file", F.col("_corrupt_record").alias("text"))


def explode_project(projects: DataFrame) -> dict[str, DataFrame]:
    """A table a list of the document: ``track_id``, the place in it and its fields."""
    one = lambda c: projects.select("track_id", F.posexplode(c).alias("place", "x")).select("track_id", "place", "x.*")
    return {c: one(c) for c in ("beats", "onsets", "cues", "segments")}


def assemble_project(tracks: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The inverse of ``explode_project``: lists in order of place; a track without rows has an empty list."""
    out = tracks
    for name, rows in tables.items():
        fields = [c for c in rows.columns if c not in ("track_id", "place")]
        lists = rows.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("place", F.struct(*fields).alias("x")))).alias("_l"))
        lists = lists.select("track_id", F.transform("_l", lambda p: p["x"]).alias(name))
        kind = dict(lists.dtypes)[name]
        out = out.join(lists, "track_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def migrate(projects: DataFrame) -> DataFrame:
    """Documents of any version as version 4.0, with ``merged``: beats whose bar or place was under 1.

    Confidences go; bars and places are at least 1; an accent flag becomes a cue of its
    onset, which keeps the cues there are.
    """
    old = F.coalesce(F.col("schema_version").try_cast("double"), F.lit(0.0)) < 4
    low = lambda b: (b["bar"] < 1) | (b["beat"] < 1)
    beats = F.transform("beats", lambda b: F.struct(b["t"].alias("t"), F.greatest(b["bar"], F.lit(1)).alias("bar"), F.greatest(b["beat"], F.lit(1)).alias("beat")))
    flagged = F.transform(F.filter("onsets", lambda o: F.coalesce(o["accent"], F.lit(False))), lambda o: F.struct(F.lit("accent").alias("type"), o["id"].alias("onset_id"), o["t"].alias("t")))
    had = F.filter("cues", lambda c: c["type"] == "accent")
    new = F.filter(flagged, lambda f: ~F.exists(had, lambda c: c["onset_id"] == f["onset_id"]))
    onsets = F.transform("onsets", lambda o: F.struct(o["id"].alias("id"), o["t"].alias("t"), o["strength"].alias("strength")))
    return projects.select("track_id", F.lit("4.0").alias("schema_version"), "name", "created_at", "duration", beats.alias("beats"), onsets.alias("onsets"), F.when(old, F.concat("cues", new)).otherwise(F.col("cues")).alias("cues"), "segments", F.size(F.filter("beats", low)).alias("merged"))


def beat_annotations(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text lines ``(file, n, line)`` of ``time place`` as ``file, t, beat``, and rejected files: ``file, n, reason``.

    Blank lines and those that start with # are skipped.  A file with a line that is no
    such pair, times that do not rise, or under two rows is rejected as a whole.
    """
    live = lines.where(~F.trim("line").rlike("^(#.*)?$"))
    part = F.split(F.trim("line"), r"\s+")
    rows = live.select("file", "n", F.size(part).alias("k"), F.try_element_at(part, F.lit(1)).try_cast("double").alias("t"), F.try_element_at(part, F.lit(2)).try_cast("int").alias("beat"))
    before = F.lag("t").over(Window.partitionBy("file").orderBy("n"))
    reason = F.when((F.col("k") != 2) | F.col("t").isNull() | F.col("beat").isNull(), "bad_row").when(F.col("t") <= before, "not_rising")
    rows = rows.withColumn("reason", reason)
    bad = rows.where("reason IS NOT NULL").groupBy("file").agg(F.min(F.struct("n", "reason")).alias("x")).select("file", "x.n", "x.reason")
    few = lines.select("file").distinct().join(rows.groupBy("file").agg(F.count("*").alias("k")), "file", "left").where(F.coalesce("k", F.lit(0)) < 2).select("file", F.lit(0).cast("long").alias("n"), F.lit("few_rows").alias("reason"))
    rejected = bad.withColumn("n", F.col("n").cast("long")).unionByName(few.join(bad, "file", "left_anti"))
    return rows.join(rejected, "file", "left_anti").select("file", "t", "beat"), rejected


def beat_to_seconds(rows: DataFrame, tempos: DataFrame, stops: DataFrame) -> DataFrame:
    """Rows ``(track_id, id, beat)`` with ``seconds``: the integral of 60 / bpm over ``tempos(track_id, beat, bpm)``, and ``stops(track_id, beat, length, before)``.

    A stop counts for rows behind its beat; one with ``before`` (a delay) for those at it
    too.  One running sum over tempos and one over stops, then as-of look-ups.
    """
    from chronoflux.operators import joins

    w = Window.partitionBy("track_id").orderBy("beat")
    spans = tempos.withColumn("step", (F.col("beat") - F.lag("beat").over(w)) * 60 / F.lag("bpm").over(w)).withColumn("done", F.coalesce(F.sum("step").over(w), F.lit(0.0)))
    found = joins.asof(rows.withColumn("t", F.col("beat").cast("double")), spans.select("track_id", F.col("beat").cast("double").alias("t"), "bpm", "done"), "s", width=64.0)
    out = found.withColumn("seconds", F.col("s.done") + (F.col("t") - F.col("s.ft")) * 60 / F.col("s.bpm")).drop("s")
    for early in (True, False):
        total = stops.where(F.col("before") == early).groupBy("track_id", "beat").agg(F.sum("length").alias("l")).withColumn("sum", F.sum("l").over(w))
        out = joins.asof(out, total.select("track_id", F.col("beat").cast("double").alias("t"), "sum"), "p", strict=not early, width=64.0)
        out = out.withColumn("seconds", F.col("seconds") + F.coalesce("p.sum", F.lit(0.0))).drop("p")
    return out.drop("t")


def match_catalog(audio: DataFrame, annotations: DataFrame) -> DataFrame:
    """``stem, genre, state``: paths matched by file stem; ``duplicate`` stems, ``no_annotation``, ``no_audio`` or ``matched``.  A genre is what stands before its first dash."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    a = audio.withColumn("stem", stem).groupBy("stem").agg(F.count("*").alias("a"), F.min(F.regexp_extract("genre", r"^[^-]*", 0)).alias("genre"))
    b = annotations.withColumn("stem", stem).groupBy("stem").agg(F.count("*").alias("b"))
    state = F.when((F.col("a") > 1) | (F.col("b") > 1), "duplicate").when(F.col("b").isNull(), "no_annotation").when(F.col("a").isNull(), "no_audio").otherwise("matched")
    return a.join(b, "stem", "full").select("stem", "genre", state.alias("state"))


def list_catalog(rows: DataFrame, query: str, backend: str | None, limit: int, offset: int) -> DataFrame:
    """A page of rows ``(id, name, backend, created_at)`` that hold ``query`` in id or name, newest first, with ``total, has_more, next_offset``."""
    hit = F.contains(F.lower("name"), F.lit(query.lower())) | F.contains(F.lower(F.col("id").cast("string")), F.lit(query.lower()))
    found = rows.where(hit if backend is None else hit & (F.col("backend") == backend))
    total = F.broadcast(found.agg(F.count("*").alias("total")))  # one row
    page = found.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit).join(total)
    more = F.col("total") > offset + limit
    return page.select("id", "name", "total", more.alias("has_more"), F.when(more, offset + limit).alias("next_offset"))


def content_key(rows: DataFrame, *parts: str) -> Column:
    """SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *[F.col(p).cast("string") for p in parts]), 256)


def active_variants(rows: DataFrame, key: list[str], newest: str, tie: str) -> DataFrame:
    """Each key's newest row, of two as new the greater ``tie``."""
    w = Window.partitionBy(*key).orderBy(F.desc(newest), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def onset_csv(onsets: DataFrame, accents: DataFrame) -> DataFrame:
    """Onsets as a text row ``line`` each: id, time, strength, low, mid, high with fixed decimals, and 1 for an accent."""
    rows = onsets.join(accents.select("track_id", "id", F.lit(1).alias("accent")).distinct(), ["track_id", "id"], "left")
    return rows.select("track_id", "id", F.concat_ws(",", F.col("id").cast("string"), *[fixed(F.col(c), 4) for c in ("t", "strength", "low", "mid", "high")], F.coalesce("accent", F.lit(0)).cast("string")).alias("line"))


def canonical_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``n, hash``: SHA-256 of the sum of row hashes, so no order of rows changes it; floats have six decimals, minus zero is zero."""
    kinds = dict(rows.dtypes)

    def text(c: str) -> Column:
        x = F.col(c)
        x = fixed(F.when(x == 0, 0.0).otherwise(x), 6) if kinds[c] in ("double", "float") else x.cast("string")
        return F.coalesce(x, F.lit("null"))

    line = F.concat_ws("|", *[text(c) for c in sorted(columns)])
    part = F.conv(F.left(F.md5(line), F.lit(12)), 16, 10).cast("decimal(38,0)")
    return rows.select(part.alias("h")).agg(F.count("*").alias("n"), F.sha2(F.sum("h").cast("string"), 256).alias("hash"))
