"""Personal data: patterns, and terms that give protected entities away (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Kinds in order.  Possessive, and held to the start of a run, so that long runs
#: take linear time; the matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
TERM = r"\p{L}{3,}"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    value = lambda i: back.substr(i, F.lit(1)).cast("int")
    add = lambda a, i: a + F.when(i % 2 == 1, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of the pattern is personal data of the kind."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _matches(kind: str, text: Column) -> Column:
    some = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    return F.when(some, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _lengths(text: Column, pattern: Column | str) -> Column:
    """Code points of the pieces between matches."""
    return F.transform(F.split(text, pattern, -1), lambda g: F.length(g))


def _raw(text: Column) -> Column:
    """Distinct runs of three letters or more outside e-mails, the only values with letters."""
    plain = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0)))


def terms(text: Column) -> Column:
    """Distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(_raw(text), lambda t: F.lower(t)))


def _any_valid(kind: str, matches: Column) -> Column:
    return F.exists(matches, lambda m: valid(kind, m))


def protected(text: Column) -> Column:
    """Whether a text holds personal data."""
    some = F.lit(False)
    for k in KINDS:
        some = some | _any_valid(k, _matches(k, text))
    return some


def scanned(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, copy, found, terms, text)``: matches per kind with the lengths between them.

    One pass over whole texts; ``terms`` and ``text`` are null where there is no
    personal data, so what follows moves no other text.
    """
    docs = common.documents(docs).withColumn("row", F.monotonically_increasing_id()).withColumn("copy", F.unhex(F.md5("text")))
    rows = docs.select("*", *[_matches(k, F.col("text")).alias(k) for k in KINDS])
    of = lambda n, k: F.struct(F.lit(n).alias("kind"), F.col(k).alias("m"), F.when(F.size(k) > 0, _lengths(F.col("text"), PATTERNS[k])).alias("g"))
    found = F.filter(F.array(*[of(n, k) for n, k in enumerate(KINDS)]), lambda x: F.size(x["m"]) > 0)
    some = F.lit(False)
    for k in KINDS:
        some = some | _any_valid(k, F.col(k))
    return rows.select("row", "doc_id", "copy", found.alias("found"), F.when(some, terms(F.col("text"))).alias("terms"), F.when(some, F.col("text")).alias("text"))


def _placed(rows: DataFrame, keys: list[str], m: Column, g: Column) -> DataFrame:
    """A row per match with ``y`` (the match), ``s`` and ``e``: it starts after all pieces and matches before it."""
    rows = rows.select(*keys, F.posexplode(F.arrays_zip(m.alias("m"), F.slice(g, F.lit(1), F.size(m)).alias("g"))).alias("i", "x"))
    end = F.sum(F.col("x.g") + F.length("x.m")).over(Window.partitionBy(*keys).orderBy("i"))
    return rows.withColumn("e", end.cast("long")).select(*keys, F.col("x.m").alias("y"), (F.col("e") - F.length("x.m")).alias("s"), "e")


def values(scan: DataFrame) -> DataFrame:
    """Valid values with their places: ``(row, doc_id, copy, kind, s, e, value)``."""
    rows = scan.select("row", "doc_id", "copy", F.explode("found").alias("f"))
    rows = _placed(rows.select("row", "doc_id", "copy", "f.kind", "f.m", "f.g"), ["row", "doc_id", "copy", "kind"], F.col("m"), F.col("g"))
    ok = F.lit(False)
    for n, k in enumerate(KINDS):
        ok = ok | ((F.col("kind") == n) & valid(k, F.col("y")))
    return rows.where(ok).withColumnRenamed("y", "value")


def entities(found: DataFrame) -> DataFrame:
    """``(row, doc_id, copy, entity)``: what the values protect, each once a document.

    A value stands for itself (cards and phones by their digits), for its group (an
    e-mail's domain, an address's first three parts) and for its kind, so there is
    something that recurs even where every value is unique.
    """
    kind, value = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1), F.lower("value")
    own = F.when(F.col("kind") >= 2, _digits(value)).otherwise(value)
    group = F.when(F.col("kind") == 0, F.concat(F.lit("@"), F.substring_index(value, "@", -1))).when(F.col("kind") == 1, F.concat(F.substring_index(value, ".", 3), F.lit(".*")))
    names = F.array_compact(F.array(kind, F.concat_ws(":", kind, own), group))
    return found.select("row", "doc_id", "copy", F.explode(names).alias("entity")).distinct()


def disclosures(docs: DataFrame, scan: DataFrame, known: DataFrame, support: int, threshold: float) -> DataFrame:
    """``(entity, t, disclosure)``: terms that give a protected entity away.

    disclosure = PMI(term; entity) / IC(entity), all from one count of documents:
    1 where the term comes with the entity only, 0 where they are independent.
    ``support`` different texts have to hold the entity, and as many both, so copies
    of one text prove nothing.  Entities that every document has disclose nothing.
    """
    n = float(scan.count())
    first = known.groupBy("copy").agg(F.min("row").alias("first"))
    marked = known.join(first, "copy").withColumn("text", (F.col("row") == F.col("first")).cast("int"))
    with_entity = marked.groupBy("entity").agg(F.count("*").alias("with_entity"), F.sum("text").alias("texts")).where((F.col("texts") >= support) & (F.col("with_entity") < n)).drop("texts")
    with_entity = common.written(with_entity, "entities")
    by_row = marked.join(with_entity.select("entity"), "entity").groupBy("row").agg(F.collect_list("entity").alias("entities"), F.max("text").alias("text"))
    both = scan.select("row", "terms").join(by_row, "row").select("text", "entities", F.explode("terms").alias("t")).select("text", "t", F.explode("entities").alias("entity"))
    joint = both.groupBy("entity", "t").agg(F.count("*").alias("joint"), F.sum("text").alias("texts")).where(F.col("texts") >= support).drop("texts")
    joint = common.written(joint, "joint")
    with_term = common.documents(docs).select(F.explode(terms(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("with_term"))
    pairs = joint.join(with_entity, "entity").join(with_term, "t")
    pmi = F.log(F.lit(n) * F.col("joint") / (F.col("with_entity") * F.col("with_term")))
    return pairs.select("entity", "t", (pmi / F.log(F.lit(n) / F.col("with_entity"))).alias("disclosure")).where(F.col("disclosure") >= threshold)


def disclosing(docs: DataFrame, support: int = 3, generalise: float = 0.6, remove: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan, values, and ``(doc_id, copy, drop, mask)``: each document's terms to remove and to generalise.

    A term counts in a document that holds an entity it gives away; from
    ``generalise`` on it is masked, from ``remove`` on dropped.
    """
    scan = common.written(scanned(docs), "scanned")
    found = common.written(values(scan), "values")
    known = common.written(entities(found), "known")
    pairs = common.written(disclosures(docs, scan, known, support, generalise), "pairs")
    own = known.join(pairs.select("entity").distinct(), "entity").groupBy("row").agg(F.collect_list("entity").alias("entities"))
    rows = scan.select("row", "doc_id", "copy", "terms").join(own, "row").select("doc_id", "copy", "entities", F.explode("terms").alias("t"))
    told = rows.join(pairs.select("t").distinct(), "t", "left_semi").select("doc_id", "copy", "t", F.explode("entities").alias("entity")).join(pairs, ["entity", "t"])
    told = told.groupBy("doc_id", "copy", "t").agg(F.max(F.col("disclosure") >= remove).alias("drop"))
    lists = told.groupBy("doc_id", "copy").agg(F.collect_list(F.when(F.col("drop"), F.col("t"))).alias("drop"), F.collect_list(F.when(~F.col("drop"), F.col("t"))).alias("mask"))
    return scan, found, common.written(lists, "told")


def _those(text: Column, those: Column) -> Column:
    """A text's runs of letters that are ``those`` terms, as alternatives."""
    return F.array_join(F.filter(_raw(text), lambda x: F.array_contains(those, F.lower(x))), "|")


def _pattern(text: Column, those: Column) -> Column:
    """Regular expression of e-mails, and outside them of runs of letters that are ``those`` terms."""
    email = PATTERNS["email"]
    return F.concat(F.lit(rf"{email}|(?:(?<!\p{{L}})|\G)(?:"), _those(text, those), F.lit(rf")(?:(?!\p{{L}})|(?={email}))"))


def report(docs: DataFrame, **options: float) -> DataFrame:
    """A row per document: counts per kind, hash of the base spans, all spans.

    Null and empty texts have none; repeated rows give a row each; an empty table
    gives no rows.  Spans are kind:start:end in code points, end exclusive; those
    the method adds, every occurrence of a disclosing term in a document that holds
    its entity, are of kind ``term`` and come last.
    """
    scan, found, told = disclosing(docs, **options)
    texts = scan.where("text IS NOT NULL").select("row", "doc_id", "copy", "text").join(told, ["doc_id", "copy"])
    texts = texts.withColumn("pattern", _pattern(F.col("text"), F.concat("drop", "mask")))
    matched = texts.select("row", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("m"), _lengths(F.col("text"), F.col("pattern")).alias("g"))
    added = _placed(matched, ["row"], F.col("m"), F.col("g")).where(~F.contains("y", F.lit("@"))).groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.lit(len(KINDS)).alias("kind"), "s", "e"))).alias("added"))
    base = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "s", "e"))).alias("base"), *[F.count_if(F.col("kind") == n).alias(f"n_{k}") for n, k in enumerate(KINDS)])
    none, zero = F.array().cast("array<struct<kind:int,s:bigint,e:bigint>>"), F.lit(0).cast("long")
    rows = scan.select("row", "doc_id", "copy").join(base, "row", "left").join(added, "row", "left")
    rows = rows.withColumn("base", F.coalesce("base", none)).withColumn("added", F.coalesce("added", none))
    name = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["s"], x["e"])), ",")
    return rows.select("doc_id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS], F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))


def sanitised(docs: DataFrame, **options: float) -> DataFrame:
    """``docs`` with personal data replaced by ``<KIND>`` and disclosing terms generalised or removed.

    Values go kind by kind, then terms, in documents that hold the entity they give
    away: they become ``<TERM>``, or nothing where their disclosure calls for
    removal.  Keeps all rows with a doc_id and all columns; null texts become empty; repeated rows are treated
    alike; ``n_chars``, if there, is counted anew; an empty table gives no rows.
    """
    _, _, told = disclosing(docs, **options)
    rows = common.whole_rows(docs)
    some = protected(F.col("text"))
    rest = rows.where(~some).select("_row", "text")  # a map: only texts with personal data are moved
    joined = rows.where(some).join(told, ["doc_id", "copy"], "left").select("_row", "text", "drop", "mask")

    def replacing(kind: str) -> Callable[[Column, Column], Column]:
        return lambda a, m: F.concat(a, F.when(valid(kind, m), F.lit(f"<{kind.upper()}>")).otherwise(m))

    for kind in KINDS:
        joined = joined.withColumn("m", _matches(kind, F.col("text")))
        g = F.split("text", PATTERNS[kind], -1)
        put = F.zip_with(F.slice(g, F.lit(1), F.size("m")), "m", replacing(kind))
        joined = joined.withColumn("text", F.when(F.size("m") > 0, F.concat(F.array_join(put, ""), F.element_at(g, -1))).otherwise(F.col("text")))
    for column, instead in (("drop", ""), ("mask", "<TERM>")):
        those = _those(F.col("text"), F.col(column))
        pattern = F.concat(F.lit(r"(?<![<\p{L}])(?:"), those, F.lit(r")(?!\p{L})"))
        joined = joined.withColumn("text", F.when(F.size(column) > 0, F.when(those != "", F.regexp_replace(F.col("text"), pattern, F.lit(instead))).otherwise(F.col("text"))).otherwise(F.col("text")))
    return joined.select("_row", "text").unionByName(rest).select(common.with_text(docs))
