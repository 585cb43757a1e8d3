"""Mixing sources to target weights by hierarchical budgets (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEVELS = ("domain", "lang", "source")
#: Leading hex digits of a document's seeded order that make a slice of its leaf.
SLICE = 3


def domain_of(source: Column) -> Column:
    """The tables name no domain: sources fall into four by their number."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int") % 4, F.lit(0)).cast("string"))


def _weight(level: int, weights: dict[tuple[str, ...], float]) -> Column:
    got = F.lit(1.0)
    for path, w in weights.items():
        if len(path) == level + 1:
            same = F.lit(True)
            for name, value in zip(LEVELS, path, strict=False):
                same = same & (F.col(name) == value)
            got = F.when(same, F.lit(float(w))).otherwise(got)
    return got


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share each parent's ``budget`` among its children: adds ``quota``.

    By weight, none above its ``room``: children in order of room per weight are full
    as long as the level at which they are fits the budget, and what they leave goes
    to their siblings by weight.  Whole tokens: largest fractions are rounded up.  A
    child of weight 0 gets nothing.
    """
    key = [F.col(p) for p in parent] or [F.lit(0)]
    children = children.withColumn("room", F.when(F.col("weight") > 0, F.col("room")).otherwise(0))
    level = F.try_divide(F.col("room").cast("double"), F.col("weight"))
    order = Window.partitionBy(*key).orderBy(level.asc_nulls_last(), name)
    to_end = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = children.withColumn("budget", F.least("budget", F.sum("room").over(Window.partitionBy(*key))))
    rows = rows.withColumn("full", F.coalesce(level * F.sum("weight").over(to_end) + F.coalesce(F.sum("room").over(before), F.lit(0)) <= F.col("budget"), F.lit(False)))
    whole = Window.partitionBy(*key)
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0)).over(whole)
    per = F.coalesce(F.try_divide(left.cast("double"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(whole)), F.lit(0.0))
    rows = rows.withColumn("share", F.when(F.col("full"), F.col("room").cast("double")).otherwise(per * F.col("weight")))
    rows = rows.withColumn("part", F.when(F.col("full"), F.col("room")).otherwise(F.floor("share")))
    rows = rows.withColumn("spare", F.col("budget") - F.sum("part").over(whole))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.col("share") - F.col("part")), name))
    return rows.withColumn("quota", F.col("part") + F.when(~F.col("full") & (F.col("weight") > 0) & (rank <= F.col("spare")), 1).otherwise(0)).drop("full", "share", "part", "spare")


def budgets(leaves: DataFrame, tokens: int, weights: dict[tuple[str, ...], float], epochs: int) -> DataFrame:
    """Token quota of every leaf: ``leaves`` with ``quota``.

    Budgets go down the tree.  A node's room is what its leaves can give in
    ``epochs`` passes, so a short leaf's rest stays with its siblings, and only what
    a whole subtree cannot give goes to its ancestors' other children.  What is under
    a weight of 0 gives nothing; a negative weight is an error.
    """
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights cannot be negative")
    wanted = F.least(*[_weight(n, weights) for n in range(len(LEVELS))]) > 0
    leaves = leaves.withColumn("room", F.when(wanted, F.col("tokens") * epochs).otherwise(0))
    above = None
    for n, name in enumerate(LEVELS):
        path, parent = list(LEVELS[: n + 1]), list(LEVELS[:n])
        level = leaves.groupBy(*path).agg(F.sum("room").alias("room")).withColumn("weight", _weight(n, weights))
        level = level.withColumn("budget", F.lit(tokens).cast("long")) if above is None else level.join(above.select(*parent, F.col("quota").alias("budget")), parent)
        above = fill(level, parent, name)
    return leaves.drop("room").join(above.select(*LEVELS, "quota"), list(LEVELS))


def sized(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """``(doc_id, copy, domain, lang, source, tokens)``; tokens are words, null names ``unknown``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("copy"), (domain if domain is not None else domain_of(name("source"))).alias("domain"), name("lang").alias("lang"), name("source").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"))


def mix(docs: DataFrame, share: float = 0.6, epochs: int = 2, weights: dict[tuple[str, ...], float] | None = None, seed: int = 17, domain: Column | None = None) -> DataFrame:
    """Choose tokens so that sources come to their target weights.

    The target is ``share`` of all tokens, split by ``weights`` (path -> weight,
    1 where none is given) down the domain-language-source tree.  A leaf gives whole
    epochs and then a prefix of the next one; every epoch has an order of its own,
    by the MD5 of seed, epoch and doc_id.  ``doc_id, copy, domain, lang, source,
    tokens, epochs`` (whole passes) ``, taken`` (tokens of the last, partial pass).

    A prefix needs no leaf in one task: slices of the order are summed first, the
    slices below the quota are taken whole, and only the one it ends in is ranked.

    Null texts have no tokens, null names are ``unknown``; repeated rows are kept
    apart; an empty table gives no rows.
    """
    rows = common.written(sized(docs, domain), "sized")
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    quotas = budgets(leaves, int(total * share), weights or {}, epochs)
    n = F.greatest("tokens", F.lit(1))
    quotas = common.written(quotas.select(*LEVELS, F.floor(F.col("quota") / n).cast("long").alias("epochs"), (F.col("quota") % n).alias("rest")), "quotas")
    order = F.md5(F.concat_ws(":", F.lit(seed), "epochs", "doc_id"))
    rows = rows.join(quotas, list(LEVELS)).withColumn("r", order).withColumn("slice", F.left("r", F.lit(SLICE)))
    slices = rows.groupBy(*LEVELS, "slice").agg(F.sum("tokens").alias("slice_tokens"))
    below = F.sum("slice_tokens").over(Window.partitionBy(*LEVELS).orderBy("slice")) - F.col("slice_tokens")
    slices = common.written(slices.withColumn("below", below), "slices")
    rows = rows.join(slices, [*LEVELS, "slice"])
    ends = (F.col("below") < F.col("rest")) & (F.col("below") + F.col("slice_tokens") > F.col("rest"))
    whole = rows.where(~ends).withColumn("taken", F.when(F.col("below") < F.col("rest"), F.col("tokens")).otherwise(0))
    at = F.col("below") + F.sum("tokens").over(Window.partitionBy(*LEVELS, "slice").orderBy("r", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    ranked = rows.where(ends).withColumn("taken", F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - at)))
    out = ["doc_id", "copy", *LEVELS, "tokens", "epochs", F.col("taken").cast("long").alias("taken")]
    return whole.select(out).unionByName(ranked.select(out)).where("epochs > 0 OR taken > 0")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", *LEVELS, "tokens", "epochs", "taken")


def _fill_sql(level: str, parent: str, name: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
 a AS (SELECT *, least(budget, sum(room) OVER ({by}))::DOUBLE AS b FROM {level}),
 f AS (SELECT *, room / weight * sum(weight) OVER ({by} ORDER BY room / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
   + coalesce(sum(room) OVER ({by} ORDER BY room / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= b AS ok FROM a),
 s AS (SELECT *, CASE WHEN ok THEN room::DOUBLE ELSE (b - sum(CASE WHEN ok THEN room ELSE 0 END) OVER ({by})) / sum(CASE WHEN ok THEN 0.0 ELSE weight END) OVER ({by}) * weight END AS share FROM f),
 p AS (SELECT *, CASE WHEN ok THEN room::BIGINT ELSE floor(share)::BIGINT END AS part FROM s),
 q AS (SELECT *, b - sum(part) OVER ({by}) AS spare, row_number() OVER ({by} ORDER BY share - part DESC, {name}) AS k FROM p)
 SELECT * EXCLUDE (budget, b, ok, share, part, spare, k), (part + CASE WHEN NOT ok AND k <= spare THEN 1 ELSE 0 END)::BIGINT AS quota FROM q"""


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, 'd' || coalesce(try_cast(nullif(regexp_extract(coalesce(source, 'unknown'), '([0-9]{{1,9}})$', 1), '') AS INT) % 4, 0) AS domain,
   coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents WHERE doc_id IS NOT NULL),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
l1 AS (SELECT domain, sum(tokens) * 2 AS room, 1.0::DOUBLE AS weight, (SELECT floor(sum(tokens)::DOUBLE * 0.6::DOUBLE)::BIGINT FROM d) AS budget FROM leaf GROUP BY ALL),
q1 AS (WITH {_fill_sql("l1", "", "domain")}),
l2 AS (SELECT leaf.domain, lang, sum(tokens) * 2 AS room, 1.0::DOUBLE AS weight, any_value(quota) AS budget FROM leaf JOIN q1 USING (domain) GROUP BY ALL),
q2 AS (WITH {_fill_sql("l2", "domain", "lang")}),
l3 AS (SELECT leaf.domain, leaf.lang, source, sum(tokens) * 2 AS room, 1.0::DOUBLE AS weight, any_value(quota) AS budget FROM leaf JOIN q2 USING (domain, lang) GROUP BY ALL),
q3 AS (WITH {_fill_sql("l3", "domain, lang", "source")}),
quota AS (SELECT domain, lang, source, quota // greatest(tokens, 1) AS epochs, quota % greatest(tokens, 1) AS rest FROM leaf JOIN q3 USING (domain, lang, source)),
o AS (SELECT d.*, epochs, rest, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', 17, epochs, doc_id)), doc_id ROWS UNBOUNDED PRECEDING) - tokens AS pos FROM d JOIN quota USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, epochs::BIGINT AS epochs, greatest(0, least(tokens, rest - pos))::BIGINT AS taken FROM o WHERE epochs > 0 OR rest > pos AND tokens > 0
"""


def cut_to(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``docs`` as ``mix`` chose them for one epoch: whole, or the first ``taken`` words.

    Documents that were not chosen go.  All columns stay, ``n_chars`` is counted
    anew; rows that repeat doc_id and text are cut alike, to the longest choice; null
    texts have no word and go; an empty table gives no rows.
    """
    keys = chosen.groupBy("doc_id", "copy").agg(F.max(F.when(F.col("epochs") > 0, F.col("tokens")).otherwise(F.col("taken"))).alias("taken"), F.max("tokens").alias("tokens"))
    joined = common.whole_rows(docs).join(keys, ["doc_id", "copy"])
    part = F.array_join(F.slice(common.words(F.col("text")), F.lit(1), F.col("taken").cast("int")), " ")
    cut = joined.withColumn("text", F.when(F.col("taken") < F.col("tokens"), part).otherwise(F.col("text")))
    return cut.select(common.with_text(docs))
