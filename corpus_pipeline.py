"""Corpus pipeline: quality, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and
is written as Parquet and read again.  All but the last return the columns of
documents, extra columns included, whatever their names.  Rows without a doc_id are
left out by the first stage that sees them; null and empty texts, repeated rows and
texts of any length pass through every stage as each says; a table without rows
gives none.  Scratch tables go with the stage that wrote them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoflux.llm import common, mixing, packing, pii, quality, shingles


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects (low quality or toxic) go.

    Null and empty texts are judged by what features they have; repeated rows are
    judged alike; without usable labels, or of an empty table, nothing goes.
    """
    return quality.kept(docs, common.table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a 5-word similarity of 0.8 or more the smallest doc_id stays.

    Of one doc_id with several texts each text is a row of its own; in one group the
    text of the smallest MD5 stays.  Of equal rows (doc_id and text) one stays.  Null,
    empty and white texts are one group.
    """
    found = shingles.near_duplicates(docs, size=5, least=0.8)
    kept = common.written(found.groupBy("component").agg(F.min(F.struct("doc_id", "copy", "n_rows")).alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x.copy").alias("_copy"), F.col("x.n_rows").alias("_rows")), "kept")
    copy = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), copy.alias("_own"))
    rows = rows.join(kept, (F.col("_doc") == F.col("_id")) & (F.col("_own") == F.col("_copy")), "left_semi")
    return (rows.dropDuplicates(["_doc", "_own"]) if kept.where("_rows > 1").head(1) else rows).select("_row.*")


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced; no document goes.  Null texts become empty."""
    return pii.sanitised(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all tokens at equal source weights, as far as each source reaches; no repeats.

    Documents without a token go, and so do those behind a source's budget; the one
    it ends in keeps its first words.  Null names are a source ``unknown``.
    """
    return mixing.cut_to(docs, mixing.mix(docs, share=0.9, epochs=1))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence; an empty text is the one end token.

    They are written here, with as many rows a batch as packing works on at once:
    executors come with heaps that the stages before have filled.
    """
    with common.few_rows(spark, packing.ROWS):
        return common.written(packing.pack(docs), "pieces")


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("personal data", personal_data_stage),
    ("mixture", mixture_stage),
    ("packing", packing_stage),
]

#: The classifier is trained, and the tokenizer is no SQL function.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        with common.own_scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
