"""The classifier on labelled documents that it was not fitted on."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronoflux.llm import quality

DATA = Path("/root/testdata/sf0.1")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


def test_held_out_documents_are_judged_right(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0)
    found = quality.scored(docs, labels.where("NOT held").drop("held")).select("doc_id", quality.accepted().alias("keep"))
    rates = found.join(labels.where("held"), "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {(r["quality"], r["toxic"]): r["kept"] for r in rates}
    assert kept[1, 0] > 0.97
    assert kept[1, 1] < 0.1
    assert kept[0, 0] < 0.15
