"""Tables between the stages of a long chain, in the folder all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read again, so plans stay short.

    Without that setting: a temporary folder in local mode, one of the warehouse on a
    cluster.  The table stays as long as the cluster keeps its checkpoints.
    """
    spark = df.sparkSession
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not home:
        local = spark.sparkContext.master.startswith("local")
        home = tempfile.mkdtemp(prefix="spark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_stored"
    path = f"{home}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
