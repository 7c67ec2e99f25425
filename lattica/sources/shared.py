"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed below ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        where = tempfile.mkdtemp(prefix="lattica-") if master.startswith("local") and "cluster" not in master else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lattica"
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()
