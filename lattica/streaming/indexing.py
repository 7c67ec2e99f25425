"""Incremental indexing: new document versions become index rows, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def version_stream(spark: SparkSession, path: str, schema: StructType, files: int = 1000) -> DataFrame:
    """Appended version files as a stream; the source keeps its own progress."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def index_stream(versions: DataFrame, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Start a query that writes the index rows of each micro-batch, the newest version of a document only.

    A batch's rows go to a folder named by its number, written anew if the batch is repeated, so a
    restart leaves no rows twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in ("resource_type", "id")]
        newest = batch.groupBy("resource_type", "id").agg(F.max_by(F.struct(*rest), "version_id").alias("v")).select("resource_type", "id", "v.*")
        extract(newest.where(~F.col("deleted"))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return versions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(spark: SparkSession, out: str) -> DataFrame:
    """Index rows of the newest indexed version of each document over all batches."""
    rows = spark.read.parquet(out)
    newest = rows.groupBy("resource_type", "resource_id").agg(F.max("version_id").alias("version_id"))
    return rows.drop("batch").join(newest, ["resource_type", "resource_id", "version_id"], "left_semi")
