"""Versioned documents: writes as appended versions, reads as of an instant, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID = ["resource_type", "id"]


def current(versions: DataFrame) -> DataFrame:
    return versions.where("is_current AND NOT deleted")


def deleted(versions: DataFrame) -> DataFrame:
    return versions.where("is_current AND deleted")


def read_version(versions: DataFrame, kind: str, key: str, version: int) -> DataFrame:
    return versions.where((F.col("resource_type") == kind) & (F.col("id") == key) & (F.col("version_id") == version))


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    """The newest version of each document at an instant; documents deleted by then are left out.

    One aggregation with map-side combine; no sort of a document's versions.
    """
    rest = [c for c in versions.columns if c not in ID]
    newest = versions.where(F.col("last_updated") <= at).groupBy(*ID).agg(F.max_by(F.struct(*rest), F.col("version_id")).alias("v"))
    return newest.select(*ID, "v.*").where(~F.col("deleted"))


def history(versions: DataFrame, since: Column | None = None, count: int = 100, **of: str) -> DataFrame:
    """Newest versions first with the method that made them; of one document, one type or all."""
    for column, value in of.items():
        versions = versions.where(F.col(column) == value)
    if since is not None:
        versions = versions.where(F.col("last_updated") >= since)
    method = F.when(F.col("deleted"), "DELETE").when(F.col("version_id") == 1, "POST").otherwise("PUT")
    return versions.withColumn("method", method).orderBy(F.desc("last_updated"), F.desc("id"), F.desc("version_id")).limit(count)


def append_versions(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """``versions`` after creates, updates and deletes, one change a document: new version numbers and current flags.

    ``changes`` has the columns of a version but version_id and is_current; ``deleted`` marks tombstones.
    """
    last = versions.join(changes.select(*ID), ID, "left_semi").groupBy(*ID).agg(F.max("version_id").alias("last"))
    new = changes.join(last, ID, "left").withColumn("version_id", (F.coalesce("last", F.lit(0)) + 1).cast("int")).withColumn("is_current", F.lit(True)).drop("last")
    old = versions.join(changes.select(*ID).withColumn("_new", F.lit(True)), ID, "left").withColumn("is_current", F.col("is_current") & F.col("_new").isNull()).drop("_new")
    return old.unionByName(new.select(*versions.columns))


def guarded(versions: DataFrame, changes: DataFrame, expected: str = "expected_version") -> DataFrame:
    """Changes whose expected version is still the current one (optimistic locking)."""
    now = current(versions).select(*ID, F.col("version_id").alias(expected))
    return changes.join(now, [*ID, expected], "left_semi")


def purge(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """Hard delete: ``versions`` without the documents in ``keys``."""
    return versions.join(keys, ID, "left_anti")


def purge_version(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """Hard delete of single past versions (resource_type, id, version_id); a current version is kept."""
    gone = keys.join(current_keys(versions), [*ID, "version_id"], "left_anti")
    return versions.join(gone, [*ID, "version_id"], "left_anti")


def current_keys(versions: DataFrame) -> DataFrame:
    return versions.where("is_current").select(*ID, "version_id")


def replay(versions: DataFrame, entries: DataFrame) -> DataFrame:
    """A history bundle: past versions of documents, with the numbers they had, beside those known; what is known stays as it is."""
    new = entries.join(versions.select(*ID, "version_id"), [*ID, "version_id"], "left_anti")
    both = versions.drop("is_current").unionByName(new.select(*[c for c in versions.columns if c != "is_current"]))
    newest = both.groupBy(*ID).agg(F.max("version_id").alias("_newest"))
    return both.join(newest, ID).withColumn("is_current", F.col("version_id") == F.col("_newest")).select(*versions.columns)


def appended(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Only the new versions that ``changes`` make, for a table that is appended to and never rewritten; ``newest`` reads it."""
    last = versions.join(changes.select(*ID), ID, "left_semi").groupBy(*ID).agg(F.max("version_id").alias("_last"))
    return changes.join(last, ID, "left").withColumn("version_id", (F.coalesce("_last", F.lit(0)) + 1).cast("int")).drop("_last")


def newest(versions: DataFrame) -> DataFrame:
    """The current version of each document by its number, deleted ones left out; no stored flag is needed."""
    rest = [c for c in versions.columns if c not in ID]
    return versions.groupBy(*ID).agg(F.max_by(F.struct(*rest), "version_id").alias("v")).select(*ID, "v.*").where(~F.col("deleted"))


def renumbered(versions: DataFrame) -> DataFrame:
    """Versions of a batch numbered by time, the newest current."""
    by_time = Window.partitionBy(*ID).orderBy("last_updated")
    newest = Window.partitionBy(*ID)
    return versions.withColumn("version_id", F.row_number().over(by_time)).withColumn("is_current", F.col("version_id") == F.max("version_id").over(newest))


def changed_elements(versions: DataFrame, columns: list[str]) -> DataFrame:
    """Which of the columns differ from the version before."""
    w = Window.partitionBy(*ID).orderBy("version_id")
    return versions.select(*ID, "version_id", *[(~F.col(c).eqNullSafe(F.lag(c).over(w)) & (F.col("version_id") > 1)).alias(f"{c}_changed") for c in columns])
