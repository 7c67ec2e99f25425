"""Administrative aggregates: totals per type, coverage of an index, collisions, lost rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def type_stats(versions: DataFrame) -> DataFrame:
    """Versions, current and deleted documents and the last change of each type."""
    return versions.groupBy("resource_type").agg(
        F.count(F.lit(1)).alias("versions"), F.count_if(F.col("is_current") & ~F.col("deleted")).alias("active"),
        F.count_if(F.col("is_current") & F.col("deleted")).alias("deleted"), F.max("last_updated").alias("last_updated"))


def coverage(ix: DataFrame, totals: DataFrame) -> DataFrame:
    """Share of each type's documents that have a value of a parameter. ``totals``: resource_type, total."""
    have = ix.groupBy("resource_type", "parameter_name").agg(F.countDistinct("resource_id").alias("indexed"))
    return have.join(totals, "resource_type").withColumn("percent", F.round(100.0 * F.col("indexed") / F.col("total"), 2))


def collisions(values: DataFrame, column: str) -> DataFrame:
    """Rows, distinct values and distinct 32-bit hashes: what a short entry hash would confuse."""
    return values.agg(F.count(column).alias("n"), F.countDistinct(column).alias("distinct_values"), F.countDistinct(F.crc32(F.col(column).cast("binary"))).alias("distinct_hashes"))


def missing_from_index(base: DataFrame, ix: DataFrame) -> DataFrame:
    """Documents that no index row names."""
    return base.join(ix.select("resource_type", "resource_id").distinct(), ["resource_type", "resource_id"], "left_anti")


def catalogue(ix: DataFrame) -> DataFrame:
    """Parameters of each type as one sorted list."""
    return ix.select("resource_type", "parameter_name").distinct().groupBy("resource_type").agg(F.array_join(F.array_sort(F.collect_list("parameter_name")), ",").alias("parameters"))


def indexing_status(indexes: dict[str, DataFrame], totals: DataFrame, parameters: DataFrame) -> DataFrame:
    """For each parameter: documents indexed in any of the index tables, documents in all, rows, and the share in percent.

    ``parameters``: resource_type, parameter_name; parameters without rows and types without documents count as nothing.
    """
    key = ["resource_type", "parameter_name"]
    out = parameters.join(totals, "resource_type", "left")
    for name, ix in indexes.items():
        out = out.join(ix.groupBy(*key).agg(F.countDistinct("resource_id").alias(f"{name}_documents"), F.count(F.lit(1)).alias(f"{name}_rows")), key, "left")
    documents = F.greatest(*[F.coalesce(f"{n}_documents", F.lit(0)) for n in indexes], F.lit(0))
    rows = sum((F.coalesce(f"{n}_rows", F.lit(0)) for n in indexes), F.lit(0))
    total = F.coalesce("total", F.lit(0))
    return out.select(*key, documents.alias("indexed"), rows.alias("rows"), total.alias("total"), F.coalesce(F.round(F.try_divide(100.0 * documents, total), 2), F.lit(0.0)).alias("percent"))


def hash_collisions(indexes: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """For each index table: rows, and how many distinct entries share a 64-bit hash with another."""
    def one(name: str, ix: DataFrame, columns: list[str]) -> DataFrame:
        entries = ix.select(*columns).distinct()
        return entries.agg(F.lit(name).alias("index"), F.count(F.lit(1)).alias("entries"), (F.count(F.lit(1)) - F.countDistinct(F.xxhash64(*columns))).alias("collisions")).select("index", "entries", "collisions")

    parts = [one(n, ix, c) for n, (ix, c) in indexes.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    parts = [t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")).select("name", "rows") for n, t in tables.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def listing(rows: DataFrame, order: list[str], equal: dict | None = None, text: str = "", text_columns: list[str] = (), offset: int = 0, count: int = 100) -> DataFrame:
    """A page of an administrative list: equality filters, a text that any of some columns holds (case aside), order, offset, limit."""
    for column, value in (equal or {}).items():
        rows = rows.where(F.col(column) == value)
    if text:
        hit = F.lit(False)
        for c in text_columns:
            hit = hit | F.lower(c).contains(text.lower())
        rows = rows.where(hit)
    return rows.orderBy(*order).offset(offset).limit(count)


def bundle_detail(bundles: DataFrame, entries: DataFrame, key: str, place: str, column: str) -> DataFrame:
    """Each bundle with its entries' values as one array, in the order of their places."""
    e = entries.groupBy(key).agg(F.count(F.lit(1)).alias("entries"), F.transform(F.array_sort(F.collect_list(F.struct(place, column))), lambda x: x[column]).alias(column))
    return bundles.join(e, key, "left")


def queue_stats(jobs: DataFrame, status: str, states: dict[str, list], seconds: str) -> DataFrame:
    """Jobs by group of states, and the mean time they took."""
    counts = [F.count_if(F.col(status).isin(v)).alias(k) for k, v in states.items()]
    return jobs.agg(*counts, F.round(F.avg(seconds), 6).alias("mean"))


def counts_with(rows: DataFrame, others: DataFrame, on: str, group: str, name: str) -> DataFrame:
    """For each group: rows, and rows whose key ``others`` holds."""
    seen = others.select(on).distinct().withColumn("_seen", F.lit(1))
    return rows.join(seen, on, "left").groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count("_seen").alias(name))
