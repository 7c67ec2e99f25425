"""Result shapes: summaries, element lists, search sets, and decisions on conditional writes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALWAYS = ["resourceType", "id", "meta"]


def elements(docs: DataFrame, wanted: list[str], mandatory: list[str] = ()) -> DataFrame:
    """Requested and mandatory elements only, tagged as subsetted."""
    keep = [c for c in docs.columns if c in {*ALWAYS, *wanted, *mandatory}]
    return docs.select(*keep).withColumn("tag", F.lit("SUBSETTED"))


def summary(docs: DataFrame, mode: str, in_summary: list[str] = (), mandatory: list[str] = ()) -> DataFrame:
    """``data`` (no narrative), ``text``, ``true``, ``count``, ``false``."""
    if mode == "count":
        return docs.agg(F.count(F.lit(1)).alias("total"))
    if mode == "data":
        return docs.drop("text").withColumn("tag", F.lit("SUBSETTED"))
    if mode == "text":
        return elements(docs, ["text"], mandatory)
    return elements(docs, list(in_summary), mandatory) if mode == "true" else docs


def searchset(matches: DataFrame, included: DataFrame, body: Column) -> DataFrame:
    """Entries of a search set as JSON text: matches first, then included documents."""
    def entry(df: DataFrame, mode: str) -> DataFrame:
        return df.select(F.lit(mode).alias("mode"), F.to_json(F.struct(body.alias("resource"), F.struct(F.lit(mode).alias("mode")).alias("search"))).alias("entry"))

    return entry(matches, "match").unionByName(entry(included, "include"))


def conditional(requests: DataFrame, found: DataFrame, key: str = "request_id") -> DataFrame:
    """For each conditional write: how many documents match, and what follows: create, update or conflict."""
    return conditional_on(requests, found, key)


def conditional_on(requests: DataFrame, documents: DataFrame, on: str) -> DataFrame:
    """``conditional`` for documents with the key that requests name: matches are counted by key before the join, which emits no pairs."""
    n = documents.groupBy(on).agg(F.count(F.lit(1)).alias("matches"), F.min("resource_id").alias("target"))
    j = requests.join(n, on, "left").withColumn("matches", F.coalesce("matches", F.lit(0)).cast("long"))
    return j.withColumn("action", F.when(F.col("matches") == 0, "create").when(F.col("matches") == 1, "update").otherwise("conflict")).withColumn("target", F.when(F.col("matches") == 1, F.col("target")))


def by_canonical(docs: DataFrame, url: str, version: str | None = None) -> DataFrame:
    """Documents of a canonical url; of a version, or of a version it begins (``1.2`` finds ``1.2.3``)."""
    out = docs.where(F.col("url") == url)
    if version:
        v = F.col("version")
        out = out.where((v == version) | v.startswith(version + ".") | v.startswith(version + "-"))
    return out


def conditional_references(rows: DataFrame, column: str, documents: DataFrame) -> DataFrame:
    """``Type?identifier=system|value`` in a column becomes ``Type/id`` where just one document matches; else it stays, with an outcome.

    ``documents``: resource_type, system, code, resource_id. Matches are counted by key before the join.
    """
    p = r"^([A-Za-z]+)\?identifier=([^|]*)\|(.*)$"
    asked = rows.withColumns({f"_{k}": F.regexp_extract(column, p, i) for i, k in enumerate(("type", "system", "code"), 1)})
    n = documents.groupBy(F.col("resource_type").alias("_type"), F.col("system").alias("_system"), F.col("code").alias("_code")).agg(F.countDistinct("resource_id").alias("_n"), F.min("resource_id").alias("_id"))
    j = asked.join(n, ["_type", "_system", "_code"], "left")
    outcome = F.when(F.col("_type") == "", "literal").when(F.col("_n").isNull(), "none").when(F.col("_n") == 1, "resolved").otherwise("several")
    return j.withColumn("outcome", outcome).withColumn(column, F.when(F.col("outcome") == "resolved", F.concat_ws("/", "_type", "_id")).otherwise(F.col(column))).drop("_type", "_system", "_code", "_n", "_id")


def _patched(document: str, steps: list[dict]) -> str | None:
    """A JSON document after add, remove, replace, move, copy and test steps at JSON pointers; None if a step fails."""
    doc = {"": json.loads(document)}

    def walk(pointer: str):
        keys = [""] + [x.replace("~1", "/").replace("~0", "~") for x in pointer.split("/")[1:]]
        at = doc
        for k in keys[:-1]:
            at = at[int(k)] if isinstance(at, list) else at[k]
        return at, len(at) if isinstance(at, list) and keys[-1] == "-" else int(keys[-1]) if isinstance(at, list) else keys[-1]

    def put(pointer: str, value) -> None:
        at, k = walk(pointer)
        if isinstance(at, list):
            if not 0 <= k <= len(at):
                raise IndexError(pointer)
            at.insert(k, value)
        else:
            at[k] = value

    try:
        for step in steps:
            op, value = step["op"], step.get("value")
            if op in ("move", "copy"):
                at, k = walk(step["from"])
                value = at.pop(k) if op == "move" else json.loads(json.dumps(at[k]))
            at, k = walk(step["path"])
            if op in ("add", "move", "copy"):
                put(step["path"], value)
            elif op == "test":
                if at[k] != value:
                    return None
            elif op == "replace":
                at[k]  # has to be there
                at[k] = value
            else:
                del at[k]
    except (KeyError, IndexError, ValueError, TypeError):
        return None
    return json.dumps(doc[""], separators=(",", ":"), ensure_ascii=False)


def json_patch(docs: DataFrame, patch: list[dict], column: str = "resource") -> DataFrame:
    """``docs`` with JSON Patch steps applied to each document; null where a step fails, as nothing of a patch applies then."""
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else _patched(t, patch))

    return docs.withColumn(column, F.pandas_udf(run, "string")(F.col(column)))


def install(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Outcomes of loading a package: created, updated or unchanged documents of each type. Both: resource_type, id, resource."""
    j = documents.join(known.withColumnRenamed("resource", "_known"), ["resource_type", "id"], "left")
    outcome = F.when(F.col("_known").isNull(), "created").when(F.col("_known") == F.col("resource"), "unchanged").otherwise("updated")
    return j.groupBy("resource_type", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def toggled(parameters: DataFrame, url: str, active: bool) -> DataFrame:
    """A parameter switched on or off."""
    return parameters.withColumn("active", F.when(F.col("url") == url, F.lit(active)).otherwise(F.col("active")))
