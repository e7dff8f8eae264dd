"""Saved questions: paths as JSON, the newest first, deletion and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The JSON form of a path; its label goes by the name "relation".
PATHS = "array<struct<id: bigint, relation: string, sourceNodes: array<string>, targetNodes: array<string>, provenanceText: string>>"


def encoded_paths(paths: Column) -> Column:
    """JSON of an array of structs id, label, sourceNodes, targetNodes, provenanceText; null fields are left out."""
    return F.to_json(F.transform(paths, lambda p: F.struct(p["id"], p["label"].alias("relation"), p["sourceNodes"], p["targetNodes"], p["provenanceText"])))


def decoded_paths(text: Column) -> Column:
    """The array again; empty if the text isn't such JSON."""
    found = F.coalesce(F.from_json(text, PATHS), F.array().cast(PATHS))
    return F.transform(found, lambda p: F.struct(p["id"].alias("id"), p["relation"].alias("label"), p["sourceNodes"].alias("sourceNodes"), p["targetNodes"].alias("targetNodes"), p["provenanceText"].alias("provenanceText")))


def recent(history: DataFrame, most: int) -> DataFrame:
    return history.orderBy(F.desc("created_at"), F.desc("id")).limit(most)


def deleted(history: DataFrame, ids: DataFrame) -> DataFrame:
    return history.join(ids.select("id").distinct(), "id", "left_anti")


def with_analysis(history: DataFrame, saved: DataFrame) -> DataFrame:
    """History rows with new analyses (id, synthesis, hypotheses, analyzed_at) put in place of stored ones."""
    new = saved.select("id", *[F.col(c).alias(f"new_{c}") for c in ("synthesis", "hypotheses", "analyzed_at")], F.lit(True).alias("given"))
    rows = history.join(new, "id", "left")
    return rows.select(*[F.when(F.col("given"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in ("synthesis", "hypotheses", "analyzed_at") else F.col(c) for c in history.columns])


def new_items(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key``, new_items: by how many rows a refresh has made a source longer, never under 0."""
    old = before.groupBy(key).agg(F.count("*").alias("old"))
    now = after.groupBy(key).agg(F.count("*").alias("now"))
    more = F.greatest(F.lit(0), F.coalesce("now", F.lit(0)) - F.coalesce("old", F.lit(0))).cast("long")
    return now.join(old, now[key].eqNullSafe(old[key]), "left").select(now[key], more.alias("new_items"))
