"""One batch of launches with their sources and conflicts: merged, appended and published together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recfuse.operators import upsert as UP
from recfuse.sources.snapshots import SnapshotTables


@dataclass(frozen=True)
class Batch:
    """Next launches, rows to append, and what happened per launch."""

    launches: DataFrame
    sources: DataFrame
    conflicts: DataFrame
    summary: DataFrame


def plan_batch(
    current: DataFrame,
    launches: DataFrame,
    sources: DataFrame,
    conflicts: DataFrame,
    as_of: Column,
    key: str = "slug",
    seq: str = "ingest_seq",
) -> Batch:
    """``launches`` is upserted into ``current``; the children name their launch by ``key``."""
    merged = UP.merge(current, launches, key, seq, as_of)
    touched = merged.filter("_change <> 'kept'").select("id", key, "_change")
    new_sources = UP.children_for(touched, sources, key, [seq])
    new_conflicts = UP.new_conflicts(touched, conflicts, key, as_of, [seq])

    def per_launch(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.col("launch_id").alias("id")).agg(F.count("*").alias(name))

    summary = (
        touched.join(per_launch(new_sources, "sources_created"), "id", "left")
        .join(per_launch(new_conflicts, "conflicts_created"), "id", "left")
        .select(
            "id",
            key,
            (F.col("_change") == "created").alias("was_created"),
            F.coalesce("sources_created", F.lit(0)).alias("sources_created"),
            F.coalesce("conflicts_created", F.lit(0)).alias("conflicts_created"),
        )
    )
    return Batch(merged, new_sources, new_conflicts, summary)


def totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count_if("was_created").alias("launches_created"),
        F.count_if(~F.col("was_created")).alias("launches_updated"),
        F.coalesce(F.sum("sources_created"), F.lit(0)).alias("total_sources_created"),
        F.coalesce(F.sum("conflicts_created"), F.lit(0)).alias("total_conflicts_created"),
    )


def persist_batch(
    tables: SnapshotTables, launches: DataFrame, sources: DataFrame, conflicts: DataFrame, as_of: Column, batch: int | None = None
) -> DataFrame:
    """Write a batch in one commit and return its per-launch summary, read from what was written."""
    plan = plan_batch(tables.read("launches"), launches, sources, conflicts, as_of)
    merged = tables.stage("launches", plan.launches, extra=["_change"])
    new_sources = tables.stage("sources", plan.sources)
    new_conflicts = tables.stage("conflicts", plan.conflicts)
    tables.commit(staged_replace=["launches"], staged_append=["sources", "conflicts"], batch=batch)
    touched = merged.filter("_change <> 'kept'").select("id", "slug", (F.col("_change") == "created").alias("was_created"))
    count = lambda df, name: df.groupBy(F.col("launch_id").alias("id")).agg(F.count("*").alias(name))
    return (
        touched.join(count(new_sources, "sources_created"), "id", "left")
        .join(count(new_conflicts, "conflicts_created"), "id", "left")
        .na.fill(0, ["sources_created", "conflicts_created"])
    )
