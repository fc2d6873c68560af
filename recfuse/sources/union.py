"""Unions of several sources. Rows keep their source; duplicates go only after the union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recfuse.operators import dedup as DD
from recfuse.operators.stats import source_breakdown
from recfuse.sources.readers import source_catalog

# Order of a row in a union: its source's place in the list, then its order in the source.
UNION_SEQ = ("source_order", "ingest_seq")


def select_sources(
    available: Sequence[str], include: Sequence[str] | None = None, exclude: Sequence[str] | None = None
) -> list[str]:
    """Names to read: unknown names are dropped, an empty selection is an error."""
    chosen = [s for s in include if s in available] if include else list(available)
    chosen = [s for s in chosen if s not in (exclude or [])]
    if not chosen:
        raise ValueError("no valid source selected")
    return chosen


def union_sources(
    frames: Mapping[str, DataFrame], include: Sequence[str] | None = None, exclude: Sequence[str] | None = None
) -> DataFrame:
    """All rows of the selected sources, with ``source`` and ``source_order``."""
    names = select_sources(list(frames), include, exclude)
    parts = [
        frames[n].withColumns({"source": F.lit(n), "source_order": F.lit(i)}) for i, n in enumerate(names)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_fallback(
    frames: Mapping[str, DataFrame],
    primary: Sequence[str],
    fallback: Sequence[str],
    min_rows: int = 1,
    key: str = "slug",
    name: str = "mission_name",
) -> DataFrame:
    """Primary sources alone if they have ``min_rows`` rows, else together with the fallback ones.

    The count is a scalar subquery in the fallback branch's filter: no driver round trip decides.
    """
    first = union_sources(frames, primary)
    second = union_sources(frames, fallback).withColumn("source_order", F.col("source_order") + len(primary))
    count = first.agg(F.count("*")).scalar()
    rows = first.unionByName(second.filter(count < min_rows), allowMissingColumns=True)
    return DD.two_pass(rows, key, name, UNION_SEQ)


@dataclass(frozen=True)
class Bundle:
    """Unique records of all sources, the provenance of the sources read, and row counts."""

    records: DataFrame
    provenance: DataFrame
    breakdown: DataFrame


def bundle(frames: Mapping[str, DataFrame], as_of, key: str = "slug", name: str = "mission_name") -> Bundle:
    rows = union_sources(frames)
    spark = rows.sparkSession
    # A source counts as read even when it gave no rows, except documents, which are optional.
    used = [n for n in frames if n != "pdf"]
    documents = rows.filter("source = 'pdf'").select("source").distinct()
    known = source_catalog(spark)
    provenance = known.filter(F.col("source").isin(used)).unionByName(known.join(documents, "source", "left_semi"))
    return Bundle(
        DD.two_pass(rows, key, name, UNION_SEQ), provenance.withColumn("scraped_at", as_of), source_breakdown(rows, "source")
    )
