"""Ranks inside a key that stay exact, and spread over many tasks, when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recfuse import constants as C
from recfuse.functions import text as X
from recfuse.schema import RecordProfile

CHUNK = 1 << 20


def source_priority(name: Column | str, priorities: dict[str, int] | None = None) -> Column:
    """Trust level of a source name: the longest known name it contains decides."""
    priorities = C.SOURCE_PRIORITIES if priorities is None else priorities
    lowered = F.lower(X.col(name))
    level = F.lit(None).cast("int")
    for known, value in sorted(priorities.items(), key=lambda kv: len(kv[0])):
        level = F.when(lowered.contains(known), F.lit(value)).otherwise(level)
    return F.coalesce(level, F.lit(C.UNKNOWN_PRIORITY))


def with_priority(claims: DataFrame, profile: RecordProfile) -> DataFrame:
    given = F.col(profile.priority) if profile.priority else source_priority(profile.source)
    return claims.withColumn("_prio", given.cast("int"))


def rank_key(profile: RecordProfile) -> Column:
    """Sortable trust order of a claim inside its key; the smallest is the best claim."""
    return F.struct(
        F.col("_prio").alias("p"),
        (-F.col(profile.quality)).alias("q"),
        *[F.col(s).alias(f"s{i}") for i, s in enumerate(profile.seq)],
    )


def spread_row_number(
    df: DataFrame,
    keys: Sequence[str],
    lead: Sequence[Column],
    seq: Sequence[str],
    out: str,
    chunk: int = CHUNK,
) -> DataFrame:
    """``row_number()`` per ``keys`` ordered by ``lead`` then ``seq``, without a window per key.

    A group is cut into pieces by the leading sort values and by ranges of the first ``seq``
    column. Numbers inside a piece come from a window over that piece alone; the number of rows
    in earlier pieces is a running total over the (few) piece counts of the key.
    """
    lead_names = [f"_lead{i}" for i in range(len(lead))]
    pieces = [*keys, *lead_names, "_piece"]
    cut = df.withColumns(dict(zip(lead_names, lead))).withColumn("_piece", F.floor(F.col(seq[0]) / F.lit(chunk)))
    order = [F.col(n).asc_nulls_last() for n in [*lead_names, "_piece"]]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*pieces)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
        .select(*[F.col(p).alias(f"o{p}") for p in pieces], "_before")
    )
    inside = Window.partitionBy(*pieces).orderBy(*[F.col(s).asc_nulls_last() for s in seq])
    numbered = cut.withColumn("_inside", F.row_number().over(inside))
    same = None
    for p in pieces:
        cond = F.col(p).eqNullSafe(F.col(f"o{p}"))
        same = cond if same is None else same & cond
    return (
        numbered.join(offsets, same)
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("int"))
        .drop("_inside", "_before", "_piece", *lead_names, *[f"o{p}" for p in pieces])
    )


def rank_claims(claims: DataFrame, profile: RecordProfile, out: str = "rank", chunk: int = CHUNK) -> DataFrame:
    """Trust rank of every claim in its key: priority, then quality, then ingest order."""
    ranked = with_priority(claims, profile)
    lead = [F.col("_prio"), -F.col(profile.quality)]
    return spread_row_number(ranked, [profile.key], lead, profile.seq, out, chunk)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``: an aggregate, so hot keys combine on the map side."""
    names = df.columns
    rest = [n for n in names if n not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*[F.col(n) if n in keys else F.col(f"_row.{n}") for n in names])
