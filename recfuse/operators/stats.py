"""Statistics over the curated tables and over metric events. Single passes with conditional sums."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recfuse.functions import values as V
from recfuse.operators.serve import days_before
from recfuse.session import ensure_checkpoint_dir


def _is(c: str, v: str) -> Column:
    return F.count_if(F.col(c) == v)


def launch_statistics(launches: DataFrame) -> DataFrame:
    counted = launches.agg(
        F.count("*").alias("total_launches"),
        _is("status", "upcoming").alias("upcoming_launches"),
        _is("status", "success").alias("successful_launches"),
        _is("status", "failure").alias("failed_launches"),
        F.max("launch_date").alias("latest_launch_date"),
        F.max("updated_at").alias("latest_update"),
    )
    decided = F.greatest(F.col("total_launches") - F.col("upcoming_launches"), F.lit(1))
    return counted.withColumn("success_rate", F.col("successful_launches") / decided * F.lit(100.0))


def breakdown(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def source_quality(sources: DataFrame) -> DataFrame:
    q = F.col("data_quality_score")
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return sources.agg(
        zero(F.avg(q)).alias("average_quality"),
        zero(F.min(q)).alias("min_quality"),
        zero(F.max(q)).alias("max_quality"),
        F.count("*").alias("total_sources"),
    )


def quality_by_source(sources: DataFrame) -> DataFrame:
    return sources.groupBy("source_name").agg(
        F.avg("data_quality_score").cast("double").alias("average_quality"), F.count("*").alias("n")
    )


def recent_activity(sources: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return sources.filter(F.col("scraped_at") >= days_before(as_of, days)).groupBy("source_name").agg(
        F.count("*").alias("recent_scrapes")
    )


def conflict_statistics(conflicts: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    counted = conflicts.agg(
        F.count("*").alias("total_conflicts"),
        F.count_if(~F.col("resolved")).alias("unresolved_conflicts"),
        F.count_if(F.col("created_at") >= days_before(as_of, days)).alias("recent_conflicts"),
        F.coalesce(F.avg("confidence_score").cast("double"), F.lit(0.0)).alias("average_confidence"),
    )
    done = F.col("total_conflicts") - F.col("unresolved_conflicts")
    return counted.withColumn("resolved_conflicts", done).withColumn(
        "resolution_rate", done / F.greatest("total_conflicts", F.lit(1)) * F.lit(100.0)
    )


def conflicts_by_field(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("field_name").agg(
        F.count("*").alias("total"),
        F.count_if("resolved").alias("resolved"),
        F.count_if(~F.col("resolved")).alias("unresolved"),
    )


def duplicate_conflicts(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("launch_id", "field_name").agg(F.count("*").alias("n")).filter("n > 1")


def system_statistics(launches: DataFrame, sources: DataFrame, conflicts: DataFrame, as_of: Column) -> DataFrame:
    """All table statistics as (section, item, value) rows."""
    parts = [
        unpivot(launch_statistics(launches).drop("latest_launch_date", "latest_update"), "launches"),
        keyed(breakdown(launches, "vehicle_type"), "vehicle_distribution", "vehicle_type", "n"),
        unpivot(source_quality(sources), "sources"),
        keyed(quality_by_source(sources), "quality_by_source", "source_name", "average_quality"),
        keyed(recent_activity(sources, as_of), "recent_activity", "source_name", "recent_scrapes"),
        unpivot(conflict_statistics(conflicts, as_of), "conflicts"),
        keyed(conflicts_by_field(conflicts), "conflicts_by_field", "field_name", "total"),
    ]
    return reduce(DataFrame.unionByName, parts)


def unpivot(one_row: DataFrame, section: str) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in one_row.columns])
    return one_row.select(F.lit(section).alias("section"), F.inline(items))


def keyed(df: DataFrame, section: str, item: str, value: str) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
        F.col(value).cast("double").alias("value"),
    )


def overview(launches: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Administrative overview; launches without a date count as historical."""
    counted = launches.agg(
        F.count("*").alias("total_launches"),
        F.count_if(F.col("launch_date") > as_of).alias("upcoming_launches"),
        F.count_if(F.col("created_at") > days_before(as_of, days)).alias("new_launches"),
        F.max("updated_at").alias("last_data_update"),
    )
    return counted.withColumn("historical_launches", F.col("total_launches") - F.col("upcoming_launches"))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows with a non-empty value, in percent with two digits, one row per column."""
    n = F.count("*")
    aggs = [n.alias("_n")] + [F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in columns]
    items = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                F.col(c).alias("filled"),
                F.coalesce(F.round(F.try_divide(F.col(c), F.col("_n")) * 100, 2), F.lit(0.0)).alias("percent"),
            )
            for c in columns
        ]
    )
    return df.agg(*aggs).select(F.inline(items))


def completeness_check(launches: DataFrame, date: str = "launch_date", details: str = "details") -> DataFrame:
    """Health row grading how many records have a date and details."""
    share = lambda c: F.coalesce(F.try_divide(c, F.count("*")) * 100, F.lit(0.0))
    row = launches.agg(
        share(F.count(date)).alias("date_percent"),
        share(F.count_if(F.col(details).isNotNull() & (F.col(details).cast("string") != ""))).alias("detail_percent"),
    )
    d, t = F.col("date_percent"), F.col("detail_percent")
    grade = F.when((d < 50) | (t < 30), "unhealthy").when((d < 80) | (t < 50), "degraded").otherwise("healthy")
    return row.select(
        F.lit("data_quality").alias("name"),
        grade.alias("status"),
        F.format_string("dates %.1f%%, details %.1f%%", d, t).alias("message"),
    )


def freshness_check(df: DataFrame, updated: str, as_of: Column) -> DataFrame:
    """Health row grading the age of the newest update; no data is unhealthy."""
    row = df.agg(V.age_hours(F.max(updated), as_of).alias("age"))
    age = F.col("age")
    grade = F.when(age.isNull() | (age > 24), "unhealthy").when(age > 12, "degraded").otherwise("healthy")
    return row.select(
        F.lit("scraping_freshness").alias("name"),
        grade.alias("status"),
        F.when(age.isNull(), "No data found").otherwise(F.format_string("Data is %.1f hours old", age)).alias("message"),
    )


def freshness_state(df: DataFrame, updated: str, as_of: Column) -> DataFrame:
    """The administrative variant: healthy below 12 hours, else stale; its own word for no data."""
    age = F.col("age")
    state = F.when(age.isNull(), "no_data").when(age < 12, "healthy").otherwise("stale")
    return df.agg(V.age_hours(F.max(updated), as_of).alias("age")).select(
        state.alias("status"), F.round(age, 2).alias("hours_since_update")
    )


def run_checks(checks: Mapping[str, Callable[[], DataFrame]], only: Sequence[str] | None = None) -> DataFrame:
    """Rows of the registered health checks, each under its registered name."""
    names = [n for n in checks if only is None or n in only]
    return reduce(DataFrame.unionByName, [checks[n]().withColumn("name", F.lit(n)) for n in names])


def overall_health(checks: DataFrame) -> DataFrame:
    s = F.col("status")
    counted = checks.agg(
        F.count("*").alias("total_checks"),
        F.count_if(s == "healthy").alias("healthy"),
        F.count_if(s == "degraded").alias("degraded"),
        F.count_if(s == "unhealthy").alias("unhealthy"),
    )
    status = (
        F.when(F.col("healthy") == F.col("total_checks"), "healthy")
        .when(F.col("unhealthy") > 0, "unhealthy")
        .otherwise("degraded")
    )
    return counted.withColumn("status", status)


def source_breakdown(df: DataFrame, source: str) -> DataFrame:
    """Rows per source and in total, in one pass."""
    return df.rollup(source).agg(F.count("*").alias("n"), F.grouping(source).alias("_g")).select(
        F.when(F.col("_g") == 1, "total").otherwise("source").alias("section"),
        F.when(F.col("_g") == 1, "all").otherwise(F.col(source)).alias("item"),
        "n",
    )


def hit_ratio(hit: Column, miss: Column) -> Column:
    """Aggregate: hits over lookups in percent, two digits, 0 when there were none."""
    h, m = F.count_if(hit), F.count_if(miss)
    return F.coalesce(F.round(F.try_divide(h, h + m) * 100, 2), F.lit(0.0))


def ranked_values(counted: DataFrame, groups: Sequence[str], value: str, count: str) -> DataFrame:
    """Adds ``upto``: how many rows of the group have this value or a smaller one.

    Values (distinct in their group) are dealt out by ranges, so a group spreads over as many tasks
    as it needs. Totals of the ranges before, a row per group and range, are added to the running
    total inside the range.
    """
    ensure_checkpoint_dir(counted.sparkSession)
    order = [*groups, value]
    ranged = counted.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint(eager=True)
    inside = Window.partitionBy(*groups, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*groups, "_range").agg(F.sum(count).alias("_n"))
    offsets = offsets.select(*[F.col(g).alias(f"_o_{g}") for g in groups], F.col("_range").alias("_o"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_o_{g}")) for g in groups], F.col("_range") == F.col("_o"))
    running = ranged.withColumn("_inside", F.sum(count).over(inside))
    return running.join(offsets, same).withColumn("upto", F.col("_before") + F.col("_inside")).select(*counted.columns, "upto")


def percentile_report(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Count, mean, exact median and exact p95 (the value at index int(0.95 n)) per group.

    Equal values are counted on the map side; the wanted ranks are then found by ``ranked_values``.
    """
    v, n = F.col(value), F.col("n")
    kept = df.filter(v.isNotNull())
    base = kept.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(v).alias("mean"))
    index = {"mid_low": F.floor((n - 1) / 2), "mid_high": F.floor(n / 2), "p95": F.least(F.floor(n * F.lit(0.95)), n - 1)}
    counted = kept.groupBy(*groups, v.alias("_v")).agg(F.count("*").alias("_c"))
    ranked = ranked_values(counted, groups, "_v", "_c")
    wanted = base.select(*[F.col(g).alias(f"_b_{g}") for g in groups], *[i.alias(t) for t, i in index.items()])
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_b_{g}")) for g in groups], F.lit(True))
    # The first value that as many rows reach as the index asks for.
    at = [F.min(F.when(F.col("upto") > F.col(t), F.col("_v"))).alias(t) for t in index]
    hit = ranked.join(wanted, same).groupBy(*[F.col(f"_b_{g}") for g in groups]).agg(*at)
    median = (F.col("mid_low") + F.col("mid_high")) / 2
    return base.join(hit, same).select(*groups, "n", "mean", median.alias("median"), "p95")
