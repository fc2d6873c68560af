"""Registered queries: statistics, health grades, percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from recfuse.operators import stats as ST
from recfuse.registry.base import query, table
from recfuse.registry.serving import T, as_of
from recfuse.registry.views import CLAIMS_SQL, CONFLICTS_SQL, LAUNCHES_SQL, SOURCES_SQL, claims, conflicts, launches, sources

_LS = """SELECT count(*) AS total_launches, count(*) FILTER (status = 'upcoming') AS upcoming_launches,
    count(*) FILTER (status = 'success') AS successful_launches, count(*) FILTER (status = 'failure') AS failed_launches,
    max(launch_date) AS latest_launch_date, max(updated_at) AS latest_update,
    count(*) FILTER (status = 'success') / greatest(count(*) - count(*) FILTER (status = 'upcoming'), 1) * 100.0::DOUBLE AS success_rate
    FROM launches"""


@query("launch_statistics", "A1", f"WITH {LAUNCHES_SQL} {_LS}")
def launch_statistics(spark, sf):
    return ST.launch_statistics(launches(spark, sf))


@query("vehicle_distribution", "A2", f"WITH {LAUNCHES_SQL} SELECT vehicle_type, count(*) AS n FROM launches GROUP BY vehicle_type")
def vehicle_distribution(spark, sf):
    return ST.breakdown(launches(spark, sf), "vehicle_type")


_SQ = """SELECT avg(data_quality_score) AS average_quality, min(data_quality_score)::DOUBLE AS min_quality,
    max(data_quality_score)::DOUBLE AS max_quality, count(*) AS total_sources FROM sources"""


@query("source_quality", "A3", f"WITH {SOURCES_SQL} {_SQ}")
def source_quality(spark, sf):
    return ST.source_quality(sources(spark, sf))


@query(
    "quality_by_source",
    "A4",
    f"WITH {SOURCES_SQL} SELECT source_name, avg(data_quality_score) AS average_quality, count(*) AS n FROM sources GROUP BY source_name",
)
def quality_by_source(spark, sf):
    return ST.quality_by_source(sources(spark, sf))


@query(
    "recent_activity",
    "A5",
    f"WITH {SOURCES_SQL} SELECT source_name, count(*) AS recent_scrapes FROM sources WHERE scraped_at >= {T} - INTERVAL 7 DAY GROUP BY 1",
)
def recent_activity(spark, sf):
    return ST.recent_activity(sources(spark, sf), as_of())


_CS = f"""SELECT count(*) AS total_conflicts, count(*) FILTER (NOT resolved) AS unresolved_conflicts,
    count(*) FILTER (created_at >= {T} - INTERVAL 7 DAY) AS recent_conflicts, avg(confidence_score) AS average_confidence,
    count(*) FILTER (resolved) AS resolved_conflicts,
    count(*) FILTER (resolved) / greatest(count(*), 1) * 100.0::DOUBLE AS resolution_rate FROM conflicts"""


@query("conflict_statistics", "A6", f"WITH {CONFLICTS_SQL} {_CS}")
def conflict_statistics(spark, sf):
    return ST.conflict_statistics(conflicts(spark, sf), as_of())


@query(
    "field_conflict_counts",
    "A7",
    f"""WITH {CONFLICTS_SQL} SELECT field_name, count(*) AS total, count(*) FILTER (resolved) AS resolved,
        count(*) FILTER (NOT resolved) AS unresolved FROM conflicts GROUP BY field_name""",
)
def field_conflict_counts(spark, sf):
    return ST.conflicts_by_field(conflicts(spark, sf))


@query(
    "duplicate_conflicts",
    "A8",
    f"WITH {CONFLICTS_SQL} SELECT launch_id, field_name, count(*) AS n FROM conflicts GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_conflicts(spark, sf):
    return ST.duplicate_conflicts(conflicts(spark, sf))


@query(
    "system_statistics",
    "A9",
    f"""WITH {LAUNCHES_SQL}, {SOURCES_SQL}, {CONFLICTS_SQL}, ls AS ({_LS}), sq AS ({_SQ}), cs AS ({_CS})
    SELECT 'launches' AS section, name AS item, value FROM (SELECT total_launches::DOUBLE AS total_launches,
        upcoming_launches::DOUBLE AS upcoming_launches, successful_launches::DOUBLE AS successful_launches,
        failed_launches::DOUBLE AS failed_launches, success_rate FROM ls)
        UNPIVOT (value FOR name IN (total_launches, upcoming_launches, successful_launches, failed_launches, success_rate))
    UNION ALL SELECT 'sources', name, value FROM (SELECT average_quality, min_quality, max_quality, total_sources::DOUBLE AS total_sources FROM sq)
        UNPIVOT (value FOR name IN (average_quality, min_quality, max_quality, total_sources))
    UNION ALL SELECT 'conflicts', name, value FROM (SELECT total_conflicts::DOUBLE AS total_conflicts, unresolved_conflicts::DOUBLE AS unresolved_conflicts,
        recent_conflicts::DOUBLE AS recent_conflicts, average_confidence, resolved_conflicts::DOUBLE AS resolved_conflicts, resolution_rate FROM cs)
        UNPIVOT (value FOR name IN (total_conflicts, unresolved_conflicts, recent_conflicts, average_confidence, resolved_conflicts, resolution_rate))
    UNION ALL SELECT 'vehicle_distribution', coalesce(vehicle_type, ''), count(*)::DOUBLE FROM launches GROUP BY vehicle_type
    UNION ALL SELECT 'quality_by_source', source_name, avg(data_quality_score) FROM sources GROUP BY source_name
    UNION ALL SELECT 'recent_activity', source_name, count(*)::DOUBLE FROM sources WHERE scraped_at >= {T} - INTERVAL 7 DAY GROUP BY source_name
    UNION ALL SELECT 'conflicts_by_field', field_name, count(*)::DOUBLE FROM conflicts GROUP BY field_name""",
)
def system_statistics(spark, sf):
    return ST.system_statistics(launches(spark, sf), sources(spark, sf), conflicts(spark, sf), as_of())


@query(
    "launch_overview",
    "A10",
    f"""WITH {LAUNCHES_SQL} SELECT count(*) AS total_launches, count(*) FILTER (launch_date > {T}) AS upcoming_launches,
        count(*) FILTER (created_at > {T} - INTERVAL 30 DAY) AS new_launches, max(updated_at) AS last_data_update,
        count(*) - count(*) FILTER (launch_date > {T}) AS historical_launches FROM launches""",
)
def launch_overview(spark, sf):
    return ST.overview(launches(spark, sf), as_of())


@query("status_breakdown", "A10", f"WITH {LAUNCHES_SQL} SELECT status, count(*) AS n FROM launches GROUP BY status")
def status_breakdown(spark, sf):
    return ST.breakdown(launches(spark, sf), "status")


@query(
    "field_coverage",
    "A11",
    f"""WITH {LAUNCHES_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (details <> '') AS d, count(*) FILTER (mission_patch_url <> '') AS p,
        count(*) FILTER (webcast_url <> '') AS w FROM launches)
    SELECT 'details' AS field, d AS filled, round(d / n * 100, 2) AS percent FROM c
    UNION ALL SELECT 'mission_patch_url', p, round(p / n * 100, 2) FROM c UNION ALL SELECT 'webcast_url', w, round(w / n * 100, 2) FROM c""",
)
def field_coverage(spark, sf):
    return ST.coverage(launches(spark, sf), ["details", "mission_patch_url", "webcast_url"])


def _checks(spark, sf):
    now = F.lit("2024-01-31 14:00:00").cast("timestamp")
    return ST.run_checks(
        {
            "data_quality": lambda: ST.completeness_check(claims(spark, sf), "dt", "details"),
            "scraping_freshness": lambda: ST.freshness_check(table(spark, sf, "events"), "ts", now),
        }
    )


_CHECKS = f"""{CLAIMS_SQL}, p AS (SELECT count(dt) / count(*) * 100 AS d, count(details) / count(*) * 100 AS t FROM claims),
    a AS (SELECT (epoch_us(TIMESTAMP '2024-01-31 14:00:00') - epoch_us(max(ts))) / 3600000000.0::DOUBLE AS age FROM events),
    checks AS (SELECT 'data_quality' AS name, CASE WHEN d < 50 OR t < 30 THEN 'unhealthy' WHEN d < 80 OR t < 50 THEN 'degraded'
        ELSE 'healthy' END AS status, format('dates {{:.1f}}%, details {{:.1f}}%', d, t) AS message FROM p
      UNION ALL SELECT 'scraping_freshness', CASE WHEN age > 24 THEN 'unhealthy' WHEN age > 12 THEN 'degraded' ELSE 'healthy' END,
        format('Data is {{:.1f}} hours old', age) FROM a)"""


@query("health_checks", "A12 A13", f"WITH {_CHECKS} SELECT name, status, message FROM checks")
def health_checks(spark, sf):
    return _checks(spark, sf)


@query(
    "overall_health",
    "A14",
    f"""WITH {_CHECKS} SELECT count(*) AS total_checks, count(*) FILTER (status = 'healthy') AS healthy,
        count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'unhealthy') AS unhealthy,
        CASE WHEN bool_and(status = 'healthy') THEN 'healthy' WHEN bool_or(status = 'unhealthy') THEN 'unhealthy' ELSE 'degraded' END AS status
    FROM checks""",
)
def overall_health(spark, sf):
    return ST.overall_health(_checks(spark, sf))


@query(
    "freshness_state",
    "A13",
    f"""SELECT CASE WHEN age < 12 THEN 'healthy' ELSE 'stale' END AS status, round(age, 2) AS hours_since_update
        FROM (SELECT (epoch_us(TIMESTAMP '2024-01-31 03:00:00') - epoch_us(max(ts))) / 3600000000.0::DOUBLE AS age FROM events)""",
)
def freshness_state(spark, sf):
    return ST.freshness_state(table(spark, sf, "events"), "ts", F.lit("2024-01-31 03:00:00").cast("timestamp"))


@query(
    "source_breakdown",
    "A17",
    f"""WITH {CLAIMS_SQL} SELECT 'source' AS section, source_name AS item, count(*) AS n FROM claims GROUP BY source_name
        UNION ALL SELECT 'total', 'all', count(*) FROM claims""",
)
def source_breakdown(spark, sf):
    return ST.source_breakdown(claims(spark, sf), "source_name")


@query(
    "hit_ratio_by_user",
    "A18",
    """SELECT user_id, CASE WHEN h + m = 0 THEN 0.0::DOUBLE ELSE round(h / (h + m) * 100, 2) END AS hit_ratio FROM (SELECT user_id,
        count(*) FILTER (event_type = 'view') AS h, count(*) FILTER (event_type = 'error') AS m FROM events GROUP BY user_id)""",
)
def hit_ratio_by_user(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(ST.hit_ratio(kind == "view", kind == "error").alias("hit_ratio"))


@query(
    "latency_percentiles",
    "A19",
    """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
        count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, any_value(n) AS n, round(avg(value), 6) AS mean, median(value) AS median,
        max(value) FILTER (i = CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) AS p95 FROM s GROUP BY event_type""",
)
def latency_percentiles(spark, sf):
    r = ST.percentile_report(table(spark, sf, "events"), ["event_type"], "value")
    return r.withColumn("mean", F.round("mean", 6))
