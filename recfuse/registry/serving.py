"""Registered queries: reads over the curated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recfuse.operators import serve as SV
from recfuse.operators import upsert as UP
from recfuse.registry.base import query
from recfuse.registry.views import CONFLICTS_SQL, LAUNCHES_SQL, SOURCES_SQL, conflicts, launches, sources

AS_OF = "1998-06-15"
T = f"TIMESTAMP '{AS_OF}'"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


_L = f"WITH {LAUNCHES_SQL} SELECT id, slug, mission_name, launch_date, vehicle_type, status FROM launches "
_COLS = ["id", "slug", "mission_name", "launch_date", "vehicle_type", "status"]
_S = f"WITH {SOURCES_SQL}, {LAUNCHES_SQL} SELECT id, launch_id, source_name, scraped_at, data_quality_score FROM sources "
_SCOLS = ["id", "launch_id", "source_name", "scraped_at", "data_quality_score"]
_C = f"WITH {CONFLICTS_SQL} SELECT id, launch_id, field_name, confidence_score, resolved, created_at FROM conflicts "
_CCOLS = ["id", "launch_id", "field_name", "confidence_score", "resolved", "created_at"]


@query("launch_by_slug", "Q1 S2", _L + "WHERE slug = 'order-77'")
def launch_by_slug(spark, sf):
    return SV.lookup(launches(spark, sf), "slug", "order-77").select(_COLS)


@query(
    "launches_multi_get",
    "Q2 O3",
    _L + "WHERE status = 'success' AND vehicle_type = '5-LOW' ORDER BY launch_date ASC NULLS LAST, id LIMIT 25 OFFSET 10",
)
def launches_multi_get(spark, sf):
    wanted = {"status": "success", "vehicle_type": "5-LOW", "no_such_field": 1}
    return SV.multi_get(launches(spark, sf), wanted, "launch_date", 10, 25).select(_COLS)


@query(
    "launch_count", "Q3", f"WITH {LAUNCHES_SQL} SELECT count(*) AS n FROM launches WHERE status = 'upcoming' AND vehicle_type = '1-URGENT'"
)
def launch_count(spark, sf):
    return SV.count_where(launches(spark, sf), {"status": "upcoming", "vehicle_type": "1-URGENT"})


@query("upcoming_launches", "Q4", _L + f"WHERE status = 'upcoming' AND launch_date >= {T} ORDER BY launch_date, id LIMIT 50")
def upcoming_launches(spark, sf):
    return SV.upcoming(launches(spark, sf), as_of()).select(_COLS)


@query(
    "historical_launches",
    "Q5",
    _L + f"WHERE launch_date < {T} AND status = 'success' AND vehicle_type = '2-HIGH' ORDER BY launch_date DESC, id LIMIT 50 OFFSET 5",
)
def historical_launches(spark, sf):
    return SV.historical(launches(spark, sf), as_of(), "success", "2-HIGH", 5, 50).select(_COLS)


@query(
    "launch_search",
    "Q6 O2",
    _L + "WHERE (mission_name ILIKE '%customer 1_%' OR details ILIKE '%customer 1_%') AND status = 'success' "
    "ORDER BY launch_date DESC NULLS FIRST, id LIMIT 50",
)
def launch_search(spark, sf):
    return SV.search(launches(spark, sf), "customer 1_", "success").select(_COLS)


@query(
    "launches_in_range",
    "Q7",
    _L + "WHERE launch_date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-02-15'",
)
def launches_in_range(spark, sf):
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return SV.in_date_range(launches(spark, sf), stamp("1997-01-01"), stamp("1997-02-15")).select(_COLS)


_PARAMS = SV.ListParams(
    status="failure", vehicle_type="3-MEDIUM", search="ord", date_from="1996-01-01", date_to="1999-12-31",
    sort_by="mission_name", sort_order="desc", skip=20, limit=20,
)
_LIST_WHERE = (
    "WHERE status = 'failure' AND vehicle_type = '3-MEDIUM' AND (mission_name ILIKE '%ord%' OR details ILIKE '%ord%') "
    "AND launch_date >= TIMESTAMP '1996-01-01' AND launch_date <= TIMESTAMP '1999-12-31'"
)


@query("launch_list_page", "Q8", _L + _LIST_WHERE + " ORDER BY mission_name DESC, id LIMIT 20 OFFSET 20")
def launch_list_page(spark, sf):
    return SV.list_page(launches(spark, sf), _PARAMS).select(_COLS)


@query(
    "launch_list_meta",
    "Q9",
    f"""WITH {LAUNCHES_SQL}, c AS (SELECT count(*) AS total FROM launches {_LIST_WHERE})
    SELECT total, 2 AS page, 20 AS per_page, CAST(ceil(total / 20) AS BIGINT) AS total_pages, 2 < ceil(total / 20) AS has_next,
        true AS has_prev FROM c""",
)
def launch_list_meta(spark, sf):
    return SV.page_meta(launches(spark, sf), _PARAMS)


# Small pages, so that many launches of the given tables have several.
_PAGE = 2


def _shown(df, column="sources"):
    text = F.transform(column, lambda s: F.concat_ws(":", s["id"].cast("string"), s["source_name"]))
    return F.array_join(text, ",")


@query(
    "launch_detail",
    "Q10 J2",
    f"""WITH {LAUNCHES_SQL}, {SOURCES_SQL} SELECT l.id, l.slug, l.status, 0 AS page,
        coalesce((SELECT string_agg(s.id || ':' || s.source_name, ',' ORDER BY s.id) FROM sources s WHERE s.launch_id = l.id), '') AS sources
    FROM launches l WHERE slug = 'order-42'""",
)
def launch_detail(spark, sf):
    d = SV.detail(launches(spark, sf), sources(spark, sf).select("id", "launch_id", "source_name"), "order-42")
    return d.select("id", "slug", "status", "page", _shown(d).alias("sources"))


@query(
    "launches_with_children",
    "J1 J2",
    f"""WITH {LAUNCHES_SQL}, {SOURCES_SQL}, {CONFLICTS_SQL},
      sn AS (SELECT *, CAST((row_number() OVER (PARTITION BY launch_id ORDER BY id) - 1) // {_PAGE} AS INTEGER) AS page FROM sources),
      cn AS (SELECT *, CAST((row_number() OVER (PARTITION BY launch_id ORDER BY id) - 1) // {_PAGE} AS INTEGER) AS page FROM conflicts),
      s AS (SELECT launch_id, page, string_agg(id || ':' || source_name, ',' ORDER BY id) AS sources FROM sn GROUP BY 1, 2),
      c AS (SELECT launch_id, page, string_agg(id || ':' || field_name, ',' ORDER BY id) AS conflicts FROM cn GROUP BY 1, 2),
      p AS (SELECT id AS launch_id, 0 AS page FROM launches UNION SELECT launch_id, page FROM s UNION SELECT launch_id, page FROM c)
    SELECT l.id, l.slug, p.page, coalesce(s.sources, '') AS sources, coalesce(c.conflicts, '') AS conflicts
    FROM launches l JOIN p ON p.launch_id = l.id LEFT JOIN s ON s.launch_id = l.id AND s.page = p.page
      LEFT JOIN c ON c.launch_id = l.id AND c.page = p.page""",
)
def launches_with_children(spark, sf):
    full = SV.with_children(
        launches(spark, sf).select("id", "slug"),
        sources(spark, sf).select("id", "launch_id", "source_name"),
        conflicts(spark, sf).select("id", "launch_id", "field_name"),
        _PAGE,
    )
    fields = F.transform("conflicts", lambda s: F.concat_ws(":", s["id"].cast("string"), s["field_name"]))
    return full.select("id", "slug", "page", _shown(full).alias("sources"), F.array_join(fields, ",").alias("conflicts"))


@query("sources_of_launch", "Q11", _S + "WHERE launch_id = 42")
def sources_of_launch(spark, sf):
    return SV.sources_of(sources(spark, sf), 42).select(_SCOLS)


@query("sources_by_name", "Q12", _S + "WHERE source_name = 'src3' ORDER BY scraped_at DESC, id LIMIT 100")
def sources_by_name(spark, sf):
    return SV.sources_by_name(sources(spark, sf), "src3").select(_SCOLS)


@query("recent_sources", "Q13", _S + f"WHERE scraped_at >= {T} - INTERVAL 24 HOUR")
def recent_sources(spark, sf):
    return SV.recent_sources(sources(spark, sf), as_of(), 24).select(_SCOLS)


@query(
    "stale_sources",
    "Q14 J3",
    f"""WITH {SOURCES_SQL}, {LAUNCHES_SQL} SELECT s.id, s.launch_id, l.slug, s.scraped_at FROM sources s
        LEFT JOIN launches l ON l.id = s.launch_id WHERE s.scraped_at < {T} - INTERVAL 48 HOUR""",
)
def stale_sources(spark, sf):
    old = SV.stale_sources(sources(spark, sf), launches(spark, sf), as_of(), 48)
    return old.select("id", "launch_id", "slug", "scraped_at")


@query("conflicts_of_launch", "Q15", _C + "WHERE launch_id = 42 AND NOT resolved")
def conflicts_of_launch(spark, sf):
    return SV.conflicts_of(conflicts(spark, sf), 42, False).select(_CCOLS)


@query("unresolved_conflicts", "Q16", _C + "WHERE NOT resolved ORDER BY created_at DESC, id LIMIT 100")
def unresolved_conflicts(spark, sf):
    return SV.unresolved(conflicts(spark, sf)).select(_CCOLS)


@query(
    "open_field_conflicts",
    "Q17 J3",
    f"""WITH {CONFLICTS_SQL}, {LAUNCHES_SQL} SELECT c.id, c.launch_id, l.mission_name, c.created_at FROM conflicts c
        LEFT JOIN launches l ON l.id = c.launch_id WHERE c.field_name = 'status' AND NOT c.resolved""",
)
def open_field_conflicts(spark, sf):
    found = SV.conflicts_by_field(conflicts(spark, sf), launches(spark, sf), "status", False)
    return found.select("id", "launch_id", "mission_name", "created_at")


@query(
    "high_confidence_conflicts",
    "Q18",
    f"""WITH {CONFLICTS_SQL}, {LAUNCHES_SQL} SELECT c.id, c.launch_id, l.slug, c.confidence_score FROM conflicts c
        LEFT JOIN launches l ON l.id = c.launch_id WHERE c.confidence_score >= 80""",
)
def high_confidence_conflicts(spark, sf):
    found = SV.high_confidence(conflicts(spark, sf), launches(spark, sf), 80)
    return found.select("id", "launch_id", "slug", "confidence_score")


@query(
    "resolved_by_ids",
    "Q19",
    f"""WITH {CONFLICTS_SQL} SELECT id, resolved OR part % 10 = 3 AS resolved,
        CASE WHEN part % 10 = 3 THEN {T} ELSE resolved_at END AS resolved_at FROM conflicts""",
)
def resolved_by_ids(spark, sf):
    c = conflicts(spark, sf)
    return UP.resolve(c, c.filter(F.col("part") % 10 == 3), as_of()).select("id", "resolved", "resolved_at")


@query(
    "resolved_by_criteria",
    "Q20",
    f"""WITH {CONFLICTS_SQL}, hit AS (SELECT 'field' AS rule, id FROM conflicts WHERE NOT resolved AND field_name = 'orbit'
            AND created_at >= {T} - INTERVAL 365 DAY
        UNION ALL SELECT 'confidence', id FROM conflicts WHERE NOT resolved AND confidence_score >= 90
        UNION ALL (SELECT 'latest', id FROM conflicts WHERE NOT resolved ORDER BY created_at DESC, id LIMIT 100))
    SELECT rule, count(*) AS n, CAST(sum(id % 1000003) AS BIGINT) AS id_sum FROM hit GROUP BY rule""",
)
def resolved_by_criteria(spark, sf):
    c = conflicts(spark, sf)
    picks = {
        "field": UP.resolution_candidates(c, as_of(), field_name="orbit", max_age_days=365),
        "confidence": UP.resolution_candidates(c, as_of(), min_confidence=90),
        "latest": UP.resolution_candidates(c, as_of()),
    }
    rows = [df.select(F.lit(rule).alias("rule"), "id") for rule, df in picks.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("rule").agg(
        F.count("*").alias("n"), F.sum(F.col("id") % 1000003).alias("id_sum")
    )


@query(
    "conflict_review",
    "Q21",
    f"""WITH {CONFLICTS_SQL}, {LAUNCHES_SQL} SELECT c.id, c.field_name, c.source1_value, c.source2_value,
        CAST(c.confidence_score AS DOUBLE) AS confidence_score, l.slug, l.mission_name
        FROM conflicts c LEFT JOIN launches l ON l.id = c.launch_id WHERE c.resolved""",
)
def conflict_review(spark, sf):
    rows = SV.review_list(conflicts(spark, sf), launches(spark, sf), True)
    return rows.select("id", "field_name", "source1_value", "source2_value", "confidence_score", "slug", "mission_name")


@query("recent_launches", "Q22", _L + f"WHERE launch_date > {T} - INTERVAL 30 DAY ORDER BY launch_date DESC, id LIMIT 20")
def recent_launches(spark, sf):
    return SV.recent_launches(launches(spark, sf), as_of()).select(_COLS)


@query("vehicle_types", "Q23 U3", f"WITH {LAUNCHES_SQL} SELECT DISTINCT vehicle_type FROM launches WHERE vehicle_type <> ''")
def vehicle_types(spark, sf):
    return SV.vehicle_types(launches(spark, sf))


@query(
    "launches_with_open_conflicts",
    "J4",
    f"""WITH {LAUNCHES_SQL}, {CONFLICTS_SQL} SELECT id, slug FROM launches WHERE id IN (SELECT launch_id FROM conflicts WHERE NOT resolved)""",
)
def launches_with_open_conflicts(spark, sf):
    return SV.with_open_conflicts(launches(spark, sf), conflicts(spark, sf)).select("id", "slug")
