"""Registered queries: ranking, fusion, base-against-rest conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from recfuse.operators import fuse as FU
from recfuse.operators import rank as R
from recfuse.registry.base import query
from recfuse.registry.views import CLAIMS_PROFILE as P
from recfuse.registry.views import CLAIMS_SQL, RANKED_SQL, claims


@query(
    "fused_claims",
    "R2 R8 R9 R10 R11 W1 F1",
    f"""WITH {RANKED_SQL}, long AS (
        SELECT *, row_number() OVER (PARTITION BY k ORDER BY length(details) DESC NULLS LAST, rk) AS lrk FROM ranked)
    SELECT k, arg_min(name, rk) AS name, arg_min(dt, rk) FILTER (dt IS NOT NULL) AS dt,
        arg_min(status, rk) AS status, arg_min(mass, rk) FILTER (mass IS NOT NULL) AS mass,
        arg_min(orbit, rk) FILTER (orbit IS NOT NULL) AS orbit,
        arg_min(details, lrk) FILTER (details IS NOT NULL) AS details,
        arg_min(source_name, rk) AS base_source, count(*) AS n_claims
    FROM long GROUP BY k""",
)
def fused_claims(spark, sf):
    return FU.fuse(claims(spark, sf), P)


@query(
    "ranked_claims",
    "R1 R2 W1 O1 O2",
    f"WITH {RANKED_SQL} SELECT k, claim_id, CAST(rk AS INT) AS rank FROM ranked",
)
def ranked_claims(spark, sf):
    return R.rank_claims(claims(spark, sf), P).select("k", "claim_id", "rank")


@query(
    "source_priority_rows",
    "R1",
    """SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3
        WHEN 5 THEN 4 ELSE 5 END AS priority FROM supplier""",
)
def source_priority_rows(spark, sf):
    from recfuse.registry.base import table

    # The seven source names whose level is fixed by the rules, spread over the suppliers.
    names = ["SpaceX Official", "spacex.com", "NASA", "nasa.gov", "spacex_press_kit", "Wikipedia", "Unknown Source"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return table(spark, sf, "supplier").select("s_suppkey", R.source_priority(name).alias("priority"))


_BASE_PAIRS = f"""{RANKED_SQL}, bp AS (
    SELECT r.k, b.source_name AS s1, r.source_name AS s2,
        CAST(0.5 AS DOUBLE) + CASE WHEN b.prio <> r.prio THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
            + abs(b.quality - r.quality) * CAST(0.2 AS DOUBLE) AS c,
        b.name AS n1, r.name AS n2, b.dt AS d1, r.dt AS d2, b.mass AS m1, r.mass AS m2, b.orbit AS o1, r.orbit AS o2,
        b.status AS t1, r.status AS t2, b.details AS e1, r.details AS e2
    FROM ranked r JOIN ranked b ON r.k = b.k AND b.rk = 1 AND r.rk > 1),
  base AS (
    SELECT k, 'name' AS field_name, least(CAST(1 AS DOUBLE), c + CAST(0.1 AS DOUBLE)) AS conf, n1 AS v1, n2 AS v2 FROM bp
        WHERE NOT (contains(lower(n1), lower(n2)) OR contains(lower(n2), lower(n1)))
    UNION ALL SELECT k, 'dt', least(CAST(1 AS DOUBLE), c + CAST(0.1 AS DOUBLE)), strftime(d1, '%Y-%m-%d %H:%M:%S+00:00'),
        strftime(d2, '%Y-%m-%d %H:%M:%S+00:00') FROM bp WHERE abs(epoch(d1) - epoch(d2)) > 3600
    UNION ALL SELECT k, 'mass', least(CAST(1 AS DOUBLE), c + CAST(0 AS DOUBLE)), CAST(m1 AS VARCHAR), CAST(m2 AS VARCHAR)
        FROM bp WHERE abs(m1 - m2) / greatest(abs(m1), abs(m2)) > CAST(0.1 AS DOUBLE)
    UNION ALL SELECT k, 'orbit', least(CAST(1 AS DOUBLE), c + CAST(0 AS DOUBLE)), o1, o2 FROM bp
        WHERE NOT (contains(lower(o1), lower(o2)) OR contains(lower(o2), lower(o1)))
    UNION ALL SELECT k, 'status', least(CAST(1 AS DOUBLE), c + CAST(0.1 AS DOUBLE)), t1, t2 FROM bp WHERE t1 <> t2
    UNION ALL SELECT k, 'details', least(CAST(1 AS DOUBLE), c + CAST(0 AS DOUBLE)), e1, e2 FROM bp WHERE e1 <> e2)"""


@query(
    "base_conflicts",
    "R3 R4 R5 R6 R7 J6",
    f"""WITH {_BASE_PAIRS} SELECT k, field_name, v1 AS source1_value, v2 AS source2_value,
        round(conf, 9) AS confidence_score, count(*) AS n FROM base GROUP BY ALL""",
)
def base_conflicts(spark, sf):
    found = FU.base_conflicts(claims(spark, sf), P)
    return found.groupBy(
        "k", "field_name", "source1_value", "source2_value", F.round("confidence_score", 9).alias("confidence_score")
    ).agg(F.count("*").alias("n"))


@query(
    "fusion_log",
    "R12",
    f"""WITH {_BASE_PAIRS}, per AS (SELECT k, source_name, min(rk) AS r, count(*) AS n FROM ranked GROUP BY 1, 2),
    used AS (SELECT k, string_agg(source_name || ':' || n, ',' ORDER BY r) AS sources_used, CAST(sum(n) AS BIGINT) AS n_claims
        FROM per GROUP BY k), cc AS (SELECT k, count(*) AS c FROM base GROUP BY k)
    SELECT used.k, n_claims, sources_used, coalesce(c, 0) AS conflicts_count FROM used LEFT JOIN cc ON used.k = cc.k
    WHERE n_claims > 1""",
)
def fusion_log(spark, sf):
    c = claims(spark, sf)
    log = FU.fusion_log(c, FU.base_conflicts(c, P), P)
    shown = F.transform("sources_used", lambda s: F.concat(s["source"], F.lit(":"), s["claims"].cast("string")))
    return log.withColumn("sources_used", F.array_join(shown, ","))


@query(
    "fusion_summary",
    "R13",
    f"""WITH {_BASE_PAIRS}, multi AS (SELECT k FROM claims GROUP BY k HAVING count(*) > 1)
    SELECT 'conflicts_by_field' AS section, field_name AS item, count(*) AS n FROM base GROUP BY field_name
    UNION ALL SELECT 'sources_by_priority', CASE prio WHEN 1 THEN 'SPACEX_OFFICIAL' WHEN 2 THEN 'NASA_OFFICIAL'
        WHEN 3 THEN 'SPACEX_PRESS_KIT' WHEN 4 THEN 'WIKIPEDIA' ELSE 'UNKNOWN' END, count(*)
    FROM claims WHERE k IN (SELECT k FROM multi) GROUP BY prio""",
)
def fusion_summary(spark, sf):
    c = claims(spark, sf)
    return FU.fusion_summary(c, FU.base_conflicts(c, P), P)
