"""Stand-in views over the given tables, written once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recfuse import schema as S
from recfuse.registry.base import spread, table

# Ingest order of a claim: one integer, unique inside a key on all given tables.
SEQ = ("claim_id",)

CLAIMS_PROFILE = S.RecordProfile(
    key="k",
    source="source_name",
    quality="quality",
    priority="prio",
    seq=SEQ,
    fields=(
        S.Field("name", S.TEXT, 1.0),
        S.Field("dt", S.DATE, 0.9),
        S.Field("status", S.STATUS, 0.8),
        S.Field("mass", S.NUMBER, 0.6),
        S.Field("orbit", S.TEXT, 0.5),
        S.Field("details", S.EXACT, 0.3),
    ),
    date="dt",
    longest_text="details",
    key_fields=("name", "dt", "status"),
    base_fields=("name", "dt", "mass", "orbit", "status", "details"),
)
# Completeness weights of the claims view.
CLAIMS_WEIGHTS = {"status": 2.0, "dt": 1.5, "mass": 1.0, "orbit": 1.0, "details": 0.5}

_CLAIM_COLUMNS = """
    l_partkey AS k,
    (l_orderkey * 8 + l_linenumber) * 10000 + {days} AS claim_id,
    concat('src', CAST(l_suppkey % 5 AS {text})) AS source_name,
    CAST(1 + l_suppkey % 5 AS INT) AS prio,
    (l_suppkey * 37) % 101 AS q100,
    CAST((l_suppkey * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS quality,
    concat('lot ', l_returnflag, ' ', l_linestatus, ' ', CAST(l_linenumber % 3 AS {text})) AS name,
    CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN NULL ELSE l_extendedprice END AS mass,
    CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN NULL ELSE l_shipdate END AS dt,
    CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'N' THEN 'Completed' ELSE 'scrubbed' END AS status,
    CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN NULL ELSE l_linestatus END AS orbit,
    CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN NULL
         ELSE concat('qty ', CAST(CAST(l_quantity AS INT) AS {text}), ' tax ', CAST(l_tax AS {text})) END AS details
"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about parts from five pseudo-sources."""
    days = "datediff(l_shipdate, DATE '1990-01-01')"
    columns = [c.strip() for c in split_columns(_CLAIM_COLUMNS.format(text="STRING", days=days))]
    return spread(table(spark, sf_dir, "lineitem")).selectExpr(*columns)


def split_columns(columns: str) -> list[str]:
    """Split a select list at top-level commas."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(columns[start:i])
            start = i + 1
    return [*parts, columns[start:]]


CLAIMS_SQL = (
    "claims AS (SELECT "
    + _CLAIM_COLUMNS.format(text="VARCHAR", days="date_diff('day', TIMESTAMP '1990-01-01', l_shipdate)")
    + ", claim_id AS seq FROM lineitem)"
)
RANKED_SQL = (
    CLAIMS_SQL
    + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY prio, q100 DESC, seq) AS rk FROM claims)"
)


# Orders as curated launches; a status vocabulary from the three order states.
_LAUNCH_COLUMNS = """
    o_orderkey AS id,
    concat('order-', CAST(o_orderkey AS {text})) AS slug,
    concat('Order ', CAST(o_orderkey AS {text}), ' for ', CAST(o_custkey AS {text})) AS mission_name,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS launch_date,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS vehicle_type,
    CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'upcoming' ELSE 'failure' END AS status,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN ''
         ELSE concat('Customer ', CAST(o_custkey AS {text})) END AS details,
    CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE concat('https://img.example/', CAST(o_orderkey AS {text})) END AS mission_patch_url,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('https://cast.example/', CAST(o_orderkey AS {text})) END AS webcast_url,
    o_orderdate AS created_at,
    o_orderdate + INTERVAL '1' DAY AS updated_at
"""


def launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [c.strip() for c in split_columns(_LAUNCH_COLUMNS.format(text="STRING"))]
    return table(spark, sf_dir, "orders").selectExpr(*columns)


LAUNCHES_SQL = "launches AS (SELECT " + _LAUNCH_COLUMNS.format(text="VARCHAR") + " FROM orders)"

# Line items as lineage rows of the orders; quality is kept as an integer to avoid float ties.
_SOURCE_COLUMNS = """
    ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id,
    l_orderkey AS launch_id,
    concat('src', CAST(l_suppkey % 5 AS {text})) AS source_name,
    concat('https://s.example/', CAST(l_suppkey AS {text})) AS source_url,
    l_shipdate AS scraped_at,
    CAST((l_suppkey * 37) % 101 AS INT) AS data_quality_score,
    l_partkey AS part
"""
SOURCES_SQL = "sources AS (SELECT " + _SOURCE_COLUMNS.format(text="VARCHAR") + " FROM lineitem)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [c.strip() for c in split_columns(_SOURCE_COLUMNS.format(text="STRING"))]
    return table(spark, sf_dir, "lineitem").selectExpr(*columns)


# Conflict records attached to orders, one per line item.
_CONFLICT_COLUMNS = """
    ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id,
    l_orderkey AS launch_id,
    CASE l_linenumber % 4 WHEN 0 THEN 'launch_date' WHEN 1 THEN 'status' WHEN 2 THEN 'payload_mass' ELSE 'orbit' END AS field_name,
    l_returnflag AS source1_value,
    concat(l_linestatus, '-', l_returnflag) AS source2_value,
    CAST((l_suppkey * 37) % 101 AS INT) AS confidence_score,
    (l_orderkey + l_linenumber) % 3 = 0 AS resolved,
    l_shipdate AS created_at,
    CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN l_shipdate + INTERVAL '5' DAY END AS resolved_at,
    l_suppkey AS part
"""
CONFLICTS_SQL = "conflicts AS (SELECT " + _CONFLICT_COLUMNS.format(text="VARCHAR") + " FROM lineitem)"


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [c.strip() for c in split_columns(_CONFLICT_COLUMNS.format(text="STRING"))]
    return table(spark, sf_dir, "lineitem").selectExpr(*columns)
