"""Registered queries: cleaning, constraints, quarantine, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recfuse import constants as C
from recfuse.functions import text as X
from recfuse.functions import values as V
from recfuse.operators import validate as VA
from recfuse.registry.base import query, spread, table
from recfuse.registry.views import CONFLICTS_SQL, LAUNCHES_SQL, conflicts, launches, split_columns
from recfuse.schema import LAUNCH_FIELDS, SOURCE_FIELDS

AS_OF = "2002-01-01"

# Raw text claims from line items, with defects planted by modulus. The SQL below never parses
# these texts: it knows from the modulus what each one must become.
_RAW = """
    l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
    CASE l_linenumber % 7 WHEN 1 THEN NULL WHEN 2 THEN 'Bad slug!' ELSE concat('Lot-', l_orderkey, '_', l_linenumber) END AS slug,
    CASE l_orderkey % 17 WHEN 0 THEN '   ' ELSE concat('  Lot ', l_orderkey, ': no. ', l_linenumber, ' ') END AS mission_name,
    CASE l_orderkey % 5
        WHEN 0 THEN date_format(l_shipdate, "yyyy-MM-dd'T'HH:mm:ss+0000")
        WHEN 1 THEN date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss')
        WHEN 2 THEN date_format(l_shipdate, 'yyyy-MM-dd')
        WHEN 3 THEN date_format(l_shipdate, 'dd/MM/yyyy')
        ELSE '' END AS launch_date,
    CASE WHEN l_suppkey % 4 = 0 THEN repeat('v', 101) ELSE concat(' ', l_returnflag, ' ') END AS vehicle_type,
    CASE l_suppkey % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN concat('-', l_extendedprice) WHEN 2 THEN '250000'
        ELSE CAST(l_extendedprice AS STRING) END AS payload_mass,
    CASE WHEN l_linenumber = 3 THEN ' ' ELSE l_linestatus END AS orbit,
    CASE l_orderkey % 6 WHEN 0 THEN ' Successful ' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'Scheduled' WHEN 3 THEN 'In-Flight'
        WHEN 4 THEN 'canceled' ELSE 'bogus' END AS status,
    'text' AS details,
    CASE WHEN l_orderkey % 9 = 0 THEN 'ftp://x' WHEN l_orderkey % 9 = 1 THEN '' ELSE 'https://p' END AS mission_patch_url,
    CAST(NULL AS STRING) AS webcast_url,
    concat('src', l_suppkey % 5) AS source_name,
    CASE WHEN l_suppkey % 10 = 0 THEN 'not-a-url' ELSE 'https://s.example/x' END AS source_url,
    CASE WHEN l_suppkey % 8 = 0 THEN '2999-01-01 00:00:00' ELSE '2001-01-01 00:00:00' END AS scraped_at,
    CASE WHEN l_suppkey % 9 = 0 THEN '1.5' ELSE '0.9' END AS data_quality_score
"""


def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested raw claims as the scan delivers them, plus the line item's identifying columns."""
    flat = spread(table(spark, sf_dir, "lineitem")).selectExpr(*[c.strip() for c in split_columns(_RAW)])
    return flat.select(
        F.struct(*LAUNCH_FIELDS).alias("raw"),
        F.struct(*SOURCE_FIELDS).alias("source"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ingest_seq"),
        "l_extendedprice",
    )


_CHECKED_SQL = """c AS (SELECT l_orderkey * 8 + l_linenumber AS ingest_seq, *,
    CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE 'Lot ' || l_orderkey || ': no. ' || l_linenumber END AS mn,
    CASE WHEN l_orderkey % 5 < 3 THEN date_trunc('day', l_shipdate) END AS ld,
    CASE l_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN -l_extendedprice WHEN 2 THEN 250000 ELSE l_extendedprice END AS pm,
    CASE l_orderkey % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' WHEN 2 THEN 'upcoming' WHEN 3 THEN 'in_flight'
        WHEN 4 THEN 'aborted' ELSE 'bogus' END AS st,
    CASE WHEN l_linenumber % 7 = 1 THEN CASE WHEN l_orderkey % 17 = 0 THEN NULL
            ELSE 'lot-' || l_orderkey || '-no-' || l_linenumber END
        WHEN l_linenumber % 7 = 2 THEN 'Bad slug!' ELSE 'Lot-' || l_orderkey || '_' || l_linenumber END AS sl
    FROM lineitem),
  e AS (SELECT *, [x FOR x IN [
    CASE WHEN sl IS NULL THEN 'slug:required' END,
    CASE WHEN sl = 'Bad slug!' THEN 'slug:charset' END,
    CASE WHEN mn IS NULL THEN 'mission_name:required' END,
    CASE WHEN ld < TIMESTAMP '2000-01-01' THEN 'launch_date:year' END,
    CASE WHEN l_suppkey % 4 = 0 THEN 'vehicle_type:length' END,
    CASE WHEN pm < 0 THEN 'payload_mass:negative' END,
    CASE WHEN st = 'bogus' THEN 'status:value' END,
    CASE WHEN l_orderkey % 9 = 0 THEN 'mission_patch_url:scheme' END,
    CASE WHEN l_suppkey % 10 = 0 THEN 'source_url:scheme' END,
    CASE WHEN l_suppkey % 8 = 0 THEN 'scraped_at:future' END,
    CASE WHEN l_suppkey % 9 = 0 THEN 'data_quality_score:range' END] IF x IS NOT NULL] AS errors,
    [x FOR x IN [
    CASE WHEN st = 'upcoming' AND ld < TIMESTAMP '2002-01-01' THEN 'status:upcoming_in_past' END,
    CASE WHEN pm > 100000 THEN 'payload_mass:very_high' END] IF x IS NOT NULL] AS warnings FROM c)"""


def document_lines(spark, sf) -> DataFrame:
    """doc_id, line (from 0), t: every line of every document."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))


def _checked(spark, sf):
    return VA.check_claims(raw_claims(spark, sf), F.lit(AS_OF).cast("timestamp"))


@query(
    "valid_claims",
    "S1 V1 V2 V3 V4 V5 V7 V8 V10 V11",
    f"""WITH {_CHECKED_SQL} SELECT ingest_seq, lower(sl) AS slug, mn AS mission_name, ld AS launch_date, st AS status,
        pm AS payload_mass, l_returnflag AS vehicle_type, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linestatus END AS orbit,
        array_to_string(warnings, ',') AS warnings FROM e WHERE len(errors) = 0""",
)
def valid_claims(spark, sf):
    return _checked(spark, sf).valid.select(
        "ingest_seq",
        "slug",
        "mission_name",
        F.col("launch_date").cast("timestamp_ntz").alias("launch_date"),
        "status",
        "payload_mass",
        "vehicle_type",
        "orbit",
        F.array_join("warnings", ",").alias("warnings"),
    )


@query(
    "quarantined_claims",
    "V10",
    f"WITH {_CHECKED_SQL} SELECT ingest_seq, array_to_string(errors, ',') AS errors FROM e WHERE len(errors) > 0",
)
def quarantined_claims(spark, sf):
    return _checked(spark, sf).quarantine.select("ingest_seq", F.array_join("errors", ",").alias("errors"))


@query(
    "validation_summary",
    "V12",
    f"""WITH {_CHECKED_SQL}, k AS (SELECT 'error' AS kind, unnest(errors) AS rule FROM e
        UNION ALL SELECT 'warning', unnest(warnings) FROM e) SELECT kind, rule, count(*) AS n FROM k GROUP BY ALL""",
)
def validation_summary(spark, sf):
    return VA.summary(_checked(spark, sf).checked)


@query(
    "checked_conflicts",
    "V9",
    f"""WITH {CONFLICTS_SQL}, c AS (SELECT id, CASE WHEN part % 7 = 0 THEN '' ELSE field_name END AS f, source1_value AS a,
        CASE WHEN part % 5 = 0 THEN source1_value ELSE source2_value END AS b, confidence_score / 90.0::DOUBLE AS s FROM conflicts)
    SELECT id, array_to_string([x FOR x IN [CASE WHEN f = '' THEN 'field_name:length' END,
        CASE WHEN a = b THEN 'source_values:equal' END, CASE WHEN s > 1 THEN 'confidence_score:range' END] IF x IS NOT NULL], ',') AS errors FROM c""",
)
def checked_conflicts(spark, sf):
    c = conflicts(spark, sf).select(
        "id",
        F.when(F.col("part") % 7 == 0, "").otherwise(F.col("field_name")).alias("field_name"),
        "source1_value",
        F.when(F.col("part") % 5 == 0, F.col("source1_value")).otherwise(F.col("source2_value")).alias("source2_value"),
        (F.col("confidence_score") / F.lit(90.0)).alias("confidence_score"),
    )
    return VA.check_conflicts(c).checked.select("id", F.array_join("errors", ",").alias("errors"))


@query("duplicate_names", "V13 A8", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_names(spark, sf):
    return VA.duplicate_keys(table(spark, sf, "part"), "p_name")


@query(
    "overdue_launches",
    "V13",
    f"WITH {LAUNCHES_SQL} SELECT id, launch_date FROM launches WHERE status = 'upcoming' AND launch_date < TIMESTAMP '1999-12-31'",
)
def overdue_launches(spark, sf):
    late = VA.overdue(launches(spark, sf), F.lit("2000-01-01").cast("timestamp_ntz"))
    return late.select("id", "launch_date")


@query(
    "document_slugs",
    "V5 V6",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)
    SELECT doc_id, CAST(line AS INTEGER) AS line, trim(regexp_replace(regexp_replace(lower(t), '[^\p{L}\p{N}_\s-]', '', 'g'),
        '[-\s]+', '-', 'g'), '-') AS slug,
      trim(regexp_replace(regexp_replace(lower(t), '[^\p{L}\p{N}_\s-]', '', 'g'),
        '[\s_-]+', '-', 'g'), '-') AS page_slug FROM l""",
)
def document_slugs(spark, sf):
    lines = document_lines(spark, sf)
    return lines.select("doc_id", "line", X.slug(F.col("t")).alias("slug"), X.page_slug(F.col("t")).alias("page_slug"))


@query(
    "status_spellings",
    "V1 C7",
    """WITH s AS (SELECT event_id, event_type, user_id FROM events)
    SELECT event_id, CASE WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN 'completed' WHEN event_type = 'purchase' AND user_id % 3 = 1 THEN 'success'
        WHEN event_type = 'purchase' THEN 'upcoming' WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'signup' THEN 'in_flight'
        WHEN event_type = 'click' THEN 'aborted' ELSE event_type END AS status FROM s""",
)
def status_spellings(spark, sf):
    # What happened in an event, as sources spell it: other words, case, blanks; some are no status.
    spelled = F.expr(
        """CASE event_type WHEN 'purchase' THEN CASE user_id % 3 WHEN 0 THEN ' Completed ' WHEN 1 THEN 'SUCCESSFUL' ELSE 'Scheduled' END
        WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'In-Flight' WHEN 'click' THEN 'CANCELED' ELSE event_type END"""
    )
    return table(spark, sf, "events").select("event_id", V.clean_status(spelled).alias("status"))
