"""Registered queries: the next content of tables after a change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recfuse.operators import upsert as UP
from recfuse.plans.persist import plan_batch, totals
from recfuse.registry.base import query, table
from recfuse.registry.serving import T, as_of
from recfuse.registry.views import CONFLICTS_SQL, LAUNCHES_SQL, SOURCES_SQL, conflicts, launches, sources

# Old content: orders with key % 3 != 0. Incoming: key % 3 != 1, with every key % 10 = 0 sent twice
# and later values winning; status is null for key % 7 = 0.
_OLD = "o_orderkey % 3 <> 0"
_NEW = "o_orderkey % 3 <> 1"


def _current(spark, sf):
    return table(spark, sf, "orders").filter(_OLD).selectExpr(
        "o_orderkey AS id", "concat('order-', o_orderkey) AS slug", "o_orderstatus AS status", "o_totalprice AS mass",
        "o_orderdate AS created_at", "o_orderdate AS updated_at",
    )


def _incoming(spark, sf):
    rows = table(spark, sf, "orders").filter(_NEW).withColumn(
        "copy", F.explode(F.when(F.col("o_orderkey") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    return rows.selectExpr(
        "concat('order-', o_orderkey) AS slug",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('new', copy) END AS status",
        "o_totalprice * (copy + 2) AS mass",
        "o_orderkey * 2 + copy AS ingest_seq",
    )


_MERGED = f"""m AS (SELECT o_orderkey AS k, 'order-' || o_orderkey AS slug,
    CASE WHEN {_NEW} THEN CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 'new1' ELSE 'new0' END
        ELSE o_orderstatus END AS status,
    CASE WHEN {_NEW} THEN o_totalprice * CASE WHEN o_orderkey % 10 = 0 THEN 3 ELSE 2 END ELSE o_totalprice END AS mass,
    CASE WHEN {_OLD} THEN o_orderdate ELSE {T} END AS created_at, CASE WHEN {_NEW} THEN {T} ELSE o_orderdate END AS updated_at,
    CASE WHEN {_NEW} AND {_OLD} THEN 'updated' WHEN {_NEW} THEN 'created' ELSE 'kept' END AS change,
    CASE WHEN {_NEW} THEN CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END ELSE 0 END AS n_in FROM orders)"""


def _merged(spark, sf):
    return UP.merge(_current(spark, sf), _incoming(spark, sf), "slug", "ingest_seq", as_of())


@query("upserted_orders", "S10 S11 S21 J9", f"WITH {_MERGED} SELECT slug, status, mass, created_at, updated_at, change FROM m")
def upserted_orders(spark, sf):
    return _merged(spark, sf).select("slug", "status", "mass", "created_at", "updated_at", F.col("_change").alias("change"))


@query(
    "upsert_counts",
    "S10 S11",
    f"""WITH {_MERGED} SELECT count(*) FILTER (change = 'created') AS created,
        CAST(sum(n_in) - count(*) FILTER (change = 'created') AS BIGINT) AS updated, CAST(sum(n_in) AS BIGINT) AS total FROM m""",
)
def upsert_counts(spark, sf):
    return UP.merge_counts(_merged(spark, sf))


@query(
    "appended_sources",
    "S9 S12",
    f"""WITH {SOURCES_SQL} SELECT launch_id, source_name, count(*) AS n, count(*) AS ids FROM sources
        WHERE launch_id IN (SELECT o_orderkey FROM orders WHERE {_OLD}) GROUP BY 1, 2""",
)
def appended_sources(spark, sf):
    new = sources(spark, sf).withColumnRenamed("id", "ingest_seq").withColumn("slug", F.concat(F.lit("order-"), "launch_id")).drop("launch_id")
    rows = UP.children_for(_current(spark, sf), new, "slug", ["ingest_seq"])
    return rows.groupBy("launch_id", "source_name").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query(
    "appended_conflicts",
    "S13",
    f"""WITH {CONFLICTS_SQL} SELECT launch_id, field_name, source1_value, source2_value, confidence_score, false AS resolved,
        {T} AS created_at FROM conflicts WHERE launch_id IN (SELECT o_orderkey FROM orders WHERE {_OLD})""",
)
def appended_conflicts(spark, sf):
    new = conflicts(spark, sf).select(
        F.concat(F.lit("order-"), "launch_id").alias("slug"), "field_name", "source1_value", "source2_value", "confidence_score",
        F.col("id").alias("ingest_seq"),
    )
    rows = UP.new_conflicts(_current(spark, sf), new, "slug", as_of(), ["ingest_seq"])
    return rows.select("launch_id", "field_name", "source1_value", "source2_value", "confidence_score", "resolved", "created_at")


@query(
    "partially_updated",
    "S15",
    f"""WITH {LAUNCHES_SQL} SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE status END AS status,
        CASE WHEN id % 2 = 0 THEN 'patched' ELSE vehicle_type END AS vehicle_type FROM launches""",
)
def partially_updated(spark, sf):
    base = launches(spark, sf).select("id", "status", "vehicle_type")
    patches = base.filter("id % 2 = 0").selectExpr(
        "id", "CAST(NULL AS STRING) AS status", "'patched' AS vehicle_type",
        "CASE WHEN id % 4 = 0 THEN array('status', 'vehicle_type') ELSE array('vehicle_type') END AS set_fields",
    )
    return UP.partial_update(base, patches)


@query(
    "rescored_sources",
    "S16",
    f"WITH {SOURCES_SQL} SELECT id, CASE WHEN part % 5 = 0 THEN 77 ELSE data_quality_score END AS data_quality_score FROM sources",
)
def rescored_sources(spark, sf):
    s = sources(spark, sf)
    updates = s.filter("part % 5 = 0").select("id", F.lit(77).alias("data_quality_score")).distinct()
    return UP.update_quality(s.select("id", "data_quality_score"), updates)


@query(
    "cascade_delete",
    "S17 J10",
    f"""WITH {LAUNCHES_SQL}, {SOURCES_SQL}, {CONFLICTS_SQL}
    SELECT 'launches' AS tbl, count(*) AS n, CAST(sum(id % 1000003) AS BIGINT) AS id_sum FROM launches WHERE id % 9 <> 0
    UNION ALL SELECT 'sources', count(*), CAST(sum(id % 1000003) AS BIGINT) FROM sources WHERE launch_id % 9 <> 0
    UNION ALL SELECT 'conflicts', count(*), CAST(sum(id % 1000003) AS BIGINT) FROM conflicts WHERE launch_id % 9 <> 0""",
)
def cascade_delete(spark, sf):
    base = launches(spark, sf)
    left = UP.delete_cascade(base, sources(spark, sf), conflicts(spark, sf), base.filter("id % 9 = 0"))
    parts = [
        df.agg(F.count("*").alias("n"), F.sum(F.col("id") % 1000003).alias("id_sum")).select(F.lit(t).alias("tbl"), "n", "id_sum")
        for t, df in zip(("launches", "sources", "conflicts"), left)
    ]
    return reduce(DataFrame.unionByName, parts)


@query("retained_sources", "S18", f"WITH {SOURCES_SQL} SELECT id, scraped_at FROM sources WHERE scraped_at >= {T} - INTERVAL 30 DAY")
def retained_sources(spark, sf):
    return UP.retain_sources(sources(spark, sf), as_of()).select("id", "scraped_at")


@query(
    "retained_conflicts",
    "S19",
    f"WITH {CONFLICTS_SQL} SELECT id, resolved FROM conflicts WHERE NOT (resolved AND resolved_at < {T} - INTERVAL 90 DAY)",
)
def retained_conflicts(spark, sf):
    return UP.retain_conflicts(conflicts(spark, sf), as_of()).select("id", "resolved")


@query(
    "cleanup_counts",
    "S20",
    f"""WITH {SOURCES_SQL}, {CONFLICTS_SQL} SELECT (SELECT count(*) FROM sources WHERE scraped_at < {T} - INTERVAL 30 DAY) AS deleted_sources,
        (SELECT count(*) FROM conflicts WHERE resolved AND resolved_at < {T} - INTERVAL 90 DAY) AS deleted_conflicts""",
)
def cleanup_counts(spark, sf):
    return UP.cleanup_counts(sources(spark, sf), conflicts(spark, sf), as_of())


_BATCH = f"""{_MERGED}, s AS (SELECT launch_id, count(*) AS n FROM (WITH {SOURCES_SQL} SELECT * FROM sources) GROUP BY 1),
    c AS (SELECT launch_id, count(*) AS n FROM (WITH {CONFLICTS_SQL} SELECT * FROM conflicts) GROUP BY 1),
    b AS (SELECT m.slug, m.change = 'created' AS was_created, coalesce(s.n, 0) AS sources_created, coalesce(c.n, 0) AS conflicts_created
        FROM m LEFT JOIN s ON s.launch_id = m.k LEFT JOIN c ON c.launch_id = m.k WHERE m.change <> 'kept')"""


def _batch(spark, sf):
    slug = F.concat(F.lit("order-"), "launch_id")
    s = sources(spark, sf).withColumn("slug", slug).withColumnRenamed("id", "ingest_seq").drop("launch_id")
    c = conflicts(spark, sf).select(
        slug.alias("slug"), "field_name", "source1_value", "source2_value", "confidence_score", F.col("id").alias("ingest_seq")
    )
    return plan_batch(_current(spark, sf), _incoming(spark, sf), s, c, as_of())


@query("batch_summary", "S14", f"WITH {_BATCH} SELECT * FROM b")
def batch_summary(spark, sf):
    return _batch(spark, sf).summary.drop("id")


@query(
    "batch_totals",
    "S14",
    f"""WITH {_BATCH} SELECT count(*) FILTER (was_created) AS launches_created, count(*) FILTER (NOT was_created) AS launches_updated,
        CAST(sum(sources_created) AS BIGINT) AS total_sources_created, CAST(sum(conflicts_created) AS BIGINT) AS total_conflicts_created FROM b""",
)
def batch_totals(spark, sf):
    return totals(_batch(spark, sf).summary)
