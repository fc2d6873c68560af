"""Registered queries: roll-ups, windows, admission and unions, in their batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recfuse.functions import text as X
from recfuse.functions import values as V
from recfuse.plans.curate import CurateConfig, Curated, curate, run_history, statistics
from recfuse.registry.base import query, table
from recfuse.registry.cleaning import AS_OF as CLEAN_AS_OF
from recfuse.registry.cleaning import _CHECKED_SQL, raw_claims
from recfuse.registry.views import split_columns
from recfuse.schema import LAUNCH_FIELDS, SOURCE_FIELDS
from recfuse.session import ensure_checkpoint_dir
from recfuse.sources import readers as RD
from recfuse.sources import union as UN
from recfuse.streaming import limiter as LM
from recfuse.streaming.ingest import CurationSink
from recfuse.streaming import metrics as ME


def _events(spark, sf):
    return table(spark, sf, "events")


def _ntz(name):
    return F.col(name).cast("timestamp_ntz").alias(name)


@query(
    "event_counters",
    "T4",
    """SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
)
def event_counters(spark, sf):
    return ME.counters(_events(spark, sf), "ts", ["event_type"]).select(_ntz("window_start"), "event_type", "n")


@query(
    "value_histogram",
    "T5",
    """WITH b AS (SELECT unnest([1.0, 5.0, 10.0, 30.0, 60.0, 300.0, 600.0, 1800.0, 3600.0]::DOUBLE[]) AS b)
    SELECT event_type, CAST(b AS VARCHAR) AS le, count(*) FILTER (value <= b) AS n, count(value) AS total FROM events, b GROUP BY event_type, b
    UNION ALL SELECT event_type, '+Inf', count(value), count(value) FROM events GROUP BY event_type""",
)
def value_histogram(spark, sf):
    return ME.histogram(_events(spark, sf), ["event_type"], "value", "tasks").select("event_type", "le", "n", "total")


@query(
    "last_values",
    "T6",
    "SELECT user_id, event_type, arg_max(value, {'t': ts, 'i': event_id}) AS value, max(ts) AS at FROM events GROUP BY 1, 2",
)
def last_values(spark, sf):
    return ME.gauges(_events(spark, sf), "ts", ["user_id", "event_type"], "value", ["event_id"])


@query(
    "failure_alerts",
    "T7",
    """WITH e AS (SELECT ts, unnest(generate_series(0, 11)) AS k FROM events WHERE event_type = 'error'),
      w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS window_start, count(*) AS n FROM e GROUP BY 1)
    SELECT window_start, n FROM w WHERE n > 5""",
)
def failure_alerts(spark, sf):
    fired = ME.repeated_failures(_events(spark, sf), "ts", F.col("event_type") == "error")
    return fired.select(_ntz("window_start"), "n")


@query(
    "error_rate_alerts",
    "T7 W5",
    """WITH e AS (SELECT ts, unnest(generate_series(0, 4)) AS k FROM events WHERE event_id % 2 = 0),
      w AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - k * INTERVAL 1 MINUTE AS window_start, count(*) AS n FROM e GROUP BY 1)
    SELECT window_start, n, n / 300.0::DOUBLE AS level FROM w WHERE n / 300.0::DOUBLE > 0.01::DOUBLE""",
)
def error_rate_alerts(spark, sf):
    coded = _events(spark, sf).withColumn("status_code", F.when(F.col("event_id") % 2 == 0, "503").otherwise("200"))
    # The same rule as high_error_rate with a bound that the sparse table reaches.
    fired = ME.alerts(coded, "ts", [], F.col("status_code").startswith("5"), "5 minutes", "1 minute", 0.01, 300)
    return fired.select(_ntz("window_start"), "n", "level")


@query(
    "trailing_requests",
    "W4",
    """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS trailing
    FROM events""",
)
def trailing_requests(spark, sf):
    return ME.trailing(_events(spark, sf), ["event_type"], "ts", 3600).select("event_id", "trailing")


@query(
    "trailing_increase",
    "W5",
    """SELECT event_id, CAST(sum(event_id % 7) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS increase
    FROM events""",
)
def trailing_increase(spark, sf):
    return ME.trailing(_events(spark, sf), ["event_type"], "ts", 3600, F.col("event_id") % 7, True, "increase").select("event_id", "increase")


@query(
    "hourly_rollup",
    "T10",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, user_id % 3 AS worker, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok,
        count(*) FILTER (event_type <> 'error') / count(*) * 100 AS success_rate, round(avg(value), 6) AS avg_runtime FROM events GROUP BY 1, 2""",
)
def hourly_rollup(spark, sf):
    e = _events(spark, sf).withColumn("worker", F.col("user_id") % 3)
    r = ME.rollup(e, "ts", F.col("event_type") != "error", "value", ["worker"])
    return r.select(_ntz("hour"), "worker", "total", "ok", "success_rate", F.round("avg_runtime", 6).alias("avg_runtime"))


_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'INFO' ELSE 'WARNING' END"


@query(
    "log_tail",
    "T11",
    f"SELECT event_id, {_LEVEL} AS level FROM events WHERE event_type IN ('error', 'signup', 'purchase') ORDER BY ts DESC, event_id LIMIT 100",
)
def log_tail(spark, sf):
    logs = _events(spark, sf).selectExpr("event_id", "ts", f"{_LEVEL} AS level")
    return ME.log_tail(logs, "ts", "level", "WARNING", 100, "event_id").select("event_id", "level")


@query(
    "first_claims",
    "T9",
    """SELECT user_id, event_type, CAST(round(value) AS BIGINT) AS v, min(ts) AS ts FROM events GROUP BY 1, 2, 3""",
)
def first_claims(spark, sf):
    e = _events(spark, sf).selectExpr("user_id", "event_type", "CAST(round(value) AS BIGINT) AS v", "ts")
    return ME.first_claims(e, "ts", ["user_id", "event_type"]).select("user_id", "event_type", "v", _ntz("ts"))


def _requests(spark, sf, limit=3, window=3600):
    e = _events(spark, sf).selectExpr("event_id", "ts", "CAST(user_id % 7 AS STRING) AS identifier", "event_type AS endpoint")
    return e.withColumns({"max_requests": F.lit(limit), "window_s": F.lit(window)})


@query(
    "admitted_requests",
    "T1",
    """WITH RECURSIVE r AS (SELECT event_id, epoch_us(ts) AS us, user_id % 7 AS u, event_type AS e,
        row_number() OVER (PARTITION BY user_id % 7, event_type ORDER BY ts, event_id) AS i FROM events),
      w AS (SELECT event_id, u, e, i, true AS allowed, 2 AS remaining, [us] AS passed FROM r WHERE i = 1
        UNION ALL SELECT n.event_id, n.u, n.e, n.i, n.allowed, CASE WHEN n.allowed THEN 2 - len(n.live) ELSE 0 END,
            CASE WHEN n.allowed THEN list_append(n.live, n.us) ELSE n.live END
        FROM (SELECT r.event_id, r.u, r.e, r.i, r.us, [x FOR x IN w.passed IF x > r.us - 3600000000] AS live,
            len([x FOR x IN w.passed IF x > r.us - 3600000000]) < 3 AS allowed
            FROM w JOIN r ON r.u = w.u AND r.e = w.e AND r.i = w.i + 1) n)
    SELECT event_id, allowed, CAST(remaining AS INTEGER) AS remaining FROM w""",
)
def admitted_requests(spark, sf):
    return LM.admit(_requests(spark, sf), "ts", "event_id").select("event_id", "allowed", "remaining")


@query(
    "request_limits",
    "T2",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 300 WHEN 'error' THEN 10 ELSE 100 END AS max_requests,
        3600 AS window_s FROM events""",
)
def request_limits(spark, sf):
    e = _events(spark, sf).selectExpr(
        "event_id",
        "CASE event_type WHEN 'click' THEN '/api/launches' WHEN 'view' THEN '/api/launches/upcoming' WHEN 'error' THEN '/api/admin/refresh' "
        "ELSE '/other' END AS endpoint",
    )
    return LM.with_limits(e).select("event_id", "max_requests", "window_s")


@query(
    "active_limits",
    "T3",
    """SELECT CAST(user_id % 7 AS VARCHAR) AS identifier, event_type AS endpoint, count(*) AS current_requests FROM events
        WHERE ts > TIMESTAMP '2024-01-15 11:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1, 2""",
)
def active_limits(spark, sf):
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return LM.active_limits(_requests(spark, sf), "ts", as_of).select("identifier", "endpoint", "current_requests")


# Suppliers of three regions as three sources of one list, the documents' place taken by parts.
def _frames(spark, sf):
    s = table(spark, sf, "supplier")
    record = lambda n: s.filter(F.col("s_nationkey") % 3 == n).selectExpr(
        "s_suppkey AS ingest_seq", f"concat('sup-', CAST(s_suppkey % {40 + n} AS STRING)) AS slug",
        "concat('Supplier ', CAST(s_suppkey % 30 AS STRING)) AS mission_name", "CASE WHEN s_acctbal > 0 THEN 'LEO' END AS orbit",
    )
    return {"spacex": record(0), "nasa": record(1), "wikipedia": record(2)}


_UNION = """u AS (SELECT s_nationkey % 3 AS so, s_suppkey AS q, 'sup-' || (s_suppkey % (40 + s_nationkey % 3)) AS slug,
      'Supplier ' || (s_suppkey % 30) AS name, CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS info FROM supplier)"""
_TWO_PASS = """f AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY so, q) AS r1 FROM {0}),
      g AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY info DESC, so, q) AS r2 FROM f WHERE r1 = 1)"""


@query(
    "source_union",
    "S5 U1 A17",
    f"WITH {_UNION} SELECT CASE so WHEN 0 THEN 'spacex' ELSE 'wikipedia' END AS source, slug, q AS ingest_seq FROM u WHERE so <> 1",
)
def source_union(spark, sf):
    rows = UN.union_sources(_frames(spark, sf), ["spacex", "nasa", "wikipedia", "unknown"], ["nasa"])
    return rows.select("source", "slug", "ingest_seq")


@query(
    "source_fallback",
    "S6",
    f"""WITH {_UNION}, n AS (SELECT count(*) AS n FROM u WHERE so = 0), a AS (SELECT u.* FROM u, n WHERE so = 0 OR n < 1000000),
      {_TWO_PASS.format('a')}, b AS (SELECT * FROM u WHERE so = 0), {_TWO_PASS.format('b').replace('f AS', 'f2 AS').replace('g AS', 'g2 AS').replace('FROM f ', 'FROM f2 ')}
    SELECT 'short' AS run, slug, q AS ingest_seq FROM g WHERE r2 = 1 UNION ALL SELECT 'enough', slug, q FROM g2 WHERE r2 = 1""",
)
def source_fallback(spark, sf):
    frames = _frames(spark, sf)
    runs = {
        name: UN.with_fallback(frames, ["spacex"], ["nasa", "wikipedia"], need).select(F.lit(name).alias("run"), "slug", "ingest_seq")
        for name, need in (("short", 1_000_000), ("enough", 1))
    }
    return runs["short"].unionByName(runs["enough"])


@query(
    "source_bundle",
    "S7 F6 A17",
    f"""WITH {_UNION}, {_TWO_PASS.format('u')} SELECT 'record' AS section, slug AS item, q::DOUBLE AS value FROM g WHERE r2 = 1
    UNION ALL SELECT 'rows', CASE so WHEN 0 THEN 'spacex' WHEN 1 THEN 'nasa' ELSE 'wikipedia' END, count(*)::DOUBLE FROM u GROUP BY so
    UNION ALL SELECT 'rows', 'all', count(*)::DOUBLE FROM u
    UNION ALL SELECT 'quality', * FROM (VALUES ('SpaceX Official Website', 0.9::DOUBLE), ('NASA Official Website', 0.8::DOUBLE), ('Wikipedia', 0.7::DOUBLE))""",
)
def source_bundle(spark, sf):
    """Records, rows per source, and the sources read, of one bundle."""
    b = UN.bundle(_frames(spark, sf), F.current_timestamp())
    part = lambda df, section, item, value: df.select(F.lit(section).alias("section"), F.col(item).alias("item"), F.col(value).cast("double").alias("value"))
    rows = part(b.records, "record", "slug", "ingest_seq").unionByName(part(b.breakdown, "rows", "item", "n"))
    return rows.unionByName(part(b.provenance, "quality", "source_name", "data_quality_score"))


@query(
    "source_metadata",
    "S8",
    """SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'SpaceX Official Website' WHEN 1 THEN 'NASA Official Website' ELSE 'Wikipedia' END AS source_name,
        CASE s_nationkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 ELSE 0.7 END::DOUBLE AS data_quality_score FROM supplier""",
)
def source_metadata(spark, sf):
    s = table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "CASE s_nationkey % 3 WHEN 0 THEN 'spacex' WHEN 1 THEN 'nasa' ELSE 'wikipedia' END AS source"
    )
    return RD.with_source_metadata(s, F.current_timestamp()).select("s_suppkey", "source_name", "data_quality_score")


# Line items as claims about their order, some invalid, with the fields and defects that SQL below knows from the columns.
_ORDER_CLAIMS = """
    concat('Order-', l_orderkey) AS slug,
    concat(' Order ', l_orderkey) AS mission_name,
    CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE date_format(date_add(l_shipdate, 4000), 'yyyy-MM-dd') END AS launch_date,
    CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_returnflag END AS vehicle_type,
    CASE WHEN l_suppkey % 6 = 0 THEN 'n/a' ELSE CAST(l_extendedprice AS STRING) END AS payload_mass,
    CASE WHEN l_linenumber = 3 THEN ' ' ELSE l_linestatus END AS orbit,
    CASE l_suppkey % 3 WHEN 0 THEN 'Successful' WHEN 1 THEN 'success' ELSE 'FAILED' END AS status,
    concat('qty ', repeat('x', CAST(l_quantity AS INT))) AS details,
    CASE WHEN l_suppkey % 11 = 0 THEN 'ftp://x' END AS mission_patch_url,
    CAST(NULL AS STRING) AS webcast_url,
    CASE l_suppkey % 3 WHEN 0 THEN 'SpaceX Official' WHEN 1 THEN 'NASA' ELSE 'Wikipedia' END AS source_name,
    'https://s.example/x' AS source_url,
    '2001-01-01 00:00:00' AS scraped_at,
    concat('0.', 1 + l_suppkey % 9) AS data_quality_score
"""
_ORDERS_SQL = """v AS (SELECT 'order-' || l_orderkey AS slug, 'Order ' || l_orderkey AS mission_name, (l_orderkey * 8 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS seq,
        CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE date_trunc('day', l_shipdate) + INTERVAL 4000 DAY END AS dt,
        CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_returnflag END AS vehicle, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE l_extendedprice END AS mass,
        CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linestatus END AS orbit, CASE WHEN l_suppkey % 3 < 2 THEN 'success' ELSE 'failure' END AS status,
        'qty ' || repeat('x', CAST(l_quantity AS INTEGER)) AS details, CASE l_suppkey % 3 WHEN 0 THEN 'SpaceX Official' WHEN 1 THEN 'NASA' ELSE 'Wikipedia' END AS source,
        CASE l_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS prio, l_suppkey % 9 AS q FROM lineitem WHERE l_suppkey % 11 <> 0)"""


def _fused_sql(claims: str, keys: str) -> str:
    """Fusion of the claims by ranks: the first filled value in trust order, the longest details."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY prio, q DESC, seq) AS rk FROM {claims}),
      l AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY length(details) DESC, rk) AS lrk FROM r),
      f AS (SELECT slug, min(mission_name) AS mission_name, CAST(arg_min(dt, rk) FILTER (dt IS NOT NULL) AS TIMESTAMP) AS launch_date,
        arg_min(vehicle, rk) FILTER (vehicle IS NOT NULL) AS vehicle_type, arg_min(mass, rk) FILTER (mass IS NOT NULL) AS payload_mass,
        arg_min(orbit, rk) FILTER (orbit IS NOT NULL) AS orbit, arg_min(status, rk) AS status, arg_min(details, lrk) AS details,
        arg_min(source, rk) AS base_source, count(*) AS n_claims FROM l GROUP BY {keys})"""


def order_claims(spark, sf):
    """Nested raw claims about orders, with the line number they came in."""
    columns = [c.strip() for c in split_columns(_ORDER_CLAIMS)]
    flat = table(spark, sf, "lineitem").selectExpr("(l_orderkey * 8 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS ingest_seq", "l_linenumber", *columns)
    return flat.select(F.struct(*LAUNCH_FIELDS).alias("raw"), F.struct(*SOURCE_FIELDS).alias("source"), "ingest_seq", "l_linenumber")


def _run(spark, sf, **switches) -> Curated:
    return curate(raw_claims(spark, sf), F.lit(CLEAN_AS_OF).cast("timestamp"), CurateConfig(**switches))


def _order_run(spark, sf, **switches) -> Curated:
    return curate(order_claims(spark, sf).drop("l_linenumber"), F.lit(_ORDERS_AS_OF).cast("timestamp"), CurateConfig(**switches))


_ORDERS_AS_OF = "2020-01-01"
_RECORD = ["slug", "mission_name", "launch_date", "vehicle_type", "payload_mass", "orbit", "status", "details"]


def _records(fused, *more):
    return fused.select(*[_ntz(c) if c == "launch_date" else F.col(c) for c in _RECORD], *more)


@query(
    "curated_records",
    "S1 V10 F1 R8 R9 R11",
    f"WITH {_ORDERS_SQL}, {_fused_sql('v', 'slug')} SELECT * FROM f",
)
def curated_records(spark, sf):
    """Raw claims to fused records, all fields."""
    return _records(_order_run(spark, sf).fused, "base_source", "n_claims")


@query(
    "date_split_records",
    "D4 F2 R8",
    f"""WITH RECURSIVE {_ORDERS_SQL}, o AS (SELECT slug, seq, dt, row_number() OVER (PARTITION BY slug ORDER BY dt NULLS LAST, seq) AS i FROM v),
      w AS (SELECT slug, seq, i, dt AS anchor FROM o WHERE i = 1
        UNION ALL SELECT o.slug, o.seq, o.i, CASE WHEN o.dt IS NULL THEN NULL WHEN o.dt - w.anchor <= INTERVAL 24 HOUR THEN w.anchor ELSE o.dt END
        FROM w JOIN o ON o.slug = w.slug AND o.i = w.i + 1),
      c AS (SELECT v.*, w.anchor FROM v JOIN w ON w.slug = v.slug AND w.seq = v.seq), {_fused_sql('c', 'slug, anchor')} SELECT * FROM f""",
)
def date_split_records(spark, sf):
    """The same claims, split by date inside an order before they are fused."""
    return _records(_order_run(spark, sf, mode="date_split").fused, "base_source", "n_claims")


_DIFFER = """(CASE WHEN abs(epoch(a.dt) - epoch(b.dt)) > {seconds} THEN 1 ELSE 0 END + CASE WHEN a.vehicle <> b.vehicle THEN 1 ELSE 0 END
        + CASE WHEN {mass} THEN 1 ELSE 0 END + CASE WHEN a.orbit <> b.orbit THEN 1 ELSE 0 END + CASE WHEN a.status <> b.status THEN 1 ELSE 0 END
        + CASE WHEN a.details <> b.details THEN 1 ELSE 0 END)"""


@query(
    "curation_statistics",
    "A15",
    f"""WITH {_ORDERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY prio, q DESC, seq) AS rk FROM v),
      d AS (SELECT sum{_DIFFER.format(seconds=7200, mass="abs(a.mass - b.mass) / ((abs(a.mass) + abs(b.mass)) / 2.0::DOUBLE) * 100.0::DOUBLE > 10.0::DOUBLE")} AS n
        FROM v a JOIN v b ON a.slug = b.slug AND a.seq < b.seq),
      b AS (SELECT sum{_DIFFER.format(seconds=3600, mass="abs(a.mass - b.mass) / greatest(abs(a.mass), abs(b.mass)) > 0.1::DOUBLE")} AS n
        FROM r a JOIN r b ON a.slug = b.slug AND a.rk = 1 AND b.rk > 1),
      t AS (SELECT count(*) AS n FROM lineitem), c AS (SELECT count(*) AS n, count(DISTINCT slug) AS k FROM v)
    SELECT t.n AS input_records, c.n AS validated_records, t.n - c.n AS validation_errors, c.k AS reconciled_records, c.k AS final_records,
      CAST(d.n AS BIGINT) AS conflicts_detected, CAST(b.n AS BIGINT) AS base_conflicts, c.n / t.n AS validation_success_rate FROM t, c, d, b""",
)
def curation_statistics(spark, sf):
    """All stages of a run, conflicts between all claims and with the base claims included."""
    return statistics(_order_run(spark, sf))


@query(
    "run_history",
    "A16",
    f"""WITH {_CHECKED_SQL} SELECT ingest_seq % 5 AS batch, count(*) AS input_records, count(*) FILTER (len(errors) = 0) AS validated_records,
        count(*) FILTER (len(errors) > 0) AS validation_errors FROM e GROUP BY 1""",
)
def run_history_rows(spark, sf):
    # Five runs by the last digit of the ingest number.
    checked = _run(spark, sf, detect_conflicts=False).checked.withColumn("batch", F.col("ingest_seq") % 5)
    return run_history(checked, "batch")


@query(
    "incremental_curation",
    "T8",
    f"""WITH {_ORDERS_SQL}, {_fused_sql('v', 'slug')},
      u AS (SELECT slug, 'launch_date' AS f, CAST(dt AS VARCHAR) AS t, epoch(dt)::DOUBLE AS n FROM v WHERE dt IS NOT NULL
        UNION SELECT slug, 'vehicle_type', vehicle, NULL FROM v WHERE vehicle IS NOT NULL
        UNION SELECT slug, 'payload_mass', CAST(mass AS VARCHAR), mass FROM v WHERE mass IS NOT NULL
        UNION SELECT slug, 'orbit', orbit, NULL FROM v WHERE orbit IS NOT NULL
        UNION SELECT slug, 'status', status, NULL FROM v UNION SELECT slug, 'details', details, NULL FROM v),
      p AS (SELECT a.slug, a.f FROM u a JOIN u b ON a.slug = b.slug AND a.f = b.f AND a.t < b.t
        WHERE CASE a.f WHEN 'launch_date' THEN abs(a.n - b.n) > 7200
          WHEN 'payload_mass' THEN abs(a.n - b.n) / ((abs(a.n) + abs(b.n)) / 2.0::DOUBLE) * 100.0::DOUBLE > 10.0::DOUBLE ELSE true END),
      c AS (SELECT slug, count(*) AS conflicts FROM p GROUP BY slug)
    SELECT f.* EXCLUDE (base_source, n_claims), n_claims AS sources, coalesce(conflicts, 0) AS conflicts FROM f LEFT JOIN c ON c.slug = f.slug""",
)
def incremental_curation(spark, sf):
    """Three batches through the sink, then the curated tables as they were published."""
    raw = order_claims(spark, sf)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/curated-{uuid.uuid4().hex}"
    sink = CurationSink(spark, root, F.lit(_ORDERS_AS_OF).cast("timestamp"), key_parts=8, most_commits=2)
    for batch in range(3):
        sink(raw.filter(F.col("l_linenumber") % 3 == batch).drop("l_linenumber"), batch)
    count = lambda name, out: sink.tables.read(name).groupBy(F.col("launch_id").alias("id")).agg(F.count("*").alias(out))
    joined = sink.tables.read("launches").join(count("sources", "sources"), "id", "left").join(count("conflicts", "conflicts"), "id", "left")
    rows = joined.withColumn("payload_mass", F.col("payload_mass").cast("double"))
    return _records(rows, F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


# Scalar expression library over events.
@query(
    "event_ages",
    "X2.11 staleness relative-age",
    """WITH a AS (SELECT event_id, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) AS us FROM events)
    SELECT event_id, round(us / 3600000000.0::DOUBLE, 6) AS hours, CASE WHEN us > 86400000000 THEN 'expired' WHEN us > 300000000 THEN 'stale' ELSE 'fresh' END AS state,
      CASE WHEN us // 86400000000 > 0 THEN (us // 86400000000) || ' day' || CASE WHEN us // 86400000000 > 1 THEN 's' ELSE '' END || ' ago'
        WHEN us // 3600000000 > 0 THEN (us // 3600000000) || ' hour' || CASE WHEN us // 3600000000 > 1 THEN 's' ELSE '' END || ' ago'
        WHEN us // 60000000 > 0 THEN (us // 60000000) || ' minute' || CASE WHEN us // 60000000 > 1 THEN 's' ELSE '' END || ' ago'
        ELSE 'Just now' END AS age FROM a""",
)
def event_ages(spark, sf):
    now = F.lit("2024-01-31").cast("timestamp")
    ts = F.col("ts")
    return _events(spark, sf).select(
        "event_id", F.round(V.age_hours(ts, now), 6).alias("hours"), V.staleness(ts, now).alias("state"), V.relative_age(ts, now).alias("age")
    )


@query(
    "request_labels",
    "X2.11 labels routes clients noise redaction",
    """SELECT event_id, CASE user_id % 4 WHEN 0 THEN '/api/launches/{slug}' WHEN 1 THEN '/api/admin/conflicts/{id}/resolve'
        WHEN 2 THEN '/api/admin/refresh/status/{task_id}' ELSE '/api/launches' END AS route,
      CASE user_id % 4 WHEN 0 THEN 'api_key:key-0000...' WHEN 1 THEN 'jwt:token-00...' WHEN 2 THEN 'ip:10.0.0.1' ELSE 'ip:unknown' END AS client,
      CASE event_type WHEN 'signup' THEN 'In Flight' ELSE upper(event_type[1]) || event_type[2:] END AS label,
      event_type = 'error' OR user_id % 5 = 0 AS noise, '[REDACTED]' AS secret, event_type AS kind FROM events""",
)
def request_labels(spark, sf):
    u = F.col("user_id")
    path = F.expr(
        """CASE user_id % 4 WHEN 0 THEN concat('/api/launches/slug-', user_id, '?x=1') WHEN 1 THEN concat('/api/admin/conflicts/', user_id, '/resolve')
        WHEN 2 THEN concat('/api/admin/refresh/status/', user_id) ELSE '/api/launches?skip=1' END"""
    )
    when = lambda n, v: F.when(u % 4 == n, F.lit(v))
    client = X.client_id(when(0, "key-000000001"), when(1, "Bearer token-0000001"), F.lit(None).cast("string"), when(2, "10.0.0.1, 10.0.0.2"), F.lit(None).cast("string"))
    log = X.redact(F.create_map(F.lit("api_key"), F.lit("s3"), F.lit("kind"), F.col("event_type")))
    return _events(spark, sf).select(
        "event_id",
        X.route_template(path).alias("route"),
        client.alias("client"),
        X.title_label(F.when(F.col("event_type") == "signup", "in_flight").otherwise(F.col("event_type"))).alias("label"),
        X.is_noise(F.when(u % 5 == 0, "HTTPException").otherwise("Other"), F.when(F.col("event_type") == "error", "Connection lost").otherwise("fine")).alias("noise"),
        log["api_key"].alias("secret"),
        log["kind"].alias("kind"),
    )
