"""Snapshot tables, upserts, unions and read queries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recfuse.operators import serve as SV
from recfuse.operators import stats as ST
from recfuse.operators import upsert as UP
from recfuse.plans.persist import persist_batch, totals
from recfuse.schema import CONFLICTS_TABLE, LAUNCHES_TABLE, SOURCES_TABLE
from recfuse.sources import union as UN
from recfuse.sources.snapshots import SnapshotTables

NOW = dt.datetime(2024, 6, 1)
SCHEMAS = {"launches": LAUNCHES_TABLE, "sources": SOURCES_TABLE, "conflicts": CONFLICTS_TABLE}


def incoming(spark, rows):
    df = spark.createDataFrame(rows, "slug string, mission_name string, status string, orbit string, ingest_seq long")
    empty = {"launch_date": "timestamp", "vehicle_type": "string", "payload_mass": "double", "details": "string",
             "mission_patch_url": "string", "webcast_url": "string"}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})


def test_upsert_created_then_updated(spark, tmp_path):
    store = SnapshotTables(spark, str(tmp_path / "db"), SCHEMAS)
    first = UP.merge(store.read("launches"), incoming(spark, [("a", "A", "upcoming", "LEO", 1), ("b", "B", "success", None, 2)]), "slug", "ingest_seq", F.lit(NOW))
    assert UP.merge_counts(first).first().asDict() == {"created": 2, "updated": 0, "total": 2}
    store.commit(replace={"launches": first})
    ids = {r.slug: r.id for r in store.read("launches").collect()}
    later = NOW + dt.timedelta(days=1)
    batch = incoming(spark, [("a", "A2", "success", None, 3), ("a", "A3", "success", None, 4), ("c", "C", "success", None, 5)])
    second = UP.merge(store.read("launches"), batch, "slug", "ingest_seq", F.lit(later))
    assert UP.merge_counts(second).first().asDict() == {"created": 1, "updated": 2, "total": 3}
    store.commit(replace={"launches": second})
    rows = {r.slug: r for r in store.read("launches").collect()}
    assert rows["a"].mission_name == "A3" and rows["a"].orbit is None and rows["a"].id == ids["a"]
    assert rows["a"].created_at == NOW and rows["a"].updated_at == later and rows["b"].updated_at == NOW
    # Merging the same batch again changes nothing but the update time.
    again = UP.merge(store.read("launches"), batch, "slug", "ingest_seq", F.lit(later)).drop("_change", "_n_in")
    assert sorted(map(str, again.collect())) == sorted(map(str, store.read("launches").collect()))


def test_uncommitted_rows_stay_invisible(spark, tmp_path):
    store = SnapshotTables(spark, str(tmp_path / "db"), SCHEMAS)
    rows = spark.createDataFrame([(1, 1, "s", "https://x", NOW, None)], SOURCES_TABLE)
    store.commit(append={"sources": rows}, batch=1)
    store.stage("sources", rows)
    assert store.read("sources").count() == 1
    assert store.commit(append={"sources": rows}, batch=1) == 1 and store.read("sources").count() == 1
    store.commit(append={"sources": rows}, batch=2)
    assert store.read("sources").count() == 2 and store.last_batch() == 2


def launches(spark):
    days = lambda n: NOW + dt.timedelta(days=n)
    rows = [(i, f"s{i}", f"Name {i}", None if i == 9 else days(i * 10 - 50), "F9" if i % 2 else "FH", ["upcoming", "success", "failure"][i % 3]) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, slug string, mission_name string, launch_date timestamp, vehicle_type string, status string")
    return df.withColumns({"details": F.lit("100% sure"), "created_at": F.lit(NOW), "updated_at": F.lit(NOW)})


def test_search_wildcards(spark):
    df = launches(spark)
    assert SV.search(df, "e_1").count() == 1
    assert SV.search(df, "e_1", escape=True).count() == 0 and SV.search(df, "0%", escape=True).count() == 10
    # Undated rows come first in a descending list.
    assert SV.search(df, "name").first().id == 9


def test_pages_are_exact(spark):
    df = launches(spark)
    p = SV.ListParams(skip=4, limit=4, sort_by="mission_name", sort_order="asc")
    assert [r.id for r in SV.list_page(df, p).collect()] == [4, 5, 6, 7]
    m = SV.page_meta(df, p).first()
    assert (m.total, m.page, m.total_pages, m.has_next, m.has_prev) == (10, 2, 3, True, True)
    with pytest.raises(ValueError):
        SV.list_page(df, SV.ListParams(sort_by="details"))


@pytest.mark.parametrize("n", [0, 25, 10_001, 25_000])
def test_children_come_in_pages(spark, n):
    """Pages of one size whatever a parent holds: in order, none lost, kinds side by side."""
    ids = [i * 977 % 1_000_003 for i in range(n)]
    children = spark.createDataFrame([(i, 1, "k") for i in ids], "id long, launch_id long, name string").repartition(5)
    few = spark.createDataFrame([(7, 1), (3, 1), (5, 2)], "id long, launch_id long")
    out = SV.nest(launches(spark).select("id"), {"kids": children, "few": few}, "launch_id", size=10).collect()
    assert out[0].asDict().keys() == {"id", "page", "kids", "few"}
    mine = sorted((r for r in out if r.id == 1), key=lambda r: r.page)
    assert [r.page for r in mine] == list(range(max(1, -(-n // 10))))
    assert [k.id for r in mine for k in r.kids] == sorted(ids) and all(len(r.kids) <= 10 for r in mine)
    assert [f.id for f in mine[0].few] == [3, 7] and all(r.few == [] for r in mine[1:])
    assert all(r.kids == [] and r.page == 0 for r in out if r.id != 1) and len(out) == 9 + len(mine)


def test_statistics(spark):
    s = ST.launch_statistics(launches(spark)).first()
    assert (s.total_launches, s.upcoming_launches, s.successful_launches, s.failed_launches) == (10, 4, 3, 3)
    assert s.success_rate == 50.0
    empty = ST.launch_statistics(launches(spark).filter("id < 0")).first()
    assert empty.total_launches == 0 and empty.success_rate == 0


@pytest.mark.parametrize("n", [1, 7, 20, 20_000])
def test_percentiles(spark, n):
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("v"))
    r = ST.percentile_report(df, [], "v").first()
    values = sorted(float(i * 7919 % n) for i in range(n))
    assert r.n == n and r.p95 == values[int(0.95 * n)] and r.median == (values[(n - 1) // 2] + values[n // 2]) / 2


def test_percentiles_per_group_with_ties(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, float(rng.randrange(50))])) for _ in range(3000)]
    got = {r.g: r for r in ST.percentile_report(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in ("a", "b", None):
        values = sorted(v for k, v in rows if k == g and v is not None)
        n = len(values)
        assert (got[g].n, got[g].p95, got[g].median) == (n, values[int(0.95 * n)], (values[(n - 1) // 2] + values[n // 2]) / 2)
    assert ST.percentile_report(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_health(spark):
    rows = spark.createDataFrame([("healthy",), ("degraded",)], "status string")
    assert ST.overall_health(rows).first().status == "degraded"
    assert ST.overall_health(rows.filter("status = 'healthy'")).first().status == "healthy"
    assert ST.freshness_check(launches(spark), "updated_at", F.lit(NOW + dt.timedelta(hours=13))).first().status == "degraded"
    assert ST.freshness_state(launches(spark).filter("id < 0"), "updated_at", F.lit(NOW)).first().status == "no_data"


def test_empty_source_selection():
    with pytest.raises(ValueError):
        UN.select_sources(["spacex"], ["nope"])
    assert UN.select_sources(["a", "b"], ["b", "x"], None) == ["b"]


def test_partial_update_can_set_null(spark):
    cur = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, s string, t string")
    patch = spark.createDataFrame([(1, None, None, ["s"])], "id long, s string, t string, set_fields array<string>")
    assert {tuple(r) for r in UP.partial_update(cur, patch).collect()} == {(1, None, "x"), (2, "b", "y")}


def test_batch_with_children(spark, tmp_path):
    store = SnapshotTables(spark, str(tmp_path / "db"), SCHEMAS)
    rows = incoming(spark, [("a", "A", "upcoming", "LEO", 1), ("b", "B", "success", None, 2)])
    sources = spark.createDataFrame([("a", "s1", "https://x", NOW, 0.9, 1), ("a", "s2", "https://x", NOW, 0.8, 2), ("zz", "s3", "https://x", NOW, 0.8, 3)],
                                    "slug string, source_name string, source_url string, scraped_at timestamp, data_quality_score double, ingest_seq long")
    found = spark.createDataFrame([("b", "orbit", "LEO", "GTO", 0.7, 1)],
                                  "slug string, field_name string, source1_value string, source2_value string, confidence_score double, ingest_seq long")
    summary = persist_batch(store, rows, sources, found, F.lit(NOW), batch=1)
    got = {r.slug: (r.was_created, r.sources_created, r.conflicts_created) for r in summary.collect()}
    assert got == {"a": (True, 2, 0), "b": (True, 0, 1)}
    assert store.read("sources").count() == 2 and store.read("conflicts").first().resolved is False
    assert totals(summary).first().launches_created == 2
    left = UP.delete_cascade(store.read("launches"), store.read("sources"), store.read("conflicts"), store.read("launches").filter("slug = 'a'"))
    assert [df.count() for df in left] == [1, 0, 1]


def test_document_pages(spark):
    from recfuse.operators.documents import document_pages

    docs = spark.createDataFrame([(1, "\n--- Page 1 ---\nfirst text\n\n--- Page 2 ---\nsecond text\n")], "doc_id long, text string")
    assert [r.text.strip() for r in document_pages(docs).orderBy("page_no").collect()] == ["first text", "second text"]


def test_corrupt_claims_are_kept(spark, tmp_path):
    from recfuse.sources.readers import read_claims

    path = tmp_path / "claims.json"
    path.write_text('{"raw": {"slug": "a"}, "source": {"source_name": "s"}, "ingest_seq": 1}\nnot json\n')
    rows = read_claims(spark, str(path)).collect()
    assert [r._corrupt_record for r in rows] == [None, "not json"]
