"""The physical plans the operators are meant to have."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recfuse.operators import conflicts as CO
from recfuse.operators import fuse as FU
from recfuse.operators import serve as SV
from recfuse.operators import validate as VA
from recfuse.registry.cleaning import raw_claims
from recfuse.registry.load import QUERIES
from recfuse.registry.views import launches
from recfuse.schema import LAUNCH_PROFILE
from recfuse.streaming import metrics as ME

SF_DIR = "/root/testdata/sf0.001"
NOW = dt.datetime(1998, 6, 15)


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def valid(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("claims") / "valid")
    VA.check_claims(raw_claims(spark, SF_DIR), F.lit(dt.datetime(2002, 1, 1))).valid.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("curated") / "launches")
    launches(spark, SF_DIR).write.parquet(path)
    return spark.read.parquet(path)


def test_fusion_shuffles_once(valid):
    text = plan(FU.fuse(valid, LAUNCH_PROFILE))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_min_by" in text and "Window" not in text


def test_the_registered_fusion_combines_before_its_shuffle(spark):
    """Claims are fused per task first; only candidates are shuffled by key."""
    text = plan(QUERIES["fused_claims"].run(spark, SF_DIR))
    # Plans are printed from the result down.
    assert text.count("hashpartitioning") == 1 and text.index("hashpartitioning") < text.rindex("partial_min_by")


def test_value_classes_use_hash_aggregation(valid):
    text = plan(CO.value_classes(valid, LAUNCH_PROFILE))
    assert "HashAggregate" in text and "SortAggregate" not in text and text.count("Exchange") == 1


def test_conflicts_never_form_a_cartesian_product(valid):
    text = plan(CO.detect(valid, LAUNCH_PROFILE))
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_base_conflicts_read_only_needed_columns(valid):
    text = plan(FU.base_conflicts(valid, LAUNCH_PROFILE))
    assert "Window" not in text and "Cartesian" not in text and "webcast_url" not in text.split("ReadSchema")[-1].split(">")[0]


def test_top_k_and_pushdown(table):
    text = plan(SV.upcoming(table, F.lit(NOW).cast("timestamp_ntz")))
    assert "TakeOrderedAndProject" in text and "EqualTo(status,upcoming)" in text and "GreaterThanOrEqual(launch_date" in text


def test_page_query_pushes_filters(table):
    p = SV.ListParams(status="success", vehicle_type="5-LOW", skip=10, limit=10)
    text = plan(SV.list_page(table, p).select("id", "slug"))
    assert "EqualTo(status,success)" in text and "EqualTo(vehicle_type,5-LOW)" in text and "details" not in text.split("ReadSchema")[-1]


def test_existence_is_a_semi_join(table):
    open_ = table.select(F.col("id").alias("launch_id"), F.lit(False).alias("resolved"), F.col("id").alias("x"))
    assert "LeftSemi" in plan(SV.with_open_conflicts(table, open_))


def test_checking_does_not_shuffle_and_runs_once(spark, valid):
    raw = spark.createDataFrame([], "raw struct<slug:string,mission_name:string,launch_date:string,vehicle_type:string,payload_mass:string,"
                                "orbit:string,status:string,details:string,mission_patch_url:string,webcast_url:string>,"
                                "source struct<source_name:string,source_url:string,scraped_at:string,data_quality_score:string>, ingest_seq long")
    logical = VA.check_claims(raw, F.lit(NOW)).valid._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("mission_name:required") <= 1


def test_histogram_is_one_aggregate_without_expand(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    text = plan(ME.histogram(events, ["event_type"], "value", "tasks"))
    assert text.count("Exchange hashpartitioning") == 1 and "Expand" not in text
