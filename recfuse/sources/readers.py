"""Scans: raw claims with a fixed all-text schema, curated tables, source catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recfuse import constants as C
from recfuse.schema import RAW

CORRUPT = "_corrupt_record"


def read_claims(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw claims from JSON lines or Parquet. Broken JSON lines are kept in ``_corrupt_record``."""
    if fmt == "json":
        schema = T.StructType([*RAW.fields, T.StructField(CORRUPT, T.StringType())])
        return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return spark.read.schema(RAW).format(fmt).load(path)


def stream_claims(spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """A curated table kept in a database, read in parallel over ranges of an integer key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for name, value in options.items():
        reader = reader.option(name, value)
    return (
        reader.option("partitionColumn", key)
        .option("lowerBound", str(lower))
        .option("upperBound", str(upper))
        .option("numPartitions", str(partitions))
        .load()
    )


def source_catalog(spark: SparkSession) -> DataFrame:
    """The fixed list of sources: four rows."""
    return spark.createDataFrame(
        C.SOURCE_CATALOG, "source string, source_name string, source_url string, data_quality_score double"
    )


def with_source_metadata(records: DataFrame, scraped_at, source: str = "source", url: str | None = None) -> DataFrame:
    """Add lineage columns to extracted records from the catalogue, one source per row.

    Documents have no fixed address; their own one (column ``url``) stands in.
    """
    catalog = source_catalog(records.sparkSession).withColumnsRenamed({"source": "_source", "source_url": "_url"})
    joined = records.join(F.broadcast(catalog), F.col(source) == F.col("_source"), "left").drop("_source")
    own = F.col(url) if url else F.lit(None).cast("string")
    return joined.withColumn("source_url", F.coalesce("_url", own)).withColumn("scraped_at", scraped_at).drop("_url")
