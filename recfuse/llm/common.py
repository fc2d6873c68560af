"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recfuse.session import ensure_checkpoint_dir

#: Rows and bytes an Arrow batch may hold. Texts can be long, so a batch is kept small.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder that every executor reaches."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there, and it is computed once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the folders of stored frames. Call it when all that is made of them is stored itself."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def batched(df: DataFrame) -> DataFrame:
    """The frame; Arrow batches of its session are kept small from here on, in rows and in bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text of a documents table, with the named columns; a null text counts as empty."""
    return batched(docs).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def pairs_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of each batch as Python lists."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(n).to_pylist() for n in names)


def lists(offsets, values) -> pa.ListArray:
    """An Arrow list<int32> column from offsets and one flat array."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
