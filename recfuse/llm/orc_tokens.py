"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

``write`` encodes every whole text, appends an end id and writes the documents in ascending doc_id
order (null first, equal ids by text), one file per range of ids. Stripes are read in parallel; a
reader that asks for some doc_ids skips stripes and row groups by their minima, maxima and filters.
``read`` gives each document with its place in the whole id stream: sums inside a file, and one
offset per file from a pass that reads only the count column.

Null text counts as empty (only the end id). Repeated rows are all written. An empty table gives no
files with rows and reads back empty. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recfuse.llm.bpe import codec
from recfuse.llm.common import lists, pairs_of, scratch, texts
from recfuse.llm.words import WordCodec

SCHEMA = "doc_id long, n_tokens long, ids array<int>, file long, row long"


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, stripe_mb: int = 16, index_rows: int = 1000) -> None:
    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(WordCodec, tokenizer, end_id)
        for keys, rows in pairs_of(batches, "doc_id", "text"):
            found = [own.encode(t) for t in rows]
            counts = np.array([len(x) // 4 for x in found], np.int64)
            ids = lists(np.concatenate([[0], np.cumsum(counts)]), np.frombuffer(b"".join(found), "<i4"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts), ids], ["doc_id", "n_tokens", "ids"])

    # Equal ids share a range; the salt spreads an id that many rows share.
    ordered = texts(docs).repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    (
        ordered.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")
        .withColumn("file", F.spark_partition_id().cast("long"))
        .withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .write.option("orc.compress", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(index_rows))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("orc.bloom.filter.columns", "doc_id")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, row, n_tokens, ids of every document in the files."""
    return spark.read.schema(SCHEMA).orc(path)


def starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``start`` to rows with file, row, n_tokens. files: the same files, of which only counts are read."""
    totals = files.groupBy("file").agg(F.sum("n_tokens").alias("_all"))
    # One row per file that was written; no more than the partitions of the writing job.
    before = totals.select("file", F.coalesce(F.sum("_all").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_in", F.coalesce(inside, F.lit(0))).join(before, "file").withColumn("start", F.col("_in") + F.col("_base")).drop("_in", "_base")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all from the files."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, edges = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(flat)).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("doc_id", "file", "row", "n_tokens")), pa.array(sums, pa.int64())],
                ["doc_id", "file", "row", "n_tokens", "ids_crc32"],
            )

    files = read(spark, path)
    rows = files.select("doc_id", "file", "row", "n_tokens", "ids").mapInArrow(run, "doc_id long, file long, row long, n_tokens long, ids_crc32 long")
    return starts(rows, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def written_digests(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the files (to a new shared folder unless a path is given) and digest what they hold."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-orc")
    write(docs, path, **options)
    return read_digests(spark, path)
