"""Tables published together: what a write leaves behind."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recfuse.sources.snapshots import SnapshotTables


def test_a_write_leaves_no_shuffle_files(spark, tmp_path):
    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().size()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = blocks(), spark.conf.get(name, None)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("part", T.IntegerType())])
    tables = SnapshotTables(spark, str(tmp_path), {"rows": schema}, {"rows": "part"})
    rows = spark.range(1000).groupBy((F.col("id") % 50).alias("id")).count().select("id", (F.col("id") % 3).cast("int").alias("part"))
    staged = tables.stage("rows", rows)
    assert blocks() <= before and spark.conf.get(name, None) == setting
    tables.commit(staged_append=["rows"])
    assert staged.count() == tables.read("rows").count() == 50
