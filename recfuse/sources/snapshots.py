"""Curated tables on plain Parquet, published together.

Rows of commit ``n`` go to ``<table>/commit=n``; a marker lists the commits every table consists of,
for a partitioned table per partition, so a commit can replace some partitions and leave the others
where they are. Readers follow the newest marker: unfinished work is never seen and a path being read
is never overwritten. A marker is written aside and renamed, which fails if another writer was first.
A commit may carry a batch id; repeating it does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "commits"
#: Commits that a table, or one partition of it, may consist of before they are merged into one.
MOST_COMMITS = 16


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside are deleted when each ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class SnapshotTables:
    """A set of tables versioned together under one root folder of any Hadoop file system.

    ``partitions`` names the partition column of a table, a column with a bounded number of values.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schemas: Mapping[str, T.StructType],
        partitions: Mapping[str, str] | None = None,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas, self.partitions = dict(schemas), dict(partitions or {})
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._staged: set[str] = set()

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def version(self) -> int:
        """Number of the current commit; 0 when nothing was committed yet."""
        names = [n for n in self._names(f"{self.root}/{LOG}") if n.endswith(".json") and n[0].isdigit()]
        return max((int(n.removesuffix(".json")) for n in names), default=0)

    def _marker(self) -> dict:
        v = self.version()
        if not v:
            return {"tables": {}, "batch": None}
        text = self.spark.read.text(f"{self.root}/{LOG}/{v}.json", wholetext=True).first()
        return json.loads(text[0])

    def last_batch(self) -> int | None:
        return self._marker()["batch"]

    def commits(self, table: str) -> dict[str, list[int]]:
        """Commits that each partition consists of; an unpartitioned table is one partition named ''."""
        return self._marker()["tables"].get(table, {})

    def read(self, table: str, parts: Iterable | None = None) -> DataFrame:
        """The table as of the newest commit, or the named partitions of it."""
        found = self.commits(table)
        wanted = found if parts is None else {p: found.get(p, []) for p in map(str, parts)}
        return self._load(table, wanted)

    def _load(self, table: str, commits: Mapping[str, Sequence[int]], extra: Sequence[T.StructField] = ()) -> DataFrame:
        fields = [*self.schemas[table].fields, *extra]
        base, column = f"{self.root}/{table}", self.partitions.get(table)
        folder = lambda commit, part: f"{base}/commit={commit}" + (f"/{column}={part}" if column else "")
        paths = [folder(c, part) for part, own in commits.items() for c in own]
        schema = T.StructType([*fields, T.StructField("commit", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], T.StructType(fields))
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
        return rows.select(*[f.name for f in fields])

    def parts_written(self, table: str, commit: int) -> list[str]:
        """Partitions that a commit holds rows of."""
        if table not in self.partitions:
            return [""]
        start = f"{self.partitions[table]}="
        return sorted(n.removeprefix(start) for n in self._names(f"{self.root}/{table}/commit={commit}") if n.startswith(start))

    def stage(self, table: str, df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        """Write rows for the next commit and read them back; they stay invisible until it."""
        target = self.version() + 1
        self._write(target, table, df, extra)
        self._staged.add(table)
        written = {part: [target] for part in self.parts_written(table, target)}
        return self._load(table, written, [df.schema[c] for c in extra])

    def commit(
        self,
        replace: Mapping[str, DataFrame] | None = None,
        append: Mapping[str, DataFrame] | None = None,
        staged_replace: Sequence[str] = (),
        staged_append: Sequence[str] = (),
        batch: int | None = None,
        parts: Mapping[str, Iterable] | None = None,
    ) -> int:
        """Write and publish replaced tables, appended rows and staged rows, all at once.

        ``parts`` names the partitions of a replaced table that are replaced; without, all are.
        """
        current, old = self.version(), self._marker()
        if batch is not None and old["batch"] is not None and batch <= old["batch"]:
            return current
        if not {*staged_replace, *staged_append} <= self._staged:
            raise ValueError("a table to publish was not staged")
        target, tables = current + 1, {name: dict(own) for name, own in old["tables"].items()}
        for name, df in {**(replace or {}), **(append or {})}.items():
            self._write(target, name, df)
        for name in (*(replace or {}), *staged_replace):
            left = tables.get(name, {}) if parts and name in parts else {}
            gone = {str(p) for p in parts[name]} if parts and name in parts else set()
            kept = {p: own for p, own in left.items() if p not in gone}
            tables[name] = kept | {p: [target] for p in self.parts_written(name, target)}
        for name in (*(append or {}), *staged_append):
            own = tables.setdefault(name, {})
            for p in self.parts_written(name, target):
                own[p] = [*own.get(p, []), target]
        self._staged.clear()
        self._publish(target, {"tables": tables, "batch": old["batch"] if batch is None else batch})
        return target

    def compact(self, most: int = MOST_COMMITS) -> int | None:
        """Merge the commits of partitions that consist of more than ``most`` into one; the commit made, if any."""
        crowded = {t: [p for p, own in self.commits(t).items() if len(own) > most] for t in self.schemas}
        crowded = {t: parts for t, parts in crowded.items() if parts}
        if not crowded:
            return None
        merged = {t: self.read(t, parts) for t, parts in crowded.items()}
        return self.commit(replace=merged, parts=crowded)

    def _publish(self, target: int, marker: dict) -> None:
        aside = self._path(f"{self.root}/{LOG}/_{target}-{uuid.uuid4().hex}.json")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(marker), "utf-8"))
        stream.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(kind, 1)
        options[0] = kind.valueOf("NONE")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf)
        files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._path(f"{self.root}/{LOG}/{target}.json")), options)

    def _write(self, version: int, name: str, df: DataFrame, extra: Sequence[str] = ()) -> None:
        fields = self.schemas[name].fields
        rows = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in fields], *extra)
        column = self.partitions.get(name)
        if column:
            # One task writes a partition, or several where the adaptive plan splits a large one.
            rows = rows.hint("rebalance", column)
        writer = rows.write.mode("overwrite")
        if column:
            writer = writer.partitionBy(column)
        with shuffles_released(self.spark):
            writer.parquet(f"{self.root}/{name}/commit={version}")
