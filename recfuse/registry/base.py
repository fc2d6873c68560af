"""Registry of queries over the given tables, each with an independent SQL statement where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None
    covers: str


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query. ``covers`` lists the inventory ids it exercises."""

    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(run)
        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Naive timestamps of the tables are UTC instants, whatever the session was set to.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, sf_dir)

        QUERIES[name] = Query(name, in_utc, sql, covers)
        return in_utc

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give heavy row-wise work enough tasks when a table has fewer input splits than the cluster has cores.

    Rows are dealt out in turn, not by a key: what follows is planned as it is on a table with splits
    enough, which is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
