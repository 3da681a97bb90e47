"""Queries of this subpackage and the SQL that states what they must return."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cartloom.plans.registry import SESSION_OPTIONS
from cartloom.runtime import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Whole texts go to Python in small batches, so that a run of very long ones
# does not fill a worker.
OPTIONS = SESSION_OPTIONS | {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def prepare(spark: SparkSession) -> None:
    for option, value in OPTIONS.items():
        spark.conf.set(option, value)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def llm_query(name: str, sql: str | None = None):
    """Register a function of (spark, folder), with its oracle if SQL has one."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return fn(spark, folder)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder, or the path given, read back.

    What is read again later comes from files that outlive executors, and is
    computed once.
    """
    spark, path = df.sparkSession, path or scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What a job has shuffled is deleted at its end, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def fresh(taken: list[str], name: str) -> str:
    """A name for a helper column that none of the taken ones has, in whatever case."""
    used = {c.lower() for c in taken}
    name = f"_{name}"
    while name in used:
        name = f"_{name}"
    return name


def settled(df: DataFrame, path: str | None = None) -> DataFrame:
    """Rows in the same order whenever a partition is computed again.

    So they are in a plain scan; what comes out of a shuffle is written first,
    to the path if one is given.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    moved = ("Join", "Aggregate", "Repartition", "Sort", "Window", "Generate", "Sample", "Limit", "Map", "Union")
    return written(df, path) if any(word in plan for word in moved) else df
