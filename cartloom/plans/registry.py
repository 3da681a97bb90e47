"""Named queries and the SQL that states what they must return."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.runtime import ADAPTIVE, SHARED_SHUFFLES, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The interaction log the reference works on, told by the order tables:
# reader = customer, author = supplier, item = part.
LOG_SQL = """log AS (
  SELECT l_orderkey AS basket, l_linenumber AS line, l_partkey AS item, l_suppkey AS author,
         o_custkey AS reader, l_quantity AS qty, l_extendedprice AS price, l_discount AS discount,
         o_orderdate AS posted, l_shipdate AS ship, CAST(l_returnflag = 'R' AS INT) AS y,
         CAST(l_linestatus = 'F' AS INT) AS z, o_orderpriority AS kind, o_orderstatus AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
LINE_ORDER = ["line", "item", "author", "price", "ship"]
LINE_ORDER_SQL = "line, item, author, price, ship"


# Epoch values need UTC.
SESSION_OPTIONS = {"spark.sql.session.timeZone": "UTC", **ADAPTIVE, SHARED_SHUFFLES: "true"}


class Tables:
    """The test tables of one scale factor, opened on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.spark.read.parquet(f"{self.folder}/documents.parquet"))

    @cached_property
    def log(self) -> DataFrame:
        joined = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(
            F.col("l_orderkey").alias("basket"), F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("author"),
            F.col("o_custkey").alias("reader"), F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
            F.col("o_orderdate").alias("posted"), F.col("l_shipdate").alias("ship"),
            (F.col("l_returnflag") == "R").cast("int").alias("y"),
            (F.col("l_linestatus") == "F").cast("int").alias("z"),
            F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"),
        )


def query(name: str, sql: str | None = None, options: dict[str, str] | None = None):
    """Register a function of Tables under a name, with its oracle and session options of its own, if any."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            for option, value in (SESSION_OPTIONS | (options or {})).items():
                spark.conf.set(option, value)
            return fn(Tables(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.replace("$LOG", LOG_SQL).replace("$LINE_ORDER", LINE_ORDER_SQL).strip()
        return fn

    return register


def rounded(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column.cast("double"), digits).alias(name or c)


def big(c: Column | str, name: str | None = None) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return column.cast("long").alias(name or c)


def text(c: Column | str, name: str | None = None) -> Column:
    """A list as comma-separated text."""
    column = F.col(c) if isinstance(c, str) else c
    return F.array_join(column.cast("array<string>"), ",").alias(name or c)


def scaled(c: Column | str, name: str | None = None) -> Column:
    """A list of numbers as text of whole millionths."""
    column = F.col(c) if isinstance(c, str) else c
    return text(F.transform(column, lambda x: F.round(x * 1000000).cast("long")), name or c)
