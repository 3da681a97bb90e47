"""Readers with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the engagement log, labels last.
ENGAGEMENT_FIELDS = """
text_tokens string, hashtags string, tweet_id string, media string, links string, domains string,
tweet_type string, language string, timestamp bigint, a_user_id string, a_follower_count bigint,
a_following_count bigint, a_is_verified boolean, a_account_creation bigint, b_user_id string,
b_follower_count bigint, b_following_count bigint, b_is_verified boolean, b_account_creation bigint,
b_follows_a boolean
"""
LABEL_FIELDS = "reply bigint, retweet bigint, retweet_comment bigint, like bigint"
FIELD_SEPARATOR = "\x01"


def engagement_schema(labelled: bool = True) -> str:
    fields = ENGAGEMENT_FIELDS.replace("\n", " ")
    return f"{fields}, {LABEL_FIELDS}" if labelled else fields


def read_engagements(spark: SparkSession, path: str | Sequence[str], labelled: bool = True,
                     schema: str | T.StructType | None = None) -> DataFrame:
    """Headerless log with \\x01 between fields; tabs stay inside fields."""
    reader = spark.read.schema(schema or engagement_schema(labelled))
    return reader.options(sep=FIELD_SEPARATOR, quote="", escape="", header=False).csv(path)


def read_table_csv(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType,
                   columns: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """CSV with header, down to some columns."""
    frame = spark.read.schema(schema).options(header=True, sep=sep, escape='"').csv(path)
    return frame.select(*columns) if columns else frame


def read_parquet(spark: SparkSession, *paths: str, columns: Sequence[str] = ()) -> DataFrame:
    frame = spark.read.parquet(*paths)
    return frame.select(*columns) if columns else frame


def read_test_queries(spark: SparkSession, path: str | Sequence[str], event_schema: str, parents: dict[str, str],
                      events: str = "query", lines: bool = False) -> DataFrame:
    """Flatten ``[{query: [event, ..], parent: ..}, ..]`` to one row per event.

    A file with one array is read by one task; give many files, or JSON lines
    with ``lines=True``, where that matters.
    """
    fields = ", ".join(f"{n} {t}" for n, t in parents.items())
    schema = f"{events} array<struct<{event_schema}>>" + (f", {fields}" if fields else "")
    frame = spark.read.schema(schema).option("multiLine", not lines).json(path)
    rows = frame.select(*parents, F.posexplode(events).alias("place", "_e"))
    return rows.select(*parents, "place", "_e.*")


def parse_list(c: Column, element: str = "string") -> Column:
    """A printed list ("['a', 'b']") to an array; null stays null."""
    return F.from_json(F.translate(c, "'", '"'), f"array<{element}>")
