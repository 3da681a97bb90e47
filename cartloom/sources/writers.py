"""Writers: plain, partitioned and submission formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.operators.ordered import ordered_list, top_k


def write_parquet(df: DataFrame, path: str, rows_per_file: int | None = None, block_bytes: int | None = None,
                  rows_per_group: int | None = None) -> None:
    """One Parquet folder, with bounded files or row groups when asked."""
    writer = df.write.mode("overwrite")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if block_bytes:
        writer = writer.option("parquet.block.size", block_bytes)
    if rows_per_group:
        writer = writer.option("parquet.block.row.count.limit", rows_per_group)
    writer.parquet(path)


def write_parts(df: DataFrame, path: str, keys: Sequence[str], parts: int = 40, part: str = "part") -> None:
    """Parquet in ``parts`` folders by hash of the keys.

    The rebalance hint gathers a folder's rows into files of the advisory
    size: a big folder is split over tasks, small ones share a task, and the
    number of files does not grow with tasks times folders.
    """
    placed = df.withColumn(part, F.pmod(F.xxhash64(*keys), F.lit(parts)))
    placed.hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(path)


def write_splits(df: DataFrame, path: str, by: Sequence[str] = ("split", "fold")) -> None:
    """Parquet in one folder per split value, in files of the advisory size."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_submissions(df: DataFrame, path: str, keys: Sequence[str], labels: Sequence[str]) -> None:
    """One headerless CSV folder per label: keys and score."""
    for label in labels:
        df.select(*keys, label).write.mode("overwrite").csv(f"{path}/{label}", header=False)


def zero_submission(df: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """The keys with an all-zero score per label."""
    return df.select(*keys, *[F.lit(0.0).alias(x) for x in labels])


def label_records(df: DataFrame, keys: Sequence[str], order: Sequence[str], item: str, most: int = 20) -> DataFrame:
    """Per session its first ``most`` items as one list."""
    kept = top_k(df, keys, list(order), most, "_at")
    return ordered_list(kept, keys, "_at", [item]).withColumnRenamed(f"{item}_list", "label")


def write_label_records(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], item: str, most: int = 20) -> None:
    label_records(df, keys, order, item, most).write.mode("overwrite").json(path)
