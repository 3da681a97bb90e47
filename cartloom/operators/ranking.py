"""Top-k selection and the forms a prediction table takes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.operators.ordered import Number, ordered_windows, top_k


def top_items(scores: DataFrame, row: Sequence[str], item: str, score: str, k: int) -> DataFrame:
    """The k best items per row, ties by item."""
    return top_k(scores, row, [F.desc(score), F.col(item)], k)


def top_lists(scores: DataFrame, row: Sequence[str], item: str, score: str, k: int) -> DataFrame:
    """Best items and their scores per row as two lists of at most k."""
    best = top_items(scores, row, item, score, k)
    packed = F.array_sort(F.collect_list(F.struct("rank", item, score))).alias("_p")
    grouped = best.groupBy(*row).agg(packed)
    return grouped.select(*row, F.col(f"_p.{item}").alias("items"), F.col(f"_p.{score}").alias("scores"))


def to_wide(ranked: DataFrame, row: Sequence[str], item: str, score: str, k: int) -> DataFrame:
    """Columns rec0.. and prob0.. from ranked rows (rank from 1)."""
    at = lambda c, i: F.max(F.when(F.col("rank") == i + 1, F.col(c)))
    return ranked.groupBy(*row).agg(
        *[at(item, i).alias(f"rec{i}") for i in range(k)],
        *[at(score, i).alias(f"prob{i}") for i in range(k)],
    )


def to_long(wide: DataFrame, row: Sequence[str], k: int) -> DataFrame:
    """Back to (row, rank, item, score); missing places are dropped."""
    places = F.array(*[
        F.struct(F.lit(i + 1).alias("rank"), F.col(f"rec{i}").alias("item"), F.col(f"prob{i}").alias("score"))
        for i in range(k)
    ])
    long = wide.select(*row, F.explode(places).alias("p"))
    return long.select(*row, "p.*").filter(F.col("item").isNotNull())


def candidate_rank(scores: DataFrame, row: Sequence[str], item: str, score: str,
                   hot_rows: int | None = None) -> DataFrame:
    """Rank of every candidate in its row by score, with its reciprocal."""
    order = [F.desc(score), F.col(item)]
    ranked = ordered_windows(scores, row, order, {"rank": Number()}, hot_rows)
    return ranked.withColumn("reciprocal", 1 / F.col("rank"))


def best_value(value: Column, score: Column) -> Column:
    """Aggregate: the value with the highest score, the smaller one on ties."""
    return F.min_by(value, F.struct(-score, value))
