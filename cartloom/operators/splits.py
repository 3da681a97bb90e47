"""Splits and folds. Random ones hash a key, so every run agrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.operators.ordered import number_rows


def modulo(c: Column, parts: int) -> Column:
    return F.pmod(c, F.lit(parts))


def before(df: DataFrame, at: str, moment) -> tuple[DataFrame, DataFrame]:
    """Rows before a moment, and from it on."""
    border = F.lit(moment)
    return df.filter(F.col(at) < border), df.filter(F.col(at) >= border)


def time_split(at: Column, valid_from, test_from) -> Column:
    """'train', 'valid' or 'test' by time."""
    as_column = lambda m: m if isinstance(m, Column) else F.lit(m)
    return F.when(at < as_column(valid_from), "train").when(at < as_column(test_from), "valid").otherwise("test")


def weekday_split(at: Column, held_out: Sequence[int]) -> Column:
    return F.when(F.weekday(at).isin(list(held_out)), "valid").otherwise("train")


def id_range(c: Column, sizes: dict[str, int]) -> Column:
    """Split name by known sizes laid end to end over dense ids."""
    start, chain = 0, None
    for name, size in sizes.items():
        hit = (c >= start) & (c < start + size)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
        start += size
    return chain


def hash_fold(keys: Sequence[str], folds: int, seed: int = 0, first: int = 0) -> Column:
    """Fold of an entity by md5 of its key: all its rows stay together."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    point = F.conv(F.right(F.md5(text), F.lit(8)), 16, 10).cast("long")
    return (F.pmod(point, F.lit(folds)) + first).cast("int")


def balanced_group_folds(df: DataFrame, key: str, folds: int, fold: str = "fold") -> DataFrame:
    """Fold per group so that row counts even out.

    Groups are numbered by falling size and dealt out back and forth, which
    needs one pass over the size table and no running totals on the driver.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    placed = number_rows(sizes, [F.desc("n"), key], "_place")
    turn = F.pmod(F.col("_place"), F.lit(2 * folds))
    dealt = F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn)
    return placed.select(key, "n", dealt.cast("int").alias(fold))


def contiguous_folds(df: DataFrame, order: Sequence, folds: int, wrap: bool = False, fold: str = "fold",
                     hot_rows: int | None = None) -> DataFrame:
    """Equal runs of consecutive rows. The remainder joins the last fold, or
    starts over at fold 0 with ``wrap``; fewer rows than folds are a run each."""
    numbered = number_rows(df, order, "_row", hot_rows=hot_rows)
    size = F.greatest(F.lit(1), F.floor(df.select(F.count(F.lit(1))).scalar() / folds))
    run = F.floor(F.col("_row") / size)
    placed = F.pmod(run, F.lit(folds)) if wrap else F.least(run, F.lit(folds - 1))
    return numbered.withColumn(fold, placed.cast("int")).drop("_row")


def running_modulo(df: DataFrame, order: Sequence, folds: int, fold: str = "fold",
                   hot_rows: int | None = None) -> DataFrame:
    """Row number modulo the number of folds."""
    numbered = number_rows(df, order, "_row", hot_rows=hot_rows)
    return numbered.withColumn(fold, F.pmod("_row", F.lit(folds)).cast("int")).drop("_row")


def recent_sessions(day_index: Column, days: int = 50) -> Column:
    """1 for sessions in the last days, by days-before-end index."""
    return (day_index <= days).cast("int")


def hash_split(keys: Sequence[str], train_share: float = 0.8, seed: int = 0) -> Column:
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    point = F.conv(F.right(F.md5(text), F.lit(8)), 16, 10).cast("long")
    return F.when(F.pmod(point, F.lit(10000)) < int(train_share * 10000), "train").otherwise("valid")
