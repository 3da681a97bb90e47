"""Filters, null handling, narrowing and scaling of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.functions import scalars as S
from cartloom.operators.aggregates import one_row, percentiles
from cartloom.operators.ordered import Running, ordered_windows

INT_TYPES = (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63))


def tag(df: DataFrame, **labels) -> DataFrame:
    """Constant columns naming where a row comes from."""
    return df.withColumns({name: F.lit(value) for name, value in labels.items()})


def keep_groups_with(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Rows of groups that have at least one row meeting the condition."""
    wanted = df.filter(condition).select(*keys).distinct()
    return df.join(wanted, list(keys), "left_semi")


def keep_overlap(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides reduced to the keys they share."""
    return (
        left.join(right.select(key).distinct(), key, "left_semi"),
        right.join(left.select(key).distinct(), key, "left_semi"),
    )


def upper_median(df: DataFrame, column: str) -> Column:
    """sorted[n // 2] of the non-null values, as a scalar subquery.

    Equal values are counted first, so the ordered pass runs over distinct
    values and a frequent value weighs nothing.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    running = ordered_windows(counts, [], [column], {"_upto": Running("sum", "_n")})
    total = df.select(F.count(column)).scalar()
    return running.filter(F.col("_upto") > F.floor(total / 2)).select(F.min(column)).scalar()


def modal_value(df: DataFrame, column: str) -> Column:
    """Most frequent non-null value, the smallest on ties, as a scalar subquery."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.desc("_n"), column).limit(1).select(column).scalar()


def fill_fitted(df: DataFrame, fitted_on: DataFrame, column: str, how: str = "median",
                constant=0, indicator: bool = True) -> DataFrame:
    """Fill nulls by a value learnt from another table, with a ``_na`` flag.

    ``median`` is the upper median, ``middle`` the interpolated one.
    """
    value = {
        "median": lambda: upper_median(fitted_on, column),
        "middle": lambda: percentiles(fitted_on, column, [0.5]).select(F.col("q")[0]).scalar(),
        "mode": lambda: modal_value(fitted_on, column),
        "constant": lambda: F.lit(constant),
    }[how]()
    if indicator:
        df = df.withColumn(f"{column}_na", F.col(column).isNull().cast("int"))
    return df.withColumn(column, F.coalesce(F.col(column), value))


def check_no_new_nulls(fitted_on: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise when a column without nulls at fit time has some now."""
    def nulls(frame):
        return frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()

    before, after = nulls(fitted_on), nulls(df)
    fresh = [c for c in columns if before[c] == 0 and after[c] > 0]
    if fresh:
        raise ValueError(f"columns with new nulls: {fresh}")
    return df


def narrow_integers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest integer type that holds each column's observed range."""
    bounds = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
    ).first()

    def fitting(c):
        low, high = bounds[f"lo_{c}"] or 0, bounds[f"hi_{c}"] or 0
        return next(t for t, bits in INT_TYPES if -(1 << bits) <= low and high < (1 << bits))

    return df.withColumns({c: F.col(c).cast(fitting(c)) for c in columns})


def halve_widths(df: DataFrame) -> DataFrame:
    """64-bit integers and doubles to 32 bits, by declared type."""
    target = {T.LongType(): "int", T.DoubleType(): "float"}
    cast = {
        f.name: F.col(f.name).cast(target[f.dataType])
        for f in df.schema.fields
        if f.dataType in target
    }
    return df.withColumns(cast) if cast else df


def centre(df: DataFrame, column: str, out: str, scale: float = 1.0) -> DataFrame:
    """Distance from the global mean, divided by a constant."""
    mean = df.select(F.avg(column)).scalar()
    return df.withColumn(out, (F.col(column) - mean) / scale)


def fit_moments(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row: mean and sample deviation per named expression."""
    return df.agg(
        *[F.avg(c).alias(f"{n}_mean") for n, c in columns.items()],
        *[F.stddev_samp(c).alias(f"{n}_std") for n, c in columns.items()],
    )


def standardise(df: DataFrame, fitted_on: DataFrame, columns: dict[str, Column],
                epsilon: float = 1e-7) -> DataFrame:
    """(x - mean) / (epsilon + std) with moments learnt from ``fitted_on``."""
    moments = one_row(fit_moments(fitted_on, columns))
    return df.withColumns({
        n: (c - moments[f"{n}_mean"]) / (moments[f"{n}_std"] + epsilon)
        for n, c in columns.items()
    })


def log_standardise(df: DataFrame, fitted_on: DataFrame, columns: dict[str, Column],
                    epsilon: float = 0.0) -> DataFrame:
    return standardise(df, fitted_on, {n: F.log1p(c) for n, c in columns.items()}, epsilon)


def min_max_scale(df: DataFrame, fitted_on: DataFrame, columns: Sequence[str]) -> DataFrame:
    bounds = one_row(fitted_on.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
    ))

    def scaled(c):
        low = bounds[f"lo_{c}"]
        return F.try_divide(F.col(c) - low, bounds[f"hi_{c}"] - low)

    return df.withColumns({c: scaled(c) for c in columns})


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: mean and deviation, raw and log, minimum, maximum."""
    names = ("mean", "std", "log_mean", "log_std", "low", "high")
    made = []
    for c in columns:
        value = F.col(c).cast("double")
        log = F.log1p(F.abs(value))
        made.append(F.array(
            F.avg(value), F.stddev_samp(value), F.avg(log), F.stddev_samp(log), F.min(value), F.max(value)
        ).alias(c))
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns]
    long = df.agg(*made).select(F.explode(F.array(*pairs)).alias("r"))
    return long.select("r.column", *[F.col("r.s")[i].alias(n) for i, n in enumerate(names)])


def recode(df: DataFrame, column: str, codes: dict[str, int], out: str, default: int = 0) -> DataFrame:
    return df.withColumn(out, S.code_of(F.col(column), codes, default))
