"""Group statistics, flags and frequency curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.operators.ordered import Running, ordered_windows, with_group

QUANTILES = {"min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}


def summarise(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def histogram(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def kind_flags(df: DataFrame, keys: Sequence[str], kind: str, kinds: dict[str, str],
               count: str = "n_interactions") -> DataFrame:
    """Per group: a 0/1 flag for each kind of event seen, and the row count."""
    flags = [F.max((F.col(kind) == value).cast("int")).alias(name) for name, value in kinds.items()]
    return df.groupBy(*keys).agg(*flags, F.count(F.lit(1)).alias(count))


def two_level_means(df: DataFrame, coarse: str, fine: Sequence[str], value: str) -> DataFrame:
    """Item table with mean value of its main and of its full category."""
    first = with_group(df, [coarse], mean_main=F.avg(value))
    return with_group(first, list(fine), mean_full=F.avg(value))


def first_seen(df: DataFrame, key: str, at: str, name: str = "first_at") -> DataFrame:
    return df.groupBy(key).agg(F.min(at).alias(name))


def element_frequency(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.select(F.explode(column).alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias(name))


def one_row(frame: DataFrame) -> Column:
    """A one-row table as a struct column: one scalar subquery, run once
    however many of its fields are used."""
    return frame.select(F.struct("*")).scalar()


def _interpolated(value: Column, upto: Column, total: Column, p: float) -> Column:
    """Aggregate over running counts: the interpolated percentile ``p``."""
    at = (total - 1) * F.lit(float(p))
    low = F.min(F.when(upto > F.floor(at), value))
    high = F.min(F.when(upto > F.ceil(at), value))
    return low + (high - low) * F.max(at - F.floor(at))


def percentiles(df: DataFrame, column: str, points: Sequence[float], by: Sequence[str] = (),
                hot_rows: int | None = None) -> DataFrame:
    """Exact interpolated percentiles as a list ``q``, per group when asked.

    Values merge into counts, a running count orders them, and each point
    picks its two neighbours; the distinct values never meet in one buffer.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    steps = ordered_windows(counts, list(by), [column], {"_upto": Running("sum", "_n")}, hot_rows)
    if by:
        steps = with_group(steps, list(by), _total=F.sum("_n"))
    else:
        steps = steps.withColumn("_total", df.select(F.count(column)).scalar())
    value = F.col(column).cast("double")
    return steps.groupBy(*by).agg(
        F.array(*[_interpolated(value, F.col("_upto"), F.col("_total"), p) for p in points]).alias("q"))


def percentile_row(df: DataFrame, column: str, exact: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Named quantiles in one row (or one per group), exact or by sketch."""
    points = list(QUANTILES.values())
    if exact:
        row = percentiles(df, column, points, by)
    else:
        row = df.groupBy(*by).agg(F.percentile_approx(column, points, 100000).alias("q"))
    return row.select(*by, *[F.col("q")[i].cast("double").alias(n) for i, n in enumerate(QUANTILES)])


def frequencies(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur how often: freq, n_keys. Small whatever the input."""
    return histogram(df, [key], "freq").groupBy("freq").agg(F.count(F.lit(1)).alias("n_keys"))


def _gini(m: Column, upto: Column, x: Column) -> Column:
    """Aggregate over frequency steps. With frequencies ascending and 1-based
    ranks i the index is sum((2 i - n - 1) x) / (n sum x); the m keys of one
    step have ranks adding up to m * (2 * before + m + 1) / 2."""
    ranks = m * (2 * (upto - m) + m + 1) / 2
    n, total = F.sum(m), F.sum(m * x)
    return (2 * F.sum(ranks * x) - (n + 1) * total) / (n * total)


def gini(df: DataFrame, key: str) -> DataFrame:
    """Gini index of key frequencies, from the compressed histogram."""
    bins = ordered_windows(frequencies(df, key), [], ["freq"], {"_upto": Running("sum", "n_keys")})
    m, x = F.col("n_keys"), F.col("freq")
    return bins.agg(F.sum(m).alias("n_keys"), F.sum(m * x).alias("n_rows"), _gini(m, F.col("_upto"), x).alias("gini"))


def share_curve(df: DataFrame, key: str) -> DataFrame:
    """Top share of keys against their share of rows, one line per frequency."""
    bins = frequencies(df, key).withColumn("_volume", F.col("freq") * F.col("n_keys"))
    totals = one_row(bins.agg(F.sum("n_keys").alias("k"), F.sum("_volume").alias("r")))
    running = ordered_windows(
        bins, [], [F.desc("freq")], {"cum_keys": Running("sum", "n_keys"), "cum_rows": Running("sum", "_volume")}
    )
    return running.select(
        "freq", "n_keys",
        (F.col("cum_keys") / totals["k"]).alias("key_share"),
        (F.col("cum_rows") / totals["r"]).alias("row_share"),
    )


def _top_share(m: Column, before: Column, x: Column, keys: Column, share: float) -> Column:
    """Aggregate over frequency steps: rows held by the first share of keys.

    Within the step that crosses the share the keys are interchangeable, so
    the part of the step up to it counts.
    """
    taken = F.greatest(F.lit(0), F.least(m, F.floor(keys * share) - before))
    return F.sum(taken * x) / F.sum(m * x)


def top_shares(df: DataFrame, key: str, shares: Sequence[float]) -> DataFrame:
    """Share of rows held by the most frequent x of keys, for several x."""
    bins = frequencies(df, key)
    running = ordered_windows(bins, [], [F.desc("freq")], {"_upto": Running("sum", "n_keys")})
    m, x = F.col("n_keys"), F.col("freq")
    steps = running.withColumn("_k", bins.select(F.sum("n_keys")).scalar())
    return steps.agg(*[_top_share(m, F.col("_upto") - m, x, F.col("_k"), s).alias(f"top_{int(s * 1000)}") for s in shares])


def frequency_summary(df: DataFrame, key: str, shares: Sequence[float]) -> DataFrame:
    """Percentiles, Gini index and top shares of key frequencies in one row,
    all from one ordered pass over the histogram."""
    bins = frequencies(df, key)
    running = ordered_windows(bins, [], ["freq"], {"_upto": Running("sum", "n_keys")})
    steps = running.withColumn("_k", bins.select(F.sum("n_keys")).scalar())
    m, x, upto, n = F.col("n_keys"), F.col("freq"), F.col("_upto"), F.col("_k")
    return steps.agg(
        *[_interpolated(x.cast("double"), upto, n, p).alias(name) for name, p in QUANTILES.items()],
        _gini(m, upto, x).alias("gini"),
        *[_top_share(m, n - upto, x, n, s).alias(f"top_{int(s * 1000)}") for s in shares],
    )


def bucket_distribution(df: DataFrame, bucket: str, split: str, splits: Sequence[str]) -> DataFrame:
    """Share of each bucket within each split, one column per split."""
    wide = df.groupBy(bucket).pivot(split, list(splits)).agg(F.count(F.lit(1)))
    totals = one_row(df.groupBy().agg(*[F.count_if(F.col(split) == s).alias(s) for s in splits]))
    return wide.select(
        bucket,
        *[F.try_divide(F.coalesce(F.col(s), F.lit(0)), totals[s]).alias(f"share_{s}") for s in splits],
    )
