"""Daily aggregates kept in a folder: a day is added or replaced, and longer periods are merged from days."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartloom.functions import timeparts as D
from cartloom.operators.joins import attach

THETA_LOG_K, KLL_K = 14, 1024
"""Sizes of the sketches: at most 2^14 hashes (128 KB) for distinct keys, some 10 KB for a distribution."""


class DayStore:
    """One table of aggregates per day, in versions that one writer adds.

    ``put`` writes the aggregates of its days beside the older ones and then
    publishes a listing, in a single file, of the version that holds each day.
    What a failure left behind unpublished is never read and is overwritten by
    the next attempt, and a day put again is replaced, not doubled. Listings of
    older versions stay readable.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def version(self) -> int:
        """Number of the latest published version, 0 for none."""
        try:
            return self._listings().agg(F.coalesce(F.max("version"), F.lit(0)).cast("long")).first()[0]
        except AnalysisException as missing:
            if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return 0
            raise

    def _listings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/listing")

    def put(self, aggregates: DataFrame, days: Iterable[int] | None = None) -> int:
        """Add aggregates with an integer ``day``; returns the new version.

        ``days`` are the days that are replaced, also those that have no rows
        any more; by default the days that have rows. Their number is that of a
        calendar. Rows of null day belong to no day and are an error.
        """
        now = self.version()
        day = F.coalesce(F.col("day").cast("int"), F.raise_error(F.lit("a row without a day")).cast("int"))
        # Rebalancing sizes the files: a large day is split, small ones are not.
        (aggregates.withColumn("day", day).hint("rebalance", "day").write.mode("overwrite")
         .option("partitionOverwriteMode", "static").partitionBy("day").parquet(f"{self.path}/days/version={now + 1}"))
        schema = aggregates.withColumn("day", F.lit(0)).schema
        written = self.spark.read.schema(schema).parquet(f"{self.path}/days/version={now + 1}").select("day").distinct()
        if days is None:
            replaced = written
        else:
            replaced = self.spark.createDataFrame([(int(d),) for d in days], "day int")
            stray = written.join(replaced, "day", "left_anti").count()
            if stray:
                raise ValueError(f"{stray} days beyond those named")
        # The line without a day makes a version known that holds no day at all.
        marker = self.spark.createDataFrame([(None, now + 1)], "day int, held_in int")
        listing = written.select("day", F.lit(now + 1).alias("held_in")).unionByName(marker)
        if now:
            listing = listing.unionByName(self.listing(now).join(replaced, "day", "left_anti"))
        listing.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/listing/version={now + 1}")
        return now + 1

    def listing(self, version: int) -> DataFrame:
        """(day, held_in): the version whose files hold each day."""
        return self._listings().filter((F.col("version") == version) & F.col("day").isNotNull()).select("day", "held_in")

    def table(self, version: int | None = None) -> DataFrame:
        """The aggregates of all days as of a version, the latest by default."""
        at = self.version() if version is None else version
        if at == 0:
            raise LookupError(f"nothing has been put into {self.path}")
        held = self.listing(at).withColumnRenamed("held_in", "version")
        return self.spark.read.parquet(f"{self.path}/days").join(held, ["version", "day"], "left_semi").drop("version")


# --- sums for target encoding ------------------------------------------------

def daily_sums(rows: DataFrame, keys: Sequence[str], labels: Sequence[str], day: str) -> DataFrame:
    """(keys, day, <label>_sum, <label>_count), to be put into a DayStore."""
    made = [a for label in labels for a in (F.sum(label).alias(f"{label}_sum"), F.count(label).alias(f"{label}_count"))]
    return rows.groupBy(*keys, F.col(day).alias("day")).agg(*made)


def encode_from_days(rows: DataFrame, state: DataFrame, keys: Sequence[str], label: str, day: str, weight: float, out: str) -> DataFrame:
    """Each row by the label's smoothed mean over the stored days before its own.

    The state has a line per key and day, so neither the rows' history nor
    their labels are read. Smoothed towards the mean of all keys on those days;
    keys without history, and rows of null key or day, get null.
    """
    total, count = F.col(f"{label}_sum"), F.col(f"{label}_count")
    held = state.select(*keys, F.col("day").alias("_d"), total.alias("_s"), count.alias("_c"))
    asked = rows.select(*keys, F.col(day).cast("int").alias("_d")).dropna().distinct()
    points = held.unionByName(asked.select("*", F.lit(None).cast(held.schema["_s"].dataType).alias("_s"), F.lit(0).cast("long").alias("_c")))
    past = Window.partitionBy(*keys).orderBy("_d").rangeBetween(Window.unboundedPreceding, -1)
    known = points.groupBy(*keys, "_d").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c")).select(
        *keys, "_d", F.sum("_s").over(past).alias("_hs"), F.sum("_c").over(past).alias("_hc")).filter("_hc > 0")
    # One line per day of the calendar: a single small ordered pass.
    before = Window.partitionBy(F.lit(0)).orderBy("_d").rangeBetween(Window.unboundedPreceding, -1)
    means = points.groupBy("_d").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c")).select(
        "_d", F.try_divide(F.sum("_s").over(before), F.sum("_c").over(before)).alias("_mean"))
    table = known.join(means, "_d").select(*keys, "_d", ((F.col("_hs") + F.col("_mean") * weight) / (F.col("_hc") + weight)).alias(out))
    return attach(rows.withColumn("_at", F.col(day).cast("int")), table, {**{k: k for k in keys}, "_at": "_d"}).drop("_at")


# --- sketches ----------------------------------------------------------------

def daily_sketches(rows: DataFrame, at: str, distinct: Sequence[str] = (), spread: Sequence[str] = (),
                   theta_log_k: int = THETA_LOG_K, kll_k: int = KLL_K) -> DataFrame:
    """(day, n_rows, <column>_theta, <column>_kll): rows, distinct keys and distributions per day, as sketches that merge.

    ``day`` is the number of days since 1970. Sketches are built where the rows
    are and merged, so what moves is one sketch per task and day.
    """
    thetas = [F.theta_sketch_agg(F.col(c), theta_log_k).alias(f"{c}_theta") for c in distinct]
    klls = [F.kll_sketch_agg_double(F.col(c).cast("double"), kll_k).alias(f"{c}_kll") for c in spread]
    return rows.groupBy(F.datediff(at, F.lit("1970-01-01").cast("date")).alias("day")).agg(F.count(F.lit(1)).alias("n_rows"), *thetas, *klls)


_PERIOD = {"day": lambda c: F.date_format(c, "yyyy-MM-dd"), "week": D.year_week, "month": D.year_month, "all": lambda c: F.lit("all")}


def merged_sketches(days: DataFrame, period: str, points: Sequence[float], theta_log_k: int = THETA_LOG_K, kll_k: int = KLL_K) -> DataFrame:
    """Per day, week, month or all: rows, estimated distinct keys (n_<column>) and percentiles (<column>_p50 ..) from the daily sketches alone."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))
    made, shown = [], []
    for c in days.columns:
        if c.endswith("_theta"):
            made.append(F.theta_union_agg(c, theta_log_k).alias(c))
            shown.append(F.theta_sketch_estimate(c).alias(f"n_{c.removesuffix('_theta')}"))
        elif c.endswith("_kll"):
            made.append(F.kll_merge_agg_double(c, kll_k).alias(c))
            name = c.removesuffix("_kll")
            shown += [F.kll_sketch_get_quantile_double(F.col(c), F.lit(float(p))).alias(f"{name}_p{round(p * 100)}") for p in points]
    joined = days.groupBy(_PERIOD[period](date).alias("period")).agg(F.sum("n_rows").alias("n_rows"), *made)
    return joined.select("period", "n_rows", *shown)


def distinct_error(theta_log_k: int = THETA_LOG_K) -> float:
    """Four standard errors of an estimated number of distinct keys, as a share of it; below 2^k keys they are counted exactly."""
    return 4 / (2 ** theta_log_k - 1) ** 0.5


def rank_error(kll_k: int = KLL_K) -> float:
    """Bound of the rank error of a percentile, twice the 99 % one of such a sketch."""
    return 2 * 2.296 / kll_k ** 0.9021
