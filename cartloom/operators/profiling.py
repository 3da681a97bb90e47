"""Dataset profile: sizes, frequency curves, ages, cold start, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.functions import timeparts as D
from cartloom.operators.aggregates import frequency_summary, one_row, percentile_row, percentiles
from cartloom.operators.history import session_gaps
from cartloom.operators.joins import missing_ids
from cartloom.operators.ordered import small_map, with_group
from cartloom.runtime import stored

PERIODS = {"day": lambda c: F.date_format(c, "yyyy-MM-dd"), "week": D.year_week, "month": D.year_month}


def sizes(df: DataFrame, user: str, item: str, session: str, at: str) -> DataFrame:
    """One row: range, days, rows, users, items, sessions, pairs, sparsity.

    Distinct counts come from one group-by per id, each with map-side partial
    aggregation, rather than from one expanded multi-distinct aggregate.
    """
    base = df.agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n_rows"))
    count = lambda *cs: df.select(*cs).distinct().agg(F.count(F.lit(1))).scalar()
    out = base.select(
        "n_rows",
        D.seconds(F.col("first_at")).alias("first_second"),
        D.seconds(F.col("last_at")).alias("last_second"),
        F.datediff("last_at", "first_at").alias("n_days"),
        count(user).alias("n_users"), count(item).alias("n_items"),
        count(session).alias("n_sessions"), count(user, item).alias("n_pairs"),
    )
    return out.withColumn("sparsity", 1 - F.try_divide(F.col("n_pairs"), F.col("n_users") * F.col("n_items")))


def frequency_profile(df: DataFrame, key: str) -> DataFrame:
    """Percentiles of key frequencies, Gini index and top shares in one row."""
    return frequency_summary(df, key, (0.01, 0.05, 0.1, 0.25, 0.5))


def repeat_profile(df: DataFrame, user: str, item: str) -> DataFrame:
    """Percentiles of each user's share of repeated interactions."""
    pairs = df.groupBy(user, item).agg(F.count(F.lit(1)).alias("_n"))
    ratios = pairs.groupBy(user).agg(((F.sum("_n") - F.count(F.lit(1))) / F.sum("_n")).alias("ratio"))
    return percentile_row(ratios, "ratio")


def by_period(df: DataFrame, at: str, period: str) -> DataFrame:
    return df.groupBy(PERIODS[period](F.col(at)).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def interaction_ages(df: DataFrame, key: str, at: str) -> DataFrame:
    """Days since the key was first seen, as a histogram."""
    first = with_group(df, [key], _first=F.min(at))
    return first.groupBy(D.age_days(F.col(at), F.col("_first")).alias("age_days")).agg(F.count(F.lit(1)).alias("n"))


def age_percentiles(df: DataFrame, key: str, at: str) -> DataFrame:
    first = with_group(df, [key], _first=F.min(at))
    return percentile_row(first.select(D.age_days(F.col(at), F.col("_first")).alias("age")), "age")


def new_per_period(df: DataFrame, key: str, at: str, period: str) -> DataFrame:
    """Keys first seen per period, and the median without the first period."""
    firsts = df.groupBy(key).agg(F.min(at).alias("_first"))
    counted = firsts.groupBy(PERIODS[period](F.col("_first")).alias("period")).agg(F.count(F.lit(1)).alias("n_new"))
    start = counted.select(F.min("period")).scalar()
    median = counted.filter(F.col("period") > start).select(F.percentile("n_new", 0.5)).scalar()
    return counted.withColumn("median_new", median)


def cold_start(df: DataFrame, key: str, at: str) -> DataFrame:
    """Share of rows on keys first seen in the same day, week or month; the
    rows of the first week are left out."""
    first = with_group(df.select(key, at), [key], _first=F.min(at))
    start = df.select(F.min(D.year_week(F.col(at)))).scalar()
    later = first.filter(D.year_week(F.col(at)) != start)
    same = lambda p: F.avg((PERIODS[p](F.col(at)) == PERIODS[p](F.col("_first"))).cast("int"))
    return later.agg(F.count(F.lit(1)).alias("n"), *[same(p).alias(f"same_{p}") for p in PERIODS])


def session_profile(df: DataFrame, user: str, session: str, seconds: str) -> DataFrame:
    """Percentiles of length, duration, sessions per user and session gaps."""
    sessions = df.groupBy(user, session).agg(
        F.count(F.lit(1)).alias("length"), ((F.max(seconds) - F.min(seconds)) / 60).alias("minutes"))
    per_user = sessions.groupBy(user).agg(F.count(F.lit(1)).alias("sessions"))
    gaps = session_gaps(df, user, session, seconds)
    values = [F.struct(F.lit(n).alias("measure"), F.col(c).cast("double").alias("value")) for n, c in
              (("length", "length"), ("minutes", "minutes"))]
    between = [F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in ("gap_hours", "gap_days")]
    long = (
        sessions.select(F.inline(F.array(*values)))
        .unionByName(per_user.select(F.lit("sessions_per_user").alias("measure"), F.col("sessions").cast("double").alias("value")))
        .unionByName(gaps.select(F.inline(F.array(*between))))
    )
    return percentile_row(long, "value", by=["measure"])


def compare_splits(train: DataFrame, test: DataFrame, session: str, item: str) -> DataFrame:
    """Session-length distribution of both splits, with item coverage."""
    def lengths(df, name):
        return df.groupBy(session).agg(F.count(F.lit(1)).alias("length")).groupBy("length").agg(
            F.count(F.lit(1)).alias("n")).withColumn("split", F.lit(name))

    both = lengths(train, "train").unionByName(lengths(test, "test"))
    totals = small_map(both.groupBy("split").agg(F.sum("n").alias("_t")), "split", F.col("_t"))
    unseen = missing_ids(test, train, item).agg(F.count(F.lit(1))).scalar()
    return both.select(
        "split", "length", "n", (F.col("n") / F.try_element_at(totals, F.col("split"))).alias("share"), unseen.alias("test_only_items"))


def compare_lengths(train: DataFrame, test: DataFrame, session: str, points: Sequence[float]) -> DataFrame:
    """Session-length percentiles of both splits side by side, with their ratio."""
    def at(df):
        lengths = df.groupBy(session).agg(F.count(F.lit(1)).alias("_length"))
        return one_row(percentiles(lengths, "_length", points))["q"]

    both = train.sparkSession.createDataFrame([(list(points),)], "points array<double>").select(
        "points", at(train).alias("a"), at(test).alias("b"))
    rows = both.select(F.explode(F.arrays_zip("points", "a", "b")).alias("r"))
    return rows.select(F.col("r.points").alias("point"), F.col("r.a").alias("train"), F.col("r.b").alias("test"),
                       F.try_divide("r.a", "r.b").alias("ratio"))


def profile_row(df: DataFrame, user: str, item: str, session: str, at: str) -> DataFrame:
    """The whole profile as a single row; the columns it needs are stored once and read from there."""
    df = stored(df.select(*dict.fromkeys([user, item, session, at])))
    row = sizes(df, user, item, session, at)
    extra = {}
    for name, key in (("item", item), ("user", user)):
        part = one_row(frequency_profile(df, key))
        extra |= {f"{name}_{c}": part[c] for c in ("p50", "p90", "max", "gini", "top_100")}
        cold = one_row(cold_start(df, key, at))
        extra |= {f"{name}_{c}": cold[c] for c in ("same_day", "same_week", "same_month")}
    return row.withColumns(extra)

