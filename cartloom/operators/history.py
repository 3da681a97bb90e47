"""What an entity did before: lags, gaps, favourites and stable periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.operators.joins import attach
from cartloom.operators.ordered import Shift, ordered_windows, with_group
from cartloom.runtime import stored

FIFTEEN_DAYS = 15 * 86400


def lags(df: DataFrame, keys: Sequence[str], order: Sequence, column: str, steps: Sequence[int], fill=None,
         hot_rows: int | None = None) -> DataFrame:
    """``<column>_lag<i>`` for each step; ``fill`` where there is no such row."""
    specs = {f"{column}_lag{i}": Shift(column, i) for i in steps}
    out = ordered_windows(df, keys, order, specs, hot_rows)
    return out if fill is None else out.fillna(fill, list(specs))


def neighbour_gaps(df: DataFrame, keys: Sequence[str], order: Sequence, seconds: str, missing: int = FIFTEEN_DAYS,
                   hot_rows: int | None = None) -> DataFrame:
    """Seconds since the previous and until the next row of the entity."""
    specs = {"since_prev": Shift(seconds, 1), "until_next": Shift(seconds, -1)}
    moved = ordered_windows(df, keys, order, specs, hot_rows)
    gap = lambda c: F.coalesce(F.abs(F.col(seconds) - F.col(c)), F.lit(missing))
    return moved.withColumns({c: gap(c) for c in specs})


def stay_gaps(df: DataFrame, keys: Sequence[str], order: Sequence, start: str, end: str, out: str = "lapse",
              missing: int = -1, hot_rows: int | None = None) -> DataFrame:
    """Days between the previous row's end and this row's start."""
    moved = ordered_windows(df, keys, order, {"_prev_end": Shift(end, 1)}, hot_rows)
    days = F.coalesce(F.datediff(F.col(start), F.col("_prev_end")), F.lit(missing))
    return moved.withColumn(out, days).drop("_prev_end")


def group_ends(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First and last value of each column in its group, on every row."""
    at = F.struct(*order)
    made = {f"first_{c}": F.min_by(c, at) for c in columns} | {f"last_{c}": F.max_by(c, at) for c in columns}
    return with_group(df, keys, **made)


def group_span(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str,
               out: str = "span_days") -> DataFrame:
    """Days from the group's first start to its last end; where that comes out
    negative (a sequence told backwards) the other two ends are used."""
    at = F.struct(*order)
    ends = with_group(df, keys, _s0=F.min_by(start, at), _e1=F.max_by(end, at), _s1=F.max_by(start, at), _e0=F.min_by(end, at))
    forward, backward = F.datediff("_e1", "_s0"), F.datediff("_e0", "_s1")
    return ends.withColumn(out, F.when(forward >= 0, forward).otherwise(backward)).drop("_s0", "_e1", "_s1", "_e0")


def favourite(df: DataFrame, entity: str, value: str, out: str, support: int = 0, ignore=None) -> DataFrame:
    """Each entity's most frequent value, if it occurs more than ``support``
    times; the smaller value wins a tie."""
    rows = df.filter(F.col(value).isNotNull())
    if ignore is not None:
        rows = rows.filter(F.col(value) != ignore)
    counts = rows.groupBy(entity, value).agg(F.count(F.lit(1)).alias("_n"))
    if support:
        counts = counts.filter(F.col("_n") > support)
    best = F.min_by(value, F.struct(-F.col("_n"), F.col(value)))
    return counts.groupBy(entity).agg(best.alias(out))


def favourite_flags(df: DataFrame, favourites: DataFrame, entity: str, fav: str, values: Sequence[str],
                    name: str, fav_key: str | None = None) -> DataFrame:
    """same / diff / unknown flags of the row's value(s) against the favourite."""
    joined = attach(df, stored(favourites, df), {entity: fav_key or entity})
    hit = None
    for v in values:
        one = F.coalesce(F.col(v) == F.col(fav), F.lit(False))
        hit = one if hit is None else hit | one
    known = F.col(fav).isNotNull()
    return joined.withColumns({
        f"same_{name}": (known & hit).cast("int"),
        f"diff_{name}": (known & ~hit).cast("int"),
        f"unknown_{name}": (~known).cast("int"),
    })


def union_columns(df: DataFrame, entity: str, columns: Sequence[str], value: str, row: str) -> DataFrame:
    """Distinct (entity, value, row) over several columns."""
    return df.select(entity, row, F.explode(F.array(*columns)).alias(value)).distinct()


def authored_count(df: DataFrame, reader: str, author: str, item: str, out: str) -> DataFrame:
    """Number of distinct items the reader of a row has authored."""
    counts = df.groupBy(F.col(author).alias("_a")).agg(F.countDistinct(item).alias(out))
    return attach(df, stored(counts, df), {reader: "_a"}, {out: 0})


def stable_flag(df: DataFrame, entity: Sequence[str], values: Sequence[str], at: str, out: str) -> DataFrame:
    """1 while the entity shows the values it kept longest, 0 otherwise, -1
    for values seen at a single moment."""
    spans = df.groupBy(*entity, *values).agg((F.max(at) - F.min(at)).alias("_span"))
    longest = spans.groupBy(*entity).agg(F.max("_span").alias("_most"))
    flags = spans.join(longest, list(entity)).select(
        *entity, *values,
        F.when(F.col("_span") == 0, -1).otherwise((F.col("_span") == F.col("_most")).cast("int")).alias(out),
    )
    return attach(df, stored(flags, df), [*entity, *values])


def modal_flag(df: DataFrame, entity: Sequence[str], values: Sequence[str], out: str) -> DataFrame:
    """1 for the entity's most frequent values, -1 for values seen once."""
    counts = df.groupBy(*entity, *values).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.groupBy(*entity).agg(F.max("_n").alias("_most"))
    flags = counts.join(most, list(entity)).select(
        *entity, *values,
        F.when(F.col("_n") <= 1, -1).otherwise((F.col("_n") == F.col("_most")).cast("int")).alias(out),
    )
    return attach(df, stored(flags, df), [*entity, *values])


def latest_attributes(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str],
                      prefix: str = "latest_") -> DataFrame:
    """The entity's last known attribute values on every row."""
    at = F.struct(*order)
    return with_group(df, [entity], **{prefix + c: F.max_by(c, at) for c in columns})


def elapsed(start: Column, *ends: Column) -> Column:
    """From start to the earliest present end; null when there is none."""
    earliest = F.least(*ends) if len(ends) > 1 else ends[0]
    return earliest - start


def repeat_counts(df: DataFrame, key_sets: dict[str, Sequence[str]]) -> DataFrame:
    """Rows sharing each key set, on every row."""
    for name, keys in key_sets.items():
        df = with_group(df, keys, **{name: F.count(F.lit(1))})
    return df


def repeat_rate(df: DataFrame, keys: Sequence[str], order: Sequence, item: str, hot_rows: int | None = None) -> DataFrame:
    """Per group, the share of rows that repeat the item of the row before."""
    moved = ordered_windows(df, keys, order, {"_prev": Shift(item, 1)}, hot_rows)
    again = F.coalesce((F.col("_prev") == F.col(item)).cast("int"), F.lit(0))
    return moved.groupBy(*keys).agg(F.avg(again).alias("repeat_rate"), F.count(F.lit(1)).alias("n"))


def session_gaps(df: DataFrame, user: str, session: str, at: str, hot_rows: int | None = None) -> DataFrame:
    """Per session but a user's first: seconds since the session before ended.

    Full elapsed seconds; hours and days derive from them.
    """
    sessions = df.groupBy(user, session).agg(F.min(at).alias("start"), F.max(at).alias("end"))
    moved = ordered_windows(sessions, [user], ["start", session], {"_prev": Shift("end", 1)}, hot_rows)
    gap = F.col("start") - F.col("_prev")
    return moved.filter(F.col("_prev").isNotNull()).select(
        user, session, gap.alias("gap_seconds"), (gap / 3600).alias("gap_hours"), F.floor(gap / 86400).alias("gap_days"))
