"""Windows over ordered groups that stay parallel when one group is huge.

A plain window puts every row of a group into one task. That is the right plan
while groups are of ordinary size. For a *hot* group (more rows than
``hot_rows``) the rows are range-partitioned by (keys, order) instead, each
part is windowed on its own, and what a part needs from the parts before it
(row counts, running aggregates, its neighbours' edge rows) is carried over by
a table with one line per part and group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.runtime import cut_lineage, is_small, stored

HOT_ROWS = 4_000_000
SAMPLED = 4_000
MANY_GROUPS = 100_000
"""A carry table of at most so many lines, edge rows included, is broadcast."""
PART_ROWS = 2_000_000
"""Rows of a part when a group is split."""
PART, LOCAL, PLACE = "_ow_part", "_ow_local", "_ow_place"


@dataclass(frozen=True)
class Number:
    """1-based position in the group."""


@dataclass(frozen=True)
class Shift:
    """Value of the row ``step`` rows earlier (later when negative)."""

    column: str
    step: int = 1


@dataclass(frozen=True)
class Running:
    """sum, max or min from the group's first row to this one.

    With ``later=True`` from this row to the group's last one. With
    ``before=True`` the row itself is left out.
    """

    how: str
    column: str
    before: bool = False
    later: bool = False

    def over(self, window):
        """The rows of an ordered window that it takes."""
        own = 1 if self.before else 0
        if self.later:
            return window.rowsBetween(own, Window.unboundedFollowing)
        return window.rowsBetween(Window.unboundedPreceding, -own)


Spec = Number | Shift | Running
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _as_columns(order: Sequence) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """Keys of groups of about ``hot_rows`` rows or more.

    Large sizes are told from a sample that would hold some thousand rows of
    such a group. Which side a borderline group falls on changes the plan,
    never the result. The table has about rows / hot_rows lines at most.
    """
    share = min(1.0, SAMPLED / hot_rows)
    rows = df.select(*keys)
    rows = rows.sample(fraction=share, seed=1) if share < 1 else rows
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.filter(F.col("_n") > hot_rows * share).drop("_n")


def ordered_windows(df: DataFrame, keys: Sequence[str], order: Sequence, specs: dict[str, Spec],
                    hot_rows: int | None = None) -> DataFrame:
    """Add one column per spec. ``order`` must be total within a group.

    Without keys the whole table is one group. ``hot_rows`` overrides the
    size from which a group is split; by default small plans skip the check.
    """
    order = _as_columns(order)
    if hot_rows is None and is_small(df):
        return _plain(df, keys, order, specs)
    limit = HOT_ROWS if hot_rows is None else hot_rows
    if not keys:
        return _in_parts(df, keys, order, specs, groups=1)
    hot = cut_lineage(hot_groups(df, keys, limit))
    n_hot = hot.count()
    if n_hot == 0:
        return _plain(df, keys, order, specs)
    # Told apart without moving rows by the very keys that are hot.
    marked = F.broadcast(hot) if n_hot <= MANY_GROUPS else hot
    match = null_safe(df, hot, keys)
    cold = _plain(df.join(marked, match, "left_anti"), keys, order, specs)
    split = _in_parts(df.join(marked, match, "left_semi"), keys, order, specs, groups=n_hot)
    return cold.unionByName(split)


def _plain(df, keys, order, specs) -> DataFrame:
    base = Window.partitionBy(*keys).orderBy(*order)
    out = {}
    for name, spec in specs.items():
        if isinstance(spec, Number):
            out[name] = F.row_number().over(base).cast("long")
        elif isinstance(spec, Shift):
            out[name] = F.lag(spec.column, spec.step).over(base)
        else:
            out[name] = _AGG[spec.how](spec.column).over(spec.over(base))
    return df.withColumns(out)


def part_count(df: DataFrame) -> int:
    """A part for every ``PART_ROWS`` counted rows, and one for each shuffle partition at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-df.select(F.lit(1)).count() // PART_ROWS))


def range_parts(df: DataFrame, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """Range-partition by ``order``, tag rows with their part and their place
    in it, and pin the result.

    The cut points come from a sample, so the tagged rows are checkpointed:
    every later read, also after a lost executor, sees the same parts.
    """
    ranged = df.repartitionByRange(parts or part_count(df), *order).sortWithinPartitions(*order)
    return cut_lineage(ranged.withColumns({PART: F.spark_partition_id(), PLACE: F.monotonically_increasing_id()}))


def _in_parts(df, keys, order, specs, groups: int) -> DataFrame:
    """Window every part on its own and carry over what comes before it.

    The carry table has one line per part and group: rows and running
    aggregates of the earlier (or later) parts, and the rows of other parts within reach
    of a shift, by position. All specs take one join of the rows with it; it is
    broadcast if the number of ``groups`` says that it is small.
    """
    key_columns = [F.col(k) for k in keys]
    parts = part_count(df)
    tagged = range_parts(df, [*key_columns, *order], parts)
    group = [PART, *keys]
    shifts = {n: s for n, s in specs.items() if isinstance(s, Shift)}
    running = {n: s for n, s in specs.items() if isinstance(s, Running)}
    reach = max([abs(s.step) for s in shifts.values()], default=0)

    sums = [F.count(F.lit(1)).alias("_ow_rows"), F.min(PLACE).alias("_ow_first")]
    sums += [_AGG[s.how](s.column).alias(f"_ow_sum_{n}") for n, s in running.items()]
    by_part = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(PART)
    earlier, later = by_part.rowsBetween(Window.unboundedPreceding, -1), by_part.rowsBetween(1, Window.unboundedFollowing)
    carried = {"_ow_before": F.coalesce(F.sum("_ow_rows").over(earlier), F.lit(0).cast("long"))}
    carried |= {f"_ow_carry_{n}": _AGG[s.how](f"_ow_sum_{n}").over(later if s.later else earlier) for n, s in running.items()}
    per_part = tagged.groupBy(*group).agg(*sums)
    carry = per_part.withColumns(carried).select(*group, "_ow_rows", "_ow_first", *carried)

    small = (parts + groups) * max(1, 2 * reach) <= MANY_GROUPS
    if shifts:
        carry = cut_lineage(_with_edges(tagged, carry, group, keys, shifts, reach, small))

    inside = Window.partitionBy(*group).orderBy(PLACE)
    local = {n: F.lag(s.column, s.step).over(inside) for n, s in shifts.items()}
    for name, spec in running.items():
        local[name] = _AGG[spec.how](spec.column).over(spec.over(inside))
    # Places of a part's group are consecutive, so positions need no window.
    rows = tagged.withColumns(local) if local else tagged
    joined = _carried(rows, carry, group, small)
    joined = joined.withColumn(LOCAL, F.col(PLACE) - F.col("_ow_first") + 1)

    finished = {}
    position = (F.col("_ow_before") + F.col(LOCAL)).cast("long")
    for name, spec in specs.items():
        if isinstance(spec, Number):
            finished[name] = position
        elif isinstance(spec, Running):
            mine, before = F.col(name), F.col(f"_ow_carry_{name}")
            if spec.how == "sum":
                finished[name] = F.coalesce(mine + before, mine, before)
            else:
                pick = F.greatest if spec.how == "max" else F.least
                finished[name] = pick(mine, before)
        else:
            outside = F.col(LOCAL) <= spec.step if spec.step > 0 else F.col(LOCAL) > F.col("_ow_rows") + spec.step
            edge = F.try_element_at("_ow_edges", position - spec.step)[name]
            finished[name] = F.when(outside, edge).otherwise(F.col(name))
    helpers = [PART, PLACE, LOCAL, "_ow_rows", "_ow_first", *carried, *(["_ow_edges"] if shifts else [])]
    return joined.withColumns(finished).drop(*helpers)


def _carried(rows, carry, group, small: bool) -> DataFrame:
    lines = carry.withColumnsRenamed({k: f"_g{i}" for i, k in enumerate(group)})
    match = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(lines[f"_g{i}"]) for i, k in enumerate(group)])
    joined = rows.join(F.broadcast(lines) if small else lines, match)
    return joined.drop(*[f"_g{i}" for i in range(len(group))])


def _with_edges(tagged, carry, group, keys, shifts, reach: int, small: bool) -> DataFrame:
    """The carry table with a map of the rows up to ``reach`` positions before and after each part's."""
    values = F.struct(*[F.col(s.column).alias(n) for n, s in shifts.items()])
    ends = _carried(tagged, carry, group, small).withColumn(LOCAL, F.col(PLACE) - F.col("_ow_first") + 1)
    near = (F.col(LOCAL) <= reach) | (F.col(LOCAL) > F.col("_ow_rows") - reach)
    edges = ends.filter(near).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_ow_before") + F.col(LOCAL)).alias("_ow_at"), values.alias("_ow_values"))
    first, last = F.col("_ow_before") + 1, F.col("_ow_before") + F.col("_ow_rows")
    span = F.lit(reach).cast("long")
    wanted = carry.select(*group, F.explode(F.concat(F.sequence(first - span, first - 1), F.sequence(last + 1, last + span))).alias("_ow_want"))
    match = wanted["_ow_want"] == edges["_ow_at"]
    for i, k in enumerate(keys):
        match = match & wanted[k].eqNullSafe(edges[f"_k{i}"])
    found = wanted.join(edges, match).groupBy(*group).agg(
        F.map_from_entries(F.collect_list(F.struct("_ow_want", "_ow_values"))).alias("_ow_edges"))
    named = found.withColumnsRenamed({k: f"_g{i}" for i, k in enumerate(group)})
    same = reduce(lambda a, b: a & b, [carry[k].eqNullSafe(named[f"_g{i}"]) for i, k in enumerate(group)])
    return carry.join(named, same, "left").drop(*[f"_g{i}" for i in range(len(group))])


def number_rows(df: DataFrame, order: Sequence, name: str = "row_id", start: int = 0,
                hot_rows: int | None = None) -> DataFrame:
    """Dense global row number from ``start`` in the given total order."""
    numbered = ordered_windows(df, [], order, {name: Number()}, hot_rows)
    return numbered.withColumn(name, F.col(name) - 1 + start)


def with_group(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Group aggregates attached to every row of their group.

    Aggregate first, join after: partial aggregation absorbs hot groups, and
    the join either broadcasts the small side or may split a skewed partition.
    """
    totals = stored(df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]), df)
    renamed = totals.withColumnsRenamed({k: f"_g{i}" for i, k in enumerate(keys)})
    match = reduce(
        lambda a, b: a & b,
        [df[k].eqNullSafe(renamed[f"_g{i}"]) for i, k in enumerate(keys)],
    )
    return df.join(renamed, match, "left").drop(*[f"_g{i}" for i in range(len(keys))])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int,
          rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1.

    The rank filter lets Spark keep only k rows per group and task before the
    shuffle, so a hot group never travels whole. Spark does so up to a limit of
    its own; beyond it ranks are given by the windows that split hot groups.
    """
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return ordered_windows(df, keys, order, {rank: Number()}).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("int"))
    spec = Window.partitionBy(*keys).orderBy(*_as_columns(order))
    return df.withColumn(rank, F.row_number().over(spec)).filter(F.col(rank) <= k)


def small_map(frame: DataFrame, key: str, value: Column) -> Column:
    """A table with few keys by nature (folds, splits, buckets) as a map
    column: a scalar subquery, so big tables look it up without a shuffle."""
    entries = F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))
    return frame.filter(F.col(key).isNotNull()).agg(F.map_from_entries(entries).alias("m")).scalar()


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence, last: bool = False) -> DataFrame:
    """One row per group: the first (or last) by ``order``, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*rest), F.struct(*_as_columns(order))).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def ordered_list(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str],
                 suffix: str = "_list", extra: Sequence[Column] = ()) -> DataFrame:
    """Collect columns into lists sorted by ``order``.

    For input whose groups are bounded already (see ``top_k``, ``chunk_lists``).
    """
    packed = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    lists = [F.col("_items")[c].alias(c + suffix) for c in columns]
    grouped = df.groupBy(*keys).agg(packed.alias("_items"), *extra)
    kept = [c for c in grouped.columns if c != "_items"]
    return grouped.select(*kept, *lists)
