"""Row identity, order, duplicates and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.operators.ordered import Number, first_row, number_rows, ordered_windows, with_group

__all__ = ["chain_ids", "hash_below", "keep_one", "number_rows", "positions", "reverse_copy",
           "sample_entities", "sample_rows", "shuffle_rank", "without_twins"]


def chain_ids(frames: Sequence[tuple[str, DataFrame]], order: Sequence, name: str = "row_id",
              source: str = "source") -> DataFrame:
    """Dense ids over several tables, each continuing where the last ended."""
    stacked = None
    for place, (label, frame) in enumerate(frames):
        one = frame.withColumn(source, F.lit(label)).withColumn("_place", F.lit(place))
        stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
    return number_rows(stacked, ["_place", *order], name).drop("_place")


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence, last: bool = True) -> DataFrame:
    """Drop duplicates on the keys, keeping the last (or first) by order."""
    return first_row(df, keys, order, last)


def without_twins(df: DataFrame, keys: Sequence[str], kind: Column, order: Sequence) -> DataFrame:
    """Drop rows of one kind that are not the first at their (keys) spot."""
    firsts = F.min(F.struct(*[F.col(o) for o in order])).alias("_first")
    heads = df.groupBy(*keys).agg(firsts)
    mine = F.struct(*[F.col(o) for o in order])
    joined = df.join(heads, list(keys), "left")
    return joined.filter(~kind | (mine == F.col("_first"))).drop("_first").select(*df.columns)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence, hot_rows: int | None = None) -> DataFrame:
    """Position from the start, from the end, and group size: dcount, icount, n."""
    placed = ordered_windows(df, keys, order, {"dcount": Number()}, hot_rows)
    sized = with_group(placed, keys, n=F.count(F.lit(1)))
    at = F.col("dcount") - 1
    return sized.withColumn("dcount", at).withColumn("icount", F.col("n") - F.col("dcount") - 1)


def reverse_copy(df: DataFrame, key: str, forward: str = "dcount", backward: str = "icount",
                 only: Column | None = None, flag: str = "reverse") -> DataFrame:
    """Append every sequence once more, back to front, under a suffixed key."""
    source = df if only is None else df.filter(only)
    copy = source.withColumns({
        forward: F.col(backward),
        backward: F.col(forward),
        key: F.concat(F.col(key).cast("string"), F.lit("_r")),
        flag: F.lit(1),
    })
    original = df.withColumns({key: F.col(key).cast("string"), flag: F.lit(0)})
    return original.unionByName(copy)


def hash_below(keys: Sequence[str], fraction: float, seed: int = 0) -> Column:
    """True for a stable share of key values, the same on every run."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    point = F.conv(F.right(F.md5(text), F.lit(8)), 16, 10).cast("long")
    return point < int(fraction * 2**32)


def sample_rows(df: DataFrame, fraction: float, seed: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """A random share of the rows.

    With keys that tell rows apart their hash decides, so the sample is the same
    however the rows are partitioned; without, position and partition decide.
    """
    return df.filter(hash_below(keys, fraction, seed)) if keys else df.sample(fraction=fraction, seed=seed)


def sample_entities(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 0) -> DataFrame:
    """All rows of a random share of entities.

    The hash decides per entity, so no distinct list and no join are needed.
    """
    return df.filter(hash_below(keys, fraction, seed))


def shuffled(df: DataFrame, key: Sequence[str], seed: int = 0, name: str = "place") -> DataFrame:
    """Every row's place in a random order fixed by its key and the seed."""
    drawn = df.withColumn("_draw", shuffle_rank(key, seed))
    return number_rows(drawn, ["_draw", *key], name).drop("_draw")


def shuffle_rank(keys: Sequence[str], seed: int = 0) -> Column:
    """Pseudo-random sort value of a row, fixed by its key and the seed."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(seed)))
