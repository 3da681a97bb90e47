"""Item vectors from co-occurrence, without a vocabulary on the driver.

Items near each other in a session are counted, counts become positive pointwise
mutual information, and the leading eigenvectors of that symmetric table are
found by subspace iteration: the table times the vectors is a join and a sum, and
the vectors are made orthogonal by a matrix of size x size alone, the only thing
that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.operators.joins import attach
from cartloom.operators.ordered import Shift, ordered_windows
from cartloom.runtime import stored

SMALLEST = 1e-12
"""Of the squared length of a direction, as a share of the largest; a shorter one has died out."""


def cooccurrences(rows: DataFrame, keys: Sequence[str], order: Sequence, item: str, window: int = 5, hot_rows: int | None = None) -> DataFrame:
    """(a, b, n): how often two items stand within ``window`` places of a session, in either order.

    Each pair is counted both ways; an item beside itself counts twice, once for
    each of its two places. Rows of null item take a place but are no partner.
    A session of any length costs each row its ``window`` predecessors.
    """
    before = {f"_before{k}": Shift(item, k) for k in range(1, window + 1)}
    shifted = ordered_windows(rows.select(*keys, *[o for o in order if isinstance(o, str) and o not in keys and o != item], item), keys, order, before, hot_rows)
    partner = F.explode(F.filter(F.array(*before), lambda x: x.isNotNull())).alias("b")
    one_way = shifted.filter(F.col(item).isNotNull()).select(F.col(item).alias("a"), partner).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return both.groupBy("a", "b").agg(F.sum("n").alias("n"))


def association(counts: DataFrame, shift: float = 1.0) -> DataFrame:
    """(a, b, weight): log of n(a, b) n / (n(a) n(b) shift), where that is positive."""
    counts = stored(counts)
    each = stored(counts.groupBy(F.col("a").alias("item")).agg(F.sum("n").alias("all")))
    total = counts.agg(F.sum("n").alias("n")).scalar()
    sized = attach(attach(counts, each.withColumnRenamed("all", "_of_a"), {"a": "item"}, how="inner"), each.withColumnRenamed("all", "_of_b"), {"b": "item"}, how="inner")
    ratio = F.col("n").cast("double") * total.cast("double") / (F.col("_of_a").cast("double") * F.col("_of_b").cast("double") * F.lit(float(shift)))
    return sized.withColumn("weight", F.log(ratio)).filter(F.col("weight") > 0).select("a", "b", "weight")


def _seeded(item: Column, place: int, seed: int) -> Column:
    """A number in [-1, 1) hashed from the item."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(place), item), 11).cast("double") * F.lit(2.0**-52) - 1.0


def _products(table: DataFrame, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Sums of products of columns, one for every two of them."""
    row = table.agg(*[F.sum(F.col(a) * F.col(b)) for a in left for b in right]).first()
    return np.array([x or 0.0 for x in row]).reshape(len(left), len(right))


def _mixed(names: Sequence[str], matrix: np.ndarray) -> list[Column]:
    """Columns times a matrix."""
    return [sum((F.col(c) * float(m) for c, m in zip(names, column)), F.lit(0.0)) for column in matrix.T]


def item_vectors(weights: DataFrame, size: int = 16, rounds: int = 8, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(item, vector) of a symmetric table (a, b, weight), and the eigenvalues found, largest first by size.

    A vector holds the item's place in each eigenvector times the root of the
    eigenvalue's size. With fewer directions than ``size`` the rest are zero.
    Items are those of column a; an empty table gives none.
    """
    names = [f"_v{k}" for k in range(size)]
    weights = stored(weights)
    vectors = stored(weights.select(F.col("a").alias("item")).distinct().select("item", *[_seeded(F.col("item"), k, seed).alias(c) for k, c in enumerate(names)]))

    def multiplied(table: DataFrame) -> DataFrame:
        joined = attach(weights, table, {"b": "item"}, how="inner")
        return stored(joined.groupBy(F.col("a").alias("item")).agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in names]))

    def orthogonal(table: DataFrame) -> DataFrame:
        square, axes = np.linalg.eigh(_products(table, names, names))
        alive = square > SMALLEST * max(square.max(initial=0), 1e-300)
        scale = np.where(alive, 1 / np.sqrt(np.where(alive, square, 1)), 0)
        return table.select("item", *[c.alias(n) for c, n in zip(_mixed(names, axes * scale), names)])

    vectors = orthogonal(vectors)
    for _ in range(rounds):
        vectors = orthogonal(multiplied(vectors))
    # Once more, as one pass leaves errors where lengths differ much.
    vectors = orthogonal(stored(vectors))
    vectors = stored(vectors)
    image = multiplied(vectors).withColumnsRenamed({c: f"{c}_m" for c in names})
    inner = _products(attach(vectors, image, {"item": "item"}, how="inner"), names, [f"{c}_m" for c in names])
    values, axes = np.linalg.eigh((inner + inner.T) / 2)
    largest = np.argsort(-np.abs(values), kind="stable")
    values, axes = values[largest], axes[:, largest]
    turned = _mixed(names, axes * np.sqrt(np.abs(values)))
    return vectors.select("item", F.array(*turned).alias("vector")), values
