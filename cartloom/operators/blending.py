"""Combining the predictions of several models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions import vectors as V
from cartloom.operators.ordered import ordered_list, top_k, with_group
from cartloom.operators.ranking import top_items
from cartloom.runtime import stored


def average_runs(runs: DataFrame, keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Mean of each score over all runs of a key."""
    return runs.groupBy(*keys).agg(*[F.avg(s).alias(s) for s in scores])


def weighted_runs(runs: DataFrame, keys: Sequence[str], model: str, score: str, weights: dict[str, float],
                  missing: float = 0.0) -> DataFrame:
    """Weighted sum of model scores per key (and fold, if in the keys)."""
    pairs = [F.lit(x) for item in weights.items() for x in item]
    weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(model)), F.lit(missing))
    return runs.groupBy(*keys).agg(F.sum(F.col(score) * weight).alias(score))


def convex(first: Column, *steps: tuple[Column, float]) -> Column:
    """Blend in one model after another: (1 - w) * so_far + w * next."""
    for score, weight in steps:
        first = first * (1 - weight) + score * weight
    return first


def equal(*scores: Column) -> Column:
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return total / len(scores)


def blend_top(tables: Sequence[tuple[DataFrame, float]], row: Sequence[str], item: str, score: str, k: int,
              digits: int = 9) -> DataFrame:
    """Weighted sum of sparse top lists, absent items counting 0, best k again.

    Several bags of one model are given as tables with the weight split. Sums
    are rounded before ranking: the order in which a cluster adds them up must
    not decide a tie.
    """
    stacked = None
    for table, weight in tables:
        one = table.select(*row, item, (F.col(score) * weight).alias(score))
        stacked = one if stacked is None else stacked.unionByName(one)
    summed = stacked.groupBy(*row, item).agg(F.round(F.sum(score), digits).alias(score))
    return top_items(summed, row, item, score, k)


def explode_predictions(df: DataFrame, keys: Sequence[str], items: str, logits: str, **source) -> DataFrame:
    """Lists of ids and logits to rows of softmax weights scaled by log2(size).

    An empty list leaves one dummy item 0 of weight 0.
    """
    empty = F.coalesce(F.size(items) == 0, F.lit(True))
    kind = df.schema[items].dataType
    ids = F.when(empty, F.array(F.lit(0)).cast(kind)).otherwise(F.col(items))
    probs = F.when(empty, F.array(F.lit(0.0))).otherwise(V.softmax_by_length(F.col(logits)))
    rows = df.select(*keys, F.posexplode(F.arrays_zip(ids.alias("item"), probs.alias("prob"))).alias("place", "_p"))
    out = rows.select(*keys, "place", "_p.item", "_p.prob")
    return out.withColumns({n: F.lit(v) for n, v in source.items()})


def scale_day(df: DataFrame, day: str, hour: str, score: str, which: int) -> DataFrame:
    """Level one day's scores to its neighbours.

    The factor averages the ratios of mean score across midnight on both sides
    of the day. Where one side has no ratio the other counts alone, and without
    both the scores stay as they are.
    """
    at = lambda d, h: F.avg(F.when((F.col(day) == d) & (F.col(hour) == h), F.col(score)))
    edge = df.agg(at(which - 1, 23).alias("a"), at(which, 0).alias("b"), at(which, 23).alias("c"), at(which + 1, 0).alias("d"))
    left, right = F.try_divide("a", "b"), F.try_divide("d", "c")
    factor = edge.select(F.coalesce(0.5 * left + 0.5 * right, left, right, F.lit(1.0))).scalar()
    return df.withColumn(score, F.when(F.col(day) == which, F.col(score) * factor).otherwise(F.col(score)))


def scale_where(df: DataFrame, condition: Column, score: str, factor: float) -> DataFrame:
    return df.withColumn(score, F.when(condition, F.col(score) * factor).otherwise(F.col(score)))


def votes(runs: DataFrame, keys: Sequence[str], score: str, threshold: float, at_least: int = 2) -> DataFrame:
    """Positive votes of the runs of a key, and the decisions drawn from them."""
    yes = (F.col(score) >= threshold).cast("int")
    counted = runs.groupBy(*keys).agg(
        F.sum(yes).alias("n_yes"), F.count(F.lit(1)).alias("n_runs"), F.avg(score).alias("mean_score"))
    return counted.withColumns({
        "majority": (F.col("n_yes") * 2 > F.col("n_runs")).cast("int"),
        "at_least": (F.col("n_yes") >= at_least).cast("int"),
        "any_yes": (F.col("n_yes") > 0).cast("int"),
        "by_mean": (F.col("mean_score") >= threshold).cast("int"),
    })


def filter_predictions(preds: DataFrame, keys: Sequence[str], item: str, products: DataFrame, seen: DataFrame,
                       banned: Sequence = ()) -> DataFrame:
    """Only products, not in the session already, not among banned ids."""
    kept = preds.join(products.select(item).distinct(), item, "left_semi")
    kept = kept.join(seen.select(*keys, item).distinct(), [*keys, item], "left_anti")
    return kept.filter(~F.col(item).isin(list(banned))) if banned else kept


def softmax_rows(scores: DataFrame, row: Sequence[str], score: str, out: str = "prob") -> DataFrame:
    """Softmax over the rows of each group; the scores are read three times and made once."""
    scores = stored(scores, scores)
    peaked = with_group(scores, row, _peak=F.max(score))
    raised = peaked.withColumn("_e", F.exp(F.col(score) - F.col("_peak")))
    return with_group(raised, row, _sum=F.sum("_e")).withColumn(out, F.col("_e") / F.col("_sum")).drop("_peak", "_e", "_sum")


def average_then_softmax(runs: DataFrame, row: Sequence[str], item: str, score: str) -> DataFrame:
    return softmax_rows(average_runs(runs, [*row, item], [score]), row, score)


def prediction_lists(preds: DataFrame, keys: Sequence[str], item: str, score: str, most: int) -> DataFrame:
    ranked = top_k(preds, keys, [F.desc(score), F.col(item)], most)
    return ordered_list(ranked, keys, "rank", [item, score])
