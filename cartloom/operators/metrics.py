"""Ranking and classification metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.operators.ordered import Running, number_rows, ordered_windows, top_k, with_group
from cartloom.operators.ranking import candidate_rank
from cartloom.operators.rows import shuffle_rank

# Weight per number of events after the first add.
AFTER_ADD_WEIGHTS = {0: 1.0, 2: 0.9, 4: 0.8, 6: 0.7, 8: 0.6, 10: 0.5}
EPSILON = 1e-15


def reciprocal_rank(candidates: DataFrame, row: Sequence[str], item: str, score: str, clicked: Column,
                    hot_rows: int | None = None) -> DataFrame:
    """Mean reciprocal rank of clicked candidates; rows without a hit do not
    enter the mean."""
    ranked = candidate_rank(candidates, row, item, score, hot_rows)
    return ranked.filter(clicked).agg(F.avg("reciprocal").alias("mrr"), F.count(F.lit(1)).alias("n"))


def list_reciprocal(preds: Column, labels: Column, k: int) -> Column:
    """1 / place of the first label among the first k predictions, else 0."""
    place = F.array_position(F.slice(preds, 1, k), F.try_element_at(labels, F.lit(1)))
    return F.coalesce(F.when(place > 0, 1 / place), F.lit(0.0))


def list_f1(preds: Column, labels: Column, k: int) -> dict[str, Column]:
    """Precision over k, recall over distinct labels, and their F1."""
    hits = F.coalesce(F.size(F.array_intersect(F.slice(preds, 1, k), labels)), F.lit(0))
    precision = hits / F.lit(float(k))
    recall = F.when(F.size(labels) > 0, hits / F.size(F.array_distinct(labels))).otherwise(0.0)
    both = precision + recall
    return {"precision": precision, "recall": recall, "f1": F.when(both > 0, 2 * precision * recall / both).otherwise(0.0)}


def session_metrics(df: DataFrame, preds: str, labels: str, k: int = 20) -> DataFrame:
    """Next-item and all-items metrics averaged over sessions."""
    f1 = list_f1(F.col(preds), F.col(labels), k)
    return df.agg(
        F.avg(list_reciprocal(F.col(preds), F.col(labels), k)).alias("mrr"),
        *[F.avg(c).alias(n) for n, c in f1.items()],
    )


def bucket_accuracy(df: DataFrame, bucket: str, prediction: Column, label: str,
                    weights: dict[int, float] = AFTER_ADD_WEIGHTS) -> DataFrame:
    """Accuracy and weight per bucket."""
    pairs = [F.lit(x) for item in weights.items() for x in item]
    hit = (prediction.cast("int") == F.col(label).cast("int")).cast("int")
    scored = df.groupBy(bucket).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return scored.withColumn("weight", F.element_at(F.create_map(*pairs), F.col(bucket).cast("int")))


def weighted_micro_f1(df: DataFrame, bucket: str, prediction: Column, label: str) -> DataFrame:
    """Bucket accuracies times weights, summed and not divided: 0 .. 4.5."""
    scored = bucket_accuracy(df, bucket, prediction, label)
    return scored.agg(F.sum(F.col("accuracy") * F.col("weight")).alias("weighted_f1"))


def threshold_sweep(df: DataFrame, bucket: str, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Weighted micro-F1 for every threshold from one pass over the rows."""
    label_value = F.col(label).cast("int")
    hits = [F.avg(((F.col(score) > t).cast("int") == label_value).cast("int")) for t in thresholds]
    pairs = [F.lit(x) for item in AFTER_ADD_WEIGHTS.items() for x in item]
    scored = df.groupBy(bucket).agg(F.array(*hits).alias("_h"))
    weight = F.element_at(F.create_map(*pairs), F.col(bucket).cast("int"))
    long = scored.select(F.posexplode("_h").alias("_i", "_a"), weight.alias("_w"))
    values = F.array(*[F.lit(float(t)) for t in thresholds])
    return long.groupBy(F.element_at(values, F.col("_i") + 1).alias("threshold")).agg(
        F.sum(F.col("_a") * F.col("_w")).alias("weighted_f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the highest metric."""
    best = F.min_by(F.struct("threshold", "weighted_f1"), F.struct(-F.col("weighted_f1"), F.col("threshold")))
    return sweep.agg(best.alias("b")).select("b.*")


def hit_rate(df: DataFrame, row: Sequence[str], item: str, score: str, target: str, k: int = 4,
             only: Column | None = None) -> DataFrame:
    """Share of rows whose target is among the k best items."""
    rows = df if only is None else df.filter(only)
    best = top_k(rows, row, [F.desc(score), F.col(item)], k)
    hit = F.max((F.col(item) == F.col(target)).cast("int"))
    return best.groupBy(*row).agg(hit.alias("hit")).agg(F.avg("hit").alias(f"precision_at_{k}"), F.count(F.lit(1)).alias("n"))


def relative_cross_entropy(df: DataFrame, score: str, label: str, by: Sequence[str] = (), name: str = "rce") -> DataFrame:
    """(1 - log loss / log loss of the constant rate) * 100.

    Missing scores count as the mean score of the group.
    """
    y = (F.col(label) > 0).cast("double")
    p = F.col(score)
    loss = lambda c: F.when(y > 0, F.ln(c + EPSILON)).otherwise(F.ln(1 - c + EPSILON))
    sums = df.groupBy(*by).agg(
        F.sum(F.when(p.isNotNull(), loss(p))).alias("_l"), F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"),
        F.avg(p).alias("_m"), F.count_if(p.isNull() & (y > 0)).alias("_p"), F.count_if(p.isNull() & (y <= 0)).alias("_q"),
    )
    filled = F.when(F.col("_p") + F.col("_q") > 0,
                    F.col("_p") * F.ln(F.col("_m") + EPSILON) + F.col("_q") * F.ln(1 - F.col("_m") + EPSILON)).otherwise(0.0)
    entropy = -(F.coalesce("_l", F.lit(0.0)) + filled) / F.col("n")
    rate = F.col("rate")
    strawman = -(rate * F.ln(rate) + (1 - rate) * F.ln(1 - rate))
    return sums.select(*by, "n", "rate", ((1 - F.try_divide(entropy, strawman)) * 100).alias(name))


def threshold_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """True and false positives at every distinct score, highest first.

    Equal scores merge before the running sums, so ties cannot matter.
    """
    y = (F.col(label) > 0).cast("long")
    steps = df.groupBy(*by, score).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    return ordered_windows(steps, list(by), [F.desc(score)],
                           {"tp": Running("sum", "pos"), "fp": Running("sum", "neg")}, hot_rows)


def mean_filled(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Scores that are null or not a number replaced by the mean of the others."""
    p = F.col(score).cast("double")
    known = df.withColumn(score, F.when(~F.isnan(p), p))
    if by:
        filled = with_group(known, list(by), _mean=F.avg(score))
        return filled.withColumn(score, F.coalesce(score, "_mean")).drop("_mean")
    return known.withColumn(score, F.coalesce(F.col(score), known.agg(F.avg(score)).scalar()))


def curve_areas(df: DataFrame, score: str, label: str, by: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """ROC-AUC, PR-AUC by trapezoids, and average precision.

    The PR curve starts at recall 0 with precision 1. Scores that are null or
    not a number count as the mean score of the group.
    """
    curve = threshold_curve(mean_filled(df, score, by), score, label, by, hot_rows)
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    precision = tp / (tp + fp)
    before_all = tp + fp - pos - neg
    earlier = F.when(before_all > 0, F.try_divide(tp - pos, before_all)).otherwise(1.0)
    sums = curve.groupBy(*by).agg(
        F.sum(pos).alias("n_pos"), F.sum(neg).alias("n_neg"),
        F.sum(pos * (precision + earlier) / 2).alias("_pr"),
        F.sum(pos * precision).alias("_ap"),
        F.sum(neg * (tp - pos / 2)).alias("_roc"),
    )
    return sums.select(
        *by, "n_pos", "n_neg",
        F.try_divide(F.col("_roc"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("roc_auc"),
        F.try_divide(F.col("_pr"), F.col("n_pos")).alias("pr_auc"),
        F.try_divide(F.col("_ap"), F.col("n_pos")).alias("ap"),
    )


def grouped_precision(df: DataFrame, score: str, label: str, group: str) -> DataFrame:
    """Average precision per popularity group and its mean over the groups."""
    per_group = curve_areas(df, score, label, [group])
    mean = per_group.agg(F.avg("ap")).select(F.col("avg(ap)")).scalar()
    return per_group.select(group, "n_pos", "ap").withColumn("mean_ap", mean)


def ranking_metrics(df: DataFrame, query: Sequence[str], item: str, score: str, label: str, ks: Sequence[int]) -> DataFrame:
    """Per k: precision, recall, average precision, DCG and NDCG, averaged
    over queries. A query without relevant items scores 0."""
    relevant = df.groupBy(*query).agg(F.sum(F.col(label).cast("int")).alias("_rel"))
    best = top_k(df, query, [F.desc(score), F.col(item)], max(ks))
    y = F.col(label).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("rank", y.alias("y"))))
    listed = best.groupBy(*query).agg(ordered.alias("_l")).select(*query, F.col("_l.y").alias("_y"))
    rows = listed.join(relevant, list(query))
    places = rows.select(*query, "_rel", "_y", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    cut = F.slice("_y", 1, F.col("k"))
    hits = F.aggregate(cut, F.lit(0), lambda a, x: a + x)
    discounted = lambda v: F.aggregate(
        F.transform(v, lambda x, i: x / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)
    precise = F.transform(cut, lambda x, i: F.when(x == 1, F.aggregate(F.slice(cut, 1, i + 1), F.lit(0), lambda a, z: a + z) / (i + 1)).otherwise(0.0))
    precise_sum = F.aggregate(precise, F.lit(0.0), lambda a, x: a + x)
    # The ideal order of the first k: all hits among the kept labels up front.
    ideal = discounted(F.slice(F.sort_array("_y", asc=False), 1, F.col("k")))
    dcg = discounted(cut)
    each = places.select(
        "k",
        (hits / F.col("k")).alias("precision"),
        F.when(F.col("_rel") > 0, hits / F.col("_rel")).otherwise(0.0).alias("recall"),
        (precise_sum / F.least(F.greatest(F.col("_rel"), F.lit(1)), F.col("k"))).alias("ap"),
        dcg.alias("dcg"),
        F.when(ideal > 0, dcg / ideal).otherwise(0.0).alias("ndcg"),
    )
    return each.groupBy("k").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "ap", "dcg", "ndcg")], F.count(F.lit(1)).alias("n"))


def label_rates(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(f"{c}_rate") for c in labels])


def permute_column(df: DataFrame, key: Sequence[str], column: str, seed: int = 0, hot_rows: int | None = None) -> DataFrame:
    """Hand every row the column value of another row, one to one.

    Rows are numbered by key and again in seeded hash order; equal numbers
    exchange values.
    """
    mine = number_rows(df, list(key), "_a", hot_rows=hot_rows)
    drawn = df.select(*key, column).withColumn("_h", shuffle_rank(key, seed))
    theirs = number_rows(drawn, ["_h", *key], "_b", hot_rows=hot_rows).select("_b", F.col(column).alias("_value"))
    joined = mine.join(theirs, mine["_a"] == theirs["_b"])
    return joined.withColumn(column, F.col("_value")).drop("_a", "_b", "_value").select(*df.columns)


def swap_noise(df: DataFrame, key: Sequence[str], columns: Sequence[str], score, metric, seed: int = 0) -> DataFrame:
    """Metric after permuting each column in turn, and without permuting.

    ``score`` maps rows to scored rows, ``metric`` those to one row.
    """
    out = metric(score(df)).withColumn("permuted", F.lit("none"))
    for place, c in enumerate(columns):
        noisy = metric(score(permute_column(df, key, c, seed + place)))
        out = out.unionByName(noisy.withColumn("permuted", F.lit(c)))
    return out
