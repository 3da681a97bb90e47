"""Gradient-boosted trees on feature tables with Spark ML.

A feature table is binned once: features become the numbers of their quantile
bins, a missing value has a bin of its own and a flag beside, so that a split may
send it either way, and the table is stored. All models of a table, whatever
their labels, folds or groups, are fitted side by side on that one stored table.
A share of the rows stops the boosting once it no longer gets better on them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.operators.blending import average_runs
from cartloom.runtime import checkpoint_folder, stored

BINS = 64
SEED = 20240607
SIDE_BY_SIDE = 4
"""Models that are fitted at a time."""
STOP = 5e-4
"""Boosting ends when a round makes the loss of the rows held for it better by less than this share."""
MERGED = 1_000_000
"""Rows of a fit beyond which those of equal bins and label are merged to weighted lines."""
VECTOR, DRAW = "_bins", "_draw"


@dataclass(frozen=True)
class Bins:
    """Inner borders of each feature's bins, and the features with missing values."""

    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    flagged: tuple[str, ...]

    @property
    def parts(self) -> list[str]:
        """The feature that each place of the vector belongs to."""
        return [*self.features, *self.flagged]


@dataclass(frozen=True)
class Trees:
    """A model with the bins that its input needs."""

    bins: Bins
    model: GBTClassificationModel


def _number(c: str) -> Column:
    """As a double; null, like NaN, is missing."""
    return F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))


def learn_bins(df: DataFrame, features: Sequence[str], bins: int = BINS) -> Bins:
    """Quantile borders of all features in one pass, and which features miss values, in another."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    # One bin is left for missing values.
    share = [k / (bins - 1) for k in range(1, bins - 1)]
    found = numbers.approxQuantile(list(features), share, 1 / (4 * bins))
    edges = tuple(tuple(sorted({float(x) for x in e if not math.isinf(x)})) for e in found)
    missing = numbers.agg(*[F.max(F.isnan(_number(c))).alias(c) for c in features]).first()
    return Bins(tuple(features), edges, tuple(c for c in features if missing[c]))


def binned(df: DataFrame, bins: Bins) -> DataFrame:
    """The table with a vector of bin numbers; a value equal to a border lies above it."""
    inputs = [f"_x{i}" for i in range(len(bins.features))]
    outputs = [f"_b{i}" for i in range(len(bins.features))]
    flags = [f"_m{i}" for i in range(len(bins.flagged))]
    inside = F.lit(1e308)
    clipped = {x: F.when(F.isnan(_number(c)), _number(c)).otherwise(F.least(F.greatest(_number(c), -inside), inside)) for x, c in zip(inputs, bins.features)}
    table = df.withColumns(clipped | {m: F.isnan(_number(c)).cast("double") for m, c in zip(flags, bins.flagged)})
    infinite = float("inf")
    # A feature of one bin has no border of its own; any one does.
    splits = [[-infinite, *(e or (0.0,)), infinite] for e in bins.edges]
    cut = Bucketizer(splitsArray=splits, inputCols=inputs, outputCols=outputs, handleInvalid="keep").transform(table)
    # Bins are numbers in order, not categories as the columns' metadata says.
    plain = cut.withColumns({o: F.col(o).alias(o, metadata={}) for o in outputs})
    whole = VectorAssembler(inputCols=[*outputs, *flags], outputCol=VECTOR).transform(plain)
    return whole.select(*df.columns, VECTOR)


def binned_table(df: DataFrame, features: Sequence[str], bins: int = BINS) -> tuple[DataFrame, Bins]:
    """The table binned and stored with a number in [0, 1) drawn for each row, for any number of fits.

    The source is read for the borders, for what is missing, and once more.
    """
    learned = learn_bins(df, features, bins)
    place = F.xxhash64(F.lit(SEED), F.monotonically_increasing_id())
    return stored(binned(df, learned).withColumn(DRAW, F.shiftrightunsigned(place, 11).cast("double") * F.lit(2.0**-53))), learned


def merged(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of a fit, each of ``_weight`` 1; where there are more than ``most``, stored lines of equal rows with their number.

    The rows of a line are dealt by their draw to as many lines as make ``most``
    together, and one at least: lines are no more than distinct rows, or ``most``.
    """
    most = MERGED if most is None else most
    if rows.count() <= most:
        return rows.drop(DRAW).withColumn("_weight", F.lit(1.0))
    keys = [c for c in rows.columns if c != DRAW]
    distinct = rows.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    parts = max(1, most // max(1, distinct))
    lines = rows.groupBy(*keys, F.floor(F.col(DRAW) * parts).alias("_part")).agg(F.count(F.lit(1)).cast("double").alias("_weight"))
    return stored(lines.drop("_part"))


def fit_binned(table: DataFrame, bins: Bins, label: str, depth: int = 8, rounds: int = 300, step: float = 0.1, seed: int = 42,
               rows: float = 0.8, columns: float = 0.3, held: float = 0.1) -> Trees:
    """Binary classifier for one label on a binned table.

    Each tree is grown on the share ``rows`` of the rows, and each of its splits
    looks at the share ``columns`` of the features. A share ``held`` of the rows,
    drawn by hash, ends the boosting early; with 0 all rounds are run. Of large
    tables, lines of equal rows take the place of rows; see ``merged``.
    """
    checkpoint_folder(table.sparkSession)
    stop: dict = {}
    chosen = [VECTOR, DRAW, F.col(label).cast("double").alias("_label")]
    # A table too small to have a row held grows all rounds.
    if held > 0 and not table.filter(F.col(DRAW) < held).isEmpty():
        chosen.append((F.col(DRAW) < held).alias("_held"))
        stop = {"validationIndicatorCol": "_held", "validationTol": STOP}
    trees = GBTClassifier(featuresCol=VECTOR, labelCol="_label", weightCol="_weight", maxDepth=depth, maxIter=rounds, stepSize=step, seed=seed, subsamplingRate=rows,
                          featureSubsetStrategy=str(columns), maxBins=max(BINS, 2 + max(map(len, bins.edges), default=0)), checkpointInterval=10, **stop)
    return Trees(bins, trees.fit(merged(table.select(*chosen))))


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], Trees]], threads: int = SIDE_BY_SIDE) -> list[Trees]:
    """The jobs' models in order; fits share the cluster, so one's last tasks do not keep the others waiting."""
    if not jobs:
        return []
    with ThreadPoolExecutor(min(threads, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def fit_trees(df: DataFrame, features: Sequence[str], label: str, **options) -> Trees:
    """Binary classifier for one label, binned by the table's own quantiles."""
    return fit_labels(df, features, [label], **options)[label]


def fit_labels(df: DataFrame, features: Sequence[str], labels: Sequence[str], threads: int = SIDE_BY_SIDE, **options) -> dict[str, Trees]:
    """A model of its own for every label, all on one binned table."""
    table, bins = binned_table(df.select(*dict.fromkeys([*features, *labels])), features)
    models = side_by_side(df.sparkSession, [lambda label=label: fit_binned(table, bins, label, **options) for label in labels], threads)
    return dict(zip(labels, models))


def score_trees(trees: Trees, df: DataFrame, out: str = "score") -> DataFrame:
    """The probability of label 1 beside each row."""
    ready = df if VECTOR in df.columns else binned(df, trees.bins)
    scored = trees.model.transform(ready).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*[c for c in df.columns if c != out], out)


def _fit_parts(df: DataFrame, features: Sequence[str], label: str, parts: Sequence[Column], threads: int, options: dict) -> tuple[DataFrame, list[Trees]]:
    """The binned table, and a model of the rows of each part of it."""
    table, bins = binned_table(df, features)
    return table, side_by_side(df.sparkSession, [lambda part=part: fit_binned(table.filter(part), bins, label, **options) for part in parts], threads)


def _union(frames: Sequence[DataFrame]) -> DataFrame | None:
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    return out


def cross_fit(df: DataFrame, features: Sequence[str], label: str, half: Column, test: DataFrame | None = None,
              keys: Sequence[str] = (), threads: int = SIDE_BY_SIDE, **options):
    """Two half-models score each other's rows; test rows get the mean."""
    side = F.col("_half")
    table, models = _fit_parts(df.withColumn("_half", half), features, label, [side == 0, side == 1], threads, options)
    scored = _union([score_trees(models[1], table.filter(side == 0)), score_trees(models[0], table.filter(side == 1))]).drop("_half", VECTOR, DRAW)
    if test is None:
        return scored, None
    return scored, average_runs(_union([score_trees(m, test) for m in models]), keys, ["score"])


def bag_folds(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: int, test: DataFrame | None = None,
              keys: Sequence[str] = (), threads: int = SIDE_BY_SIDE, **options):
    """Out-of-fold scores, the bagged test scores, and the fold models."""
    table, models = _fit_parts(df, features, label, [F.col(fold) != k for k in range(folds)], threads, options)
    held_out = _union([score_trees(m, table.filter(F.col(fold) == k)) for k, m in enumerate(models)]).drop(VECTOR, DRAW)
    runs = None if test is None else average_runs(_union([score_trees(m, test) for m in models]), keys, ["score"])
    return held_out, runs, models


def importances(trees: Trees) -> dict[str, float]:
    """Share of each feature in the splits' gain, what its missing values tell included."""
    out = dict.fromkeys(trees.bins.features, 0.0)
    for feature, share in zip(trees.bins.parts, trees.model.featureImportances.toArray()):
        out[feature] += float(share)
    return out


def mean_importances(df: DataFrame, models: Sequence[Trees]) -> DataFrame:
    """Feature importances averaged over models; one line per feature."""
    each = [importances(m) for m in models]
    lines = [(f, sum(e[f] for e in each) / len(each)) for f in models[0].bins.features]
    return df.sparkSession.createDataFrame(lines, "feature string, importance double")


def per_group_models(df: DataFrame, features: Sequence[str], label: str, group: str, values: Sequence, threads: int = SIDE_BY_SIDE, **options) -> DataFrame:
    """A model of its own for every value of a small group column."""
    table, models = _fit_parts(df, features, label, [F.col(group) == v for v in values], threads, options)
    return _union([score_trees(m, table.filter(F.col(group) == v)) for v, m in zip(values, models)]).drop(VECTOR, DRAW)
