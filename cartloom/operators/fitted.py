"""Estimators of pyspark.ml whose fitted statistics are tables, saved and loaded with the model.

They stand in a ``pyspark.ml.Pipeline`` beside Spark's own stages. A model
loaded in a later session gives the same rows without the data it was fitted on.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.operators import clean, encoders
from cartloom.operators.aggregates import one_row
from cartloom.runtime import stored


class _Writer(MLWriter):
    def __init__(self, model: "TableModel"):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, SparkSession.active())
        self.model.table.write.mode("overwrite" if self.shouldOverwrite else "errorifexists").parquet(f"{path}/table")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> "TableModel":
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.kind(spark.read.parquet(f"{path}/table"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class TableModel(Model, MLWritable, MLReadable):
    """A model that is a table of statistics and the parameters of its estimator."""

    def __init__(self, table: DataFrame):
        super().__init__()
        self.table = table

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _TableEstimator(Estimator, DefaultParamsWritable, DefaultParamsReadable):
    """Parameters are given by name; ``fit`` makes a table and hands its parameters to the model."""

    model: type[TableModel]

    def _fit(self, dataset: DataFrame) -> TableModel:
        fitted = self.model(stored(self.learnt(dataset)))
        return self._copyValues(fitted)

    def learnt(self, dataset: DataFrame) -> DataFrame:
        raise NotImplementedError


class _OneColumn(Params):
    inputCol = Param(Params._dummy(), "inputCol", "column that is read", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column that is written", TypeConverters.toString)


# --- codes -------------------------------------------------------------------

class _CodeParams(_OneColumn):
    minCount = Param(Params._dummy(), "minCount", "rows that a value needs to get a code", TypeConverters.toInt)
    start = Param(Params._dummy(), "start", "first code", TypeConverters.toInt)
    unseen = Param(Params._dummy(), "unseen", "code of null, rare and unseen values", TypeConverters.toInt)

    def __init__(self, *args, **values):
        super().__init__(*args)
        self._setDefault(minCount=1, start=1, unseen=0)
        self._set(**values)


class CodesModel(_CodeParams, TableModel):
    """Codes of a learnt vocabulary."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        value = self.getOrDefault
        return encoders.encode(dataset, self.table, value("inputCol"), value("outputCol"), value("unseen"))


class Codes(_CodeParams, _TableEstimator):
    """Values that occur often enough, coded in sorted order; all others get ``unseen``."""

    model = CodesModel

    def learnt(self, dataset: DataFrame) -> DataFrame:
        value = self.getOrDefault
        return encoders.vocabulary(dataset, value("inputCol"), value("start"), value("minCount")).select("value", "code")


# --- missing values ----------------------------------------------------------

class _FillParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "column whose nulls are filled", TypeConverters.toString)
    how = Param(Params._dummy(), "how", "median (upper of two), middle (interpolated) or mode", TypeConverters.toString)
    indicator = Param(Params._dummy(), "indicator", "whether <column>_na tells what was filled", TypeConverters.toBoolean)
    strict = Param(Params._dummy(), "strict", "whether nulls in a column that had none are an error", TypeConverters.toBoolean)

    def __init__(self, *args, **values):
        super().__init__(*args)
        self._setDefault(how="median", indicator=True, strict=False)
        self._set(**values)


class FilledModel(_FillParams, TableModel):
    """Nulls replaced by the learnt value."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column, learnt = self.getOrDefault("inputCol"), one_row(self.table)
        if self.getOrDefault("strict") and self.table.first()["nulls"] == 0 and not dataset.filter(F.col(column).isNull()).isEmpty():
            raise ValueError(f"columns with new nulls: {[column]}")
        if self.getOrDefault("indicator"):
            dataset = dataset.withColumn(f"{column}_na", F.col(column).isNull().cast("int"))
        return dataset.withColumn(column, F.coalesce(F.col(column), learnt["value"]))


class Filled(_FillParams, _TableEstimator):
    """The value that stands for nulls, learnt from the column; null where the column has no value at all."""

    model = FilledModel

    def learnt(self, dataset: DataFrame) -> DataFrame:
        column, how = self.getOrDefault("inputCol"), self.getOrDefault("how")
        # A row without a value, filled by the operator, is the value learnt.
        nulls = dataset.agg(F.count_if(F.col(column).isNull()).alias("nulls"))
        blank = nulls.select("nulls", F.lit(None).cast(dataset.schema[column].dataType).alias(column))
        return clean.fill_fitted(blank, dataset, column, how, indicator=False).select("nulls", F.col(column).alias("value"))


# --- z-scores ----------------------------------------------------------------

class _ScoreParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns that are replaced by their z-scores", TypeConverters.toListString)
    log = Param(Params._dummy(), "log", "whether log(1 + x) is taken first", TypeConverters.toBoolean)
    epsilon = Param(Params._dummy(), "epsilon", "added to the deviation", TypeConverters.toFloat)

    def __init__(self, *args, **values):
        super().__init__(*args)
        self._setDefault(log=False, epsilon=1e-7)
        self._set(**values)

    def _measured(self) -> dict:
        return {c: F.log1p(c) if self.getOrDefault("log") else F.col(c) for c in self.getOrDefault("inputCols")}


class ScoresModel(_ScoreParams, TableModel):
    """(x - mean) / (epsilon + deviation) by the learnt moments."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        moments, epsilon = one_row(self.table), self.getOrDefault("epsilon")
        return dataset.withColumns({n: (c - moments[f"{n}_mean"]) / (moments[f"{n}_std"] + epsilon) for n, c in self._measured().items()})


class Scores(_ScoreParams, _TableEstimator):
    """Mean and sample deviation of each column."""

    model = ScoresModel

    def learnt(self, dataset: DataFrame) -> DataFrame:
        return clean.fit_moments(dataset, self._measured())


# --- target means ------------------------------------------------------------

class _TargetParams(Params):
    keys = Param(Params._dummy(), "keys", "columns that make the key", TypeConverters.toListString)
    label = Param(Params._dummy(), "label", "column whose mean is taken", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column that is written", TypeConverters.toString)
    prior = Param(Params._dummy(), "prior", "mean that sums are smoothed towards", TypeConverters.toFloat)
    weight = Param(Params._dummy(), "weight", "rows that the prior counts for", TypeConverters.toFloat)

    def __init__(self, *args, **values):
        super().__init__(*args)
        self._set(**values)


class TargetMeansModel(_TargetParams, TableModel):
    """The smoothed mean of the row's key; the prior for unseen keys."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        value = self.getOrDefault
        label = value("label")
        coded = encoders.apply_target(dataset, self.table, value("keys"), {label: value("prior")}, value("weight"), "_te")
        return coded.withColumnRenamed(f"_te_{label}", value("outputCol"))


class TargetMeans(_TargetParams, _TableEstimator):
    """Sums and counts of the label per key."""

    model = TargetMeansModel

    def learnt(self, dataset: DataFrame) -> DataFrame:
        return encoders.fit_target(dataset, self.getOrDefault("keys"), [self.getOrDefault("label")])
