"""Boosted trees on the event log; of their scores SQL can state whose there are, and their range.

Trees are of depth 8 and up to 300 rounds, as the operators' defaults have it; a
tenth of the rows ends a boosting that no longer gets better.
"""

from pyspark.sql import functions as F

from cartloom import runtime
from cartloom.operators import models as M
from cartloom.plans.registry import query, rounded

FEATURES = ["hour", "dow", "value", "k"]


def features(t):
    """One row per event; the label is whether a purchase is told."""
    return t.events.select(
        "event_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("dow"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        F.pmod("user_id", F.lit(3)).cast("int").alias("fold"), F.pmod("event_id", F.lit(2)).cast("int").alias("half"),
        (F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz")).cast("int").alias("is_test"))


_fitted: dict[tuple, str] = {}


def fitted(name):
    """The query's result is stored: the scores and the facts about them come from the same models of a session."""

    def wrap(make):
        def result(t):
            key = (t.spark.sparkContext.applicationId, t.folder, name)
            if _fitted.get(key) not in runtime.scratch_paths():
                frame = make(t)
                _fitted[key] = runtime.scratch_folder(t.spark)
                frame.write.parquet(_fitted[key])
            return t.spark.read.parquet(_fitted[key])

        return result

    return wrap


def in_range(*scores):
    """Whether every score is a probability."""
    inside = F.lit(True)
    for c in scores:
        inside = inside & F.coalesce(F.col(c).between(0, 1), F.lit(False))
    return inside.alias("in_range")


KINDS = ("purchase", "click", "view", "signup")


@query("mdl1_boosted_trees")
@fitted("labels")
def labels(t):
    """A model for each of four labels, those of the event kinds."""
    rows = features(t).join(t.events.select("event_id", *[(F.col("event_type") == k).cast("int").alias(k) for k in KINDS]), "event_id")
    models = M.fit_labels(rows.filter("is_test = 0"), FEATURES, KINDS)
    scored = rows.filter("is_test = 1")
    for kind, model in models.items():
        scored = M.score_trees(model, scored, f"p_{kind}")
    return scored.select("event_id", *[rounded(f"p_{k}") for k in KINDS])


@query("mdl1_score_facts", "SELECT event_id, true AS in_range FROM events WHERE ts >= '2024-01-25'")
def _(t):
    return labels(t).select("event_id", in_range(*[f"p_{k}" for k in KINDS]))


@query("mdl2_cross_fit")
@fitted("halves")
def halves(t):
    rows = features(t)
    scored, tested = M.cross_fit(rows.filter("is_test = 0"), FEATURES, "y", F.col("half"), rows.filter("is_test = 1"), ["event_id"])
    return scored.select("event_id", rounded("score")).unionByName(tested.select("event_id", rounded("score")))


@query("mdl2_score_facts", "SELECT event_id, true AS in_range FROM events")
def _(t):
    return halves(t).select("event_id", in_range("score"))


@query("mdl3_bagged_folds_stacked")
@fitted("folds")
def folds(t):
    rows = features(t).filter("is_test = 0")
    held_out, _, _ = M.bag_folds(rows, FEATURES, "y", "fold", 3)
    stacked = held_out.withColumnRenamed("score", "stage1")
    second, _, _ = M.bag_folds(stacked, [*FEATURES, "stage1"], "y", "fold", 3)
    return second.select("event_id", rounded("stage1"), rounded("score"))


@query("mdl3_score_facts", "SELECT event_id, true AS in_range FROM events WHERE ts < '2024-01-25'")
def _(t):
    return folds(t).select("event_id", in_range("stage1", "score"))


@query("mdl4_mean_importances")
@fitted("importances")
def shares(t):
    table, bins = M.binned_table(features(t), FEATURES)
    models = M.side_by_side(t.spark, [lambda h=h: M.fit_binned(table.filter(F.col("half") == h), bins, "y") for h in (0, 1)])
    return M.mean_importances(table, models)


@query("mdl4_importance_facts", "SELECT 4 AS n_features, 1.0::DOUBLE AS total, true AS in_range")
def _(t):
    found = shares(t).withColumn("inside", F.col("importance").between(0, 1) & F.col("feature").isin(FEATURES))
    return found.agg(F.countDistinct("feature").cast("int").alias("n_features"), F.round(F.sum("importance"), 6).alias("total"), F.min("inside").alias("in_range"))


@query("mdl5_model_per_group")
@fitted("groups")
def groups(t):
    return M.per_group_models(features(t), FEATURES, "y", "half", [0, 1]).select("event_id", rounded("score"))


@query("mdl5_score_facts", "SELECT event_id, true AS in_range FROM events")
def _(t):
    return groups(t).select("event_id", in_range("score"))
