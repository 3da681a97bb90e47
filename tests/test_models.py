"""Boosted trees: bins, missing values, stopping, and models side by side."""

import random

import pytest
from pyspark.sql import functions as F

from cartloom.operators import models

SMALL = {"depth": 3, "rounds": 12}


def rows(n=1200, seed=2):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        x, z = draw.gauss(0, 1), draw.choice([None, 1.0, 2.0, 3.0])
        good = int((x > 0.3) != (draw.random() < 0.1))
        out.append((i, x, z, draw.random(), good, int(z is None or z == 1.0), i % 3))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "id long, x double, z double, noise double, y int, gap int, fold int").repartition(4).cache()


def accuracy(frame, label, score="score"):
    return frame.agg(F.avg(((F.col(score) > 0.5).cast("int") == F.col(label)).cast("double"))).first()[0]


def test_bins(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), *[float(i % 10) for i in range(100)]]
    frame = spark.createDataFrame([(i, v, None, 1) for i, v in enumerate(values)], "id long, a double, b double, c int")
    bins = models.learn_bins(frame, ["a", "b", "c"], 8)
    assert bins.flagged == ("a", "b") and bins.parts == ["a", "b", "c", "a", "b"]
    assert bins.edges[0] == tuple(sorted(set(bins.edges[0]))) and 3 <= len(bins.edges[0]) <= 6 and bins.edges[1] == ()
    got = {r.id: r[models.VECTOR].toArray().tolist() for r in models.binned(frame, bins).collect()}
    missing = len(bins.edges[0]) + 1
    for i, v in enumerate(values):
        number, none = got[i][0], got[i][3]
        if v is None or v != v:
            assert (number, none) == (missing, 1)
        else:
            assert (number, none) == (sum(e <= v for e in bins.edges[0]), 0)
    assert len({tuple(v[1:3]) for v in got.values()}) == 1


def test_learns_and_stops(table):
    trees = models.fit_trees(table, ["x", "noise"], "y")
    assert 1 < len(trees.model.trees) < 300 and max(t.depth for t in trees.model.trees) <= 8
    assert accuracy(models.score_trees(trees, table), "y") > 0.85
    whole = models.fit_trees(table, ["x"], "y", depth=2, rounds=7, held=0)
    assert len(whole.model.trees) == 7


def test_missing_values_have_a_branch(table):
    """A missing value goes with 1 against 2 and 3, which no order of the values allows."""
    trees = models.fit_trees(table, ["z"], "gap", columns=1.0, **SMALL)
    assert accuracy(models.score_trees(trees, table), "gap") == 1.0
    assert models.importances(trees) == {"z": pytest.approx(1.0)}


def test_models_side_by_side_equal_models_in_turn(table):
    one, _, _ = models.bag_folds(table, ["x", "z", "noise"], "y", "fold", 3, threads=1, **SMALL)
    many, _, fits = models.bag_folds(table, ["x", "z", "noise"], "y", "fold", 3, threads=3, **SMALL)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() == 1200
    shares = {r.feature: r.importance for r in models.mean_importances(table, fits).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["x"] == max(shares.values())


def test_one_read_of_the_source(spark, table, tmp_path):
    """Folds read the stored table; the source is read for its borders, for missing values and to be stored."""
    path = str(tmp_path / "source")
    table.write.parquet(path)
    source = spark.read.parquet(path)
    held, _, _ = models.bag_folds(source, ["x", "noise"], "y", "fold", 3, **SMALL)
    assert not any(path in f for f in held.inputFiles())


def test_cross_fit_and_groups(table):
    train, test = table.filter("id < 1000"), table.filter("id >= 1000")
    scored, tested = models.cross_fit(train, ["x", "noise"], "y", F.pmod("id", F.lit(2)), test, ["id"], **SMALL)
    assert scored.columns == [*table.columns, "score"] and scored.count() == 1000 and tested.count() == 200
    assert accuracy(scored, "y") > 0.8 and accuracy(tested.join(test.select("id", "y"), "id"), "y") > 0.8
    grouped = models.per_group_models(table, ["x"], "y", "fold", [0, 1, 2], **SMALL)
    assert grouped.count() == 1200 and accuracy(grouped, "y") > 0.8


def test_labels_share_a_table(table):
    fits = models.fit_labels(table, ["x", "z"], ["y", "gap"], **SMALL)
    assert list(fits) == ["y", "gap"] and fits["y"].bins == fits["gap"].bins
    both = models.score_trees(fits["gap"], models.score_trees(fits["y"], table, "p_y"), "p_gap")
    assert both.columns == [*table.columns, "p_y", "p_gap"] and accuracy(both, "y", "p_y") > 0.8 and accuracy(both, "gap", "p_gap") > 0.95


def test_equal_rows_of_large_tables_are_merged(spark, table, monkeypatch):
    stored, bins = models.binned_table(table, ["x", "z"])
    chosen = stored.select(models.VECTOR, models.DRAW, "gap")
    distinct = chosen.select(models.VECTOR, "gap").distinct().count()
    lines = models.merged(chosen, 10)
    assert lines.count() == distinct < 1200 and lines.agg(F.sum("_weight")).first()[0] == 1200
    few = models.merged(chosen.select(F.expr("gap"), models.DRAW), 100)
    assert 60 < few.count() <= 110 and {r.gap: r.n for r in few.groupBy("gap").agg(F.sum("_weight").alias("n")).collect()} == {
        r.gap: r.n for r in table.groupBy("gap").agg(F.count("*").cast("double").alias("n")).collect()}
    assert models.merged(chosen, 1200).agg(F.sum("_weight"), F.count("*")).first()[:] == (1200, 1200)
    plain = models.fit_binned(stored, bins, "gap", depth=3, rounds=5, rows=1.0, columns=1.0, held=0)
    monkeypatch.setattr(models, "MERGED", 10)
    weighted = models.fit_binned(stored, bins, "gap", depth=3, rounds=5, rows=1.0, columns=1.0, held=0)
    both = models.score_trees(weighted, models.score_trees(plain, table, "p"), "q")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9
    assert accuracy(models.score_trees(models.fit_trees(table, ["x", "noise"], "y"), table), "y") > 0.85
