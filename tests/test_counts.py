"""Count maps joined where rows and maps of a column's value meet."""

import random

import pytest

from cartloom.operators import encoders as E
from cartloom.operators.joins import attach_frequent
from cartloom.runtime import SHARED_SHUFFLES

SETS = [["r"], ["r", "a"], ["r", "k"], ["a"], ["a", "k"], ["i"], ["i", "k"]]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture
def log(spark):
    draw = random.Random(4)
    some = lambda n: None if draw.random() < 0.05 else draw.randrange(n)
    lines = [(n, some(40), some(30), some(25), f"k{draw.randrange(3)}") for n in range(800)]
    return spark.createDataFrame(lines + [(n, 7, some(30), some(25), "k1") for n in range(800, 1100)], "n int, r long, a int, i long, k string")


def brute(log, known):
    lines = log.collect()
    out = []
    for row in lines:
        counts = [sum(x.n >= known and all(x[c] is not None and x[c] == row[c] for c in keys) for x in lines) for keys in SETS]
        out.append((*row, *[n or 1 for n in counts]))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_rows", [50, 10**9])
def test_shared_shuffles_give_the_counts(spark, log, hot_rows):
    maps = E.count_maps(log.filter("n >= 300"), SETS)
    found = E.attach_counts(log, maps, small=0, hot_rows=hot_rows)
    assert found.columns == [*log.columns, *["cnt_" + "_".join(k) for k in SETS]]
    assert rows_of(found) == brute(log, 300)


def test_maps_that_share_a_column_move_the_rows_once(spark, log):
    maps = E.count_maps(log, SETS)
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", SHARED_SHUFFLES: "false"}
    try:
        for option, value in options.items():
            spark.conf.set(option, value)
        plan = E.attach_counts(log, maps, small=0)._jdf.queryExecution().executedPlan().toString()
    finally:
        for option in options:
            spark.conf.unset(option)
    # Rows by r, a and i, beside one for each map.
    assert plan.count("Exchange hashpartitioning") == 3 + len(SETS)


def test_rows_of_frequent_lines_are_not_moved(spark):
    draw = random.Random(5)
    keys = [None if draw.random() < 0.05 else min(draw.randrange(60), draw.randrange(60)) for _ in range(900)]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k int")
    lines = [(k, 10 * k, keys.count(k)) for k in range(45)] + [(None, -1, 10**6)]
    table = spark.createDataFrame(lines, "key int, v int, n int")
    for most in (1, 7, 1000):
        found = attach_frequent(rows, table, {"k": "key"}, "n", small=0, most=most)
        assert found.columns == ["i", "k", "v"]
        assert rows_of(found) == sorted(((i, k, 10 * k if k is not None and k < 45 else None) for i, k in enumerate(keys)), key=str)
