"""Hot groups: the split plan must give what the plain one gives."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartloom.operators import history, joins, rows
from cartloom.operators.ordered import Number, Running, Shift, hot_groups, number_rows, ordered_windows

SPECS = {"n": Number(), "p1": Shift("v", 1), "p3": Shift("v", 3), "x2": Shift("id", -2), "s": Running("sum", "v"),
         "top": Running("max", "v", True), "low": Running("min", "v"), "rest": Running("sum", "v", before=True, later=True),
         "least_later": Running("min", "v", later=True), "most_later": Running("max", "v", before=True, later=True)}


def skewed(spark, n=3000):
    """A third of all rows on key 0, another hot group on null, the rest spread."""
    ids = spark.range(n).withColumn("k", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 211))
    return ids.withColumns({"v": F.pmod(F.col("id") * 7919, F.lit(1009)).cast("double"), "t": F.floor(F.col("id") / 10)}).repartition(7)


def same(a, b):
    a, b = (f.toPandas().sort_values("id").reset_index(drop=True) for f in (a, b))
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)])


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("falling", [False, True])
def test_split_groups_equal_plain_ones(spark, keys, falling):
    df = skewed(spark)
    order = [F.desc("v"), F.col("id")] if falling else ["t", "id"]
    same(ordered_windows(df, keys, order, SPECS), ordered_windows(df, keys, order, SPECS, hot_rows=100))


def test_hot_groups_are_found_from_a_sample(spark):
    df = spark.range(400_000).withColumn("k", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")))
    assert [r.k for r in hot_groups(df, ["k"], 40_000).collect()] == [-1]


def test_split_group_is_spread_over_parts(spark):
    from cartloom.operators.ordered import PART, range_parts

    hot = skewed(spark).filter("k = 0")
    sizes = range_parts(hot, [F.col("k"), F.col("id")], 4).groupBy(PART).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 600


def test_ids_are_dense_in_order(spark):
    got = number_rows(skewed(spark), ["v", "id"], "row", start=5, hot_rows=10).orderBy("row").collect()
    assert [r.row for r in got] == list(range(5, 3005))
    assert [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)


def test_positions_of_hot_group(spark):
    got = rows.positions(skewed(spark), ["k"], ["t", "id"], hot_rows=100).filter("k = 0").collect()
    assert len(got) > 1000 and sorted(r.dcount for r in got) == list(range(len(got)))
    assert all(r.dcount + r.icount + 1 == r.n for r in got)


def test_nearest_events_against_brute_force(spark):
    df = skewed(spark, 600).filter("k is not null")
    a, b = df.filter("v < 300"), df.filter("v >= 300")
    got = {r.id: (r.gap_before, r.gap_after) for r in joins.nearest_events(a, b, ("k", "k"), ("t", "t"), 999, hot_rows=50).collect()}
    events = [(r.k, r.t) for r in b.collect()]
    for r in a.collect():
        before = [r.t - t for k, t in events if k == r.k and t < r.t]
        after = [t - r.t for k, t in events if k == r.k and t > r.t]
        assert got[r.id] == (min(before, default=999), min(after, default=999))


def test_two_hop_with_a_hub_against_brute_force(spark):
    edges = {(i, 0) for i in range(1, 60)} | {(0, i) for i in range(30, 90)} | {(i, (i * 7) % 90) for i in range(90)}
    frame = spark.createDataFrame(sorted(edges), "a long, b long")
    want = {(a, b) for a, b in edges if any((a, c) in edges and (c, b) in edges for c in range(90))}
    assert {tuple(r) for r in joins.two_hop(frame, frame).collect()} == want


def test_input_partitioning_does_not_matter(spark):
    df = skewed(spark)
    for parts in (1, 3, 11):
        same(history.lags(df, ["k"], ["t", "id"], "v", [1, 2]), history.lags(df.repartition(parts), ["k"], ["t", "id"], "v", [1, 2], hot_rows=200))


@pytest.mark.parametrize("keys", [["k"], []])
def test_joins_do_not_grow_with_the_shifts(spark, keys):
    def joins_of(steps):
        specs = {f"s{k}": Shift("v", k) for k in steps}
        frame = ordered_windows(skewed(spark), keys, ["t", "id"], specs, hot_rows=100)
        return frame._jdf.queryExecution().executedPlan().toString().count("Join ")

    assert joins_of([1]) == joins_of([1, 2, 3, 4, -1, -2, -5])


def test_far_shifts_over_thin_parts(spark):
    df = skewed(spark, 200)
    specs = {"far": Shift("id", 30), "ahead": Shift("id", -25), "n": Number()}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        same(ordered_windows(df, ["k"], ["t", "id"], specs), ordered_windows(df, ["k"], ["t", "id"], specs, hot_rows=10))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_exploded_rows_are_not_small(spark, monkeypatch):
    from cartloom import runtime

    monkeypatch.setattr(runtime, "SMALL_ROWS", 100_000)
    few = spark.range(100)
    assert runtime.is_small(few) and not runtime.is_small(few.select(F.explode(F.sequence(F.lit(1), F.lit(2000))).alias("x")))


def test_ranks_beyond_the_group_limit(spark, large):
    from cartloom.operators.ordered import top_k

    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "20")
    try:
        got = top_k(skewed(spark), ["k"], ["v", "id"], 50).filter("k = 0").collect()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    want = sorted((r.v, r.id) for r in skewed(spark).filter("k = 0").collect())[:50]
    assert [(r.v, r.id) for r in sorted(got, key=lambda r: r["rank"])] == want
