"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from cartloom import plans
from cartloom.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
plans.load()
# Operators with a plan of their own for large inputs and hot groups.
LARGE = ["prj6_fill_upper_median", "row1_dense_ids", "row6_group_positions", "agg6_session_lists", "agg9_gini", "agg10_share_curve",
         "jon7_nearest_events", "enc2_joint_codes", "enc16_contiguous_folds_pooled", "enc17_kfold_target_mean", "enc26_difference",
         "win1_lags", "win17_session_gaps", "seq8_half_labels", "seq14_cut_points", "met7_pr_auc", "met9_grouped_precision",
         "enc20_daily_target_mean", "seq13_cut_after_add", "seq16_resampled_buckets", "win2_neighbour_gaps", "win14_candidate_rank",
         "str12_decoded_tokens", "agg7_concatenated_lists"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda row: tuple((v is None, str(v)) for v in row)
    return [columns[i] for i in order], sorted((tuple(row[i] for i in order) for row in rows), key=key)


def check(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"))
    columns, got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLES:
        assert got
        return
    result = duck.sql(ORACLES[name])
    names, want = canonical(result.columns, result.fetchall())
    assert columns == names
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-9, abs=1.1e-6) if all(isinstance(v, float) for v in a) else a == b, (a, b)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    check(spark, duck, name)


@pytest.mark.parametrize("name", LARGE)
def test_query_by_large_plan(spark, duck, large, name):
    check(spark, duck, name)


def test_contract_has_the_plans():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert set(contract.entry(spark).columns) == {"basket", "line", "item", "te"}


def test_filter_and_columns_reach_the_scan(spark):
    plan = QUERIES["src3_pruned_parquet"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan
    assert "l_extendedprice" not in plan


def test_rank_limit_before_the_shuffle(spark):
    plan = QUERIES["topk1_best_items"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_a_softmax_makes_its_scores_once(spark, large):
    from cartloom.operators.blending import softmax_rows

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x % 7)

    scores = spark.range(60).select((F.col("id") % 4).alias("k"), counted.asNondeterministic()("id").alias("s"))
    rows = softmax_rows(scores, ["k"], "s").groupBy("k").agg(F.round(F.sum("prob"), 9).alias("total")).collect()
    assert [r.total for r in rows] == [1.0] * 4 and seen.value == 60


def test_ranked_bags_are_made_once(spark):
    plan = QUERIES["bld5_sparse_top_blend"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan


def test_tasks_after_a_shuffle_read_little(spark):
    from cartloom.runtime import ADAPTIVE, tune

    kept = {o: spark.conf.get(o, None) for o in [*ADAPTIVE, "spark.sql.shuffle.partitions"]}
    try:
        tune(spark).conf.set("spark.sql.shuffle.partitions", "64")
        moved = spark.range(10_000_000).select(F.xxhash64("id").alias("h"), F.xxhash64(F.col("id") + 1).alias("g")).repartition("h")
        assert moved.rdd.getNumPartitions() >= 8
    finally:
        for option, value in kept.items():
            spark.conf.unset(option) if value is None else spark.conf.set(option, value)
