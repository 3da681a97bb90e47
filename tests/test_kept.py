"""State that outlives a job: bucketed feature maps, daily aggregates, saved models."""

import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from cartloom.operators import daystate, fitted
from cartloom.operators.featuremaps import KeyedMaps
from cartloom.operators.joins import attach


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


# --- feature maps --------------------------------------------------------------

def shuffles(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


@pytest.fixture
def maps(spark, tmp_path):
    store = KeyedMaps(spark, ["k"], str(tmp_path / "maps"), buckets=3)
    kept = [store.keep(f"m{i}", spark.range(100 * i, 400).select(F.col("id").alias("k"), (F.col("id") * (i + 2)).alias(f"v{i}"))) for i in range(4)]
    return store, kept


def log_of(spark, hot=0):
    keys = [i % 500 for i in range(2000)] + [7] * hot + [999] * hot + [None] * 40
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, n int")


def plainly(log, kept):
    for one in kept:
        log = attach(log, one, ["k"])
    return rows_of(log)


def test_maps_and_a_kept_log_are_not_shuffled(spark, maps):
    store, kept = maps
    log = log_of(spark)
    once = store.attach(log, kept, small=0)
    # The log once, for four maps; no map.
    assert shuffles(once) == 1 and "REPARTITION_BY_NUM" in once._jdf.queryExecution().executedPlan().toString()
    assert rows_of(once) == plainly(log, kept)
    held = store.keep("log", log)
    never = store.attach(held, kept, arranged=True, small=0)
    assert "Exchange" not in never._jdf.queryExecution().executedPlan().toString()
    assert rows_of(never) == plainly(log, kept)


def test_hot_keys_stay_where_they_are(spark, maps, monkeypatch):
    store, kept = maps
    log = log_of(spark, hot=3000)
    out = store.attach(log, kept, {"v1": -1}, small=0, hot_rows=1000)
    assert out.columns == ["k", "n", "v0", "v1", "v2", "v3"]
    want = sorted((tuple(-1 if i == 3 and v is None else v for i, v in enumerate(r)) for r in plainly(log, kept)),
                  key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rows_of(out) == want
    # More hot keys than may be broadcast: only those of larger groups are.
    monkeypatch.setattr("cartloom.operators.featuremaps.MANY_HOT", 2)
    assert rows_of(store.attach(log, kept, small=0, hot_rows=1)) == plainly(log, kept)


def test_maps_opened_later_empty_logs_and_names_written_again(spark, maps, tmp_path):
    store, kept = maps
    later = KeyedMaps(spark, ["k"], str(tmp_path / "maps"), buckets=3)
    opened = [later.open(f"m{i}") for i in range(4)]
    log = log_of(spark)
    out = later.attach(log, opened, small=0)
    assert shuffles(out) == 1 and rows_of(out) == plainly(log, kept)
    assert later.attach(log.limit(0), opened, small=0).count() == 0
    again = later.keep("m0", spark.createDataFrame([(1, 5)], "k long, v0 long"))
    assert rows_of(again) == [(1, 5)]
    assert rows_of(later.attach(log, [again])) == plainly(log, [again])


# --- daily aggregates ----------------------------------------------------------

def events_of(spark, seed=3, n=900):
    draw = random.Random(seed)
    made = [(draw.choice("abcde"), draw.choice([0, 1, 1, None]), draw.randrange(1, 13)) for _ in range(n)]
    return spark.createDataFrame(made + [(None, 1, 4), ("z", 1, 12)], "k string, y int, day int")


def sums(rows):
    return daystate.daily_sums(rows, ["k"], ["y"], "day")


def test_days_put_one_by_one_equal_all_at_once(spark, tmp_path):
    rows = events_of(spark)
    steps, whole = (daystate.DayStore(spark, str(tmp_path / n)) for n in ("steps", "whole"))
    for day in range(1, 13):
        assert steps.put(sums(rows.filter(F.col("day") == day))) == day
    assert whole.put(sums(rows)) == 1
    assert rows_of(steps.table().select(*sums(rows).columns)) == rows_of(whole.table().select(*sums(rows).columns)) == rows_of(sums(rows))
    for day in (3, 7):
        steps.put(sums(rows.filter(F.col("day") == day)), [day])
    assert rows_of(steps.table().select("k", "day", "y_sum", "y_count")) == rows_of(sums(rows).select("k", "day", "y_sum", "y_count"))

    coded = daystate.encode_from_days(rows, steps.table(), ["k"], "y", "day", 5, "te")
    facts = [tuple(r) for r in rows.collect()]
    before = lambda day, key=...: [y for k, y, d in facts if d < day and y is not None and (key is ... or k == key)]
    for k, y, day, te in coded.collect():
        past, every = before(day, k) if k is not None else [], before(day)
        want = (sum(past) + 5 * sum(every) / len(every)) / (len(past) + 5) if past else None
        assert te == pytest.approx(want)
    assert coded.count() == len(facts)


def test_a_failure_before_the_listing_leaves_the_old_state(spark, tmp_path):
    rows = events_of(spark)
    store = daystate.DayStore(spark, str(tmp_path / "days"))
    store.put(sums(rows.filter("day < 6")))
    old = rows_of(store.table())
    # Files of a version that was never listed, as a lost driver leaves them.
    sums(rows.filter("day = 2")).write.partitionBy("day").parquet(str(tmp_path / "days/days/version=2"))
    with pytest.raises(Exception, match="a row without a day"):
        store.put(sums(rows.withColumn("day", F.when(F.col("day") != 3, F.col("day")))))
    assert store.version() == 1 and rows_of(store.table()) == old
    assert store.put(sums(rows.filter("day = 6"))) == 2
    assert rows_of(store.table().select("k", "day", "y_sum")) == rows_of(sums(rows.filter("day < 7")).select("k", "day", "y_sum"))
    assert rows_of(store.table(1)) == old


def test_days_that_became_empty(spark, tmp_path):
    rows = events_of(spark)
    store = daystate.DayStore(spark, str(tmp_path / "days"))
    with pytest.raises(LookupError):
        store.table()
    store.put(sums(rows.filter("day < 4")))
    assert store.put(sums(rows.filter("day = 99")), [2, 3]) == 2
    assert {r.day for r in store.table().select("day").distinct().collect()} == {1}
    with pytest.raises(ValueError):
        store.put(sums(rows.filter("day = 5")), [4])
    assert store.put(sums(rows.filter("day = 99")), [1]) == 3 and store.table().count() == 0
    assert store.put(sums(rows.filter("day = 5"))) == 4 and {r.day for r in store.table().collect()} == {5}


def test_sketches_of_days_merge_within_their_bounds(spark):
    n = 60_000
    rows = spark.range(n).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")).alias("at"),
        (F.pmod(F.xxhash64("id"), F.lit(40_000))).alias("reader"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)).alias("price"))
    days = daystate.daily_sketches(rows, "at", ["reader"], ["price"], theta_log_k=10)
    assert days.count() == 60
    whole = daystate.merged_sketches(days, "all", (0.1, 0.5, 0.99), theta_log_k=10).first()
    readers = rows.select("reader").distinct().count()
    assert whole.n_rows == n and abs(whole.n_reader - readers) <= readers * daystate.distinct_error(10)
    prices = sorted(r.price for r in rows.select("price").collect())
    for p, told in ((0.1, whole.price_p10), (0.5, whole.price_p50), (0.99, whole.price_p99)):
        below, upto = sum(x < told for x in prices) / n, sum(x <= told for x in prices) / n
        assert below - daystate.rank_error() <= p <= upto + daystate.rank_error()
    months = {r.period: r.n_rows for r in daystate.merged_sketches(days, "month", (0.5,), theta_log_k=10).collect()}
    assert months == {"2024-01": 31_000, "2024-02": 29_000}
    empty = daystate.merged_sketches(daystate.daily_sketches(rows.limit(0), "at", ["reader"], ["price"]), "week", (0.5,))
    assert empty.count() == 0


# --- saved models --------------------------------------------------------------

STAGES = lambda: [
    fitted.Filled(inputCol="x"), fitted.Filled(inputCol="kind", how="mode", indicator=False),
    fitted.Codes(inputCol="kind", outputCol="code", minCount=2, unseen=-1), fitted.Scores(inputCols=["x"], log=True),
    fitted.TargetMeans(keys=["kind"], label="y", outputCol="te", prior=0.5, weight=2.0)]


def test_a_loaded_pipeline_gives_equal_rows(spark, tmp_path):
    train = spark.createDataFrame([(1.0, "a", 1), (3.0, "a", 0), (None, "b", 1), (8.0, None, 0), (8.0, "c", 1), (2.0, "b", 1)], "x double, kind string, y int")
    test = spark.createDataFrame([(None, "a", 0), (4.0, "new", 1), (5.0, None, 0), (6.0, "c", 0)], "x double, kind string, y int")
    model = Pipeline(stages=STAGES()).fit(train)
    want = rows_of(model.transform(test))
    model.write().overwrite().save(str(tmp_path / "model"))
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert rows_of(loaded.transform(test)) == want
    assert [type(s) for s in loaded.stages] == [type(s) for s in model.stages] and loaded.stages[2].uid == model.stages[2].uid
    got = {r.kind: r for r in loaded.transform(test.select("x", "kind", "y")).collect()}
    # a three times with the filled mode, c once: below the count, like an unseen value.
    assert got["a"].code == 1 and got["c"].code == got["new"].code == -1
    assert got["a"].te == pytest.approx((1 + 2 * 0.5) / (3 + 2)) and got["new"].te == 0.5
    assert loaded.transform(test).filter("x_na = 1").count() == 1
    Pipeline(stages=STAGES()).save(str(tmp_path / "plan"))
    assert rows_of(Pipeline.load(str(tmp_path / "plan")).fit(train).transform(test)) == want


def test_new_nulls_and_columns_without_values(spark):
    full, holed = spark.createDataFrame([(1,), (2,), (2,)], "x int"), spark.createDataFrame([(1,), (None,)], "x int")
    model = fitted.Filled(inputCol="x", strict=True).fit(full)
    assert rows_of(model.transform(full)) == [(1, 0), (2, 0), (2, 0)]
    with pytest.raises(ValueError, match="new nulls"):
        model.transform(holed)
    nothing = fitted.Filled(inputCol="x", strict=True).fit(holed.filter("x is null"))
    assert rows_of(nothing.transform(holed)) == [(1, 0), (None, 1)]
    empty = fitted.Scores(inputCols=["x"]).fit(full.limit(0))
    assert rows_of(empty.transform(full)) == [(None,), (None,), (None,)]
