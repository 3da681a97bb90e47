"""Hand-made frames for the semantics that are easy to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from cartloom.functions import scalars as S
from cartloom.functions import text as X
from cartloom.functions import vectors as V
from cartloom.operators import blending, clean, encoders, history, metrics, sequences, splits
from cartloom.sources import readers


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_static_codes():
    assert len(S.LANGUAGE_CODES) == 66
    assert S.LANGUAGE_CODES["488B32D24BD4BB44172EB981C1BCA6FA"] == 0
    assert S.LANGUAGE_CODES["8C64085F46CD49FA5C80E72A35845185"] == 65


@pytest.mark.parametrize("text, nth, want", [
    ("hi @Tom: there", 0, "tom"), ("hi @a _ b! x @second", 0, "a_b"), ("hi @a _ b! x @second", 1, "second"), ("none", 0, ""), ("@!", 0, "!")])
def test_mentions(spark, text, nth, want):
    assert value(spark, X.mention(F.lit(text), nth)) == want


@pytest.mark.parametrize("text, want", [
    ("why?", 1), ("why!?", 2), ("why?!", 3), ("wow!", 4), ("so.", 0), ("", 0), ("?", 0), ("really? http://x", 1), ("wow! #tag", 4), ("ok @me what?", 1), ("hm?[sep]", 1)])
def test_ending_class(spark, text, want):
    assert value(spark, X.ending_class(F.lit(text))) == want


def test_hashes(spark):
    import hashlib

    for word in ("hello", "ab", ""):
        source = word if len(word) > 2 else "0"
        want = int(hashlib.md5(source.encode()).hexdigest(), 16) % 2**32
        assert value(spark, X.md5_u32(F.lit(word))) == want
    assert value(spark, X.hex_to_long(F.lit("AAFFFFFFFFFFFFFFF0"))) == -16
    assert value(spark, X.hex_to_u32(F.lit("0123456789ABCDEF\tFF"))) == 0x89ABCDEF
    assert value(spark, X.hex_to_u32(F.lit(None).cast("string"))) == 0


def test_clean_text(spark):
    assert value(spark, X.clean_text(F.lit("[CLS] RT @ Bob: see https : / / t. co / abc # Tag  ¶ end"))) == "@bob: see httpabc #tag end"


def test_retweet_parts(spark):
    c, rt = F.lit("@bob: see: this"), F.lit(True)
    assert value(spark, X.retweet_head(c, rt)) == "@bob"
    assert value(spark, X.retweet_body(c, rt)) == " see: this"
    assert value(spark, X.retweet_body(c, F.lit(False))) == "@bob: see: this"


def test_account_age_wraps_like_one_byte(spark):
    assert value(spark, S.account_age_byte(F.lit(-5))) == -127
    assert value(spark, S.account_age_byte(F.lit(1139000000))) == 113
    assert value(spark, S.account_age_byte(F.lit(1139000000 + 691387))) == (113 + 240 + 128) % 256 - 128


def test_snap_even(spark):
    got = [value(spark, S.snap_even(F.lit(x))) for x in range(13)]
    assert got == [min((0, 2, 4, 6, 8, 10), key=lambda n: abs(n - x)) for x in range(13)]


def test_cosine_is_a_distance(spark):
    u, v = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert value(spark, V.cosine_distance(u, u)) == pytest.approx(0)
    assert value(spark, V.cosine_distance(u, v)) == pytest.approx(1)


def test_softmax_by_length(spark):
    got = value(spark, V.softmax_by_length(F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)])))
    raised = [math.exp(x) for x in (1, 2, 3, 4)]
    assert got == pytest.approx([r / sum(raised) * 2 for r in raised])


def test_upper_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    filled = clean.fill_fitted(df, df, "v", "median")
    assert sorted(r.v for r in filled.collect()) == [1.0, 2.0, 3.0, 3.0, 10.0]
    assert sum(r.v_na for r in filled.collect()) == 1
    middle = clean.fill_fitted(df, df, "v", "middle", indicator=False)
    assert sorted(r.v for r in middle.collect()) == [1.0, 2.0, 2.5, 3.0, 10.0]


def test_new_nulls_raise(spark):
    full, holes = spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([(None,)], "v int")
    with pytest.raises(ValueError, match="v"):
        clean.check_no_new_nulls(full, holes, ["v"])


def test_favourite_needs_support(spark):
    df = spark.createDataFrame([(1, "x")] * 4 + [(1, "y")] * 5 + [(2, "x")] * 3, "u int, v string")
    assert [tuple(r) for r in history.favourite(df, "u", "v", "fav", support=3).collect()] == [(1, "y")]
    assert dict(history.favourite(df, "u", "v", "fav").collect()) == {1: "y", 2: "x"}


def test_multi_hot_matches_whole_tokens(spark):
    df = spark.createDataFrame([("Bar & Lounge|Pool",), (None,)], "p string")
    assert [r.is_Bar for r in encoders.multi_hot(df, "p", r"\|", ["Bar"]).collect()] == [0, 0]


def test_fold_sums_add_up(spark):
    df = spark.range(500).select("id", (F.col("id") % 13).alias("k"), (F.col("id") % 5).cast("int").alias("fold"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = encoders.target_encode(df, ["k"], "y", "fold", 0, "te").collect()
    raw = df.collect()
    for r in got[::17]:
        other = [x.y for x in raw if x.k == r.k and x.fold != r.fold]
        assert r.te == pytest.approx(sum(other) / len(other))


def test_leave_one_out_drops_own_label(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "k string, y int")
    table = encoders.fit_target(df, ["k"], ["y"])
    got = encoders.apply_target(df, table, ["k"], {"y": 0.5}, 1, "te", in_train=F.lit(True))
    assert sorted((r.k, r.y, r.te_y) for r in got.collect()) == [("a", 0, 0.75), ("a", 1, 0.25), ("b", 1, 0.5)]


def test_extended_vocabulary_stays_dense(spark):
    base = spark.createDataFrame([("b",), ("a",), (None,)], "v string")
    more = spark.createDataFrame([("a",), ("z",), ("c",)], "v string")
    grown = encoders.extend_vocabulary(encoders.vocabulary(base, "v"), more, "v")
    assert dict(grown.collect()) == {"a": 0, "b": 1, "c": 2, "z": 3}


def test_half_labels_keep_rare_items(spark):
    items = [7, 1, 8, 1, 7, 9, 9, 5]
    df = spark.createDataFrame([(0, i, x, "p" if x != 5 else "v") for i, x in enumerate(items)], "s int, t int, item int, kind string")
    got = sequences.half_labels(df, ["s"], ["t"], "item", F.col("kind") == "p", rare=1).first()
    assert (got.n, got.n_input, got.labels) == (8, 4, [9])
    got = sequences.half_labels(df.filter("t < 4"), ["s"], ["t"], "item", F.lit(True), rare=1).first()
    assert got.labels == [8, 1]


def test_long_lists_continue_in_chunks(spark):
    df = spark.range(25).withColumn("s", F.lit(1))
    got = sequences.chunk_lists(df, ["s"], ["id"], ["id"], chunk=10, hot_rows=5).orderBy("chunk").collect()
    assert [r.chunk for r in got] == [0, 1, 2]
    assert sum((r.id_list for r in got), []) == list(range(25))


def test_joined_lists_default(spark):
    df = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, None), (2, 0, [])], "s int, t int, l array<string>")
    got = {r.s: r["items"] for r in sequences.joined_lists(df, ["s"], ["t"], "l", 100).collect()}
    assert got == {1: ["a", "b"], 2: ["missing"]}


def test_blend_keeps_missing_as_zero(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 0.5)], "r int, i string, s double")
    b = spark.createDataFrame([(1, "y", 1.0)], "r int, i string, s double")
    got = blending.blend_top([(a, 0.5), (b, 0.5)], ["r"], "i", "s", 5).collect()
    assert [(r.i, r.s) for r in sorted(got, key=lambda r: r.rank)] == [("y", 0.75), ("x", 0.5)]


def test_empty_prediction_list_leaves_a_dummy(spark):
    df = spark.createDataFrame([(1, [], []), (2, [4, 5], [0.0, 0.0])], "s int, ids array<int>, lg array<double>")
    got = sorted(tuple(r) for r in blending.explode_predictions(df, ["s"], "ids", "lg").collect())
    assert got == [(1, 0, 0, 0.0), (2, 0, 4, 0.5), (2, 1, 5, 0.5)]


def test_list_metrics(spark):
    df = spark.createDataFrame([([3, 1, 2], [1, 9]), ([4], [7]), ([5, 6], [6])], "p array<int>, l array<int>")
    got = metrics.session_metrics(df, "p", "l", 2).first()
    assert got.mrr == pytest.approx((1 / 2 + 0 + 1 / 2) / 3)
    assert got.precision == pytest.approx((0.5 + 0 + 0.5) / 3)
    assert got.recall == pytest.approx((0.5 + 0 + 1) / 3)


def test_mean_reciprocal_rank_counts_hits_only(spark):
    df = spark.createDataFrame([(1, "a", 0.9, 0), (1, "b", 0.1, 1), (2, "a", 0.5, 0)], "r int, i string, s double, hit int")
    got = metrics.reciprocal_rank(df, ["r"], "i", "s", F.col("hit") == 1).first()
    assert (got.mrr, got.n) == (0.5, 1)


def test_areas_with_tied_scores(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "p double, y int")
    got = metrics.curve_areas(df, "p", "y").first()
    assert got.roc_auc == pytest.approx(0.875)
    assert got.ap == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert got.pr_auc == pytest.approx(0.5 * 1 + 0.5 * (1 + 2 / 3) / 2)


def test_weighted_micro_f1_is_not_divided(spark):
    df = spark.createDataFrame([(b, 1) for b in (0, 2, 4, 6, 8, 10)], "b int, y int")
    assert metrics.weighted_micro_f1(df, "b", F.lit(1), "y").first().weighted_f1 == pytest.approx(4.5)


def test_ranking_metrics_closed_form(spark):
    df = spark.createDataFrame([(1, i, 1.0 - i / 10, int(i in (0, 2))) for i in range(4)], "q int, i int, s double, y int")
    got = {r.k: r for r in metrics.ranking_metrics(df, ["q"], "i", "s", "y", [1, 3]).collect()}
    assert (got[1].precision, got[1].recall, got[1].ap, got[1].ndcg) == (1.0, 0.5, 1.0, 1.0)
    assert got[3].dcg == pytest.approx(1 + 1 / 2)
    assert got[3].ap == pytest.approx((1 + 2 / 3) / 2)
    assert got[3].ndcg == pytest.approx(1.5 / (1 + 1 / math.log2(3)))


def test_permutation_keeps_the_values(spark):
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    got = metrics.permute_column(df, ["id"], "v").collect()
    assert sorted(r.v for r in got) == [2 * i for i in range(50)]
    assert any(r.v != 2 * r.id for r in got)


def test_balanced_folds(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 37)
    folds = splits.balanced_group_folds(df, "g", 5).groupBy("fold").agg(F.sum("n").alias("n")).collect()
    assert len(folds) == 5 and max(r.n for r in folds) - min(r.n for r in folds) <= 30


def test_contiguous_folds_remainder(spark):
    df = spark.range(11)
    last = splits.contiguous_folds(df, ["id"], 3).orderBy("id").collect()
    assert [r.fold for r in last] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 2]
    wrapped = splits.contiguous_folds(df, ["id"], 3, wrap=True).orderBy("id").collect()
    assert [r.fold for r in wrapped][-2:] == [0, 0]


def test_nested_queries_from_one_array(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"query": [{"e": 1}, {"e": 2}], "nb": 4},\n {"query": [{"e": 3}], "nb": 0}]')
    rows = readers.read_test_queries(spark, str(tmp_path / "q.json"), "e: int", {"nb": "int"}).collect()
    assert sorted((r.nb, r.place, r.e) for r in rows) == [(0, 0, 3), (4, 0, 1), (4, 1, 2)]


def test_unlabelled_log(spark, tmp_path):
    line = "\x01".join(["1\t2", "", "T", "Photo\tGIF", "", "", "Quote", "L", "5", "A", "1", "2", "true", "9", "B", "3", "4", "false", "8", "true"])
    (tmp_path / "log.tsv").write_text(line + "\n")
    row = readers.read_engagements(spark, str(tmp_path / "log.tsv"), labelled=False).first()
    assert (row.text_tokens, row.hashtags, row.media, row.b_follows_a, row.a_follower_count) == ("1\t2", None, "Photo\tGIF", True, 1)


def test_missing_scores_count_as_the_mean(spark):
    from cartloom.operators.metrics import curve_areas

    rows = [(0.9, 1), (0.1, 0), (float("nan"), 0), (None, 1)]
    got = curve_areas(spark.createDataFrame(rows, "p double, y int"), "p", "y").first()
    assert got.roc_auc == pytest.approx(0.875)


def test_row_groups_are_bounded(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from cartloom.sources.writers import write_parquet

    write_parquet(spark.range(5000).coalesce(1), str(tmp_path / "t"), rows_per_group=1000)
    meta = pq.ParquetFile(glob.glob(str(tmp_path / "t" / "*.parquet"))[0]).metadata
    assert max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= 1000


def test_one_shared_folder(spark):
    from cartloom import runtime

    assert runtime.stored(spark.range(3)).count() == runtime.cut_lineage(spark.range(3)).count() == 3
    assert runtime.shared_folder(spark).removeprefix("file:") in spark.sparkContext.getCheckpointDir()


def test_short_sessions_and_flagged_rows(spark):
    from cartloom.operators.sequences import minimum_length

    df = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (3, 1)], "s int, test int")
    assert sorted(r.s for r in minimum_length(df, ["s"], 2, keep=F.col("test") == 1).collect()) == [1, 1, 3]


def test_fewer_rows_than_folds(spark):
    from cartloom.operators.splits import contiguous_folds

    assert sorted(r.fold for r in contiguous_folds(spark.range(3), ["id"], 5).collect()) == [0, 1, 2]


def test_a_day_without_neighbours_keeps_its_scores(spark):
    from cartloom.operators.blending import scale_day

    df = spark.createDataFrame([(1, 23, 2.0), (2, 0, 1.0), (2, 12, 3.0)], "d int, h int, s double")
    assert sorted(r.s for r in scale_day(df, "d", "h", "s", 2).collect()) == [2.0, 2.0, 6.0]
    assert sorted(r.s for r in scale_day(df.filter("d = 2"), "d", "h", "s", 2).collect()) == [1.0, 3.0]


def test_scratch_can_be_dropped(spark):
    import os

    from cartloom import runtime

    path = runtime.scratch_folder(spark)
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path.removeprefix("file:"))
    kept, runtime._scratch[:] = runtime._scratch[:-1], [path]
    runtime.drop_scratch(spark)
    runtime._scratch[:] = kept
    assert not os.path.exists(path.removeprefix("file:"))
