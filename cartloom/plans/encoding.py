"""Category codes, counts and target encodings."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from cartloom.functions import scalars as S
from cartloom.operators import daystate, fitted
from cartloom.operators import encoders as E
from cartloom.operators import sequences as Q
from cartloom.operators import splits
from cartloom.operators.aggregates import histogram
from cartloom.plans.registry import LINE_ORDER, big, query, rounded, text
from cartloom.runtime import SHARED_SHUFFLES, scratch_folder, stored

KEY = ["basket", "line", "item"]


@query("enc1_sorted_codes", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def _(t):
    return E.encode(t.part, E.vocabulary(t.part, "p_brand"), "p_brand", "code").select("p_partkey", "code")


@query("enc1_first_seen_codes", """
WITH f AS (SELECT event_type, min(event_id) AS first_id FROM events GROUP BY 1)
SELECT event_type AS value, row_number() OVER (ORDER BY first_id) - 1 AS code FROM f""")
def _(t):
    return E.vocabulary_by_first(t.events, "event_type", ["event_id"])


@query("enc2_joint_codes", """
WITH $LOG, v AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS code FROM (SELECT author AS id FROM log UNION SELECT reader FROM log))
SELECT basket, line, item, a.code AS author_code, r.code AS reader_code FROM log JOIN v a ON author = a.id JOIN v r ON reader = r.id""")
def _(t):
    log = t.log
    v = E.vocabulary(log, ["author", "reader"])
    coded = E.encode(E.encode(log, v, "author", "author_code"), v, "reader", "reader_code")
    return coded.select(*KEY, "author_code", "reader_code")


@query("enc3_frequency_threshold", """
WITH v AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) AS code FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 30))
SELECT l_orderkey, l_partkey, coalesce(code, 0) AS code FROM lineitem LEFT JOIN v USING (l_partkey)""")
def _(t):
    v = E.vocabulary(t.lineitem, "l_partkey", start=1, min_count=30)
    return E.encode(t.lineitem, v, "l_partkey", "code", 0).select("l_orderkey", "l_partkey", "code")


@query("enc4_unseen_to_zero", """
WITH v AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS code FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'))
SELECT o_orderkey, coalesce(code, 0) AS code FROM orders LEFT JOIN v USING (o_custkey)""")
def _(t):
    v = E.vocabulary(t.orders.filter("o_orderdate < timestamp_ntz'1996-01-01'"), "o_custkey", start=1)
    return E.encode(t.orders, v, "o_custkey", "code", 0).select("o_orderkey", "code")


@query("enc3_saved_model", """
WITH v AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) AS code FROM (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1 HAVING count(*) >= 5)),
 m AS (SELECT l_suppkey, sum(CAST(l_returnflag = 'R' AS INT)) AS s, count(*) AS c FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(code, 0) AS code, round(coalesce((s + 0.25 * 20) / (c + 20), 0.25), 6) AS te
FROM lineitem LEFT JOIN v USING (l_partkey) LEFT JOIN m USING (l_suppkey)""")
def _(t):
    rows = t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    stages = [fitted.Codes(inputCol="l_partkey", outputCol="code", minCount=5),
              fitted.TargetMeans(keys=["l_suppkey"], label="y", outputCol="te", prior=0.25, weight=20.0)]
    path = scratch_folder(t.spark)
    Pipeline(stages=stages).fit(rows.filter("l_shipdate < timestamp_ntz'1996-01-01'")).save(path)
    coded = PipelineModel.load(path).transform(rows)
    return coded.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "code", rounded("te"))


@query("enc5_extended_vocabulary", """
WITH v AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS code FROM (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01')),
 n AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM v))
SELECT id AS value, code FROM v UNION ALL SELECT id, (SELECT max(code) FROM v) + row_number() OVER (ORDER BY id) FROM n""")
def _(t):
    early = t.lineitem.filter("l_shipdate < timestamp_ntz'1995-06-01'")
    return E.extend_vocabulary(E.vocabulary(early, "l_partkey"), t.lineitem, "l_partkey")


@query("enc6_encoded_lists", """
WITH $LOG, v AS (SELECT author, dense_rank() OVER (ORDER BY author) AS code FROM (SELECT DISTINCT author FROM log)),
 r AS (SELECT basket, author, row_number() OVER (PARTITION BY basket ORDER BY $LINE_ORDER) - 1 AS b FROM log)
SELECT basket, b // 10000 AS chunk, string_agg(CAST(code AS VARCHAR), ',' ORDER BY b) AS codes FROM r JOIN v USING (author) GROUP BY ALL""")
def _(t):
    lists = Q.chunk_lists(t.log, ["basket"], LINE_ORDER, ["author"], Q.CHUNK)
    coded = E.encode_lists(lists, ["basket", "chunk"], "author_list", E.vocabulary(t.log, "author", start=1), "codes")
    return coded.select("basket", "chunk", text("codes"))


@query("enc7_most_frequent_token", """
WITH u AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)),
 n AS (SELECT tok, count(*) AS n FROM u GROUP BY tok),
 s AS (SELECT doc_id, tok, min(i) AS i FROM u GROUP BY doc_id, tok)
SELECT doc_id, tok AS token FROM (SELECT doc_id, tok, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS k FROM s JOIN n USING (tok)) WHERE k = 1""")
def _(t):
    return E.frequent_token(t.documents, ["doc_id"], "text", " ", "token").select("doc_id", "token")


@query("enc8_shared_rank_vocabulary", """
WITH u AS (SELECT l_suppkey AS value FROM lineitem UNION ALL SELECT l_partkey FROM lineitem UNION ALL SELECT CAST(l_linenumber AS BIGINT) FROM lineitem),
 c AS (SELECT value, count(*) AS n FROM u GROUP BY value)
SELECT value, n, row_number() OVER (ORDER BY n DESC, value) - 1 AS code FROM c""")
def _(t):
    three = t.lineitem.select("l_suppkey", "l_partkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return E.vocabulary_by_count(three, ["l_suppkey", "l_partkey", "l_linenumber"])


@query("enc9_words_by_frequency", """
WITH d AS (SELECT DISTINCT text FROM documents), c AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM d) GROUP BY word),
 k AS (SELECT * FROM c WHERE n > 2 AND n < 100000 AND word NOT IN ('', '[', ']', '.', '!', '@', '_', '#')),
 u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))
SELECT doc_id, count(*) AS n_words, md5(string_agg(word, ' ' ORDER BY n, i)) AS words FROM u JOIN k USING (word) GROUP BY doc_id""")
def _(t):
    counts = E.word_counts(t.documents, "text")
    words = E.words_by_frequency(t.documents, ["doc_id"], "text", counts)
    return words.select("doc_id", big(F.size("words"), "n_words"), F.md5(F.array_join("words", " ")).alias("words"))


@query("enc10_pair_count_share", """
SELECT l_suppkey, l_returnflag, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey), 6) AS share FROM lineitem GROUP BY 1, 2""")
def _(t):
    return E.pair_counts(t.lineitem, ["l_suppkey"], "l_returnflag").select("l_suppkey", "l_returnflag", "n", rounded("share"))


@query("enc11_count_encode", """
WITH a AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01') SELECT o_orderkey, n AS "CE_reader" FROM a
JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) USING (o_custkey)""")
def _(t):
    border = "timestamp_ntz'2000-01-01'"
    train, test = t.orders.filter(f"o_orderdate < {border}"), t.orders.filter(f"o_orderdate >= {border}")
    return E.count_encode(train, [test], ["o_custkey"], "CE_reader").select("o_orderkey", "CE_reader")


@query("enc12_frequency_encode", """
WITH s AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS split FROM orders)
SELECT o_orderkey, split, round(count(*) OVER (PARTITION BY split, o_custkey) / count(*) OVER (PARTITION BY split), 9) AS fe FROM s""")
def _(t):
    split = F.when(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"), "train").otherwise("test")
    coded = E.frequency_encode(t.orders.withColumn("split", split), "split", ["o_custkey"], "fe")
    return coded.select("o_orderkey", "split", rounded("fe", digits=9))


_SETS = [["reader"], ["author"], ["item"], ["kind"], ["reader", "author"], ["reader", "kind"], ["author", "kind"],
         ["author", "item"], ["item", "kind"], ["reader", "status"]]
_JOINS = "".join(f" LEFT JOIN (SELECT {', '.join(k)}, count(*) AS n{i} FROM te GROUP BY ALL) USING ({', '.join(k)})" for i, k in enumerate(_SETS))


@query("enc13_count_maps", "WITH $LOG, te AS (SELECT * FROM log WHERE posted >= TIMESTAMP '2000-01-01') SELECT basket, line, item, "
       + ", ".join(f"coalesce(n{i}, 1) AS cnt_{'_'.join(k)}" for i, k in enumerate(_SETS)) + " FROM log" + _JOINS, {SHARED_SHUFFLES: "false"})
def _(t):
    log = stored(t.log.select(*dict.fromkeys([*KEY, "posted", *(c for k in _SETS for c in k)])), t.log)
    maps = E.count_maps(log.filter("posted >= timestamp_ntz'2000-01-01'"), _SETS)
    return E.attach_counts(log, maps).select(*KEY, *["cnt_" + "_".join(k) for k in _SETS])


@query("enc14_supported_map", """
WITH $LOG SELECT item, CAST(sum(y) AS BIGINT) AS y_sum, count(*) AS te_count FROM log GROUP BY item HAVING count(*) > 30""")
def _(t):
    return E.fit_target(t.log, ["item"], ["y"], min_count=30)


def _fold_sql(keys: str, folds: int, smooth: int, target: str = "y") -> str:
    """Every fold encoded from the rows of the other folds, spelt out."""
    return f"""
WITH $LOG, f AS (SELECT *, basket % {folds} AS fold FROM log), k AS (SELECT unnest(range({folds})) AS fold),
 o AS (SELECT k.fold, {keys}, sum({target}) AS s, count({target}) AS c FROM k JOIN f ON f.fold <> k.fold GROUP BY ALL),
 p AS (SELECT avg({target}) AS m FROM f)
SELECT basket, line, item, round(CASE WHEN c > 0 THEN (s + m * {smooth}) / (c + {smooth}) ELSE m END, 6) AS te
FROM f LEFT JOIN o USING (fold, {keys}), p"""


def _with_fold(t, folds):
    return t.log.withColumn("fold", splits.modulo(F.col("basket"), folds))


@query("enc15_unsmoothed_folds", _fold_sql("author", 8, 0))
def _(t):
    return E.target_encode(_with_fold(t, 8), ["author"], "y", "fold", 0, "te").select(*KEY, rounded("te"))


@query("enc15_test_from_train", """
WITH $LOG, a AS (SELECT author, sum(y) AS s, count(*) AS c FROM log WHERE posted < TIMESTAMP '2000-01-01' GROUP BY 1),
 p AS (SELECT sum(s) / sum(c) AS m FROM a)
SELECT basket, line, item, round(coalesce((s + 20 * m) / (c + 20), m), 6) AS te FROM log LEFT JOIN a USING (author), p WHERE posted >= TIMESTAMP '2000-01-01'""")
def _(t):
    train, test = t.log.filter("posted < timestamp_ntz'2000-01-01'"), t.log.filter("posted >= timestamp_ntz'2000-01-01'")
    return E.encode_unseen(test, train, ["author"], "y", 20, "te").select(*KEY, rounded("te"))


@query("enc16_contiguous_folds_pooled", """
WITH r AS (SELECT o_orderkey, o_custkey, CAST(o_orderstatus = 'F' AS INT) AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () // 5 AS size FROM orders),
 f AS (SELECT *, least(i // size, 4) AS fold FROM r), k AS (SELECT unnest(range(5)) AS fold),
 c AS (SELECT k.fold, o_custkey, count(*) AS n FROM k JOIN f ON f.fold <> k.fold GROUP BY ALL),
 g AS (SELECT k.fold, CASE WHEN n <= 8 THEN -1 ELSE f.o_custkey END AS id, y FROM k JOIN f ON f.fold <> k.fold JOIN c ON c.fold = k.fold AND c.o_custkey = f.o_custkey),
 e AS (SELECT fold, id, sum(y) AS s, count(*) AS c FROM g GROUP BY ALL), p AS (SELECT fold, avg(y) AS m FROM g GROUP BY fold)
SELECT o_orderkey, f.fold AS fold, round(coalesce((e.s + m * 20) / (e.c + 20), m), 6) AS te
FROM f LEFT JOIN c ON c.fold = f.fold AND c.o_custkey = f.o_custkey LEFT JOIN e ON e.fold = f.fold AND e.id = CASE WHEN n <= 8 THEN -1 ELSE f.o_custkey END JOIN p ON p.fold = f.fold""")
def _(t):
    rows = t.orders.withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    folded = splits.contiguous_folds(rows, ["o_orderkey"], 5)
    coded = E.target_encode(folded, ["o_custkey"], "y", "fold", 20, "te", fold_prior=True, min_count=8)
    return coded.select("o_orderkey", big("fold"), rounded("te"))


@query("enc17_kfold_target_mean", _fold_sql("author", 5, 20))
def _(t):
    return E.target_encode(_with_fold(t, 5), ["author"], "y", "fold", 20, "te").select(*KEY, rounded("te"))


# Target means by keys of 5, 3, 66 and customers many values, for timing alike encodings.
@query("enc17_by_5_values", _fold_sql("kind", 5, 20))
def _(t):
    return E.target_encode(_with_fold(t, 5), ["kind"], "y", "fold", 20, "te").select(*KEY, rounded("te"))


@query("enc17_by_3_values", _fold_sql("status", 5, 20))
def _(t):
    return E.target_encode(_with_fold(t, 5), ["status"], "y", "fold", 20, "te").select(*KEY, rounded("te"))


@query("enc17_by_66_values", _fold_sql("language", 5, 20).replace("SELECT *, basket", "SELECT *, item % 66 AS language, basket"))
def _(t):
    rows = _with_fold(t, 5).withColumn("language", F.pmod("item", F.lit(66)))
    return E.target_encode(rows, ["language"], "y", "fold", 20, "te").select(*KEY, rounded("te"))


@query("enc17_by_user", _fold_sql("reader", 5, 20))
def _(t):
    return E.target_encode(_with_fold(t, 5), ["reader"], "y", "fold", 20, "te").select(*KEY, rounded("te"))


@query("enc18_multi_key_target_mean", _fold_sql("author, kind", 5, 20))
def _(t):
    return E.target_encode(_with_fold(t, 5), ["author", "kind"], "y", "fold", 20, "te").select(*KEY, rounded("te"))


@query("enc19_continuous_target", """
WITH $LOG, f AS (SELECT *, basket % 5 AS fold, CASE WHEN y = 1 THEN date_diff('day', posted, ship) END AS days FROM log),
 k AS (SELECT unnest(range(5)) AS fold), o AS (SELECT k.fold, reader, sum(days) AS s, count(days) AS c FROM k JOIN f ON f.fold <> k.fold GROUP BY ALL),
 p AS (SELECT sum(days) / count(days) AS m FROM f)
SELECT basket, line, item, round(CASE WHEN c > 0 THEN (s + m * 20) / (c + 20) ELSE m END, 5) AS te FROM f LEFT JOIN o USING (fold, reader), p""")
def _(t):
    days = F.when(F.col("y") == 1, F.datediff("ship", "posted"))
    rows = _with_fold(t, 5).withColumn("days", days)
    return E.target_encode(rows, ["reader"], "days", "fold", 20, "te").select(*KEY, rounded("te", digits=5))


_DAYS = "e AS (SELECT event_id, event_type, CAST(value > 40 AS INT) AS y, CAST(day(ts) AS INT) AS d FROM events)"


@query("enc20_daily_target_mean", f"""
WITH {_DAYS}, m AS (SELECT DISTINCT least(d, 25) AS d FROM e),
 h AS (SELECT m.d, event_type, sum(y) AS s, count(*) AS c FROM m JOIN e ON e.d < m.d GROUP BY ALL), p AS (SELECT m.d, avg(y) AS mean FROM m JOIN e ON e.d < m.d GROUP BY ALL)
SELECT event_id, round((s + mean * 10) / (c + 10), 6) AS te FROM (SELECT *, least(d, 25) AS dd FROM e) q
LEFT JOIN h ON h.d = dd AND h.event_type = q.event_type LEFT JOIN p ON p.d = dd""")
def _(t):
    rows = t.events.select("event_id", "event_type", (F.col("value") > 40).cast("int").alias("y"), F.dayofmonth("ts").alias("d"))
    return E.daily_target_encode(rows, ["event_type"], "y", "d", 10, "te", held_out=25).select("event_id", rounded("te"))


@query("enc20_appended_days", f"""
WITH {_DAYS}, m AS (SELECT DISTINCT d FROM e),
 h AS (SELECT m.d, event_type, sum(y) AS s, count(*) AS c FROM m JOIN e ON e.d < m.d GROUP BY ALL), p AS (SELECT m.d, avg(y) AS mean FROM m JOIN e ON e.d < m.d GROUP BY ALL)
SELECT event_id, round((s + mean * 10) / (c + 10), 6) AS te FROM e LEFT JOIN h USING (d, event_type) LEFT JOIN p USING (d)""")
def _(t):
    rows = t.events.select("event_id", "event_type", (F.col("value") > 40).cast("int").alias("y"), F.dayofmonth("ts").alias("d"))
    store = daystate.DayStore(t.spark, scratch_folder(t.spark))
    # Three deliveries, of which the second brings days 8 to 10 once more.
    for low, high in ((1, 10), (8, 20), (21, 31)):
        store.put(daystate.daily_sums(rows.filter(F.col("d").between(low, high)), ["event_type"], ["y"], "d"), range(low, high + 1))
    return daystate.encode_from_days(rows, store.table(), ["event_type"], "y", "d", 10, "te").select("event_id", rounded("te"))


@query("enc20_first_day_from_later", f"""
WITH {_DAYS}, h AS (SELECT m.d, event_type, sum(y) AS s, count(*) AS c FROM (SELECT DISTINCT d FROM e) m JOIN e ON (m.d > 1 AND e.d < m.d) OR (m.d = 1 AND e.d BETWEEN 2 AND 6) GROUP BY ALL)
SELECT event_id, round((s + 1) / (c + 1), 6) AS te FROM e LEFT JOIN h USING (d, event_type)""")
def _(t):
    rows = t.events.select("event_id", "event_type", (F.col("value") > 40).cast("int").alias("y"), F.dayofmonth("ts").alias("d"))
    coded = E.daily_target_encode(rows, ["event_type"], "y", "d", 1, "te", first_from=(1, 2, 6), method=1)
    return coded.select("event_id", rounded("te"))


# Fixed values of these queries: label rates assumed at apply time.
_PRIORS = {"y": 0.33, "z": 0.5}


@query("enc21_merged_maps", """
WITH $LOG, m AS (SELECT author, sum(y) AS ys, sum(z) AS zs, count(*) AS c FROM log GROUP BY author)
SELECT basket, line, item, round((ys + 0.33 * 20) / (c + 20), 6) AS te_y, round((zs + 0.5 * 20) / (c + 20), 6) AS te_z FROM log JOIN m USING (author)""")
def _(t):
    log = t.log
    early, late = log.filter("posted < timestamp_ntz'1998-01-01'"), log.filter("posted >= timestamp_ntz'1998-01-01'")
    table = E.merge_target([E.fit_target(p, ["author"], ["y", "z"]) for p in (early, late)], ["author"], ["y", "z"])
    return E.apply_target(log, table, ["author"], _PRIORS, 20, "te").select(*KEY, rounded("te_y"), rounded("te_z"))


@query("enc22_leave_one_out", """
WITH $LOG, l AS (SELECT *, CAST(posted < TIMESTAMP '2000-01-01' AS INT) AS tr FROM log), m AS (SELECT author, kind, sum(y) AS s, count(*) AS c FROM l WHERE tr = 1 GROUP BY ALL)
SELECT basket, line, item, round(coalesce((s - y * tr + 0.33 * 20) / (c - tr + 20), 0.33), 6) AS te_y FROM l LEFT JOIN m USING (author, kind)""")
def _(t):
    in_train = F.col("posted") < F.lit("2000-01-01").cast("timestamp_ntz")
    table = E.fit_target(t.log.filter(in_train), ["author", "kind"], ["y"])
    coded = E.apply_target(t.log, table, ["author", "kind"], {"y": 0.33}, 20, "te", in_train=in_train)
    return coded.select(*KEY, rounded("te_y"))


@query("enc23_support_and_rounding", """
WITH $LOG, m AS (SELECT item, sum(y) AS ys, sum(z) AS zs, count(*) AS c FROM log GROUP BY item)
SELECT basket, line, item, round(CASE WHEN c > 30 THEN (ys - y + 0.33 * 20) / (c - 1 + 20) ELSE 0.33 END, 3) AS te_y, round((zs - z + 0.5 * 20) / (c - 1 + 20), 3) AS te_z
FROM log JOIN m USING (item)""")
def _(t):
    table = E.fit_target(t.log, ["item"], ["y", "z"])
    coded = E.apply_target(t.log, table, ["item"], _PRIORS, 20, "te", in_train=F.lit(True), least_support={"y": 30}, digits=3)
    return coded.select(*KEY, "te_y", "te_z")


@query("enc24_map_on_second_column", """
WITH $LOG, m AS (SELECT author AS id, sum(y) AS s, count(*) AS c FROM log GROUP BY author)
SELECT basket, line, item, round((a.s + 0.33 * 20) / (a.c + 20), 6) AS own_y, round(coalesce((b.s + 0.33 * 20) / (b.c + 20), 0.33), 6) AS other_y
FROM log LEFT JOIN m a ON a.id = author LEFT JOIN m b ON b.id = reader""")
def _(t):
    table = E.fit_target(t.log, ["author"], ["y"])
    own = E.apply_target(t.log, table, ["author"], {"y": 0.33}, 20, "own")
    both = E.apply_target(own, table, {"reader": "author"}, {"y": 0.33}, 20, "other")
    return both.select(*KEY, rounded("own_y"), rounded("other_y"))


@query("enc25_positional_columns", """
WITH w AS (SELECT user_id, event_id, event_type, CAST(value > 40 AS INT) AS y, lag(event_type, 1, 'none') OVER p AS p0, lag(event_type, 2, 'none') OVER p AS p1, event_id % 5 AS fold
  FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT unnest(range(5)) AS fold), g AS (SELECT avg(y) AS m FROM w),
 a AS (SELECT k.fold, p0, sum(y) AS s, count(*) AS c FROM k JOIN w ON w.fold <> k.fold GROUP BY ALL), b AS (SELECT k.fold, p1, sum(y) AS s, count(*) AS c FROM k JOIN w ON w.fold <> k.fold GROUP BY ALL)
SELECT event_id, round((a.s + 20 * m) / (a.c + 20), 6) AS te_p0, round((b.s + 20 * m) / (b.c + 20), 6) AS te_p1
FROM w JOIN a ON a.fold = w.fold AND a.p0 = w.p0 JOIN b ON b.fold = w.fold AND b.p1 = w.p1, g""")
def _(t):
    from cartloom.operators.history import lags

    rows = lags(t.events, ["user_id"], ["ts", "event_id"], "event_type", [1, 2], "none")
    rows = rows.withColumns({"y": (F.col("value") > 40).cast("int"), "fold": F.pmod("event_id", F.lit(5))})
    for i in (0, 1):
        rows = E.target_encode(rows, [f"event_type_lag{i + 1}"], "y", "fold", 20, f"te_p{i}")
    return rows.select("event_id", rounded("te_p0"), rounded("te_p1"))


@query("enc26_difference", """
SELECT event_id, round(coalesce(value - lag(value) OVER w, 0), 6) AS de_prev, round(coalesce(value - lead(value) OVER w, 0), 6) AS de_next
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(t):
    moved = E.differences(t.events, ["user_id"], ["ts", "event_id"], "value", {"de_prev": 1, "de_next": -1})
    return moved.select("event_id", rounded("de_prev"), rounded("de_next"))


@query("enc27_positive_pairs", """
WITH $LOG SELECT author, reader, CAST(sum(y) AS BIGINT) AS y_sum, CAST(sum(z) AS BIGINT) AS z_sum, count(*) AS n FROM log WHERE y > 0 OR z > 0 GROUP BY 1, 2""")
def _(t):
    return E.positive_pairs(t.log, "author", "reader", ["y", "z"])


@query("enc28_multi_hot", """
SELECT p_partkey, CAST(list_contains(string_split(p_name, ' '), 'red') AS INT) AS is_red, CAST(list_contains(string_split(p_name, ' '), 'widget') AS INT) AS is_widget,
 CAST(list_contains(string_split(p_name, ' '), 'ring') AS INT) AS is_ring FROM part""")
def _(t):
    return E.multi_hot(t.part, "p_name", " ", ["red", "widget", "ring"]).select("p_partkey", "is_red", "is_widget", "is_ring")


@query("enc29_ternary_combination", """
WITH f AS (SELECT c_custkey, c_nationkey % 3 - 1 AS f0, CAST(c_acctbal > 5000 AS INT) - CAST(c_acctbal < 0 AS INT) AS f1, c_custkey % 3 - 1 AS f2, CAST(c_mktsegment = 'MACHINERY' AS INT) AS f3, c_custkey % 2 AS f4, -(c_nationkey % 2) AS f5 FROM customer),
 m AS (SELECT c_custkey, (f0+1) + (f1+1)*3 + (f2+1)*9 + (f3+1)*27 + (f4+1)*81 + (f5+1)*243 AS mix FROM f)
SELECT c_custkey, CAST(mix AS BIGINT) AS mix, dense_rank() OVER (ORDER BY mix) - 1 AS code FROM m""")
def _(t):
    c = F.col
    flags = [c("c_nationkey") % 3 - 1, (c("c_acctbal") > 5000).cast("int") - (c("c_acctbal") < 0).cast("int"), c("c_custkey") % 3 - 1,
             (c("c_mktsegment") == "MACHINERY").cast("int"), c("c_custkey") % 2, -(c("c_nationkey") % 2)]
    mixed = t.customer.select("c_custkey", big(S.ternary_code(*flags), "mix"))
    return E.encode(mixed, E.vocabulary(mixed, "mix"), "mix", "code")


@query("enc30_collapse_rare", """
WITH w AS (SELECT event_id, props, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
 r AS (SELECT props FROM events GROUP BY 1 HAVING count(*) <= 95)
SELECT event_id, CASE WHEN props IN (SELECT props FROM r) THEN 'other' ELSE props END AS city, CASE WHEN prev IN (SELECT props FROM r) THEN 'other' ELSE prev END AS prev_city FROM w""")
def _(t):
    from cartloom.operators.history import lags

    rows = lags(t.events, ["user_id"], ["ts", "event_id"], "props", [1])
    out = E.collapse_rare(rows, "props", 95, "other", "city", also=["props_lag1"])
    return out.select("event_id", "city", F.col("props_lag1_city").alias("prev_city"))


@query("enc31_capped_lists", """
WITH $LOG, r AS (SELECT basket, item, row_number() OVER (PARTITION BY basket ORDER BY $LINE_ORDER) - 1 AS b FROM log),
 c AS (SELECT item, count(*) AS n FROM log GROUP BY item)
SELECT basket, b // 10000 AS chunk, string_agg(CAST(CASE WHEN n >= 30 THEN item ELSE 1 END AS VARCHAR), ',' ORDER BY b) AS capped, string_agg(CASE WHEN n >= 30 THEN '2' ELSE '1' END, ',' ORDER BY b) AS flags
FROM r JOIN c USING (item) GROUP BY ALL""")
def _(t):
    lists = Q.chunk_lists(t.log, ["basket"], LINE_ORDER, ["item"], Q.CHUNK)
    capped = E.cap_list_frequency(lists, ["basket", "chunk"], "item_list", 30)
    return capped.select("basket", "chunk", text("capped"), text("capped_flags", "flags"))


@query("enc32_supported_users", """
WITH a AS (SELECT l_suppkey AS id, count(*) AS na FROM lineitem GROUP BY 1), b AS (SELECT o_custkey AS id, count(*) AS nb FROM orders GROUP BY 1),
 j AS (SELECT id, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM a FULL JOIN b USING (id))
SELECT id, row_number() OVER (ORDER BY id) AS code FROM j WHERE na >= 600 OR nb >= 12""")
def _(t):
    a = histogram(t.lineitem.withColumnRenamed("l_suppkey", "id"), ["id"], "na")
    b = histogram(t.orders.withColumnRenamed("o_custkey", "id"), ["id"], "nb")
    return E.supported_ids(a, b, "id", (F.col("na") >= 600) | (F.col("nb") >= 12)).select("id", "code")


@query("enc33_cardinalities", """
SELECT 'l_partkey' AS "column", max(l_partkey) + 1 AS cardinality FROM lineitem UNION ALL SELECT 'l_suppkey', max(l_suppkey) + 1 FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(max(l_linenumber) + 1 AS BIGINT) FROM lineitem""")
def _(t):
    return E.cardinalities(t.lineitem, ["l_partkey", "l_suppkey", "l_linenumber"])


@query("enc34_inverse_lookup", "SELECT p_partkey, p_brand AS brand FROM part")
def _(t):
    v = E.vocabulary(t.part, "p_brand")
    coded = E.encode(t.part, v, "p_brand", "code")
    return E.decode(coded.select("p_partkey", "code"), v, "code", "brand").select("p_partkey", "brand")
