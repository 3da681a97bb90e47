"""Filters, null handling, scaling, row identity."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from cartloom.functions import scalars as S
from cartloom.functions import timeparts as D
from cartloom.operators import clean, fitted, rows
from cartloom.plans.registry import LINE_ORDER, big, query, rounded, text
from cartloom.runtime import scratch_folder


@query("prj1_select_rename_tag", """
SELECT o_orderkey AS id, o_custkey AS reader, 'orders' AS source, 0 AS istest FROM orders""")
def _(t):
    named = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("reader"))
    return clean.tag(named, source="orders", istest=0)


@query("prj2_compound_filter", """
SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
WHERE l_returnflag = 'R' AND l_shipdate IS NOT NULL AND (l_discount > 0.05 OR l_quantity < 10)""")
def _(t):
    keep = (F.col("l_returnflag") == "R") & F.col("l_shipdate").isNotNull() & (
        (F.col("l_discount") > 0.05) | (F.col("l_quantity") < 10))
    return t.lineitem.filter(keep).select("l_orderkey", "l_partkey", "l_quantity")


@query("prj3_sessions_with_purchase", """
WITH e AS (SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events)
SELECT event_id, user_id, day FROM e
WHERE (user_id, day) IN (SELECT (user_id, day) FROM e WHERE event_type = 'purchase')""")
def _(t):
    e = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    kept = clean.keep_groups_with(e, ["user_id", "day"], F.col("event_type") == "purchase")
    return kept.select("event_id", "user_id", "day")


@query("prj4_overlapping_readers", """
WITH a AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
     b AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')
SELECT o_orderkey AS id, 'early' AS side FROM a WHERE o_custkey IN (SELECT o_custkey FROM b)
UNION ALL SELECT o_orderkey, 'late' FROM b WHERE o_custkey IN (SELECT o_custkey FROM a)""")
def _(t):
    early = t.orders.filter("o_orderdate < timestamp_ntz'1996-01-01'")
    late = t.orders.filter("o_orderdate >= timestamp_ntz'2000-01-01'")
    a, b = clean.keep_overlap(early, late, "o_custkey")
    pick = lambda df, side: df.select(F.col("o_orderkey").alias("id"), F.lit(side).alias("side"))
    return pick(a, "early").unionByName(pick(b, "late"))


@query("prj5_fill_constants", """
SELECT event_id, coalesce(nullif(event_type, 'error'), 'missing') AS kind,
       coalesce(CASE WHEN event_type <> 'signup' THEN value END, 0.0) AS value,
       CASE WHEN event_type = 'click' THEN 'missing' ELSE event_type || ',' || props END AS tags
FROM events""")
def _(t):
    tags = F.when(F.col("event_type") != "click", F.array("event_type", "props"))
    return t.events.select(
        "event_id",
        S.fill(S.sentinel_to_null(F.col("event_type"), "error"), "missing").alias("kind"),
        S.fill(F.when(F.col("event_type") != "signup", F.col("value")), 0.0).alias("value"),
        text(S.fill_list(tags), "tags"),
    )


@query("prj6_fill_upper_median", """
WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events),
     m AS (SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n
                          FROM e WHERE v IS NOT NULL) WHERE i = n // 2 + 1)
SELECT event_id, round(coalesce(v, (SELECT v FROM m)), 6) AS v, CAST(v IS NULL AS INT) AS v_na FROM e""")
def _(t):
    e = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return clean.fill_fitted(e, e, "v", "median").select("event_id", rounded("v"), "v_na")


@query("prj6_fill_mode", """
WITH e AS (SELECT event_id, nullif(event_type, 'error') AS kind FROM events),
     m AS (SELECT kind FROM e WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)
SELECT event_id, coalesce(kind, (SELECT kind FROM m)) AS kind, CAST(kind IS NULL AS INT) AS kind_na FROM e""")
def _(t):
    e = t.events.select("event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("kind"))
    clean.check_no_new_nulls(e, e, ["kind"])
    return clean.fill_fitted(e, e, "kind", "mode")


@query("prj7_fill_median", """
WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)
SELECT event_id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM e)), 6) AS v FROM e""")
def _(t):
    e = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return clean.fill_fitted(e, e, "v", "middle", indicator=False).select("event_id", rounded("v"))


@query("prj8_surrogate_id", """
SELECT event_id, coalesce(CASE WHEN event_type IN ('click', 'purchase') THEN event_type END, props) AS item FROM events""")
def _(t):
    item = F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type"))
    return t.events.select("event_id", F.coalesce(item, "props").alias("item"))


_MARKS = """e AS (SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'R' THEN epoch_us(l_shipdate) // 1000000 END AS reply,
  CASE WHEN l_linestatus = 'F' THEN epoch_us(l_shipdate) // 1000000 END AS retweet,
  CASE WHEN l_discount > 0.05 THEN epoch_us(l_shipdate) // 1000000 ELSE 0 END AS comment,
  CASE WHEN l_tax > 0.04 THEN epoch_us(l_shipdate) // 1000000 END AS "like" FROM lineitem)"""


def _marks(t):
    at = D.seconds(F.col("l_shipdate"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"),
        F.when(F.col("l_returnflag") == "R", at).alias("reply"),
        F.when(F.col("l_linestatus") == "F", at).alias("retweet"),
        F.when(F.col("l_discount") > 0.05, at).otherwise(0).alias("comment"),
        F.when(F.col("l_tax") > 0.04, at).alias("like"),
    )


@query("prj9_binary_labels", f"""
WITH {_MARKS}, f AS (SELECT id, CAST(coalesce(reply > 0, false) AS INT) AS reply, CAST(coalesce(retweet > 0, false) AS INT) AS retweet,
  CAST(coalesce(comment > 0, false) AS INT) AS comment, CAST(coalesce("like" > 0, false) AS INT) AS "like" FROM e)
SELECT *, greatest(reply, retweet, comment, "like") AS engage FROM f""")
def _(t):
    labels = [F.col(c) for c in ("reply", "retweet", "comment", "like")]
    flags = [S.flag(c).alias(n) for c, n in zip(labels, ("reply", "retweet", "comment", "like"))]
    return _marks(t).select("id", *flags, S.any_flag(*labels).alias("engage"))


@query("prj10_label_bits", f"""
WITH {_MARKS} SELECT id, CAST(coalesce(reply > 0, false) AS INT) + 2 * CAST(coalesce(retweet > 0, false) AS INT)
 + 4 * CAST(coalesce(comment > 0, false) AS INT) + 8 * CAST(coalesce("like" > 0, false) AS INT) AS code FROM e""")
def _(t):
    return _marks(t).select("id", S.bit_code(*[S.flag(F.col(c)) for c in ("reply", "retweet", "comment", "like")]).alias("code"))


@query("prj11_narrow_integers", """
WITH m AS (SELECT max(o_orderkey) AS a, max(o_custkey) AS b, max(l) AS c FROM orders, (SELECT max(l_linenumber) AS l FROM lineitem)),
     u AS (SELECT unnest([a, b, c]) AS hi, unnest(['o_orderkey', 'o_custkey', 'l_linenumber']) AS "column" FROM m)
SELECT "column", CASE WHEN hi < 128 THEN 'tinyint' WHEN hi < 32768 THEN 'smallint' WHEN hi < 2147483648 THEN 'int' ELSE 'bigint' END AS kind FROM u""")
def _(t):
    a = clean.narrow_integers(t.orders, ["o_orderkey", "o_custkey"])
    b = clean.narrow_integers(t.lineitem, ["l_linenumber"])
    kind = lambda df, c: df.agg(F.lit(c).alias("column"), F.max(F.typeof(c)).alias("kind"))
    return kind(a, "o_orderkey").unionByName(kind(a, "o_custkey")).unionByName(kind(b, "l_linenumber"))


@query("prj12_halve_widths", """
SELECT CAST(event_id AS INT) AS event_id, CAST(user_id AS INT) AS user_id,
       round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS value FROM events""")
def _(t):
    return clean.halve_widths(t.events.select("event_id", "user_id", "value")).withColumn("value", rounded("value"))


@query("prj13_static_codes", """
SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS code FROM events""")
def _(t):
    return clean.recode(t.events, "event_type", {"view": 1, "click": 2, "purchase": 3}, "code").select("event_id", "code")


@query("prj14_media_pair", "SELECT p_partkey, replace(p_name, ' ', '_') AS pair FROM part")
def _(t):
    tabbed = F.concat(F.replace("p_name", F.lit(" "), F.lit("\t")), F.lit("\tGIF"))
    return t.part.select("p_partkey", S.media_pair(tabbed).alias("pair"))


@query("prj15_clip", "SELECT l_orderkey, l_partkey, least(greatest(l_quantity, 5), 40) AS qty FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey", S.clip(F.col("l_quantity"), 5.0, 40.0).alias("qty"))


@query("prj16_quantise", """
SELECT vec, CAST(trunc(p * 255 - 128) AS INT) AS byte8, CAST(trunc(p * 65535 - 32768) AS INT) AS short16
FROM (SELECT event_id AS vec, (event_id * 37 % 1001) / 1000 AS p FROM events)""")
def _(t):
    p = F.pmod(F.col("event_id") * 37, F.lit(1001)) / 1000
    return t.events.select(F.col("event_id").alias("vec"), S.quantise(p).cast("int").alias("byte8"),
                           S.quantise(p, 16).cast("int").alias("short16"))


@query("prj17_account_age_byte", """
WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE 1138308613 + c_custkey * 400 END AS born FROM customer),
 s AS (SELECT c_custkey, trunc(240 * (CASE WHEN born < 0 THEN 1138308613 ELSE born END - 1138308613) / 691387.0 - 127) AS v FROM a)
SELECT c_custkey, CAST(((CAST(v AS BIGINT) + 128) % 256 + 256) % 256 - 128 AS INT) AS age FROM s""")
def _(t):
    born = F.when(F.col("c_custkey") % 7 == 0, -1).otherwise(F.col("c_custkey") * 400 + 1138308613)
    return t.customer.select("c_custkey", S.account_age_byte(born).cast("int").alias("age"))


@query("prj18_divide_buckets", """
SELECT o_orderkey, CAST(floor(o_totalprice / 819) AS BIGINT) AS a, CAST(floor(o_totalprice / 7.19) AS BIGINT) AS b FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", S.bucket(F.col("o_totalprice"), 819).alias("a"), S.bucket(F.col("o_totalprice"), 7.19).alias("b"))


@query("prj19_threshold_groups", """
SELECT c_custkey, CAST(c_acctbal >= 222 AS INT) + CAST(c_acctbal >= 578 AS INT) + CAST(c_acctbal >= 1225 AS INT) + CAST(c_acctbal >= 3689 AS INT) AS g,
 CAST(c_acctbal > 92 AS INT) + CAST(c_acctbal > 216 AS INT) + CAST(c_acctbal > 442 AS INT) + CAST(c_acctbal > 1064 AS INT) AS g_low FROM customer""")
def _(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", S.threshold_group(b, S.FOLLOWER_CUTS).alias("g"),
                             S.threshold_group(b, S.FOLLOWER_CUTS_LOW, inclusive=False).alias("g_low"))


@query("prj20_guarded_ratios", """
SELECT l_orderkey, l_partkey, round(l_extendedprice / (1 + l_quantity), 9) AS guarded,
       round(l_extendedprice / nullif(l_discount, 0), 4) AS plain FROM lineitem""")
def _(t):
    p = F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_partkey", rounded(S.ratio(p, F.col("l_quantity"), 1), "guarded", 9),
                             rounded(S.ratio(p, F.col("l_discount")), "plain", 4))


@query("prj21_signed_log", """
SELECT c_custkey, round(ln(1 + abs(c_acctbal)) * sign(c_acctbal), 6) AS signed_log FROM customer""")
def _(t):
    return t.customer.select("c_custkey", rounded(S.signed_log1p(F.col("c_acctbal")), "signed_log"))


@query("prj22_centre", """
SELECT event_id, round((value - (SELECT avg(value) FROM events)) / 10, 6) AS v FROM events""")
def _(t):
    return clean.centre(t.events, "value", "v", 10).select("event_id", rounded("v"))


@query("prj23_standardise", """
WITH m AS (SELECT avg(value) AS a, stddev_samp(value) AS s FROM events WHERE ts < TIMESTAMP '2024-01-20')
SELECT event_id, round((value - (SELECT a FROM m)) / ((SELECT s FROM m) + 1e-7), 6) AS value FROM events""")
def _(t):
    train = t.events.filter("ts < timestamp_ntz'2024-01-20'")
    return clean.standardise(t.events, train, {"value": F.col("value")}).select("event_id", rounded("value"))


@query("prj23_saved_model", """
WITH e AS (SELECT event_id, ts, CASE WHEN event_type <> 'error' THEN value END AS v FROM events), t AS (SELECT v FROM e WHERE ts < TIMESTAMP '2024-01-20'),
 f AS (SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM t WHERE v IS NOT NULL) WHERE i = n // 2 + 1),
 m AS (SELECT avg(coalesce(v, (SELECT v FROM f))) AS a, stddev_samp(coalesce(v, (SELECT v FROM f))) AS s FROM t)
SELECT event_id, CAST(v IS NULL AS INT) AS v_na, round((coalesce(v, (SELECT v FROM f)) - (SELECT a FROM m)) / ((SELECT s FROM m) + 1e-7), 6) AS v FROM e""")
def _(t):
    e = t.events.select("event_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    path = scratch_folder(t.spark)
    stages = [fitted.Filled(inputCol="v"), fitted.Scores(inputCols=["v"])]
    Pipeline(stages=stages).fit(e.filter("ts < timestamp_ntz'2024-01-20'")).save(path)
    return PipelineModel.load(path).transform(e).select("event_id", "v_na", rounded("v"))


@query("prj24_log_standardise", """
WITH m AS (SELECT avg(ln(1 + value)) AS a, stddev_samp(ln(1 + value)) AS s FROM events)
SELECT event_id, round((ln(1 + value) - (SELECT a FROM m)) / (SELECT s FROM m), 6) AS value FROM events""")
def _(t):
    return clean.log_standardise(t.events, t.events, {"value": F.col("value")}).select("event_id", rounded("value"))


_STATS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, round(avg(ln(1 + abs({c}))), 6) AS log_mean,
 round(stddev_samp(ln(1 + abs({c}))), 6) AS log_std, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM lineitem"""
    for c in ("l_quantity", "l_discount", "l_linenumber"))


@query("prj25_column_statistics", _STATS)
def _(t):
    s = clean.column_statistics(t.lineitem, ["l_quantity", "l_discount", "l_linenumber"])
    return s.select("column", rounded("mean", digits=5), rounded("std", digits=5), rounded("log_mean"), rounded("log_std"), "low", "high")


@query("prj26_sentinel_to_null", "SELECT l_orderkey, l_partkey, nullif(l_discount, 0) AS discount FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey", S.sentinel_to_null(F.col("l_discount"), 0.0).alias("discount"))


@query("prj27_min_max", """
WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT event_id, round((value - (SELECT lo FROM m)) / ((SELECT hi FROM m) - (SELECT lo FROM m)), 6) AS value FROM events""")
def _(t):
    return clean.min_max_scale(t.events, t.events, ["value"]).select("event_id", rounded("value"))


# --- row identity -----------------------------------------------------------

@query("row1_dense_ids", """
WITH u AS (SELECT 'train' AS source, 0 AS p, event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-20'
 UNION ALL SELECT 'test', 1, event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20')
SELECT source, event_id, row_number() OVER (ORDER BY p, ts, event_id) - 1 AS row_id FROM u""")
def _(t):
    train = t.events.filter("ts < timestamp_ntz'2024-01-20'")
    test = t.events.filter("ts >= timestamp_ntz'2024-01-20'")
    return rows.chain_ids([("train", train), ("test", test)], ["ts", "event_id"]).select("source", "event_id", "row_id")


@query("row2_keep_last", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1""")
def _(t):
    e = t.events.select("user_id", "event_type", "event_id", "value", "ts")
    return rows.keep_one(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("row3_drop_twins", """
WITH e AS (SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events),
 n AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS i FROM e)
SELECT event_id, user_id, day FROM n WHERE NOT (event_type = 'view' AND i > 1)""")
def _(t):
    e = t.events.select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return rows.without_twins(e, ["user_id", "day"], F.col("event_type") == "view", ["event_id"]).drop("event_type")


@query("row4_distinct_pairs", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def _(t):
    return t.lineitem.select("l_suppkey", "l_partkey").distinct()


@query("row5_time_order", """
SELECT user_id, event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events""")
def _(t):
    ordered = rows.number_rows(t.events, ["ts", "event_id"], "place", start=1)
    return ordered.select("user_id", "event_id", "place")


@query("row6_group_positions", """
WITH $LOG, p AS (SELECT basket, line, item, row_number() OVER (PARTITION BY basket ORDER BY $LINE_ORDER) - 1 AS dcount,
  count(*) OVER (PARTITION BY basket) AS n FROM log)
SELECT *, n - dcount - 1 AS icount FROM p""")
def _(t):
    return rows.positions(t.log, ["basket"], LINE_ORDER).select("basket", "line", "item", "dcount", "icount", "n")


@query("row7_reverse_copy", """
WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS d, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, d AS dcount, n - d - 1 AS icount, 0 AS reverse FROM p
UNION ALL SELECT CAST(conv_id AS VARCHAR) || '_r', turn, n - d - 1, d, 1 FROM p WHERE n > 1""")
def _(t):
    p = rows.positions(t.conversations.select("conv_id", "turn"), ["conv_id"], ["turn"])
    return rows.reverse_copy(p, "conv_id", only=F.col("n") > 1).drop("n")


@query("row8_sample_rows", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE CAST(concat('0x', right(md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|7'), 8)) AS UBIGINT) < 429496729""")
def _(t):
    return rows.sample_rows(t.lineitem, 0.1, 7, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("row8_seeded_shuffle", """
SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|7'), o_orderkey) - 1 AS place FROM orders""")
def _(t):
    return rows.shuffled(t.orders.select("o_orderkey"), ["o_orderkey"], 7, "place")


@query("row9_sample_entities", """
SELECT l_orderkey, count(*) AS n FROM lineitem WHERE CAST(concat('0x', right(md5(CAST(l_orderkey AS VARCHAR) || '|7'), 8)) AS UBIGINT) < 429496729 GROUP BY l_orderkey""")
def _(t):
    kept = rows.sample_entities(t.lineitem, ["l_orderkey"], 0.1, 7)
    return kept.groupBy("l_orderkey").agg(big(F.count(F.lit(1)), "n"))
