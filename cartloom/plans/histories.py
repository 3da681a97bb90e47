"""Entity history: lags, gaps, favourites, stable periods, graph flags."""

from pyspark.sql import functions as F

from cartloom.functions import timeparts as D
from cartloom.operators import history as H
from cartloom.operators import joins as J
from cartloom.operators import ranking as R
from cartloom.plans.registry import LINE_ORDER, query, rounded
from cartloom.runtime import shuffles_freed, stored

KEY = ["basket", "line", "item"]
TRIP = ["posted", "basket", *LINE_ORDER]
TRIP_SQL = "posted, basket, line, item, author, price, ship"


@query("win1_lags", "WITH $LOG SELECT basket, line, item, " + ", ".join(
    f"lag(author, {i}, -1) OVER w AS author_lag{i}" for i in range(1, 6)) + " FROM log WINDOW w AS (PARTITION BY basket ORDER BY $LINE_ORDER)")
def _(t):
    return H.lags(t.log, ["basket"], LINE_ORDER, "author", range(1, 6), -1).select(*KEY, *[f"author_lag{i}" for i in range(1, 6)])


@query("win2_neighbour_gaps", """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events)
SELECT event_id, coalesce(abs(s - lag(s) OVER w), 1296000) AS since_prev, coalesce(abs(s - lead(s) OVER w), 1296000) AS until_next
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)""")
def _(t):
    e = t.events.withColumn("s", D.seconds(F.col("ts")))
    return H.neighbour_gaps(e, ["user_id"], ["s", "event_id"], "s").select("event_id", "since_prev", "until_next")


@query("win3_stay_gaps", f"""
WITH $LOG SELECT basket, line, item, CAST(coalesce(date_diff('day', lag(ship) OVER w, posted), -1) AS INT) AS lapse FROM log WINDOW w AS (PARTITION BY reader ORDER BY {TRIP_SQL})""")
def _(t):
    return H.stay_gaps(t.log, ["reader"], TRIP, "posted", "ship").select(*KEY, "lapse")


@query("win4_group_ends", f"""
WITH $LOG SELECT basket, line, item, first(author) OVER w AS first_author, last(author) OVER w AS last_author, first(kind) OVER w AS first_kind, last(kind) OVER w AS last_kind
FROM log WINDOW w AS (PARTITION BY reader ORDER BY {TRIP_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def _(t):
    ends = H.group_ends(t.log, ["reader"], TRIP, ["author", "kind"])
    return ends.select(*KEY, "first_author", "last_author", "first_kind", "last_kind")


@query("win5_group_span", f"""
WITH $LOG, s AS (SELECT basket, line, item, first(posted) OVER w AS s0, last(ship) OVER w AS e1, last(posted) OVER w AS s1, first(ship) OVER w AS e0
 FROM log WINDOW w AS (PARTITION BY reader ORDER BY {TRIP_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT basket, line, item, CAST(CASE WHEN date_diff('day', s0, e1) >= 0 THEN date_diff('day', s0, e1) ELSE date_diff('day', s1, e0) END AS INT) AS span_days FROM s""")
def _(t):
    return H.group_span(t.log, ["reader"], TRIP, "posted", "ship").select(*KEY, "span_days")


@query("win6_favourite_flags", """
WITH c AS (SELECT user_id, props, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 3),
 f AS (SELECT user_id, arg_min(props, (-n, props)) AS fav FROM c GROUP BY user_id)
SELECT event_id, CAST(fav IS NOT NULL AND fav = props AS INT) AS same_props, CAST(fav IS NOT NULL AND fav <> props AS INT) AS diff_props, CAST(fav IS NULL AS INT) AS unknown_props
FROM events LEFT JOIN f USING (user_id)""")
def _(t):
    fav = H.favourite(t.events, "user_id", "props", "fav", support=3)
    return H.favourite_flags(t.events, fav, "user_id", "fav", ["props"], "props").select("event_id", "same_props", "diff_props", "unknown_props")


@query("win7_favourite_of_two_columns", """
WITH $LOG, u AS (SELECT DISTINCT reader, value, basket FROM (SELECT reader, item AS value, basket FROM log UNION ALL SELECT reader, author, basket FROM log) WHERE value <> 0),
 f AS (SELECT reader, arg_min(value, (-n, value)) AS fav FROM (SELECT reader, value, count(*) AS n FROM u GROUP BY ALL HAVING count(*) > 3) GROUP BY reader)
SELECT basket, line, item, CAST(coalesce(fav IN (item, author), false) AS INT) AS same_hash, CAST(coalesce(fav NOT IN (item, author), false) AS INT) AS diff_hash, CAST(fav IS NULL AS INT) AS unknown_hash
FROM log LEFT JOIN f USING (reader)""")
def _(t):
    both = H.union_columns(t.log, "reader", ["item", "author"], "value", "basket")
    fav = H.favourite(both, "reader", "value", "fav", support=3, ignore=0)
    return H.favourite_flags(t.log, fav, "reader", "fav", ["item", "author"], "hash").select(*KEY, "same_hash", "diff_hash", "unknown_hash")


@query("win8_author_language_vs_reader", """
WITH $LOG, d AS (SELECT DISTINCT author, item, kind FROM log), f AS (SELECT author AS id, arg_min(kind, (-n, kind)) AS fav FROM (SELECT author, kind, count(*) AS n FROM d GROUP BY ALL) GROUP BY author)
SELECT basket, line, item, CAST(coalesce(fav = kind, false) AS INT) AS same_lang, CAST(coalesce(fav <> kind, false) AS INT) AS diff_lang, CAST(fav IS NULL AS INT) AS unknown_lang FROM log LEFT JOIN f ON reader = id""")
def _(t):
    authored = t.log.select("author", "item", "kind").distinct()
    fav = H.favourite(authored, "author", "kind", "fav").withColumnRenamed("author", "id")
    flags = H.favourite_flags(t.log, fav, "reader", "fav", ["kind"], "lang", fav_key="id")
    return flags.select(*KEY, "same_lang", "diff_lang", "unknown_lang")


@query("win9_authored_count", """
WITH $LOG, a AS (SELECT author, count(DISTINCT item) AS n FROM log GROUP BY 1) SELECT basket, line, item, coalesce(n, 0) AS authored FROM log LEFT JOIN a ON reader = a.author""")
def _(t):
    return H.authored_count(t.log, "reader", "author", "item", "authored").select(*KEY, "authored")


_SPAN = lambda keys, out: f"""(SELECT o_custkey, {keys}, CASE WHEN span = 0 THEN -1 WHEN span = max(span) OVER (PARTITION BY o_custkey) THEN 1 ELSE 0 END AS {out}
 FROM (SELECT o_custkey, {keys}, date_diff('second', min(o_orderdate), max(o_orderdate)) AS span FROM orders GROUP BY ALL))"""


@query("win10_stable_period", f"""
SELECT o_orderkey, a, b, c FROM orders JOIN {_SPAN('o_orderstatus', 'a')} USING (o_custkey, o_orderstatus) JOIN {_SPAN('o_orderpriority', 'b')} USING (o_custkey, o_orderpriority)
JOIN {_SPAN('o_orderstatus, o_orderpriority', 'c')} USING (o_custkey, o_orderstatus, o_orderpriority)""")
def _(t):
    o = t.orders.withColumn("s", D.seconds(F.col("o_orderdate")))
    for out, values in (("a", ["o_orderstatus"]), ("b", ["o_orderpriority"]), ("c", ["o_orderstatus", "o_orderpriority"])):
        o = H.stable_flag(o, ["o_custkey"], values, "s", out)
    return o.select("o_orderkey", "a", "b", "c")


_MODE = lambda keys, out: f"""(SELECT o_custkey, {keys}, CASE WHEN n <= 1 THEN -1 WHEN n = max(n) OVER (PARTITION BY o_custkey) THEN 1 ELSE 0 END AS {out}
 FROM (SELECT o_custkey, {keys}, count(*) AS n FROM orders GROUP BY ALL))"""


@query("win11_modal_values", f"""
SELECT o_orderkey, a, b, c FROM orders JOIN {_MODE('o_orderstatus', 'a')} USING (o_custkey, o_orderstatus) JOIN {_MODE('o_orderpriority', 'b')} USING (o_custkey, o_orderpriority)
JOIN {_MODE('o_orderstatus, o_orderpriority', 'c')} USING (o_custkey, o_orderstatus, o_orderpriority)""")
def _(t):
    o = t.orders
    for out, values in (("a", ["o_orderstatus"]), ("b", ["o_orderpriority"]), ("c", ["o_orderstatus", "o_orderpriority"])):
        o = H.modal_flag(o, ["o_custkey"], values, out)
    return o.select("o_orderkey", "a", "b", "c")


@query("win12_latest_attributes", """
SELECT event_id, arg_max(event_type, (ts, event_id)) OVER w AS latest_event_type, arg_max(value, (ts, event_id)) OVER w AS latest_value FROM events WINDOW w AS (PARTITION BY user_id)""")
def _(t):
    return H.latest_attributes(t.events, "user_id", ["ts", "event_id"], ["event_type", "value"]).select("event_id", "latest_event_type", "latest_value")


@query("win13_elapsed", """
WITH $LOG SELECT basket, line, item, CASE WHEN y = 1 THEN date_diff('second', posted, ship) WHEN z = 1 THEN date_diff('second', posted, ship) + 60 END AS elapsed FROM log""")
def _(t):
    s, e = D.seconds(F.col("posted")), D.seconds(F.col("ship"))
    first = H.elapsed(s, F.when(F.col("y") == 1, e), F.when(F.col("z") == 1, e + 60))
    return t.log.select(*KEY, first.alias("elapsed"))


_SCORE_SQL = "(l_partkey * 37 + l_suppkey * 11 + l_linenumber) % 1000 / 1000 AS score"


def scored(t):
    score = F.pmod(F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + F.col("l_linenumber"), F.lit(1000)) / 1000
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", score.alias("score"))


@query("win14_candidate_rank", f"""
WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_SCORE_SQL} FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER w AS rank, round(1 / row_number() OVER w, 6) AS reciprocal
FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, (l_partkey, l_suppkey, l_linenumber))""")
def _(t):
    s = scored(t).withColumn("candidate", F.struct("l_partkey", "l_suppkey", "l_linenumber"))
    ranked = R.candidate_rank(s, ["l_orderkey"], "candidate", "score")
    return ranked.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "rank", rounded("reciprocal"))


@query("win15_repeat_counts", """
WITH $LOG SELECT basket, line, item, count(*) OVER (PARTITION BY author) AS same_author, count(*) OVER (PARTITION BY reader) AS same_reader, count(*) OVER (PARTITION BY author, reader) AS same_pair FROM log""")
def _(t):
    c = H.repeat_counts(t.log, {"same_author": ["author"], "same_reader": ["reader"], "same_pair": ["author", "reader"]})
    return c.select(*KEY, "same_author", "same_reader", "same_pair")


@query("win16_repeat_rate", """
WITH l AS (SELECT user_id, CAST(coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS INT) AS again FROM events)
SELECT user_id, round(avg(again), 6) AS repeat_rate, count(*) AS n FROM l GROUP BY user_id""")
def _(t):
    return H.repeat_rate(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", rounded("repeat_rate"), "n")


@query("win17_session_gaps", """
WITH s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS session, min(epoch_us(ts) // 1000000) AS a, max(epoch_us(ts) // 1000000) AS b FROM events GROUP BY 1, 2),
 g AS (SELECT user_id, session, a - lag(b) OVER (PARTITION BY user_id ORDER BY a, session) AS gap FROM s)
SELECT user_id, session, gap AS gap_seconds, round(gap / 3600, 6) AS gap_hours, gap // 86400 AS gap_days FROM g WHERE gap IS NOT NULL""")
def _(t):
    e = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("session"), D.seconds(F.col("ts")).alias("s"))
    return H.session_gaps(e, "user_id", "session", "s").select("user_id", "session", "gap_seconds", rounded("gap_hours"), "gap_days")


@query("win18_follow_flags", """
WITH $LOG, e AS (SELECT DISTINCT reader AS a, author AS b FROM log),
 h AS (SELECT DISTINCT e.a, g.b FROM e JOIN e g ON e.b = g.a)
SELECT l.basket, l.line, l.item, CAST(r.a IS NOT NULL AS INT) AS follows_back, CAST(f.a IS NOT NULL AS INT) AS two_hop, CAST(k.a IS NOT NULL AS INT) AS two_hop_back
FROM log l LEFT JOIN e r ON r.a = l.author AND r.b = l.reader LEFT JOIN h f ON f.a = l.reader AND f.b = l.author LEFT JOIN h k ON k.a = l.author AND k.b = l.reader""")
def _(t):
    with shuffles_freed(t.spark):
        rows = stored(t.log.select(*KEY, F.col("reader").alias("a"), F.col("author").alias("b")))
    return J.follow_flags(rows, rows).select(*KEY, "follows_back", "two_hop", "two_hop_back")


@query("win19_late_decline", """
SELECT event_id, CASE WHEN day(ts) IN (29, 30) AND hour(ts) * 60 + minute(ts) > 720 THEN CAST(hour(ts) * 60 + minute(ts) - 720 AS INT) ELSE 0 END AS decline FROM events""")
def _(t):
    return t.events.select("event_id", D.late_decline(F.col("ts"), [29, 30]).alias("decline"))
