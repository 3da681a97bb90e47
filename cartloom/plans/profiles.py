"""Dataset profile of the event log: user, item (props), session (day)."""

from pyspark.sql import functions as F

from cartloom.functions import timeparts as D
from cartloom.operators import daystate as S
from cartloom.operators import profiling as R
from cartloom.operators.aggregates import share_curve
from cartloom.plans.aggregating import PERCENTILES_SQL
from cartloom.plans.registry import query, rounded
from cartloom.runtime import scratch_folder

_EV = "e AS (SELECT event_id, ts, user_id, props AS item, user_id || '/' || strftime(ts, '%Y-%m-%d') AS sess, epoch_us(ts) // 1000000 AS s FROM events)"
_WEEK = lambda c: f"year({c}) || '-' || lpad(CAST(week({c}) AS VARCHAR), 2, '0')"
_PERIODS = {"day": lambda c: f"strftime({c}, '%Y-%m-%d')", "week": _WEEK, "month": lambda c: f"strftime({c}, '%Y-%m')"}


def events(t):
    sess = F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd"))
    return t.events.select("event_id", "ts", "user_id", F.col("props").alias("item"), sess.alias("sess"), D.seconds(F.col("ts")).alias("s"))


@query("pro1_sizes", f"""
WITH {_EV} SELECT count(*) AS n_rows, min(s) AS first_second, max(s) AS last_second, CAST(date_diff('day', min(ts), max(ts)) AS INT) AS n_days, count(DISTINCT user_id) AS n_users, count(DISTINCT item) AS n_items,
 count(DISTINCT sess) AS n_sessions, count(DISTINCT (user_id, item)) AS n_pairs, round(1 - count(DISTINCT (user_id, item)) / (count(DISTINCT user_id) * count(DISTINCT item)), 6) AS sparsity FROM e""")
def _(t):
    return R.sizes(events(t), "user_id", "item", "sess", "ts").withColumn("sparsity", rounded("sparsity"))


@query("pro2_frequency_profile", f"""
WITH f AS (SELECT count(*) AS freq FROM lineitem GROUP BY l_partkey), r AS (SELECT freq AS x, row_number() OVER (ORDER BY freq) AS i, row_number() OVER (ORDER BY freq DESC) AS d, count(*) OVER () AS n FROM f)
SELECT (SELECT round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) FROM r) AS gini, """ + ", ".join(
    f"(SELECT round(sum(CASE WHEN d <= floor(n * {x}) THEN x ELSE 0 END) / sum(x), 6) FROM r) AS top_{int(x * 1000)}" for x in (0.01, 0.05, 0.1, 0.25, 0.5))
    + f", {PERCENTILES_SQL('freq')} FROM f")
def _(t):
    row = R.frequency_profile(t.lineitem, "l_partkey")
    return row.select(*[rounded(c) for c in row.columns])


@query("pro3_repeat_profile", f"""
WITH {_EV}, u AS (SELECT user_id, (count(*) - count(DISTINCT item)) / count(*) AS ratio FROM e GROUP BY user_id) SELECT {PERCENTILES_SQL('ratio')} FROM u""")
def _(t):
    row = R.repeat_profile(events(t), "user_id", "item")
    return row.select(*[rounded(c) for c in row.columns])


for _p in ("day", "week", "month"):
    @query(f"pro4_rows_per_{_p}", f"SELECT {_PERIODS[_p]('o_orderdate')} AS period, count(*) AS n FROM orders GROUP BY 1")
    def _(t, period=_p):
        return R.by_period(t.orders, "o_orderdate", period)


@query("pro5_interaction_ages", f"""
WITH {_EV}, a AS (SELECT (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY item)) // 86400000000 AS age_days FROM e) SELECT age_days, count(*) AS n FROM a GROUP BY 1""")
def _(t):
    return R.interaction_ages(events(t), "item", "ts")


@query("pro5_age_percentiles", f"""
WITH {_EV}, a AS (SELECT (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 86400000000 AS age FROM e) SELECT {PERCENTILES_SQL('age')} FROM a""")
def _(t):
    row = R.age_percentiles(events(t), "user_id", "ts")
    return row.select(*[rounded(c) for c in row.columns])


for _p in ("day", "week", "month"):
    @query(f"pro6_new_readers_per_{_p}", f"""
WITH f AS (SELECT {_PERIODS[_p]('min(o_orderdate)')} AS period FROM orders GROUP BY o_custkey), c AS (SELECT period, count(*) AS n_new FROM f GROUP BY 1)
SELECT period, n_new, round((SELECT quantile_cont(n_new, 0.5) FROM c WHERE period > (SELECT min(period) FROM c)), 6) AS median_new FROM c""")
    def _(t, period=_p):
        return R.new_per_period(t.orders, "o_custkey", "o_orderdate", period).withColumn("median_new", rounded("median_new"))


@query("pro7_cold_start", f"""
WITH f AS (SELECT o_orderdate AS d, min(o_orderdate) OVER (PARTITION BY o_custkey) AS f FROM orders), l AS (SELECT * FROM f WHERE {_WEEK('d')} <> (SELECT min({_WEEK('o_orderdate')}) FROM orders))
SELECT count(*) AS n, """ + ", ".join(f"round(avg(CAST({_PERIODS[p]('d')} = {_PERIODS[p]('f')} AS INT)), 6) AS same_{p}" for p in _PERIODS) + " FROM l")
def _(t):
    row = R.cold_start(t.orders, "o_custkey", "o_orderdate")
    return row.select("n", *[rounded(f"same_{p}") for p in _PERIODS])


_SESS = f"""{_EV}, z AS (SELECT user_id, sess, count(*) AS length, (max(s) - min(s)) / 60 AS minutes, min(s) AS a, max(s) AS b FROM e GROUP BY ALL),
 g AS (SELECT (a - lag(b) OVER (PARTITION BY user_id ORDER BY a, sess)) AS gap FROM z), u AS (SELECT count(*) AS n FROM z GROUP BY user_id)"""


@query("pro8_session_profile", f"""
WITH {_SESS} SELECT 'length' AS measure, {PERCENTILES_SQL('length')} FROM z UNION ALL SELECT 'minutes', {PERCENTILES_SQL('minutes')} FROM z UNION ALL SELECT 'sessions_per_user', {PERCENTILES_SQL('n')} FROM u
UNION ALL SELECT 'gap_hours', {PERCENTILES_SQL('gap / 3600')} FROM g WHERE gap IS NOT NULL UNION ALL SELECT 'gap_days', {PERCENTILES_SQL('gap // 86400')} FROM g WHERE gap IS NOT NULL""")
def _(t):
    out = R.session_profile(events(t), "user_id", "sess", "s")
    return out.select("measure", *[rounded(c) for c in out.columns if c != "measure"])


@query("pro9_compare_splits", """
WITH o AS (SELECT *, o_orderdate < TIMESTAMP '2000-01-01' AS tr FROM orders), l AS (SELECT tr, o_custkey, count(*) AS length FROM o GROUP BY ALL), c AS (SELECT tr, length, count(*) AS n FROM l GROUP BY ALL)
SELECT CASE WHEN tr THEN 'train' ELSE 'test' END AS split, length, n, round(n / sum(n) OVER (PARTITION BY tr), 6) AS share,
 (SELECT count(DISTINCT floor(o_totalprice / 10)) FROM o WHERE NOT tr AND floor(o_totalprice / 10) NOT IN (SELECT floor(o_totalprice / 10) FROM o WHERE tr)) AS test_only_items FROM c""")
def _(t):
    o = t.orders.withColumn("item", F.floor(F.col("o_totalprice") / 10))
    train, test = o.filter("o_orderdate < timestamp_ntz'2000-01-01'"), o.filter("o_orderdate >= timestamp_ntz'2000-01-01'")
    return R.compare_splits(train, test, "o_custkey", "item").withColumn("share", rounded("share"))


@query("pro9_length_percentiles", """
WITH l AS (SELECT o_orderdate < TIMESTAMP '2000-01-01' AS tr, o_custkey, count(*) AS length FROM orders GROUP BY ALL), p AS (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.99]) AS point),
 q AS (SELECT point, (SELECT quantile_cont(length, [0.25, 0.5, 0.75, 0.9, 0.99]) FROM l WHERE tr) AS a, (SELECT quantile_cont(length, [0.25, 0.5, 0.75, 0.9, 0.99]) FROM l WHERE NOT tr) AS b, row_number() OVER (ORDER BY point) AS i FROM p)
SELECT CAST(point AS DOUBLE) AS point, round(a[i], 6) AS train, round(b[i], 6) AS test, round(a[i] / b[i], 6) AS ratio FROM q""")
def _(t):
    o = t.orders
    train, test = o.filter("o_orderdate < timestamp_ntz'2000-01-01'"), o.filter("o_orderdate >= timestamp_ntz'2000-01-01'")
    compared = R.compare_lengths(train, test, "o_custkey", [0.25, 0.5, 0.75, 0.9, 0.99])
    return compared.select("point", rounded("train"), rounded("test"), rounded("ratio"))


def _profile_sql() -> str:
    pick = [f"count(*) AS n_rows, min(s) AS first_second, max(s) AS last_second, CAST(date_diff('day', min(ts), max(ts)) AS INT) AS n_days, count(DISTINCT user_id) AS n_users, count(DISTINCT item) AS n_items, "
            "count(DISTINCT sess) AS n_sessions, count(DISTINCT (user_id, item)) AS n_pairs, round(1 - count(DISTINCT (user_id, item)) / (count(DISTINCT user_id) * count(DISTINCT item)), 6) AS sparsity"]
    for name, key in (("item", "item"), ("user", "user_id")):
        steps = f"(SELECT freq AS x, row_number() OVER (ORDER BY freq) AS i, row_number() OVER (ORDER BY freq DESC) AS d, count(*) OVER () AS n FROM (SELECT count(*) AS freq FROM e GROUP BY {key}))"
        for n, p in (("p50", 0.5), ("p90", 0.9), ("max", 1.0)):
            pick.append(f"(SELECT round(quantile_cont(x, {p}), 6) FROM {steps}) AS {name}_{n}")
        pick.append(f"(SELECT round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) FROM {steps}) AS {name}_gini")
        pick.append(f"(SELECT round(sum(CASE WHEN d <= floor(n * 0.1) THEN x ELSE 0 END) / sum(x), 6) FROM {steps}) AS {name}_top_100")
        later = f"(SELECT ts AS d, min(ts) OVER (PARTITION BY {key}) AS f FROM e) WHERE {_WEEK('d')} <> (SELECT min({_WEEK('ts')}) FROM e)"
        pick += [f"(SELECT round(avg(CAST({_PERIODS[p]('d')} = {_PERIODS[p]('f')} AS INT)), 6) FROM {later}) AS {name}_same_{p}" for p in _PERIODS]
    return f"WITH {_EV} SELECT {', '.join(pick)} FROM e"


for _p in ("day", "week", "month"):
    @query(f"pro4_sketches_per_{_p}", f"""
SELECT {_PERIODS[_p]('ts')} AS period, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, TRUE AS users_near, TRUE AS p50_near, TRUE AS p90_near, TRUE AS p99_near FROM events GROUP BY 1""")
    def _(t, period=_p):
        """Periods merged from stored days; estimates are held against the exact figures within the sketches' bounds."""
        events = t.events.select("ts", "user_id", "value")
        store = S.DayStore(t.spark, scratch_folder(t.spark))
        half = F.lit("2024-01-16").cast("timestamp_ntz")
        for part in (F.col("ts") < half, F.col("ts") >= half):
            store.put(S.daily_sketches(events.filter(part), "ts", ["user_id"], ["value"]))
        told = S.merged_sketches(store.table(), period, (0.5, 0.9, 0.99))
        points = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
        dated = events.withColumn("period", R.PERIODS[period](F.col("ts"))).join(told.drop("n_rows"), "period")
        below = [F.avg((F.col("value") < F.col(f"value_{n}")).cast("int")).alias(f"{n}_below") for n in points]
        upto = [F.avg((F.col("value") <= F.col(f"value_{n}")).cast("int")).alias(f"{n}_upto") for n in points]
        exact = dated.groupBy("period").agg(F.first("n_user_id").alias("told"), F.count_distinct("user_id").alias("n_users"), *below, *upto)
        error = S.rank_error()
        near = [((F.col(f"{n}_below") <= p + error) & (F.col(f"{n}_upto") >= p - error)).alias(f"{n}_near") for n, p in points.items()]
        users = (F.abs(F.col("told") - F.col("n_users")) <= F.col("n_users") * S.distinct_error()).alias("users_near")
        return exact.join(told.select("period", "n_rows"), "period").select("period", "n_rows", "n_users", users, *near)


@query("pro10_profile_row", _profile_sql())
def _(t):
    row = R.profile_row(events(t), "user_id", "item", "sess", "ts")
    exact = ("n_rows", "first_second", "last_second", "n_days", "n_users", "n_items", "n_sessions", "n_pairs")
    return row.select(*[c if c in exact else rounded(c) for c in row.columns])


@query("pro10_share_table", """
WITH f AS (SELECT user_id, count(*) AS freq FROM events GROUP BY 1), b AS (SELECT freq, count(*) AS n_keys FROM f GROUP BY 1)
SELECT freq, n_keys, round(sum(n_keys) OVER (ORDER BY freq DESC) / (SELECT count(*) FROM f), 6) AS key_share, round(sum(freq * n_keys) OVER (ORDER BY freq DESC) / (SELECT count(*) FROM events), 6) AS row_share FROM b""")
def _(t):
    return share_curve(t.events, "user_id").select("freq", "n_keys", rounded("key_share"), rounded("row_share"))
