"""Group statistics, curves, joins and set sizes."""

from pyspark.sql import functions as F

from cartloom.functions import timeparts as D
from cartloom.operators import aggregates as A
from cartloom.operators import joins as J
from cartloom.operators import sequences as Q
from cartloom.operators.featuremaps import KeyedMaps
from cartloom.operators.ordered import with_group
from cartloom.plans.registry import LINE_ORDER, big, query, rounded, text


@query("agg1_multi_aggregate", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(avg(l_discount), 6) AS discount,
       min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def _(t):
    return A.summarise(t.lineitem, ["l_returnflag", "l_linestatus"], qty=F.sum("l_quantity"),
                       discount=F.round(F.avg("l_discount"), 6), low=F.min("l_extendedprice"),
                       high=F.max("l_extendedprice"), n=F.count(F.lit(1)))


@query("agg2_distinct_counts", """
SELECT count(DISTINCT l_partkey) AS items, count(DISTINCT l_suppkey) AS authors, count(DISTINCT l_orderkey) AS sessions FROM lineitem""")
def _(t):
    count = lambda c: t.lineitem.select(c).distinct().agg(F.count(F.lit(1)))
    items = count("l_partkey").toDF("items")
    return items.select("items", count("l_suppkey").scalar().alias("authors"), count("l_orderkey").scalar().alias("sessions"))


@query("agg3_histogram", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type")
def _(t):
    return A.histogram(t.part, ["p_brand", "p_type"])


@query("agg4_group_transform", """
SELECT event_id, max(value) OVER w AS hi, min(value) OVER w AS lo, count(*) OVER w AS n,
       last(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_type
FROM events WINDOW w AS (PARTITION BY user_id)""")
def _(t):
    g = with_group(t.events, ["user_id"], hi=F.max("value"), lo=F.min("value"), n=F.count(F.lit(1)),
                   last_type=F.max_by("event_type", F.struct("ts", "event_id")))
    return g.select("event_id", "hi", "lo", "n", "last_type")


@query("agg5_kind_flags", """
SELECT user_id, props, max(CAST(event_type = 'purchase' AS INT)) AS has_purchase, max(CAST(event_type = 'view' AS INT)) AS has_view,
 max(CAST(event_type = 'click' AS INT)) AS has_click, count(*) AS n_interactions FROM events GROUP BY user_id, props""")
def _(t):
    kinds = {"has_purchase": "purchase", "has_view": "view", "has_click": "click"}
    return A.kind_flags(t.events, ["user_id", "props"], "event_type", kinds)


@query("agg6_session_lists", """
WITH $LOG, p AS (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY $LINE_ORDER) - 1 AS i FROM log)
SELECT basket, i // 10000 AS chunk, string_agg(CAST(item AS VARCHAR), ',' ORDER BY i) AS items,
       string_agg(CAST(author AS VARCHAR), ',' ORDER BY i) AS authors FROM p GROUP BY basket, i // 10000""")
def _(t):
    lists = Q.chunk_lists(t.log, ["basket"], LINE_ORDER, ["item", "author"], Q.CHUNK)
    return lists.select("basket", "chunk", text("item_list", "items"), text("author_list", "authors"))


@query("agg6_session_ends", """
SELECT user_id, arg_min(event_type, event_id) AS event_type_first, arg_max(event_type, event_id) AS event_type_last,
       arg_max(value, event_id) AS value_last, count(*) AS n FROM events GROUP BY user_id""")
def _(t):
    return Q.session_summary(t.events, ["user_id"], ["event_id"], ["event_type"], ["event_type", "value"])


@query("agg7_concatenated_lists", """
WITH w AS (SELECT conv_id, turn, role, string_split(role, 'e') AS parts FROM conversations),
 u AS (SELECT conv_id, turn, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM w WHERE role = 'assistant'),
 n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS k FROM u)
SELECT conv_id, k // 10000 AS chunk, string_agg(part, ',' ORDER BY k) AS items FROM n GROUP BY conv_id, k // 10000
UNION ALL SELECT DISTINCT conv_id, 0, 'missing' FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM u)""")
def _(t):
    parts = F.when(F.col("role") == "assistant", F.split("role", "e"))
    lists = Q.joined_lists(t.conversations.withColumn("parts", parts), ["conv_id"], ["turn"], "parts", Q.CHUNK)
    return lists.select("conv_id", "chunk", text("items"))


_POINTS = {"min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}
PERCENTILES_SQL = lambda c: ", ".join(f'round(quantile_cont({c}, {p}), 6) AS "{n}"' for n, p in _POINTS.items())


@query("agg8_percentiles", f"SELECT {PERCENTILES_SQL('value')} FROM events")
def _(t):
    row = A.percentile_row(t.events, "value")
    return row.select(*[rounded(c) for c in row.columns])


@query("agg8_percentile_sketch")
def _(t):
    return A.percentile_row(t.lineitem, "l_extendedprice", exact=False)


@query("agg9_gini", """
WITH f AS (SELECT l_partkey, count(*) AS x FROM lineitem GROUP BY l_partkey),
 r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM f)
SELECT max(n) AS n_keys, CAST(sum(x) AS BIGINT) AS n_rows, round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) AS gini FROM r""")
def _(t):
    return A.gini(t.lineitem, "l_partkey").select(big("n_keys"), big("n_rows"), rounded("gini"))


@query("agg10_share_curve", """
WITH f AS (SELECT l_partkey, count(*) AS freq FROM lineitem GROUP BY l_partkey),
 b AS (SELECT freq, count(*) AS n_keys FROM f GROUP BY freq)
SELECT freq, n_keys, round(sum(n_keys) OVER (ORDER BY freq DESC) / (SELECT count(*) FROM f), 6) AS key_share,
 round(sum(freq * n_keys) OVER (ORDER BY freq DESC) / (SELECT count(*) FROM lineitem), 6) AS row_share FROM b""")
def _(t):
    return A.share_curve(t.lineitem, "l_partkey").select("freq", "n_keys", rounded("key_share"), rounded("row_share"))


@query("agg10_top_shares", """
WITH f AS (SELECT l_partkey, count(*) AS x FROM lineitem GROUP BY l_partkey),
 r AS (SELECT x, row_number() OVER (ORDER BY x DESC) AS i, count(*) OVER () AS n FROM f)
SELECT """ + ", ".join(f"round(sum(CASE WHEN i <= floor(n * {x}) THEN x ELSE 0 END) / sum(x), 6) AS top_{int(x * 1000)}"
                       for x in (0.01, 0.05, 0.1, 0.25, 0.5)) + " FROM r")
def _(t):
    row = A.top_shares(t.lineitem, "l_partkey", (0.01, 0.05, 0.1, 0.25, 0.5))
    return row.select(*[rounded(c) for c in row.columns])


@query("agg11_category_prices", """
SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 6) AS mean_main,
       round(avg(p_retailprice) OVER (PARTITION BY p_brand, p_type), 6) AS mean_full FROM part""")
def _(t):
    means = A.two_level_means(t.part, "p_brand", ["p_brand", "p_type"], "p_retailprice")
    return means.select("p_partkey", rounded("mean_main"), rounded("mean_full"))


@query("agg12_first_seen", "SELECT user_id, epoch_us(min(ts)) AS first_at FROM events GROUP BY user_id")
def _(t):
    return A.first_seen(t.events, "user_id", "ts").select("user_id", D.micros(F.col("first_at")).alias("first_at"))


@query("agg13_label_means", """
WITH $LOG SELECT kind, round(avg(y), 6) AS y_mean, round(avg(z), 6) AS z_mean FROM log GROUP BY kind""")
def _(t):
    return A.summarise(t.log, ["kind"], y_mean=F.round(F.avg("y"), 6), z_mean=F.round(F.avg("z"), 6))


@query("agg14_element_frequency", """
SELECT element, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS element FROM documents) GROUP BY element""")
def _(t):
    return A.element_frequency(t.documents.withColumn("words", F.split("text", " ")), "words")


@query("agg15_bucket_distribution", """
WITH s AS (SELECT l_linenumber AS bucket, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'train' WHEN l_shipdate < TIMESTAMP '2000-01-01' THEN 'valid' ELSE 'test' END AS split FROM lineitem)
SELECT bucket, round(count(*) FILTER (split = 'train') / (SELECT count(*) FROM s WHERE split = 'train'), 6) AS share_train,
 round(count(*) FILTER (split = 'valid') / (SELECT count(*) FROM s WHERE split = 'valid'), 6) AS share_valid,
 round(count(*) FILTER (split = 'test') / (SELECT count(*) FROM s WHERE split = 'test'), 6) AS share_test FROM s GROUP BY bucket""")
def _(t):
    at = F.col("l_shipdate")
    split = F.when(at < F.lit("1998-01-01").cast("timestamp_ntz"), "train").when(
        at < F.lit("2000-01-01").cast("timestamp_ntz"), "valid").otherwise("test")
    s = t.lineitem.select(F.col("l_linenumber").alias("bucket"), split.alias("split"))
    d = A.bucket_distribution(s, "bucket", "split", ["train", "valid", "test"])
    return d.select("bucket", *[rounded(c) for c in d.columns[1:]])


@query("agg16_daily_hourly_mean", """
SELECT CAST(day(ts) AS INT) AS day, CAST(hour(ts) AS INT) AS hour, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def _(t):
    return t.events.groupBy(F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.round(F.avg("value"), 6).alias("mean"))


# --- joins ------------------------------------------------------------------

@query("jon1_feature_map", """
WITH $LOG, m AS (SELECT author, kind, count(*) AS n, sum(qty) AS q FROM log GROUP BY author, kind)
SELECT basket, line, item, coalesce(n, 0) AS n, q FROM log LEFT JOIN m USING (author, kind)""")
def _(t):
    m = A.summarise(t.log, ["author", "kind"], n=F.count(F.lit(1)), q=F.sum("qty"))
    return J.attach(t.log, m, ["author", "kind"], {"n": 0}).select("basket", "line", "item", "n", "q")


@query("jon2_inner", """
SELECT l_orderkey, p_partkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(t):
    return J.attach(t.lineitem, t.part.withColumn("k", F.col("p_partkey")), {"l_partkey": "k"}, how="inner").select(
        "l_orderkey", "p_partkey", "p_brand")


@query("jon3_outer_counts", """
WITH a AS (SELECT l_suppkey AS id, count(*) AS n_author FROM lineitem GROUP BY 1), b AS (SELECT o_custkey AS id, count(*) AS n_reader FROM orders GROUP BY 1)
SELECT id, coalesce(n_author, 0) AS n_author, coalesce(n_reader, 0) AS n_reader FROM a FULL JOIN b USING (id)""")
def _(t):
    a = A.histogram(t.lineitem.withColumnRenamed("l_suppkey", "id"), ["id"], "n_author")
    b = A.histogram(t.orders.withColumnRenamed("o_custkey", "id"), ["id"], "n_reader")
    return J.outer_counts(a, b, "id")


@query("jon4_other_key_name", """
WITH a AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS n FROM orders LEFT JOIN a ON o_custkey = l_suppkey""")
def _(t):
    a = A.histogram(t.lineitem, ["l_suppkey"])
    return J.attach(t.orders, a, {"o_custkey": "l_suppkey"}, {"n": 0}).select("o_orderkey", "n")


@query("jon5_role_switch", """
WITH $LOG, m AS (SELECT author, reader, count(*) AS n FROM log GROUP BY 1, 2)
SELECT l.basket, l.line, l.item, coalesce(m.n, 0) AS n FROM log l LEFT JOIN m ON l.author = m.reader AND l.reader = m.author""")
def _(t):
    m = A.histogram(t.log, ["author", "reader"])
    switched = J.role_switched(m, ("author", "reader"))
    return J.attach(t.log, switched, ["author", "reader"], {"n": 0}).select("basket", "line", "item", "n")


@query("jon6_two_hop", """
WITH $LOG, e AS (SELECT DISTINCT reader AS a, author AS b FROM log)
SELECT DISTINCT e.a, e.b FROM e JOIN e f ON e.a = f.a JOIN e g ON f.b = g.a AND g.b = e.b""")
def _(t):
    edges = t.log.select(F.col("reader").alias("a"), F.col("author").alias("b")).distinct()
    return J.two_hop(edges, edges)


@query("jon7_nearest_events", """
WITH e AS (SELECT *, epoch_us(ts) // 1000000 AS s FROM events)
SELECT r.event_id, coalesce(r.s - max(p.s) FILTER (p.s < r.s), 1296000) AS gap_before, coalesce(min(p.s) FILTER (p.s > r.s) - r.s, 1296000) AS gap_after
FROM (SELECT * FROM e WHERE event_type = 'view') r LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') p ON p.user_id = r.user_id GROUP BY r.event_id, r.s""")
def _(t):
    e = t.events.withColumn("s", D.seconds(F.col("ts")))
    views, buys = e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'")
    near = J.nearest_events(views, buys, ("user_id", "user_id"), ("s", "s"))
    return near.select("event_id", "gap_before", "gap_after")


@query("jon8_shrunk_map", """
SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY') GROUP BY l_partkey""")
def _(t):
    m = A.histogram(t.lineitem, ["l_partkey"])
    wanted = t.part.filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"))
    return J.shrink_to(m, wanted, ["l_partkey"])


@query("jon8_marked_map", """
SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem WHERE (l_orderkey, l_suppkey) IN (SELECT o_orderkey, o_custkey % 100 + 1 FROM orders WHERE o_orderstatus = 'F')
GROUP BY ALL""")
def _(t):
    """Keys of two columns, more than are broadcast, as a bit map before the semi-join."""
    m = A.histogram(t.lineitem, ["l_orderkey", "l_suppkey"])
    wanted = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 100 + 1).alias("l_suppkey"))
    return J.shrink_to(m, wanted, ["l_orderkey", "l_suppkey"], few=0)


@query("jon9_missing_ids", """
SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT l_suppkey FROM lineitem)""")
def _(t):
    return J.missing_ids(t.customer.select(F.col("c_custkey").alias("id")), t.lineitem.select(F.col("l_suppkey").alias("id")), "id")


@query("jon10_aligned_columns", """
SELECT a.event_id, a.value, b.event_type AS other FROM events a LEFT JOIN (SELECT * FROM events WHERE value > 5) b USING (event_id)""")
def _(t):
    other = t.events.filter("value > 5").select("event_id", F.col("event_type").alias("other"))
    return J.attach(t.events, other, ["event_id"]).select("event_id", "value", "other")


@query("jon11_literal_lookup", """
SELECT o_orderkey, CASE WHEN month(o_orderdate) <= 3 THEN 'winter' WHEN month(o_orderdate) <= 6 THEN 'spring'
 WHEN month(o_orderdate) <= 9 THEN 'summer' ELSE 'autumn' END AS season FROM orders""")
def _(t):
    names = t.spark.createDataFrame([(0, "winter"), (1, "spring"), (2, "summer"), (3, "autumn")], "code int, season string")
    coded = t.orders.withColumn("code", D.season(F.col("o_orderdate")))
    return coded.join(F.broadcast(names), "code", "left").select("o_orderkey", "season")


@query("jon12_attach_models", """
WITH p AS (SELECT event_id, user_id, 'm' || (event_id % 3) AS model, event_id * 7 % 1000 / 1000 AS score FROM events),
 w AS (SELECT user_id, max(CASE WHEN model = 'm0' THEN score END) AS score_m0, max(CASE WHEN model = 'm1' THEN score END) AS score_m1,
  max(CASE WHEN model = 'm2' THEN score END) AS score_m2 FROM p GROUP BY user_id)
SELECT event_id, score_m0, score_m1, score_m2 FROM events LEFT JOIN w USING (user_id)""")
def _(t):
    p = t.events.select("user_id", F.concat(F.lit("m"), F.col("event_id") % 3).alias("model"),
                        (F.col("event_id") * 7 % 1000 / 1000).alias("score"))
    wide = J.attach_models(t.events, p, ["user_id"], ["m0", "m1", "m2"])
    return wide.select("event_id", "score_m0", "score_m1", "score_m2")


@query("jon13_wide_label_map", """
WITH $LOG SELECT author, CAST(sum(y) AS BIGINT) AS y_sum, CAST(sum(z) AS BIGINT) AS z_sum, count(*) AS te_count FROM log GROUP BY author""")
def _(t):
    from cartloom.operators.encoders import fit_target

    return fit_target(t.log, ["author"], ["y", "z"])


@query("jon1_kept_maps", """
WITH $LOG, n AS (SELECT author, count(*) AS n, CAST(sum(y) AS BIGINT) AS ys FROM log GROUP BY author), q AS (SELECT author, max(qty) AS most FROM log WHERE kind = '1-URGENT' GROUP BY author),
 r AS (SELECT author, count(DISTINCT reader) AS readers FROM log WHERE status = 'P' GROUP BY author)
SELECT basket, line, item, n, ys, most, coalesce(readers, 0) AS readers FROM log LEFT JOIN n USING (author) LEFT JOIN q USING (author) LEFT JOIN r USING (author)""")
def _(t):
    log = t.log
    maps = KeyedMaps(t.spark, ["author"])
    kept = [
        maps.keep("sizes", A.summarise(log, ["author"], n=F.count(F.lit(1)), ys=F.sum("y"))),
        maps.keep("urgent", A.summarise(log.filter("kind = '1-URGENT'"), ["author"], most=F.max("qty"))),
        maps.keep("pending", A.summarise(log.filter("status = 'P'"), ["author"], readers=F.countDistinct("reader"))),
    ]
    # Attached by their buckets, however small they are.
    return maps.attach(log, kept, {"readers": 0}, small=0).select("basket", "line", "item", "n", "ys", "most", "readers")


@query("jon12_kept_predictions", """
WITH p AS (SELECT event_id, user_id, event_id % 3 AS m, event_id * 7 % 1000 / 1000 AS score FROM events)
SELECT event_id, CASE WHEN m = 0 THEN score END AS score_m0, CASE WHEN m = 1 THEN score END AS score_m1, CASE WHEN m = 2 THEN score END AS score_m2 FROM p""")
def _(t):
    keys = ["event_id", "user_id"]
    p = t.events.select(*keys, (F.col("event_id") * 7 % 1000 / 1000).alias("score"))
    maps = KeyedMaps(t.spark, keys)
    kept = [maps.keep(f"m{m}", p.filter(F.col("event_id") % 3 == m).withColumnRenamed("score", f"score_m{m}")) for m in range(3)]
    log = maps.keep("log", t.events.select(*keys))
    return maps.attach(log, kept, arranged=True, small=0).select("event_id", "score_m0", "score_m1", "score_m2")


# --- sets -------------------------------------------------------------------

@query("set1_union_by_name", """
SELECT o_orderkey AS id, o_custkey AS reader, NULL AS value FROM orders UNION ALL SELECT event_id, user_id, value FROM events""")
def _(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("reader"))
    b = t.events.select(F.col("event_id").alias("id"), "value", F.col("user_id").alias("reader"))
    return a.unionByName(b, allowMissingColumns=True)


_SETS = """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT l_suppkey AS id FROM lineitem)"""


def _sides(t):
    return (t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")),
            t.lineitem.select(F.col("l_suppkey").alias("id")))


@query("set2_vocabulary_overlap", _SETS + """
SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a JOIN b USING (id)) AS n_both,
 (SELECT count(*) FROM (SELECT id FROM a UNION SELECT id FROM b)) AS n_union,
 (SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM b)) AS n_left_only, (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS n_right_only""")
def _(t):
    return J.set_sizes(*_sides(t), "id")


@query("set3_difference", _SETS + " SELECT id FROM a EXCEPT SELECT id FROM b")
def _(t):
    a, b = _sides(t)
    return a.subtract(b)
