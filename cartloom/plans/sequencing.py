"""Sessions and sequences, top-k forms, splits."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cartloom.functions import scalars as S
from cartloom.functions import timeparts as D
from cartloom.operators import embedding as E
from cartloom.operators import nearest as N
from cartloom.operators import ranking as R
from cartloom.operators import sequences as Q
from cartloom.operators import splits as P
from cartloom.operators.ordered import with_group
from cartloom.plans.histories import scored
from cartloom.plans.registry import LINE_ORDER, big, query, rounded, scaled, text

SESSION = ["user_id", "day"]
_EV = """ev AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS item,
  epoch_us(ts) // 1000000 AS s FROM events)"""


def sessions(t):
    item = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "value",
                           item.alias("item"), D.seconds(F.col("ts")).alias("s"))


def _add(t):
    """Session rows around the first 'signup', which stands for the add."""
    return Q.around_event(sessions(t), SESSION, ["s", "event_id"], F.col("event_type") == "signup")


_AROUND = _EV + """, sp AS (SELECT user_id, day, min((s, event_id)) AS spot FROM ev WHERE event_type = 'signup' GROUP BY ALL),
 ar AS (SELECT ev.*, CASE WHEN (s, event_id) < spot THEN -1 WHEN (s, event_id) = spot THEN 0 ELSE 1 END AS side FROM ev JOIN sp USING (user_id, day))"""


@query("seq1_impression_explode", """
WITH $LOG, n AS (SELECT basket, item, price, row_number() OVER (PARTITION BY basket ORDER BY $LINE_ORDER) - 1 AS position, count(*) OVER (PARTITION BY basket) AS n,
 first(item) OVER (PARTITION BY basket ORDER BY $LINE_ORDER) AS clicked FROM log)
SELECT basket, CAST(position AS INT) AS position, CAST(item AS VARCHAR) AS item, price AS value, CAST(item = clicked AS INT) AS label FROM n WHERE n > 1""")
def _(t):
    first = with_group(t.log, ["basket"], clicked=F.min_by("item", F.struct(*LINE_ORDER)))
    lists = Q.chunk_lists(first, ["basket"], LINE_ORDER, ["item", "price", "clicked"], Q.CHUNK)
    bar = lambda c: F.array_join(F.col(c).cast("array<string>"), "|")
    shown = lists.select("basket", "chunk", bar("item_list").alias("impressions"), bar("price_list").alias("prices"),
                         F.col("clicked_list")[0].cast("string").alias("reference"))
    least = F.when(F.col("chunk") == 0, 2).otherwise(1)
    rows = Q.explode_pairs(shown, ["basket", "chunk"], "impressions", "prices", r"\|", "reference", least=least)
    position = (F.col("position") + F.col("chunk") * Q.CHUNK).cast("int").alias("position")
    return rows.select("basket", position, "item", F.col("value").cast("double").alias("value"), "label")


@query("seq2_click_events", """
SELECT conv_id, turn, unnest(string_split(role, 's')) AS item, 'click' AS action FROM conversations""")
def _(t):
    c = t.conversations.select("conv_id", "turn", F.split("role", "s").alias("clicked"))
    return Q.click_events(c, "clicked", "item")


@query("seq3_merged_lists", """
SELECT event_id, CASE WHEN event_type = 'click' THEN 'view,click,' || props WHEN event_type = 'view' THEN 'view,click,' || props ELSE 'view,click,' || props || ',' || event_type END AS merged FROM events""")
def _(t):
    shown = F.array(F.lit("view"), F.lit("click"), F.col("props"))
    return t.events.select("event_id", text(Q.merge_lists(shown, F.array("event_type", "props")), "merged"))


@query("seq4_list_sizes", """
SELECT doc_id, CAST(CASE WHEN lang = 'en' THEN 0 ELSE len(string_split(text, ' ')) END AS INT) AS n FROM documents""")
def _(t):
    return t.documents.select("doc_id", Q.list_size(F.when(F.col("lang") != "en", F.split("text", " "))).alias("n"))


@query("seq5_membership_flags", f"""
WITH $LOG, r AS (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY $LINE_ORDER) - 1 AS b FROM log),
 c AS (SELECT DISTINCT basket, item FROM log WHERE y = 1)
SELECT basket, b // 10000 AS chunk, string_agg(CASE WHEN c.item IS NULL THEN '0' ELSE '1' END, ',' ORDER BY b) AS flags FROM r LEFT JOIN c USING (basket, item) GROUP BY ALL""")
def _(t):
    # An item chosen in another chunk of the basket counts too, so choices are marked on rows.
    marked = with_group(t.log, ["basket", "item"], bought=F.max("y"))
    shown = Q.chunk_lists(marked, ["basket"], LINE_ORDER, ["item", "bought"], Q.CHUNK)
    pairs = F.filter(F.arrays_zip("item_list", "bought_list"), lambda p: p["bought_list"] == 1)
    chosen = F.transform(pairs, lambda p: p["item_list"])
    return shown.select("basket", "chunk", text(Q.membership(F.col("item_list"), chosen), "flags"))


@query("seq5_fresh_clicks", f"""
WITH {_EV} SELECT DISTINCT user_id, day, item FROM ev WHERE event_type = 'click' AND (user_id, day, item) NOT IN (SELECT (user_id, day, item) FROM ev WHERE event_type = 'view')""")
def _(t):
    rows = sessions(t)
    return Q.fresh_items(rows.filter("event_type = 'click'"), rows.filter("event_type = 'view'"), SESSION, "item")


@query("seq6_last_n", f"""
WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id DESC) AS b FROM ev)
SELECT user_id, string_agg(CAST(item AS VARCHAR), ',' ORDER BY b DESC) AS items, string_agg(event_type, ',' ORDER BY b DESC) AS kinds,
 string_agg(CASE WHEN b <= 3 THEN event_type END, ',' ORDER BY b DESC) AS last3 FROM r WHERE b <= 30 GROUP BY user_id""")
def _(t):
    lists = Q.last_lists(sessions(t), ["user_id"], ["s", "event_id"], ["item", "event_type"], 30)
    return lists.select("user_id", text("item_list", "items"), text("event_type_list", "kinds"), text(Q.keep_last(F.col("event_type_list"), 3), "last3"))


@query("seq7_scaled_elements", f"""
WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1 AS b FROM ev), m AS (SELECT avg(value) AS a, stddev_samp(value) AS d FROM ev)
SELECT user_id, b // 10000 AS chunk, string_agg(CAST(CAST(round((value - a) / d * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY b) AS scaled FROM r, m GROUP BY ALL""")
def _(t):
    lists = Q.chunk_lists(sessions(t), ["user_id"], ["s", "event_id"], ["value"], Q.CHUNK)
    return Q.scale_elements(lists, "value_list", lists, "scaled").select("user_id", "chunk", scaled("scaled"))


@query("seq8_half_labels", f"""
WITH {_EV}, p AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
 h AS (SELECT *, i > n - n // 2 AS late FROM p), x AS (SELECT user_id, item, max(CAST(NOT late AS INT)) AS seen, min(CASE WHEN late AND event_type <> 'view' THEN i END) AS f FROM h GROUP BY ALL),
 l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) AS k FROM x WHERE f IS NOT NULL AND (seen = 0 OR item = 1)), z AS (SELECT user_id, max(n) AS n, count(*) FILTER (NOT late) AS n_input FROM h GROUP BY user_id)
SELECT user_id, n, n_input, string_agg(CAST(item AS VARCHAR), ',' ORDER BY k) AS labels FROM z JOIN l USING (user_id) WHERE k <= 20 GROUP BY ALL""")
def _(t):
    out = Q.half_labels(sessions(t), ["user_id"], ["s", "event_id"], "item", F.col("event_type") != "view", 20, rare=1)
    return out.select("user_id", "n", "n_input", text("labels"))


@query("seq9_minimum_length", f"""
WITH {_EV} SELECT event_id FROM ev WHERE day >= '2024-01-25' OR (user_id, day) IN (SELECT (user_id, day) FROM ev GROUP BY user_id, day HAVING count(*) >= 2)""")
def _(t):
    return Q.minimum_length(sessions(t), SESSION, 2, keep=F.col("day") >= "2024-01-25").select("event_id")


@query("seq10_first_add_position", f"""
WITH {_AROUND} SELECT user_id, day, max(item) FILTER (side = 0) AS event_item, count(*) FILTER (side < 0) AS position, count(*) FILTER (side > 0) AS n_after FROM ar GROUP BY user_id, day""")
def _(t):
    return Q.event_position(_add(t), SESSION, "item")


@query("seq11_until_first_purchase", f"""
WITH {_EV}, f AS (SELECT user_id, day, arg_min(item, (s, event_id)) FILTER (event_type = 'purchase') AS pid, max(CAST(event_type = 'purchase' AS INT)) AS has_event,
 coalesce(arg_min(s, (s, event_id)) FILTER (event_type = 'purchase'), max(s)) AS event_at FROM ev GROUP BY user_id, day)
SELECT event_id, coalesce(CAST(pid AS VARCHAR), 'none') AS first_id, has_event, event_at FROM ev JOIN f USING (user_id, day) WHERE s <= event_at""")
def _(t):
    rows = sessions(t).withColumn("item", F.col("item").cast("string"))
    buys = Q.first_event(rows, SESSION, ["s", "event_id"], F.col("event_type") == "purchase", "item", "s")
    return Q.until_event(rows, buys, SESSION, "s").select("event_id", "first_id", "has_event", "event_at")


@query("seq12_padded_lists", """
WITH $LOG, l AS (SELECT basket, list(item ORDER BY $LINE_ORDER) AS items FROM log GROUP BY basket)
SELECT basket, array_to_string(list_concat(items, [0, 0, 0, 0])[1:4], ',') AS padded FROM l""")
def _(t):
    lists = Q.chunk_lists(t.log, ["basket"], LINE_ORDER, ["item"], Q.CHUNK).filter("chunk = 0")
    return lists.select("basket", text(Q.pad(F.col("item_list"), 4), "padded"))


@query("seq13_cut_after_add", f"""
WITH {_AROUND}, n AS (SELECT user_id, day, item, row_number() OVER (PARTITION BY user_id, day ORDER BY s, event_id) AS i, count(*) FILTER (side < 0) OVER (PARTITION BY user_id, day) AS p, s, event_id FROM ar)
SELECT user_id, day, i AS position, item FROM n WHERE i <= p + 1 + 2""")
def _(t):
    around = _add(t)
    place = Q.event_position(around, SESSION, "item").select(*SESSION, (F.col("position") + 3).alias("kept"))
    return Q.rows_of_cuts(around, place, SESSION, ["s", "event_id"]).select(*SESSION, "position", "item")


@query("seq14_cut_points", f"""
WITH {_AROUND}, z AS (SELECT user_id, day, count(*) FILTER (side < 0) AS p, count(*) FILTER (side > 0) AS a FROM ar GROUP BY user_id, day),
 c AS (SELECT user_id, day, p, unnest(generate_series(0, least(10, a // 2 * 2), 2)) AS cut FROM z), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY s, event_id) AS i FROM ar)
SELECT n.user_id, n.day, CAST(cut AS INT) AS cut, event_id, i AS position FROM n JOIN c ON c.user_id = n.user_id AND c.day = n.day AND i <= p + cut + 1""")
def _(t):
    around = _add(t)
    cuts = Q.cut_points(around, SESSION, ["s", "event_id"])
    return Q.rows_of_cuts(around, cuts, SESSION, ["s", "event_id"]).select(*SESSION, "cut", "event_id", "position")


@query("seq15_snap_even", f"""
WITH {_AROUND} SELECT user_id, day, CAST(least(10, count(*) FILTER (side > 0) // 2 * 2) AS INT) AS nb_after FROM ar GROUP BY user_id, day""")
def _(t):
    return Q.event_position(_add(t), SESSION, "item").select(*SESSION, S.snap_even(F.col("n_after")).alias("nb_after"))


@query("seq16_resampled_buckets", """
WITH n AS (SELECT l_orderkey AS k, least(10, count(*) // 2 * 2) AS bucket FROM lineitem GROUP BY 1),
 s AS (SELECT k, CAST(bucket AS INT) AS bucket, CASE WHEN k % 3 = 0 THEN 'test' ELSE 'valid' END AS split FROM n),
 q AS (SELECT bucket, floor((count(*) FILTER (split = 'valid') / (SELECT count(*) FROM s WHERE split = 'valid') - count(*) FILTER (split = 'test') / (SELECT count(*) FROM s WHERE split = 'test')) * (SELECT count(*) FROM s WHERE split = 'valid') + 1e-9) AS quota FROM s WHERE bucket > 0 GROUP BY bucket),
 d AS (SELECT k, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5(CAST(k AS VARCHAR) || '|0')) AS i FROM s WHERE split = 'valid' AND bucket > 0)
SELECT s.k, s.bucket, split, CASE WHEN i <= quota THEN 0 ELSE s.bucket END AS new_bucket FROM s LEFT JOIN d USING (k) LEFT JOIN q ON q.bucket = s.bucket""")
def _(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("_n"))
    rows = n.select("k", S.snap_even(F.col("_n")).alias("bucket"), F.when(F.pmod("k", F.lit(3)) == 0, "test").otherwise("valid").alias("split"))
    return Q.resample_to(rows, ["k"], "bucket", "split", "valid", "test")


@query("seq16_balanced_buckets", """
WITH n AS (SELECT l_orderkey AS k, least(10, count(*) // 2 * 2) AS bucket FROM lineitem GROUP BY 1),
 s AS (SELECT k, CAST(bucket AS INT) AS bucket, CASE WHEN k % 3 = 0 THEN 'test' ELSE 'valid' END AS split FROM n),
 z AS (SELECT bucket, count(*) FILTER (split = 'valid') / (SELECT count(*) FROM s WHERE split = 'valid') AS a, count(*) FILTER (split = 'test') / (SELECT count(*) FROM s WHERE split = 'test') AS b FROM s WHERE bucket > 0 GROUP BY bucket),
 q AS (SELECT bucket, floor((a - (a + b) / 2) * (SELECT count(*) FROM s WHERE split = 'valid') + 1e-9) AS quota FROM z),
 d AS (SELECT k, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5(CAST(k AS VARCHAR) || '|0')) AS i FROM s WHERE split = 'valid' AND bucket > 0)
SELECT s.k, s.bucket, split, CASE WHEN i <= quota THEN 0 ELSE s.bucket END AS new_bucket FROM s LEFT JOIN d USING (k) LEFT JOIN q ON q.bucket = s.bucket""")
def _(t):
    """The target is the mean of both distributions."""
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("_n"))
    rows = n.select("k", S.snap_even(F.col("_n")).alias("bucket"), F.when(F.pmod("k", F.lit(3)) == 0, "test").otherwise("valid").alias("split"))
    return Q.resample_to(rows, ["k"], "bucket", "split", "valid", "test", balanced=True)


_KINDS = ("signup", "view", "click", "purchase")


@query("seq17_counts_around_add", f"WITH {_AROUND} SELECT user_id, day, " + ", ".join(
    f"count(*) FILTER (side = -1 AND event_type = '{k}') AS {k}_before, count(*) FILTER (side = 1 AND event_type = '{k}') AS {k}_after" for k in _KINDS)
    + " FROM ar GROUP BY user_id, day")
def _(t):
    return Q.side_counts(_add(t), SESSION, {k: F.col("event_type") == k for k in _KINDS})


@query("seq18_added_item_attributes", f"""
WITH {_AROUND} SELECT user_id, day, item AS event_item, round(value, 6) AS event_value, s AS event_s FROM ar WHERE side = 0""")
def _(t):
    return Q.event_attributes(_add(t), SESSION, ["item", "value", "s"]).withColumn("event_value", rounded("event_value"))


@query("seq19_session_totals", f"""
WITH {_EV} SELECT user_id, day, count(*) AS n_interactions, count(DISTINCT item) AS n_items, count(*) FILTER (event_type = 'view') AS n_queries FROM ev GROUP BY user_id, day""")
def _(t):
    return Q.session_totals(sessions(t), SESSION, "item", F.col("event_type") == "view")


_USER_AROUND = _EV + """, sq AS (SELECT user_id, min((s, event_id)) AS spot FROM ev WHERE event_type = 'signup' GROUP BY ALL),
 ar AS (SELECT ev.*, CASE WHEN (s, event_id) < spot THEN -1 WHEN (s, event_id) = spot THEN 0 ELSE 1 END AS side FROM ev JOIN sq USING (user_id))"""


@query("seq20_neighbours_spread", f"""
WITH {_USER_AROUND}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1 AS k FROM ar WHERE side < 0),
 a0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id DESC) AS r FROM ar WHERE side > 0),
 a AS (SELECT *, max(r) OVER (PARTITION BY user_id) - r AS k FROM a0 WHERE r <= 5)
SELECT u.user_id, """ + ", ".join(
    f"coalesce((SELECT item FROM a WHERE a.user_id = u.user_id AND k = {i}), 0) AS item_after_{i}, coalesce((SELECT item FROM b WHERE b.user_id = u.user_id AND k = {i}), 0) AS item_before_{i}" for i in range(5))
    + " FROM (SELECT DISTINCT user_id FROM ar) u")
def _(t):
    around = Q.around_event(sessions(t), ["user_id"], ["s", "event_id"], F.col("event_type") == "signup")
    return Q.spread_neighbours(around, ["user_id"], ["s", "event_id"], {"item": 0}, 5)


@query("seq21_vector_similarity", f"""
WITH {_USER_AROUND},
 g AS (SELECT user_id, item, max(CAST(side < 0 AS INT)) AS b, max(CAST(side > 0 AS INT)) AS a, max(CAST(side = 0 AS INT)) AS e FROM ar GROUP BY user_id, item),
 v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), w AS (SELECT * FROM g JOIN v ON vec_id = item),
 d AS (SELECT w.user_id, w.item <> o.item AS other, w.a, w.b, list_cosine_distance(o.x, w.x) AS d FROM w JOIN w o ON o.user_id = w.user_id AND o.e = 1)
SELECT user_id, """ + ", ".join(f"round(coalesce(avg(d) FILTER ({c}), 0), 5) AS sim_mean_{n}, round(coalesce(stddev_pop(d) FILTER ({c}), 0), 5) AS sim_std_{n}"
                                for n, c in (("all", "other"), ("before", "b = 1"), ("after", "a = 1"))) + " FROM (SELECT DISTINCT user_id FROM ar) LEFT JOIN d USING (user_id) GROUP BY user_id")
def _(t):
    around = Q.around_event(sessions(t), ["user_id"], ["s", "event_id"], F.col("event_type") == "signup")
    out = Q.event_similarity(around, ["user_id"], "item", t.embeddings, "vec_id", "embedding", "sim")
    return out.select("user_id", *[rounded(c, digits=5) for c in out.columns if c != "user_id"])


@query("seq21_category_shares", f"""
WITH {_AROUND}, c AS (SELECT user_id, day, event_type, 'signup' AS ec FROM ar) SELECT user_id, day, round(count(DISTINCT event_type) / count(*), 6) AS category_diversity, round(avg(CAST(event_type = ec AS INT)), 6) AS category_share FROM c GROUP BY user_id, day""")
def _(t):
    return Q.category_shares(_add(t), SESSION, "event_type").select(*SESSION, rounded("category_diversity"), rounded("category_share"))


@query("seq22_queries_per_session", f"""
WITH {_EV}, q AS (SELECT user_id, day, count(*) AS n FROM ev WHERE event_type = 'view' GROUP BY ALL) SELECT event_id, coalesce(n, 0) AS n_queries FROM ev LEFT JOIN q USING (user_id, day)""")
def _(t):
    return with_group(sessions(t), SESSION, n_queries=F.count_if(F.col("event_type") == "view")).select("event_id", "n_queries")


@query("seq23_vectors_or_zero", """
SELECT p_partkey AS vec_id, round(coalesce(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 0), 5) AS energy FROM part LEFT JOIN embeddings ON vec_id = p_partkey""")
def _(t):
    items = t.part.select(F.col("p_partkey").alias("vec_id"))
    filled = Q.vectors_or_zero(items, t.embeddings, "vec_id", "embedding", 64)
    energy = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return filled.select("vec_id", rounded(energy, "energy", 5))


@query("seq24_item_embeddings")
def _(t):
    lists = Q.chunk_lists(sessions(t), ["user_id"], ["s", "event_id"], ["item"], Q.CHUNK)
    words = lists.select(F.col("item_list").cast("array<string>").alias("items"))
    model = Q.item_embeddings(words, "items", size=8)
    return model.getVectors().select(F.col("word").alias("item"), vector_to_array("vector").alias("vector"))


@query("seq24_cooccurrences", f"""
WITH {_EV}, o AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS p FROM ev),
 w AS (SELECT x.item AS a, y.item AS b FROM o x JOIN o y ON x.user_id = y.user_id AND x.p <> y.p AND abs(x.p - y.p) <= 5)
SELECT a, b, count(*) AS n FROM w GROUP BY a, b""")
def _(t):
    return E.cooccurrences(sessions(t), ["user_id"], ["s", "event_id"], "item").select("a", "b", big("n"))


@query("seq24_association", f"""
WITH {_EV}, o AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS p FROM ev),
 w AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM o x JOIN o y ON x.user_id = y.user_id AND x.p <> y.p AND abs(x.p - y.p) <= 5 GROUP BY ALL),
 e AS (SELECT a AS item, sum(n) AS m FROM w GROUP BY 1), t AS (SELECT sum(n) AS m FROM w),
 r AS (SELECT w.a, w.b, ln(n::DOUBLE * t.m::DOUBLE / (x.m::DOUBLE * y.m::DOUBLE)) AS weight FROM w, t, e x, e y WHERE x.item = w.a AND y.item = w.b)
SELECT a, b, round(weight, 6) AS weight FROM r WHERE weight > 1e-9""")
def _(t):
    counts = E.cooccurrences(sessions(t), ["user_id"], ["s", "event_id"], "item")
    return E.association(counts).filter("weight > 1e-9").select("a", "b", rounded("weight"))


@query("seq24_item_vectors")
def _(t):
    counts = E.cooccurrences(sessions(t), ["user_id"], ["s", "event_id"], "item")
    return E.item_vectors(E.association(counts), size=8)[0]


@query("seq24_nearest_items", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 s AS (SELECT q.vec_id AS item, v.vec_id AS nearest, round(list_cosine_similarity(q.x, v.x), 9) AS similarity FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY similarity DESC, nearest) AS rank FROM s)
SELECT item, nearest, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def _(t):
    """The five most similar vectors of every hundredth one."""
    found = N.nearest(t.embeddings.filter("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding", 64, k=5)
    return found.select(F.col("query").alias("item"), "nearest", rounded("similarity"), "rank")


@query("seq25_placeholder_item", """
WITH $LOG, r AS (SELECT basket, item, row_number() OVER (PARTITION BY basket ORDER BY line DESC, item DESC, author DESC, price DESC, ship DESC) AS b FROM log),
 l AS (SELECT basket, list(item ORDER BY b DESC) AS items FROM r WHERE b <= 5 GROUP BY basket) SELECT basket, array_to_string(list_append(items[1:4], 1), ',') AS items FROM l""")
def _(t):
    lists = Q.last_lists(t.log, ["basket"], LINE_ORDER, ["item"], 5)
    return lists.select("basket", text(Q.placeholder(F.col("item_list"), 5), "items"))


# --- top-k ------------------------------------------------------------------

_BEST = """s AS (SELECT l_suppkey AS row_id, l_partkey AS item, max((l_partkey * 37 + l_suppkey * 11 + l_linenumber) % 1000 / 1000) AS score FROM lineitem GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, item) AS rank FROM s)"""


def _scores(t):
    return scored(t).groupBy(F.col("l_suppkey").alias("row_id"), F.col("l_partkey").alias("item")).agg(F.max("score").alias("score"))


@query("topk1_best_items", f"WITH {_BEST} SELECT row_id, item, score, rank FROM r WHERE rank <= 50")
def _(t):
    return R.top_items(_scores(t), ["row_id"], "item", "score", 50).withColumn("rank", big("rank"))


@query("topk2_ordered_lists", f"""
WITH {_BEST} SELECT row_id, string_agg(CAST(item AS VARCHAR), ',' ORDER BY rank) AS items, string_agg(CAST(CAST(round(score * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY rank) AS scores FROM r WHERE rank <= 20 GROUP BY row_id""")
def _(t):
    lists = R.top_lists(_scores(t), ["row_id"], "item", "score", 20)
    return lists.select("row_id", text("items"), scaled("scores"))


@query("topk3_wide_and_long", f"WITH {_BEST} SELECT row_id, CAST(rank AS INT) AS rank, item, score FROM r WHERE rank <= 4")
def _(t):
    wide = R.to_wide(R.top_items(_scores(t), ["row_id"], "item", "score", 4), ["row_id"], "item", "score", 4)
    return R.to_long(wide, ["row_id"], 4)


@query("topk3_wide_columns", f"WITH {_BEST} SELECT row_id, " + ", ".join(
    f"max(CASE WHEN rank = {i + 1} THEN item END) AS rec{i}, max(CASE WHEN rank = {i + 1} THEN score END) AS prob{i}" for i in range(4)) + " FROM r GROUP BY row_id")
def _(t):
    return R.to_wide(R.top_items(_scores(t), ["row_id"], "item", "score", 4), ["row_id"], "item", "score", 4)


# --- splits -----------------------------------------------------------------

@query("spl1_modulo", "SELECT o_orderkey, o_orderkey % 5 AS split FROM orders")
def _(t):
    return t.orders.select("o_orderkey", P.modulo(F.col("o_orderkey"), 5).alias("split"))


@query("spl2_time_split", """
SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' WHEN ts < TIMESTAMP '2024-01-25' THEN 'valid' ELSE 'test' END AS by_time,
 CASE WHEN isodow(ts) IN (6, 7) THEN 'valid' ELSE 'train' END AS by_weekday FROM events""")
def _(t):
    at = F.col("ts").cast("timestamp")
    return t.events.select("event_id", P.time_split(F.col("ts"), *[F.lit(d).cast("timestamp_ntz") for d in ("2024-01-20", "2024-01-25")]).alias("by_time"),
                           P.weekday_split(at, [5, 6]).alias("by_weekday"))


@query("spl3_position_split", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) SELECT event_id, CASE WHEN i < 600 THEN 'train' WHEN i < 800 THEN 'valid' WHEN i < 1000 THEN 'test' END AS split FROM r""")
def _(t):
    from cartloom.operators.rows import number_rows

    ids = number_rows(t.events, ["ts", "event_id"], "i")
    return ids.select("event_id", P.id_range(F.col("i"), {"train": 600, "valid": 200, "test": 200}).alias("split"))


_MD5 = lambda c: f"CAST(concat('0x', right(md5(CAST({c} AS VARCHAR) || '|0'), 8)) AS UBIGINT)"


@query("spl4_group_folds", f"SELECT o_orderkey, CAST({_MD5('o_custkey')} % 5 AS INT) AS fold FROM orders")
def _(t):
    return t.orders.select("o_orderkey", P.hash_fold(["o_custkey"], 5).alias("fold"))


@query("spl4_balanced_folds", """
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT *, (row_number() OVER (ORDER BY n DESC, o_custkey) - 1) % 10 AS t FROM n)
SELECT o_custkey, n, CAST(CASE WHEN t < 5 THEN t ELSE 9 - t END AS INT) AS fold FROM p""")
def _(t):
    return P.balanced_group_folds(t.orders, "o_custkey", 5)


@query("spl5_contiguous_folds", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () // 7 AS size FROM orders)
SELECT o_orderkey, CAST(least(i // size, 6) AS INT) AS clipped, CAST(i // size % 7 AS INT) AS wrapped FROM r""")
def _(t):
    a = P.contiguous_folds(t.orders.select("o_orderkey"), ["o_orderkey"], 7, fold="clipped")
    return P.contiguous_folds(a, ["o_orderkey"], 7, wrap=True, fold="wrapped")


@query("spl6_recent_sessions", f"""
WITH e AS (SELECT event_id, user_id, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) // 86400000000 + 1 AS day_index FROM events)
SELECT event_id, day_index, CAST(day_index <= 7 AS INT) AS is_valid, CAST({_MD5('user_id')} % 5 + 1 AS INT) AS fold FROM e""")
def _(t):
    index = D.days_before_end(F.col("ts"), t.events.select(F.max("ts")).scalar())
    return t.events.select("event_id", index.alias("day_index"), P.recent_sessions(index, 7).alias("is_valid"), P.hash_fold(["user_id"], 5, first=1).alias("fold"))


@query("spl7_hash_split", f"SELECT event_id, CASE WHEN {_MD5('event_id')} % 10000 < 8000 THEN 'train' ELSE 'valid' END AS split FROM events")
def _(t):
    return t.events.select("event_id", P.hash_split(["event_id"], 0.8).alias("split"))


@query("spl8_running_modulo", "SELECT event_id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) % 5 AS INT) AS fold FROM events")
def _(t):
    return P.running_modulo(t.events, ["ts", "event_id"], 5).select("event_id", "fold")
