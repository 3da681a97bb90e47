"""Prediction blending, ranking and classification metrics."""

from pyspark.sql import functions as F

from cartloom.functions import scalars as S
from cartloom.operators import blending as B
from cartloom.operators import metrics as M
from cartloom.operators import ranking as R
from cartloom.plans.registry import big, query, rounded
from cartloom.runtime import stored

# Scores of three made-up models over the given pairs, drawn from their keys.
_RUNS = """runs AS (SELECT l_suppkey AS sess, l_partkey AS item, 'm' || m AS model, m AS bag, avg((l_partkey * (37 + m) + l_suppkey * 11 + l_linenumber) % 1000) / 1000 AS score
 FROM lineitem, (SELECT unnest([0, 1, 2]) AS m) GROUP BY ALL)"""


def runs(t, *bags):
    """The runs of the given bags, of all three without any; each pair's lines are gathered once for all bags."""
    bags = bags or (0, 1, 2)
    item, sess, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    raw = lambda i: F.pmod(item * (i + 37) + sess * 11 + line, F.lit(1000))
    means = t.lineitem.groupBy(sess.alias("sess"), item.alias("item")).agg(*[(F.avg(raw(i)) / 1000).alias(f"_{i}") for i in bags])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("bag"), F.col(f"_{i}").alias("score")) for i in bags]))
    return means.select("sess", "item", each.alias("_run")).select("sess", "item", "_run.bag", "_run.score", F.concat(F.lit("m"), "_run.bag").alias("model"))


# A classification table: score, label, bucket 0..10 and group per line.
_PRED = """pred AS (SELECT l_orderkey AS k, l_linenumber AS line, (l_partkey * 37 + l_suppkey * 11 + l_linenumber) % 997 / 1000 AS p, CAST(l_returnflag = 'R' AS INT) AS y,
 CAST(least(10, l_linenumber // 2 * 2) AS INT) AS bucket, l_linestatus || l_returnflag AS flags, l_suppkey % 5 AS grp FROM lineitem)"""


def pred(t):
    p = F.pmod(F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + F.col("l_linenumber"), F.lit(997)) / 1000
    return t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), p.alias("p"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"), S.snap_even(F.col("l_linenumber")).alias("bucket"),
        F.pmod("l_suppkey", F.lit(5)).alias("grp"))


@query("bld1_average_runs", f"WITH {_RUNS} SELECT sess, item, round(avg(score), 6) AS score FROM runs GROUP BY ALL")
def _(t):
    return B.average_runs(runs(t), ["sess", "item"], ["score"]).select("sess", "item", rounded("score"))


@query("bld2_convex_blend", f"""
WITH {_RUNS}, w AS (SELECT sess, item, max(score) FILTER (bag = 0) AS a, max(score) FILTER (bag = 1) AS b, max(score) FILTER (bag = 2) AS c FROM runs GROUP BY ALL)
SELECT sess, item, round((a * 0.6 + b * 0.4) * 0.7 + c * 0.3, 6) AS score FROM w""")
def _(t):
    at = lambda i, n: F.max(F.when(F.col("bag") == i, F.col("score"))).alias(n)
    wide = runs(t).groupBy("sess", "item").agg(at(0, "a"), at(1, "b"), at(2, "c"))
    blend = B.convex(F.col("a"), (F.col("b"), 0.4), (F.col("c"), 0.3))
    return wide.select("sess", "item", rounded(blend, "score"))


@query("bld3_equal_blend", f"""
WITH {_RUNS} SELECT sess, item, round((max(score) FILTER (bag = 0) + max(score) FILTER (bag = 1)) / 2, 6) AS score FROM runs GROUP BY ALL""")
def _(t):
    at = lambda i, n: F.max(F.when(F.col("bag") == i, F.col("score"))).alias(n)
    wide = runs(t).groupBy("sess", "item").agg(at(0, "a"), at(1, "b"))
    return wide.select("sess", "item", rounded(B.equal(F.col("a"), F.col("b")), "score"))


@query("bld4_weighted_models", f"""
WITH {_RUNS} SELECT sess, item, round(sum(score * CASE model WHEN 'm0' THEN 0.5 WHEN 'm1' THEN 0.3 ELSE 0.2 END), 6) AS score FROM runs GROUP BY ALL""")
def _(t):
    blended = B.weighted_runs(runs(t), ["sess", "item"], "model", "score", {"m0": 0.5, "m1": 0.3, "m2": 0.2})
    return blended.select("sess", "item", rounded("score"))


@query("bld5_sparse_top_blend", f"""
WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY model, sess ORDER BY score DESC, item) AS i FROM runs),
 b AS (SELECT sess, item, round(sum(score * CASE bag WHEN 0 THEN 0.32 ELSE 0.34 END), 9) AS score FROM r WHERE i <= 50 GROUP BY ALL)
SELECT sess, item, round(score, 6) AS score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sess ORDER BY score DESC, item) AS k FROM b) WHERE k <= 4""")
def _(t):
    # All bags' lists in one pass; a task that ranks them holds one sort.
    best = stored(R.top_items(runs(t), ["bag", "sess"], "item", "score", 50).drop("rank"))
    top = lambda i: best.filter(F.col("bag") == i)
    blended = B.blend_top([(top(0), 0.32), (top(1), 0.34), (top(2), 0.34)], ["sess"], "item", "score", 4)
    return blended.select("sess", "item", rounded("score"), big("rank"))


@query("bld6_exploded_lists", f"""
WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY sess ORDER BY score DESC, item) AS i FROM runs WHERE bag = 0),
 e AS (SELECT sess, item, i, exp(score - max(score) OVER (PARTITION BY sess)) AS e, count(*) OVER (PARTITION BY sess) AS n FROM r WHERE i <= 100)
SELECT sess, CAST(i - 1 AS INT) AS place, item, round(e / sum(e) OVER (PARTITION BY sess) * log2(n), 6) AS prob, 'xl' AS algorithm, 0 AS bag FROM e""")
def _(t):
    lists = R.top_lists(runs(t, 0), ["sess"], "item", "score", 100)
    rows = B.explode_predictions(lists, ["sess"], "items", "scores", algorithm="xl", bag=0)
    return rows.withColumn("prob", rounded("prob"))


@query("bld7_level_one_day", """
WITH e AS (SELECT event_id, day(ts) AS d, hour(ts) AS h, value FROM events),
 r AS (SELECT avg(value) FILTER (d = 17 AND h = 23) / nullif(avg(value) FILTER (d = 18 AND h = 0), 0) AS a, avg(value) FILTER (d = 19 AND h = 0) / nullif(avg(value) FILTER (d = 18 AND h = 23), 0) AS b FROM e),
 f AS (SELECT coalesce(0.5 * a + 0.5 * b, a, b, 1) AS f FROM r)
SELECT event_id, round(CASE WHEN d = 18 THEN value * f ELSE value END, 6) AS value, round(CASE WHEN d = 18 THEN value * 0.85 ELSE value END, 6) AS fixed FROM e, f""")
def _(t):
    e = t.events.select("event_id", F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h"), "value", F.col("value").alias("fixed"))
    levelled = B.scale_day(e, "d", "h", "value", 18)
    both = B.scale_where(levelled, F.col("d") == 18, "fixed", 0.85)
    return both.select("event_id", rounded("value"), rounded("fixed"))


@query("bld8_votes", f"""
WITH {_RUNS}, v AS (SELECT sess, item, count(*) FILTER (score >= 0.6) AS n_yes, count(*) AS n_runs, round(avg(score), 9) AS m FROM runs GROUP BY ALL)
SELECT sess, item, n_yes, CAST(n_yes * 2 > n_runs AS INT) AS majority, CAST(n_yes >= 2 AS INT) AS at_least, CAST(n_yes > 0 AS INT) AS any_yes, CAST(m >= 0.6 AS INT) AS by_mean FROM v""")
def _(t):
    rows = runs(t)
    v = B.votes(rows, ["sess", "item"], "score", 0.6)
    by_mean = (F.round("mean_score", 9) >= 0.6).cast("int")
    return v.select("sess", "item", big("n_yes"), "majority", "at_least", "any_yes", by_mean.alias("by_mean"))


@query("bld9_filtered_predictions", f"""
WITH {_RUNS}, s AS (SELECT DISTINCT l_suppkey AS sess, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R')
SELECT sess, item, round(score, 6) AS score FROM runs WHERE bag = 0 AND item IN (SELECT p_partkey FROM part WHERE p_type <> 'ECONOMY') AND (sess, item) NOT IN (SELECT (sess, item) FROM s) AND item NOT IN (1, 2, 3)""")
def _(t):
    products = t.part.filter("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("item"))
    seen = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("sess"), F.col("l_partkey").alias("item"))
    kept = B.filter_predictions(runs(t, 0), ["sess"], "item", products, seen, [1, 2, 3])
    return kept.select("sess", "item", rounded("score"))


@query("bld10_rare_ids_restored", """
WITH v AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) AS code FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 30))
SELECT l_orderkey, l_linenumber, v.l_partkey AS restored FROM lineitem l LEFT JOIN v ON v.l_partkey = l.l_partkey""")
def _(t):
    from cartloom.operators import encoders as E

    v = E.vocabulary(t.lineitem, "l_partkey", start=1, min_count=30)
    coded = E.encode(t.lineitem, v, "l_partkey", "code", 0)
    return E.decode(coded, v, "code", "restored").select("l_orderkey", "l_linenumber", "restored")


@query("bld11_mean_then_softmax", f"""
WITH {_RUNS}, a AS (SELECT sess, item, avg(score) AS s FROM runs GROUP BY ALL), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY sess)) AS e FROM a)
SELECT sess, item, round(e / sum(e) OVER (PARTITION BY sess), 8) AS prob FROM e""")
def _(t):
    return B.average_then_softmax(runs(t), ["sess"], "item", "score").select("sess", "item", rounded("prob", digits=8))


# --- metrics ----------------------------------------------------------------

@query("met1_reciprocal_rank", """
WITH s AS (SELECT l_suppkey, l_partkey, max((l_partkey * 37 + l_suppkey * 11 + l_linenumber) % 1000 / 1000) AS score, max(CAST(l_returnflag = 'R' AND l_linenumber = 1 AS INT)) AS hit FROM lineitem GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_partkey) AS k FROM s)
SELECT round(avg(1 / k), 6) AS mrr, count(*) AS n FROM r WHERE hit = 1""")
def _(t):
    score = F.pmod(F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + F.col("l_linenumber"), F.lit(1000)) / 1000
    hit = ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).cast("int")
    s = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.max(score).alias("score"), F.max(hit).alias("hit"))
    return M.reciprocal_rank(s, ["l_suppkey"], "l_partkey", "score", F.col("hit") == 1).select(rounded("mrr"), "n")


_LISTS = f"""{_RUNS}, pr AS (SELECT sess, item, i FROM (SELECT *, row_number() OVER (PARTITION BY sess ORDER BY score DESC, item) AS i FROM runs WHERE bag = 0) WHERE i <= 20),
 lb AS (SELECT sess, item, row_number() OVER (PARTITION BY sess ORDER BY f DESC, item) AS k FROM (SELECT sess, item, max(score) AS f FROM runs WHERE bag = 1 GROUP BY ALL))"""


def _lists(t, first: bool = False):
    preds = R.top_lists(runs(t, 0), ["sess"], "item", "score", 20).select("sess", F.col("items").alias("preds"))
    # Recall needs whole labels; the reciprocal rank only the first, which is kept map-side.
    scored = runs(t, 1).groupBy("sess", "item").agg(F.max("score").alias("score"))
    ordered = F.struct((-F.col("score")).alias("s"), "item")
    kept = F.array(F.min(ordered)) if first else F.array_sort(F.collect_list(ordered))
    labels = scored.groupBy("sess").agg(kept["item"].alias("labels"))
    return preds.join(labels, "sess")


@query("met2_list_mrr", f"""
WITH {_LISTS} SELECT l.sess, round(coalesce(1 / p.i, 0), 6) AS rr FROM lb l LEFT JOIN pr p USING (sess, item) WHERE l.k = 1""")
def _(t):
    return _lists(t, first=True).select("sess", rounded(M.list_reciprocal(F.col("preds"), F.col("labels"), 20), "rr"))


@query("met3_list_f1", f"""
WITH {_LISTS}, h AS (SELECT s.sess, count(p.item) AS h, count(l.item) AS n FROM (SELECT DISTINCT sess FROM pr) s JOIN lb l USING (sess) LEFT JOIN pr p USING (sess, item) GROUP BY s.sess)
SELECT round(avg(h / 20), 6) AS precision, round(avg(h / n), 6) AS recall, round(avg(CASE WHEN h > 0 THEN 2 * (h / 20) * (h / n) / (h / 20 + h / n) ELSE 0 END), 6) AS f1 FROM h""")
def _(t):
    m = M.session_metrics(_lists(t), "preds", "labels", 20)
    return m.select(rounded("precision"), rounded("recall"), rounded("f1"))


_WEIGHT = "(1 - bucket / 20)"


@query("met4_weighted_micro_f1", f"""
WITH {_PRED}, a AS (SELECT bucket, avg(CAST(CAST(p > 0.5 AS INT) = y AS INT)) AS acc FROM pred GROUP BY bucket) SELECT round(sum(acc * {_WEIGHT}), 6) AS weighted_f1 FROM a""")
def _(t):
    return M.weighted_micro_f1(pred(t), "bucket", F.col("p") > 0.5, "y").select(rounded("weighted_f1"))


@query("met5_precision_at_4", f"""
WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY sess ORDER BY score DESC, item) AS i FROM runs WHERE bag = 0), g AS (SELECT sess, arg_min(item, (-score, item)) AS target FROM runs WHERE bag = 2 GROUP BY sess),
 h AS (SELECT sess, max(CAST(item = target AS INT)) AS hit FROM r JOIN g USING (sess) WHERE i <= 4 GROUP BY sess) SELECT round(avg(hit), 6) AS precision_at_4, count(*) AS n FROM h""")
def _(t):
    best = R.best_value(F.col("item"), F.col("score")).alias("target")
    targets = runs(t, 2).groupBy("sess").agg(best)
    return M.hit_rate(runs(t).join(targets, "sess"), ["sess"], "item", "score", "target", 4, F.col("bag") == 0).select(rounded("precision_at_4"), "n")


@query("met6_relative_cross_entropy", f"""
WITH {_PRED}, q AS (SELECT y, coalesce(p0, avg(p0) OVER ()) AS p FROM (SELECT y, CASE WHEN bucket <> 4 THEN p END AS p0 FROM pred)),
 a AS (SELECT avg(y) AS m, -avg(CASE WHEN y > 0 THEN ln(p + 1e-15) ELSE ln(1 - p + 1e-15) END) AS ce, count(*) AS n FROM q)
SELECT n, round(m, 6) AS rate, round((1 - ce / -(m * ln(m) + (1 - m) * ln(1 - m))) * 100, 5) AS rce FROM a""")
def _(t):
    rows = pred(t).withColumn("p", F.when(F.col("bucket") != 4, F.col("p")))
    return M.relative_cross_entropy(rows, "p", "y").select("n", rounded("rate"), rounded("rce", digits=5))


_CURVE = lambda by: f"""c AS (SELECT {by}p, sum(y) AS pos, sum(1 - y) AS neg FROM pred GROUP BY ALL),
 s AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM c WINDOW w AS ({'PARTITION BY ' + by.rstrip(', ') if by else ''} ORDER BY p DESC)),
 q AS (SELECT *, tp / (tp + fp) AS prec, CASE WHEN tp + fp - pos - neg > 0 THEN (tp - pos) / (tp + fp - pos - neg) ELSE 1 END AS prev FROM s)"""


# Scores of two buckets are missing: null in one, not a number in the other.
_GAPS = f"{_PRED.replace('pred AS', 'whole AS', 1)}, pred AS (SELECT * REPLACE (coalesce(CASE WHEN bucket NOT IN (2, 4) THEN p END, avg(CASE WHEN bucket NOT IN (2, 4) THEN p END) OVER ()) AS p) FROM whole)"


def gaps(t):
    p = F.when(F.col("bucket") == 4, None).when(F.col("bucket") == 2, F.lit(float("nan"))).otherwise(F.col("p"))
    return pred(t).withColumn("p", p)


@query("met7_pr_auc", f"WITH {_GAPS}, {_CURVE('')} SELECT round(sum(pos * (prec + prev) / 2) / sum(pos), 6) AS pr_auc FROM q")
def _(t):
    return M.curve_areas(gaps(t), "p", "y").select(rounded("pr_auc"))


@query("met8_roc_auc", f"WITH {_GAPS}, {_CURVE('')} SELECT CAST(sum(pos) AS BIGINT) AS n_pos, round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM q")
def _(t):
    return M.curve_areas(gaps(t), "p", "y").select("n_pos", rounded("roc_auc"))


@query("met9_grouped_precision", f"""
WITH {_PRED}, {_CURVE('grp, ')}, g AS (SELECT grp, CAST(sum(pos) AS BIGINT) AS n_pos, sum(pos * prec) / sum(pos) AS ap FROM q GROUP BY grp)
SELECT grp, n_pos, round(ap, 6) AS ap, round((SELECT avg(ap) FROM g), 6) AS mean_ap FROM g""")
def _(t):
    return M.grouped_precision(pred(t), "p", "y", "grp").select("grp", "n_pos", rounded("ap"), rounded("mean_ap"))


@query("met10_ranking_metrics", f"""
WITH s AS (SELECT l_suppkey AS q, l_partkey AS item, max((l_partkey * 37 + l_suppkey * 11 + l_linenumber) % 1000 / 1000) AS score, max(CAST(l_returnflag = 'R' AS INT)) AS y FROM lineitem GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS i, sum(y) OVER (PARTITION BY q) AS rel FROM s), t AS (SELECT *, sum(y) OVER (PARTITION BY q ORDER BY i) AS c, row_number() OVER (PARTITION BY q ORDER BY y DESC, i) AS j0 FROM r WHERE i <= 20),
 k AS (SELECT unnest([5, 10, 20]) AS k), e AS (SELECT k, q, sum(y) FILTER (i <= k) AS h, max(rel) AS rel, sum(y * c / i) FILTER (i <= k) AS ap, sum(y / log2(i + 1)) FILTER (i <= k) AS dcg, sum(y / log2(j0 + 1)) FILTER (j0 <= k) AS idcg FROM t, k GROUP BY ALL)
SELECT CAST(k AS INT) AS k, round(avg(h / k), 6) AS precision, round(avg(CASE WHEN rel > 0 THEN h / rel ELSE 0 END), 6) AS recall, round(avg(ap / least(greatest(rel, 1), k)), 6) AS ap, round(avg(dcg), 6) AS dcg,
 round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg, count(*) AS n FROM e GROUP BY k""")
def _(t):
    score = F.pmod(F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + F.col("l_linenumber"), F.lit(1000)) / 1000
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("item")).agg(
        F.max(score).alias("score"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"))
    m = M.ranking_metrics(s, ["q"], "item", "score", "y", [5, 10, 20])
    return m.select("k", *[rounded(c) for c in ("precision", "recall", "ap", "dcg", "ndcg")], "n")


@query("met11_label_rates", "SELECT round(avg(quality), 6) AS quality_rate, round(avg(toxic), 6) AS toxic_rate FROM labels")
def _(t):
    m = M.label_rates(t.labels, ["quality", "toxic"])
    return m.select(rounded("quality_rate"), rounded("toxic_rate"))


@query("met12_threshold_sweep", f"""
WITH {_PRED}, h AS (SELECT unnest(range(1, 10)) / 10 AS threshold), a AS (SELECT threshold, bucket, avg(CAST(CAST(p > threshold AS INT) = y AS INT)) AS acc FROM pred, h GROUP BY ALL)
SELECT threshold, round(sum(acc * {_WEIGHT}), 6) AS weighted_f1 FROM a GROUP BY threshold""")
def _(t):
    sweep = M.threshold_sweep(pred(t), "bucket", "p", "y", [i / 10 for i in range(1, 10)])
    return sweep.select("threshold", rounded("weighted_f1"))


@query("met12_best_threshold", f"""
WITH {_PRED}, h AS (SELECT unnest(range(1, 10)) / 10 AS threshold), a AS (SELECT threshold, bucket, avg(CAST(CAST(p > threshold AS INT) = y AS INT)) AS acc FROM pred, h GROUP BY ALL),
 s AS (SELECT threshold, round(sum(acc * {_WEIGHT}), 6) AS weighted_f1 FROM a GROUP BY threshold) SELECT * FROM s ORDER BY weighted_f1 DESC, threshold LIMIT 1""")
def _(t):
    sweep = M.threshold_sweep(pred(t), "bucket", "p", "y", [i / 10 for i in range(1, 10)])
    return M.best_threshold(sweep.withColumn("weighted_f1", rounded("weighted_f1")))


@query("met13_swap_noise", """
WITH a AS (SELECT event_id, value, CAST(value > 40 AS INT) AS y, row_number() OVER (ORDER BY event_id) AS i, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || '|0'), event_id) AS j FROM events),
 b AS (SELECT a.y, c.value FROM a JOIN a c ON a.i = c.j)
SELECT 'none' AS permuted, round(avg(CAST(CAST(value > 38 AS INT) = y AS INT)), 6) AS accuracy FROM a UNION ALL SELECT 'value', round(avg(CAST(CAST(value > 38 AS INT) = y AS INT)), 6) FROM b""")
def _(t):
    rows = t.events.select("event_id", "value", (F.col("value") > 40).cast("int").alias("y"))
    score = lambda df: df.withColumn("p", (F.col("value") > 38).cast("int"))
    metric = lambda df: df.agg(F.round(F.avg((F.col("p") == F.col("y")).cast("int")), 6).alias("accuracy"))
    return M.swap_noise(rows, ["event_id"], ["value"], score, metric)
