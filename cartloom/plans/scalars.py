"""Text, time and vector functions over whole columns."""

from pyspark.sql import functions as F

from cartloom.functions import text as X
from cartloom.functions import timeparts as D
from cartloom.functions import vectors as V
from cartloom.operators.ordered import ordered_list
from cartloom.operators import encoders as E
from cartloom.plans.registry import query, rounded, scaled


@query("str1_token_counts", """
SELECT p_partkey, CAST(CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE len(string_split(p_name, ' ')) END AS INT) AS n FROM part""")
def _(t):
    return t.part.select("p_partkey", X.token_count(F.when(F.col("p_type") != "ECONOMY", F.col("p_name")), " ").alias("n"))


_PATTERNS = {"quest": r"\?", "hash": "#", "at": "@", "excl_quest": r"!|\?"}
# RE2 knows ASCII word borders only: other letters become 'a' first.
_ASCII_WORDS = r"""regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_]', ' ', 'g'), '[^\x00-\x7F]', 'a', 'g')"""


@query("str2_pattern_counts", "SELECT doc_id, " + ", ".join(
    f"CAST(len(regexp_extract_all(text, '{p}')) AS INT) AS {n}" for n, p in _PATTERNS.items())
    + rf", CAST(len(regexp_extract_all({_ASCII_WORDS}, '\b[A-Z]{{2,}}\b')) AS INT) AS capital_words FROM documents")
def _(t):
    names = [*_PATTERNS, "capital_words"]
    return t.documents.select("doc_id", *[X.pattern_count(F.col("text"), X.COUNTED[n]).alias(n) for n in names])


@query("str3_lengths", """
SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(len(string_split(text, ' ')) - 1 AS INT) AS spaces, CAST(len(string_split(text, ' ')) AS INT) AS tokens FROM documents""")
def _(t):
    c = F.col("text")
    return t.documents.select("doc_id", X.char_count(c).alias("chars"), X.space_count(c).alias("spaces"), X.token_count(c, " ").alias("tokens"))


@query("str4_words_at", "SELECT doc_id, " + ", ".join(
    f"coalesce(string_split(text, ' ')[{i + 1}], '') AS w{i}" for i in range(5)) + ", string_split(text, ' ')[-1] AS last1, string_split(text, ' ')[-2] AS last2 FROM documents")
def _(t):
    c = F.col("text")
    return t.documents.select("doc_id", *[X.word_at(c, i, "").alias(f"w{i}") for i in range(5)],
                              X.word_at(c, -1).alias("last1"), X.word_at(c, -2).alias("last2"))


_MENTION = lambda i: f"""coalesce(regexp_extract(string_split(lower(text), '@')[{i + 2}], '^[^ ]*(?: _ [^ ]*)*', 0), '')"""
_CLEAN = lambda e: f"""regexp_replace({e}, '(?s)^(.+)[!?:;.,]\\z', '\\1')"""


@query("str5_mentions", "SELECT doc_id, " + ", ".join(
    f"array_to_string([{_CLEAN('x')} for x in string_split({_MENTION(i)}, ' _ ')], '_') AS m{i}" for i in range(2)) + " FROM documents")
def _(t):
    return t.documents.select("doc_id", *[X.mention(F.col("text"), i).alias(f"m{i}") for i in range(2)])


@query("str6_md5_hash", """
SELECT doc_id, CAST(concat('0x', right(md5(CASE WHEN length(w) <= 2 THEN '0' ELSE w END), 8)) AS UBIGINT)::BIGINT AS h FROM (SELECT doc_id, coalesce(string_split(text, ' ')[2], '') AS w FROM documents)""")
def _(t):
    return t.documents.select("doc_id", X.md5_u32(X.word_at(F.col("text"), 1, "")).alias("h"))


@query("str7_hex_ids", """
SELECT doc_id, CASE WHEN h >= 9223372036854775808 THEN CAST(h - 18446744073709551616 AS BIGINT) ELSE CAST(h AS BIGINT) END AS signed64, CAST(u AS BIGINT) AS u32
FROM (SELECT doc_id, CAST(CAST(concat('0x', right(md5(text), 16)) AS UBIGINT) AS HUGEINT) AS h, CASE WHEN lang = 'en' THEN 0 ELSE CAST(concat('0x', right(md5(text), 8)) AS UBIGINT) END AS u FROM documents)""")
def _(t):
    h = F.md5("text")
    tokens = F.when(F.col("lang") != "en", F.concat(h, F.lit("\tFFFF")))
    return t.documents.select("doc_id", X.hex_to_long(h).alias("signed64"), X.hex_to_u32(tokens).alias("u32"))


_REJOINED = """replace(replace(replace(replace(replace(lower(text), 'http : / / t. co / ', 'http'), 'https : / / t. co / ', 'http'), ' _ ', '_'), '@ ', '@'), '# ', '#')"""


@query("str8_clean_text", f"""
SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace({_REJOINED}, '[cls] rt @', '@'), '[cls] ', ' '), '¶ ', ' '), '\\s+', ' ', 'g'), ' ')) AS clean FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("clean"))


@query("str9_retweet_parts", """
SELECT page_id, CASE WHEN rt THEN string_split(url, ':')[1] ELSE '' END AS head, CASE WHEN rt THEN substr(url, length(string_split(url, ':')[1]) + 2) ELSE url END AS body
FROM (SELECT page_id, url, page_id % 2 = 0 AS rt FROM pages)""")
def _(t):
    rt = F.col("page_id") % 2 == 0
    return t.pages.select("page_id", X.retweet_head(F.col("url"), rt).alias("head"), X.retweet_body(F.col("url"), rt).alias("body"))


@query("str10_ending_class", r"""
WITH a AS (SELECT doc_id, string_split(replace(text || CASE doc_id % 6 WHEN 0 THEN '?' WHEN 1 THEN ' !? ' WHEN 2 THEN '?! http://x' WHEN 3 THEN ' #tag why!' WHEN 4 THEN ' @me' ELSE '' END, '[sep]', ''), 'http')[1] AS x FROM documents),
 b AS (SELECT doc_id, regexp_replace(x, '(?s)^([^#]*)#[^# ]*(?: ([^#]*))?.*\z', '\1\2') AS x FROM a),
 c AS (SELECT doc_id, regexp_replace(regexp_replace(x, '(?s)^([^@]*)@[^@ ]*(?: ([^@]*))?.*\z', '\1\2'), '\s+\z', '') AS x FROM b)
SELECT doc_id, CAST(CASE WHEN length(x) < 2 THEN 0 WHEN right(x, 2) = '!?' THEN 2 WHEN right(x, 2) = '?!' THEN 3 WHEN right(x, 1) = '?' THEN 1 WHEN right(x, 1) = '!' THEN 4 ELSE 0 END AS INT) AS ending FROM c""")
def _(t):
    tails = ("?", " !? ", "?! http://x", " #tag why!", " @me")
    tail = F.lit("")
    for i, end in reversed(list(enumerate(tails))):
        tail = F.when(F.col("doc_id") % 6 == i, end).otherwise(tail)
    return t.documents.select("doc_id", X.ending_class(F.concat("text", tail)).alias("ending"))


@query("str11_text_tests", """
SELECT p_partkey, CAST(contains(p_name, 'ring') AS INT) AS has_ring, CAST(p_type = 'SMALL' AS INT) AS is_small FROM part""")
def _(t):
    return t.part.select("p_partkey", X.has_text(F.col("p_name"), "ring").alias("has_ring"), (F.col("p_type") == "SMALL").cast("int").alias("is_small"))


@query("str12_decoded_tokens", """
SELECT doc_id, md5(replace(text, ' ##', '')) AS decoded FROM documents""")
def _(t):
    from cartloom.operators.sequences import decode_tokens

    vocab = E.vocabulary(t.documents.select(F.explode(F.split("text", " ")).alias("w")), "w")
    items = t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "w"))
    coded = E.encode(items, vocab, "w", "code", skewed=True)
    return decode_tokens(coded, ["doc_id"], "at", "code", vocab, "decoded", skewed=True).select("doc_id", F.md5("decoded").alias("decoded"))


@query("str13_path_heads", "SELECT page_id, string_split(url, '/')[1] AS head, string_split(replace(p, '://', '/'), '/')[1] AS scheme FROM (SELECT page_id, url, url AS p FROM pages)")
def _(t):
    return t.pages.select("page_id", X.path_head(F.col("url")).alias("head"), X.path_head(F.replace("url", F.lit("://"), F.lit("/"))).alias("scheme"))


@query("str14_amenity_tokens", """
WITH u AS (SELECT p_partkey, unnest(['anytime Desk', p_type, p_name, ['one', 'two', 'three', 'four', 'five'][p_size % 5 + 1] || ' star']) AS a FROM part)
SELECT p_partkey, lower(replace(string_agg(a, ' xxnext ' ORDER BY a), '  ', ' ')) AS tokens FROM (SELECT DISTINCT p_partkey, a FROM u) GROUP BY p_partkey""")
def _(t):
    listed = F.concat_ws("|", F.lit("24/7 Desk"), F.col("p_type"), F.concat(F.pmod("p_size", F.lit(5)) + 1, F.lit(" Star")), F.lit("From 2 Stars"), F.col("p_name"))
    return t.part.select("p_partkey", F.array_join(X.amenity_tokens(listed), " ").alias("tokens"))


# --- time -------------------------------------------------------------------

@query("dtm1_parts", """
SELECT event_id, CAST(day(ts) AS INT) AS day, CAST(isodow(ts) - 1 AS INT) AS dow, CAST(hour(ts) AS INT) AS hour, CAST(minute(ts) AS INT) AS minute, CAST(second(ts) AS INT) AS second FROM events""")
def _(t):
    at = D.from_seconds(D.seconds(F.col("ts")))
    return t.events.select("event_id", *[c.alias(n) for n, c in D.parts(at).items()])


@query("dtm2_minute_of_day", "SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INT) AS minute FROM events")
def _(t):
    return t.events.select("event_id", D.minute_of_day(F.col("ts")).alias("minute"))


@query("dtm3_wrapped_day", "SELECT event_id, CAST(CASE WHEN day(ts) < 4 THEN day(ts) + 28 ELSE day(ts) END AS INT) AS day FROM events")
def _(t):
    return t.events.select("event_id", D.wrapped_day(F.col("ts")).alias("day"))


@query("dtm4_age_in_months", "SELECT l_orderkey, l_partkey, round(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) / 30, 6) AS months FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey", rounded(D.months_between_days(F.col("l_shipdate"), F.lit("1995-01-01").cast("date")), "months"))


@query("dtm5_cyclic", "SELECT event_id, " + ", ".join(
    f"round(sin(2 * pi() * ({e} + 1e-6) / {p}), 6) AS {n}_sin, round(cos(2 * pi() * ({e} + 1e-6) / {p}), 6) AS {n}_cos" for n, e, p in (("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7))) + " FROM events")
def _(t):
    hs, hc = D.cyclic(F.hour("ts"), 24)
    ds, dc = D.cyclic(F.weekday("ts"), 7)
    return t.events.select("event_id", rounded(hs, "hour_sin"), rounded(hc, "hour_cos"), rounded(ds, "dow_sin"), rounded(dc, "dow_cos"))


@query("dtm6_item_age", """
SELECT event_id, greatest((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 86400000000, 0) AS age FROM events""")
def _(t):
    from cartloom.operators.ordered import with_group

    e = with_group(t.events, ["user_id"], first=F.min("ts"))
    return e.select("event_id", D.age_days(F.col("ts"), F.col("first")).alias("age"))


@query("dtm7_days_before_end", "SELECT event_id, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) // 86400000000 + 1 AS day_index FROM events")
def _(t):
    return t.events.select("event_id", D.days_before_end(F.col("ts"), t.events.select(F.max("ts")).scalar()).alias("day_index"))


@query("dtm8_calendar_flags", """
SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS month, CAST(isodow(o_orderdate) >= 6 AS INT) AS weekend, CAST((month(o_orderdate) - 1) // 3 AS INT) AS season, CAST(date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') AS INT) AS stay FROM orders""")
def _(t):
    c = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.month(c).alias("month"), D.is_weekend(c).alias("weekend"), D.season(c).alias("season"), D.stay(c, F.lit("2002-01-01").cast("date")).alias("stay"))


@query("dtm9_rollup_keys", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, year(o_orderdate) || '-' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS week, strftime(o_orderdate, '%Y-%m') AS month FROM orders""")
def _(t):
    c = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.date_format(c, "yyyy-MM-dd").alias("day"), D.year_week(c).alias("week"), D.year_month(c).alias("month"))


# --- vectors ----------------------------------------------------------------

@query("mth1_softmax_lists", """
WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i, len(embedding) AS n FROM embeddings),
 e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM u)
SELECT vec_id, string_agg(CAST(CAST(round(p * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS probs FROM (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) * log2(n) AS p FROM e) GROUP BY vec_id""")
def _(t):
    v = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", scaled(V.softmax_by_length(F.col("v")), "probs"))


@query("mth2_unit_vectors", """
SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, round(embedding[64]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS last FROM embeddings""")
def _(t):
    unit = t.embeddings.select("vec_id", V.l2_normalise(F.col("embedding")).alias("u"))
    return unit.select("vec_id", rounded(F.col("u")[0], "first"), rounded(F.element_at("u", -1), "last"))


@query("mth3_cosine_to_label_mean", """
WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL),
 m AS (SELECT label, list(x ORDER BY i) AS centre FROM c GROUP BY label)
SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], centre), 6) AS distance FROM embeddings JOIN m USING (label)""")
def _(t):
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = ordered_list(means, ["label"], "i", ["x"])
    joined = t.embeddings.join(centres, "label")
    return joined.select("vec_id", rounded(V.cosine_distance(F.col("embedding"), F.col("x_list")), "distance"))
