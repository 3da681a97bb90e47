"""Round trips through every source and sink format."""

from pyspark.sql import functions as F

from cartloom.functions import scalars as S
from cartloom.functions import text as X
from cartloom.functions import timeparts as D
from cartloom.operators import splits as P
from cartloom.plans.registry import big, query, rounded, text
from cartloom.runtime import scratch_folder
from cartloom.sources import readers, writers


def _engagements(t):
    """Lines of orders dressed as the 24-column engagement log."""
    at = D.seconds(F.col("l_shipdate"))
    hexed = lambda c: F.upper(F.md5(F.col(c).cast("string")))
    media = F.when(F.col("l_linenumber") == 1, "Photo").when(F.col("l_linenumber") == 2, "Photo\tGIF").when(F.col("l_linenumber") == 3, "GIF\tGIF\tGIF")
    kinds = F.when(F.col("l_returnflag") == "R", "Retweet").when(F.col("l_returnflag") == "A", "Quote").otherwise("TopLevel")
    null = F.lit(None).cast("string")
    return t.lineitem.select(
        F.concat_ws("\t", "l_orderkey", "l_linenumber", "l_partkey").alias("text_tokens"), null.alias("hashtags"), hexed("l_partkey").alias("tweet_id"),
        media.alias("media"), null.alias("links"), null.alias("domains"), kinds.alias("tweet_type"), F.lit(S.LANGUAGE_HASHES[3]).alias("language"),
        at.alias("timestamp"), hexed("l_suppkey").alias("a_user_id"), F.col("l_suppkey").alias("a_follower_count"), F.col("l_partkey").alias("a_following_count"),
        (F.col("l_linestatus") == "F").alias("a_is_verified"), at.alias("a_account_creation"), hexed("l_orderkey").alias("b_user_id"), F.col("l_orderkey").alias("b_follower_count"),
        F.col("l_partkey").alias("b_following_count"), F.lit(False).alias("b_is_verified"), at.alias("b_account_creation"), F.lit(True).alias("b_follows_a"),
        F.when(F.col("l_returnflag") == "R", at).alias("reply"), F.lit(None).cast("bigint").alias("retweet"), F.lit(None).cast("bigint").alias("retweet_comment"),
        F.when(F.col("l_linestatus") == "F", at).alias("like"))


@query("src1_engagement_log", """
SELECT upper(md5(CAST(l_partkey AS VARCHAR))) AS tweet_id, l_suppkey AS author, 3 AS tokens, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 9 WHEN 3 THEN 13 ELSE 0 END AS media,
 CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS kind, 3 AS language, CAST(l_linestatus = 'F' AS INT) AS verified, CAST(l_returnflag = 'R' AS INT) AS reply, 0 AS retweet, epoch_us(l_shipdate) // 1000000 AS at FROM lineitem""")
def _(t):
    folder = scratch_folder(t.spark) + "/log"
    writer = _engagements(t).write.options(sep=readers.FIELD_SEPARATOR, quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.csv(folder)
    log = readers.read_engagements(t.spark, folder)
    return log.select("tweet_id", F.col("a_follower_count").alias("author"), X.token_count(F.col("text_tokens")).alias("tokens"),
                      S.code_of(F.substring("media", 1, 9), S.MEDIA_CODES).alias("media"), S.code_of(F.col("tweet_type"), S.TWEET_TYPE_CODES).alias("kind"),
                      S.code_of(F.col("language"), S.LANGUAGE_CODES).alias("language"), F.col("a_is_verified").cast("int").alias("verified"),
                      S.flag(F.col("reply")).alias("reply"), S.flag(F.col("retweet")).alias("retweet"), F.col("timestamp").alias("at"))


@query("src2_csv_with_header", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _(t):
    folder = scratch_folder(t.spark) + "/part"
    t.part.write.csv(folder, header=True)
    schema = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    return readers.read_table_csv(t.spark, folder, schema, ["p_partkey", "p_name", "p_retailprice"])


@query("src3_pruned_parquet", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 45")
def _(t):
    frame = readers.read_parquet(t.spark, f"{t.folder}/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_quantity"])
    return frame.filter("l_quantity > 45").drop("l_quantity")


@query("src4_nested_queries", """
SELECT user_id % 6 * 2 AS nb_after_add, event_id, event_type, value FROM events""")
def _(t):
    folder = scratch_folder(t.spark) + "/queries"
    day = F.date_format("ts", "yyyy-MM-dd")
    # At most 1,000 ids a query, however busy a user is.
    packed = t.events.groupBy("user_id", day, F.floor(F.col("event_id") / 1000)).agg(F.collect_list(F.struct("event_id", "event_type", "value")).alias("query"))
    packed.select("query", (F.col("user_id") % 6 * 2).alias("nb_after_add")).write.json(folder)
    rows = readers.read_test_queries(t.spark, folder, "event_id: bigint, event_type: string, value: double", {"nb_after_add": "bigint"}, lines=True)
    return rows.drop("place")


@query("src5_printed_lists", """
SELECT event_id, event_type || ',' || CAST(user_id AS VARCHAR) AS words, round(value * 2, 6) AS total FROM events""")
def _(t):
    words = F.concat(F.lit("['"), "event_type", F.lit("', '"), F.col("user_id").cast("string"), F.lit("']"))
    numbers = F.concat(F.lit("["), F.col("value").cast("string"), F.lit(", "), F.col("value").cast("string"), F.lit("]"))
    parsed = readers.parse_list(numbers, "double")
    return t.events.select("event_id", text(readers.parse_list(words), "words"), rounded(parsed[0] + parsed[1], "total"))


_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"


@query("snk1_parquet", _ORDERS)
def _(t):
    folder = scratch_folder(t.spark) + "/orders"
    writers.write_parquet(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), folder)
    return readers.read_parquet(t.spark, folder)


@query("snk2_forty_parts", _ORDERS)
def _(t):
    folder = scratch_folder(t.spark) + "/parts"
    writers.write_parts(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), folder, ["o_orderkey"])
    return readers.read_parquet(t.spark, folder).drop("part")


@query("snk3_split_folders", """
SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS split, CAST(o_custkey % 5 AS INT) AS fold FROM orders""")
def _(t):
    folder = scratch_folder(t.spark) + "/splits"
    split = F.when(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"), "train").otherwise("test")
    writers.write_splits(t.orders.select("o_orderkey", split.alias("split"), P.modulo(F.col("o_custkey"), 5).alias("fold")), folder)
    return readers.read_parquet(t.spark, folder)


@query("snk4_bounded_files", "SELECT 1 AS bounded, count(*) AS n FROM lineitem")
def _(t):
    folder = scratch_folder(t.spark) + "/bounded"
    writers.write_parquet(t.lineitem, folder, rows_per_file=10000, block_bytes=1 << 20, rows_per_group=2000)
    sizes = readers.read_parquet(t.spark, folder).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg((F.max("n") <= 10000).cast("int").alias("bounded"), big(F.sum("n"), "n"))


@query("snk5_submissions", """
SELECT o_orderkey, o_custkey, o_orderkey % 100 / 100 AS score, 'reply' AS label FROM orders UNION ALL SELECT o_orderkey, o_custkey, 0.0, 'like' FROM orders""")
def _(t):
    folder = scratch_folder(t.spark) + "/submission"
    zero = writers.zero_submission(t.orders, ["o_orderkey", "o_custkey"], ["reply", "like"])
    scores = zero.withColumn("reply", F.col("o_orderkey") % 100 / 100)
    writers.write_submissions(scores, folder, ["o_orderkey", "o_custkey"], ["reply", "like"])
    read = lambda label: t.spark.read.schema("o_orderkey bigint, o_custkey bigint, score double").csv(f"{folder}/{label}").withColumn("label", F.lit(label))
    return read("reply").unionByName(read("like"))


@query("snk6_label_records", """
SELECT user_id, string_agg(event_type, ',' ORDER BY i) AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) WHERE i <= 20 GROUP BY user_id""")
def _(t):
    folder = scratch_folder(t.spark) + "/labels"
    writers.write_label_records(t.events, folder, ["user_id"], ["event_id"], "event_type")
    return t.spark.read.schema("user_id bigint, label array<string>").json(folder).select("user_id", text("label"))
