"""Exact copies against a persistent index of digests.

The index is a table bucketed and sorted by digest. A batch of documents is
reduced to one row per digest, a sort-merge join with the index (whose side needs
no shuffle) tells the digests that it has, and those that it has not are
appended. Columns and SQL functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.llm.registry import llm_query, read, written
from cartloom.runtime import scratch_folder

LEAST_BUCKETS, BUCKET_TEXTS = 64, 4_000_000
BLANKS = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    """SHA-256 of the text without blanks, lower-case hex; null as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, ""), 256)


class DigestIndex:
    """Digests seen so far, with the id of the document that stays for each and the batch that brought it.

    ``name`` is the catalog table, ``path`` its files. The same path can be
    opened again in a later session, also where the catalog forgot the table;
    its number of buckets is fixed when it is made. ``texts`` is the number of
    distinct texts that it is to hold in the end: a bucket, which one task reads
    and merges, is made for BUCKET_TEXTS of them.
    """

    COLUMNS = "digest STRING, keep_id BIGINT, keep_points BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, buckets: int | None = None, texts: int = 0):
        self.spark, self.path = spark, path
        self.buckets = buckets or max(LEAST_BUCKETS, -(-texts // BUCKET_TEXTS))
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
        """Append the batch's new texts and return one decision per document.

        Of equal texts in a batch the one with the most code points stays, then
        the smallest id, then (repeated rows) any one row; a text that an
        earlier batch brought keeps that batch's document, and every copy in
        this batch is dropped. Null text counts as empty, a null id comes after
        all others and can be kept. ``group_size`` counts this batch's copies.

        A batch that may have to be run again has a name. Adding it again under
        that name appends what the index does not have of it, if a failure left
        something out, and decides as the first time: what the index has from
        this very batch is the batch's own. Without a name a batch added again is
        a new one, of which nothing is kept. Returns doc_id, keep_id, group_size,
        kept, text_sha256; an empty batch gives no rows.
        """
        rows = written(docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("points"),
            digest(F.col(text)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ))
        batch = batch or uuid.uuid4().hex
        order = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
        best = rows.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
        held = self.table().select("digest", F.col("keep_id").alias("held_id"), F.col("batch").alias("held_by"))
        found = best.hint("merge").join(held, "digest", "left")
        # Written before the append, which changes the table it is read from.
        mine = F.col("held_by").isNull() | (F.col("held_by") == batch)
        decided = written(found.select(
            "digest", "group_size", mine.alias("mine"), F.col("held_by").isNull().alias("new"), F.col("best.row").alias("best_row"),
            F.when(mine, F.col("best.doc_id")).otherwise(F.col("held_id")).alias("keep_id"), (-F.col("best.less")).alias("keep_points")))
        (decided.filter("new").select("digest", "keep_id", "keep_points", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
         .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name))
        return rows.join(decided, "digest").select(
            "doc_id", "keep_id", "group_size", (F.col("mine") & (F.col("best_row") == F.col("row"))).alias("kept"),
            F.col("digest").alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


@llm_query("op4_exact_dedup", SQL)
def op4_exact_dedup(spark, folder):
    """All documents as the first batch of a new index."""
    return DigestIndex(spark, scratch_folder(spark)).add(read(spark, folder, "documents"), batch="documents")
