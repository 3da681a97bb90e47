"""Benchmark passages found in documents by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of a benchmark item, or the whole of a
shorter one; its shingles are its pairs of neighbouring words (the word itself
if it has only one). Containment is exact, so a document with the window has all
its shingles, and the window's prefix is one: the rarest in the corpus. Only
occurrences of prefix shingles are joined; where the window must start then
follows from the shingle's place, is held against the document's length, and
the words there are compared with the window's.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.llm.registry import fresh, llm_query, read, written
from cartloom.llm.words import LETTERS_DIGITS, find_words, pair_hashes

WINDOW = 13
SHARE = 20
"""Contaminated: at least one of so many words is hit."""
FILTER_BITS = 22
"""The filter of shingles is a bit map of 2^22 entries, 512 kB, whatever the size of the benchmark."""
FEW_WINDOWS = 200_000
"""So many windows at most are broadcast; more are joined by shuffle."""

EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _shingles(hashes: np.ndarray) -> np.ndarray:
    return pair_hashes(hashes[:-1], hashes[1:]) if len(hashes) > 1 else hashes


def benchmark_windows(items: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, window words, shingle hashes in order), one row per window.

    Null or wordless items have none; a null id counts as an item without one.
    """

    def cut(batches):
        for batch in batches:
            found = find_words(batch.column(1), LETTERS_DIGITS)
            hashes, ids = found.hashes(), batch.column(0)
            out: tuple[list, list, list] = ([], [], [])
            for row in range(batch.num_rows):
                low, high = int(found.first[row]), int(found.first[row + 1])
                words = [found.text(i) for i in range(low, high)]
                shingles = _shingles(hashes[low:high]).astype(np.int64)
                for at in range(max(1, high - low - size + 1) if high > low else 0):
                    out[0].append(ids[row].as_py())
                    out[1].append(words[at : at + size])
                    out[2].append(shingles[at : at + max(1, min(size, high - low) - 1)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.list_(pa.int64()))],
                names=["item_id", "words", "shingles"])

    rows = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "item_id string, words array<string>, shingles array<long>")


def _filter_of(shingles: DataFrame) -> np.ndarray:
    """A bit map of the hashes' low bits, as bytes; at most 2^FILTER_BITS places reach the driver."""
    places = shingles.select(F.col("shingle").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("place")).distinct()
    marked = np.zeros(1 << FILTER_BITS, dtype=bool)
    marked[places.toArrow().column(0).to_numpy()] = True
    return np.packbits(marked)


def _passes(bits: np.ndarray):
    marked = np.unpackbits(bits).astype(bool)
    low = np.uint64((1 << FILTER_BITS) - 1)
    return lambda hashes: marked[(hashes & low).astype(np.int64)]


def _document_shingles(found):
    """Pairs of neighbouring words of the same text by the first one's number, and single words."""
    hashes = found.hashes()
    within = np.ones(len(hashes), dtype=bool)
    last = found.first[1:] - 1
    within[last[last >= found.first[:-1]]] = False
    at = np.flatnonzero(within[:-1])
    return hashes, at, pair_hashes(hashes[at], hashes[at + 1])


def shingle_counts(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """How often each wanted shingle occurs in all documents."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted))

    def count(batches):
        passes = _passes(bits.value)
        for batch in batches:
            hashes, _, pairs = _document_shingles(find_words(batch.column(0), LETTERS_DIGITS))
            every = np.concatenate([hashes[passes(hashes)], pairs[passes(pairs)]])
            keys, counts = np.unique(every, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["shingle", "count"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "shingle long, count long").groupBy("shingle").agg(F.sum("count").alias("count"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct windows with their rarest shingle and its place in the window.

    A window with a shingle that no document has is left out: it occurs nowhere.
    """
    distinct = windows.select("words", "shingles").distinct().withColumn("window", F.monotonically_increasing_id())
    parts = written(distinct).select("window", "words", F.posexplode("shingles").alias("place", "shingle"))
    ranked = parts.join(counts, "shingle", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rarest = ranked.groupBy("window").agg(F.min(F.struct("count", "shingle", "place", "words")).alias("rare"))
    return rarest.filter("rare.count > 0").select("window", "rare.words", "rare.shingle", "rare.place")


def _candidates(docs: DataFrame, bits, size: int) -> DataFrame:
    """Every row with its number of words and the places that pass the filter,
    each with the words around it in which a window over it must lie."""
    schema = "digest string, n_words long, places array<struct<at: long, low: long, shingle: long, words: array<string>>>"
    place_type = pa.list_(pa.struct([("at", pa.int64()), ("low", pa.int64()), ("shingle", pa.int64()), ("words", pa.list_(pa.string()))]))

    def find(batches):
        passes = _passes(bits.value)
        for batch in batches:
            texts = batch.column("_text")
            found = find_words(texts, LETTERS_DIGITS)
            hashes, at, pairs = _document_shingles(found)
            hit, single = passes(pairs), np.flatnonzero(passes(hashes))
            spots = np.concatenate([at[hit], single])
            values = np.concatenate([pairs[hit], hashes[single]]).astype(np.int64)
            order = np.argsort(spots, kind="stable")
            spots, values = spots[order], values[order]
            rows = np.searchsorted(found.first, spots, side="right") - 1
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            digests, places = [None] * batch.num_rows, [None] * batch.num_rows
            for row in np.unique(rows):
                low, high = int(found.first[row]), int(found.first[row + 1])
                digests[row] = md5(texts[int(row)].as_py().encode()).hexdigest()
                listed = []
                for spot, value in zip(spots[cuts[row] : cuts[row + 1]].tolist(), values[cuts[row] : cuts[row + 1]].tolist()):
                    left, right = max(low, spot - size + 1), min(high, spot + size)
                    listed.append({"at": spot - low, "low": left - low, "shingle": value, "words": [found.text(i) for i in range(left, right)]})
                places[row] = listed
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_text"]
            names = [name for name in batch.schema.names if name != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(digests, pa.string()), pa.array(np.diff(found.first)), pa.array(places, place_type)],
                names=[*names, "digest", "n_words", "places"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "_text")
    return docs.mapInArrow(find, f"{kept}, {schema}")


def _measured(docs: DataFrame, items: DataFrame, size: int, share: int, doc_id: Column, text: str) -> DataFrame:
    """One row per document as of contamination(), with the md5 of each text that has a candidate."""
    spark = docs.sparkSession
    windows = written(benchmark_windows(items, size))
    wanted = windows.select(F.explode("shingles").alias("shingle")).distinct()
    chosen = written(prefixes(windows, shingle_counts(docs, wanted, text)))
    bits = spark.sparkContext.broadcast(_filter_of(chosen.select("shingle")))
    rows = written(_candidates(docs.select(doc_id.alias("doc_id"), F.col(text).alias("_text")), bits, size))

    few = chosen.count() <= FEW_WINDOWS
    by_shingle = chosen.select("window", F.col("words").alias("window_words"), "shingle", "place", F.size("words").alias("length"))
    place = rows.filter("digest IS NOT NULL").select("digest", "n_words", F.explode("places").alias("p")).select("digest", "n_words", "p.*")
    begin = F.col("at") - F.col("place")
    joined = place.join(F.broadcast(by_shingle) if few else by_shingle, "shingle").withColumn("begin", begin)
    bounded = joined.filter((F.col("begin") >= F.col("low")) & (F.col("begin") + F.col("length") <= F.col("n_words")))
    same = F.slice("words", (F.col("begin") - F.col("low") + 1).cast("int"), F.col("length")) == F.col("window_words")
    matches = written(bounded.filter(same).select("digest", "begin", "length", "window"))

    # Words hit: what each occurrence reaches beyond all that began before it.
    spans = matches.groupBy("digest", "begin").agg((F.col("begin") + F.max("length")).alias("end"))
    before = F.max("end").over(Window.partitionBy("digest").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0).cast("long"), F.col("end") - F.greatest("begin", F.coalesce(before, F.col("begin"))))
    hits = spans.withColumn("fresh", fresh).groupBy("digest").agg(F.sum("fresh").alias("n_hit"))
    occurring = matches.select("digest", "window").distinct()
    ids = chosen.select("window", "words").join(windows.select("words", "item_id"), "words").select("window", "item_id").distinct()
    named = occurring.join(ids, "window").groupBy("digest").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    per_text = hits.join(named, "digest").select(
        "digest", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))

    none = rows.filter("digest IS NULL").select("doc_id", "digest", "n_words", F.lit(0).cast("long").alias("n_hit"),
                                               F.lit(0).cast("long").alias("n_items"), F.lit(EMPTY_SHA).alias("items_sha256"))
    some = rows.filter("digest IS NOT NULL").select("doc_id", "n_words", "digest").join(per_text, "digest", "left").select(
        "doc_id", "digest", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.lit(EMPTY_SHA)).alias("items_sha256"))
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return none.unionByName(some).withColumn("contaminated", dirty)


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = SHARE,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of letters, digits and non-ASCII characters with A-Z
    lower-cased. A word within any occurrence of a window is hit. ``n_items``
    counts the ids with an occurring window; ``items_sha256`` is of those ids,
    sorted as strings and comma-joined. Null and empty texts have no words and
    no hits; rows repeated in text have equal results; an empty benchmark hits
    nothing; items that share a window are all named.
    """
    return _measured(docs, items, size, share, F.col(doc_id), text).drop("digest")


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = SHARE, text: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, all columns kept; null texts stay."""
    dirty = written(_measured(docs, items, size, share, F.lit(None).cast("long"), text).filter("contaminated").select("digest").distinct())
    marked = fresh(docs.columns, "digest")
    marks = dirty.select(F.col("digest").alias(marked))
    if marks.count() <= FEW_WINDOWS:
        marks = F.broadcast(marks)
    return docs.join(marks, F.md5(F.col(text)) == F.col(marked), "left_anti")


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS win
  FROM items, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win
  FROM words, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k)),
matches AS (SELECT doc_id, k, s.n, item_id FROM spots s JOIN windows v ON s.n = v.n AND s.win = v.win),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM matches) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM matches) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@llm_query("op2_decontamination", SQL)
def op2_decontamination(spark, folder):
    """All documents against all benchmark items."""
    return contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
