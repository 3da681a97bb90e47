"""Documents drawn by importance towards a target text collection.

Runs of one and two words are hashed into 10,000 buckets. A bucket's gain tells
how much more often it occurs in the target than in the documents; a document's
weight is the mean gain of its features, and documents with the highest weight
plus hashed Gumbel noise are drawn, which is sampling without replacement in
proportion to exp(weight / 1000).

Weights come from bit-sliced aggregation. Plane i of a document holds bit i of
its 10,000 bucket counts, one bit a bucket; the gains, told apart by sign, are
sliced into planes in the same way. The sum of counts times gains is exactly the
sum, over pairs of planes, of a power of two times the number of bits that both
have.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cartloom.llm.crc import crc_sql, followed, word_crcs
from cartloom.llm.registry import fresh, llm_query, read, written
from cartloom.llm.words import LETTERS_DIGITS, find_words, slices
from cartloom.operators.ordered import Number, ordered_windows

BUCKETS = 10_000
SEED = 7
PERCENT, MIN_WORDS = 25, 20
GROUP = 128
"""Documents whose counts are dense at a time."""
_SPACE = np.uint32(0xE96CCF45)
"""CRC-32 of one blank."""


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, and for every feature its text and its bucket."""
    words = find_words(texts, LETTERS_DIGITS)
    crcs, lengths = word_crcs(words), words.ends - words.starts
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(texts)), counts)
    second = np.flatnonzero(text[1:] == text[:-1]) + 1
    after = followed(np.full(len(second), _SPACE), crcs[second], lengths[second])
    pairs = followed(crcs[second - 1], after, lengths[second] + 1)
    bucket = np.concatenate([crcs, pairs]).astype(np.int64) % BUCKETS
    return counts, np.concatenate([text, text[second]]), bucket


def bucket_counts(texts: DataFrame, text: str = "text") -> list[int]:
    """How many features of all texts fall into each bucket."""

    def count(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for low, high in slices(batch.column(0)):
                total += np.bincount(_features(batch.column(0).slice(low, high - low))[2], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = [0] * BUCKETS
    for r in texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Of each bucket, thousand times the smoothed log ratio of its target share to its source share, rounded down."""
    s_all, t_all = sum(source), sum(target)
    return [math.floor(1000 * math.log(float(t + 1) * float(s_all + BUCKETS) / (float(s + 1) * float(t_all + BUCKETS))))
            for s, t in zip(source, target)]


def _planes(numbers: np.ndarray) -> list[np.ndarray]:
    """Bit i of rows of non-negative numbers as rows of 64-bit words, for every i that the largest needs."""
    out = []
    for i in range(int(numbers.max(initial=0)).bit_length()):
        packed = np.packbits((numbers >> i).astype(np.uint8) & np.uint8(1), axis=1)
        out.append(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64))
    return out


class Gains:
    """Gains as signed bit planes."""

    def __init__(self, values: list[int]):
        row = np.array([values], dtype=np.int64)
        self.signed = [(1, _planes(np.maximum(row, 0))), (-1, _planes(np.maximum(-row, 0)))]

    def sums(self, counts: np.ndarray) -> np.ndarray:
        """Exact sum of counts times gains of each row of counts."""
        out = np.zeros(len(counts), dtype=np.int64)
        for i, plane in enumerate(_planes(counts)):
            # A high bit is set in few documents.
            some = np.flatnonzero(plane.any(axis=1))
            held = plane[some]
            for sign, planes in self.signed:
                for j, gain in enumerate(planes):
                    out[some] += sign * (np.bitwise_count(held & gain).sum(axis=1, dtype=np.int64) << (i + j))
        return out


def _weights(texts: pa.Array, planes: Gains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, features and weight of each text."""
    n_words, n_features, weight = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
    for low, high in slices(texts):
        counts, of, bucket = _features(texts.slice(low, high - low))
        n_words[low:high] = counts
        n_features[low:high] = np.bincount(of, minlength=high - low)
        order = np.argsort(of, kind="stable")
        of, bucket = of[order], bucket[order]
        for first in range(0, high - low, GROUP):
            rows = min(GROUP, high - low - first)
            a, b = np.searchsorted(of, [first, first + rows])
            dense = np.bincount((of[a:b] - first) * BUCKETS + bucket[a:b], minlength=rows * BUCKETS).reshape(rows, BUCKETS)
            total, n = planes.sums(dense), n_features[low + first : low + first + rows]
            weight[low + first : low + first + rows] = np.where(n > 0, total // np.maximum(n, 1), 0)
    return n_words, n_features, weight


def weigh(docs: DataFrame, values: list[int], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows of docs with its columns, or those of ``keep``, and n_words, n_features, weight, replacing columns of these names.

    A null or empty text, or one without a word, has no feature and weight 0.
    """
    added = ["n_words", "n_features", "weight"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    body = fresh(names, "text")
    source = docs.select(*names, F.col(text).alias(body))
    planes = Gains(values)

    def score(batches):
        for batch in batches:
            found = _weights(batch.column(body), planes)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, found)], names=[*names, *added])

    schema = StructType([*source.select(*names).schema, *(StructField(c, LongType()) for c in added)])
    return source.mapInArrow(score, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousand times a standard Gumbel number hashed from seed and id, rounded down; a null id counts as empty text."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows of docs with n_words, n_features, weight, score and rank, replacing columns of these names.

    ``percent`` of the documents with at least ``min_words`` words are drawn:
    those of the highest scores, ties to the smaller id (null last), ranked from
    1 over the whole table; rank is null for the others. Rows repeated in id and
    text are documents of their own with equal scores. With an empty target all
    gains come from the documents alone; an empty table gives no rows. ``keep``
    names the columns to return besides, all unless given.
    """
    values = gains(bucket_counts(docs, text), bucket_counts(target, text))
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_features", "weight", "score", "rank")]
    # The caller's columns travel as one, apart from the helpers of the numbering.
    packed = docs.select(F.struct(*names).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    weighed = weigh(packed, values, "text", ["row", "id"])
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    able = F.col("n_words") >= min_words
    drawn = scored.filter(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("n_words")]
    # Places over all rows are found in range parts, never in one task.
    placed = ordered_windows(scored.filter(able), [], order, {"rank": Number()}, hot_rows=1)
    ranked = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("row.*", "n_words", "n_features", "weight", "score", "rank")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
doc_runs AS (SELECT r, unnest({_RUNS}) AS f FROM doc),
goal_runs AS (SELECT unnest({_RUNS}) AS f FROM (SELECT {_WORDS} AS w FROM benchmark)),
hashed AS (SELECT f, {crc_sql("f")} % {BUCKETS} AS b FROM (SELECT f FROM doc_runs UNION SELECT f FROM goal_runs)),
source AS (SELECT b, count(*) AS s FROM doc_runs JOIN hashed USING (f) GROUP BY b),
target AS (SELECT b, count(*) AS t FROM goal_runs JOIN hashed USING (f) GROUP BY b),
gains AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM source) + {BUCKETS})::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM source FULL JOIN target USING (b)),
sums AS (SELECT r, count(*) AS n, sum(gain) AS total FROM doc_runs JOIN hashed USING (f) JOIN gains USING (b) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CAST(coalesce(floor(total::DOUBLE / n), 0) AS BIGINT) AS weight,
         ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM doc LEFT JOIN sums USING (r)),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, n_features, n_words) AS place, count(*) OVER () * {PERCENT} // 100 AS drawn
  FROM noisy WHERE n_words >= {MIN_WORDS})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank
FROM noisy LEFT JOIN placed USING (r)
"""


@llm_query("op13_importance_resampling", SQL)
def op13_importance_resampling(spark, folder):
    """A quarter of the documents drawn towards the benchmark's words."""
    drawn = resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"), keep=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
