"""Spelling variants: words one edit apart, each led to a far more frequent one.

A word's letters are a multiset, read as a binary vector: a dimension for the
first, second, ... occurrence of every letter. An inserted or deleted letter
changes one dimension, a replaced one two. So near words of one length are within
Hamming distance two, and of neighbouring lengths within distance one. The
dimensions are dealt into parts of about equal use, and a word has an exact
signature for every choice of parts that leaves out as many as edits may touch:
near words agree in one at least. Signatures name the half of the word that the
edit leaves alone as well, which tells permutations of the same syllables apart.
Words of equal signature are joined, and the edit distance is verified in the
join.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.crc import crc_sql
from cartloom.llm.registry import llm_query, read, written
from cartloom.llm.words import mix

LETTERS = "A-Za-zÀ-ÿ"
LENGTH, COUNT, RATIO = 7, 2, 10
"""Least length and number of a word, and how much more frequent the form of a word is."""
PARTS_SAME, PARTS_NEXT = 4, 2
"""Parts of the dimensions where two may differ, and where one may."""
TOLD_APART = 3
"""Occurrences of a letter from this one on lie in one part."""
SAME, SHORTER, LONGER = 0, 1, 2
SIGNED = "key long, role int, word string, n long"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, letters: str = LETTERS, least: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, word): each longest run of letters that has the least length, A-Z lower-cased, as often as it occurs."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"[{letters}]{{{least},}}"), F.lit(0))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("word")).withColumn("word", F.translate("word", _UPPER, _LOWER))


def _dimensions(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every letter of all words its word, its code point, and which occurrence in the word it is, from 0."""
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), pc.utf8_length(words).to_numpy())
    order = np.lexsort((codes, word))
    word, codes = word[order], codes[order]
    first = np.ones(len(codes), dtype=bool)
    first[1:] = (word[1:] != word[:-1]) | (codes[1:] != codes[:-1])
    begins = np.flatnonzero(first)
    return word, codes, np.arange(len(codes)) - begins[np.cumsum(first) - 1]


def letter_use(words: DataFrame) -> dict[tuple[int, int], int]:
    """Number of words with each (code point, occurrence), the last occurrence told apart standing for all further ones."""

    def count(batches):
        for batch in batches:
            _, codes, nth = _dimensions(batch.column(0))
            keys, n = np.unique(codes << 8 | np.minimum(nth, TOLD_APART), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["dimension", "n"])

    used = words.select("word").mapInArrow(count, "dimension long, n long").groupBy("dimension").agg(F.sum("n").alias("n")).collect()
    return {(r.dimension >> 8, r.dimension & 255): r.n for r in used}


def deal(use: dict[tuple[int, int], int], parts: int) -> dict[tuple[int, int], int]:
    """A part for every dimension, the most used first, each to the part that is used least so far."""
    load, out = [0] * parts, {}
    for dimension, n in sorted(use.items(), key=lambda x: (-x[1], x[0])):
        out[dimension] = load.index(min(load))
        load[out[dimension]] += n
    return out


def _part_sums(words: pa.Array, dealt: dict[tuple[int, int], int], parts: int) -> np.ndarray:
    """A hash of each word's dimensions in each part."""
    word, codes, nth = _dimensions(words)
    names = np.array(sorted(c << 8 | k for c, k in dealt), dtype=np.int64)
    part_of = np.array([dealt[(int(x) >> 8, int(x) & 255)] for x in names], dtype=np.int64)
    out = np.zeros((parts, len(words)), dtype=np.uint64)
    if len(codes):
        part = part_of[np.searchsorted(names, codes << 8 | np.minimum(nth, TOLD_APART))]
        np.add.at(out, (part, word), mix((codes << 32 | nth).astype(np.uint64) + np.uint64(1)))
    return out


def _halves(words: list[str], shift: int) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of the part before the middle, and of the part from the middle on, of words taken as ``shift`` letters shorter."""
    first, last = np.empty(len(words), dtype=np.uint64), np.empty(len(words), dtype=np.uint64)
    for i, word in enumerate(words):
        length = len(word) - shift
        first[i] = zlib.crc32(word[: length // 2].encode())
        last[i] = zlib.crc32(word[len(word) - (length - length // 2) :].encode())
    return first, last


def _signatures(words: pa.Array, same: dict, near: dict):
    """(role, keys) of a batch of words for every choice of parts and each half that an edit may leave alone."""
    plain = words.to_pylist()
    lengths = pc.utf8_length(words).to_numpy().astype(np.uint64)
    for roles, dealt, parts, edits in (((SAME,), same, PARTS_SAME, 2), ((SHORTER, LONGER), near, PARTS_NEXT, 1)):
        sums = _part_sums(words, dealt, parts)
        for role in roles:
            shift = 1 if role == LONGER else 0
            halves = _halves(plain, shift)
            for number, kept in enumerate(combinations(range(parts), parts - edits)):
                vector = mix(sum(mix(sums[p] + np.uint64(p)) for p in kept) + lengths - np.uint64(shift) + np.uint64(edits << 16 | number << 20))
                for side, half in enumerate(halves):
                    yield role, mix(vector ^ half << np.uint64(1) ^ np.uint64(side))


def signed(words: DataFrame) -> DataFrame:
    """A row for each signature of each word (word, n): key, role, word, n."""
    use = letter_use(words)
    same, near = deal(use, PARTS_SAME), deal(use, PARTS_NEXT)

    def sign(batches):
        for batch in batches:
            word, n = batch.column(0), batch.column(1)
            for role, keys in _signatures(word, same, near):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(word), role, dtype=np.int32)), word, n],
                                                 names=["key", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(sign, SIGNED)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two words (word, n) one edit apart, once."""
    rows = signed(words).repartition("key")
    left = rows.withColumnsRenamed({"role": "a_role", "word": "a", "n": "a_n"})
    right = rows.withColumnsRenamed({"role": "b_role", "word": "b", "n": "b_n"})
    # One condition on both roles, so that neither side is filtered and one exchange serves both.
    roles = F.col("a_role") * 3 + F.col("b_role")
    meet = ((roles == SAME * 3 + SAME) & (F.col("a") < F.col("b"))) | (roles == SHORTER * 3 + LONGER)
    return left.join(right, "key").filter(meet & (F.levenshtein("a", "b", 1) == 1)).groupBy("a", "b").agg(
        F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n of every word (word, n)."""
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form")).alias("other")),
                             F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("form")).alias("other"))))
    best = near_pairs(words).select(both.alias("p")).select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    joined = words.join(best, "word", "left")
    leads = -F.col("best.less") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(leads, F.col("best.form")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n"))


def rooted(found: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``forms`` with root, the last word of the chain of forms.

    Every form is ``ratio`` times as frequent as its word, which bounds the
    chain; each round doubles the steps taken.
    """
    most = found.agg(F.max("n"), F.min("n")).first()
    steps = int(math.log(most[0] / most[1], ratio) + 1e-9) if most[0] else 0
    arcs = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        arcs = written(arcs)
        further = arcs.select(F.col("word").alias("root"), F.col("root").alias("further"))
        arcs = arcs.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return found.join(arcs, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame, letters: str = LETTERS, length: int = LENGTH, count: int = COUNT, ratio: int = RATIO,
                    change: Callable[[Column, Column], Column] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are the runs of letters of at least ``length`` code points that occur
    ``count`` times or more in all texts. Two are near if one edit of one code
    point turns one into the other; a word's form is its near word of largest n
    (ties: the first by code points) if that is at least ``ratio`` times its own
    n. ``change`` makes a word from (doc_id, run) before lengths are looked at; it
    must not add letters. Null and empty texts have no words; rows repeated
    count as often as they occur; an empty table gives no rows. Only the two
    columns named are read.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    found = runs(docs, letters, length, doc_id, text)
    if change is not None:
        found = found.withColumn("word", change(F.col("doc_id"), F.col("word"))).filter(F.char_length("word") >= length)
    words = written(found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count))
    return rooted(written(forms(words, ratio)), ratio)


def with_slips(doc_id: Column, word: Column) -> Column:
    """The word without one of its code points, in one of 31 pairs of document and word."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), word).cast("binary"))
    place = F.pmod(h, F.char_length(word).cast("long")).cast("int")
    return F.when(F.pmod(h, F.lit(31)) == 0, F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.char_length(word)))).otherwise(word)


_TYPED = crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")
SQL = f"""
WITH RECURSIVE found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= {LENGTH} GROUP BY ALL),
hashed AS (SELECT *, CAST({_TYPED} AS BIGINT) AS h FROM counted),
typed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(n) >= {COUNT}),
less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
led AS (
  SELECT word, n_near, top, min(other) AS form FROM best JOIN near USING (word) WHERE other_n = top GROUP BY ALL),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * n THEN form END AS form, CASE WHEN top >= {RATIO} * n THEN top END AS form_n
  FROM words LEFT JOIN led USING (word)),
chain AS (
  SELECT word, form, word AS root FROM formed
  UNION ALL SELECT c.word, f.form, f.word FROM chain c JOIN formed f ON c.form = f.word)
SELECT word, n, n_near, f.form, form_n, root FROM formed f JOIN (SELECT word, root FROM chain WHERE form IS NULL) USING (word)
"""


@llm_query("op12_spelling_variants", SQL)
def op12_spelling_variants(spark, folder):
    """Words of all documents, the more frequent spelling of each, and the last of its chain."""
    return spelling_groups(read(spark, folder, "documents"), change=with_slips).select("word", "form", "root", "n", "n_near", "form_n")
