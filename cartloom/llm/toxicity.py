"""Toxicity by class-conditional Kneser-Ney models with shared backoff.

Two interpolated models, of toxic and of ordinary texts, run from word pairs to
continuation counts (before how many distinct words a word was seen) to the
continuation counts of both classes together:

    s(w)        = share of w among the contexts of both classes, discounted by 1/2, rest spread evenly
    q_c(w)      = own_c(w) / all_c + l_c s(w)
    p_c(w | v)  = own_c(vw) / c_c(v) + g_c(v) q_c(w)

``own`` is the class's count times 1 - D / N, with N the count in both classes,
and nothing where N <= D: what is rare in both classes together is left to the
shared counts in both alike, so it speaks for neither. l and g are what is left
over, so that the shares sum to one.

A text is judged by the difference of the two log-likelihoods divided by length:
over the whole text, and the largest over its passages of 1, 4 and 16 words, so
that a few expressions are not lost in a long text; by pairs and by words alone.
A logistic regression over these turns them into a probability. It is fitted on
texts that the counts it sees do not hold, and picks the discount D.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.registry import fresh, llm_query, read, written
from cartloom.llm.words import LETTERS_DIGITS, find_words, mix, pair_hashes, slices

SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32 << 20
"""Bound of the sample a model is fitted on: distinct texts of each class, and their bytes. It bounds the model."""
DISCOUNTS = (1.0, 2.0, 4.0, 8.0)
PASSAGES = (1, 4, 16)
FEATURES = 2 * (len(PASSAGES) + 1)
HELD_BACK = 4
"""Every so many-th text of the sample, by hash, is for the regression."""
LEAST_PENALTY = 1e-3
"""Of the regression; with few texts it is one by their number."""
THRESHOLD = 0.7
CELLS = 4096
SEED = 20240607
BEGIN = mix(np.array([0x626567], dtype=np.uint64))[0]
_COUNTS = ["a0", "a1", "b0", "b1"]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, of the word before each, and the number of words of each text."""
    found = find_words(texts, LETTERS_DIGITS)
    w, n = found.hashes(), np.diff(found.first)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[found.first[:-1][n > 0]] = BEGIN
    return v, w, n


def _unit(h: Column) -> Column:
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def sample(docs: DataFrame, labels: DataFrame, learns: Column, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES,
           doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[int]]:
    """(toxic, h, text): distinct labelled texts in hash order up to the bounds of their class, and how many texts each class has.

    Ids of both labels are not learned from. A class has at least the texts of
    one cell of hashes, however large.
    """
    marks = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(
        F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("_most")).filter("toxic = _most").drop("_most")
    texts = docs.filter(learns & (F.octet_length(F.col(text)) > 0)).select(
        F.col(doc_id).alias("_id"), F.xxhash64(F.lit(SEED), F.col(text)).alias("h"), F.col(text).alias("text"))
    # Texts stay where they are until it is known which ones are drawn.
    known = written(texts.select("_id", "h", F.octet_length("text").alias("bytes")).join(marks, "_id").groupBy("toxic", "h").agg(F.first("bytes").alias("bytes")))
    sizes = {r.toxic: (r.n, r.bytes) for r in known.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    # Twice the bound is looked at in cells of equal width; whole cells are drawn.
    share = {c: min(1.0, 2 * rows / n, 2 * size / total) for c, (n, total) in sizes.items()}
    width = F.when(F.col("toxic") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    cells = known.withColumn("cell", F.floor(_unit(F.col("h")) / width * CELLS)).filter(F.col("cell") < CELLS)
    upto = dict.fromkeys(share, 0)
    held = {c: [0, 0] for c in share}
    full: set[int] = set()
    for r in cells.groupBy("toxic", "cell").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy("cell").collect():
        n, total = held[r.toxic]
        if r.toxic in full or n and (n + r.n > rows or total + r.bytes > size):
            full.add(r.toxic)
            continue
        held[r.toxic] = [n + r.n, total + r.bytes]
        upto[r.toxic] = r.cell + 1
    limit = F.when(F.col("toxic") == 1, upto.get(1, 0)).otherwise(upto.get(0, 0))
    drawn = cells.filter(F.col("cell") < limit).select("toxic", "h")
    found = texts.select("h", "text").join(F.broadcast(drawn), "h").groupBy("toxic", "h").agg(F.first("text").alias("text"))
    return written(found), [sizes.get(c, (0, 0))[0] for c in (0, 1)]


def count_grams(texts: DataFrame) -> DataFrame:
    """(v, w, a0, a1, b0, b1): word pairs of ordinary and toxic texts, b those of the texts held back for the regression."""

    def count(batches):
        for batch in batches:
            for low, high in slices(batch.column(2)):
                part = batch.slice(low, high - low)
                v, w, n = _words(part.column(2))
                kind = part.column(0).to_numpy().astype(np.int64) + 2 * (part.column(1).to_numpy() % HELD_BACK == 0)
                order = np.lexsort((w, v))
                v, w, kind = v[order], w[order], np.repeat(kind, n)[order]
                first = np.ones(len(w), dtype=bool)
                first[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
                begins = np.flatnonzero(first)
                counts = [pa.array(np.add.reduceat((kind == k).astype(np.int64), begins) if len(begins) else np.zeros(0, dtype=np.int64)) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(v[first].view(np.int64)), pa.array(w[first].view(np.int64)), *counts], names=["v", "w", *_COUNTS])

    rows = texts.select("toxic", "h", "text").mapInArrow(count, "v long, w long, " + ", ".join(f"{c} long" for c in _COUNTS))
    return written(rows.groupBy("v", "w").agg(*(F.sum(c).alias(c) for c in _COUNTS)))


def _own(counts: np.ndarray, discount: float) -> np.ndarray:
    """Counts of two classes, less each one's part of what is taken from both together."""
    both = counts.sum(axis=0)
    return counts * (np.maximum(both - discount, 0) / np.maximum(both, 1))


class Counts:
    """What a model needs of the sample: pairs, words and words before of more than one occurrence, and totals.

    What occurs once is left to the shared counts by every discount of 1 or
    more, so the totals tell all about it.
    """

    def __init__(self, grams: DataFrame, ordinary: Column, toxic: Column):
        rows = grams.select("v", "w", ordinary.alias("c0"), toxic.alias("c1")).filter("c0 + c1 > 0")
        words = written(rows.groupBy("w").agg(F.count_if(F.col("c0") > 0).alias("q0"), F.count_if(F.col("c1") > 0).alias("q1"), F.count("*").alias("contexts")))
        total = words.agg(F.sum("q0"), F.sum("q1"), F.sum("contexts"), F.count("*")).first()
        self.q_all, self.contexts, self.distinct = np.array([float(total[0] or 0), float(total[1] or 0)]), float(total[2] or 0), total[3]
        self.w, self.q, self.w_contexts = self._table(words.filter("q0 + q1 > 1"), "w", ["q0", "q1"], ["contexts"])
        befores = rows.groupBy("v").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).filter("c0 + c1 > 1")
        self.v, self.v_all, _ = self._table(befores, "v", ["c0", "c1"], [])
        got = rows.filter("c0 + c1 > 1").toArrow()
        self.pair = [got.column(c).to_numpy().view(np.uint64) for c in ("v", "w")]
        self.n = np.array([got.column(c).to_numpy() for c in ("c0", "c1")], dtype=np.float64)

    @staticmethod
    def _table(rows: DataFrame, key: str, pair: list[str], more: list[str]):
        got = rows.toArrow()
        keys = got.column(key).to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return (keys[order], np.array([got.column(c).to_numpy()[order] for c in pair], dtype=np.float64),
                [got.column(c).to_numpy()[order].astype(np.float64) for c in more])


class Ratios(NamedTuple):
    """Log of toxic by ordinary: of known pairs, of known words, of what a known word leaves over; and of unknown words."""

    pairs: np.ndarray
    pair: np.ndarray
    words: np.ndarray
    word: np.ndarray
    befores: np.ndarray
    left: np.ndarray
    unknown: float


def ratios(counts: Counts, discount: float) -> Ratios:
    """The two models' ratios under one discount of 1 or more."""
    share = lambda n: (np.maximum(n - 0.5, 0) + 0.5 * counts.distinct / (counts.distinct + 1)) / counts.contexts
    own = _own(counts.q, discount)
    l = 1 - own.sum(axis=1) / counts.q_all
    q = own / counts.q_all[:, None] + l[:, None] * share(counts.w_contexts[0])
    keep = own.sum(axis=0) > 0

    def looked_up(keys, table, values, missing):
        at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
        return np.where(table[at] == keys, values[:, at], missing) if len(table) else np.broadcast_to(missing, (2, len(keys)))

    v, w = counts.pair
    own_pair = _own(counts.n, discount)
    some = own_pair.sum(axis=0) > 0
    v, w, own_pair = v[some], w[some], own_pair[:, some]
    at = np.searchsorted(counts.v, v)
    spent = np.array([np.bincount(at, weights=o, minlength=len(counts.v)) for o in own_pair])
    g = 1 - spent / np.maximum(counts.v_all, 1)
    # A word of one context in all has only its share of the shared counts.
    q_w = looked_up(w, counts.w, q, l[:, None] * share(np.ones(1)))
    p = own_pair / np.maximum(counts.v_all[:, at], 1) + g[:, at] * q_w
    keys = pair_hashes(v, w)
    order = np.argsort(keys)
    log = lambda x: (np.log(x[1]) - np.log(x[0])).astype(np.float32)
    told = spent.sum(axis=0) > 0
    # Of a word before whose every pair is its own nothing is left over; a trace keeps the logarithm finite.
    g = np.maximum(g, 1e-9)
    return Ratios(keys[order], log(np.maximum(p, 1e-300))[order], counts.w[keep], log(q[:, keep]), counts.v[told], log(g[:, told]), float(np.log(l[1]) - np.log(l[0])))


def _found(keys: np.ndarray, table: np.ndarray, values: np.ndarray, missing: float) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], missing).astype(np.float64)


def _passages(gain: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Mean of each text's gains, and the largest mean of its passages of each length; 0 for a text without words.

    The last passage may be shorter and counts as one of full length.
    """
    some = n > 0
    begins = (np.cumsum(n) - n)[some]
    mean = np.zeros(len(n))
    mean[some] = np.add.reduceat(gain, begins) / n[some] if some.any() else 0
    out = [mean]
    place = np.arange(len(gain)) - np.repeat(begins, n[some])
    for length in PASSAGES:
        top = np.zeros(len(n))
        if some.any():
            starts = np.flatnonzero(place % length == 0)
            sums = np.add.reduceat(gain, starts) / length
            top[some] = np.maximum.reduceat(sums, np.searchsorted(starts, begins))
        out.append(top)
    return out


def features(texts: pa.Array, model: Ratios) -> np.ndarray:
    """FEATURES length-normalised differences of the two log-likelihoods of each whole text."""
    out = np.zeros((len(texts), FEATURES))
    for low, high in slices(texts):
        v, w, n = _words(texts.slice(low, high - low))
        # Every distinct pair is looked up once.
        _, first, where = np.unique(pair_hashes(v, w), return_index=True, return_inverse=True)
        v, w = v[first], w[first]
        word = _found(w, model.words, model.word, model.unknown)
        left = _found(v, model.befores, model.left, 0.0)
        keys = pair_hashes(v, w)
        at = np.minimum(np.searchsorted(model.pairs, keys), max(len(model.pairs) - 1, 0))
        known = model.pairs[at] == keys if len(model.pairs) else np.zeros(len(keys), dtype=bool)
        pair = np.where(known, model.pair[at] if len(model.pairs) else 0.0, left + word)
        out[low:high] = np.stack([*_passages(pair[where], n), *_passages(word[where], n)], axis=1)
    return out


class Model(NamedTuple):
    """Ratios of the chosen discount, and the regression; without both classes a fixed score."""

    ratios: Ratios | None
    weights: np.ndarray
    bias: float
    discount: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.ratios is None:
            return np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-(features(texts, self.ratios) @ self.weights + self.bias)))


def fit(docs: DataFrame, labels: DataFrame, learns: Column, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES,
        doc_id: str = "doc_id", text: str = "text") -> Model:
    """The model of a bounded sample of the labelled documents of which ``learns`` holds."""
    spark = docs.sparkSession
    texts, known = sample(docs, labels, learns, rows, size, doc_id, text)
    drawn = {(r.toxic, r.back): r.n for r in texts.groupBy("toxic", (F.pmod("h", F.lit(HELD_BACK)) == 0).alias("back")).agg(F.count("*").alias("n")).collect()}
    if not known[0] or not known[1]:
        return Model(None, np.zeros(FEATURES), float(known[1] > 0), 0.0)
    grams = count_grams(texts)
    whole = Counts(grams, F.col("a0") + F.col("b0"), F.col("a1") + F.col("b1"))
    # A class with no text on one of the sides is judged under the counts of all.
    split = all(drawn.get((c, back), 0) for c in (0, 1) for back in (False, True))
    seen = Counts(grams, F.col("a0"), F.col("a1")) if split else whole
    judged = texts.filter(F.pmod("h", F.lit(HELD_BACK)) == 0) if split else texts
    tried = spark.sparkContext.broadcast([ratios(seen, d) for d in DISCOUNTS])

    def measure(batches):
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.slice(low, high - low)
                found = np.concatenate([features(part.column(1), r) for r in tried.value], axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(found), pa.list_(pa.float64()))], names=["toxic", "found"])

    # Classes weigh as they do among all labelled texts, whatever was drawn of each.
    judged_of = {c: drawn.get((c, True), 0) + (0 if split else drawn.get((c, False), 0)) for c in (0, 1)}
    weight = [known[c] / judged_of[c] * sum(judged_of.values()) / sum(known) for c in (0, 1)]
    measured = written(judged.select("toxic", "text").mapInArrow(measure, "toxic int, found array<double>"))
    table = measured.withColumn("weight", F.when(F.col("toxic") == 1, weight[1]).otherwise(weight[0]))
    penalty = max(LEAST_PENALTY, 1 / sum(judged_of.values()))
    best = None
    for k, discount in enumerate(DISCOUNTS):
        one = table.select("toxic", "weight", array_to_vector(F.slice("found", k * FEATURES + 1, FEATURES)).alias("x")).coalesce(4).cache()
        fitted = LogisticRegression(featuresCol="x", labelCol="toxic", weightCol="weight", regParam=penalty, maxIter=60).fit(one)
        loss = fitted.summary.objectiveHistory[-1]
        one.unpersist()
        if best is None or loss < best[0]:
            best = loss, discount, np.array(fitted.coefficients.toArray()), float(fitted.intercept)
    tried.unpersist()
    return Model(ratios(whole, best[1]), best[2], best[3], best[1])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows of docs with its columns, or those of ``keep``, and score, replacing a column of this name.

    Only the text is looked at; null and empty texts have the score of a text
    without words, and equal texts equal scores.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    body = fresh(names, "text")
    source = docs.select(*names, F.col(text).alias(body))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(shared.value.scores(batch.column(body)))], names=[*names, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names), "score double"])
    return source.mapInArrow(judge, schema)


def held_out(doc_id: Column) -> Column:
    """The third of the documents that is not learned from; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


@llm_query("op11_toxicity")
def op11_toxicity(spark, folder):
    """Every document's toxicity, learned from two thirds of the labels."""
    docs = read(spark, folder, "documents")
    model = fit(docs, read(spark, folder, "labels"), ~held_out(F.col("doc_id")))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
