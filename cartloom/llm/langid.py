"""Language of a text by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ``ORDER`` bytes long with frozen
counts. A byte is coded in its longest context that the language has seen: with
c / (n + q) if it followed there (n: all, q: distinct followers), else with the
escape probability q / (n + q) and on in the next shorter context; below the
empty context all 256 bytes are alike. Symbols of longer contexts are not
excluded from shorter ones. The language with the shortest code wins, and its
score is its posterior probability under equal priors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.llm.registry import llm_query, read, written
from cartloom.llm.words import LOWER, column_bytes, slices

ORDER = 4
SAMPLE_ROWS, SAMPLE_BYTES, ALL_BYTES = 1000, 2_000_000, 16_000_000
"""Bound of the sample a model is fitted on: distinct texts and bytes for each language, and bytes of all
languages, which share them evenly. Every language has one text at least. It bounds the model, whatever
the corpus, and so what is collected and broadcast."""
TOGETHER = 4
"""Languages whose counts stand side by side in one table; others have tables of their own."""
UNKNOWN = "und"
PIECE = 2 << 20
"""Bytes of text scored at a time; a longer text is a piece of its own."""


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every byte, A-Z lower-cased, the number made of its ORDER predecessors and itself; offsets of the texts.

    Blanks stand before a text's first byte.
    """
    data, offsets = column_bytes(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    at = np.arange(len(data)) + ORDER * (text + 1)
    padded = np.full(len(data) + ORDER * len(texts), 0x20, dtype=np.uint64)
    padded[at] = LOWER[data]
    grams = padded.copy()
    for back in range(1, ORDER + 1):
        grams[back:] |= padded[:-back] << np.uint64(8 * back)
    return grams[at], offsets


def _low(grams: np.ndarray, width: int) -> np.ndarray:
    return grams & np.uint64((1 << (8 * width)) - 1)


class Model:
    """For every few languages the sorted grams of each order with a column of counts per language."""

    def __init__(self, languages: list[str], grams: np.ndarray, language: np.ndarray, counts: np.ndarray):
        """grams of full width with their language's number and count, each once per language."""
        self.languages = languages
        self.groups = []
        for low in range(0, len(languages), TOGETHER):
            some = (language >= low) & (language < low + TOGETHER)
            self.groups.append(self._orders(grams[some], language[some] - low, counts[some], min(TOGETHER, len(languages) - low)))

    @staticmethod
    def _orders(grams: np.ndarray, language: np.ndarray, counts: np.ndarray, width: int) -> list[tuple]:
        out = []
        for k in range(ORDER + 1):
            keys, where = np.unique(_low(grams, k + 1), return_inverse=True)
            table = np.zeros((len(keys), width), dtype=np.uint32)
            np.add.at(table, (where, language), counts.astype(np.uint32))
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(contexts), width), dtype=np.uint32), np.zeros((len(contexts), width), dtype=np.uint32)
            np.add.at(total, of, table)
            np.add.at(distinct, of, (table > 0).astype(np.uint32))
            out.append((keys, table, contexts, total, distinct))
        return out

    def bits(self, grams: np.ndarray, group: int) -> np.ndarray:
        """Code length of each gram's last byte in each language of a group."""
        orders = self.groups[group]
        out = np.zeros((len(grams), orders[0][1].shape[1]))
        coded = np.zeros(out.shape, dtype=bool)
        for k in range(ORDER, -1, -1):
            keys, table, contexts, total, distinct = orders[k]
            if not len(keys):
                continue
            full = _low(grams, k + 1)
            at = np.minimum(np.searchsorted(contexts, full >> np.uint64(8)), len(contexts) - 1)
            known = (contexts[at] == full >> np.uint64(8))[:, None]
            n, q = np.where(known, total[at], 0).astype(np.float64), np.where(known, distinct[at], 0).astype(np.float64)
            at = np.minimum(np.searchsorted(keys, full), len(keys) - 1)
            c = np.where((keys[at] == full)[:, None], table[at], 0).astype(np.float64)
            here = ~coded & (n > 0)
            cost = np.log2(np.where(here, n + q, 1)) - np.log2(np.where(here, np.where(c > 0, c, q), 1))
            out += cost
            coded |= here & (c > 0)
        return out + np.where(coded, 0.0, 8.0)

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each whole text in each language."""
        grams, offsets = _grams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if len(grams):
            distinct, inverse = np.unique(grams, return_inverse=True)
            filled = offsets[1:] > offsets[:-1]
            for group in range(len(self.groups)):
                bits = self.bits(distinct, group)
                for k in range(bits.shape[1]):
                    out[filled, group * TOGETHER + k] = np.add.reduceat(bits[inverse, k], offsets[:-1][filled])
        return out


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, together: int = ALL_BYTES,
           text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, text) of the labelled rows to learn from, distinct whole texts in hash order up to the bounds.

    At least one text of each language is taken.
    """
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter(
        "lang IS NOT NULL AND octet_length(text) > 0").withColumn("_drawn", F.xxhash64(F.lit(20240607), "text"))
    counts = written(labelled.groupBy("lang").agg(F.approx_count_distinct("_drawn", 0.02).alias("n")))
    size = min(size, together // max(1, counts.count()))
    # Twice as many texts as wanted are expected to pass, or all where there are few; their copies go before they meet.
    unit = F.shiftrightunsigned("_drawn", 11).cast("double") * F.lit(2.0**-53)
    near = labelled.join(counts, "lang").filter(unit * F.col("n") < 2 * rows + 20)
    distinct = near.groupBy("lang", "_drawn").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("_drawn")
    ranked = distinct.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= rows)
    before = F.sum(F.octet_length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("_bytes", before).filter((F.col("_bytes") <= size) | (F.col("_rank") == 1)).select("lang", "text")


def fit(labelled: DataFrame) -> Model:
    """The model of a bounded sample (lang, text)."""

    def count(batches):
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.slice(low, high - low)
                names, langs = np.unique(np.array(part.column(0).to_pylist(), dtype=object), return_inverse=True)
                grams, offsets = _grams(part.column(1))
                of = np.repeat(langs, np.diff(offsets))
                for k, name in enumerate(names):
                    keys, counts = np.unique(grams[of == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    counted = labelled.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    number = {name: k for k, name in enumerate(names)}
    language = np.array([number[x] for x in got.column("lang").to_pylist()], dtype=np.int64)
    return Model(names, got.column("gram").to_numpy().astype(np.uint64), language, got.column("n").to_numpy())


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of docs with lang_pred and score, replacing columns of these names.

    ``und`` with score 0 for a null text, one without a letter, or a model that
    has learned nothing; ties go to the first language by name. Only the text
    is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    source = docs.drop("lang_pred", "score").withColumns({"_text": F.col(text), "_lettered": lettered})
    names = [c for c in source.columns if c not in ("_text", "_lettered")]

    def predict(batches):
        model = shared.value
        for batch in batches:
            texts, lettered = batch.column("_text"), batch.column("_lettered").to_numpy(zero_copy_only=False)
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            for low, high in slices(texts, PIECE):
                if model.languages:
                    bits = model.code_lengths(texts.slice(low, high - low))
                    best[low:high] = bits.argmin(axis=1)
                    score[low:high] = 1 / np.exp2(bits.min(axis=1)[:, None] - bits).sum(axis=1)
            best[~lettered], score[~lettered] = -1, 0
            found = [model.languages[k] if k >= 0 else UNKNOWN for k in best]
            score[best < 0] = 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.string()), pa.array(score)],
                                             names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names)
    return source.mapInArrow(predict, f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that is not learned from; a null id is among them."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def learned(docs: DataFrame) -> Model:
    return fit(sample(docs.filter(~held_out(F.col("doc_id")))))


@llm_query("op3_language_id")
def op3_language_id(spark, folder):
    """The language of every document, learned from four fifths of them."""
    docs = read(spark, folder, "documents")
    predicted = identify(docs.select("doc_id", "text"), learned(docs))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
