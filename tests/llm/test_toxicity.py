"""Toxicity: probabilities against brute force, held-out quality, edges."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartloom.llm import toxicity
from tests.llm.conftest import letter_words

PLAIN = "the quick brown fox jumps over a lazy dog while seven wise owls watch from an old oak tree near the river".split()
RUDE = ["nitwit", "blockhead", "numskull"]


def corpus(n=400, seed=3):
    draw = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [draw.choice(PLAIN) + draw.choice(["", "s", "ing", str(draw.randint(0, 400))]) for _ in range(draw.randint(5, 400))]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            words.insert(draw.randrange(len(words) + 1), draw.choice(RUDE))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def learned(session):
    docs, labels = corpus()
    table, marks = session.createDataFrame(docs, "doc_id long, text string"), session.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, labels, table, marks, toxicity.fit(table, marks, ~toxicity.held_out(F.col("doc_id")))


def brute_ratio(texts, discount):
    """Log ratio of toxic to ordinary of a pair (v, w) and of a word, by the formulas."""
    pairs = [Counter(), Counter()]
    for toxic, text in texts:
        words = letter_words(text)
        pairs[toxic].update(zip([None, *words], words))
    contexts, q, before = Counter(), [Counter(), Counter()], [Counter(), Counter()]
    for v, w in set(pairs[0]) | set(pairs[1]):
        contexts[w] += 1
    for c in (0, 1):
        for (v, w), n in pairs[c].items():
            q[c][w] += 1
            before[c][v] += n
    total, distinct = sum(contexts.values()), len(contexts)

    def own(tables, key, c):
        both = tables[0][key] + tables[1][key]
        return tables[c][key] * max(both - discount, 0) / both if both else 0

    left = [1 - sum(own(q, w, c) for w in q[c]) / sum(q[c].values()) for c in (0, 1)]
    spent = [defaultdict(float), defaultdict(float)]
    for c in (0, 1):
        for v, w in pairs[c]:
            spent[c][v] += own(pairs, (v, w), c)

    def shared(w):
        return (max(contexts[w] - 0.5, 0) + 0.5 * distinct / (distinct + 1)) / total

    def word(w, c):
        return own(q, w, c) / sum(q[c].values()) + left[c] * shared(w)

    def pair(v, w, c):
        n = before[c][v]
        return own(pairs, (v, w), c) / n + (1 - spent[c][v] / n) * word(w, c) if n else word(w, c)

    return (lambda w: math.log(word(w, 1) / word(w, 0))), (lambda v, w: math.log(pair(v, w, 1) / pair(v, w, 0)))


@pytest.mark.parametrize("discount", [1.0, 2.0, 8.0])
def test_features(session, discount):
    docs, labels = corpus(40, 8)
    texts = [(y, t) for (_, t), (_, _, y) in zip(docs, labels)]
    grams = toxicity.count_grams(session.createDataFrame([(y, i, t) for i, (y, t) in enumerate(texts)], "toxic int, h long, text string").repartition(3))
    model = toxicity.ratios(toxicity.Counts(grams, F.col("a0") + F.col("b0"), F.col("a1") + F.col("b1")), discount)
    word, pair = brute_ratio(texts, discount)
    tried = ["", None, "nitwit", "Nitwit the unseen-word quick.", docs[0][1], docs[1][1] + " blockhead " * 40, "zzz " * 5]
    for got, text in zip(toxicity.features(pa.array(tried), model), tried):
        found = letter_words(text)
        by_pair, by_word = [pair(v, w) for v, w in zip([None, *found], found)], [word(w) for w in found]
        want = []
        for gains in (by_pair, by_word):
            want.append(sum(gains) / len(gains) if gains else 0)
            want += [max((sum(gains[i : i + k]) / k for i in range(0, len(gains), k)), default=0) for k in toxicity.PASSAGES]
        assert got == pytest.approx(want, abs=1e-4)


def test_shares_sum_to_one(session):
    """Both models spread the whole probability over known words and one unknown."""
    docs, labels = corpus(30, 2)
    texts = [(y, t) for (_, t), (_, _, y) in zip(docs, labels)]
    pairs = toxicity.count_grams(session.createDataFrame([(y, i, t) for i, (y, t) in enumerate(texts)], "toxic int, h long, text string"))
    counts = toxicity.Counts(pairs, F.col("a0") + F.col("b0"), F.col("a1") + F.col("b1"))
    own = toxicity._own(counts.q, 2.0)
    left = 1 - own.sum(axis=1) / counts.q_all
    assert ((0 < left) & (left < 1)).all() and counts.contexts == pairs.count() and counts.distinct == pairs.select("w").distinct().count()


def test_toxic_held_out(learned):
    docs, labels, table, marks, model = learned
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    held = {r.doc_id for r in table.filter(toxicity.held_out(F.col("doc_id"))).collect()}
    bad = [i for i, _, y in labels if y and i in held]
    good = [i for i, _, y in labels if not y and i in held]
    assert sum(got[i] >= 0.7 for i in bad) >= 0.9 * len(bad) and sum(got[i] >= 0.7 for i in good) <= 0.03 * len(good)


def test_long_text_hides_nothing(session, learned):
    docs, labels, table, marks, model = learned
    plain = " ".join(PLAIN * 500)
    texts = [plain, plain + " you nitwit blockhead " + plain, "nitwit", "", None]
    rows = [r.score for r in toxicity.score(session.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).sort("doc_id").collect()]
    assert rows[0] < 0.7 <= rows[1] and rows[2] >= 0.7 and rows[3] == rows[4] < 0.7 and all(0 <= r <= 1 for r in rows)


def test_sample(session, learned):
    docs, labels, table, marks, _ = learned
    everything = F.lit(True)
    whole, known = toxicity.sample(table, marks, everything)
    assert known == [300, 100] and whole.count() == 400
    few, known = toxicity.sample(table, marks, everything, rows=30)
    sizes = {r.toxic: r["count"] for r in few.groupBy("toxic").count().collect()}
    assert known == [300, 100] and all(20 < n <= 30 for n in sizes.values())
    # Copies are one text, ids of both labels are left out, and what is not learned from is not drawn.
    copies = table.unionByName(session.createDataFrame([(1000 + i, docs[0][1]) for i in range(500)], table.schema))
    more = marks.unionByName(session.createDataFrame([(1000 + i, 1, 1) for i in range(500)] + [(1, 0, 1)], marks.schema))
    assert toxicity.sample(copies, more, everything)[1] == [299, 100]
    assert toxicity.sample(table, marks, F.lit(False))[1] == [0, 0]
    small, _ = toxicity.sample(table, marks, everything, size=20_000)
    assert all(r.n <= 20_000 for r in small.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("n")).collect())


def test_edges(session, learned, edges, clashing, empty):
    model = learned[4]
    got = toxicity.score(edges, model)
    assert got.columns == [*edges.columns, "score"] and got.count() == edges.count()
    again = toxicity.score(clashing.withColumn("_text", F.lit("kept")), model)
    assert sorted(str((r.doc_id, r.score)) for r in again.collect()) == sorted(str((r.doc_id, r.score)) for r in got.collect())
    assert {r["_text"] for r in again.collect()} == {"kept"} and toxicity.score(empty, model).count() == 0
    by = defaultdict(set)
    for r in got.collect():
        by[r.text].add(r.score)
    assert all(len(v) == 1 for v in by.values())


def test_one_class_or_none(session, edges, empty):
    marks = "doc_id long, quality int, toxic int"
    for rows, want in (([], 0.0), ([(1, 1, 0), (2, None, None), (None, 1, 1)], 0.0), ([(1, 1, 1)], 1.0)):
        model = toxicity.fit(edges, session.createDataFrame(rows, marks), F.lit(True))
        assert {r.score for r in toxicity.score(edges, model).collect()} == {want}
    two = toxicity.fit(edges, session.createDataFrame([(1, 1, 1), (12, 1, 0)], marks), F.lit(True))
    assert all(0 <= r.score <= 1 for r in toxicity.score(edges, two).collect()) and np.isfinite(two.bias)
