"""Spelling variants against brute force."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cartloom.llm import variants
from tests.llm.conftest import EDGES, LOWER, SCHEMA


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=variants.RATIO):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    out, form = {}, {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], counts.get(form[w]), root)
    return out


def grouped(session, counts, ratio=variants.RATIO):
    words = session.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.rooted(variants.forms(words, ratio), ratio).collect()}


def test_near_words(session):
    draw = random.Random(5)
    syllables = ["th", "on", "he", "ing", "é", "ñ", "ss", "tion", "a"]
    counts = {}
    for _ in range(150):
        word = "".join(draw.choice(syllables) for _ in range(4)) + "abc"
        counts[word] = draw.randint(2, 3000)
        for _ in range(draw.randint(0, 3)):
            i, letter = draw.randrange(len(word)), draw.choice("aeéñx")
            other = draw.choice([word[:i] + word[i + 1 :], word[:i] + letter + word[i:], word[:i] + letter + word[i + 1 :]])
            if len(other) >= 7:
                counts.setdefault(other, draw.choice([2, 3, 20, 400]))
    counts |= {"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200, "aaaaaaaaaa": 2000, "aaaaaaaaaaa": 20_000, "x" * 3000: 9, "x" * 3001: 90}
    got = grouped(session, counts)
    assert got == brute(counts)
    assert got["aaaaaaa"][4] == "aaaaaaaaaaa" and any(v[1] > 3 for v in got.values())


def test_ties_go_to_the_first_word(session):
    counts = {"abcdefg": 2, "bbcdefg": 50, "abcdefh": 50, "abcdefgé": 50, "abcdefx": 19}
    assert grouped(session, counts)["abcdefg"][:4] == (2, 4, "abcdefgé", 50)
    assert grouped(session, counts) == brute(counts)
    assert grouped(session, {"abcdefg": 2, "abcdefx": 19})["abcdefg"][2:] == (None, None, "abcdefg")


def test_documents(session):
    rows = [(i, "Straßenbahn wörtlich, Wortlich! beautiful beautifull xBEAUTIFULx don't 12345678 shortest", "en", "a", 1) for i in range(60)]
    rows += [(None, "beautiful Beautifu", None, None, None), (7, None, None, None, None), (8, "", None, None, None), (9, "a" * 50_000 + " " + "beautiful " * 5000, "en", "b", 1)]
    import re

    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= 7:
                counts[word] += 1
    want = brute({w: n for w, n in counts.items() if n >= 2})
    docs = session.createDataFrame(rows, SCHEMA).repartition(4)
    got = variants.spelling_groups(docs, change=variants.with_slips)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()} == want and len(want) > 4


def test_edges(session, edges, clashing, empty):
    want = sorted(map(tuple, variants.spelling_groups(edges).collect()))
    assert want and sorted(map(tuple, variants.spelling_groups(clashing.withColumns({"word": F.lit("w"), "n": F.lit("n"), "key": F.lit(1)})).collect())) == want
    assert variants.spelling_groups(empty).count() == 0 and len(EDGES) == edges.count()
    with pytest.raises(ValueError):
        variants.spelling_groups(edges, ratio=1)


def test_pairs_are_not_made_of_all_words_of_a_signature(session):
    """Words of the same letters in another order meet only where half of them is equal."""
    draw = random.Random(1)
    words = {"".join(draw.sample("abcdefghijkl", 12)) for _ in range(400)}
    table = session.createDataFrame([(w, 2) for w in words], "word string, n long")
    signed = variants.signed(table).filter(F.col("role") == variants.SAME)
    assert signed.groupBy("key").count().agg(F.max("count")).first()[0] <= 5
