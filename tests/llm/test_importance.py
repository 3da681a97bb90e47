"""Importance resampling against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartloom.llm import crc, importance, words
from tests.llm.conftest import EDGES, letter_words


def runs(text):
    found = letter_words(text)
    return found + [f"{a} {b}" for a, b in zip(found, found[1:])]


def buckets(texts):
    return Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in runs(t))


def brute(rows, target, percent=25, least=20):
    """{(doc_id, n_features, weight, score, rank)} of (doc_id, text) rows, as a sorted list."""
    source, goal = buckets([t for _, t in rows]), buckets(target)
    s_all, t_all = sum(source.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log(float(goal[b] + 1) * float(s_all + 10_000) / (float(source[b] + 1) * float(t_all + 10_000)))) for b in range(10_000)]
    out = []
    for doc_id, text in rows:
        features = [zlib.crc32(f.encode()) % 10_000 for f in runs(text)]
        weight = sum(gain[b] for b in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(letter_words(text))))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[4]))
    drawn = {i: k for k, i in enumerate(map(id, able[: percent * len(able) // 100]), 1)}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=str)


def collected(frame):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in frame.collect()), key=str)


@given(st.lists(st.text(alphabet="aZ9é漢_ -", max_size=60), max_size=5))
@settings(max_examples=60, deadline=None)
def test_crcs(texts):
    found = words.find_words(pa.array(texts, pa.string()), words.LETTERS_DIGITS)
    crcs, lengths = crc.word_crcs(found), found.ends - found.starts
    assert crcs.tolist() == [zlib.crc32(found.text(i).encode()) for i in range(len(lengths))]
    if len(crcs) > 1:
        both = crc.followed(crcs[:-1], crcs[1:], lengths[1:])
        assert both.tolist() == [zlib.crc32((found.text(i) + found.text(i + 1)).encode()) for i in range(len(crcs) - 1)]


def test_planes_sum_exactly():
    draw = np.random.default_rng(3)
    counts = draw.integers(0, 5, (30, importance.BUCKETS)) * (draw.random((30, importance.BUCKETS)) < 0.02)
    counts[0, :7], counts[1] = [1, 2, 3, 1 << 20, 70_000, 0, 9], 0
    values = draw.integers(-14_000, 14_000, importance.BUCKETS)
    assert importance.Gains(values.tolist()).sums(counts).tolist() == (counts @ values).tolist()
    assert importance.Gains([0] * importance.BUCKETS).sums(counts).tolist() == [0] * 30


def test_edges(session, edges, benchmark):
    target = [r.text for r in benchmark.collect()]
    got = importance.resample(edges, benchmark)
    assert got.columns == [*edges.columns, "n_words", "n_features", "weight", "score", "rank"]
    assert collected(got) == brute([r[:2] for r in EDGES], target) and got.filter("rank IS NOT NULL").count() == 1


def test_large_share(session, documents, benchmark):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = importance.resample(documents.repartition(5), benchmark, percent=60, min_words=5, keep=["doc_id"])
    assert collected(got) == brute(rows, [r.text for r in benchmark.collect()], 60, 5)


def test_clashing_names(session, edges, clashing, benchmark):
    odd = clashing.withColumns({"weight": F.lit("taken"), "rank": F.lit("taken"), "_text": F.lit("kept"), "_id": F.lit("kept"), "_ow_part": F.lit(1)})
    got = importance.resample(odd, benchmark)
    assert collected(got) == collected(importance.resample(edges, benchmark))
    assert {(r["_text"], r["_id"]) for r in got.collect()} == {("kept", "kept")} and got.columns.count("weight") == 1


def test_empty_tables(session, edges, empty, benchmark):
    assert importance.resample(empty, benchmark).count() == 0
    assert collected(importance.resample(edges, empty)) == brute([r[:2] for r in EDGES], [])


def test_drawn_look_like_the_target(session, documents, benchmark):
    drawn = importance.resample(documents, benchmark)
    means = {bool(r.drawn): r.w for r in drawn.filter("n_words >= 20").groupBy(F.col("rank").isNotNull().alias("drawn")).agg(F.avg("weight").alias("w")).collect()}
    assert means[True] > means[False]
    assert pytest.approx(0.25, abs=0.02) == drawn.filter("rank IS NOT NULL").count() / drawn.filter("n_words >= 20").count()
