"""Two hops in cells of a task's memory: hubs, turns, odd numbers, and what is left behind, against brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartloom.operators import hops, joins
from cartloom.runtime import scratch_paths


def graph(n, seed):
    """Links at random, a node that links to all and one that all link to; far and negative numbers."""
    draw = random.Random(seed)
    name = lambda x: (x - 40) * (10**16 + 1)
    out = {(name(draw.randrange(n)), name(draw.randrange(n))) for _ in range(4 * n)}
    return sorted(out | {(name(0), name(x)) for x in range(n)} | {(name(x), name(1)) for x in range(n)})


def two_steps(first, second):
    into = {}
    for c, b in second:
        into.setdefault(c, set()).add(b)
    return {(a, b) for a, c in first for b in into.get(c, ())}


@pytest.mark.parametrize("edges, least", [(1 << 22, 1 << 16), (90, 60)])
def test_hubs_are_dealt_over_cells_and_turns(spark, monkeypatch, edges, least):
    monkeypatch.setattr(hops, "LEAST", least)
    monkeypatch.setattr(hops, "HELD", 100)
    monkeypatch.setattr(hops, "PROBES", 64)
    first, second = graph(100, 1), [e for e in graph(100, 2) if random.Random(str(e)).random() < 0.5]
    nodes = sorted({x for e in first + second for x in e})
    draw = random.Random(3)
    asked = sorted({(draw.choice(nodes), draw.choice(nodes), draw.randrange(2)) for _ in range(3000)} | {(nodes[0], x, 0) for x in nodes})
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    for one, two in ((first, second), (second, first)):
        linked = hops.linked(frame(one, "start long, node long"), frame(two, "node long, end long"),
                             frame(asked, "start long, end long, way byte"), edges)
        want = two_steps(one, two)
        assert sorted(map(tuple, linked.collect())) == [x for x in asked if x[:2] in want]


def test_buckets_of_hubs_have_places_of_their_own():
    counts = np.zeros((2, hops.BUCKETS), np.int64)
    counts[0, [3, 5, 9, 10]], counts[1, [3, 9]] = [4, 5, 25, 2], [1, 12]
    place, shares, n = hops.places(counts, 8, 10)
    # 3 alone, as 5 does not fit beside it; 9 in 3 x 2 places; 10 after them.
    assert place[[3, 5, 9, 10]].tolist() == [0, 1, 2, 8] and n == 9
    assert shares[:, 9].tolist() == [3, 2] and shares[:, [3, 5, 10]].max() == 1
    assert hops.places(counts * 0, 8, 10)[2] == 0


def test_numbers_travel_whole():
    pack, unpack = hops._packing()
    for v in ([5], [7, 7, 7], [-3, 2**40, 0], [-(2**63), 2**63 - 1, 0, -1]):
        v = np.array(v, np.int64)
        assert unpack(pack(v), len(v)).tolist() == v.tolist()
    assert len(pack(np.arange(10**6, 10**6 + 200))) == 9 + 200


@pytest.mark.parametrize("kind", ["int", "string"])
def test_flags_of_rows_that_are_their_own_links(spark, monkeypatch, kind):
    monkeypatch.setattr(joins, "FEW_KEYS", 0)
    draw = random.Random(5)
    name = {"int": lambda x: x - 20, "string": lambda x: f"n{x}"}[kind]
    pairs = [(name(draw.randrange(60)), name(draw.randrange(60))) for _ in range(250)]
    pairs += pairs[:40] + [(None, pairs[0][0]), (pairs[0][0], None), (None, None), (name(61), name(61))]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], f"id long, a {kind}, b {kind}")
    edges = {p for p in pairs if None not in p}
    over = two_steps(edges, edges)
    got = joins.follow_flags(rows, rows)
    assert got.columns == ["a", "b", "id", "follows_back", "two_hop", "two_hop_back"] and dict(got.dtypes)["a"] == kind
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [
        (a, b, i, int((b, a) in edges), int((a, b) in over), int((b, a) in over)) for i, (a, b) in enumerate(pairs)]


def left_on_disk(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.path.getsize(f"{d}/{f}") for top in folders for d, _, names in os.walk(top) for f in names if f.endswith(".data"))


def test_only_the_flags_stay_on_disk(spark):
    rows = spark.range(40_000).select(F.pmod(F.xxhash64("id"), F.lit(900)).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(900)).alias("b"))
    had, paths = left_on_disk(spark), scratch_paths()
    flags = joins.follow_flags(rows, rows)
    kept = scratch_paths()[len(paths):]
    # The flags, of 39,000 pairs, and no lists or links; the opened lists of the pairs, some 40 nodes each, were never moved.
    assert len(kept) == 1 and left_on_disk(spark) - had < 100_000
    assert flags.filter("two_hop = 1").count() > 0
