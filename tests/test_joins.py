"""Map reduction by bit maps, and two-hop links over bit maps, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cartloom.operators import joins


@pytest.mark.parametrize("bits", [1 << 28, 1 << 16, 1 << 15])
def test_shrunk_by_a_bit_map(spark, bits):
    table = spark.range(30_000).select((F.col("id") % 5000).alias("k"), F.col("id").cast("string").alias("s"), "id")
    table = table.unionByName(spark.createDataFrame([(None, "1", 1), (1, None, 2)], "k long, s string, id long"))
    wanted = spark.range(0, 9000, 7).select((F.col("id") % 5000).alias("k"), F.col("id").cast("string").alias("s"), F.lit(1).alias("other"))
    wanted = wanted.unionByName(spark.createDataFrame([(None, "1", 1), (1, None, 1)], "k long, s string, other int"))
    plain = sorted(map(tuple, joins.shrink_to(table, wanted, ["k", "s"]).collect()))
    marked = joins.shrink_to(table, wanted, ["k", "s"], few=0, most_bits=bits)
    assert sorted(map(tuple, marked.collect())) == plain and len(plain) == 1286 and marked.columns == table.columns


def test_only_marked_rows_reach_the_shuffle(spark):
    table, wanted = spark.range(50_000).withColumnRenamed("id", "k"), spark.range(0, 50_000, 100).withColumnRenamed("id", "k")
    bits = 1 << 15
    passed = joins.maybe_among(table, joins.key_bits(wanted, ["k"], bits), ["k"], bits)
    assert 500 <= passed.count() <= 500 + 50_000 * 500 / bits * 1.5
    assert passed.join(wanted, "k", "left_semi").count() == 500
    assert joins.shrink_to(table, wanted.limit(0), ["k"]).count() == 0 and joins.shrink_to(table, wanted.limit(0), ["k"], few=-1).count() == 0


def links(kind, n=700, nodes=150, seed=4):
    draw = random.Random(seed)
    name = {"long": lambda x: x - 70, "string": lambda x: f"n{x}"}[kind]
    out = {(name(draw.randrange(nodes)), name(draw.randrange(nodes))) for _ in range(n)}
    return out | {(name(0), name(x)) for x in range(nodes)} | {(name(x), name(1)) for x in range(nodes)}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_two_hops(spark, kind):
    edges = links(kind)
    draw = random.Random(1)
    nodes = sorted({x for e in edges for x in e})
    pairs = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(500)] + [(nodes[0], nodes[1])] * 3
    after, before = {}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        before.setdefault(b, set()).add(a)
    two = lambda a, b: bool(after.get(a, set()) & before.get(b, set()))
    schema = f"a {kind}, b {kind}"
    table, asked = spark.createDataFrame(sorted(edges), schema), spark.createDataFrame(pairs, schema)
    assert {tuple(r) for r in joins.two_hop(asked, table).collect()} == {p for p in pairs if two(*p)}
    assert sorted(map(tuple, joins.two_hop(table, table).collect())) == sorted(e for e in edges if two(*e))
    got = joins.follow_flags(asked, table).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, int((b, a) in edges), int(two(a, b)), int(two(b, a))) for a, b in pairs)


def test_a_node_is_opened_as_one_list_of_the_nodes_between(spark):
    starts = [(1, 100 + 64 * x) for x in range(50)] + [(1, 9), (7, 1)]
    edges = spark.createDataFrame(starts + [(100 + 64 * x, 5) for x in range(0, 50, 2)], "_s long, _d long")
    first, second = joins._legs(edges)
    near = {r.node: sorted(r.near) for r in joins._neighbours(first, "_s", "_d").collect()}
    assert near == {1: [100 + 64 * x for x in range(0, 50, 2)], 7: [1]}
    back = {r.node: sorted(r.near) for r in joins._neighbours(second, "_d", "_s").collect()}
    assert back == {5: [100 + 64 * x for x in range(0, 50, 2)], 9: [1]} | {100 + 64 * x: [1] for x in range(50)}
