"""Item vectors and nearest items against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartloom.operators import embedding, nearest


def brute_nearest(queries, items, size, k):
    unit = {}
    for key, v in items:
        if key is not None and v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and any(v):
            scaled = np.array(v) / np.abs(v).max()
            unit[key] = scaled / np.linalg.norm(scaled)
    out = []
    for key in sorted({q for q in queries if q in unit}):
        found = sorted((-round(float(unit[key] @ v), 9), other) for other, v in unit.items() if other != key)
        out += [(key, other, -s, rank) for rank, (s, other) in enumerate(found[:k], 1)]
    return out


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]
    rows += [(400 + i, [x * 1e200 for x in rows[7][1]]) for i in range(3)] + [(410, [x * 1e-200 for x in rows[8][1]])]
    rows += [(500, None), (501, [0.0] * 6), (502, [1.0] * 5), (503, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (504, [float("nan")] * 6), (505, [float("inf")] * 6), (None, [1.0] * 6)]
    return rows


def fields(frame):
    return sorted((r["query"], r.nearest, pytest.approx(r.similarity, abs=1e-8), r["rank"]) for r in frame.collect())


@pytest.mark.parametrize("k", [1, 4, 60])
def test_nearest(spark, vectors, k):
    items = spark.createDataFrame(vectors, "id long, v array<double>").repartition(3)
    got = nearest.nearest(items.filter("id % 7 = 0 OR id >= 400"), items, "id", "v", 6, k)
    want = brute_nearest([i for i, _ in vectors if i is not None and (i % 7 == 0 or i >= 400)], vectors, 6, k)
    assert sorted(((r["query"], r["rank"]), r.nearest) for r in got.collect()) == sorted(((q, rank), n) for q, n, _, rank in want)
    for r in got.collect():
        assert r.similarity == pytest.approx(next(s for q, n, s, _ in want if (q, n) == (r["query"], r.nearest)), abs=1e-8)


def test_nearest_in_many_blocks_and_rounds(spark, vectors, monkeypatch):
    items = spark.createDataFrame(vectors, "id long, v array<double>").repartition(4)
    whole = nearest.nearest(items, items, "id", "v", 6, 3).collect()
    monkeypatch.setattr(nearest, "ROUND_BYTES", 3000)
    monkeypatch.setattr(nearest.blocks, "__defaults__", (17,))
    split = nearest.nearest(items, items, "id", "v", 6, 3).collect()
    assert sorted(map(str, whole)) == sorted(map(str, split)) and len(whole) == 3 * 344


def test_nearest_edges(spark, vectors):
    items = spark.createDataFrame(vectors, "id long, v array<float>")
    assert nearest.nearest(items.limit(0), items, "id", "v", 6).count() == 0
    assert nearest.nearest(items, items.limit(0), "id", "v", 6).count() == 0
    one = items.filter("id = 3")
    assert nearest.nearest(one, one, "id", "v", 6).count() == 0
    assert [(r["query"], r.nearest, r.similarity) for r in nearest.nearest(one, one, "id", "v", 6, itself=True).collect()] == [(3, 3, 1.0)]
    doubled = nearest.nearest(one.unionByName(one), items.unionByName(items), "id", "v", 6, 5).collect()
    assert len({r.nearest for r in doubled}) == 5
    with pytest.raises(ValueError):
        nearest.nearest(one, one, "id", "v", 6, 0)


def sessions(n=400, seed=1):
    draw = random.Random(seed)
    return [(draw.choice([1, 1, 2, 3]), i, draw.choice([None, *range(12)])) for i in range(n)]


def brute_counts(rows, window):
    out = {}
    for key in {r[0] for r in rows}:
        items = [r[2] for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1])]
        for i, a in enumerate(items):
            for j, b in enumerate(items):
                if i != j and abs(i - j) <= window and a is not None and b is not None:
                    out[a, b] = out.get((a, b), 0) + 1
    return out


@pytest.mark.parametrize("hot_rows", [None, 30])
def test_cooccurrences(spark, hot_rows):
    rows = sessions()
    table = spark.createDataFrame(rows, "session long, at long, item long").repartition(3)
    got = embedding.cooccurrences(table, ["session"], ["at"], "item", 3, hot_rows)
    counts = {(r.a, r.b): r.n for r in got.collect()}
    assert counts == brute_counts(rows, 3)
    assert all(counts[b, a] == n for (a, b), n in counts.items())


def test_association(spark):
    counts = brute_counts(sessions(), 2)
    table = spark.createDataFrame([(a, b, n) for (a, b), n in counts.items()], "a long, b long, n long")
    total = sum(counts.values())
    each = {}
    for (a, _), n in counts.items():
        each[a] = each.get(a, 0) + n
    for shift in (1.0, 1.3):
        want = {(a, b): np.log(n * total / (each[a] * each[b] * shift)) for (a, b), n in counts.items()}
        got = {(r.a, r.b): r.weight for r in embedding.association(table, shift).collect()}
        assert got == pytest.approx({p: w for p, w in want.items() if w > 0})
    assert embedding.association(table.limit(0)).count() == 0


def test_item_vectors(spark):
    draw = np.random.default_rng(2)
    basis = np.linalg.qr(draw.normal(size=(30, 30)))[0]
    matrix = basis @ np.diag([9, -7, 5, 3, 2] + [0.1] * 25) @ basis.T
    table = spark.createDataFrame([(i, j, float(matrix[i, j])) for i in range(30) for j in range(30)], "a long, b long, weight double").repartition(3)
    vectors, values = embedding.item_vectors(table, size=4, rounds=30)
    assert values == pytest.approx([9, -7, 5, 3], abs=1e-6)
    got = np.array([r.vector for r in vectors.sort("item").collect()])
    # The products of the vectors, with their signs, are the table's best approximation.
    assert got @ np.diag(np.sign(values)) @ got.T == pytest.approx(basis[:, :4] @ np.diag([9, -7, 5, 3]) @ basis[:, :4].T, abs=1e-5)


def test_item_vectors_of_little(spark):
    schema = "a long, b long, weight double"
    empty, values = embedding.item_vectors(spark.createDataFrame([], schema), size=3, rounds=1)
    assert empty.count() == 0 and len(values) == 3
    two, values = embedding.item_vectors(spark.createDataFrame([(1, 2, 4.0), (2, 1, 4.0)], schema), size=3, rounds=4)
    rows = {r.item: r.vector for r in two.collect()}
    assert sorted(np.abs(values)) == pytest.approx([0, 4, 4], abs=1e-9) and all(len(v) == 3 and np.isfinite(v).all() for v in rows.values())


def test_groups_of_items_lie_together(spark):
    """Items that share sessions are nearest to each other."""
    draw = random.Random(3)
    rows = [(s, p, 10 * (s % 3) + draw.randrange(5)) for s in range(90) for p in range(8)]
    table = spark.createDataFrame(rows, "session long, at long, item long")
    vectors, _ = embedding.item_vectors(embedding.association(embedding.cooccurrences(table, ["session"], ["at"], "item")), size=4, rounds=6)
    found = nearest.nearest(vectors, vectors, "item", "vector", 4, 3).collect()
    assert len(found) == 45 and all(r["query"] // 10 == r.nearest // 10 for r in found)


def test_no_row_for_each_item_on_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    seen = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(out := collect(self)) or out)
    table = spark.createDataFrame([(i, (i + 1) % 500, 1.0) for i in range(500)] + [((i + 1) % 500, i, 1.0) for i in range(500)], "a long, b long, weight double")
    embedding.item_vectors(table, size=2, rounds=1)
    assert all(len(rows) <= 1 for rows in seen)
    assert spark.range(3).select(F.col("id")).collect()
