"""Near duplicates against brute force, and the pipeline on edge rows and against its stages by brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from cartloom.llm import mixing, near_dedup, sharding
from cartloom.llm.registry import written
from tests.llm.conftest import BASE, EDGES, FOLDER, SCHEMA, blank_words
from tests.llm.test_exact import hits, poisson_count


def shingles(text, size):
    w = blank_words(text)
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size, threshold=80):
    """(component id, kept) of each (doc_id, text)."""
    sets = [shingles(t, size) for _, t in rows]
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= threshold * len(a | sets[j]):
                x, y = root(i), root(j)
                part[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def compare(session, rows, size):
    docs = session.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA)
    got = near_dedup.near_duplicates(docs, size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute(rows, size))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def changed(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("size, block", [(2, 512), (5, 3)])
def test_groups_of_near_copies(session, monkeypatch, size, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(size)
    rows = []
    for g in range(6):
        words = [f"g{g}x{rng.randrange(400)}" for _ in range(100)]
        rows += [changed(rng, words, n) for n in (0, 0, 1, 2, 3, 5, 6, 8, 8, 12)]
    hub = [f"h{k}" for k in range(120)]
    rows += [changed(rng, hub, n % 9) for n in range(60)]
    rng.shuffle(rows)
    compare(session, list(enumerate(rows)), size)


@pytest.mark.parametrize("size, short", [(2, 256), (2, 40), (5, 8)])
def test_large_buckets(session, monkeypatch, size, short):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "SHORT", short)
    rng = random.Random(size + short)
    # Few distinct signatures a band: every set of a length shares some bucket.
    monkeypatch.setattr(near_dedup, "band_keys", lambda signature: np.arange(near_dedup.BANDS))
    stem = [f"s{k}" for k in range(60)]
    rows = [" ".join(stem[: rng.randrange(5, 60)] + [f"t{rng.randrange(9)}"]) for _ in range(60)]
    rows += [changed(rng, stem, n % 7) for n in range(30)] + [f"thank you name{rng.randrange(30)}" for _ in range(60)]
    rng.shuffle(rows)
    compare(session, list(enumerate(rows)), size)


def test_templates_are_not_compared_in_pairs(session):
    sets = session.range(3000).selectExpr("id AS node", "array(cast(7 AS BIGINT), 1000 + id) AS elements")
    rest = sets.selectExpr("cast(1 AS BIGINT) AS bucket", "node", "node AS part")
    got = near_dedup.groups(rest, sets, 80)
    assert got.count() == 3000 and got.groupBy("bucket").count().agg({"count": "max"}).first()[0] == 1


def test_edges(session):
    compare(session, [r[:2] for r in EDGES], 5)


def test_nothing(session, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    lone = session.createDataFrame([(1, None, "", "", 0), (2, "", "", "", 0)], SCHEMA)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(lone).collect()) == [(1, 1, True), (2, 2, True)]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    errors = []
    for shared in (360, 300, 200, 100):
        b = np.concatenate([a[:shared], rng.integers(0, 2**63, 400 - shared).astype(np.uint64)])
        same = (near_dedup.superminhash(np.unique(a)) == near_dedup.superminhash(np.unique(b))).mean()
        errors.append(same - shared / (800 - shared))
    assert max(map(abs, errors)) < 0.12
    small = near_dedup.superminhash(np.array([5], dtype=np.uint64))
    assert np.isfinite(small).all() and len({int(x) for x in small}) == len(small)


def test_blocks_do_not_change_a_signature():
    elements = np.unique(np.random.default_rng(1).integers(0, 2**63, 9000).astype(np.uint64))
    parts = [near_dedup.superminhash(p) for p in np.array_split(elements, 7)]
    whole = near_dedup.superminhash(elements)
    assert (whole == np.min(parts, axis=0)).all()


def test_components(session):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)]
    part = {}
    for x in {x for e in links for x in e}:
        part[x] = x
    for _ in range(100):
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    got = near_dedup.components(session.createDataFrame(links, "a long, b long").repartition(5)).collect()
    alone = {x for a, b in links if a == b for x in (a, b)} - {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.root for r in got} == {x: r for x, r in part.items() if x not in alone} and len(got) == len(part) - len(alone)


def test_one_document_of_each_group_stays(session, edges):
    got = near_dedup.deduplicated(edges)
    assert got.columns == edges.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    fate = {(d, t): c for (d, t), (_, _, c) in zip([r[:2] for r in EDGES], brute([r[:2] for r in EDGES], 5))}
    assert kept == Counter(k for k, c in fate.items() if k[0] == c)


def test_clashing_columns_stay(session, clashing):
    got = near_dedup.deduplicated(clashing)
    assert got.columns == clashing.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in near_dedup.deduplicated(clashing.select("doc_id", "text")).collect())


@pytest.mark.parametrize("table", ["edges", "empty", "documents"])
def test_pipeline_stages(session, request, table):
    docs = request.getfixturevalue(table)
    rows, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(session, docs, "/root/testdata/sf0.001"))
        assert docs.columns == columns, name
        if name == "near duplicates":
            texts = [shingles(r.text, 5) for r in docs.collect()]
            assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(texts) for b in texts[:i])
    last = corpus_pipeline.STAGES[-1][1](session, docs, "/root/testdata/sf0.001")
    assert last.count() == docs.count() and (rows == 0) == (last.count() == 0)
    assert {"shard", "slot"} <= set(last.columns)


def test_whole_pipeline(session, documents, benchmark):
    rows = [r for r in documents.collect() if r.text and any(c.isalpha() for c in r.text)]
    parts = brute([(r.doc_id, r.text) for r in rows], 5)
    rows = [r for r, (_, _, part) in zip(rows, parts) if r.doc_id == part]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    rows = [r for r in rows if not hits(r.text, items)[4]]
    assert 0 < len(rows) < documents.count()
    size = Counter()
    for r in rows:
        size[r.source] += len(r.text.encode())
    total, weight = sum(size.values()), sum(b**mixing.TEMPERATURE for b in size.values())
    want = Counter()
    for r in rows:
        drawn = hashlib.md5(f"{mixing.SEED}:{r.doc_id}:{r.text}".encode()).hexdigest()
        rate = total * size[r.source] ** mixing.TEMPERATURE / weight / size[r.source]
        want[tuple(r)] += poisson_count(rate, int(drawn[:13], 16) / 2**52)

    got = corpus_pipeline.run(session, FOLDER).collect()
    assert Counter(tuple(r[c] for c in documents.columns) for r in got) == +want
    places, load = defaultdict(list), Counter({k: 0 for k in range(sharding.SHARDS)})
    for r in got:
        body = r.text.encode()
        assert r["size"] == len(body) + 16 and r.text_crc32 == zlib.crc32(body)
        places[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert set(places) <= set(range(sharding.SHARDS)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    by_slot = Counter()
    for r in got:
        by_slot[r.virtual_slot] += r["size"]
    # Heaviest slots first, each to the lightest shard: no two shards differ by more than one slot.
    assert max(load.values()) - min(load.values()) <= max(by_slot.values())


def test_text_with_letters_stays(session, edges):
    kept = {r.doc_id for r in corpus_pipeline.language_id(session, edges.unionByName(edges), "").collect()}
    assert kept == {r[0] for r in EDGES if r[1] and any(c.isalpha() for c in r[1])}


def test_long_texts_are_whole(session):
    tail = " ".join(f"t{k}" for k in range(3000))
    compare(session, [(1, BASE + " " + tail), (2, tail), (3, tail + " x"), (4, BASE)], 5)
