"""Exact dedup, decontamination, mixing and sharding: against SQL, laws and edge rows."""

import hashlib
import math
import re
import uuid
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from cartloom.llm import catalog, decontaminate, exact_dedup, mixing, sharding
from cartloom.runtime import scratch_folder
from tests.llm.conftest import BASE, FOLDER, SCHEMA, letter_words
from tests.test_queries import canonical


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in ("documents", "benchmark"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(session, duck, name):
    frame = catalog.QUERIES[name](session, FOLDER)
    columns, got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    result = duck.sql(catalog.ORACLES[name])
    names, want = canonical(result.columns, result.fetchall())
    assert columns == names
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-8) if any(isinstance(v, float) for v in a) else a == b


def index(session):
    return exact_dedup.DigestIndex(session, scratch_folder(session), f"digests_{uuid.uuid4().hex}", 4)


def test_dedup_keeps_the_longest_then_the_smallest_id(session):
    rows = [(3, "a b", "", "", 0), (1, "a  b", "", "", 0), (2, "a  b", "", "", 0), (2, "a  b", "", "", 0), (4, None, "", "", 0), (5, " ", "", "", 0), (None, "ab", "", "", 0)]
    got = index(session).add(session.createDataFrame(rows, SCHEMA)).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.text_sha256].append(r)
    assert len(got) == len(rows)
    ab = groups[hashlib.sha256(b"ab").hexdigest()]
    assert len(ab) == 5 and {r.keep_id for r in ab} == {1} and all(r.group_size == 5 for r in ab)
    blank = groups[hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in blank} == {5}
    assert all(sum(r.kept for r in g) == 1 for g in groups.values())


def test_repeated_rows_keep_one(session, edges):
    got = index(session).add(edges).collect()
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in got}


def test_later_batches_only_add_new_texts(session):
    store = index(session)
    first = session.createDataFrame([(1, "one", "", "", 0), (2, "two", "", "", 0)], SCHEMA)
    second = session.createDataFrame([(0, "two", "", "", 0), (3, "three", "", "", 0)], SCHEMA)
    store.add(first)
    got = {r.doc_id: r for r in store.add(second).collect()}
    assert (got[0].keep_id, got[0].kept) == (2, False) and got[3].kept
    assert not any(r.kept for r in store.add(second).collect())
    reopened = exact_dedup.DigestIndex(session, store.path, f"again_{uuid.uuid4().hex}", 4)
    assert sorted(r.keep_id for r in reopened.table().collect()) == [1, 2, 3]


def decisions(frame):
    return sorted(map(str, frame.collect()))


def test_a_named_batch_can_be_run_again(session, edges):
    store = index(session)
    store.add(session.createDataFrame([(50, BASE, "", "", 0)], SCHEMA), batch="monday")
    first = decisions(store.add(edges, batch="tuesday"))
    held = decisions(store.table())
    assert decisions(store.add(edges.repartition(3), batch="tuesday")) == first and decisions(store.table()) == held
    assert any("kept=True" in r for r in first) and any("keep_id=50, " in r for r in first)
    # Under another name it is a new batch, of which nothing is new.
    assert not any("kept=True" in r for r in decisions(store.add(edges, batch="wednesday")))


def test_a_batch_that_failed_between_append_and_result(session, edges):
    whole = index(session)
    want = decisions(whole.add(edges, batch="b"))
    rows = sorted(map(tuple, whole.table().collect()))
    for done in (rows, rows[::2], []):
        store = index(session)
        if done:
            (session.createDataFrame(done, whole.COLUMNS).write.format("parquet").mode("append").bucketBy(4, "digest").sortBy("digest")
             .option("path", store.path).saveAsTable(store.name))
        assert decisions(store.add(edges, batch="b")) == want
        assert sorted(map(tuple, store.table().collect())) == rows


def test_clashing_columns_in_dedup(session, edges, clashing):
    odd = clashing.withColumns({c: F.lit("taken") for c in ("points", "row", "batch", "best", "mine", "new")})
    assert decisions(index(session).add(odd)) == decisions(index(session).add(edges))


def test_buckets_follow_the_texts(session):
    made = exact_dedup.DigestIndex(session, scratch_folder(session), f"digests_{uuid.uuid4().hex}", texts=1_000_000_000)
    assert made.buckets == 250 and index(session).buckets == 4


def test_the_index_side_of_the_anti_join_is_not_shuffled(session):
    store = index(session)
    store.add(session.createDataFrame([(1, "one", "", "", 0)], SCHEMA))
    fresh = session.createDataFrame([("x",)], "digest string").hint("merge").join(store.table().select("digest"), "digest", "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


def test_empty_batch(session, empty):
    assert index(session).add(empty).count() == 0


def hits(text, items, size=13, share=20):
    words = letter_words(text)
    windows = defaultdict(set)
    for name, body in items:
        w = letter_words(body)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(name)
    covered, ids = set(), set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            found = windows.get(tuple(words[k : k + n]))
            if found:
                covered.update(range(k, k + n))
                ids |= found
    ids = sorted(map(str, ids - {None}))
    sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
    return len(words), len(covered), len(ids), sha, bool(covered) and share * len(covered) >= len(words)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak"), (2, "the lazy dog while"),
         (2, "the lazy dog while"), (3, ""), (4, None), (5, "word"), (6, "Über alle"), (7, "the the the"), (8, "x y x y x y x y x y x y x y x y")]
TEXTS = ["the the the the", "the the", "x y " * 20, "y x " * 9, "Über ALLE länder", "the lazy dog while the lazy dog while", "a word " * 50]


def test_contamination_of_edge_rows(session, edges):
    items = session.createDataFrame(ITEMS, "item_id long, text string")
    more = session.createDataFrame([(100 + k, t, "en", "a", 1) for k, t in enumerate(TEXTS)], SCHEMA)
    docs = edges.unionByName(more)
    got = decontaminate.contamination(docs, items)
    texts = [r.text for r in docs.collect()]
    want = Counter(hits(t, ITEMS) for t in texts)
    assert Counter((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == want
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()) == Counter(t for t in texts if not hits(t, ITEMS)[4])


def test_contamination_without_items_or_documents(session, edges, empty, benchmark):
    assert decontaminate.contamination(empty, benchmark).count() == 0
    none = decontaminate.contamination(edges, benchmark.limit(0)).collect()
    assert len(none) == edges.count() and not any(r.contaminated or r.n_hit for r in none)


def poisson_count(rate, u):
    total, term, k = math.exp(-rate), math.exp(-rate), 0
    while total <= u:
        k += 1
        term *= rate / k
        total += term
    return k


def test_counts_invert_the_poisson_distribution(session, edges, clashing):
    rates = mixing.source_rates(edges, {"a": 3.0, "b": 1.0, None: 0.5})
    by_source = {r.source: r.rate for r in rates.collect()}
    want = Counter()
    for r in edges.collect():
        key = hashlib.md5(f"{mixing.SEED}:{'' if r.doc_id is None else r.doc_id}:{r.text or ''}".encode()).hexdigest()
        want[r.doc_id, r.text] += poisson_count(by_source[r.source], int(key[:13], 16) / 2**52)
    assert Counter((r.doc_id, r.text) for r in mixing.replicate(edges, rates).collect()) == +want
    mixed = mixing.replicate(clashing, rates)
    assert set(mixed.columns) == set(clashing.columns) and mixed.filter("CAST(rate AS STRING) = 'taken'").count() == 0


def test_sources_get_their_share(documents):
    rates = mixing.source_rates(documents, budget=40.0 * documents.agg(F.sum(F.octet_length("text"))).first()[0])
    sizes = {r[0]: r[1] for r in documents.groupBy("source").agg(F.sum(F.octet_length("text"))).collect()}
    mixed = mixing.replicate(documents, rates)
    got = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(F.octet_length("text"))).collect()}
    weight = sum(b**0.5 for b in sizes.values())
    for source, size in sizes.items():
        assert got[source] / sum(got.values()) == pytest.approx(size**0.5 / weight, rel=0.25)


def test_large_and_zero_rates(session):
    table = session.createDataFrame([(0.0,), (0.3,), (900.0,)], "rate double").withColumn("cdf", mixing.poisson_cdf(F.col("rate")))
    for r in table.collect():
        assert r.cdf[-1] == pytest.approx(1.0, abs=1e-9)
        assert sum(c <= 0.5 for c in r.cdf) == {0.0: 0, 0.3: 0, 900.0: 900}[r.rate]


def test_very_large_rates(session):
    """The middle of 300,000 copies, its quartiles by the normal distribution, in time in proportion."""
    rate = 300_000.0
    cdf = session.createDataFrame([(rate,)], "rate double").select(mixing.poisson_cdf(F.col("rate")).alias("cdf")).first().cdf
    assert cdf == sorted(cdf) and cdf[-1] == pytest.approx(1.0, abs=1e-8) and cdf[int(rate - 14 * rate**0.5)] == 0
    for share, z in ((0.25, -0.6745), (0.5, 0.0), (0.75, 0.6745)):
        assert sum(c <= share for c in cdf) == pytest.approx(rate + z * rate**0.5, abs=2)


def test_rates_too_large_to_broadcast(session, edges, monkeypatch):
    rates = mixing.source_rates(edges, {"a": 3.0, "b": 1.0, None: 0.5})
    few = sorted(map(str, mixing.replicate(edges, rates).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(str, mixing.replicate(edges, rates).collect())) == few


def test_mixing_nothing(empty):
    assert mixing.replicate(empty, mixing.source_rates(empty)).count() == 0


def placed(session, docs):
    return sharding.shard_documents(docs, sharding.SlotMap(session, scratch_folder(session)), shards=3, slots=64)


def check_places(rows, shards=3):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        body = (r.text or "").encode()
        assert r["size"] == len(body) + 16 and r.text_crc32 == zlib.crc32(body) and r.law == "bytes" and r.grown_shard is None
    assert set(by) <= set(range(shards)) and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_places_are_gapless(session, edges, clashing, empty):
    rows = placed(session, edges).collect()
    assert len(rows) == edges.count()
    check_places(rows)
    check_places(placed(session, clashing).collect())
    assert placed(session, empty).count() == 0


def test_pipeline_spreads_copies(session, edges, empty):
    import corpus_pipeline

    many = edges.filter("doc_id = 1").crossJoin(session.range(300).select()).unionByName(edges)
    rows = corpus_pipeline.shards(session, many, FOLDER).collect()
    assert Counter((r.doc_id, r.text, r.lang) for r in rows) == Counter((r.doc_id, r.text, r.lang) for r in many.collect())
    check_places(rows, sharding.SHARDS)
    hot = [r for r in rows if r.doc_id == 1]
    assert len({r.virtual_slot for r in hot}) > 250 and len({r.shard for r in hot}) > 30
    assert corpus_pipeline.shards(session, empty, FOLDER).count() == 0


def test_equal_rows_are_spread(session, edges, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 700)
    hot = edges.filter("doc_id = 1").limit(1).crossJoin(session.range(20_000).select())
    rows = placed(session, hot.unionByName(edges.filter("doc_id < 10"))).collect()
    check_places(rows)
    assert len(rows) == 20_000 + edges.filter("doc_id < 10").count()
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert max(load.values()) < 1.1 * min(load.values())


def test_clashing_columns_in_the_pipeline(session, clashing):
    import corpus_pipeline

    assert decontaminate.decontaminated(clashing, session.read.parquet(f"{FOLDER}/benchmark.parquet")).columns == clashing.columns
    rows = corpus_pipeline.shards(session, clashing, FOLDER)
    own = [c for c in clashing.columns if c not in ("size", "shard", "slot", "law")]
    assert set(own) <= set(rows.columns) and len(set(rows.columns)) == len(rows.columns)
    assert Counter(map(str, rows.select(*own).collect())) == Counter(map(str, clashing.select(*own).collect()))
    check_places(rows.collect(), sharding.SHARDS)


def test_sizes_are_near_equal(session, documents):
    rows = placed(session, documents.unionByName(documents).unionByName(documents)).collect()
    check_places(rows)
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert max(load.values()) < 1.1 * min(load.values())


def test_rebalancing_moves_few_slots():
    sizes = {s: 100 + s % 7 for s in range(400)}
    old = sharding.balance(sizes, 10)
    new = sharding.balance(sizes, 11, old)
    load = Counter()
    for s, k in new.items():
        load[k] += sizes[s]
    assert max(load.values()) - min(load.values()) <= 2 * max(sizes.values())
    assert sum(old[s] != new[s] for s in sizes) < 50
    fewer = sharding.balance(sizes, 9, old)
    assert set(fewer.values()) == set(range(9))


def test_map_versions(session, documents):
    store = sharding.SlotMap(session, scratch_folder(session))
    sizes = sharding.slot_sizes(sharding.with_slot(documents, 64))
    store_sizes = {r.virtual_slot: r.slot_bytes for r in sizes.collect()}
    store.write(1, sizes, 3, 64)
    store.write(2, sizes, 4, 64, old=1)
    one, two = ({r.virtual_slot: r.shard for r in store.read(v).collect()} for v in (1, 2))
    assert len(one) == len(two) == 64 and set(two.values()) == {0, 1, 2, 3}
    assert sum(one[s] != two[s] for s in one) < 40
    for shards, slots in ((3, one), (4, two)):
        load = Counter()
        for s, k in slots.items():
            load[k] += store_sizes.get(s, 0)
        assert len(load) == shards and max(load.values()) - min(load.values()) <= 2 * max(store_sizes.values())


def test_patterns_agree():
    assert re.fullmatch(exact_dedup.BLANKS, " \t\n\x0b\x0c\r")
