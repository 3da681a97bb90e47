"""Near-duplicates by SuperMinHash, banding, verification and union-find.

A document is its set of hashed shingles. Equal sets become one class at once.
Classes that agree in a band of the signature share a bucket; every bucket links
to its smallest member, links are confirmed on the full sets, and components are
formed. What a bucket then still holds apart from one another is compared set
against set in blocks of bounded size, so no link is lost to the shortcut, and
no pairs are listed for the many that are already known to belong together.
Short sets of a large bucket, such as those of texts made from one template, are
only compared if they share one of their rarest shingles, as all linked sets do.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.registry import fresh, llm_query, read, written
from cartloom.llm.words import BLANK_CUT, find_words, mix

SHINGLE = 5
THRESHOLD = 80
"""Least similarity in hundredths."""
BANDS, ROWS = 32, 4
"""At a similarity of 0.8 the bands miss a pair with a chance below 1e-7."""
BLOCK = 512
"""Sets that a comparing task holds of either side."""
SHORT = 256
"""Sets of more shingles are compared with all of their bucket that are about as large."""
COUNTER_BITS = 20
"""2^COUNTER_BITS counters order shingles by rarity; a shared counter changes the work and not the links."""
FILTER_BITS = 24
FEW_MARKS = 500_000
"""So many dropped documents at most (50 bytes each) are broadcast; more are joined by shuffle."""
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words are one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    runs = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        runs = mix(runs * _GOLDEN + hashes[k : n - width + 1 + k] + np.uint64(width))
    return np.unique(runs)


def superminhash(elements: np.ndarray, slots: int = BANDS * ROWS) -> np.ndarray:
    """Signature of a non-empty set.

    Every element permutes the slots by its own Fisher-Yates shuffle; the j-th
    slot of that order gets j plus a random part if that is the least so far.
    After step j all later values exceed j, so a full signature ends the work.
    Elements go in blocks, which bounds the memory of a very long text.
    """
    low = np.full(slots, np.inf)
    for begin in range(0, len(elements), 4096):
        state = mix(elements[begin : begin + 4096] + _GOLDEN)
        order = np.tile(np.arange(slots, dtype=np.uint8), (len(state), 1))
        rows = np.arange(len(state))
        for j in range(slots):
            if low.max() < j:
                break
            state = state + _GOLDEN
            drawn = mix(state)
            pick = j + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
            slot = order[rows, pick]
            order[rows, pick] = order[:, j]
            np.minimum.at(low, slot, j + (drawn >> np.uint64(32)).astype(np.float64) * 2.0**-32)
    return low


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash for each band, its number included."""
    parts = signature.view(np.uint64).reshape(bands, -1)
    keys = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for k in range(parts.shape[1]):
        keys = mix(keys * _GOLDEN + parts[:, k])
    return keys.astype(np.int64)


def text_key(text: Column) -> Column:
    """Tells the texts of one id apart; null as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def _sets(texts: pa.Array, size: int):
    found = find_words(texts, BLANK_CUT)
    hashes = found.hashes()
    for row in range(len(texts)):
        elements = shingle_set(hashes[found.first[row] : found.first[row + 1]], size)
        yield elements, blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest of the set, band keys); the last two null for a document without words."""

    def sketch(batches):
        for batch in batches:
            counts, digests, bands = [], [], []
            signed: dict = {}
            for elements, digest in _sets(batch.column(2), size):
                counts.append(len(elements))
                digests.append(digest)
                if digest is not None and digest not in signed:
                    signed[digest] = band_keys(superminhash(elements))
                bands.append(signed.get(digest))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "digest", "bands"])

    return docs.select("doc_id", text_key(F.col("_text")).alias("text_key"), "_text").mapInArrow(
        sketch, "doc_id long, text_key string, n_shingles long, digest binary, bands array<long>")


def class_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, elements) of the wanted classes (node, digest), from the texts.

    A bit map of fixed size keeps most unwanted sets from being shuffled.
    """
    place = F.conv(F.substring(F.hex("digest"), 1, FILTER_BITS // 4), 16, 10).cast("int")
    marked = np.zeros(1 << FILTER_BITS, dtype=bool)
    marked[wanted.select(place.alias("place")).distinct().toArrow().column(0).to_numpy()] = True
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def take(batches):
        packed = bits.value
        for batch in batches:
            got: dict = {}
            for elements, digest in _sets(batch.column(0), size):
                if digest is not None and digest not in got:
                    at = int.from_bytes(digest[: FILTER_BITS // 8], "big")
                    if packed[at >> 3] >> (7 - (at & 7)) & 1:
                        got[digest] = elements.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.list_(pa.int64()))],
                                             names=["digest", "elements"])

    sets = docs.select("_text").mapInArrow(take, "digest binary, elements array<long>")
    return sets.join(wanted.select("digest", "node"), "digest").groupBy("node").agg(F.first("elements").alias("elements"))


def similar(common: Column, a: Column, b: Column, threshold: int) -> Column:
    return common * 100 >= (a + b - common) * threshold


def forest(links: DataFrame) -> DataFrame:
    """The links (a, b) of each partition reduced to (node, root) by union-find."""

    def shrink(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [x for x in list(parent) if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])

    return links.mapInArrow(shrink, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root being the component's smallest node.

    Each partition's links shrink to a forest; then large stars and small stars
    alternate until nothing changes, each round a table in the shared folder.
    """
    def mark(edges: DataFrame):
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = written(forest(links.select("a", "b")).distinct())
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = written(small.select("e.a", "e.b").filter("a <> b").distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _compare(threshold: int):
    """Links between the sets of a block and those of another, of different components."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes, parts = right.column("node").to_numpy(), right.column("part").to_numpy()
        lists = right.column("elements").combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        elements = lists.flatten().to_numpy()
        begins = np.cumsum(sizes) - sizes
        a, b = [], []
        joined: dict[int, int] = {}

        def top(x):
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        tops = parts.copy()
        for node, part, own in zip(left.column("node_").to_pylist(), left.column("part_").to_pylist(), left.column("elements_")):
            own = own.values.to_numpy()
            at = np.minimum(np.searchsorted(own, elements), len(own) - 1)
            common = np.add.reduceat((own[at] == elements).astype(np.int64), begins)
            near = common * 100 >= (sizes + len(own) - common) * threshold
            for other in np.flatnonzero(near & (tops != top(part))):
                x, y = top(part), top(int(parts[other]))
                if x != y:
                    joined[max(x, y)] = min(x, y)
                    a.append(node)
                    b.append(int(nodes[other]))
            if a:
                tops = np.array([top(int(p)) for p in parts])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _rarest(counters, threshold: int):
    """A row for each of a set's rarest shingles, so many that a linked set has one of them among its own."""

    def take(batches):
        for batch in batches:
            nodes, parts, tokens = [], [], []
            for node, part, elements in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = elements.values.to_numpy()
                rare = own[np.lexsort((own, counters.value[own & (len(counters.value) - 1)]))]
                rare = rare[: len(own) - (len(own) * threshold + 99) // 100 + 1]
                tokens.append(rare)
                nodes += [node] * len(rare)
                parts += [part] * len(rare)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens) if tokens else [], pa.int64()), pa.array(nodes, pa.int64()), pa.array(parts, pa.int64())],
                                             names=["bucket", "node", "part"])

    return take


def groups(rest: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(bucket, node, part): any two linked sets of different parts that share a bucket of ``rest`` share one here.

    Buckets of one part have nothing to compare. One of at most BLOCK sets stays
    as it is. In a larger one sets of at most SHORT shingles are grouped by their
    rarest ones, and those that a longer set can be linked with stay a bucket.
    """
    counts = rest.groupBy("bucket").agg(F.count("*").alias("all"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
    open_ = written(rest.join(counts.select("bucket", (F.col("all") > BLOCK).alias("large")), "bucket"))
    plain, large = open_.filter("NOT large").select("bucket", "node", "part"), open_.filter("large").select("bucket", "node", "part")
    if large.isEmpty():
        return plain
    length = F.size("elements")
    lengths = written(large.select("node", "part").distinct().join(sets.select("node", length.alias("length"), F.when(length <= SHORT, F.col("elements")).alias("elements")), "node"))
    long = large.join(lengths.filter(F.col("length") * 100 >= SHORT * threshold).select("node"), "node", "left_semi").select("bucket", "node", "part")
    short = lengths.filter("elements IS NOT NULL").select("node", "part", "elements")
    place = F.col("element").bitwiseAND(F.lit((1 << COUNTER_BITS) - 1))
    seen = short.select(F.explode("elements").alias("element")).groupBy(place.cast("int").alias("place")).agg(F.count("*").alias("n")).toArrow()
    counters = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
    counters[seen.column("place").to_numpy()] = seen.column("n").to_numpy()
    tokens = short.mapInArrow(_rarest(rest.sparkSession.sparkContext.broadcast(counters), threshold), "bucket long, node long, part long")
    return plain.unionByName(long).unionByName(tokens)


def linked_classes(docs: DataFrame, classes: DataFrame, size: int, threshold: int) -> DataFrame:
    """(node, root) of all classes with a link. docs has _text; classes has node, digest, n_shingles, bands."""
    banded = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("members")).filter("members > 1")
    members = written(banded.select("node", "bucket").join(shared, "bucket"))
    sets = written(class_sets(docs, classes.join(members.select("node").distinct(), "node", "left_semi"), size)
                   .withColumn("elements", F.array_sort("elements")))

    counted = classes.select("node", "n_shingles")
    pairs = members.filter("node <> hub").select("node", "hub").distinct()
    sized = pairs.join(counted, "node").join(counted.select(F.col("node").alias("hub"), F.col("n_shingles").alias("n_hub")), "hub")
    fit = sized.filter(F.least("n_shingles", "n_hub") * 100 >= F.greatest("n_shingles", "n_hub") * threshold)
    common = F.size(F.array_intersect("elements", "others")).cast("long")
    stars = (fit.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("elements").alias("others")), "hub")
             .filter(similar(common, F.col("n_shingles"), F.col("n_hub"), threshold))
             .select(F.col("node").alias("a"), F.col("hub").alias("b")))
    links = written(stars)
    parted = components(links)

    # Members apart from their group's largest component against all others of the group.
    rest = members.filter("node <> hub").select("bucket", "node").join(parted, "node", "left").withColumn("part", F.coalesce("root", "node"))
    rest = written(groups(written(rest.select("bucket", "node", "part")), sets, threshold))
    sizes = rest.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    split = written(rest.join(main.select("bucket", F.col("main.part").alias("main")), "bucket"))
    few = split.groupBy("bucket").agg(F.count("*").alias("all"), F.count_if(F.col("part") != F.col("main")).alias("apart"))
    blocked = split.join(few, "bucket").withColumns({
        "blocks": F.ceil(F.col("all") / BLOCK).cast("int"), "lefts": F.ceil(F.col("apart") / BLOCK).cast("int"),
        "at": F.xxhash64("node")})
    right = blocked.select("bucket", "node", "part", F.pmod("at", F.col("blocks")).cast("int").alias("j"),
                           F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"))
    left = blocked.filter("part <> main").select("bucket", "node", "part", F.pmod("at", F.col("lefts")).cast("int").alias("i"),
                                                 F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    keys = ["bucket", "i", "j"]
    # New names, as the two sides come from one table.
    ours = left.join(sets, "node").select(*(F.col(c).alias(f"{c}_") for c in (*keys, "node", "part", "elements")))
    theirs = right.join(sets, "node").select(*keys, "node", "part", "elements")
    found = (ours.groupBy(*(f"{k}_" for k in keys)).cogroup(theirs.groupBy(*keys))
             .applyInArrow(_both_sides(_compare(threshold)), "a long, b long"))
    return components(links.unionByName(written(found)))


def _both_sides(compare):
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return compare(left, right) if left.num_rows and right.num_rows else empty

    return run


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_key.

    Words end at blanks, with A-Z lower-cased. Linked: 100 * common >= threshold
    * union of the shingle sets. The component's id is the smallest doc_id that
    links reach, nulls counting as larger than any; the document of that id is
    kept, as are all without words (null, empty), which link with nothing. Rows
    repeated in id share one fate; a component of null ids only is kept whole.
    An empty table gives no rows.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    rows = written(sketches(source, size))
    per_set = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = written(per_set.withColumn("node", F.monotonically_increasing_id()))
    parted = written(linked_classes(source, classes, size, threshold))
    known = classes.select("node", "digest", "first_id").join(parted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labelled = known.join(names, "root").select("digest", "component_id")
    worded = rows.filter("digest IS NOT NULL").select("doc_id", "text_key", "n_shingles", "digest").join(labelled, "digest")
    empty = rows.filter("digest IS NULL").select("doc_id", "text_key", "n_shingles", "digest", F.col("doc_id").alias("component_id"))
    return worded.unionByName(empty).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")


def deduplicated(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose documents are kept, all columns kept, rows repeated in id and text once."""
    decided = written(near_duplicates(docs, size, threshold, doc_id, text))
    own_id, own_key = fresh(docs.columns, "id"), fresh(docs.columns, "key")
    key = [F.col(doc_id).eqNullSafe(F.col(own_id)), text_key(F.col(text)) == F.col(own_key)]

    def marks(rows: DataFrame) -> DataFrame:
        named = rows.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).distinct()
        return F.broadcast(named) if named.count() <= FEW_MARKS else named

    dropped = marks(decided.filter("NOT kept"))
    repeated = written(decided.filter("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1"))
    kept = docs.join(dropped, key, "left_anti")
    if repeated.isEmpty():
        return kept
    once = kept.join(marks(repeated), key, "left_semi").dropDuplicates([doc_id, text])
    return kept.join(marks(repeated), key, "left_anti").unionByName(once)


@llm_query("op9_near_dedup")
def op9_near_dedup(spark, folder):
    """All documents by two-word shingles."""
    return near_duplicates(read(spark, folder, "documents"), size=2).drop("text_key")
