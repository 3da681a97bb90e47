"""Equi-joins of feature tables, and the nearest-event and two-hop joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.operators.hops import linked
from cartloom.operators.ordered import Running, ordered_windows
from cartloom.runtime import passing, plan_bytes, scratch_folder, shuffles_freed, stored


FEW_KEYS = 100_000
"""Distinct keys up to which they are broadcast to shrink a table."""
KEY_BITS = 1 << 28
"""Bits of a map of keys at most: 32 MB."""
MAP_WORDS = 512
"""Words of 64 bits in a bit map's row of 4 KB."""
FREQUENT = 200_000
"""Lines of a table at most that are looked up without moving rows, the most frequent ones."""
KEY_SEED = 20240607
RANGE_BITS = 15
"""Neighbours of a node whose numbers differ in these low bits only are in one list."""


def attach(df: DataFrame, table: DataFrame, on: Sequence[str] | dict[str, str],
           fills: dict | None = None, how: str = "left") -> DataFrame:
    """Join a feature table; ``on`` may map own key names to the table's.

    Null keys find no partner. No broadcast is forced: Spark broadcasts a
    table whose size it knows to be small and splits skewed partitions
    otherwise.
    """
    pairs = on if isinstance(on, dict) else {k: k for k in on}
    renamed = table.withColumnsRenamed({theirs: f"_r{i}" for i, theirs in enumerate(pairs.values())})
    match = None
    for i, mine in enumerate(pairs):
        one = df[mine] == renamed[f"_r{i}"]
        match = one if match is None else match & one
    out = df.join(renamed, match, how).drop(*[f"_r{i}" for i in range(len(pairs))])
    return out.fillna(fills) if fills else out


def attach_frequent(df: DataFrame, table: DataFrame, on: Sequence[str] | dict[str, str], weight: str, small: int,
                    most: int = FREQUENT) -> DataFrame:
    """``attach`` of a table that tells in ``weight`` how often its lines are met; each key has one line.

    Of a table of more than ``small`` bytes the ``most`` frequent lines, stored so that
    Spark sees whether they can be broadcast, are looked up where the rows are;
    only rows that are not among them are moved to the rest of the table.
    """
    plain = table.drop(weight)
    if plan_bytes(table) <= small:
        return attach(df, plain, on)
    theirs = list((on if isinstance(on, dict) else {k: k for k in on}).values())
    head = stored(table.dropna(subset=theirs).orderBy(F.desc(weight), *theirs).limit(most))
    marked = attach(df, head.drop(weight).withColumn("_met", F.lit(True)), on)
    moved = marked.filter("_met is null").select(*df.columns)
    return marked.filter("_met").drop("_met").unionByName(attach(moved, plain, on))


def outer_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of two count tables; missing counts are 0."""
    joined = left.join(right, key, "full_outer")
    return joined.fillna(0, [c for c in joined.columns if c != key])


def role_switched(table: DataFrame, roles: tuple[str, str]) -> DataFrame:
    """The same table with the two role keys exchanged."""
    a, b = roles
    other = {a: b, b: a}
    return table.select(*[F.col(c).alias(other.get(c, c)) for c in table.columns])


def key_bits(keys_of: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """(bucket, marks): a bit map of ``bits`` bits with the bit of every key's hash set, in maps of 4 KB."""
    place = F.pmod(F.xxhash64(F.lit(KEY_SEED), *keys), F.lit(bits)) + 1
    hashed = keys_of.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    return hashed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("marks"))


def maybe_among(table: DataFrame, marks: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """The rows whose key's bit is set: all whose key was marked, and by chance some others."""
    place = F.pmod(F.xxhash64(F.lit(KEY_SEED), *keys), F.lit(bits)) + 1
    # Words of 64 bits, of which a row reads one where the map lies; a binary would be copied for every row.
    half = lambda at: F.conv(F.hex(F.substring("marks", at, F.lit(4))), 16, 10).cast("long")
    words = F.transform(F.sequence(F.lit(0), F.lit(MAP_WORDS - 1)), lambda i: F.shiftleft(half(i * 8 + 1), 32).bitwiseOR(half(i * 8 + 5)))
    is_set = F.expr("(get(_words, cast(_bit >> 6 as int)) >> cast((_bit & 63) ^ 56 as int)) & 1 = 1")
    named = marks.select(F.col("bucket").alias("_bucket"), words.alias("_words"))
    met = table.withColumn("_bucket", F.bitmap_bucket_number(place)).withColumn("_bit", F.bitmap_bit_position(place)).join(F.broadcast(named), "_bucket")
    return met.filter(is_set).select(*table.columns)


def shrink_to(table: DataFrame, df: DataFrame, keys: Sequence[str], few: int = FEW_KEYS, most_bits: int = KEY_BITS) -> DataFrame:
    """Only the table rows whose keys occur in ``df``.

    Beyond ``few`` keys, which are looked up where the rows are, a bit map of the
    keys drops most other rows before the semi-join shuffles what is left. It has
    16 bits a key and ``most_bits`` at most, so its size is bounded; a fuller one
    lets more rows through, and the result is the same. Null keys are in neither.
    """
    wanted = stored(df.select(*keys).dropna().distinct())
    n = wanted.count()
    if n <= few:
        return table.join(F.broadcast(wanted), list(keys), "left_semi")
    bits = min(most_bits, 1 << (16 * n - 1).bit_length())
    return maybe_among(table, stored(key_bits(wanted, keys, bits)), keys, bits).join(wanted, list(keys), "left_semi")


def missing_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct ids of the left side that the right side lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def set_sizes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: sizes of both id sets, intersection, union and differences."""
    side = lambda frame, bit: frame.select(key).distinct().withColumn("_bit", F.lit(bit))
    both = side(left, 1).unionByName(side(right, 2)).groupBy(key).agg(F.sum("_bit").alias("_in"))
    count = lambda cond: F.count_if(cond)
    seen = F.col("_in")
    return both.agg(
        count(seen != 2).alias("n_left"),
        count(seen != 1).alias("n_right"),
        count(seen == 3).alias("n_both"),
        F.count(F.lit(1)).alias("n_union"),
        count(seen == 1).alias("n_left_only"),
        count(seen == 2).alias("n_right_only"),
    )


def attach_models(df: DataFrame, predictions: DataFrame, keys: Sequence[str], models: Sequence[str],
                  model: str = "model", score: str = "score") -> DataFrame:
    """One score column per model: a single pivot and a single join."""
    wide = predictions.groupBy(*keys).pivot(model, list(models)).agg(F.max(score))
    named = wide.withColumnsRenamed({m: f"{score}_{m}" for m in models})
    return df.join(named, list(keys), "left")


def nearest_events(rows: DataFrame, events: DataFrame, entity: tuple[str, str], at: tuple[str, str],
                   none: int = 15 * 86400, hot_rows: int | None = None) -> DataFrame:
    """Seconds to the entity's closest event strictly before and strictly after.

    Both sides collapse to distinct (entity, second) spots; a running maximum
    of the earlier spots and a minimum of the later ones find the neighbours in one pass. The pairs of an entity's rows and
    events are never formed.
    """
    spots = (
        rows.select(F.col(entity[0]).alias("_e"), F.col(at[0]).alias("_t"), F.lit(None).cast("long").alias("_ev"))
        .unionByName(events.select(F.col(entity[1]).alias("_e"), F.col(at[1]).alias("_t"),
                                   F.col(at[1]).cast("long").alias("_ev")))
        .groupBy("_e", "_t").agg(F.max("_ev").alias("_ev"))
    )
    sides = {"_prev": Running("max", "_ev", before=True), "_next": Running("min", "_ev", before=True, later=True)}
    both = ordered_windows(spots, ["_e"], ["_t"], sides, hot_rows)
    gaps = both.select(
        "_e", "_t",
        F.coalesce(F.col("_t") - F.col("_prev"), F.lit(none)).alias("gap_before"),
        F.coalesce(F.col("_next") - F.col("_t"), F.lit(none)).alias("gap_after"),
    )
    match = (rows[entity[0]] == gaps["_e"]) & (rows[at[0]] == gaps["_t"])
    joined = rows.join(gaps, match, "left").drop("_e", "_t")
    return joined.fillna(none, ["gap_before", "gap_after"])


def two_hop(pairs: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The given pairs (a, b) that are linked by some a -> c -> b, each once.

    For each pair only the shorter of a's followees and b's followers is opened,
    in memory: a hub is not multiplied out, and opened lists are not moved.
    """
    spark = pairs.sparkSession
    path = scratch_folder(spark)
    with shuffles_freed(spark), passing(spark):
        links = _links(edges, a, b)
        asked = links if pairs is edges else _links(pairs, a, b)
        found = stored(_two_hop(asked.withColumn("way", F.lit(0).cast("byte")), links).drop("way"), path=path)
    kinds = {f.name: f.dataType for f in pairs.schema}
    return found.select(F.col("_s").cast(kinds[a]).alias(a), F.col("_d").cast(kinds[b]).alias(b))


def _links(table: DataFrame, a: str, b: str) -> DataFrame:
    """The distinct links or pairs (_s, _d) of a table, stored; whole numbers are long."""
    named = table.select(F.col(a).alias("_s"), F.col(b).alias("_d"))
    ends = [F.col(c).cast("long") if _whole(named, c) else F.col(c) for c in named.columns]
    return stored(named.select(*ends).dropna().distinct())


def _whole(frame: DataFrame, column: str) -> bool:
    return frame.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")


def _legs(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links that can be a first step of two, and those that can be a second: they end, or start, at a node between others."""
    between = stored(links.select(F.col("_d").alias("node")).distinct().join(links.select(F.col("_s").alias("node")).distinct(), "node", "left_semi"))
    return tuple(links.join(between, links[end] == between["node"], "left_semi") for end in ("_d", "_s"))


def _neighbours(links: DataFrame, node: str, other: str) -> DataFrame:
    """(node, range, near): the node's neighbours, a row for those of 32,768 numbers, as places in that range;
    neighbours that are no numbers are ranges of their own."""
    if links.schema[other].dataType.typeName() in ("byte", "short", "integer", "long"):
        number = F.col(other).cast("long")
        part, place = F.shiftright(number, RANGE_BITS), number.bitwiseAND((1 << RANGE_BITS) - 1).cast("short")
    else:
        part, place = F.col(other), F.lit(0).cast("short")
    return stored(links.groupBy(F.col(node).alias("node"), part.alias("range")).agg(F.collect_list(place).alias("near")))


def _nodes(table: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The nodes in a column, for ``_near``: FEW_KEYS of them as they are, more as a bit map of 16 bits a node, KEY_BITS at most."""
    nodes = stored(table.select(column).distinct())
    n = nodes.count()
    bits = 0 if n <= FEW_KEYS else min(KEY_BITS, 1 << max(15, (16 * n).bit_length()))
    return stored(key_bits(nodes, [column], bits)) if bits else nodes.toDF("_node"), bits


def _near(table: DataFrame, column: str, nodes: tuple[DataFrame, int]) -> DataFrame:
    """Rows whose node is among the nodes, and by chance of a bit map some others."""
    known, bits = nodes
    return maybe_among(table, known, [column], bits) if bits else table.join(F.broadcast(known), table[column] == known["_node"], "left_semi")


def _two_hop(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Those of the distinct pairs (_s, _d, way) that are linked over some third.

    Nodes that are no whole numbers are numbered first.
    """
    whole = all(_whole(frame, c) for frame in (pairs, links) for c in ("_s", "_d"))
    if not whole:
        nodes = stored(links.select(F.col("_s").alias("node")).union(links.select("_d")).distinct().withColumn("number", F.monotonically_increasing_id()))
        numbered = lambda frame, c: frame.join(nodes, F.col(c) == F.col("node")).withColumn(c, F.col("number")).drop("node", "number")
        named = lambda frame, c: frame.join(nodes, F.col(c) == F.col("number")).withColumn(c, F.col("node")).drop("node", "number")
        pairs, links = (stored(numbered(numbered(frame, "_s"), "_d")) for frame in (pairs, links))
    first, second = (stored(leg) for leg in _legs(links.select("_s", "_d")))
    asked = _near(_near(pairs, "_s", _nodes(first, "_s")), "_d", _nodes(second, "_d"))
    found = linked(first.select(F.col("_s").alias("start"), F.col("_d").alias("node")), second.select(F.col("_s").alias("node"), F.col("_d").alias("end")),
                   asked.select(F.col("_s").alias("start"), F.col("_d").alias("end"), "way"))
    over = found.select(F.col("start").alias("_s"), F.col("end").alias("_d"), "way")
    return over if whole else named(named(over, "_s"), "_d")


def _reversed(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (_s, _d) whose reverse is a link; most others, of whole numbers, are kept out of the shuffle."""
    some, others = pairs, links
    if all(_whole(frame, c) for frame in (pairs, links) for c in ("_s", "_d")):
        known = {c: _nodes(links, c) for c in ("_s", "_d")}
        asked = known if pairs is links else {c: _nodes(pairs, c) for c in ("_s", "_d")}
        for mine, theirs in (("_s", "_d"), ("_d", "_s")):
            some, others = _near(some, mine, known[theirs]), _near(others, mine, asked[theirs])
    return some.join(others.select(F.col("_d").alias("_s"), F.col("_s").alias("_d")), ["_s", "_d"], "left_semi")


def follow_flags(rows: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per row (a, b): follows back, two hops forward, two hops backward; ``edges`` may be the rows themselves."""
    spark, names = rows.sparkSession, ("follows_back", "two_hop", "two_hop_back")
    path = scratch_folder(spark)
    with shuffles_freed(spark), passing(spark):
        links = _links(edges, a, b)
        pairs = links if edges is rows else _links(rows, a, b)
        # Both directions in one pass over the links.
        ways = (pairs.withColumn("way", F.lit(0).cast("byte"))
                .unionByName(pairs.select(F.col("_d").alias("_s"), F.col("_s").alias("_d"), F.lit(1).cast("byte").alias("way"))))
        back = F.col("way") == 1
        over = _two_hop(ways, links).select(
            F.when(back, F.col("_d")).otherwise(F.col("_s")).alias("_s"), F.when(back, F.col("_s")).otherwise(F.col("_d")).alias("_d"),
            F.when(back, 4).otherwise(2).alias("bit"))
        marks = _reversed(pairs, links).withColumn("bit", F.lit(1)).unionByName(over)
        flags = stored(marks.groupBy("_s", "_d").agg(F.bit_or("bit").alias("_flags")), path=path)
    kinds = {f.name: f.dataType for f in rows.schema}
    named = flags.select(F.col("_s").cast(kinds[a]).alias(a), F.col("_d").cast(kinds[b]).alias(b), "_flags")
    joined = rows.join(named, [a, b], "left")
    seen = F.coalesce("_flags", F.lit(0))
    return joined.withColumns({n: F.shiftright(seen, i).bitwiseAND(1) for i, n in enumerate(names)}).drop("_flags")
