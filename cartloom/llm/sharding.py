"""Shards by fixed virtual slots.

A record's hash names one of a few thousand slots for good; a stored, versioned
map names each slot's shard. Only the map changes when shards are added or
sizes drift, so a rebalancing moves few slots. The map has ``SLOTS`` rows at
any corpus size, which bounds what is broadcast and what the driver sees.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartloom.llm.registry import fresh, llm_query, read, written
from cartloom.runtime import scratch_folder

SLOTS = 4096
SHARDS = 40
ROW_BYTES = 16
CHUNK = 10_000
"""Copies of a row that one array names when they are numbered."""
MAP_SCHEMA = "version INT, virtual_slot INT, shard INT, slot_bytes LONG, slot_rows LONG, first_position LONG"


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds size and text_crc32, replacing columns of these names. Null text has no bytes."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"size": F.octet_length(body).cast("long") + F.lit(ROW_BYTES), "text_crc32": F.crc32(body.cast("binary"))})


def with_slot(docs: DataFrame, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text", key: Column | None = None) -> DataFrame:
    """Adds size, text_crc32 and virtual_slot, replacing columns of these names.

    Id and text decide the slot together, so a hot or null id spreads over the
    slots; only rows repeated in id and text share one. A whole-number ``key``
    decides in their place.
    """
    own = F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit(""))) if key is None else key
    return with_size(docs, text).withColumn("virtual_slot", F.pmod(own, F.lit(slots)).cast("int"))


def numbered(docs: DataFrame, number: str) -> DataFrame:
    """All rows with a ``number`` from 0 that tells equal rows apart.

    Equal rows are counted, which their tasks do before they meet, stored once,
    and made again from the count in chunks of at most CHUNK, those of one hot
    row by many tasks.
    """
    many, chunk = fresh([*docs.columns, number], "many"), fresh([*docs.columns, number], "chunk")
    counted = written(docs.groupBy(*(F.col(f"`{c}`") for c in docs.columns)).agg(F.count("*").alias(many)))
    few = counted.filter(F.col(many) <= CHUNK).withColumn(chunk, F.lit(0).cast("long"))
    hot = counted.filter(F.col(many) > CHUNK).withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1, F.lit(CHUNK).cast("long"))))
    chunks = few.unionByName(hot.repartition(docs.sparkSession.sparkContext.defaultParallelism, F.xxhash64(chunk, *(F.col(f"`{c}`") for c in docs.columns))))
    last = F.least(F.col(many), F.col(chunk) + CHUNK) - 1
    return chunks.withColumn(number, F.explode(F.sequence(F.col(chunk), last))).drop(many, chunk)


def slot_sizes(slotted: DataFrame) -> DataFrame:
    """Bytes and rows of each slot; at most one row per slot."""
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))


def balance(sizes: dict[int, int], shards: int, old: dict[int, int] | None = None) -> dict[int, int]:
    """A shard for every slot, sizes near equal.

    From nothing: the largest slots first, each to the lightest shard. From an
    ``old`` map: slots of shards that are gone, then the best fitting slots of
    the heaviest shard move to the lightest while that narrows the gap.
    """
    load = [0] * shards
    chosen = {s: k for s, k in (old or {}).items() if k < shards and s in sizes}
    for slot, shard in chosen.items():
        load[shard] += sizes[slot]
    heap = [(b, k) for k, b in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(sizes.keys() - chosen.keys(), key=lambda s: (-sizes[s], s)):
        bytes_, shard = heapq.heappop(heap)
        chosen[slot] = shard
        load[shard] = bytes_ + sizes[slot]
        heapq.heappush(heap, (load[shard], shard))
    if old:
        for _ in range(len(sizes)):
            high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
            gap = load[high] - load[low]
            fit = [s for s, k in chosen.items() if k == high and 0 < sizes[s] < gap]
            if not fit:
                break
            slot = min(fit, key=lambda s: (abs(2 * sizes[s] - gap), s))
            chosen[slot] = low
            load[high] -= sizes[slot]
            load[low] += sizes[slot]
    return chosen


class SlotMap:
    """Versions of the slot-to-shard map, one Parquet folder each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/v{version}")

    def write(self, version: int, sizes: DataFrame, shards: int = SHARDS, slots: int = SLOTS, old: int | None = None) -> DataFrame:
        """Map of the slots' present sizes; ``old`` names the version to edit.

        Slots without rows get a shard too. ``first_position`` is the number of
        rows in the shard's slots before this one.
        """
        found = {r.virtual_slot: (r.slot_bytes, r.slot_rows) for r in sizes.collect()}
        before = {r.virtual_slot: r.shard for r in self.read(old).collect()} if old is not None else None
        chosen = balance({s: found.get(s, (0, 0))[0] for s in range(slots)}, shards, before)
        rows, filled = [], [0] * shards
        for slot in range(slots):
            size, count = found.get(slot, (0, 0))
            rows.append((version, slot, chosen[slot], size, count, filled[chosen[slot]]))
            filled[chosen[slot]] += count
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{self.path}/v{version}")
        return self.read(version)


def place(slotted: DataFrame, slot_map: DataFrame, order: list[Column]) -> DataFrame:
    """Adds shard and slot, the row's gapless position in its shard.

    Rows are numbered slot by slot, so no task holds more than a slot's rows,
    and the map's running counts put the slots one after the other.
    """
    at, own_slot, own_shard, first = (fresh(slotted.columns, name) for name in ("at", "slot", "shard", "first"))
    ranked = slotted.withColumn(at, F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order)) - 1)
    few = slot_map.select(F.col("virtual_slot").alias(own_slot), F.col("shard").alias(own_shard), F.col("first_position").alias(first))
    joined = ranked.join(F.broadcast(few), F.col("virtual_slot") == F.col(own_slot))
    return joined.withColumns({"shard": F.col(own_shard), "slot": F.col(first) + F.col(at)}).drop(at, own_slot, own_shard, first)


def shard_documents(docs: DataFrame, slot_map: SlotMap, shards: int = SHARDS, slots: int = SLOTS,
                    keep: list[str] | None = None, seed: int | None = None) -> DataFrame:
    """All rows of docs with its columns, or those of ``keep``, and size,
    text_crc32, virtual_slot, law, shard, slot and grown_shard, replacing
    columns of these names.

    The law is ``bytes``: shard sizes are near equal. Rows equal in all that is
    kept are numbered, and a hash of id, text and number names the slot, so
    copies spread over the slots however many there are; columns must be of
    types that can be grouped. In a slot rows are ordered by id, or with a
    ``seed`` shuffled by another hash. An empty table gives no rows and a map of
    empty slots.
    """
    spark = docs.sparkSession
    added = ("size", "text_crc32", "virtual_slot", "law", "shard", "slot", "grown_shard")
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    both, copy = fresh(docs.columns, "both"), fresh(docs.columns, "copy")
    hashed = F.xxhash64(*([] if seed is None else [F.lit(seed)]), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    rows = numbered(with_size(docs.withColumn(both, hashed)).select(*(F.col(f"`{c}`") for c in names), "size", "text_crc32", both), copy)
    slotted = rows.withColumn("virtual_slot", F.pmod(F.xxhash64(both, copy), F.lit(slots)).cast("int"))
    version = slot_map.write(1, slot_sizes(slotted.select("virtual_slot", "size")), shards, slots)
    plain = [F.col("doc_id")] if "doc_id" in names else []
    shuffled = [] if seed is None else [F.xxhash64(F.lit(seed + 1), both, copy)]
    placed = place(slotted, version, [*shuffled, *plain, F.col("text_crc32"), F.col("size"), F.col(both), F.col(copy)])
    return placed.drop(both, copy).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@llm_query("op8_sharding")
def op8_sharding(spark, folder):
    """Every document's place in 40 shards."""
    placed = shard_documents(read(spark, folder, "documents"), SlotMap(spark, scratch_folder(spark)), keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot")
