"""Nearest items by cosine similarity: a stated set of vectors against all, in blocks.

Vectors are packed into blocks of some thousand as unit-length matrices. A block
of queries and a block of items meet once and are multiplied as matrices; of the
product only each query's best items of the block go on, and the best over all
blocks are ranked after. Query blocks are broadcast in rounds of counted size,
so items never move, whatever the number of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.operators.ordered import top_k
from cartloom.runtime import stored

BLOCK = 2048
ROUND_BYTES = 32 << 20
"""Bytes of query blocks that are broadcast at a time."""
DIGITS = 9
"""Similarities are compared to so many digits, so that equal vectors tie whatever block they are in."""
_PACKED = "ids array<long>, rows binary"


def comparable(vector: Column, size: int) -> Column:
    """Of the size, all its numbers finite, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def blocks(vectors: DataFrame, key: str, vector: str, size: int, rows: int = BLOCK) -> DataFrame:
    """(ids, rows): the comparable vectors of each partition, ``rows`` at a time, of unit length."""

    def unit(matrix: np.ndarray) -> np.ndarray:
        # Scaled first, so that squares neither overflow nor vanish.
        matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
        return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))

    def pack(batches):
        ids, held, n = [], [], 0

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([unit(np.concatenate(held)).tobytes()], pa.binary())],
                                              names=["ids", "rows"])

        for batch in batches:
            numbers = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for low in range(0, len(keys), rows):
                part = keys[low : low + rows]
                if n and n + len(part) > rows:
                    yield packed()
                    ids, held, n = [], [], 0
                ids.append(part)
                held.append(numbers[low : low + rows])
                n += len(part)
        if n:
            yield packed()

    fit = vectors.filter(F.col(key).isNotNull() & comparable(F.col(vector), size))
    return fit.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(pack, _PACKED)


def _best(size: int, k: int, itself: bool):
    """The k best items of a block for each query of a block, ties to the smaller id."""

    def multiply(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, wanted = (batch.column(c)[i].values.to_numpy() for c in ("ids", "query_ids"))
                items, queries = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.float64).reshape(-1, size) for c in ("rows", "query_rows"))
                order = np.argsort(ids, kind="stable")
                ids, items = ids[order], items[order]
                found = np.round(queries @ items.T, DIGITS)
                if not itself:
                    found[wanted[:, None] == ids[None, :]] = -np.inf
                take = min(k, len(ids))
                if take < len(ids):
                    least = np.partition(found, len(ids) - take, axis=1)[:, len(ids) - take]
                    q, at = np.nonzero(found >= least[:, None])
                else:
                    q, at = np.nonzero(np.ones(found.shape, dtype=bool))
                value = found[q, at]
                # Of equal ones at the border the smallest ids are enough.
                rank = np.lexsort((at, -value, q))
                q, at, value = q[rank], at[rank], value[rank]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                keep = (place < take) & np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array(wanted[q[keep]]), pa.array(ids[at[keep]]), pa.array(value[keep])], names=["query", "nearest", "similarity"])

    return multiply


def nearest(queries: DataFrame, items: DataFrame, key: str, vector: str, size: int, k: int = 1, itself: bool = False) -> DataFrame:
    """(query, nearest, similarity, rank): the ``k`` items of highest cosine similarity to each query, exactly.

    Keys are whole numbers. An item is not its own neighbour unless ``itself``
    says so; ties go to the smaller key. Vectors that are null, of another size,
    all zero or not finite are compared with nothing; a query that occurs twice
    under one key is one query. Empty tables give no rows.
    """
    if k < 1 or size < 1:
        raise ValueError("k and size must be 1 or more")
    asked = stored(blocks(queries.dropDuplicates([key]), key, vector, size).withColumnsRenamed({"ids": "query_ids", "rows": "query_rows"})
                   .withColumn("number", F.monotonically_increasing_id()))
    packed = blocks(items, key, vector, size)
    bytes_of = [(r.number, r.n) for r in asked.select("number", (F.octet_length("query_rows") + 8 * F.size("query_ids")).alias("n")).collect()]
    rounds: list[list[int]] = []
    room = 0
    for number, n in sorted(bytes_of):
        if not rounds or n > room:
            rounds.append([])
            room = ROUND_BYTES
        rounds[-1].append(number)
        room -= n
    if len(rounds) > 1:
        packed = stored(packed)
    found = None
    for numbers in rounds or [[]]:
        chunk = asked.filter(F.col("number").between(min(numbers, default=0), max(numbers, default=-1))).drop("number")
        # A stated set against all items, block by block; never rows by rows.
        pairs = packed.crossJoin(F.broadcast(chunk)).select("ids", "rows", "query_ids", "query_rows")
        one = pairs.mapInArrow(_best(size, k, itself), "query long, nearest long, similarity double")
        found = one if found is None else found.unionByName(one)
    # Some rows for each query and block of items, kept so that ranking them multiplies nothing again.
    return top_k(stored(found.distinct()), ["query"], [F.desc("similarity"), F.asc("nearest")], k)
