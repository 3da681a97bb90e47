"""Pairs linked over a third node, found in cells of links that fit a task's memory.

A cell holds the first steps of some starts, the second steps to some ends and the
pairs asked for between them, as arrays. Lists are opened in memory only, the
shorter one of a pair's two, so what is moved grows with the links and the pairs
and not with what they multiply out to.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.runtime import stored

EDGES = 1 << 22
"""Links of a step, or pairs, in a cell at most, but for links of equal nodes."""
LEAST = 1 << 16
"""Cells are not made smaller than so many links and pairs."""
HELD = 1 << 20
"""Rows that a task deals out at a time."""
PROBES = 1 << 18
"""Neighbours looked up at a time."""
BUCKETS = 1 << 14
"""Nodes are dealt by buckets of their hash, whose counts the driver knows."""
SEED = 20240611
FIRST, SECOND, ASKED = 0, 1, 2
_MESSAGE = "cell int, kind byte, n int, x binary, y binary"


def _packing():
    """How numbers travel: the bytes above the smallest number, plane by plane. Nested, so that workers need no import."""

    def pack(v):
        above = (v - v.min()).view(np.uint64)
        width = (int(above.max()).bit_length() + 7) // 8
        return v.min().tobytes() + bytes([width]) + above.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()

    def unpack(data, n):
        above, width = np.zeros((n, 8), np.uint8), data[8]
        above[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(width, n).T
        return above.view(np.int64).ravel() + np.frombuffer(data, np.int64, 1)

    return pack, unpack


def places(counts, room: int, most: int):
    """(place of every bucket, shares of it by each of the counts, places in all).

    Buckets in a row share a place while none of their counts is beyond ``room``. A
    bucket with a count beyond ``most`` is one of hubs: it has as many places as its
    shares multiplied.
    """
    place, shares = np.zeros(BUCKETS, np.int64), np.ones((len(counts), BUCKETS), np.int64)
    at, held = 0, [0] * len(counts)
    for b in range(BUCKETS):
        own = [int(c[b]) for c in counts]
        split = [max(1, -(-n // most)) for n in own]
        wide = math.prod(split)
        if any(held) and (wide > 1 or any(h + n > room for h, n in zip(held, own))):
            at, held = at + 1, [0] * len(counts)
        place[b], shares[:, b] = at, split
        held = [h + n for h, n in zip(held, own)]
        if wide > 1:
            at, held = at + wide, [0] * len(counts)
    return place, shares, at + any(held)


def _deal(place, by_link, by_pair, turn, turns, now):
    """Messages of a batch's rows to their cells; second steps go to all cells, which is -1.

    A start's links are dealt over ``by_link`` cells by the node between, its pairs over
    ``by_pair`` by their end; each share of the one meets each share of the other.
    """
    pack, _ = _packing()

    def messages(cell, kind, x, y):
        order = np.argsort(x)
        order = order[np.argsort(cell[order], kind="stable")]
        cell, x, y = cell[order], x[order], y[order]
        cuts = np.flatnonzero(np.diff(cell)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)]):
            if high > low:
                yield int(cell[low]), kind, high - low, pack(np.diff(x[low:high], prepend=x[low])) + x[low].tobytes(), pack(y[low:high])

    def dealt(kind, x, y, by, to):
        for k in np.unique(kind).tolist():
            mine = kind == k
            p, q, b, t = x[mine], y[mine], by[mine], to[mine]
            if k == SECOND:
                keep = turn[b] + t % turns[b] == now
                yield from messages(np.full(int(keep.sum()), -1), k, p[keep], q[keep])
                continue
            if k == FIRST:
                own, copies, cell, step = None, by_pair[b], place[b] + t % by_link[b], by_link[b]
            else:
                own, copies, cell, step = (turn[t] <= now) & (now < turn[t] + turns[t]), by_link[b], place[b] + t % by_pair[b] * by_link[b], 1
            for i in range(int(copies.max())):
                keep = copies > i if own is None else own & (copies > i)
                yield from messages((cell + i * step)[keep], k, p[keep], q[keep])

    def deal(batches):
        held, n = [], 0

        def sent():
            rows = list(dealt(*[np.concatenate(c) for c in zip(*held)]))
            kinds = (pa.int32(), pa.int8(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["cell", "kind", "n", "x", "y"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= HELD:
                yield sent()
                held, n = [], 0
        if n:
            yield sent()

    return deal


def _meet():
    """The asked pairs of a cell that a first and a second step of it link."""
    _, unpack = _packing()

    def distinct(v):
        v = np.sort(v)
        return v[np.append(True, v[1:] != v[:-1])] if len(v) else v

    def found_at(known, v):
        """Place among the known ones, and which are."""
        at = np.minimum(np.searchsorted(known, v), len(known) - 1)
        return at, known[at] == v

    def spread(c):
        return (c * 0x9E3779B1) & 0xFFFFFFFF

    def look(hit, pairs, opened, low, keys, asked, their_low, their_keys, n):
        """Open one list of each pair and look its nodes up in the other. Pairs go by the list asked, which stays in the cache."""
        if not len(pairs):
            return
        order = pairs[np.argsort(asked[pairs], kind="stable")]
        node = keys % n
        mixed, eight = spread(node), np.diff(their_low) * 8
        # Eight marks a neighbour, side by side for a list, tell most nodes that are not in it.
        marks = np.zeros(8 * len(their_keys), bool)
        for i in range(0, len(their_keys), PROBES):
            owner, theirs = np.divmod(their_keys[i : i + PROBES], n)
            marks[their_low[owner] * 8 + ((spread(theirs) * eight[owner]) >> 32)] = True
        size = (low[1:] - low[:-1])[opened[order]]
        total = np.cumsum(size)
        begin = 0
        while begin < len(order):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] - size[begin] + PROBES, "right")))
            i, s = order[begin:end], size[begin:end]
            before = np.cumsum(s) - s
            at = np.arange(int(s.sum())) + np.repeat(low[opened[i]] - before, s)
            theirs = asked[i]
            spot = np.repeat(their_low[theirs] * 8, s) + ((mixed[at] * np.repeat(eight[theirs], s)) >> 32)
            maybe = np.flatnonzero(marks[spot])
            pair = np.searchsorted(before, maybe, "right") - 1
            _, true = found_at(their_keys, theirs[pair] * n + node[at[maybe]])
            hit[i[pair[true]]] = True
            begin = end

    def meet(table):
        kinds, sizes = (table.column(c).to_numpy() for c in ("kind", "n"))
        joined, at = {}, {}
        for k in np.unique(kinds).tolist():
            joined[k], at[k] = [np.empty(int(sizes[kinds == k].sum()), np.int64) for _ in range(2)], 0
        for i, (k, n) in enumerate(zip(kinds.tolist(), sizes.tolist())):
            x, (p, q) = table.column("x")[i].as_py(), joined[k]
            p[at[k] : at[k] + n] = np.cumsum(unpack(x[:-8], n)) + np.frombuffer(x, np.int64, 1, len(x) - 8)
            q[at[k] : at[k] + n] = unpack(table.column("y")[i].as_py(), n)
            at[k] += n
        none = pa.table({"start": pa.array([], pa.int64()), "end": pa.array([], pa.int64()), "way": pa.array([], pa.int8())})
        asked = [k for k in joined if k >= ASKED]
        if FIRST not in joined or SECOND not in joined or not asked:
            return none
        (a, out), (b, into) = joined.pop(FIRST), joined.pop(SECOND)
        between = distinct(into)
        n = len(between)
        out, known = found_at(between, out)
        a, out = a[known], out[known]
        if not len(a):
            return none
        starts, ends = distinct(a), distinct(b)
        after = distinct(np.searchsorted(starts, a) * n + out)
        del a, out
        b = np.searchsorted(ends, b) * n
        b += np.searchsorted(between, into)
        del into
        before = distinct(b)
        del b
        after_low = np.searchsorted(after, np.arange(len(starts) + 1) * n)
        before_low = np.searchsorted(before, np.arange(len(ends) + 1) * n)
        results = [none]
        for k in asked:
            p, q = joined.pop(k)
            s, one = found_at(starts, p)
            e, other = found_at(ends, q)
            both = one & other
            p, q, s, e = p[both], q[both], s[both], e[both]
            hit = np.zeros(len(p), bool)
            shorter = np.diff(after_low)[s] <= np.diff(before_low)[e]
            look(hit, np.flatnonzero(shorter), s, after_low, after, e, before_low, before, n)
            look(hit, np.flatnonzero(~shorter), e, before_low, before, s, after_low, after, n)
            results.append(pa.table({"start": p[hit], "end": q[hit], "way": np.full(int(hit.sum()), k - ASKED, np.int8)}))
        return pa.concat_tables(results)

    return meet


def linked(first: DataFrame, second: DataFrame, asked: DataFrame, edges: int | None = None) -> DataFrame:
    """The (start, end, way) asked for with a (start, node) in ``first`` and a (node, end) in ``second``.

    All are tables of whole numbers without nulls that can be read more than once; ``way``, a
    byte, is only carried along. One of the two steps, the one with fewer links, is read by
    every cell; where it does not fit one, cells are filled in several turns.
    """
    spark, edges = asked.sparkSession, edges or EDGES
    swap = second.count() > first.count()
    start, end, one, two = ("end", "start", second, first) if swap else ("start", "end", first, second)
    bucket = lambda c: F.pmod(F.xxhash64(F.lit(SEED), F.col(c)), F.lit(BUCKETS)).cast("int")
    row = lambda table, kind, x, y: table.select(kind.cast("byte").alias("kind"), F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"))
    rows = (row(one, F.lit(FIRST), start, "node").unionByName(row(two, F.lit(SECOND), end, "node"))
            .unionByName(row(asked, F.col("way") + ASKED, start, end)).withColumns({"by": bucket("x"), "to": bucket("y")}))
    counts = np.zeros((3, BUCKETS), np.int64)
    for kind, by, n in rows.groupBy(F.least("kind", F.lit(ASKED).cast("byte")).alias("kind"), "by").count().collect():
        counts[kind, by] = n
    turn, (turns,), rounds = places(counts[[SECOND]], edges, edges)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The links that every cell reads are at most twice those that are dealt.
    room = min(edges, max(LEAST, int(counts[SECOND].sum()) // max(1, rounds) // 2, int(counts[[FIRST, ASKED]].sum()) // tasks))
    place, (by_link, by_pair), cells = places(counts[[FIRST, ASKED]], room, edges)
    found = None
    for now in range(max(1, rounds)):
        of_turn = np.flatnonzero((turn <= now) & (now < turn + turns))
        low, high = int(of_turn.min(initial=BUCKETS)), int(of_turn.max(initial=-1))
        mine = rows.filter((F.col("kind") == FIRST) | F.when(F.col("kind") == SECOND, F.col("by")).otherwise(F.col("to")).between(low, high))
        messages = mine.mapInArrow(_deal(place, by_link, by_pair, turn, turns, now), _MESSAGE)
        every = F.when(F.col("cell") < 0, F.sequence(F.lit(0), F.lit(max(1, cells) - 1))).otherwise(F.array("cell"))
        dealt = messages.withColumn("cell", F.explode(every)).repartition(max(1, cells), "cell")
        part = stored(dealt.groupBy("cell").applyInArrow(_meet(), "start long, end long, way byte"))
        found = part if found is None else found.unionByName(part)
    if max(turns.max(), by_link.max()) > 1:
        found = found.distinct()
    return found.select(F.col(start).alias("start"), F.col(end).alias("end"), "way")
