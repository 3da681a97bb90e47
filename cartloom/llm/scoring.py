"""Scores of texts under a backoff n-gram automaton of the whole corpus.

States are the root and one state for every word of the training texts; an arc
of a state is a word seen after it, with log10 of its smoothed probability, and
its failure arc leads to the root with log10 of the state's backoff weight.
Probabilities are by absolute discounting over an add-one unigram model, with
one share for all unknown words, so those of a state sum to one:

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | u) = (c(uw) - D) / c(u) + b(u) p(w)  if uw was seen, else b(u) p(w)
    b(u)     = D * (words seen after u) / c(u)

The model grows with the corpus, so no task holds it. Texts are cut into blocks
of bounded size. A block sends each distinct word and word pair once to the
shard of its hash, which adds the counts of all blocks and answers every block
in the order it asked in; a hot word costs a shard one entry per block. With the
answers a block has the part of the automaton that its texts can reach, and
walks through it: one step for the next word of all texts at once, from left to
right, each text carrying its state and its sum.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.registry import llm_query, read, settled
from cartloom.llm.words import BLANK_CUT, find_words, mix, pair_hashes, slices

DISCOUNT = 0.75
BLOCK_TOKENS = 1_500_000
SHARD_BYTES = 24 << 20
"""Text bytes for each shard of counts."""
END, BEGIN = mix(np.array([0x454E44, 0x424547], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

# A message goes to the shard or block (kind, target): what it is, where from, how many entries, packed arrays.
MESSAGE = "kind string, target long, what string, origin long, n long, a binary, b binary, c binary, d binary, e binary"
_MESSAGE = pa.schema([("kind", pa.string()), ("target", pa.int64()), ("what", pa.string()), ("origin", pa.int64()), ("n", pa.int64()),
                      *((c, pa.binary()) for c in "abcde")])


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers, first all lowest bytes, then all next ones, as far as the largest needs."""
    x = np.ascontiguousarray(x, dtype=np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    each = x.view(np.uint8).reshape(-1, 8)
    planes = np.empty((width, len(x)), dtype=np.uint8)
    for k in range(width):
        planes[k] = each[:, k]
    return bytes([width]) + planes.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    for k in range(width):
        out[:, k] = planes[k]
    return out.view(np.uint64).reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def _shard_edges(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of sorted hashes begins, and the end."""
    shard = (hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


def _message(kind: str, target: int, what: str, origin: int, n: int, *arrays: bytes) -> tuple:
    return (kind, target, what, origin, n, *arrays, *[None] * (5 - len(arrays)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _MESSAGE.types)], schema=_MESSAGE) if rows \
        else pa.RecordBatch.from_pylist([], schema=_MESSAGE)


def _to_shards(kind: str, what: str, origin: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple]:
    """A message for every shard of the sorted keys."""
    edges = _shard_edges(keys, shards)
    return [_message(kind, s, what, origin, b - a, pack_sorted(keys[a:b]), pack(counts[a:b]))
            for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]


def _words(texts: pa.Array):
    """Hashes of a column's words with END after each text, and where each text ends."""
    found = find_words(texts, BLANK_CUT)
    counts = np.diff(found.first)
    ends = np.cumsum(counts + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    last = np.zeros(len(out), dtype=bool)
    last[ends - 1] = True
    out[~last], out[last] = found.hashes(), END
    return out, ends


def _blocks(batches):
    """(ids, trained, hashes, ends) of about BLOCK_TOKENS words each; whole texts."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for low, high in slices(batch.column(2)):
            part = batch.slice(low, high - low)
            hashes, ends = _words(part.column(2))
            held.append((part.column(0), part.column(1), hashes, ends))
            size += len(hashes)
            if size >= BLOCK_TOKENS:
                yield _together(held)
                held, size = [], 0
    if held:
        yield _together(held)


def _together(held):
    shifts = np.cumsum([0] + [len(h[2]) for h in held[:-1]])
    return (pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]).to_numpy(zero_copy_only=False),
            np.concatenate([h[2] for h in held]), np.concatenate([h[3] + s for h, s in zip(held, shifts)]))


def _weights(trained: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.repeat(trained, np.diff(ends, prepend=0))


def count_words(texts: DataFrame, shards: int) -> tuple[int, int]:
    """Number of training tokens and of distinct ones. texts: doc_id, trained, text."""

    def send(batches):
        for _, trained, hashes, ends in _blocks(batches):
            keys, counts = np.unique(hashes[_weights(trained, ends)], return_counts=True)
            yield _batch(_to_shards("word", "words", 0, keys, counts, shards))

    def add(messages: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([unpack_sorted(a.as_py()) for a in messages.column("a")]))
        tokens = sum(int(unpack(b.as_py()).sum()) for b in messages.column("b"))
        return pa.table({"tokens": pa.array([tokens], pa.int64()), "words": pa.array([len(keys)], pa.int64())})

    sent = texts.mapInArrow(send, MESSAGE).select("target", "a", "b").repartition(shards, "target")
    total = sent.groupBy("target").applyInArrow(add, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    return int(total[0] or 0), int(total[1] or 0)


def _pairs(local: np.ndarray, ends: np.ndarray, words: np.ndarray):
    """Distinct (before, word) numbers of all positions, the hash of each, and the pair of each position.

    Numbers index ``words``; BEGIN has the number len(words).
    """
    before = np.empty(len(local), dtype=np.uint64)
    before[1:] = local[:-1]
    before[np.concatenate([[0], ends[:-1]])] = len(words)
    keys = before << np.uint64(32) | local.astype(np.uint64)
    hashes = np.append(words, BEGIN)
    return keys, hashes


def _key_hashes(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return pair_hashes(hashes[(keys >> np.uint64(32)).astype(np.int64)], hashes[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)])


def _questions(shards: int):
    """Messages of a partition's blocks: its texts as numbers of its words, its words, its word pairs."""

    def send(batches):
        partition = TaskContext.get().partitionId()
        for number, (ids, trained, hashes, ends) in enumerate(_blocks(batches)):
            block = partition << 24 | number
            words, local = np.unique(hashes, return_inverse=True)
            weight = _weights(trained, ends)
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            # Frequent words get small numbers, whose upper bytes are all zero.
            order = np.argsort(-np.bincount(local, minlength=len(words)), kind="stable")
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            yield _batch([_message(
                "text", block, "texts", 0, len(ids), pack(rank[local]), pack(np.concatenate([ends, ids.fill_null(0).to_numpy().view(np.uint64)])),
                pack(np.concatenate([named, trained])), pack_sorted(words), pack(order))])
            del rank, order

            # BEGIN is asked for among the words; training texts are its count.
            counts = np.append(np.bincount(local[weight], minlength=len(words)), trained.sum())
            asked = np.append(words, BEGIN)
            order = np.argsort(asked)
            yield _batch(_to_shards("word", "words", block, asked[order], counts[order], shards))

            keys, named_hashes = _pairs(local, ends, words)
            distinct, inverse = np.unique(keys, return_inverse=True)
            counts = np.bincount(inverse[weight], minlength=len(distinct))
            del keys, inverse
            hashes = _key_hashes(distinct, named_hashes)
            order = np.argsort(hashes)
            for message in _to_shards("pair", "pairs", block, hashes[order], counts[order], shards):
                yield _batch([message])

    return send


def _add_pairs(messages: pa.Table) -> pa.Table:
    """For each block twice its pairs' counts, and one more where the pair is the block's to count:
    of the blocks that have a pair seen in training exactly one is told so."""
    if messages.column("kind")[0].as_py() != "pair":
        return pa.Table.from_batches([_batch([])])
    sent = sorted(messages.to_pylist(), key=lambda m: m["origin"])
    keys, first, where = np.unique(np.concatenate([unpack_sorted(m["a"]) for m in sent]), return_index=True, return_inverse=True)
    totals = np.bincount(where, weights=np.concatenate([unpack(m["b"]) for m in sent]), minlength=len(keys)).astype(np.uint64)
    answer = totals[where] * np.uint64(2)
    answer[first[totals > 0]] += np.uint64(1)
    rows, low = [], 0
    for m in sent:
        rows.append(_message("text", m["origin"], "pairs", m["target"], m["n"], pack(answer[low : low + m["n"]])))
        low += m["n"]
    return pa.Table.from_batches([_batch(rows)])


class _Block:
    """A block's texts and what the shards have answered."""

    def __init__(self, texts: pa.Table, answers: pa.Table):
        block = {k: v[0] for k, v in texts.to_pydict().items()}
        self.number, n = block["target"], block["n"]
        self.local = unpack(block["e"]).astype(np.int64)[unpack(block["a"]).astype(np.int64)]
        self.words, about, both = unpack_sorted(block["d"]), unpack(block["c"]).astype(bool), unpack(block["b"])
        self.ends, self.ids = both[:n].astype(np.int64), both[n:].view(np.int64)
        self.named, self.trained = about[:n], about[n:]
        self.answers = sorted(answers.to_pylist(), key=lambda m: m["origin"])
        # Words in the order of their hashes, BEGIN among them.
        self.asked = np.append(self.words, BEGIN)
        self.order = np.argsort(self.asked)

    def gather(self, what: str, column: str) -> np.ndarray:
        return np.concatenate([unpack(m[column]) for m in self.answers if m["what"] == what])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (before, word) numbers, their counts, and whether the pair is this block's to count."""
        keys, hashes = _pairs(self.local, self.ends, self.words)
        arcs = np.unique(keys)
        answer = np.empty(len(arcs), dtype=np.uint64)
        answer[np.argsort(_key_hashes(arcs, hashes))] = self.gather("pairs", "a")
        return arcs, answer >> np.uint64(1), (answer & np.uint64(1)).astype(bool)


def _has_texts(texts: pa.Table) -> bool:
    return bool(texts.num_rows) and texts.column("kind")[0].as_py() == "text"


def _count_after(shards: int):
    """For the words' shards: how many of the pairs that are this block's to count each word begins."""

    def count(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not _has_texts(texts):
            return pa.Table.from_batches([_batch([])])
        block = _Block(texts, answers)
        arcs, _, mine = block.pairs()
        after = np.bincount((arcs[mine] >> np.uint64(32)).astype(np.int64), minlength=len(block.asked))[block.order]
        some = after > 0
        return pa.Table.from_batches([_batch(_to_shards("word", "after", block.number, block.asked[block.order][some], after[some], shards))])

    return count


def _add_words(asked: pa.Table, after: pa.Table) -> pa.Table:
    """For each block its words' counts and the number of words seen after each."""
    if not asked.num_rows or asked.column("kind")[0].as_py() != "word":
        return pa.Table.from_batches([_batch([])])
    sent, more = asked.to_pylist(), after.to_pylist()
    keys, where = np.unique(np.concatenate([unpack_sorted(m["a"]) for m in sent]), return_inverse=True)
    counts = np.bincount(where, weights=np.concatenate([unpack(m["b"]) for m in sent]), minlength=len(keys)).astype(np.uint64)
    follow = np.zeros(len(keys), dtype=np.uint64)
    for m in more:
        follow[np.searchsorted(keys, unpack_sorted(m["a"]))] += unpack(m["b"])
    rows, low = [], 0
    for m in sent:
        here = where[low : low + m["n"]]
        rows.append(_message("text", m["origin"], "words", m["target"], m["n"], pack(counts[here]), pack(follow[here])))
        low += m["n"]
    return pa.Table.from_batches([_batch(rows)])


RESULT = "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double"


def _walk(arcs, weights, failure, unigram, known, local, ends):
    """Sum of the log-probabilities of each text, one step for one word of every text."""
    begins = np.concatenate([[0], ends[:-1]])
    lengths = ends - begins
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    root, start = len(known) - 1, len(known) - 2
    state = np.full(len(order), start if known[start] else root, dtype=np.int64)
    total = np.zeros(len(order))
    active = len(order)
    for step in range(int(lengths[0]) if len(order) else 0):
        while lengths[active - 1] <= step:
            active -= 1
        word, at = local[begins[:active] + step], state[:active]
        gain = unigram[word]
        if len(arcs):
            key = at.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)
            place = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
            gain = np.where(arcs[place] == key, weights[place], failure[at] + gain)
        total[:active] += gain
        state[:active] = np.where(known[word], word, root)
    out = np.empty(len(order))
    out[order] = total
    return out


def _score(tokens: int, distinct: int, discount: float):
    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not _has_texts(texts):
            return pa.table({k: pa.array([], t) for k, t in zip(
                ("doc_id", "trained", "n_tokens", "n_known", "base_score", "score"),
                (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))})
        block = _Block(texts, answers)
        local, ends = block.local, block.ends
        count, after = np.empty(len(block.asked)), np.empty(len(block.asked))
        count[block.order], after[block.order] = block.gather("words", "a"), block.gather("words", "b")

        unigram = np.log10((count[:-1] + 1) / (tokens + distinct + 1))
        arcs, seen, _ = block.pairs()
        arcs, seen = arcs[seen > 0], seen[seen > 0]
        # The numbers after the words': the begin of a text, then the root. The end of a text leads nowhere.
        known = np.append(after > 0, False)
        failure = np.zeros(len(known))
        with np.errstate(divide="ignore"):
            failure[:-1] = np.where(after > 0, np.log10(discount * after / np.maximum(count, 1)), 0)
        before, word = (arcs >> np.uint64(32)).astype(np.int64), (arcs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        weights = np.log10((seen - discount) / count[before] + 10 ** (failure[before] + unigram[word]))
        total = _walk(arcs, weights, failure, unigram, known, local, ends)
        begins = np.concatenate([[0], ends[:-1]])
        return pa.table({
            "doc_id": pa.array(block.ids, mask=~block.named), "trained": pa.array(block.trained), "n_tokens": pa.array(np.diff(ends, prepend=0)),
            "n_known": pa.array(np.add.reduceat((count[local] > 0).astype(np.int64), begins)),
            "base_score": pa.array(np.add.reduceat(unigram[local], begins)), "score": pa.array(total)})

    return score


def _of_kind(messages: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind. The condition is bound to the partition so that it stays
    above the exchange, and the one exchange of all messages serves every reader."""
    return messages.filter(F.when(F.spark_partition_id() >= 0, F.col("kind") == kind))


def _renamed(messages: DataFrame) -> DataFrame:
    """Keys by other names, for the side of a cogroup that comes from the same messages."""
    return messages.withColumnsRenamed({"kind": "kind_", "target": "target_"})


def language_scores(docs: DataFrame, trained: Column, discount: float = DISCOUNT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score.

    The model is learned from all texts of which ``trained`` holds and scores
    all. Words end at blanks, A-Z lower-cased, and the end of a text is a token;
    null and empty texts are that token alone. ``base_score`` is the sum of
    log10 p(w), ``score`` that of the automaton. Repeated rows count as often as
    they occur. With nothing to learn from, all is unknown: p = 1. An empty
    table gives no rows.
    """
    texts = settled(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(trained, F.lit(False)).alias("trained"),
                                F.coalesce(F.col(text), F.lit("")).alias("text")))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(2, math.ceil(size / SHARD_BYTES))
    tokens, distinct = count_words(texts, shards)

    keys = ["kind", "target"]
    sent = texts.mapInArrow(_questions(shards), MESSAGE).repartition(shards, *keys)
    pairs = _of_kind(sent, "pair").groupBy(*keys).applyInArrow(_add_pairs, MESSAGE).repartition(shards, *keys)
    after = _of_kind(sent, "text").groupBy(*keys).cogroup(_renamed(pairs).groupBy("kind_", "target_")).applyInArrow(_count_after(shards), MESSAGE)
    words = (_of_kind(sent, "word").groupBy(*keys).cogroup(_renamed(after).groupBy("kind_", "target_"))
             .applyInArrow(_add_words, MESSAGE).repartition(shards, *keys))
    answers = _renamed(pairs.unionByName(words)).groupBy("kind_", "target_")
    scored = _of_kind(sent, "text").groupBy(*keys).cogroup(answers).applyInArrow(_score(tokens, distinct, discount), RESULT)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))


def held_out(doc_id: Column) -> Column:
    """The seventh of the documents that is not learned from; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


@llm_query("op1_lm_scores")
def op1_lm_scores(spark, folder):
    """All documents under the model of those that are not held out."""
    docs = read(spark, folder, "documents")
    scored = language_scores(docs, ~held_out(F.col("doc_id")))
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
