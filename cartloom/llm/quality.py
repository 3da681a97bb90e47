"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model.

The model is learned from all texts of the learning half of the trusted
documents. Trigrams are counted, shorter n-grams counted by the distinct words
before them, and each context has its total and how many n-grams of counts 1, 2
and more it has; counts of counts give the discounts. The counts are one Spark
table in shards of n-gram hashes, a row holding a shard's sorted hashes and
their counts as packed arrays.
Texts are cut into blocks; a block asks the shards for its distinct n-grams,
which are joined with the counts there, and sums the log-probabilities of each
of its texts from the answers. This is done for one part of the rows after
another, so that the disk holds one part's questions and answers at a time. A
document passes if its perplexity is within a quantile of that of its language's
trusted documents, those held back from learning.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.registry import discard, fresh, llm_query, read, settled, shuffles_freed, written
from cartloom.llm.scoring import MESSAGE, _batch, _message, _of_kind, _renamed, _shard_edges, pack, pack_sorted, unpack, unpack_sorted
from cartloom.llm.words import BLANK_CUT, find_words, mix, pair_hashes, slices
from cartloom.runtime import scratch_folder

QUANTILE = 0.995
ACCURACY = 20_000
BLOCK_TOKENS = 1_000_000
SHARD_BYTES = 16 << 20
"""Text bytes for each shard of counts when texts are scored."""
LEARNED_BYTES = 2 << 20
"""Learned text bytes for each shard of the model."""
ROUNDS = 7
"""Parts at most that the rows are scored in; a part's questions and answers are on disk at a time, and a copy of the model."""
ROUND_BYTES = 16 << 20
"""Text bytes, about, of a part of a small table."""
FILTER_BITS = 27
"""At most 2^FILTER_BITS bits tell blocks which n-grams the model cannot have, or rows which ids a join cannot find; a fuller filter lets more through, and answers stay the same."""
SEGMENT_KEYS = 1 << 20
"""Keys, about, that a task holds when it makes a segment of that filter."""
POOL = "\0pool"
"""Stands for the language of the model of all trusted texts."""
END, BEGIN = mix(np.array([0x656E64, 0x626567696E], dtype=np.uint64))
_COUNTS = ["n", "total", "m1", "m2", "m3"]


def _language_seed(name: str) -> np.uint64:
    out = np.uint64(len(name) + 1)
    for byte in name.encode():
        out = mix(np.array([out + np.uint64(byte)]) * np.uint64(0x9E3779B97F4A7C15))[0]
    return out


def _seeds(langs: list) -> np.ndarray:
    seeds = {name: _language_seed(name or "") for name in set(langs)}
    return np.array([seeds[name] for name in langs], dtype=np.uint64)


def _words(texts: pa.Array, langs: list) -> tuple[np.ndarray, np.ndarray]:
    """Every word and text end, told apart by language, and where each text ends."""
    found = find_words(texts, BLANK_CUT)
    ends = np.cumsum(np.diff(found.first) + 1)
    w = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    last = np.zeros(len(w), dtype=bool)
    last[ends - 1] = True
    w[~last], w[last] = found.hashes(), END
    return mix(w ^ np.repeat(_seeds(langs), np.diff(ends, prepend=0))), ends


def _before(w: np.ndarray, ends: np.ndarray, langs: list) -> tuple[np.ndarray, np.ndarray]:
    """The two words before each; BEGIN stands twice before a text."""
    begin, first = mix(_seeds(langs) ^ BEGIN), np.concatenate([[0], ends[:-1]])
    v, u = np.empty_like(w), np.empty_like(w)
    v[1:] = w[:-1]
    v[first] = begin
    u[1:] = v[:-1]
    u[first] = begin
    return u, v


def _pack_parts(parts: list[np.ndarray]) -> bytes:
    """Sorted arrays after one another."""
    packed = [pack_sorted(x) for x in parts]
    return np.array([len(x) for x in packed], dtype=np.int64).tobytes() + b"".join(packed)


def _unpack_parts(raw: bytes, parts: int) -> np.ndarray:
    at = 8 * parts + np.concatenate([[0], np.cumsum(np.frombuffer(raw, dtype=np.int64, count=parts))])
    return np.concatenate([unpack_sorted(raw[i:j]) for i, j in zip(at[:-1], at[1:])])


def _text_message(block: int, rows: pa.Table, w: np.ndarray, ends: np.ndarray) -> tuple:
    """A block's texts as numbers of its words, beside its rows."""
    words, local, counts = np.unique(w, return_inverse=True, return_counts=True)
    place = np.empty(len(words), dtype=np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(words))
    # Frequent words get small numbers, whose upper bytes are all zero; words of numbers as long are sorted.
    tier = (place >= 1 << 8).astype(np.int8) + (place >= 1 << 16)
    order = np.argsort(tier, kind="stable")
    number = np.empty(len(words), dtype=np.int64)
    number[order] = np.arange(len(words))
    words = words[order]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return _message("text", block, "texts", 0, len(ends), pack(number[local]), pack(np.diff(ends, prepend=0)),
                    _pack_parts([words[: 1 << 8], words[1 << 8 : 1 << 16], words[1 << 16 :]]), sink.getvalue().to_pybytes())


def _text_of(texts: pa.Table) -> tuple[int, pa.Table, np.ndarray, np.ndarray]:
    """Number, rows, words and text ends of a block."""
    block = {k: v[0] for k, v in texts.to_pydict().items()}
    w = _unpack_parts(block["c"], 3)[unpack(block["a"]).astype(np.int64)]
    return block["target"], pa.ipc.open_stream(block["d"]).read_all(), w, np.cumsum(unpack(block["b"]).astype(np.int64))


def _is_of(messages: pa.Table, kind: str) -> bool:
    return bool(messages.num_rows) and messages.column("kind")[0].as_py() == kind


def _none() -> pa.Table:
    return pa.Table.from_batches([_batch([])])


def _to_shards(kind: str, what: str | None, origin: int, keys: np.ndarray, values: np.ndarray, shards: int) -> list[tuple]:
    """A message for every shard of the sorted keys; values has a column for each."""
    edges = _shard_edges(keys, shards)
    return [_message(kind, s, what, origin, b - a, pack_sorted(keys[a:b]), pack(values[:, a:b].ravel()))
            for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]


def _new(ordered: np.ndarray) -> np.ndarray:
    """Whether each of sorted keys differs from the one before."""
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return new


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys. np.unique without counts or places would hash them, which takes many times as long as a sort."""
    ordered = np.sort(keys)
    return ordered[_new(ordered)]


def _one_of_each(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and where one of each is; np.unique would find the first, by a slower sort."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = _new(ordered)
    return ordered[new], order[new]


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sum of each row of values for each, and which of them each key is."""
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.array([np.bincount(where, weights=x, minlength=len(distinct)) for x in values]).astype(np.uint64), where


def _power_of_two(n: float) -> int:
    """At least n; so each of some shards is a part of one, or is cut into whole ones, of as many as another power."""
    return 1 << max(1, math.ceil(math.log2(max(n, 2))))


def _values(message: dict) -> np.ndarray:
    return unpack(message["b"]).reshape(-1, message["n"])


def _added(messages: pa.Table):
    """Messages to a shard by origin, their keys, their values, and the same of the distinct keys, with which of these each is."""
    sent = sorted(messages.to_pylist(), key=lambda m: m["origin"])
    keys, values = np.concatenate([unpack_sorted(m["a"]) for m in sent]), np.concatenate([_values(m) for m in sent], axis=1)
    return sent, values, *_sums(keys, values)


def _owners(messages: pa.Table) -> pa.Table:
    """For each block twice the sum of the first value of its keys, and one more where the key is the block's to count:
    of the blocks that give a key more than 0 exactly one is told so."""
    if not messages.num_rows or messages.column("kind")[0].as_py() == "text":
        return _none()
    sent, values, _, sums, where = _added(messages)
    answer = sums[0][where] * np.uint64(2)
    given = np.flatnonzero(values[0])
    _, first = np.unique(where[given], return_index=True)
    answer[given[first]] += np.uint64(1)
    edges = np.cumsum([0] + [m["n"] for m in sent])
    return pa.Table.from_batches([_batch([_message("text", m["origin"], m["kind"], m["target"], m["n"], pack(answer[a:b]))
                                          for m, a, b in zip(sent, edges[:-1], edges[1:])])])


def _said(answers: list[dict], what: str) -> tuple[np.ndarray, np.ndarray]:
    """What the shards say of each key that a block sent, in the order of the keys: whether it is the block's, and the sum."""
    sent = sorted((m for m in answers if m["what"] == what), key=lambda m: m["origin"])
    said = np.concatenate([unpack(m["a"]) for m in sent]) if sent else np.empty(0, dtype=np.uint64)
    return (said & np.uint64(1)).astype(bool), said >> np.uint64(1)


def _of_context(n: np.ndarray) -> np.ndarray:
    """What an n-gram of count n adds to its context, with _COUNTS as rows."""
    return np.array([np.zeros(len(n), dtype=np.uint64), n, n == 1, n == 2, n >= 3], dtype=np.uint64)


def _of_ending(n: np.ndarray) -> np.ndarray:
    """What an n-gram adds to the one without its first word."""
    return np.array([np.ones(len(n)), *[np.zeros(len(n))] * 4]).astype(np.uint64)


def _learned(shards: int):
    """A message of each block's texts, and one to every shard of its distinct trigrams and their counts."""

    def send(batches):
        partition = TaskContext.get().partitionId()
        for number, (rows, w, ends) in enumerate(_parts(batches)):
            block = partition << 24 | number
            yield _batch([_text_message(block, rows, w, ends)])
            u, v = _before(w, ends, rows.column(0).to_pylist())
            keys, counts = np.unique(pair_hashes(u, pair_hashes(v, w)), return_counts=True)
            for message in _to_shards("tri", "tri", block, keys, counts[None], shards):
                yield _batch([message])

    return send


def _own_trigrams(texts: pa.Table, answers: list[dict]):
    """Number of a block, and of the trigrams that are its to count: words u, v, w, hashes of uv and vw, counts, languages."""
    block, rows, w, ends = _text_of(texts)
    langs = rows.column(0).to_pylist()
    u, v = _before(w, ends, langs)
    _, first = _one_of_each(pair_hashes(u, pair_hashes(v, w)))
    own, n = _said(answers, "tri")
    at, names = first[own], list(dict.fromkeys(langs))
    lang = np.repeat(np.array([names.index(x) for x in langs], dtype=np.int64), np.diff(ends, prepend=0))[at]
    u, v, w = u[at], v[at], w[at]
    return block, v, w, pair_hashes(u, v), pair_hashes(v, w), n[own], lang, names


def _ask_pairs(shards: int):
    """To every shard what the block's own trigrams add to the pairs within them."""

    def ask(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not _is_of(texts, "text"):
            return _none()
        block, _, _, uv, vw, n, *_ = _own_trigrams(texts, answers.to_pylist())
        keys, values, _ = _sums(np.concatenate([vw, uv]), np.concatenate([_of_ending(n), _of_context(n)], axis=1))
        return pa.Table.from_batches([_batch(_to_shards("pair", "pair", block, keys, values, shards))])

    return ask


def _ask_words(shards: int):
    """To every shard what the block's own pairs add to the words within them, told apart by language."""

    def ask(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not _is_of(texts, "text"):
            return _none()
        sent = answers.to_pylist()
        block, v, w, uv, vw, _, lang, names = _own_trigrams(texts, sent)
        keys = _distinct(np.concatenate([vw, uv]))
        own, n = _said(sent, "pair")
        pairs, first = _one_of_each(vw)
        at = np.searchsorted(keys, pairs)
        first, n = first[own[at]], n[at][own[at]]
        rows = []
        for k, name in enumerate(names):
            here, some = first[lang[first] == k], n[lang[first] == k]
            words, values, _ = _sums(np.concatenate([w[here], v[here]]), np.concatenate([_of_ending(some), _of_context(some)], axis=1))
            rows += _to_shards("word", name, block, words, values, shards)
        return pa.Table.from_batches([_batch(rows)])

    return ask


def _model_rows(messages: pa.Table) -> pa.Table:
    """A shard's n-grams with their counts, how many have the counts 1 to 4, and the words of each language and their counts."""
    if not messages.num_rows or messages.column("kind")[0].as_py() == "text":
        return _none()
    sent, _, keys, sums, _ = _added(messages)
    kind, shard = sent[0]["kind"], sent[0]["target"]
    rows = [_message("model", shard, kind, 0, len(keys), pack_sorted(keys), pack(sums.ravel()))]
    rows += [_message("stat", shard, f"{kind}{k}", 0, int((sums[0] == k).sum())) for k in range(1, 5)]
    if kind == "word":
        for name in dict.fromkeys(m["what"] for m in sent):
            at = np.searchsorted(keys, _distinct(np.concatenate([unpack_sorted(m["a"]) for m in sent if m["what"] == name])))
            n = sums[0][at]
            rows.append(_message("lang", shard, name, int(n.sum()), int((n > 0).sum())))
    return pa.Table.from_batches([_batch(rows)])


def discounts(counts: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of the counts 1, 2 and more, from the numbers of n-grams of counts 1 to 4."""
    n1, n2, n3, n4 = counts
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    # Small or odd tables can give figures outside what a count allows.
    return [min(max(d, 0.1), k - 0.1) for k, d in enumerate(raw, 1)]


class Model(NamedTuple):
    """table: messages of kind "model", each with n sorted n-gram hashes of a shard and their counts; rows: of all of them;
    discounts of trigrams and pairs; for each language what a word's count is divided by and what every word has besides."""

    path: str
    shards: int
    table: DataFrame
    rows: int
    discounts3: list[float]
    discounts2: list[float]
    languages: dict[str, tuple[float, float]]


def fit(trusted: DataFrame) -> Model:
    """The model of all trusted texts (lang, text).

    A block sends each distinct trigram once to its shard, which answers with the
    count and whether it is the block's to count. The pairs within a block's own
    trigrams go to their shards with what these add to them, and in the same way
    the words within its own pairs. Only the table of counts is left in the
    shared folder.
    """
    spark = trusted.sparkSession
    step = scratch_folder(spark)
    with shuffles_freed(spark):
        texts = settled(trusted.select("text", "lang"), step)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = _power_of_two(size / LEARNED_BYTES)

    keys, other = ["kind", "target"], ["kind_", "target_"]
    sent = texts.mapInArrow(_learned(shards), MESSAGE).repartition(shards, *keys)
    own = _of_kind(sent, "text").groupBy(*keys)
    trigrams = _of_kind(sent, "tri").groupBy(*keys)
    said = trigrams.applyInArrow(_owners, MESSAGE).repartition(shards, *keys)
    sent2 = own.cogroup(_renamed(said).groupBy(*other)).applyInArrow(_ask_pairs(shards), MESSAGE).repartition(shards, *keys)
    pairs = sent2.groupBy(*keys)
    both = said.unionByName(pairs.applyInArrow(_owners, MESSAGE).repartition(shards, *keys))
    sent3 = own.cogroup(_renamed(both).groupBy(*other)).applyInArrow(_ask_words(shards), MESSAGE).repartition(shards, *keys)
    with shuffles_freed(spark):
        path = scratch_folder(spark)
        table = written(reduce(DataFrame.unionByName, [x.applyInArrow(_model_rows, MESSAGE) for x in (trigrams, pairs, sent3.groupBy(*keys))]), path)
    discard(spark, [step])

    about = {(r.kind, r.what): r for r in table.groupBy("kind", "what").agg(F.sum("origin").alias("total"), F.sum("n").alias("n")).collect()}
    seen = lambda kind: [about["stat", f"{kind}{k}"].n if about else 0 for k in range(1, 5)]
    languages = {what: (float(r.total), 0.5 * r.n / r.total / (r.n + 1)) for (kind, what), r in about.items() if kind == "lang"}
    return Model(path, shards, table.filter("kind = 'model'"), sum(r.n for (kind, _), r in about.items() if kind == "model"), discounts(seen("tri")), discounts(seen("pair")), languages)


def _bits(rows: int) -> int:
    return min(FILTER_BITS, max(16, math.ceil(math.log2(16 * rows + 1))))


def _marks(keys: np.ndarray, bits: int) -> tuple[int, bytes]:
    """Bytes of the map from the one of the smallest key on that have a bit for the top bits of every key."""
    at = (keys >> np.uint64(64 - bits)).astype(np.int64)
    low, high = int(at.min()) >> 3, int(at.max()) >> 3
    marked = np.zeros((high + 1 - low) << 3, dtype=bool)
    marked[at - (low << 3)] = True
    return low, np.packbits(marked).tobytes()


def _gathered(marks: DataFrame, bits: int) -> np.ndarray:
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in marks.toLocalIterator(prefetchPartitions=True):
        out[r.low : r.low + len(r.marks)] |= np.frombuffer(r.marks, dtype=np.uint8)
    return out


def _bit_map(model: Model) -> np.ndarray:
    """A bit for the top bits of every key of the model."""
    bits = _bits(model.rows)

    def mark(batches):
        for batch in batches:
            for raw in batch.column(0):
                low, marks = _marks(unpack_sorted(raw.as_py()), bits)
                yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([marks], pa.binary())], names=["low", "marks"])

    return _gathered(model.table.select("a").mapInArrow(mark, "low long, marks binary"), bits)


def _id_map(ids: DataFrame) -> np.ndarray:
    """The same for hashes of ids (key); a task makes a segment of the map from about SEGMENT_KEYS keys."""
    rows = ids.count()
    bits = _bits(rows)
    segments = min(bits - 3, max(3, math.ceil(math.log2(rows / SEGMENT_KEYS + 1))))

    def mark(table: pa.Table) -> pa.Table:
        low, marks = _marks(table.column("key").to_numpy().view(np.uint64), bits)
        return pa.table({"low": pa.array([low], pa.int64()), "marks": pa.array([marks], pa.binary())})

    segment = F.shiftrightunsigned("key", 64 - segments).cast("int").alias("segment")
    return _gathered(ids.select("key", segment).groupBy("segment").applyInArrow(mark, "low long, marks binary"), bits)


def _marked(keys: np.ndarray, bit_map: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - (len(bit_map).bit_length() + 2))
    return (bit_map[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0


def _key(doc_id: Column, kind) -> Column:
    return F.xxhash64(doc_id.cast(kind))


def _may_be_of(docs: DataFrame, ids: DataFrame) -> Column:
    """Whether a document's id can be one of the ids; of a few others it says so too.

    Where texts are joined with many ids, only those of such rows are moved then.
    """
    kind = docs.schema["doc_id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast(_id_map(ids.select(_key(F.col("doc_id"), kind).alias("key"))))

    @F.arrow_udf("boolean")
    def may(keys: pa.Array) -> pa.Array:
        return pa.array(_marked(keys.to_numpy(zero_copy_only=False).view(np.uint64), shared.value))

    return F.col("doc_id").isNotNull() & may(_key(F.col("doc_id"), kind))


def _parts(batches):
    """Rows of about BLOCK_TOKENS words each without their text, with their words and where each text ends; whole texts.

    Text and language are the last two columns, whatever they are called.
    """
    held, size = [], 0
    for batch in batches:
        texts = batch.num_columns - 2
        for low, high in slices(batch.column(texts)):
            part = batch.slice(low, high - low)
            w, ends = _words(part.column(texts), part.column(texts + 1).to_pylist())
            held.append((part.select([*range(texts), texts + 1]), w, ends))
            size += len(w)
            if size >= BLOCK_TOKENS:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    shifts = np.cumsum([0] + [len(h[1]) for h in held[:-1]])
    rows = pa.Table.from_batches([h[0] for h in held]).combine_chunks()
    return rows, np.concatenate([h[1] for h in held]), np.concatenate([h[2] + s for h, s in zip(held, shifts)])


def _keys(w: np.ndarray, ends: np.ndarray, langs: list, bit_map: np.ndarray) -> list[np.ndarray]:
    """For each position the hashes of w, v, vw, uv and uvw, 0 for those that the model cannot have.

    An n-gram is only in the model if all within it are; w may have 0 for words that are not.
    """

    def known(keys: np.ndarray) -> np.ndarray:
        return np.where(_marked(keys, bit_map), keys, np.uint64(0))

    u, v = _before(w, ends, langs)
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    begin = v[first]
    w_key = np.where(w == 0, np.uint64(0), known(w))
    v_key, vw_key, uv_key, uvw_key = (np.zeros_like(w) for _ in range(4))
    v_key[1:], v_key[first] = w_key[:-1], known(begin)
    some = np.flatnonzero((v_key != 0) & (w_key != 0))
    vw_key[some] = known(pair_hashes(v[some], w[some]))
    uv_key[1:], uv_key[first] = vw_key[:-1], known(pair_hashes(begin, begin))
    some = np.flatnonzero((vw_key != 0) & (uv_key != 0))
    uvw_key[some] = known(pair_hashes(u[some], vw_key[some]))
    return [w_key, v_key, vw_key, uv_key, uvw_key]


def _sought(keys: list[np.ndarray], first: np.ndarray) -> list[np.ndarray]:
    """The keys that a block asks for, 0 for none. Those of v and uv are the w and vw before, but where a text begins."""
    w, v, vw, uv, uvw = keys
    return [w, v[first], vw, uv[first], uvw]


def _questions(shards: int, shared):
    """A message of each block's texts as numbers of its words, and one to every shard of n-grams asked for."""

    def send(batches):
        partition = TaskContext.get().partitionId()
        for number, (rows, w, ends) in enumerate(_parts(batches)):
            block = partition << 24 | number
            keys = _keys(w, ends, rows.column(rows.num_columns - 1).to_pylist(), shared.value)
            yield _batch([_text_message(block, rows, keys[0], ends)])
            first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            asked = _distinct(np.concatenate([k[k != 0] for k in _sought(keys, first)]))
            del keys
            edges = _shard_edges(asked, shards)
            for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if b > a:
                    yield _batch([_message("gram", s, "grams", block, b - a, pack_sorted(asked[a:b]))])

    return send


def _dealt(model: Model, shards: int) -> DataFrame:
    """The model's n-grams as messages to the shards that are asked for them."""

    def cut(batches):
        for batch in batches:
            for m in batch.to_pylist():
                yield _batch(_to_shards("gram", m["what"], m["target"], unpack_sorted(m["a"]), _values(m), shards))

    if shards > model.shards:
        return model.table.mapInArrow(cut, MESSAGE)
    # A shard has the n-grams of several of the model's.
    return model.table.withColumns({"kind": F.lit("gram"), "target": F.floor(F.col("target") / (model.shards // shards)).cast("long")})


def _answer(messages: pa.Table, counts: pa.Table) -> pa.Table:
    """For each block the counts of the n-grams that it asked for, 0 where there are none."""
    if not _is_of(messages, "gram"):
        return _none()
    grams = counts.rename_columns([c.rstrip("_") for c in counts.column_names]).to_pylist()
    keys = np.concatenate([np.empty(0, dtype=np.uint64), *(unpack_sorted(m["a"]) for m in grams)])
    values = np.zeros((len(_COUNTS), len(keys) + 1), dtype=np.uint64)
    low = 0
    for m in grams:
        of = _values(m)
        values[: len(of), low : low + m["n"]] = of
        low += m["n"]
    order = np.argsort(keys)
    keys = keys[order]
    order = np.append(order, len(keys))
    rows = []
    for m in messages.to_pylist():
        asked = unpack_sorted(m["a"])
        at = np.searchsorted(keys, asked)
        at[at < len(keys)] = np.where(keys[at[at < len(keys)]] == asked[at < len(keys)], at[at < len(keys)], len(keys))
        rows.append(_message("text", m["origin"], "grams", m["target"], m["n"], *(pack(v) for v in values[:, order[at]])))
    return pa.Table.from_batches([_batch(rows)])


def _score(model: dict, shared, names: list[str], types: pa.Schema):
    """log10 of each whole text's probability, and its number of words with the end, beside its row."""

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not _is_of(texts, "text"):
            return types.empty_table()
        _, rows, w, ends = _text_of(texts)
        sizes = np.diff(ends, prepend=0)
        first = ends - sizes
        langs = rows.column(rows.num_columns - 1).to_pylist()
        sought = _sought(_keys(w, ends, langs, shared.value), first)
        del w
        sent = sorted(answers.to_pylist(), key=lambda m: m["origin"])
        # A last row of zeros stands for what is not asked for.
        table = {c: np.append(np.concatenate([unpack(m[x]) for m in sent]) if sent else [], 0).astype(np.float64) for c, x in zip(_COUNTS, "abcde")}

        # Where the answer to each key is: the distinct keys were asked for in their order.
        flat = np.concatenate(sought)
        some = np.flatnonzero(flat)
        places = np.full(len(flat), -1)
        places[some] = np.unique(flat[some], return_inverse=True)[1]
        w_at, v_first, vw_at, uv_first, uvw_at = np.split(places, np.cumsum([len(k) for k in sought])[:-1])
        del flat, some, sought

        def before(at: np.ndarray, of_first: np.ndarray) -> np.ndarray:
            out = np.roll(at, 1)
            out[first] = of_first
            return out

        v_at, uv_at = before(w_at, v_first), before(vw_at, uv_first)

        def longer(p: np.ndarray, gram: np.ndarray, context: np.ndarray, d: list[float]) -> np.ndarray:
            n, total = table["n"], table["total"][context]
            held = sum(x * table[m] for x, m in zip(d, ("m1", "m2", "m3")))[context]
            own = (n - np.array([0, *d])[np.minimum(n, 3).astype(np.int64)])[gram]
            return np.where(total > 0, (own + held * p) / np.maximum(total, 1), p)

        each = np.array([model["languages"].get(x, (1.0, 1.0)) for x in langs])
        total, floor = (np.repeat(each[:, k], sizes) for k in (0, 1))
        p = np.maximum(table["n"][w_at] - 0.5, 0) / total + floor
        p = longer(longer(p, vw_at, v_at, model["d2"]), uvw_at, uv_at, model["d3"])
        values = 10 ** (-np.add.reduceat(np.log10(p), first) / sizes)
        unknown = np.array([x not in model["languages"] for x in langs])
        columns = {c: rows.column(c) for c in names} | {"n_tokens": pa.array(sizes), "perplexity": pa.array(values, mask=unknown)}
        return pa.table(columns).cast(types)

    return score


def perplexities(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """All rows of docs with its columns, or those of ``keep``, n_tokens and perplexity, replacing columns of these names.

    The perplexity is null where the language is null or was not learned. Null
    and empty texts are the end of a text alone.
    """
    spark = docs.sparkSession
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "perplexity")]
    own_text, own_lang = fresh(docs.columns, "text"), fresh(docs.columns, "lang")
    source = settled(docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias(own_text), F.col(lang).cast("string").alias(own_lang)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names), "n_tokens long", "perplexity double"])
    size = source.agg(F.sum(F.octet_length(own_text).cast("long"))).first()[0] or 0
    shards = _power_of_two(size / SHARD_BYTES)
    shared = spark.sparkContext.broadcast(_bit_map(model))
    types = _arrow_schema(source, names)
    plain = {"languages": model.languages, "d2": model.discounts2, "d3": model.discounts3}
    keys, other = ["kind", "target"], ["kind_", "target_"]

    def scored(part: DataFrame) -> DataFrame:
        sent = part.mapInArrow(_questions(shards, shared), MESSAGE).repartition(shards, *keys)
        counts = _renamed(_dealt(model, shards)).repartition(shards, *other).groupBy(*other)
        answers = _of_kind(sent, "gram").groupBy(*keys).cogroup(counts).applyInArrow(_answer, MESSAGE).repartition(shards, *keys)
        return _of_kind(sent, "text").groupBy(*keys).cogroup(_renamed(answers).groupBy(*other)).applyInArrow(_score(plain, shared, names, types), schema)

    rounds = min(ROUNDS, math.ceil(size / ROUND_BYTES))
    if rounds <= 1:
        return scored(source)
    number = fresh(source.columns, "part")
    parts = source.withColumn(number, F.monotonically_increasing_id() % rounds)
    paths = [scratch_folder(spark) for _ in range(rounds)]
    with shuffles_freed(spark):
        done = [written(scored(parts.filter(F.col(number) == k).drop(number)), path) for k, path in enumerate(paths)]
    return spark.read.schema(done[0].schema).parquet(*paths)


def _arrow_schema(source: DataFrame, names: list[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    own = to_arrow_schema(source.select(*names).schema)
    return pa.schema([*own, pa.field("n_tokens", pa.int64()), pa.field("perplexity", pa.float64())])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic; an id with any other label too is not trusted."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).filter("good").select("doc_id")


def learns(doc_id: Column) -> Column:
    """The half of the trusted documents that models are learned from; thresholds come from the other."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(2)) == 0


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per document: doc_id, lang, n_tokens, perplexity, threshold, kept.

    ``threshold`` is the quantile of the perplexities of all the language's
    trusted documents of the half that nothing is learned from. Documents of
    null language, or of one without learned text or without a threshold, are
    scored under the model of all trusted texts together and held against the
    quantile of all such trusted documents under it. Only where no trusted
    document is left for a model or a threshold, all is kept.
    Repeated rows each get a row; an empty table gives none.
    """
    trusted = written(trusted_ids(labels))
    back, learned = trusted.filter(~learns(F.col("doc_id"))), trusted.filter(learns(F.col("doc_id")))
    texts = docs.filter("lang IS NOT NULL AND octet_length(text) > 0").filter(_may_be_of(docs, learned))
    learning = texts.join(learned, "doc_id", "left_semi")
    model = fit(learning.select(F.col("lang").cast("string").alias("lang"), "text"))
    source = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    scored = settled(perplexities(source, model, keep=["doc_id", "lang"]))
    discard(docs.sparkSession, [model.path])
    threshold = F.percentile_approx("perplexity", F.lit(quantile), F.lit(ACCURACY)).alias("threshold")
    limits = written(scored.join(back, "doc_id", "left_semi").filter("perplexity IS NOT NULL").groupBy("lang").agg(threshold))
    columns = ["doc_id", "lang", "n_tokens", "perplexity", "threshold"]
    judged = scored.join(limits, "lang").select(*columns)
    rest = scored.join(limits, "lang", "left_anti")
    if not rest.isEmpty():
        if model.languages:
            pooled = fit(learning.select(F.lit(POOL).alias("lang"), "text"))
            flags = (source.withColumn("_may", _may_be_of(docs, back)).join(limits.select("lang", F.lit(True).alias("_own")), "lang", "left")
                     .filter("_own IS NULL OR _may").withColumn("_pool", F.lit(POOL)))
            both = perplexities(flags, pooled, lang="_pool", keep=["doc_id", "lang", "_own"])
            both = written(both.join(back.withColumn("_back", F.lit(True)), "doc_id", "left").filter("_own IS NULL OR _back"))
            limit = both.filter("_back").agg(threshold).first()[0]
            rest = both.filter("_own IS NULL").withColumn("threshold", F.lit(limit).cast("double"))
        else:
            rest = rest.withColumn("threshold", F.lit(None).cast("double"))
        judged = judged.unionByName(rest.select(*columns))
    return judged.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


@llm_query("op6_quality")
def op6_quality(spark, folder):
    """Every document's perplexity and whether it passes."""
    return classify(read(spark, folder, "documents"), read(spark, folder, "labels"))
