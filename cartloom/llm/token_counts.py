"""Tokens of whole documents under a unigram vocabulary, by dynamic programming over a trie.

A pre-token is a word between blanks, with a blank mark in front if a space (or
nothing) precedes it; every other blank is a token of its own. A pre-token's
tokens are its best segmentation into vocabulary pieces. The distinct
pre-tokens of a batch are put in order, which is a depth-first walk of their
trie: forward scores of a common prefix are computed once and kept on a stack,
and the number of tokens at each word's end is what is stored.

The pieces are those of a public vocabulary; its file gives ranks, and a piece
of rank r has the log-probability -log(r + 1) of Zipf's law. A character without
a piece falls back to its UTF-8 bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.registry import llm_query, read
from cartloom.llm.words import BLANK_CUT, Words, column_bytes, find_words, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHED = 500_000
"""Pre-tokens whose counts a task remembers; a full store is emptied and filled anew."""


class Vocabulary:
    """Pieces with log-probabilities, its size bound by the vocabulary file."""

    def __init__(self, pieces: list[str]):
        """pieces in the order of their ranks."""
        self.scores = {p: -math.log(rank + 1) for rank, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.byte = -2 * math.log(len(pieces) + 1)


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return Vocabulary([model.id_to_piece(i) for i in ordinary])


def trie_counts(pretokens: list[str], vocabulary: Vocabulary) -> dict[str, int]:
    """Tokens of the best segmentation of each pre-token; of equal scores the one of fewer tokens."""
    scores, longest, byte = vocabulary.scores, vocabulary.longest, vocabulary.byte
    out: dict[str, int] = {}
    best, tokens = [0.0], [0]
    before = ""
    for word in sorted(pretokens):
        shared, limit = 0, min(len(before), len(word))
        while shared < limit and word[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top, count = best[end - 1] + byte * size, tokens[end - 1] + size
            for begin in range(max(0, end - longest), end):
                score = scores.get(word[begin:end])
                if score is not None:
                    score += best[begin]
                    if score > top or (score == top and tokens[begin] + 1 < count):
                        top, count = score, tokens[begin] + 1
            best.append(top)
            tokens.append(count)
        out[word] = tokens[-1]
        before = word
    return out


def _after_space(found: Words, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word follows a space of its text, and whether it begins its text."""
    first = np.repeat(offsets[:-1], np.diff(found.first)) == found.starts
    space = found.data[np.maximum(found.starts - 1, 0)] == 0x20
    return space & ~first, first


def token_counts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """All rows and columns of docs with n_pretokens and n_tokens, replacing columns of these names.

    Null and empty texts have none. A text of blanks has one token for each
    blank. Equal texts have equal counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source = docs.drop("n_pretokens", "n_tokens").withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    names = [c for c in source.columns if c != "_text"]

    def count(batches):
        vocabulary = shared.value
        known: dict[int, int] = {}
        for batch in batches:
            texts = batch.column("_text")
            n_words, n_tokens = [], []
            for low, high in slices(texts):
                part = texts.slice(low, high - low)
                found = find_words(part, BLANK_CUT)
                sizes = np.diff(found.first)
                _, offsets = column_bytes(part)
                space, first = _after_space(found, offsets)
                marked = space | first
                keys = found.hashes(lower=False) * np.uint64(2) + marked.astype(np.uint64)
                distinct, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
                if len(known) + len(distinct) > CACHED:
                    known.clear()
                named = {}
                for key, i in zip(distinct.tolist(), at.tolist()):
                    if key not in known:
                        word = found.data[found.starts[i] : found.ends[i]].tobytes().decode("utf-8", "surrogateescape")
                        named[key] = (MARK if marked[i] else "") + word
                counted = trie_counts(list(set(named.values())), vocabulary)
                known.update((key, counted[word]) for key, word in named.items())
                per_word = np.array([known[key] for key in distinct.tolist()], dtype=np.int64)[inverse] if len(distinct) else np.empty(0, dtype=np.int64)
                sums = np.concatenate([[0], np.cumsum(per_word)])
                taken = np.concatenate([[0], np.cumsum(found.ends - found.starts + space)])
                blanks = np.diff(offsets) - (taken[found.first[1:]] - taken[found.first[:-1]])
                n_words.extend(sizes.tolist())
                n_tokens.extend((sums[found.first[1:]] - sums[found.first[:-1]] + blanks).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                                             names=[*names, "n_pretokens", "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names)
    return source.mapInArrow(count, f"{schema}, n_pretokens long, n_tokens long")


@llm_query("op5_token_counts")
def op5_token_counts(spark, folder):
    """Tokens of every document under the public 32k vocabulary."""
    return token_counts(read(spark, folder, "documents").select("doc_id", "text"), load_vocabulary()).select("doc_id", "n_pretokens", "n_tokens")
