"""CRC-32 of many words at once, and of words put together.

Small numpy helpers for work inside Spark's Python tasks, and the same code as
DuckDB SQL for the queries' oracles.
"""

from __future__ import annotations

import zlib

import numpy as np

from cartloom.llm.words import LOWER, Words

POLYNOMIAL = 0xEDB88320
SHORT = 48
"""Words of more bytes are taken one at a time."""
MASK = np.uint32(0xFF)


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (table & np.uint32(1)) * np.uint32(POLYNOMIAL)
    return table


_BYTE = _byte_table()
_zeros: list[np.ndarray] = []


def _zero_table(k: int) -> np.ndarray:
    """What 2^k zero bytes make of each of a register's four bytes."""
    while len(_zeros) <= k:
        places = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
        if _zeros:
            made = _through(_through(places, _zeros[-1]), _zeros[-1])
        else:
            made = _BYTE[places & MASK] ^ (places >> np.uint32(8))
        _zeros.append(made)
    return _zeros[k]


def _through(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[0][x & MASK]
    for byte in range(1, 4):
        out = out ^ table[byte][(x >> np.uint32(8 * byte)) & MASK]
    return out


def followed(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of one string after another, from the CRC of each and the second one's bytes."""
    out = first.astype(np.uint32)
    for k in range(int(length.max()).bit_length() if len(length) else 0):
        some = np.flatnonzero((length >> k) & 1)
        out[some] = _through(out[some], _zero_table(k))
    return out ^ second


def word_crcs(words: Words) -> np.ndarray:
    """Unsigned CRC-32 of every word's bytes, A-Z lower-cased."""
    lengths = words.ends - words.starts
    out = np.empty(len(lengths), dtype=np.uint32)
    for i in np.flatnonzero(lengths > SHORT):
        out[i] = zlib.crc32(LOWER[words.data[words.starts[i] : words.ends[i]]].tobytes())
    order = np.argsort(np.minimum(lengths, SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    order = order[int((lengths > SHORT).sum()) :]
    starts, lengths = words.starts[order], lengths[order]
    state, active = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32), len(order)
    for step in range(int(lengths[0]) if len(order) else 0):
        while lengths[active - 1] <= step:
            active = int(np.searchsorted(-lengths, -step, side="left"))
        now = state[:active]
        state[:active] = _BYTE[(now ^ LOWER[words.data[starts[:active] + step]]) & MASK] ^ (now >> np.uint32(8))
    out[order] = ~state
    return out


def crc_sql(string: str) -> str:
    """CRC-32 of a VARCHAR's UTF-8 bytes as DuckDB SQL: bit by bit, a byte joining at every eighth step."""
    zeros = ", ".join(["0::UBIGINT"] * 7)
    byte = f"('0x' || substr(hex(encode({string})), CAST(2 * i + 1 AS BIGINT), 2))::UBIGINT"
    bits = f"flatten(list_transform(range(0, octet_length(encode({string}))), lambda i: [{byte}, {zeros}]))"
    step = f"lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * {POLYNOMIAL}::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {bits}), {step}), 4294967295::UBIGINT)"
