"""BLAKE3 and CRC-32C, which Spark lacks, for files in the binary log format: from the public BLAKE3 paper and the Castagnoli polynomial.

Native tables use sha2 instead, which Spark computes itself.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The initial words, which are SHA-256's, and the permutation of the message words between rounds.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_CHUNK, _BLOCK, _MASK = 1024, 64, 0xFFFFFFFF
#: Columns and diagonals that a round mixes.
_MIXED = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _turn(x: int, by: int) -> int:
    return (x >> by | x << 32 - by) & _MASK


def _compress(chain, words, counter: int, size: int, flags: int) -> list[int]:
    v = [*chain, *_IV[:4], counter & _MASK, counter >> 32, size, flags]
    for step in range(7):
        for i, (a, b, c, d) in enumerate(_MIXED):
            for word, right, left in ((words[2 * i], 16, 12), (words[2 * i + 1], 8, 7)):
                v[a] = (v[a] + v[b] + word) & _MASK
                v[d] = _turn(v[d] ^ v[a], right)
                v[c] = (v[c] + v[d]) & _MASK
                v[b] = _turn(v[b] ^ v[c], left)
        if step < 6:
            words = [words[k] for k in _ORDER]
    return [x ^ y for x, y in zip(v[:8], v[8:], strict=True)] + [x ^ y for x, y in zip(v[8:], chain, strict=True)]


def _node(data: bytes, first: int) -> tuple:
    """The last compression's input of the subtree over data, whose first chunk has number first."""
    if len(data) <= _CHUNK:
        blocks = [data[i : i + _BLOCK] for i in range(0, len(data), _BLOCK)] or [b""]
        chain = _IV
        for i, block in enumerate(blocks):
            flags = _CHUNK_START * (i == 0) | _CHUNK_END * (i == len(blocks) - 1)
            given = chain, struct.unpack("<16I", block.ljust(_BLOCK, b"\0")), first, len(block), flags
            if i < len(blocks) - 1:
                chain = _compress(*given)[:8]
        return given
    left = _CHUNK << ((len(data) - 1) // _CHUNK).bit_length() - 1
    pair = _compress(*_node(data[:left], first))[:8] + _compress(*_node(data[left:], first + left // _CHUNK))[:8]
    return _IV, pair, 0, _BLOCK, _PARENT


def blake3(data: bytes) -> bytes:
    """The 32-byte BLAKE3 digest."""
    chain, words, counter, size, flags = _node(data, 0)
    return struct.pack("<8I", *_compress(chain, words, counter, size, flags | _ROOT)[:8])


def _crc_table() -> list[int]:
    table = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0x82F63B78 if x & 1 else 0)
        table.append(x)
    return table


_CRC = _crc_table()


def crc32c(data: bytes) -> int:
    crc = _MASK
    for b in data:
        crc = crc >> 8 ^ _CRC[(crc ^ b) & 255]
    return crc ^ _MASK


def crc32c_rows(rows: list[bytes]) -> np.ndarray:
    """CRC-32C of byte strings of one length, all advanced together."""
    table, data = np.array(_CRC, np.uint32), np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    crc = np.full(len(rows), _MASK, np.uint32)
    for column in data.T:
        crc = crc >> np.uint32(8) ^ table[(crc ^ column) & np.uint32(255)]
    return crc ^ np.uint32(_MASK)


@F.pandas_udf(T.BinaryType())
def blake3_column(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else blake3(bytes(x)))


@F.pandas_udf(T.LongType())
def crc32c_column(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else crc32c(bytes(x))).astype("Int64")
