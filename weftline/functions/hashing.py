"""Hashes that Catalyst lacks, as Arrow UDFs over batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_POLY = 0x82F63B78


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (_POLY if byte & 1 else 0)
        table.append(byte)
    return table


_CRC = _crc_table()
_MASK = 0xA282EAD8


_CRC_NP = np.array(_CRC, np.uint32)
#: Bytes of the stretches whose CRCs are computed side by side, and what such a stretch of zeros makes of each byte of a CRC.
_STRETCH = 128


def _after_zeros() -> np.ndarray:
    crc = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).copy()
    for _ in range(_STRETCH):
        crc = _CRC_NP[crc & 0xFF] ^ crc >> 8
    return crc


_AFTER = [row.tolist() for row in _after_zeros()]


def crc32c(data: bytes, crc: int = 0) -> int:
    """The Castagnoli CRC of some bytes; of many bytes, stretches are taken side by side and then joined."""
    crc ^= 0xFFFFFFFF
    whole = len(data) // _STRETCH
    if whole >= 8:
        rows = np.frombuffer(data, np.uint8, whole * _STRETCH).reshape(whole, _STRETCH).T
        each = np.zeros(whole, np.uint32)
        for row in np.ascontiguousarray(rows):
            each = _CRC_NP[(each ^ row) & 0xFF] ^ each >> 8
        a, b, c, d = _AFTER
        for own in each.tolist():
            crc = a[crc & 0xFF] ^ b[crc >> 8 & 0xFF] ^ c[crc >> 16 & 0xFF] ^ d[crc >> 24] ^ own
        data = data[whole * _STRETCH :]
    for b in data:
        crc = _CRC[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    """A CRC turned and shifted, so that CRCs stored beside their data don't disturb CRCs over both."""
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def unmasked(value: int) -> int:
    turned = (value - _MASK) & 0xFFFFFFFF
    return (turned >> 17 | turned << 15) & 0xFFFFFFFF


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """Murmur 3 of 32 bits, unsigned."""
    h, n = seed, len(data)
    whole = n - n % 4
    for at in range(0, whole, 4):
        k = int.from_bytes(data[at : at + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h ^= k
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        h = h * 5 + 0xE6546B64 & 0xFFFFFFFF
    if n > whole:
        k = int.from_bytes(data[whole:], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
    h ^= n
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint32(by) | x >> np.uint32(32 - by)


def murmur3_many(values: list[bytes], seed: int = 0) -> np.ndarray:
    """Murmur 3 of each value; values of one length are hashed side by side."""
    out = np.zeros(len(values), np.uint32)
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    for n in np.unique(lengths):
        at, n = np.flatnonzero(lengths == n), int(n)
        if n < 4096 and len(at) > 1:
            data = np.frombuffer(b"".join(values[i].ljust(-(-n // 4) * 4, b"\0") for i in at), "<u4").reshape(len(at), -(-n // 4))
            h = np.full(len(at), seed, np.uint32)
            for j in range(data.shape[1]):
                k = _rotated(data[:, j] * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
                h = h ^ k
                if (j + 1) * 4 <= n:
                    h = _rotated(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
            h = h ^ np.uint32(n)
            h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
            h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
            out[at] = h ^ h >> np.uint32(16)
        else:
            out[at] = [murmur3_32(values[i], seed) for i in at]
    return out


def hash_shard(key: Column, shards: int) -> Column:
    """The shard of a key's bytes: its Murmur hash without the sign, by equal ranges of the hash, not by remainder."""
    width = 0x7FFFFFFF // shards + 1

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        found = murmur3_many([b"" if b is None else bytes(b) for b in keys]) & np.uint32(0x7FFFFFFF)
        return pd.Series((found // np.uint32(width)).astype(np.int64), dtype="Int32").where(keys.notna().to_numpy())

    return shard(key.cast("binary"))


def crc32c_column(data: Column) -> Column:
    @F.pandas_udf("long")
    def crc(values: pd.Series) -> pd.Series:
        return pd.Series(np.array([crc32c(bytes(b)) if b is not None else 0 for b in values], np.int64), dtype="Int64").where(values.notna().to_numpy())

    return crc(data.cast("binary"))
