"""Shard of a document: Murmur3 (x86, 32 bits, seed 0) of its id, floor-mod the number of shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_M = 0xFFFFFFFF


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """Signed 32-bit hash."""
    h, n = seed, len(data) & ~3
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & _M
    for i in range(0, n, 4):
        k = rot(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & _M, 15) * 0x1B873593 & _M
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & _M
    if tail := data[n:]:
        h ^= rot(int.from_bytes(tail, "little") * 0xCC9E2D51 & _M, 15) * 0x1B873593 & _M
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & _M
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & _M
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def shard_of(doc_id: str, shards: int) -> int:
    return murmur3_32(doc_id.encode()) % shards


def _murmur3_many(ids: pd.Series) -> np.ndarray:
    """All ids of a batch at once: ids of equal length form a matrix, hashed column by column."""
    raw = [("" if v is None else v).encode() for v in ids]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    out = np.empty(len(raw), np.uint32)
    mul = lambda x, c: x * np.uint32(c)
    rot = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        body = b"".join(raw[i].ljust(-(-n // 4) * 4, b"\0") for i in rows)
        words = np.frombuffer(body, "<u4").reshape(len(rows), -(-n // 4)).astype(np.uint32)
        h = np.zeros(len(rows), np.uint32)
        for j in range(words.shape[1]):
            k = mul(rot(mul(words[:, j], 0xCC9E2D51), 15), 0x1B873593)
            h = h ^ k
            if 4 * (j + 1) <= n:
                h = mul(rot(h, 13), 5) + np.uint32(0xE6546B64)
        h = h ^ np.uint32(n)
        h = mul(h ^ (h >> np.uint32(16)), 0x85EBCA6B)
        h = mul(h ^ (h >> np.uint32(13)), 0xC2B2AE35)
        out[rows] = h ^ (h >> np.uint32(16))
    return out.view(np.int32)


def murmur3(doc_id: Column) -> Column:
    @F.pandas_udf("int")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series(_murmur3_many(ids))

    return run(doc_id)


def shard(doc_id: Column, shards: int) -> Column:
    if shards == 1:
        return F.lit(0)
    return F.pmod(murmur3(doc_id), F.lit(shards)).cast("int")
