"""Hash exchange between chunks of documents and buckets of hashes.

A chunk sends each bucket one row with all its distinct hashes of that bucket's range, so a value that fills a third of the
corpus arrives once per chunk; the bucket's answer goes back in the order of what was sent. Chunks and buckets follow the
input's size, so neither a chunk's nor a bucket's task grows with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textcore import U64

MAX_ID = np.iinfo(np.int64).max


def cut(u: np.ndarray, n: int):
    """(bucket, from, to) of sorted hashes: a bucket holds an equal range of the upper 32 bits."""
    bucket = ((u >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(edge, [*edge[1:], len(u)] if len(u) else [], strict=True):
        yield int(bucket[lo]), int(lo), int(hi)


def keys(table: pa.Table) -> np.ndarray:
    """Integer keys for ordering; null orders last."""
    return table["key"].fill_null(MAX_ID).to_numpy().astype(np.int64)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def answered(u: np.ndarray, n_buckets: int, replies: dict[int, bytes], width: int = 0) -> np.ndarray:
    """The answers to sorted hashes: bits, or numbers of width bytes; zero where a bucket sent none."""
    out = np.zeros(len(u), bool if not width else np.uint8)
    for bucket, lo, hi in cut(u, n_buckets):
        if bucket in replies:
            out[lo:hi] = bits(replies[bucket], hi - lo) if not width else np.frombuffer(replies[bucket], np.uint8)
    return out
