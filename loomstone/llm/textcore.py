"""Vectorised word splitting and hashing over Arrow string buffers.

Texts arrive as UTF-8 buffers with offsets. Words are maximal runs of bytes of a class, so no Python string is made for a
word. A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums and passed through a mixer; a
window's hash is a polynomial over the word hashes. All constants are fixed, so every task on every machine agrees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BLOCK = 1 << 18  # bytes hashed at a time: the temporary arrays stay in the cache
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_Q = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits (the splitmix64 output function)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = mix((np.arange(256, dtype=U64) + U64(1)) * U64(_P))
_CODES_LOWER = _CODES[_LOWER]

#: Words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, _BLOCK) + 1
        for name, base in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
            x = np.full(size, base, dtype=U64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["p"], _POWERS["i"]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more entry than texts). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """Words of many texts: byte spans, the index of each text's first word (bounds) and, on request, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED, lower: bool = False):
        self.data, self.offsets, self.codes = data, offsets, _CODES_LOWER if lower else _CODES
        inside = kind[data]
        edge = np.empty(len(data) + 1, dtype=bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        if len(data):
            edge[0], edge[-1] = inside[0], inside[-1]
        else:
            edge[0] = False
        # a text's end also ends a word, and its successor's first byte starts one
        cut = offsets[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        joined = cut[inside[cut - 1] & inside[cut]]
        both = np.flatnonzero(edge)
        if len(joined):
            both = np.sort(np.concatenate([both, joined, joined]))
        self.starts, self.ends = both[0::2], both[1::2]
        self.bounds = np.searchsorted(self.starts, offsets, "left")
        self.counts = np.diff(self.bounds)

    @classmethod
    def of(cls, column, kind: np.ndarray = SPACED, lower: bool = False) -> Words:
        return cls(*buffers(column), kind, lower)

    def __len__(self) -> int:
        return len(self.starts)

    def texts(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), U64)
        i, n = 0, len(out)
        while i < n:
            base = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, base + _BLOCK, "right")))
            span = int(self.ends[j - 1]) - base
            power, inverse = _powers(span)
            total = np.zeros(span + 1, U64)
            np.cumsum(self.codes[self.data[base : base + span]] * power[:span], out=total[1:])
            s, e = self.starts[i:j] - base, self.ends[i:j] - base
            out[i:j] = mix((total[e] - total[s]) * inverse[s])
            i = j
        return out

    def valid(self, n: int) -> np.ndarray:
        """True where n consecutive words of one text start."""
        last = np.repeat(self.bounds[1:], self.counts) - n
        return np.arange(len(self.starts)) <= last

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; as long as h, and meaningless where fewer than n words follow."""
    if len(h) < n:
        return np.zeros(len(h), U64)
    m = len(h) - n + 1
    acc = h[:m].copy()
    for i in range(1, n):
        acc *= U64(_Q)
        acc += h[i : i + m]
    out = np.zeros(len(h), U64)
    out[:m] = mix(acc)
    return out


def covered(starts: np.ndarray, n: int | np.ndarray, size: int) -> np.ndarray:
    """True for each of size words that one of the windows [start, start + n) covers."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + n, size), -1)
    return np.cumsum(step[:size]) > 0


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags over the words of each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch whose texts hold at most that many bytes (one text at least), so that temporary arrays stay small."""
    _, at = buffers(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
