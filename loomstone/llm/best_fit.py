"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .textcore import U64, Words, buffers, slices

#: Pieces packed together by one task; each shard wastes at most about one sequence.
SHARD_PIECES = 50_000
#: Distinct strings whose ids a worker keeps, and distinct parts of them; when full, either starts again.
CACHE, PARTS = 3_000_000, 300_000
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters that composition leaves alone and whose lower case does not depend on their neighbours.
_PLAIN = regex.compile(r"[\x21-\x7E¡-įı-ſ]+")
#: Bytes that are no blank. Other white space stays inside a string; the tokenizer drops it.
_FULL = np.ones(256, dtype=bool)
_FULL[[0x20, 0x09, 0x0A, 0x0D]] = False


class Encoder:
    """Ids of many texts at once. The tokenizer drops white space and never joins across it, so a text's ids are those of its
    blank-free strings in order: each distinct string of a batch is looked up by its hash, and encoded by the tokenizer once.

    Strings of common characters go part by part to the tokenizer's model; all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = [b for b in range(256) if b not in plain]
        self.table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(spare)}
        self.parts: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        none = np.empty(0, np.int64)
        self.old, self.young = (np.empty(0, U64), none, none), (np.empty(0, U64), none, none)
        self.pool = np.empty(1 << 20, np.uint32)
        self.used = 0

    def word(self, word: str) -> list[int]:
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        out: list[int] = []
        for p in _PRE.findall(word.lower()):
            ids = self.parts.get(p)
            if ids is None:
                if len(self.parts) >= PARTS:
                    self.parts.clear()
                ids = self.parts[p] = [t.id for t in self.model.tokenize(p if p.isascii() else "".join(map(self.table.__getitem__, p.encode())))]
            out += ids
        return out

    def _find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each hash are in the pool, how many, and which hashes are new."""
        at, size, new = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64), np.ones(len(u), bool)
        for keys, start, n in (self.old, self.young):
            if len(keys):
                i = np.searchsorted(keys, u)
                i[i == len(keys)] = 0
                hit = keys[i] == u
                at[hit], size[hit], new[hit] = start[i[hit]], n[i[hit]], False
        return at, size, new

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        exact = b"<|" in data.tobytes()  # special tokens are told apart by case
        words = Words(data, offsets, _FULL, lower=not exact)
        u, place = np.unique(words.hashes() ^ U64(exact), return_inverse=True)
        if len(self.old[0]) + len(self.young[0]) > CACHE:
            self.clear()
        at, size, new = self._find(u)
        if new.any():
            example = np.empty(len(u), np.int64)
            example[place] = np.arange(len(place))
            found = [self.word(words.word(i).decode()) for i in example[new]]
            size[new] = [len(x) for x in found]
            at[new] = self.used + np.cumsum(size[new]) - size[new]
            more = int(size[new].sum())
            while self.used + more > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            self.pool[self.used : self.used + more] = [i for x in found for i in x]
            self.used += more
            self.young = _merged(self.young, (u[new], at[new], size[new]))
            if len(self.young[0]) > len(self.old[0]) // 4:
                self.old, self.young = _merged(self.old, self.young), tuple(x[:0] for x in self.young)
        n = size[place]
        total = np.concatenate([[0], np.cumsum(n)])
        flat = self.pool[np.repeat(at[place] - total[:-1], n) + np.arange(total[-1])]
        return flat, total[words.bounds]


def _merged(a: tuple, b: tuple) -> tuple:
    order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
    return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))


_ENCODERS: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        if path not in _ENCODERS:  # kept while the worker lives
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        tail = np.asarray([end], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, at = encoder.ids(*buffers(part["text"]))
                raw = memoryview(ids.astype("<u4").tobytes())
                own, cols = [], [[] for _ in range(4)]
                for k in range(len(part)):
                    text = bytes(raw[4 * at[k] : 4 * at[k + 1]]) + tail
                    for i, start in enumerate(range(0, len(text), 4 * capacity)):
                        piece = text[start : start + 4 * capacity]
                        own.append(k)
                        for col, x in zip(cols, (i, start // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([part["key"].take(pa.array(own, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["key", "piece", "start", "length", "ids_crc32"])

    return run


def tokenised(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: key, piece, start, length, ids_crc32; the end id closes each document."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_pieces(path, capacity, end), f"key {rows.schema['key'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. Greedy best fit, longest first; then a bin's smallest piece gives way to two that fit tighter.

    Works on counts by length, so equal lengths cost nothing extra: a bin takes a few look-ups of the largest length that fits.
    """
    order = np.argsort(-lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1).tolist()
    at = np.searchsorted(-lengths[order], -np.arange(capacity + 1), "left")  # where a length's pieces begin in order
    there = sum(1 << x for x in range(capacity + 1) if count[x])  # bit x: pieces of length x are left
    upto = [(2 << x) - 1 for x in range(capacity + 1)]

    def below(x: int) -> int:
        """The largest length at or below x with pieces left, or 0."""
        return max(0, (there & upto[x]).bit_length() - 1)

    def take(x: int) -> None:
        nonlocal there
        count[x] -= 1
        there ^= (count[x] == 0) << x

    def two(room: int, over: int) -> tuple[int, int] | None:
        """The pair of remaining lengths with the largest sum in (over, room]."""
        best, a = None, below(room - 1)
        while 2 * a > over:
            b = below(min(room - a, a))
            if b == a and count[a] < 2:
                b = below(a - 1)
            if b and a + b > over:
                over, best = a + b, (a, b)
                if over == room:
                    break
            a = below(a - 1)
        return best

    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n = 0
    while there:
        took, gap = [], capacity
        while x := below(gap):
            took.append(x)
            take(x)
            gap -= x
        while gap and there:  # the smallest gives way to two that leave less room
            small = took[-1]
            pair = two(gap + small, small)
            if pair is None:
                break
            took.pop()
            for x in pair:
                took.append(x)
                take(x)
            count[small] += 1
            there |= 1 << small
            took.sort(reverse=True)
            gap -= sum(pair) - small
        place = 0
        for x in took:
            i = order[at[x]]
            at[x] += 1
            bin_of[i], offset[i] = n, place
            place += x
        n += 1
    return bin_of, offset


def _packer(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("key", "ascending"), ("piece", "ascending")])
        bins, at = pack(table["length"].to_numpy().astype(np.int64), capacity)
        shard = table["shard"].to_numpy().astype(np.int64)
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array((shard << 40) + bins)).append_column("offset", pa.array(at))

    return run


def best_fit(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of over capacity ids are cut, into pieces of capacity ids; the last may be shorter. A full piece is a sequence
    of its own. The others are dealt by hash into shards of about SHARD_PIECES and each shard is packed by one task, so a task's
    memory does not grow with the corpus and each shard costs at most about one sequence more than packing all at once.

    A null or empty text is the end id alone. Null keys are kept. Repeated rows are packed each. An empty table gives no row.
    Other columns are never read.
    """
    pieces = tables.written(tokenised(docs, path, capacity, end, key, text), "pieces")
    n = max(1, -(-pieces.count() // SHARD_PIECES))
    shard = F.pmod(F.xxhash64("key", "piece", "start", "ids_crc32"), F.lit(n)).cast("int")
    kind = pieces.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    packed = pieces.where(F.col("length") < capacity).withColumn("shard", shard).groupBy("shard").applyInArrow(_packer(capacity), schema)
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
    return packed.unionByName(full).withColumnRenamed("key", key)
