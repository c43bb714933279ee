"""Substring deduplication by fixed-block anchors.

Non-overlapping blocks of half a window are the index; every rolling window of a block's size probes it. A repeated window of
twice the block size holds a whole reference block, so its copy has a probe that hits. Hits are extended to the windows around
them and those to maximal exact repeats; a repeat keeps its first place only.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .exchange import answered, bits, cut, keys, pack_bits
from .textcore import U64, Words, covered, mix, per_text, windows

_SENT = "bucket int, chunk int, n int, state boolean, hashes binary, marks binary"
_BACK = "chunk int, bucket int, state boolean, answer binary"


def _rows(schema: list[tuple], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.table({name: pa.array(col, kind) for (name, kind), col in zip(schema, cols, strict=True)})


_SENT_PA = [("bucket", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("state", pa.bool_()), ("hashes", pa.binary()), ("marks", pa.binary())]
_BACK_PA = [("chunk", pa.int32()), ("bucket", pa.int32()), ("state", pa.bool_()), ("answer", pa.binary())]


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of hashes, sorted; where each occurs first, and for each place the number of its pair."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return x[new], y[new], order[new], place


class _Chunk:
    """Words and hashes of one chunk, the same in each pass: rows by key, nulls last, then by a hash of the text."""

    def __init__(self, table: pa.Table, window: int):
        self.table, self.window, self.block = table.sort_by([("key", "ascending"), ("th", "ascending")]), window, (window + 1) // 2
        self.words = Words.of(self.table["text"])
        self.h = self.words.hashes()

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rolling block-sized windows: where, their hashes, and which are reference blocks."""
        at = np.flatnonzero(self.words.valid(self.block))
        first = np.repeat(self.words.bounds[:-1], self.words.counts)[at]
        return at, windows(self.h, self.block)[at], (at - first) % self.block == 0

    def whole(self, start: np.ndarray) -> tuple:
        """The distinct windows that start there, by two independent hashes of 64 bits."""
        return _distinct(windows(self.h, self.window)[start], windows(mix(self.h ^ U64(0x6A09E667F3BCC909)), self.window)[start])

    def full(self, near: np.ndarray) -> np.ndarray:
        """Starts of whole windows that hold a hit."""
        total = np.concatenate([[0], np.cumsum(near, dtype=np.int64), np.full(self.window, near.sum())])
        n = len(near)
        inside = total[np.arange(n) + self.window - self.block + 1] > total[:n]
        return np.flatnonzero(inside & self.words.valid(self.window))


def _probe(window: int, n: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window)
        _, hashes, reference = chunk.probes()
        u, count = np.unique(hashes, return_counts=True)
        indexed = np.zeros(len(u), bool)
        indexed[np.searchsorted(u, hashes[reference])] = True
        low, number = (u & U64(0xFFFFFFFF)).astype(np.uint32), table["chunk"][0].as_py()
        return _rows(_SENT_PA, [(b, number, j - i, False, low[i:j].tobytes(), pack_bits(indexed[i:j]) + pack_bits(count[i:j] > 1)) for b, i, j in cut(u, n)])

    return run


def _hits(table: pa.Table) -> pa.Table:
    """Of one bucket: which sent hashes are a reference block's and occur twice or more in the corpus."""
    sizes, marks = table["n"].to_pylist(), table["marks"].to_pylist()
    low = np.concatenate([np.frombuffer(x, np.uint32) for x in table["hashes"].to_pylist()])
    indexed = np.concatenate([bits(m[: -(-s // 8)], s) for m, s in zip(marks, sizes, strict=True)])
    many = np.concatenate([bits(m[-(-s // 8) :], s) for m, s in zip(marks, sizes, strict=True)])
    order = np.argsort(low, kind="stable")
    new = np.flatnonzero(np.diff(low[order].astype(np.int64), prepend=-1))
    hit = (np.add.reduceat(1 + many[order], new) > 1) & np.logical_or.reduceat(indexed[order], new)
    out = np.empty(len(low), bool)
    out[order] = np.repeat(hit, np.diff([*new, len(low)]))
    ends = np.cumsum(sizes)
    rows = [(c, b, False, pack_bits(out[e - s : e])) for c, b, s, e in zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(), sizes, ends, strict=True) if out[e - s : e].any()]
    return _rows(_BACK_PA, rows)


def _extend(window: int, n: int):
    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        if not len(table) or not len(back):
            return _rows(_SENT_PA, [])
        chunk, number = _Chunk(table, window), table["chunk"][0].as_py()
        at, hashes, _ = chunk.probes()
        u, place = np.unique(hashes, return_inverse=True)
        near = np.zeros(len(chunk.h), bool)
        near[at] = answered(u, n, dict(zip(back["bucket"].to_pylist(), back["answer"].to_pylist(), strict=True)))[place]
        start = chunk.full(near)
        u, second, first, _ = chunk.whole(start)
        text = np.searchsorted(chunk.words.bounds, start[first], "right") - 1
        owner, th = keys(chunk.table)[text], (chunk.table["th"].to_numpy()[text] >> 32).astype(np.int32)
        state = np.zeros(len(near), bool)
        state[start] = True
        rows = [(b, number, j - i, False, u[i:j].tobytes(), second[i:j].tobytes() + owner[i:j].tobytes() + th[i:j].tobytes()) for b, i, j in cut(u, n)]
        return _rows(_SENT_PA, [*rows, (number % n, number, len(state), True, pack_bits(state), None)] if len(start) else [])

    return run


def _firsts(table: pa.Table) -> pa.Table:
    """Of one bucket: which chunk's first place of a window is the first of all. A chunk's own state passes through."""
    rows = table.to_pylist()
    out = [(r["chunk"], r["bucket"], True, r["hashes"]) for r in rows if r["state"]]
    if rows := [r for r in rows if not r["state"]]:
        column = lambda kind, lo, hi: np.concatenate([np.frombuffer(r["marks"][lo * r["n"] : hi * r["n"]], kind) for r in rows])
        hashes, second = np.concatenate([np.frombuffer(r["hashes"], U64) for r in rows]), column(U64, 0, 8)
        order = np.lexsort((column(np.int32, 16, 20), column(np.int64, 8, 16), second, hashes))
        x, y = hashes[order], second[order]
        first = np.zeros(len(hashes), bool)
        first[order[np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])]] = True
        ends = np.cumsum([r["n"] for r in rows])
        out += [(r["chunk"], r["bucket"], False, pack_bits(first[e - r["n"] : e])) for r, e in zip(rows, ends, strict=True)]
    return _rows(_BACK_PA, out)


def _remove(window: int, n: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window)
        words, gone = chunk.words, np.zeros(len(chunk.h), bool)
        if len(back):
            state = back.filter(back["state"])["answer"][0].as_py()
            start = np.flatnonzero(bits(state, len(gone)))
            u, _, first, place = chunk.whole(start)
            plain = back.filter(pa.compute.invert(back["state"]))
            mine = answered(u, n, dict(zip(plain["bucket"].to_pylist(), plain["answer"].to_pylist(), strict=True)))
            keep = np.zeros(len(start), bool)
            keep[first[mine]] = True
            gone = covered(start[~keep], window, len(gone))
        removed, texts, spans = per_text(gone, words.bounds), [], []
        for k, text in enumerate(chunk.table["text"].cast(pa.large_binary()).to_pylist()):
            lo, hi, kept = words.bounds[k], words.bounds[k + 1], (text or b"").split()
            on = np.flatnonzero(np.diff(gone[lo:hi].astype(np.int8), prepend=0, append=0)) if removed[k] else []
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(on[::2], on[1::2], strict=True)])
            texts.append(b" ".join(compress(kept, ~gone[lo:hi]) if removed[k] else kept))
        return pa.table({"key": chunk.table["key"], "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, span), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())})

    return run


def anchor_dedup(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text", chunk_bytes: int = tables.CHUNK_BYTES) -> DataFrame:
    """One row for each document: key, n_words, n_removed, spans (runs of removed words), kept_text.

    Words are `[^\\x20\\x09-\\x0D]+`. A word goes if a window of `window` consecutive words covers it whose sequence also starts
    earlier: at a smaller key, or earlier in the same document. Windows are judged on the input. kept_text joins the other words by
    one space. Blocks of half a window are enough: any window holds a whole reference block wherever it lies.

    A probe is sent as 32 bits and its bucket: that stage only selects windows, so a false hit there changes nothing. Surviving
    windows are compared by two hashes of 64 bits each: among 10**13 different ones the chance that any two meet is below 10**-12.

    Keys must be integers. A null key orders last. Rows that share a key, null or not, are dealt over chunks by key and text and
    ordered by a hash of the text; repeats of a whole row follow each other in one chunk. A null text has no words, a text of any
    length is one row of its chunk. Ties: of equal windows in one document the earlier start is first. An empty table gives no
    row. Other columns are never read.
    """
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    n = tables.chunks_for(rows, chunk_bytes=chunk_bytes)
    rows = tables.with_chunk(rows.withColumn("th", F.xxhash64("text")), n, "key", "th")
    dealt = rows.groupBy("chunk")
    hits = dealt.applyInArrow(_probe(window, n), _SENT).groupBy("bucket").applyInArrow(_hits, _BACK)
    firsts = dealt.cogroup(hits.groupBy("chunk")).applyInArrow(_extend(window, n), _SENT).groupBy("bucket").applyInArrow(_firsts, _BACK)
    schema = "key bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_text string"
    return dealt.cogroup(firsts.groupBy("chunk")).applyInArrow(_remove(window, n), schema).withColumnRenamed("key", key)
