"""Benchmark decontamination: a broadcast hash set of normalised test n-grams scans every document's token windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from . import tables
from .textcore import _LOWER, ALNUM, Words, covered, per_text, slices, windows

#: Benchmark text in one broadcast; its index takes about four times that. A larger benchmark is dealt into parts of this size.
PART_BYTES = 32 << 20
#: Words of a piece: longer items are dealt by pieces that overlap, so that one item is no larger than a part.
PIECE = 100_000
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _same(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words from i in a are those from j in b, all their bytes. Each side has starts, sizes and bytes of its words."""
    ok = np.ones(len(i), bool)
    for k in range(m):
        live = np.flatnonzero(ok)
        x, y = i[live] + k, j[live] + k
        ok[live] = a[1][x] == b[1][y]
        keep = ok[live]
        live, x, y = live[keep], x[keep], y[keep]
        size = b[1][y]
        differ = _LOWER[a[2][_ranges(a[0][x], size)]] != b[2][_ranges(b[0][y], size)]
        ok[live] = np.diff(np.concatenate([[0], np.cumsum(differ)])[np.concatenate([[0], np.cumsum(size)])]) == 0
    return ok


class Index:
    """Distinct windows of benchmark items by length: sorted hashes, for each the place of its words in one buffer, and its items."""

    def __init__(self, items: list[tuple], n: int):
        self.names = np.array([str(i) for i, _ in items], object)
        words = Words.of(pa.array([t or "" for _, t in items], pa.large_string()), ALNUM, lower=True)
        h, sizes = words.hashes(), (words.ends - words.starts).astype(np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32) if len(sizes) else sizes
        self.side = starts, sizes, _LOWER[words.data[_ranges(words.starts, sizes)]]
        own, self.by_length = np.minimum(words.counts, n), {}
        for m in sorted(set(own[own > 0].tolist())):
            at = np.flatnonzero(words.valid(m) & np.repeat(own == m, words.counts)).astype(np.int32)
            w = windows(h, m)[at]
            order = np.argsort(w, kind="stable")
            w, at = w[order], at[order]
            run = np.cumsum(np.concatenate([[True], w[1:] != w[:-1]])) - 1
            first = at[np.flatnonzero(np.diff(run, prepend=-1))]
            kind, more = run.copy(), {}
            for i in np.flatnonzero(~_same(self.side, at, self.side, first[run], m)):  # other words of the same hash
                kind[i] = more.setdefault((run[i], self._words(at[i], m)), run[-1] + 1 + len(more))
            kinds, where = np.unique(kind, return_index=True)
            kinds = kinds[np.argsort(w[where], kind="stable")]
            where = where[np.argsort(w[where], kind="stable")]
            place = np.empty(len(kinds), np.int64)
            place[kinds] = np.arange(len(kinds))
            pairs = np.unique((place[kind] << 32) + np.searchsorted(words.bounds, at, "right") - 1)
            bounds = np.searchsorted(pairs >> 32, np.arange(len(kinds) + 1))
            self.by_length[m] = w[where], at[where], bounds.astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)

    def _words(self, at: int, m: int) -> tuple:
        starts, sizes, data = self.side
        return tuple(data[starts[k] : starts[k] + sizes[k]].tobytes() for k in range(at, at + m))

    def scan(self, words: Words) -> tuple[np.ndarray, list[set]]:
        """Which words lie in an occurrence, and each text's items. Hash hits are verified byte by byte."""
        h, hit, items = words.hashes(), np.zeros(len(words), bool), [set() for _ in words.counts]
        side = words.starts, words.ends - words.starts, words.data
        for m, (known, first, bounds, owners) in self.by_length.items():
            w = windows(h, m)
            low = np.searchsorted(known, w)
            at = np.flatnonzero((known[np.minimum(low, len(known) - 1)] == w) & words.valid(m))
            count = np.searchsorted(known, w[at], "right") - low[at]
            at, kind = np.repeat(at, count), _ranges(low[at], count)
            true = _same(side, at, self.side, first[kind], m)
            at, kind = at[true], kind[true]
            hit |= covered(at, m, len(words))
            for k, one in zip(*np.unique(np.stack([np.searchsorted(words.bounds, at, "right") - 1, kind]), axis=1), strict=True):
                items[k] |= set(self.names[owners[bounds[one] : bounds[one + 1]]])
        return hit, items


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each of many ranges, one after the other."""
    size = np.asarray(size, np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(np.asarray(start, np.int64) - (ends - size), size)


def _spans(words: Words, hit: np.ndarray, k: int) -> list[dict]:
    """Byte ranges of text k, from the first to the last word of each run of hit words."""
    lo, hi, base = words.bounds[k], words.bounds[k + 1], words.offsets[k]
    on = np.flatnonzero(np.diff(np.concatenate([[0], hit[lo:hi].astype(np.int8), [0]])))
    return [{"start": int(words.starts[lo + a] - base), "end": int(words.ends[lo + b - 1] - base)} for a, b in zip(on[::2], on[1::2], strict=True)]


def _without(text: pa.Scalar, spans: list[dict]) -> str:
    raw, at, out = text.as_py().encode(), 0, b""
    for s in spans:
        out, at = out + raw[at : s["start"]], s["end"]
    return (out + raw[at:]).decode()


def _pieces(n: int, most: int):
    """Items of over `most` words cut into pieces that overlap by n - 1 words: they hold the same windows."""

    def run(batches):
        for batch in batches:
            names, texts = [], []
            for name, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = Words.of(pa.array([text or ""], pa.large_string()), ALNUM)
                for i in range(0, max(1, len(words) - n + 1), most):
                    last = min(len(words), i + most + n - 1) - 1
                    names.append(name)
                    texts.append(words.data[words.starts[i] : words.ends[last]].tobytes().decode() if len(words) else "")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["item", "text"])

    return run


def _parts(benchmark: DataFrame, n: int, item: str, text: str) -> list[DataFrame]:
    """The benchmark as pieces (item, text), in parts that fit a broadcast."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text}`").alias("text"))
    rows = rows.mapInArrow(_pieces(n, PIECE), "item string, text string")
    k = max(1, -(-tables.text_bytes(rows) // PART_BYTES))
    if k == 1:
        return [rows]
    rows = tables.written(rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(k))), "benchmark")
    return [rows.where(F.col("part") == i).drop("part") for i in range(k)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", carry: bool = False) -> DataFrame:
    """One row for each document: key, n_words, n_hit, n_items, items (sorted strings), spans (byte ranges of hit runs).

    A window is n consecutive words of an item; an item of fewer words, but not none, is one window. Words are
    `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. The hash set goes out by broadcast: documents are read once
    while the benchmark holds at most PART_BYTES of text; beyond that it is dealt into parts of about that size, and the
    documents are scanned once for each, with the result so far written in between. Hash hits are verified byte by byte, so the
    result is exact. The scan has no shuffle: a document's work depends on its own words only, so no key can be hot.

    Nulls: a null text (either side) has no words; a null item id is listed as "null"; a null key is kept. Empty tables give no
    row, or no hit. Repeated rows each give a row; items that share an id, or a text, are listed once each by id. Texts of any
    length are scanned whole. Other columns are never read; with carry they pass through and the result has
    all columns of docs and one struct more, "_verdict", with those above and clean_text, the text without its hit spans
    (null if it has none).
    """
    out = tables.boxed(docs, key, text, carry)
    fields = out.schema.fields
    spark, parts = docs.sparkSession, _parts(benchmark, n, item, item_text)
    out = out.withColumns({"hits": F.lit(None).cast("binary"), "items": F.array().cast("array<string>")})
    for i, part in enumerate(parts):
        known = spark.sparkContext.broadcast(Index([tuple(r) for r in part.collect()], n))
        last = i == len(parts) - 1
        out = out.mapInArrow(_scanner(known, last, keep_text=carry or not last), StructType([*fields, *_FOUND.fields]))
        if i < len(parts) - 1:
            before, out = out, tables.written(out.drop("n_words", "n_hit", "spans", "clean_text"), "decontam")
            tables.dropped(before)
    verdict = [F.col("key").alias(key), F.col("n_words"), F.col("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.col("items"), F.col("spans")]
    return out.select(*tables.unboxed(out, docs, key, text), F.struct(*verdict, F.col("clean_text")).alias(tables.free("_verdict", docs))) if carry else out.select(*verdict)


_SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
_FOUND = StructType([StructField("hits", BinaryType()), StructField("items", ArrayType(StringType())), StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("spans", ArrayType(_SPAN)), StructField("clean_text", StringType())])


def _scanner(known, last: bool, keep_text: bool):
    def scan(batches):
        index = known.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words.of(part["text"], ALNUM, lower=True)
                hit, items = index.scan(words)
                for k, before in enumerate(part["hits"].to_pylist()):
                    if before is not None:
                        lo, hi = words.bounds[k], words.bounds[k + 1]
                        hit[lo:hi] |= np.unpackbits(np.frombuffer(before, np.uint8), count=hi - lo).astype(bool)
                items = [sorted({*a, *b}) for a, b in zip(part["items"].to_pylist(), items, strict=True)]
                n_hit = per_text(hit, words.bounds)
                masks = [None if last else np.packbits(hit[a:b]).tobytes() for a, b in zip(words.bounds, words.bounds[1:], strict=False)]
                spans = [_spans(words, hit, k) if n_hit[k] else [] for k in range(len(n_hit))]
                passed = {c: part[c] for c in part.schema.names if c not in ("hits", "items")}
                if not keep_text:
                    passed["text"] = pa.nulls(len(part), pa.string())
                clean = [_without(t, s) if keep_text and s else None for t, s in zip(part["text"], spans, strict=True)]
                found = [pa.array(masks, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, _SPANS), pa.array(clean, pa.string())]
                yield pa.RecordBatch.from_arrays([*passed.values(), *found], [*passed, *_FOUND.names])

    return scan

