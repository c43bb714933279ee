"""Token counts by offset-mapped attribution: a document is encoded once as a whole, token character spans are joined with its
sections, and a token that crosses a boundary goes to one section by a stated rule."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import buffers, slices

RULES = ("majority", "start", "end")


class Encoder:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte offset of each token's end."""
        return np.cumsum(self.size[np.asarray(self.encoding.encode_ordinary(text), np.int64)])


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section [bounds[k], bounds[k + 1]), and how many of them cross a boundary. Every token counts once.

    majority: the section with most of the token's bytes, the earlier on a tie; start or end: that of its first or last byte.
    """
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    owner = last.copy() if rule == "end" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "majority":
        for i in crossing:
            edges = np.clip(bounds[first[i] : last[i] + 2], starts[i], ends[i])
            owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    n = len(bounds) - 1
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def token_counts(docs: DataFrame, path: str, pattern: str, separator: str = "\n", rule: str = "majority", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each section of each document: key, section (from 0), start, end (characters), n_tokens, n_crossing.

    Sections are cut after each separator (one ASCII character), which belongs to the section it ends; together they cover the text, so a document's
    tokens are those of encoding it whole, however long it is. A null or empty text is one empty section without tokens. Null keys are
    kept, repeated rows each give their rows, an empty table gives none; other columns are never read. Ties: a token with as many
    bytes in two sections goes to the earlier one. Documents are independent: no shuffle.
    """
    if rule not in RULES or len(separator) != 1 or ord(separator) > 127:
        raise ValueError(f"rule is one of {RULES}, separator one ASCII character")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        encoder = Encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, at = buffers(part["text"])
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                cols: list[list] = [[] for _ in range(6)]
                for k, body in enumerate(part["text"].to_pylist()):
                    lo, hi = at[k], at[k + 1]
                    cuts = np.flatnonzero(data[lo:hi] == ord(separator)) + 1
                    bounds = np.unique(np.concatenate([[0], cuts, [hi - lo]])) if hi > lo else np.array([0, 0])
                    n, crossing = attribute(encoder.ends(body), bounds, rule) if hi > lo else (np.zeros(1, np.int64),) * 2
                    place = chars[lo + bounds] - chars[lo]
                    for col, x in zip(cols, (np.full(len(n), k), np.arange(len(n)), place[:-1], place[1:], n, crossing), strict=True):
                        col.append(x)
                own, *rest = (np.concatenate(c) if c else np.empty(0, np.int64) for c in cols)
                yield pa.RecordBatch.from_arrays([part["key"].take(pa.array(own)), *(pa.array(x, pa.int64()) for x in rest)], ["key", "section", "start", "end", "n_tokens", "n_crossing"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint").withColumnRenamed("key", key)
