"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus, with exact base counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import SPACED, U64, Words, buffers, covered, mix, per_text, slices, windows

#: Buckets of the two multinomials over word unigrams and bigrams: what is sent to the driver and back, whatever the input.
BUCKETS = 1 << 16
_STEP = 1 << 12
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def grams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of unigrams, buckets of bigrams, and where a bigram starts."""
    h = words.hashes()
    return (mix(h) >> U64(48)).astype(np.int64), (windows(h, 2) >> U64(48)).astype(np.int64), words.valid(2)


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, at = words.data, words.offsets
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])
    text = words.texts()
    triple = windows(words.hashes(), 3) ^ mix(text.astype(U64) + U64(1))
    start = np.flatnonzero(words.valid(3))
    _, back, n = np.unique(triple[start], return_inverse=True, return_counts=True)
    repeated = covered(start[n[back] > 1], 3, len(words))
    lines = Words(data, at, _LINE)
    full = np.searchsorted(words.starts, lines.starts, "left") < np.searchsorted(words.starts, lines.ends, "left")
    of = lines.texts()[full]
    keys = (lines.hashes()[full]) ^ mix(of.astype(U64) + U64(1))
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return {
        "word_chars": total(SPACED[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": total(_SYMBOL[data]),
        "n_dup_lines": np.bincount(of[later], minlength=len(words.counts)),
        "n_repeat_words": per_text(repeated, words.bounds),
    }


def _count(batches):
    """Counts of one task: a block of buckets a row."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            one, two, starts = grams(Words.of(part["text"]))
            total += np.bincount(one, minlength=BUCKETS)
            total += np.bincount(two[starts], minlength=BUCKETS)
    yield _blocks(total, _STEP)


def _blocks(total: np.ndarray, step: int) -> pa.RecordBatch:
    at = [b for b in range(0, len(total), step) if total[b : b + step].any()]
    return pa.RecordBatch.from_arrays([pa.array([b // step for b in at], pa.int32()), pa.array([total[b : b + step].tobytes() for b in at], pa.binary())], ["block", "sums"])


def _merged(kind, how):
    def run(table: pa.Table) -> pa.Table:
        out = how.reduce([np.frombuffer(x, kind) for x in table["sums"].to_pylist()], axis=0)
        return pa.table({"block": table["block"].slice(0, 1), "sums": pa.array([out.tobytes()], pa.binary())})

    return run


def _gathered(blocks: DataFrame, size: int, kind, how, step: int) -> np.ndarray:
    """Blocks of all tasks merged before they reach the driver: an array of that fixed size, whatever the input."""
    out = np.zeros(size, kind)
    for block, sums in blocks.groupBy("block").applyInArrow(_merged(kind, how), "block int, sums binary").collect():
        out[block * step : (block + 1) * step] = np.frombuffer(sums, kind)
    return out


#: Bytes of the filter of trusted keys. It only spares the join texts that no trusted key can have: with far more keys than bits it
#: spares none, and the result is the same.
FILTER = 1 << 22


def _filter(size: int):
    def run(batches):
        on = np.zeros(size * 8, bool)
        for batch in batches:
            on[batch["bit"].to_numpy()] = True
        yield _blocks(np.packbits(on), _STEP)

    return run


def _passing(known):
    def run(batches):
        for batch in batches:
            bit = batch["bit"].to_numpy()
            yield batch.filter(pa.array((known.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)))

    return run


def weights(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """log(p_target / p_raw) of each bucket, from counts over every document. Each task sums its own rows before the shuffle.

    Raw counts need no join. Trusted keys follow the corpus, so they are never broadcast: texts whose key passes the filter, of
    fixed size, meet them in a merge join. Null keys never do.
    """
    spark, size = docs.sparkSession, FILTER
    bit = F.pmod(F.xxhash64("key"), F.lit(size * 8)).alias("bit")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    marks = trusted.where(F.col(key).isNotNull()).select(F.col(key).cast(rows.schema["key"].dataType).alias("key")).distinct()
    known = spark.sparkContext.broadcast(_gathered(marks.select(bit).mapInArrow(_filter(size), "block int, sums binary"), size, np.uint8, np.bitwise_or, _STEP))
    some = rows.where(F.col("key").isNotNull()).select("key", "text", bit)
    some = some.mapInArrow(_passing(known), some.schema).select("key", "text").join(marks.withColumnRenamed("key", "mark").hint("merge"), F.col("key") == F.col("mark"), "left_semi")
    raw, target = (_gathered(x.select("text").mapInArrow(_count, "block int, sums binary"), BUCKETS, np.int64, np.add, _STEP) for x in (rows, some))
    smooth = lambda c: np.log((c + 1.0) / (c.sum() + BUCKETS))
    return smooth(target) - smooth(raw) if target.sum() else np.zeros(BUCKETS)


def mean_ratio(ratio: np.ndarray, words: Words) -> np.ndarray:
    """Mean log-likelihood ratio of each text's unigrams and bigrams, 0 without words. A text's sum depends on its own words only."""
    one, two, starts = grams(words)
    out, full = np.zeros(len(words.counts)), words.counts > 0
    if full.any():
        out[full] = np.add.reduceat(ratio[one] + np.where(starts, ratio[two], 0.0), words.bounds[:-1][full])
    return np.round(out / np.maximum(1, 2 * words.counts - 1), 6)


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = -0.1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    llr is the mean log-likelihood ratio of the document's hashed word unigrams and bigrams between two multinomials: the
    documents whose keys `trusted` lists, and the raw corpus, both counted over every document. kept is llr >= threshold, unless
    a base rule fails: fewer than 50 words, or over half of the words in three-word windows found twice or more in the text.

    A null text has no words; very long ones are counted whole. Without words llr is 0. Ties: an llr equal to the threshold is kept. With no trusted document every ratio is 0, so only the base rules decide.
    Null keys are never trusted, but are scored. Repeated rows each give a row; repeated trusted keys count once. Other columns
    are never read.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(weights(docs, trusted, key, text).astype(np.float64))

    def score(batches):
        ratio = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words.of(part["text"])
                llr = mean_ratio(ratio, words)
                base = base_counts(words)
                failed = (words.counts < 50) | (100 * base["n_repeat_words"] > 50 * words.counts)
                yield pa.RecordBatch.from_arrays([part["key"], *(pa.array(x) for x in (words.counts, *base.values(), failed, llr, ~failed & (llr >= threshold)))], ["key", "n_words", *base, "base_failed", "llr", "kept"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, llr double, kept boolean"
    return rows.mapInArrow(score, schema).withColumnRenamed("key", key)
