"""Quality classifier by attention-based multiple-instance learning: passages are encoded, gated attention weighs them, and the
weighted representation is scored. A passage is encoded from its shape and from word embeddings that are learnt together with the
attention. Only document labels train it; the attention learns which passages decide."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import tables
from .textcore import U64, Words, mix, slices

#: Words of a passage.
PASSAGE = 64
#: Hashed words that have an embedding of their own.
BUCKETS = 2048
_CLASSES = [np.zeros(256, bool) for _ in range(5)]
_CLASSES[0][0x41:0x5B] = True  # upper case
_CLASSES[1][0x61:0x7B] = True  # lower case
_CLASSES[2][0x30:0x3A] = True  # digits
_CLASSES[3][0x80:] = True
_CLASSES[4][[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
#: Numbers that describe a passage's shape.
SHAPE = 12


@dataclass
class Passages:
    """Passages of many texts: shapes, word buckets, where each passage's words and each text's passages begin (one entry more)."""

    shape: np.ndarray
    bucket: np.ndarray
    at: np.ndarray
    bounds: np.ndarray

    def text(self, k: int) -> Passages:
        i, j = self.bounds[k], self.bounds[k + 1]
        return Passages(self.shape[i:j], self.bucket[self.at[i] : self.at[j]], self.at[i : j + 1] - self.at[i], np.array([0, j - i]))

    @staticmethod
    def joined(parts: list[Passages]) -> Passages:
        ends = lambda sizes: np.concatenate([[0], np.cumsum(sizes)])
        return Passages(np.concatenate([p.shape for p in parts]), np.concatenate([p.bucket for p in parts]), ends(np.concatenate([np.diff(p.at) for p in parts])), ends(np.concatenate([np.diff(p.bounds) for p in parts])))


def passages(words: Words) -> Passages:
    """Every passage of every text. A text without words has one, of zeros."""
    n_passages = np.maximum(1, -(-words.counts // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(n_passages)])
    out = np.zeros((bounds[-1], SHAPE), np.float32)
    if not len(words):
        return Passages(out, np.empty(0, np.uint16), np.zeros(len(out) + 1, np.int64), bounds)
    text = words.texts()
    place = np.arange(len(words)) - words.bounds[text]
    of = bounds[text] + place // PASSAGE
    first = np.flatnonzero(np.diff(of, prepend=-1))
    rows = of[first]
    add = lambda x: np.add.reduceat(x.astype(np.float64), first)
    h, size = words.hashes(), words.ends - words.starts
    count, chars = add(np.ones(len(words))), add(size)
    for i, kind in enumerate(_CLASSES):
        total = np.concatenate([[0], np.cumsum(kind[words.data], dtype=np.int64)])
        each = total[words.ends] - total[words.starts]
        out[rows, i] = add(each) / chars
        if i == 0:
            out[rows, 5] = add((each > 1) & (each == size)) / count
        if i == 4:
            out[rows, 6] = add(each > 1) / count
            out[rows, 7] = add(each == size) / count
    keys = h ^ mix(of.astype(U64) + U64(1))
    out[rows, 8] = np.bincount(of[np.unique(keys, return_index=True)[1]], minlength=len(out))[rows] / count
    out[rows, 9] = add(np.concatenate([[False], (h[1:] == h[:-1]) & (of[1:] == of[:-1])])) / count
    out[rows, 10] = np.log1p(chars / count)
    out[rows, 11] = np.log1p(count)
    bucket = ((h >> U64(32)) * U64(BUCKETS) >> U64(32)).astype(np.uint16)
    return Passages(out, bucket, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(out)))]), bounds)


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x between neighbouring entries of at, zero where they are equal."""
    out, full = np.zeros((len(at) - 1, *x.shape[1:]), x.dtype), at[1:] > at[:-1]
    if full.any():
        out[full] = np.add.reduceat(x, at[:-1][full])
    return out


@dataclass
class Model:
    """Gated-attention multiple-instance network. prior is the score when nothing could be learnt; attend: else passages weigh alike."""

    weights: dict[str, np.ndarray] | None
    centre: np.ndarray
    scale: np.ndarray
    prior: float
    attend: bool = True

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Standardised and clipped, so that a passage unlike any in training stays in the range that was learnt."""
        return np.clip((x - self.centre) / self.scale, -3, 3)

    def encode(self, shape: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, ...]:
        """From scaled shapes and mean word embeddings: representations, the two halves of the gate, and attention before softmax."""
        w = self.weights
        z = np.tanh(shape @ w["W"] + mean + w["b"])
        a, g = np.tanh(z @ w["V"]), 1 / (1 + np.exp(-(z @ w["U"])))
        return z, a, g, (a * g) @ w["w"] * self.attend

    def pooled(self, z: np.ndarray, e: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention shares of passages, weighted representations of documents, and their log-odds."""
        start, n = bounds[:-1], np.diff(bounds)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), n))
        share = e / np.repeat(np.add.reduceat(e, start), n)
        r = np.add.reduceat(z * share[:, None], start)
        return share, r, r @ self.weights["c"] + self.weights["d"]

    def scores(self, p: Passages) -> np.ndarray:
        if self.weights is None:
            return np.full(len(p.bounds) - 1, self.prior)
        if len(p.bounds) == 1:
            return np.empty(0)
        mean = _sums(self.weights["E"].astype(np.float32)[p.bucket], p.at) / np.maximum(1, np.diff(p.at))[:, None]
        z, _, _, e = self.encode(self.scaled(p.shape), mean)
        return 1 / (1 + np.exp(-self.pooled(z, e, p.bounds)[2]))

    def loss(self, p: Passages, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of document labels, and its gradient."""
        w, shape, n = self.weights, self.scaled(p.shape.astype(np.float64)), np.diff(p.bounds)
        of = np.repeat(np.arange(len(n)), n)
        width = np.diff(p.at)
        bag = np.bincount(np.repeat(np.arange(len(width)), width) * BUCKETS + p.bucket, minlength=len(width) * BUCKETS).reshape(-1, BUCKETS) / np.maximum(1, width)[:, None]
        z, a, g, e = self.encode(shape, bag @ w["E"])
        share, r, logit = self.pooled(z, e, p.bounds)
        d_logit = (1 / (1 + np.exp(-logit)) - y) / len(n)
        d_r = np.outer(d_logit, w["c"])[of]
        d_share = (d_r * z).sum(1)
        d_e = share * (d_share - np.add.reduceat(share * d_share, p.bounds[:-1])[of]) * self.attend
        d_gate = np.outer(d_e, w["w"])
        d_a, d_g = d_gate * g * (1 - a * a), d_gate * a * g * (1 - g)
        d_z = (d_r * share[:, None] + d_a @ w["V"].T + d_g @ w["U"].T) * (1 - z * z)
        grad = {"E": bag.T @ d_z, "W": shape.T @ d_z, "b": d_z.sum(0), "V": z.T @ d_a, "U": z.T @ d_g, "w": (a * g).T @ d_e, "c": r.T @ d_logit, "d": d_logit.sum()}
        return float((np.logaddexp(0, logit) - y * logit).mean()), grad


def train(bags: list[Passages], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 14, batch: int = 64, rate: float = 4e-3, seed: int = 7, attend: bool = True) -> Model:
    """Adam on the cross-entropy of document labels. The same bags in the same order give the same model."""
    if not bags or labels.min() == labels.max():
        return Model(None, np.zeros(SHAPE), np.ones(SHAPE), float(labels.mean()) if len(labels) else 0.5)
    flat = np.concatenate([b.shape for b in bags]).astype(np.float64)
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"E": rng.normal(0, 0.1, (BUCKETS, hidden)), "W": draw(SHAPE, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "d": np.zeros(())}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    model = Model(p, flat.mean(0), flat.std(0) + 1e-3, float(labels.mean()), attend)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for chosen in (order[i : i + batch] for i in range(0, len(order), batch)):
            _, grad = model.loss(Passages.joined([bags[i] for i in chosen]), labels[chosen])
            step += 1
            for k, q in grad.items():
                q = q + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 4000, most_passages: int = 200_000) -> Model:
    """Learns from a bounded sample of labelled documents: of the `most` labelled keys with the smallest hashes those, in that order,
    whose passages together are at most `most_passages`. Each is used whole. That sample is all that the driver is sent.

    Rows whose crc32(key as text) mod 5 is 0 are held out. Rows that repeat a key count once, by the smallest of their encodings.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col(key).cast("string")) % 5 != 0))
    one = usable.groupBy(F.col(key).alias("mark")).agg(F.max(label).alias("y"))
    sample = one.orderBy(F.xxhash64("mark"), "mark").limit(most)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), F.col("key") == F.col("mark")).select("key", "text", F.col("y").cast("double").alias("y"))

    def encode(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = passages(Words.of(part["text"]))
                own = [found.text(k) for k in range(len(part))]
                cols = [pa.array([len(p.shape) for p in own], pa.int64()), pa.array([p.shape.tobytes() + p.bucket.tobytes() for p in own], pa.binary())]
                yield pa.RecordBatch.from_arrays([part["key"], part["y"], *cols], ["key", "y", "n", "x"])

    kind = rows.schema["key"].dataType.simpleString()
    once = rows.mapInArrow(encode, f"key {kind}, y double, n bigint, x binary").groupBy("key", "y").agg(F.min(F.struct("n", "x")).alias("e")).select("key", "y", "e.*")
    once = tables.written(once, "sample")
    upto = once.select("key", F.sum("n").over(Window.orderBy(F.xxhash64("key"), "key")).alias("upto")).where(F.col("upto") <= most_passages)  # `most` rows at most
    got = sorted((r.key, r.n, bytes(r.x), r.y) for r in once.join(upto, "key", "left_semi").collect())
    tables.dropped(once)
    return train([_unpacked(n, x) for _, n, x, _ in got], np.array([y for *_, y in got]))


def _unpacked(n: int, raw: bytes) -> Passages:
    size = 4 * SHAPE * n
    bucket = np.frombuffer(raw[size:], np.uint16)
    return Passages(np.frombuffer(raw[:size], np.float32).reshape(n, SHAPE), bucket, np.minimum(np.arange(n + 1) * PASSAGE, len(bucket)), np.array([0, n]))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, carry: bool = False) -> DataFrame:
    """One row for each document: key, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold).

    Every whole text is scored, from its words alone, however long. A null or empty text is one passage of zeros. A score equal to
    the threshold is accepted. A null key is never labelled,
    is not held out, and is scored. With no label, or one kind only, the score is 0.5, or that label's share. A key labelled twice
    counts once, with its higher label; repeated documents each give a row. Other columns are never read; with carry they pass
    through and the result has all columns of docs and one struct more, "_verdict", with the four above.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, label))

    def score(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = np.round(model.value.scores(passages(Words.of(part["text"]))), 6)
                more = [part[c] for c in part.schema.names]
                yield pa.RecordBatch.from_arrays([*more, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    rows = tables.boxed(docs, key, text, carry)
    out = rows.mapInArrow(score, StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
    held = F.coalesce(F.crc32(F.col("key").cast("string")) % 5 == 0, F.lit(False))
    verdict = [F.col("key").alias(key), held.alias("held_out"), F.col("score"), F.col("predicted")]
    return out.select(*tables.unboxed(out, docs, key, text), F.struct(*verdict).alias(tables.free("_verdict", docs))) if carry else out.select(*verdict)
