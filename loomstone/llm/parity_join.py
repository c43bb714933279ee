"""N-gram Jaccard join by parity sketches, joined by pigeonhole within size bands and verified exactly.

A document's set of word shingles is dealt over the pieces of a sketch; each shingle flips the bits of its hash in its piece, so
a piece is the parity (exclusive or) of its shingles. A shingle that only one of two sets has spoils one piece at most: the
number of pieces that differ, and the Hamming distance of a parity bitmap, are lower bounds of the symmetric difference. Two
sets of sizes a <= b with Jaccard similarity 0.8 differ in at most (a + b) / 9 <= a / 4 shingles, so of any a / 4 + 1 pieces one
agrees. Each set offers the pieces that hold most shingles first, an order both sets share on agreeing pieces.

Keys that sets share without linking, such as a template's, are met a second time with finer pieces: of those each set keeps the
rarest, so a set with enough text of its own no longer offers its template.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators.components import components

from . import tables
from .exchange import answered, cut
from .textcore import U64, Words, mix, slices, windows

#: Pieces offered beyond the bound; in return each set drops as many of its most frequent ones, and one agreeing piece remains.
SPARE = 4
_RATIO = 1.5


def shingle_sets(words: Words, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, one without words has none."""
    h = words.hashes()
    by_size = {m: windows(h, m) for m in range(1, size + 1)}
    out = []
    for lo, n in zip(words.bounds, words.counts, strict=False):
        m = min(size, n)
        out.append(np.unique(by_size[m][lo : lo + n - m + 1]) if m else np.empty(0, U64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    one, two = mix(s).sum(dtype=U64), np.bitwise_xor.reduce(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)), initial=U64(0))
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def bands(n: int) -> list[tuple[int, int]]:
    """(band, its largest size) of a set's own band and of the next one, where a larger partner may be."""
    k, lo = 0, 1
    while n >= (up := max(lo + 1, int(lo * _RATIO))):
        k, lo = k + 1, up
    further = max(up + 1, int(up * _RATIO))
    return [(k, up - 1)] + ([(k + 1, further - 1)] if n * 5 // 4 >= up else [])


def piece_keys(s: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each band of a set the keys of the pieces that it offers, and how many of them it must keep."""
    out, spread = [], mix(s)
    for k, most in bands(len(s)):
        p = max(int(0.3 * most), most // 4 + 1 + SPARE) + 1
        need = len(s) // 4 + 1 + SPARE
        out.append((_keys(s, spread, p, k, need), need - SPARE))
    return out


def fine_keys(s: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """As piece_keys, with twice as many pieces as shingles, all of them offered. At most d pieces of two linked sets differ, so
    of what both hold all but d agree, and whichever d + 1 each keeps in one order of rarity, one is common."""
    out, spread = [], mix(s)
    for k, most in bands(len(s)):
        d = (len(s) + min(most, len(s) * 5 // 4)) // 9
        out.append((_keys(s, spread, 2 * most + 1, k + 512, d + 1, whole=True), d + 1))
    return out


def _keys(s: np.ndarray, spread: np.ndarray, p: int, seed: int, need: int, whole: bool = False) -> np.ndarray:
    """Keys of the first `need` of p pieces, those with most shingles first and empty ones last; whole: all with shingles at least."""
    piece = ((s >> U64(32)) * U64(p) >> U64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(piece, prepend=-1))
    parity, count, where = np.bitwise_xor.reduceat(spread, first), np.diff([*first, len(s)]), piece[first]
    take = slice(None) if whole else np.lexsort((parity, -count))[:need]
    parity, where = parity[take], where[take]
    if len(where) < need:
        empty = np.setdiff1d(np.arange(p), piece)[: need - len(where)]
        parity, where = np.concatenate([parity, np.zeros(len(empty), U64)]), np.concatenate([where, empty])
    return mix(parity ^ mix(where.astype(U64) + U64((seed + 1) << 40)))


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles on each of 2**j bits, at least four bits a shingle; folding the halves gives the next smaller one."""
    bits = 1 << max(6, int(4 * len(s) - 1).bit_length())
    flips = np.bincount((mix(s ^ U64(0x5DEECE66D)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def pack48(s: np.ndarray) -> bytes:
    """The upper 48 bits of each sorted hash; a pair of sets is compared by them."""
    return np.ascontiguousarray((s >> U64(16)).view(np.uint16).reshape(-1, 4)[:, :3]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    short = np.frombuffer(raw, np.uint16).reshape(-1, 3)
    out = np.zeros((len(short), 4), np.uint16)
    out[:, :3] = short
    return out.view(U64).ravel()


def _sizes(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(Words.of(part["text"], lower=True))
            pairs = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([part["key"], part["th"], pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["key", "th", "n", "h1", "h2"])


def _chosen(table: pa.Table, side: pa.Table) -> list[tuple]:
    """(key, set, offered keys) of a chunk's class representatives, in an order that does not depend on how rows arrived."""
    if not len(table) or not len(side):
        return []
    marks = side.filter(pa.compute.equal(side["bucket"], -1))
    wanted = set(zip(marks["rep"].to_pylist(), marks["h1"].to_pylist(), strict=True))
    out = []
    table = table.sort_by([("key", "ascending"), ("th", "ascending")])
    for key, s in zip(table["key"].to_pylist(), shingle_sets(Words.of(table["text"], lower=True)), strict=True):
        if len(s) and (key, one := digest(s)[0]) in wanted:
            wanted.discard((key, one))
            out.append((key, s, piece_keys(s)))
    return out


def _refined(table: pa.Table, side: pa.Table) -> list[tuple]:
    """The same for sets themselves, with finer pieces."""
    if not len(table):
        return []
    table = table.sort_by("node")
    sets = [unpack48(x) << U64(16) for x in table["shingles"].to_pylist()]
    return [(key, s, fine_keys(s)) for key, s in zip(table["node"].to_pylist(), sets, strict=True)]


def _all_keys(own: list[tuple]) -> np.ndarray:
    return np.concatenate([k for *_, offered in own for k, _ in offered])


def _offer(n: int, chosen):
    """What a chunk sends to buckets: its distinct keys as 32 bits, with how many of its sets offer them."""

    def run(table: pa.Table, side: pa.Table) -> pa.Table:
        rows = []
        if own := chosen(table, side):
            u, count = np.unique(_all_keys(own), return_counts=True)
            low, few = (u & U64(0xFFFFFFFF)).astype(np.uint32), np.minimum(count, 255).astype(np.uint8)
            rows = [(b, table["chunk"][0].as_py(), j - i, low[i:j].tobytes(), few[i:j].tobytes()) for b, i, j in cut(u, n)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table({k: pa.array(c, t) for (k, t), c in zip((("bucket", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())), cols, strict=True)})

    return run


def _frequency(table: pa.Table) -> pa.Table:
    """Of one bucket: for each key that was sent the power of two of how many sets offer it, 0 if only one does."""
    sizes = table["n"].to_pylist()
    low = np.concatenate([np.frombuffer(x, np.uint32) for x in table["hashes"].to_pylist()])
    count = np.concatenate([np.frombuffer(x, np.uint8) for x in table["counts"].to_pylist()]).astype(np.int64)
    order = np.argsort(low, kind="stable")
    new = np.flatnonzero(np.diff(low[order].astype(np.int64), prepend=-1))
    total = np.add.reduceat(count[order], new)
    out = np.empty(len(low), np.uint8)
    out[order] = np.repeat(np.ceil(np.log2(total)).astype(np.uint8), np.diff([*new, len(low)]))
    ends = np.cumsum(sizes)
    rows = [(c, b, out[e - s : e].tobytes()) for c, b, s, e in zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(), sizes, ends, strict=True) if out[e - s : e].any()]
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.table({k: pa.array(c, t) for (k, t), c in zip((("chunk", pa.int32()), ("bucket", pa.int32()), ("answer", pa.binary())), cols, strict=True)})


def _kept(own: list[tuple], side: pa.Table, n: int):
    """(key, set, keys) of a chunk's sets: what each keeps of what it offers, in order of rarity, if another set offers it too."""
    u, place = np.unique(_all_keys(own), return_inverse=True)
    replies = side.filter(pa.compute.greater_equal(side["bucket"], 0))
    level, at = answered(u, n, dict(zip(replies["bucket"].to_pylist(), replies["answer"].to_pylist(), strict=True)), width=1)[place], 0
    for key, s, offered in own:
        out = []
        for k, most in offered:
            lv = level[at : at + len(k)]
            keep = np.lexsort((k, lv))[:most]
            out.append(k[keep][lv[keep] > 0])
            at += len(k)
        yield key, s, np.concatenate(out).astype(np.int64)


def _share(n: int):
    def run(table: pa.Table, side: pa.Table) -> pa.Table:
        own = _chosen(table, side)
        rows = [(key, len(s), keys, pack48(s), bitmap(s)) for key, s, keys in (_kept(own, side, n) if own else ()) if len(keys)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table({k: pa.array(c, t) for (k, t), c in zip((("node", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("shingles", pa.binary()), ("parity", pa.binary())), cols, strict=True)})

    return run


def _share_fine(n: int):
    def run(table: pa.Table, side: pa.Table) -> pa.Table:
        own = _refined(table, side) if len(side) else []
        rows = [(key, keys) for key, _, keys in (_kept(own, side, n) if own else ()) if len(keys)]
        cols = list(zip(*rows, strict=True)) or [[]] * 2
        return pa.table({"node": pa.array(cols[0], pa.int64()), "keys": pa.array(cols[1], pa.list_(pa.int64()))})

    return run


def _verified(a: str = "hub", b: str = "node"):
    def run(table: pa.Table) -> pa.Table:
        ids, shingles, parity = table["id"].to_pylist(), table["shingles"].to_pylist(), table["parity"].to_pylist()
        hub = table["hub"][0].as_py()
        left = [(unpack48(s), p) for i, s, p in zip(ids, shingles, parity, strict=True) if i == hub]
        out = set()
        for i, s, p in zip(ids, shingles, parity, strict=True):
            if i == hub:
                continue
            x = unpack48(s)
            for y, q in left:
                most = (len(x) + len(y)) // 9
                if 80 * max(len(x), len(y)) <= 100 * min(len(x), len(y)) and hamming(p, q) <= most:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= 80 * (len(x) + len(y) - both):
                        out.add(i)
        return pa.table({a: pa.array([hub] * len(out), pa.int64()), b: pa.array(sorted(out), pa.int64())})

    return run


def verify(pairs: DataFrame, sets: DataFrame, group: int = 256, salts: int = 8) -> DataFrame:
    """The candidate pairs (hub, node) that really link. A hub's partners are dealt into groups of about `group`; a hub that a
    third of the corpus shares is counted and joined in `salts` parts, so that none of this meets in one task."""
    salted = pairs.select("hub", "node", F.pmod(F.xxhash64("node"), F.lit(salts)).alias("salt"))
    degree = salted.groupBy("hub", "salt").count().groupBy("hub").agg(F.ceil(F.sum("count") / group).alias("parts"))
    degree = degree.select(F.col("hub").alias("h"), "parts", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("s"))
    dealt = salted.join(degree, (F.col("hub") == F.col("h")) & (F.col("salt") == F.col("s"))).select("hub", "node", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("parts")).alias("part"))
    ask = dealt.select("hub", "part", F.col("node").alias("id")).union(dealt.select("hub", "part", F.col("hub").alias("id")).distinct())
    full = ask.join(sets.select(F.col("node").alias("id"), "shingles", "parity"), "id")
    return full.groupBy("hub", "part").applyInArrow(_verified(), "hub bigint, node bigint")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_bytes: int = tables.CHUNK_BYTES) -> DataFrame:
    """One row for each document: key, n_shingles, component_id, the smallest key that links of Jaccard similarity >= 0.8 reach.

    Sets are the distinct 5-word shingles over words `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; a text of fewer words is
    one shingle, one without words, or a null, has none and links with nothing. Equal sets are one class, whose smallest key
    stands for it, so a class may hold a third of the corpus. Candidates come from shared piece keys in steps that together lose
    no component, the same ones at every size: each key's members are compared with its smallest and its largest one; sets of keys
    whose members still lie in different components offer finer pieces, which are compared alike, and then with two others;
    members of keys that are still open are compared within the key, block by block, by bitmaps first, without a row for a
    pair that does not link. Keys are filtered by an exchange of 32-bit hashes before any key becomes a row; shared pieces that
    are most frequent are dropped within the pigeonhole bound, never by a cap.

    Keys must be integers; rows with a null key form no links and have a null component. Rows that share a key are one document
    with several texts. Repeated rows each give a row. Ties: the smallest key stands for a class and for a component. Texts of any
    length are whole sets. An empty table gives no row. Other columns are never read.
    """
    return row_components(docs, key, text, chunk_bytes).select(F.col("key").alias(key), "n_shingles", "component_id")


def row_components(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_bytes: int = tables.CHUNK_BYTES) -> DataFrame:
    """As jaccard_join, with key under that name and th, the hash of the text (xxhash64): rows of one key can be told apart."""
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    sizes = tables.written(rows.mapInArrow(_sizes, "key bigint, th bigint, n bigint, h1 bigint, h2 bigint"), "sizes")
    classes = tables.written(sizes.where("n > 0 and key is not null").groupBy("n", "h1", "h2").agg(F.min(F.struct("key", "th")).alias("rep")).select("n", "h1", "h2", F.col("rep.key").alias("rep"), F.col("rep.th").alias("rth")), "classes")
    found = linked(rows, classes, chunk_bytes)
    roots = found["roots"]
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("n").alias("n_"), F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), F.coalesce("root", "rep").alias("component_id"))
    named = tables.written(named, "named")
    tables.dropped(classes, *found.values())
    out = sizes.join(named, (F.col("n") == F.col("n_")) & (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")) & F.col("key").isNotNull(), "left")
    return out.select("key", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def linked(rows: DataFrame, classes: DataFrame, chunk_bytes: int = tables.CHUNK_BYTES) -> dict[str, DataFrame]:
    """Written tables: sets; coarse and fine, the candidate pairs of both grains; open, the keys that are compared within; roots."""
    n = tables.chunks_for(rows, chunk_bytes=chunk_bytes)
    reps = tables.with_chunk(classes.select("rep", "rth", "h1"), n, "rep", "rth")
    dealt = tables.with_chunk(rows.where("key IS NOT NULL"), n, "key", "th").groupBy("chunk")
    marks = reps.select("chunk", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("answer"), "rep", "h1")
    offers = dealt.cogroup(marks.groupBy("chunk")).applyInArrow(_offer(n, _chosen), _OFFER)
    replies = offers.groupBy("bucket").applyInArrow(_frequency, _REPLY)
    side = replies.select("chunk", "bucket", "answer", F.lit(None).cast("bigint").alias("rep"), F.lit(None).cast("bigint").alias("h1")).union(marks)
    sets = tables.written(dealt.cogroup(side.groupBy("chunk")).applyInArrow(_share(n), "node bigint, n bigint, keys array<bigint>, shingles binary, parity binary"), "sets")

    keyed = sets.select(F.explode("keys").alias("k"), "node")
    ends = keyed.groupBy("k").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("g")).where("a < b")
    ends = tables.written(ends.withColumnRenamed("k", "hk"), "ends")
    coarse = _stars(keyed.withColumn("root", F.col("node")), ends.select("hk", F.array(*(F.struct(F.col(c).alias("node"), F.col(c).alias("root")) for c in "ab")).alias("hubs")))
    first = tables.written(verify(coarse, sets), "links")
    roots = components(first)
    # keys of up to three members have no pair left untested; of the others, those that still join different components go on
    keyed = tables.written(keyed.join(ends.where("g > 3"), F.col("k") == F.col("hk"), "left_semi"), "keyed")
    opened = _open(keyed, roots)
    tables.dropped(first, ends, keyed)

    some = opened.select("node").distinct().withColumnRenamed("node", "id")
    some = tables.written(sets.join(some, F.col("node") == F.col("id"), "left_semi").select("node", "shingles"), "some")
    tables.dropped(opened)
    m = tables.chunks_for(some, "shingles", chunk_bytes)
    dealt = tables.with_chunk(some, m, "node").groupBy("chunk")
    offer = _offer(m, _refined)
    replies = dealt.applyInArrow(lambda table: offer(table, table), _OFFER).groupBy("bucket").applyInArrow(_frequency, _REPLY)
    keyed = tables.written(dealt.cogroup(replies.groupBy("chunk")).applyInArrow(_share_fine(m), "node bigint, keys array<bigint>").select(F.explode("keys").alias("k"), "node"), "keyed")
    opened = _open(keyed, roots)
    hubs = opened.groupBy(F.col("k").alias("hk")).agg(F.array(*(f(F.struct("node", "root")) for f in (F.min, F.max))).alias("hubs"))
    fine = _stars(opened, hubs)
    more = tables.written(verify(fine, sets), "links")
    before, roots = roots, components(_joined(roots, more))
    tables.dropped(before, more, keyed, some)
    before, opened = opened, _open(opened, roots)
    more = _within(opened, sets)
    gone, roots = roots, components(_joined(roots, more))
    tables.dropped(before, gone, more)
    return {"sets": sets, "coarse": coarse, "fine": fine, "open": opened, "roots": roots}


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("hub"), F.col("root").alias("node")).union(links)


_OFFER = "bucket int, chunk int, n int, hashes binary, counts binary"
_REPLY = "chunk int, bucket int, answer binary"


def _stars(keyed: DataFrame, hubs: DataFrame) -> DataFrame:
    """Each member of a key with each hub of the key that lies in another component, once: no more pairs than twice the members."""
    both = keyed.select("k", "node", "root").join(hubs, F.col("k") == F.col("hk")).select("node", "root", F.explode("hubs").alias("hub"))
    both = both.where("hub.root <> root").select("node", F.col("hub.node").alias("hub"))
    return tables.written(both.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node")).distinct(), "candidates")


def _open(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """Keys, with all their members, whose members lie in different components."""
    placed = keyed.select("k", "node").join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("k", "node", F.coalesce("root", "node").alias("root"))
    placed = tables.written(placed, "placed")
    split = placed.groupBy("k").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select(F.col("k").alias("sk"))
    out = tables.written(placed.join(split, F.col("k") == F.col("sk"), "left_semi"), "open")
    tables.dropped(placed)
    return out


def _within(opened: DataFrame, sets: DataFrame, block: int = 512) -> DataFrame:
    """Links across components among the members of each open key; keys of the same members count once.

    Members are dealt into blocks, and each two blocks are compared in one task, first by bitmaps alone: that names the members
    with any partner within the bound. Those are compared by their sets, once for each such group of members, whatever keys it
    came from. A member goes to as many tasks as its keys have blocks; no pair becomes a row unless it links.
    """
    alike = opened.groupBy("k").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in range(2)))
    parts = tables.written(alike.groupBy("n", "x0", "x1").agg(F.min("k").alias("pk")).select("pk", F.ceil(F.col("n") / block).alias("parts")), "parts")
    dealt = opened.join(parts, F.col("k") == F.col("pk")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")))
    upto = F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)
    task = F.transform(upto, lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi"), F.when(F.col("i") == j, 2).when(F.col("i") < j, 0).otherwise(1).alias("side")))
    dealt = dealt.select("k", "node", "root", F.explode(task).alias("t")).select("k", "node", "root", "t.*")
    short = dealt.join(sets.select(F.col("node").alias("id"), "n", "parity"), F.col("node") == F.col("id")).drop("id")
    near = tables.written(short.groupBy("k", "lo", "hi").applyInArrow(_near, "g1 bigint, g2 bigint, node bigint, root bigint").distinct(), "near")
    full = near.join(sets.select(F.col("node").alias("id"), "shingles", "parity"), F.col("node") == F.col("id")).drop("id")
    out = tables.written(full.groupBy("g1", "g2").applyInArrow(_compare, "hub bigint, node bigint"), "links")
    tables.dropped(parts, near)
    return out


def _folded(parity: list[bytes], size: int) -> np.ndarray:
    out = np.empty((len(parity), size), np.uint8)
    for k, raw in enumerate(parity):
        x = np.frombuffer(raw, np.uint8)
        while len(x) > size:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[k] = x
    return out.view(np.uint64)


def _within_bound(x: int, near: np.ndarray, bits: np.ndarray, size: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Of the members near those in another component whose sizes and bitmaps allow a link with member x."""
    near = near[root[near] != root[x]]
    near = near[(80 * np.maximum(size[near], size[x]) <= 100 * np.minimum(size[near], size[x]))]
    return near[np.bitwise_count(bits[near] ^ bits[x]).sum(1, dtype=np.int64) <= (size[near] + size[x]) // 9]


def _near(table: pa.Table) -> pa.Table:
    """Of one task, left against right or all against all: the members with a partner within the bound, under a digest of them all."""
    table = table.sort_by("node")
    node, root, side, size = (table[c].to_numpy() for c in ("node", "root", "side", "n"))
    parity = table["parity"].to_pylist()
    bits, found = _folded(parity, min(map(len, parity))), np.zeros(len(node), bool)
    for x in range(len(node)):
        near = np.arange(x + 1, len(node)) if side[x] == 2 else np.flatnonzero(side == 1) if side[x] == 0 else np.empty(0, np.int64)
        near = _within_bound(x, near, bits, size, root)
        found[near] = True
        found[x] |= len(near) > 0
    g = digest(node[found].astype(U64))
    return pa.table({"g1": pa.array([g[0]] * found.sum(), pa.int64()), "g2": pa.array([g[1]] * found.sum(), pa.int64()), "node": pa.array(node[found]), "root": pa.array(root[found])})


def _compare(table: pa.Table) -> pa.Table:
    """Links of one group of members, all against all. Pairs already in one component are passed over."""
    table = table.sort_by("node")
    node, root = table["node"].to_numpy(), table["root"].to_numpy().copy()
    parity, raw = table["parity"].to_pylist(), table["shingles"].to_pylist()
    bits, size = _folded(parity, min(map(len, parity))), np.array([len(x) // 6 for x in raw])
    sets: dict[int, np.ndarray] = {}
    links = []
    for x in range(len(node)):
        for y in _within_bound(x, np.arange(x + 1, len(node)), bits, size, root):
            if root[x] == root[y]:
                continue
            for k in (x, y):
                if k not in sets:
                    sets[k] = unpack48(raw[k])
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= 80 * (size[x] + size[y] - both):
                links.append((node[x], node[y]))
                root[root == root[y]] = root[x]
    return pa.table({"hub": pa.array([a for a, _ in links], pa.int64()), "node": pa.array([b for _, b in links], pa.int64())})
