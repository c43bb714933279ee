"""Operators against brute force on small fixtures: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.llm import best_fit, chat_tree, crf_extract, decontam, line_winnow, llr_rules, mil_quality, parity_join, token_attr
from loomstone.llm.anchor_dedup import anchor_dedup
from loomstone.llm.queries import CONTROL_TEXT, token_pattern, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["key", "chunk", "n", "n_words", "score", "row", "bucket", "kept_text"]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base, passage = words(rng, 300), words(rng, 60)
    out = [None, "", "  \n\t ", "one", "a b c", base, base, base + " more", passage + "\n" + words(rng, 50), words(rng, 40) + " " + passage]
    out += [" ".join(w if rng.random() > 0.02 else "edit" for w in base.split()) for _ in range(12)]
    out += ["\n".join(["l1 " + words(rng, 4), "same line one", "same line two", "same line three", "tail " + words(rng, 3)]) for _ in range(4)]
    out += ["x y " * 60, "SHOUT!! LOUD!! " * 40, words(rng, 30000), "a b\u000bc\u001cd é́ 日本 \U0001f600", "it's <|endoftext|> we'll", passage, passage]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, *range(len(CLASH))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} int" for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, n_words int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_anchor_dedup(docs, empty, texts):
    got = by_id(anchor_dedup(docs, chunk_bytes=20_000))
    seen = set()
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
        assert sum(s.end - s.start for s in got[i].spans) == sum(gone)
    assert anchor_dedup(empty).count() == 0


def test_anchor_dedup_repeated_rows_and_null_keys(spark, texts):
    long = texts[5]
    rows = spark.createDataFrame([(1, long), (1, long), (None, long), (None, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id is None, r.n_removed) for r in anchor_dedup(rows).collect())
    assert got == [(False, 0), (False, 300), (True, 0), (True, 300)]


def test_decontaminate(spark, docs, empty, texts):
    items = [(1, texts[8].split("\n")[0]), (2, "same line"), (3, None), (4, ""), (5, "W1 w2"), (6, texts[5])]
    bench = spark.createDataFrame(items, "item_id int, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def expected(t):
        w, hit, own = split(t), set(), set()
        for i, x in items:
            x = split(x)
            m = min(13, len(x))
            grams = {tuple(x[k : k + m]) for k in range(len(x) - m + 1)} if x else set()
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in grams:
                    hit |= set(range(k, k + m))
                    own.add(str(i))
        return len(w), len(hit), sorted(own)

    def check(df):
        for i, r in by_id(df).items():
            assert (r.n_words, r.n_hit, r["items"]) == expected(texts[i])

    check(decontam.decontaminate(docs, bench))
    old, decontam.PART_BYTES = decontam.PART_BYTES, 500
    try:  # a benchmark beyond the bound goes in parts
        check(decontam.decontaminate(docs, bench))
    finally:
        decontam.PART_BYTES = old
    old, decontam.PIECE = decontam.PIECE, 20
    try:  # long items go in pieces
        check(decontam.decontaminate(docs, bench))
    finally:
        decontam.PIECE = old
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    carried = decontam.decontaminate(docs, bench, carry=True)
    assert carried.columns[: len(docs.columns)] == docs.columns
    plain = docs.select("doc_id", "text")
    cut = {r.doc_id: r.t for r in decontam.decontaminate(plain, bench, carry=True).select("doc_id", F.coalesce("_verdict.clean_text", "text").alias("t")).collect()}
    assert cut[0] is None and cut[3] == "one" and cut[31].strip() == ""
    assert "same line" not in cut[22], cut[22]


def test_decontaminate_by_a_large_benchmark(spark):
    """20 MiB of benchmark: one index of bounded size, and the documents are read once."""
    rng = random.Random(2)
    items = [(k, words(rng, 2500, 10**7)) for k in range(960)] + [(None, "a b c")]
    assert sum(len(t.encode()) for _, t in items) > 20 << 20
    picked = [" ".join(items[k][1].split()[100:120]) for k in (3, 500)]
    rows = [(1, "before " + picked[0] + " after"), (2, re.sub("[a-z]", lambda m: m[0].upper(), picked[1])), (3, "clean text"), (4, "A, b; C"), (None, None), (2, picked[1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = decontam.decontaminate(docs, spark.createDataFrame(items, "item_id int, text string"))
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in out.collect())
    n = [len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", p)) for p in picked]
    assert got == [(0, 0, 0, []), (1, n[0] + 2, n[0], ["3"]), (2, n[1], n[1], ["500"]), (2, n[1], n[1], ["500"]), (3, 2, 0, []), (4, 3, 3, ["null"])]
    assert str(out._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1


def test_decontamination_index_tells_equal_hashes_apart(monkeypatch):
    monkeypatch.setattr(decontam, "windows", lambda h, n: np.zeros(len(h), np.uint64))
    index = decontam.Index([("a", "one two three"), ("b", "two three four"), ("c", "one two three")], 2)
    hit, items = index.scan(decontam.Words.of(pa.array(["x one two y", "three four three", "two one"]), decontam.ALNUM, lower=True))
    assert hit.tolist() == [False, True, True, False, True, True, False, False, False] and items == [{"a", "c"}, {"b"}, set()]


def jaccard_roots(texts):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def test_jaccard_join(docs, empty, texts):
    n, roots = jaccard_roots(texts)
    got = by_id(parity_join.jaccard_join(docs, chunk_bytes=20_000))
    assert [got[i].n_shingles for i in range(len(texts))] == n
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert parity_join.jaccard_join(empty).count() == 0


def test_jaccard_join_on_a_hot_near_copy_group(spark):
    rng = random.Random(5)
    base = words(rng, 150).split()
    group = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
        group.append(" ".join(w))
    group += [words(rng, rng.randrange(1, 60)) for _ in range(60)]
    n, roots = jaccard_roots(group)
    got = by_id(parity_join.jaccard_join(spark.createDataFrame(list(enumerate(group)), "doc_id bigint, text string"), chunk_bytes=20_000))
    assert [got[i].component_id for i in range(len(group))] == roots


def test_piece_bound():
    """Linked sets always share an offered key, whatever their sizes; of finer pieces, whatever order of rarity they are kept in."""
    rng = np.random.default_rng(1)
    for n in [1, 2, 4, 5, 9, 15, 40, 111, 112, 113, 500, 2000]:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = len(a) // 9
        for b in (np.concatenate([a[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)]), np.concatenate([a, rng.integers(0, 2**63, n // 4, dtype=np.uint64)]), a[: -(-4 * n // 5)]):
            b = np.unique(b)
            flat = lambda s: np.concatenate([k for k, _ in parity_join.piece_keys(s)])
            assert len(np.intersect1d(flat(a), flat(b))) > min(parity_join.SPARE, n)
            for seed in range(5):
                order = lambda k, seed=seed: parity_join.mix(k ^ np.uint64(seed))
                kept = [np.concatenate([k[np.argsort(order(k))][:m] for k, m in parity_join.fine_keys(s)]) for s in (a, b)]
                assert len(np.intersect1d(*kept))
            assert parity_join.hamming(parity_join.bitmap(a), parity_join.bitmap(b)) <= len(np.setxor1d(a, b))
        assert (parity_join.unpack48(parity_join.pack48(a)) == a >> np.uint64(16)).all()


def _tried(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string").withColumn("th", F.xxhash64("text"))
    sizes = df.mapInArrow(parity_join._sizes, "key bigint, th bigint, n bigint, h1 bigint, h2 bigint")
    classes = sizes.groupBy("n", "h1", "h2").agg(F.min("key").alias("rep"), F.min("th").alias("rth"))
    found = parity_join.linked(df, classes, 20_000)
    within = found["open"].groupBy("k").count().selectExpr("coalesce(sum(count * (count - 1) / 2), 0) AS n").first().n
    return found["coarse"].count() + found["fine"].count() + int(within)


def test_jaccard_join_of_documents_that_share_a_template(spark):
    """A template of two thirds of each document links nothing; pairs tried grow with the documents, not with their square."""
    rng = random.Random(9)
    template = words(rng, 100, 10**6)
    make = lambda n: [template + " " + words(rng, 50, 10**6) for _ in range(n)]
    few, many = _tried(spark, make(60)), _tried(spark, make(240))
    assert few <= 60 * 60 and many <= 240 * 60 and many <= 6 * max(few, 60)
    group = make(80)
    group += [" ".join(w if rng.random() > 0.01 else "edit" for w in group[k].split()) for k in range(0, 40, 3)]
    n, roots = jaccard_roots(group)
    got = by_id(parity_join.jaccard_join(spark.createDataFrame(list(enumerate(group)), "doc_id bigint, text string"), chunk_bytes=20_000))
    assert [got[i].component_id for i in range(len(group))] == roots and len(set(roots)) < len(roots)


def test_jaccard_join_of_mixed_passages(spark):
    """Documents made of a few common passages, near the threshold on both sides: keys stay open to the last step."""
    rng = random.Random(12)
    passages = [words(rng, 30, 10**6) for _ in range(9)]
    group = [" ".join(rng.sample(passages, rng.choice([4, 5, 6]))) + " " + words(rng, rng.randrange(12), 10**6) for _ in range(150)]
    n, roots = jaccard_roots(group)
    df = spark.createDataFrame([*enumerate(group), (None, group[0]), (None, None), (3, group[3])], "doc_id bigint, text string")
    rows = parity_join.jaccard_join(df, chunk_bytes=20_000).collect()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [got[i].component_id for i in range(len(group))] == roots
    assert len(rows) == 153 and [r.component_id for r in rows if r.doc_id is None] == [None, None]


def test_quality_rules(spark, docs, empty, texts):
    trusted = spark.createDataFrame([(5,), (6,), (None,)], "doc_id bigint")
    got = by_id(llr_rules.quality_rules(docs, trusted))
    for i, t in enumerate(texts):
        t = t or ""
        w, lines, seen, dup = WORD.findall(t), t.split("\n"), set(), 0
        for x in lines:
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        assert tuple(got[i])[1:7] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), failed)
        assert got[i].kept == (not failed and got[i].llr >= -0.1)
    # the ratio, from plain counts of buckets over all documents
    raw, target = Counter(), Counter()
    own = {}
    for i, t in enumerate(texts):
        one, two, starts = llr_rules.grams(llr_rules.Words.of(pa.array([t or ""])))
        own[i] = [*one.tolist(), *two[starts].tolist()]
        raw.update(own[i])
        target.update(own[i] if i in (5, 6) else [])
    log = lambda c, b: math.log((c[b] + 1) / (sum(c.values()) + llr_rules.BUCKETS))
    for i, buckets in own.items():
        want = sum(log(target, b) - log(raw, b) for b in buckets) / max(1, len(buckets))
        assert abs(got[i].llr - want) < 2e-6 and len(buckets) == max(0, 2 * got[i].n_words - 1)
    # a text's ratio is the same wherever it stands, and repeated rows and null keys change no verdict but by the raw counts
    ratio = np.random.default_rng(0).normal(size=llr_rules.BUCKETS)
    alone = [llr_rules.mean_ratio(ratio, llr_rules.Words.of(pa.array([t], pa.string())))[0] for t in texts]
    assert alone == llr_rules.mean_ratio(ratio, llr_rules.Words.of(pa.array(texts, pa.string()))).tolist()
    again = spark.createDataFrame([(5, texts[5]), (5, texts[5]), (None, texts[5]), (None, None)], "doc_id bigint, text string")
    rows = llr_rules.quality_rules(again, trusted.union(trusted)).collect()
    assert len(rows) == 4 and {r.n_words for r in rows} == {0, 300} and len({r.llr for r in rows if r.n_words}) == 1
    old, llr_rules.FILTER = llr_rules.FILTER, 4096 // 8
    try:  # a filter that passes others too changes nothing
        assert {r.doc_id: r.llr for r in llr_rules.quality_rules(docs, trusted).collect()} == {i: r.llr for i, r in got.items()}
    finally:
        llr_rules.FILTER = old
    assert llr_rules.quality_rules(empty, trusted).count() == 0
    assert {r.llr for r in llr_rules.quality_rules(docs, trusted.limit(0)).collect()} == {0.0}


def test_winnow_lines(docs, empty, texts):
    got = by_id(line_winnow.winnow_lines(docs))
    seen = set()
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        gone = [False] * len(lines)
        for s in range(len(lines) - 2):
            k = tuple(lines[s : s + 3])
            if k in seen:
                gone[s : s + 3] = [True] * 3
            seen.add(k)
        kept = None if t is None else "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        assert (got[i].n_lines, got[i].n_removed, got[i].kept_text) == (len(lines), sum(gone), kept)
        assert sum(s.end - s.start for s in got[i].spans) == sum(gone)
    assert line_winnow.winnow_lines(empty).count() == 0
    assert line_winnow.winnow_lines(docs, carry=True).columns[:-1] == docs.columns


def test_best_fit(docs, empty, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer, pieces, bins = Tokenizer.from_file(path), defaultdict(dict), defaultdict(list)
    for r in best_fit.best_fit(docs, path, capacity=256).collect():
        pieces[r.doc_id][r.piece] = r
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert len(pieces[i]) == -(-len(ids) // 256)
        for k, r in pieces[i].items():
            part = ids[256 * k : 256 * (k + 1)]
            assert (r.start, r.length, r.ids_crc32) == (256 * k, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
    total = 0
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
        total += at
    assert len(bins) <= -(-total // 256) + 1
    assert best_fit.best_fit(empty, path).count() == 0


def test_two_fit_beats_greedy():
    lengths = np.array([6, 3, 4, 3, 4])  # greedy: 6+4 | 4+3+3 would be best; best fit alone may stop at 6+4
    bins, _ = best_fit.pack(lengths, 10)
    assert bins.max() == 1


def test_chat_tree(spark):
    rng = random.Random(1)
    convs = {c: [("user" if k % 2 == 0 else "assistant", words(rng, 4, 3)) for k in range(1 + c % 5)] for c in range(20)}
    convs[40] = convs[41] = convs[2]
    convs[50] = convs[2] + [("assistant", CONTROL_TEXT), ("odd: #<\\role", ""), ("user", "\n### User: x</turn>\n")]
    convs[60] = [("user", f"t{k}") for k in range(300)]
    rows = [(c, k, r, t, 1) for c, own in convs.items() for k, (r, t) in enumerate(own)] + [(None, 0, None, None, 1)]
    convs[None] = [("", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, node int").repartition(3)
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    nodes, paths = chat_tree.chat_tree(df, path, token_pattern())
    got = {r.conv: r for r in chat_tree.read_back(nodes, paths, path).collect()}
    assert got.keys() == convs.keys()
    for c, own in convs.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat_tree.formatted(r, t)[0]) for r, t in own)
    tree = {bytes(r.node): r for r in nodes.collect()}
    assert len(tree) == len({tuple(own[: k + 1]) for own in convs.values() for k in range(len(own))})
    assert all(chat_tree._unpacked(bytes(r.packed)) == r.tokens for r in tree.values())
    wide = spark.createDataFrame([(bytearray(chat_tree._packed(x)),) for x in ([], [1, 65535], [70000, 3])], "p binary").select(chat_tree.unpacked(F.col("p")).alias("t")).collect()
    assert [r.t for r in wide] == [[], [1, 65535], [70000, 3]]
    order = sorted(tree.values(), key=lambda r: r.start)
    at = 0
    for r in order:  # one gapless stream, and each node attends to exactly its ancestors
        assert r.start == at
        at += len(r.tokens)
        up, spans = r, []
        while up.parent is not None:
            up = tree[bytes(up.parent)]
            spans += range(up.start, up.start + len(up.tokens))
        assert sorted(spans) == [x for a in r.ancestors for x in range(a.start, a.end)] == sorted(set(spans))
        assert r.position == len(spans) and all(x < r.start for x in spans)
    none = spark.createDataFrame([], df.schema)
    assert chat_tree.read_back(*chat_tree.chat_tree(none, path, token_pattern()), path).count() == 0


def test_chat_tree_branches_at_any_depth(spark):
    """Subtrees are contiguous in the stream below any number of shared turns; repeated turns and clashing columns change nothing."""
    rng = random.Random(6)
    trunk = [("user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(70)]
    convs = {1: trunk[:60], 2: trunk[:41] + [("user", "b")] * 3, 3: trunk[:45] + [("user", "c")], 4: trunk[:45] + [("user", "c"), ("assistant", "d" * 3000)], 5: trunk[:45] + [("user", "c"), ("user", "e")]}
    for c in range(6, 40):
        at = rng.randrange(1, 70)
        convs[c] = trunk[:at] + [("user", rng.choice("xyz")) for _ in range(rng.randrange(4))]
    rows = [(c, k, r, t, "owner", b"place") for c, own in convs.items() for k, (r, t) in enumerate(own)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, node string, place binary").repartition(5)
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    nodes, paths = chat_tree.chat_tree(df, path, token_pattern())
    got = {r.conv: r for r in chat_tree.read_back(nodes, paths, path).collect()}
    for c, own in convs.items():
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
    tree = {bytes(r.node): r for r in nodes.collect()}
    assert len(tree) == len({tuple(own[: k + 1]) for own in convs.values() for k in range(len(own))})
    size, low, high = {}, {}, {}
    for r in tree.values():  # every subtree is one gapless interval that begins with its own node
        up = r
        while up is not None:
            k = bytes(up.node)
            size[k] = size.get(k, 0) + len(r.tokens)
            low[k], high[k] = min(low.get(k, r.start), r.start), max(high.get(k, 0), r.start + len(r.tokens))
            up = tree[bytes(up.parent)] if up.parent is not None else None
    assert all(high[k] - low[k] == size[k] and low[k] == tree[k].start for k in tree)
    assert any(len(r.ancestors) > 1 and r.position > 0 for r in tree.values())


@pytest.mark.parametrize("rule", token_attr.RULES)
def test_token_counts(docs, empty, texts, rule):
    path, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), token_pattern()
    got = defaultdict(dict)
    for r in token_attr.token_counts(docs, path, pattern, separator=" ", rule=rule).collect():
        got[r.doc_id][r.section] = r
    encoder = token_attr.Encoder(path, pattern).encoding
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        owner, k = [], 0
        for b in raw:
            owner.append(k)
            k += b == 0x20
        want, at = Counter(), 0
        for token in encoder.encode_ordinary(t or ""):
            own = Counter(owner[at : at + len(encoder.decode_single_token_bytes(token))])
            at += sum(own.values())
            want[min(own) if rule == "start" else max(own) if rule == "end" else min(own, key=lambda s: (-own[s], s))] += 1
        assert {s: r.n_tokens for s, r in got[i].items() if r.n_tokens} == dict(want)
        assert "".join((t or "")[r.start : r.end] for _, r in sorted(got[i].items())) == (t or "")
    assert token_attr.token_counts(empty, path, pattern).count() == 0


def test_extract(spark):
    body = "<p>Main &amp; text <b>here</b>, with a sentence.</p>" * 2
    pages = [
        (1, "u", f"<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>Head</h1>{body}</article><footer>&copy; 2020 someone</footer></body></html>"),
        (2, "u", None), (3, None, ""), (4, "u", "<<< & <p"), (4, "u", "<<< & <p"), (5, "u", "<div>" * 500 + "x" * 100_000),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in crf_extract.extract(df.withColumn("text", F.lit(1))).collect()}
    assert got[1].text == "Head\n" + "\n".join(["Main & text here, with a sentence."] * 2)
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert crf_extract.extract(df.limit(0)).count() == 0


def block_score(model, pages):
    right = total = 0
    for page, labels in pages:
        found = crf_extract.described(page)
        right += sum(a == b for a, b in zip(model.decode(found), labels, strict=True))
        total += len(labels)
    return right / total


def test_crf_held_out_pages_and_names():
    """Other pages of the same designs, and pages whose class names and ids were never seen in training."""
    assert block_score(crf_extract.train(crf_extract.labelled_pages(400, 11)), crf_extract.labelled_pages(120, 99)) > 0.97
    model = crf_extract.train(crf_extract.labelled_pages(400, 11, slice(0, None, 2)))
    assert block_score(model, crf_extract.labelled_pages(120, 99, slice(1, None, 2))) > 0.85


def test_extract_on_pages(spark):
    """Real rows of `pages`, labelled by hand: the main text is the heading and the paragraphs of the article."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in df.collect():
        page = r.html or ""
        body = re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "", page)
        main = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", body)
        parts = re.split(r"</?(?:h1|h2|p|ul|li|table|tr|td|blockquote|pre|div|section)\b[^>]*>", main[1]) if main else []
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", x)).split()) for x in parts)
        want[r.page_id] = "\n".join(x for x in lines if x)
    got = {r.page_id: r.text for r in crf_extract.extract(df).collect()}
    assert len(got) == len(want) and np.mean([got[k] == want[k] for k in want]) > 0.98


@pytest.mark.parametrize("tag", ["<svg viewBox='0 0 1 1'/>", "<iframe src=x />", "<object/>", "<math/>", "<iframe src=x>", "<svg><svg></svg><text>no</text></svg>", "<template><p>no</p></template>", "<img alt='it>s'>", "<!-- it's -->"])
def test_elements_without_text_lose_nothing_else(tag):
    found = crf_extract.blocks(f"<article><p>One.</p>{tag}<p>Two.</p><p>Three.</p></article>")
    assert [b.text for b in found] == ["One.", "Two.", "Three."]


def test_attributes_as_html_reads_them():
    text = lambda page: [b.text for b in crf_extract.blocks(page)]
    assert text("<p title=it's>One.</p><p>Two.</p><p title='a>b'>Three.</p>") == ["One.", "Two.", "Three."]
    assert text('<p title="open>One.</p><p>Two.</p>') == ["One.", "Two."]
    assert text("<p data-x = \"a > b\" y>One.<p a='\"'>Two.</p>") == ["One.", "Two."]
    assert text("<div/ class=x>One.</div><script>a</script") == ["One."]


def test_deep_and_long_pages_take_linear_time():
    for unit in ("<div>x y", "<b>x<p>y", "</b>", "<p><b>", "<svg>", "<li>z<b>", '<a b="'):
        took = []
        for n in (5_000, 40_000):
            began = time.process_time()
            found = crf_extract.described(unit * n)
            took.append(time.process_time() - began)
        assert took[1] < 30 * max(took[0], 0.02), (unit, took)
    assert len(crf_extract.blocks("<div>x y" * 50_000)) == 50_000 and found is not None


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(0)
    model = crf_extract.Crf({f"f{i}": float(x) for i, x in enumerate(rng.normal(size=6))}, rng.normal(size=(2, 2)))
    found = [crf_extract.Block("x", (), 0.0, [f"f{rng.integers(6)}"]) for _ in range(7)]

    def score(y):
        return sum(model.weights[b.features[0]] * k for b, k in zip(found, y, strict=True)) + sum(model.pairs[a, b] for a, b in zip(y, y[1:], strict=False))

    assert tuple(model.decode(found)) == max(product((0, 1), repeat=7), key=score)


def test_quality_scores(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    data, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = mil_quality.quality_scores(data, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (held.predicted == held.quality).mean() > 0.95 and held[held.quality == 1].predicted.mean() > 0.98
    assert mil_quality.quality_scores(empty, labels).count() == 0
    scores = by_id(mil_quality.quality_scores(docs, labels.limit(0)))
    assert {r.score for r in scores.values()} == {0.5} and len(scores) == docs.count()
    assert mil_quality.quality_scores(docs, labels, carry=True).columns[:-1] == docs.columns


def mil_bags(rng, n, least=8, most=40):
    """Documents of clean passages; those of label 0 hold one passage with words that clean ones never have."""
    texts, labels = [], []
    for k in range(n):
        own = [[f"w{rng.randrange(300)}" for _ in range(64)] for _ in range(rng.randrange(least, most))]
        if k % 2:
            bad = own[rng.randrange(len(own))]
            for i in rng.sample(range(64), 12):
                bad[i] = f"b{rng.randrange(30)}"
        texts.append(" ".join(w for x in own for w in x))
        labels.append(float(k % 2 == 0))
    found = mil_quality.passages(mil_quality.Words.of(pa.array(texts)))
    return found, [found.text(k) for k in range(n)], np.array(labels)


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y > 0].sum() - (y > 0).sum() * ((y > 0).sum() - 1) / 2) / ((y > 0).sum() * (y == 0).sum())


def test_attention_beats_mean_pooling():
    """On documents of which one passage is bad: the same encoder, trained alike, with attention and with equal weights."""
    _, bags, y = mil_bags(random.Random(3), 600)
    held, _, truth = mil_bags(random.Random(4), 400)
    with_, without = (auc(mil_quality.train(bags, y, epochs=60, attend=x).scores(held), truth) for x in (True, False))
    assert with_ > 0.97 and with_ > without + 0.02, (with_, without)


def test_gradient_by_finite_differences():
    found, bags, y = mil_bags(random.Random(5), 6, 1, 4)
    model, rng = mil_quality.train(bags, y, epochs=2), np.random.default_rng(1)
    _, grad = model.loss(found, y)
    for name, g in grad.items():
        flat = model.weights[name].reshape(-1)
        for i in (np.flatnonzero(g.reshape(-1)) if name == "E" else np.arange(flat.size))[rng.integers(0, min(flat.size, 20), 5)]:
            model.weights[name] = flat.copy().reshape(g.shape)
            ends = []
            for step in (1e-5, -1e-5):
                model.weights[name].reshape(-1)[i] = flat[i] + step
                ends.append(model.loss(found, y)[0])
            assert abs((ends[0] - ends[1]) / 2e-5 - g.reshape(-1)[i]) < 1e-7 + 1e-4 * abs(g.reshape(-1)[i]), name
        model.weights[name] = flat.reshape(g.shape)


def test_quality_scores_of_odd_rows(spark):
    """Null keys, repeated rows, one key with two texts, very long and empty texts: each row has its score, and order changes nothing."""
    rng = random.Random(7)
    rows = [(k, words(rng, 100) if k % 2 else "X!! " * 90, k % 2) for k in range(200)]
    odd = [(None, "a b"), (None, None), (3, rows[3][1]), (3, "other text"), (900, ""), (901, words(rng, 40000))]
    docs = spark.createDataFrame([r[:2] for r in rows] + odd, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows] + [(3, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    one = sorted((str(r.doc_id), r.score, r.predicted, r.held_out) for r in mil_quality.quality_scores(docs, labels).collect())
    two = sorted((str(r.doc_id), r.score, r.predicted, r.held_out) for r in mil_quality.quality_scores(docs.repartition(7), labels.repartition(3)).collect())
    assert one == two and len(one) == 206 and all(0 <= s <= 1 for _, s, _, _ in one) and not any(h for k, *_, h in one if k == "None")
    bounded = mil_quality.fit(docs, labels, most=50, most_passages=60)
    assert bounded.weights is not None


def test_odd_rows_of_the_other_operators(spark):
    """Null keys, repeated rows, one key with several texts, clashing columns: every row is there, and copies fare alike."""
    rng = random.Random(13)
    lines = "\n".join(words(rng, 8) for _ in range(6))
    rows = [(1, lines), (1, lines), (None, lines), (None, None), (None, ""), (2, "other " + lines), (2, words(rng, 5000))]
    clash = ["key", "row", "_verdict", "th", "gone", "lines", "section", "piece", "start"]
    df = spark.createDataFrame([(*r, *range(len(clash))) for r in rows], "doc_id bigint, text string, " + ", ".join(f"`{c}` int" for c in clash)).repartition(3)
    got = line_winnow.winnow_lines(df).collect()
    assert len(got) == 7 and sum(r.n_removed for r in got if r.doc_id == 1) == 12  # the null key orders first and keeps its lines
    assert sorted(r.n_removed for r in got if r.doc_id is None) == [0, 0, 0]
    path, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), token_pattern()
    sections = token_attr.token_counts(df, path, pattern).collect()
    assert len(sections) == 6 * 3 + 2 + 6 + 1 and len({r.n_tokens for r in sections if r.doc_id == 1 and r.section == 0}) == 1
    pieces = best_fit.best_fit(df, tokenizer_path("word_bpe_49k.json")).collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces) and Counter(r.doc_id for r in pieces if r.piece == 0) == {1: 2, None: 3, 2: 2}
    found = decontam.decontaminate(df, df.where("doc_id = 1").selectExpr("key AS item_id", "text")).collect()
    assert len(found) == 7 and {r.n_hit for r in found if r.doc_id == 1} == {48}
    scored = llr_rules.quality_rules(df, df.select("doc_id")).collect()
    assert len(scored) == 7 and len({r.llr for r in scored if r.doc_id == 1}) == 1
    groups = parity_join.jaccard_join(df).collect()
    assert Counter(r.component_id for r in groups) == {1: 4, None: 3}  # both texts of 2 are one document, near 1
