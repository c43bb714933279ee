"""The pipeline stage by stage against plain decisions, on rows with nulls, repeats and clashing columns."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import WORD, jaccard_roots, words
from tokenizers import Tokenizer

import corpus_pipeline as P
from loomstone.llm import mil_quality, tables
from loomstone.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    base = words(rng, 120)
    lines = "\n".join(["one two three", "four five six", "seven eight nine"])
    rows = [(0, None), (1, ""), (2, base), (3, base), (4, base + " tail"), (5, lines), (6, lines), (7, "head\n" + lines + "\nend"), (8, words(rng, 20000)), (8, "other"), (None, base), (None, None)]
    data = [(i, t, "en", "s", None if t is None else len(t), 1, 2, 3) for i, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, _id int, n_removed int")


def texts(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.text or "", r.n_chars or 0) for r in df.collect())


def test_stages_keep_columns_and_apply_decisions(spark, docs):
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert P.quality(spark, docs, SF).where("doc_id = 8").count() >= 1


def test_line_dedup(spark, docs):
    got = texts(P.line_dedup(spark, docs, SF))
    ids = [i for (_, i), _, _ in got]
    assert ids.count(6) == 0 and ids.count(5) == 1  # all of 6 repeats 5
    assert ((False, 7), "head\nend", 8) in got


def test_near_duplicates(spark, docs):
    kept = sorted(r.doc_id for r in P.near_duplicates(spark, docs.where("doc_id IS NOT NULL AND doc_id <> 8"), SF).collect())
    rows = {r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL AND doc_id <> 8").collect()}
    _, roots = jaccard_roots([rows[i] for i in sorted(rows)])
    assert kept == sorted({sorted(rows)[k] for k, r in enumerate(roots) if r == k})


def test_decontamination(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    long = words(random.Random(1), 3000, 9999)
    rows = spark.createDataFrame([(1, item), (2, f"{long} {item} end"), (3, "clean text")], "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("bigint"))
    got = {r.doc_id: r for r in P.decontamination(spark, rows, SF).collect()}
    assert set(got) == {2, 3} and got[3].text == "clean text"
    assert got[2].text.startswith(long) and got[2].text.endswith("end") and item not in got[2].text and got[2].n_chars == len(got[2].text)


def test_run_packs_what_is_left(spark):
    out = P.run(spark, SF)
    assert out.select("sequence_id", "offset").distinct().count() == out.count() > 0


def plain_quality(spark, rows):
    """Score of each text by its own, one passage after the other, with the weights that the stage learns."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = mil_quality.fit(df, spark.read.parquet(f"{SF}/labels.parquet"))
    w, kept = model.weights, []
    for i, t in rows:
        found = mil_quality.passages(mil_quality.Words.of(pa.array([t], pa.string())))
        z, e = [], []
        for k in range(len(found.shape)):
            own = found.bucket[found.at[k] : found.at[k + 1]]
            mean = np.mean([w["E"][b] for b in own], axis=0) if len(own) else np.zeros(len(w["b"]))
            z.append(np.tanh(model.scaled(found.shape[k]) @ w["W"] + mean + w["b"]))
            e.append(float((np.tanh(z[-1] @ w["V"]) / (1 + np.exp(-z[-1] @ w["U"]))) @ w["w"]))
        share = np.exp(np.array(e) - max(e)) / np.exp(np.array(e) - max(e)).sum()
        logit = sum(s * x for s, x in zip(share, z, strict=True)) @ w["c"] + w["d"]
        if 1 / (1 + np.exp(-logit)) >= 0.3:
            kept.append((i, t))
    return kept


def plain_lines(spark, rows):
    seen, kept = set(), []
    for i, t in rows:
        lines = t.split("\n")
        gone = [False] * len(lines)
        for m in (1, 2, 3):
            for s in range(len(lines) - m + 1):
                run = tuple(lines[s : s + m])
                if m < 3 and sum(len(WORD.findall(x)) for x in run) <= 50:
                    continue
                if run in seen:
                    gone[s : s + m] = [True] * m
                seen.add(run)
        left = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        if left or not any(gone):
            kept.append((i, left))
    return kept


def plain_near(spark, rows):
    _, roots = jaccard_roots([t for _, t in rows])
    return [row for k, row in enumerate(rows) if roots[k] == k]


def plain_benchmark(spark, rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda m: re.sub("[A-Z]", lambda c: c[0].lower(), m[0])
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = [low(m) for m in word.finditer(r.text or "")]
        m = min(13, len(w))
        grams |= {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
    kept = []
    for i, t in rows:
        found = list(word.finditer(t))
        w, hit = [low(m) for m in found], set()
        for m in {len(g) for g in grams}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in grams:
                    hit |= set(range(k, k + m))
        if hit and 20 * len(hit) >= len(w):
            continue
        out, at, k = "", 0, 0
        while k < len(w):  # a run of hit words goes, from its first to its last character
            if k in hit:
                last = k
                while last + 1 in hit:
                    last += 1
                out, at, k = out + t[at : found[k].start()], found[last].end(), last
            k += 1
        kept.append((i, out + t[at:]))
    return kept


def test_all_stages_against_plain_versions(spark):
    """Every stage on all that the one before it kept of the whole smallest table, with copies, passages and benchmark text in it."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    counts = [len(rows)]
    for (name, stage), plain in zip(P.STAGES[:-1], (plain_quality, plain_lines, plain_near, plain_benchmark), strict=True):
        want = plain(spark, rows)
        df = tables.written(stage(spark, df, SF), name)
        got = sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        assert got == want, name
        assert all(r.n_chars == len(r.text) for r in df.collect())
        rows, counts = want, [*counts, len(want)]
    assert all(a > b for a, b in zip(counts, counts[1:], strict=False)), counts  # each stage had something to drop
    packed, tokenizer = P.packing(spark, df, SF).collect(), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    lengths = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    bins, pieces = {}, {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert pieces == lengths
    for own in bins.values():
        ends = [0, *(o + n for o, n in sorted(own))]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 4096
    assert len(bins) <= -(-sum(lengths.values()) // 4096) + 1


def test_near_copies_are_caught(spark):
    """Of documents that differ from an earlier one in a few words, all with a similarity of 0.8 or more go."""
    rng = random.Random(11)
    rows, near = [], 0
    for k in range(60):
        base = words(rng, 200, 10**6).split()
        rows.append((2 * k, " ".join(base)))
        for _ in range(rng.randrange(1, 8)):
            base[rng.randrange(200)] = "edit"
        rows.append((2 * k + 1, " ".join(base)))
    _, roots = jaccard_roots([t for _, t in rows])
    near = sum(r != k for k, r in enumerate(roots))
    kept = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF).count()
    assert near > 30 and len(rows) - kept == near


def test_repeated_rows_and_any_column_names(spark):
    """Rows that repeat stay once; of an id with two texts only the copy goes; columns of any name pass through."""
    rng = random.Random(12)
    one, two = words(rng, 100), words(rng, 100)
    rows = [(1, one), (1, one), (2, one), (2, two), (None, one), (None, one), (3, None), (3, None)]
    names = ["_verdict", "_", "key", "row", "th", "_id", "_own", "root", "kept_text"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = sorted((str(r.doc_id), str(r.text)) for r in P.near_duplicates(spark, df, SF).collect())
    assert got == sorted([("1", one), ("2", two), ("None", one), ("None", one), ("3", "None")])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        assert out.limit(1).collect() is not None
    assert P.packing(spark, df, SF).count() == len(rows)
