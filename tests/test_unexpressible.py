"""Queries that SQL cannot state, against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.functions import parse
from loomstone.operators import dedup, metrics, sample
from loomstone.plans import catalog
from loomstone.sources import io
from loomstone.streaming import log

SF = "/root/testdata/sf0.001"


def test_paired_bootstrap(spark):
    rng = np.random.default_rng(3)
    d = rng.choice([-1, 0, 1], 200, p=[0.1, 0.6, 0.3])
    pairs = spark.createDataFrame([(int(x),) for x in d], "d int")
    got = metrics.paired_bootstrap(pairs, "d").first()
    means = np.sort([rng.choice(d, len(d)).mean() for _ in range(10_000)])
    assert got.difference == pytest.approx(d.mean())
    assert got.low == pytest.approx(means[250], abs=0.011) and got.high == pytest.approx(means[9750], abs=0.011)
    again = metrics.paired_bootstrap(pairs.repartition(5), "d").first()
    assert again == got
    same = metrics.paired_bootstrap(spark.createDataFrame([(1,), (1,)], "d int"), "d", 50).first()
    assert (same.difference, same.low, same.high) == (1, 1, 1)
    none = metrics.paired_bootstrap(pairs.limit(0), "d", 50).first()
    assert (none.difference, none.low, none.high) == (None, None, None)


def test_early_stopping(spark):
    runs = {"a": [5, 4, 4, 4, 1], "b": [3, 2, 1], "c": [1, 2, 2], "d": [2, 3, 1, 2, 2, 0]}
    rows = [(r, e, float(x)) for r, xs in runs.items() for e, x in enumerate(xs, 1)]
    got = defaultdict(list)
    for r in metrics.early_stopping(spark.createDataFrame(rows, "run string, epoch int, loss double"), "run", "epoch", "loss", 2).orderBy("run", "epoch").collect():
        got[r.run].append((r.best, r.improved, r.stale, r.stopped))
    for run, xs in runs.items():
        best, stale, want = math.inf, 0, []
        for e, x in enumerate(xs, 1):
            better = x < best
            best, stale = min(best, x), 0 if better else stale + 1
            want.append((best, better, stale, stale == 2 and e < len(xs)))
            if stale == 2:
                break
        assert got[run] == want, run


def longest(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def bleu(r, c):
    total = 0.0
    for n in range(1, 5):
        grams, refs = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (c, r))
        hit, all_ = sum(min(k, refs[g]) for g, k in grams.items()), max(1, sum(grams.values()))
        if n == 1 and not hit:
            return 0.0
        total += math.log((hit + (n > 1)) / (all_ + (n > 1)))
    return min(1.0, math.exp(1 - len(r) / len(c))) * math.exp(total / 4)


def test_overlap_scores(spark):
    rng = random.Random(2)
    pairs = [(" ".join(rng.choices("abcde", k=rng.randrange(1, 90))), " ".join(rng.choices("abcdef", k=rng.randrange(1, 90)))) for _ in range(60)] + [("a", "b"), ("", "a"), (None, "a"), ("a b", "a b")]
    got = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<r:string,c:string>").select("i", parse.overlap_scores("p.r", "p.c").alias("s")).collect()
    for row in got:
        r, c = ((x or "").split() for x in pairs[row.i])
        if not r or not c:
            assert tuple(row.s) == (0.0, 0.0)
        else:
            assert row.s.rouge_l == pytest.approx(2 * longest(r, c) / (len(r) + len(c))) and row.s.bleu == pytest.approx(bleu(r, c))


def test_legacy_overlap_means(spark):
    rows = [('{"fixed_code": "a b c d e", "explanations": []}', '{"fixed_code": "a b c d e", "explanations": []}'), ("no", "{}"), ('{"fixed_code": ""}', '{"fixed_code": "a"}')]
    r = metrics.legacy_fixing(spark.createDataFrame(rows, "p string, g string"), "p", "g").first()
    assert (r.n_scored, r.json_validity, r.avg_explanation_match) == (2, pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert r.avg_rouge == pytest.approx(0.5) and r.avg_bleu == pytest.approx(0.5)
    assert catalog.QUERIES["a46_legacy_overlap"](spark, SF).first().n_scored > 0


def test_comment_aware_windows_group_like_a_union_find(spark):
    import re

    rows = spark.table("units").select("doc_id", "code").collect() if "units" in [t.name for t in spark.catalog.listTables()] else []
    got = {r.doc_id: r.group for r in catalog.QUERIES["g01_comment_aware_windows"](spark, SF).collect()}
    rows = rows or spark.table("units").select("doc_id", "code").collect()
    root, seen = {r.doc_id: r.doc_id for r in rows}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in rows:
        lines = [x.strip() for x in re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", r.code)]
        lines = [x for x in lines if len(x) >= 12 and not re.match(r"(//|/\*|\*|#include)", x)]
        for i in range(len(lines) - 5):
            a, b = sorted((find(r.doc_id), find(seen.setdefault(tuple(lines[i : i + 6]), r.doc_id))))
            root[b] = a
    number = {x: k for k, x in enumerate(sorted({find(x) for x in root}))}
    assert got == {x: number[find(x)] for x in root}


def test_group_splits_of_a_table(spark):
    got = {r.g: r.split for r in catalog.QUERIES["g02_group_splits"](spark, SF).collect()}
    sizes = Counter(r.h for r in spark.table("units").select(F.md5("code").alias("h")).collect())
    assert got.keys() == sizes.keys() and all(got[g] == "train" for g, n in sizes.items() if n > 2)
    share = Counter()
    for g, n in sizes.items():
        share[got[g]] += n / sum(sizes.values())
    assert share["val"] == pytest.approx(0.1, abs=0.03) and share["test"] == pytest.approx(0.1, abs=0.03)
    rows = spark.createDataFrame([(f"g{i}", 1) for i in range(3000)], "g string, n bigint")
    many = Counter(r.split for r in sample.group_splits(rows, "g", "n", {"train": 0.8, "test": 0.2}, 50, bucket=500).collect())
    assert many["test"] == pytest.approx(600, abs=20)


def test_batches_of_a_table(spark):
    rows = catalog.QUERIES["l07_batch_packing"](spark, SF).collect()
    size = {r.doc_id: r.n_tokens for r in spark.table("units").select("doc_id", "n_tokens").collect()}
    batches = defaultdict(list)
    for r in rows:
        batches[r.pool, r.batch].append(size[r.doc_id])
    assert len(rows) == len(size) and all(len(b) <= 16 and (len(b) == 1 or len(b) * max(b) <= 40_000) for b in batches.values())


def test_progress_counts_every_row_once(spark):
    assert catalog.QUERIES["st03_progress"](spark, SF).agg(F.sum("n")).first()[0] == spark.table("scanlog").count()
    got = log.progress(spark, spark.range(1000).repartition(8)).collect()
    assert sum(r.n for r in got) == 1000 and len({r.batch for r in got}) == len(got) > 1


def test_windowed_counts(spark):
    rows = [("2026-01-01 00:10:00", "a"), ("2026-01-01 00:50:00", "a"), ("2026-01-01 01:00:00", "a"), ("2026-01-01 00:59:59", "b")]
    events = spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("t"), "k")
    got = {(str(r.window.start), r.k): r.n for r in log.windowed_counts(events, "t", "k").collect()}
    assert got == {("2026-01-01 00:00:00", "a"): 2, ("2026-01-01 01:00:00", "a"): 1, ("2026-01-01 00:00:00", "b"): 1}


def patched(before, diff):
    lines, out, at = before.splitlines(), [], 0
    for line in diff.splitlines()[2:]:
        if line.startswith("@@"):
            old = line.split()[1][1:].split(",")
            start = int(old[0]) - (0 if len(old) > 1 and old[1] == "0" else 1)
            out += lines[at:start]
            at = start
        elif line.startswith("+"):
            out.append(line[1:])
        else:
            assert lines[at] == line[1:]
            at += 1
            out += [] if line.startswith("-") else [line[1:]]
    return out + lines[at:]


def test_unified_diff_can_be_applied(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(30):
        a = [rng.choice("abc") * 3 for _ in range(rng.randrange(0, 30))]
        b = [x for x in a if rng.random() > 0.1]
        b.insert(rng.randrange(len(b) + 1), "new")
        pairs.append(("\n".join(a), "\n".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", parse.unified_diff("a", "b").alias("d")).collect()
    assert all(patched(r.a, r.d) == r.b.splitlines() for r in got)


def test_malformed_lines_raise_and_vocabularies_are_never_cut(spark):
    path = dedup.scratch(spark)
    spark.createDataFrame([('{"a": 1}',), ("",), ('{"a": ',)], "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        io.read_jsonl(spark, path, "a int").collect()
    with pytest.raises(Exception, match="vocabulary of over 5 rows"):
        io.write_vocabulary(spark.range(6), dedup.scratch(spark), 5)
