"""Runs of few lines but many words, against a plain loop."""

import random
import re

from test_operators import words

from loomstone.llm import line_winnow


def test_runs_of_many_words_go(spark):
    rng = random.Random(5)
    long, half, other, short = words(rng, 51), words(rng, 26), words(rng, 25), words(rng, 50)
    texts = [long, long, "head\n" + long, long + "\ntail", f"{half}\n{other}", f"a\n{half}\n{other}\nb", f"{other}\n{half}", short, short, f"{long}\n{long}", "a\n\n\n", "b\n\n\n", None, "", long.replace(" ", "\t \u000b")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got, seen = {r.doc_id: r for r in line_winnow.winnow_lines(df, words=50).collect()}, set()
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        gone = [False] * len(lines)
        for m in (1, 2, 3):
            for s in range(len(lines) - m + 1):
                k = tuple(lines[s : s + m])
                if m < 3 and sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in k) <= 50:
                    continue
                if k in seen:
                    gone[s : s + m] = [True] * m
                seen.add(k)
        kept = None if t is None else "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        assert (i, got[i].n_removed, got[i].kept_text) == (i, sum(gone), kept)
    assert [got[i].n_removed for i in (0, 1, 2, 5, 6, 8, 9)] == [0, 1, 1, 2, 0, 0, 2]


def test_pipeline_drops_a_repeated_long_line(spark):
    import corpus_pipeline as P

    long = words(random.Random(6), 60)
    df = spark.createDataFrame([(1, long, 1), (2, long, 1), (3, "x\n" + long, 1)], "doc_id int, text string, n_chars bigint")
    assert sorted((r.doc_id, r.text) for r in P.line_dedup(spark, df, "").collect()) == [(1, long), (3, "x")]
