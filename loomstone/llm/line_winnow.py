"""Line deduplication by winnowing, in DataFrame functions only.

Hashes of `gram` adjacent lines are winnowed: of every `pick` neighbours the smallest is a fingerprint, so a run of
gram + pick - 1 lines always holds one, and both copies of a run hold the same. Positions are joined on fingerprints that occur
again, extended both ways to whole runs, and every run but the first is deleted. Shorter runs that hold many words are compared
whole: each is its own fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

GRAM, PICK = 2, 2
RUN = GRAM + PICK - 1
WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _windows(h: str, n: int, *seed: int) -> Column:
    """Hash of the n lines from each on; empty where fewer follow."""
    size = F.size(h)
    at = lambda i, k: F.get(F.col(h), i + k)
    order = range(n) if not seed else reversed(range(n))
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.xxhash64(*map(F.lit, seed), *(at(i, k) for k in order))))


def _grams() -> list[Column]:
    return [_windows("h", GRAM).alias("g"), _windows("h", RUN).alias("w"), _windows("h", RUN, 1).alias("x")]


def _fingerprints() -> Column:
    """Of every two neighbouring grams the smaller one, the later on a tie: gram hash, its line, and the runs that hold it."""
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("g") - PICK), lambda i: F.when(F.get("g", i) < F.get("g", i + 1), i).otherwise(i + 1)))
    run = lambda s: F.when((s >= 0) & (s < F.size("w")), F.struct(s.alias("s"), F.get("w", s).alias("w"), F.get("x", s).alias("x"), F.lit(RUN).alias("m")))
    return F.transform(chosen, lambda p: F.struct(F.get("g", p).alias("g"), F.array_compact(F.array(run(p - 1), run(p))).alias("runs")))


def _wordy(words: int) -> Column:
    """The runs of fewer than RUN lines that hold more than so many words, each as its own fingerprint. Two hashes of the lines
    themselves: one line's 64 bits are few. All is bound to a lambda's variable, or the plan would count words anew for each run."""

    def own(v: Column, n: int) -> Column:
        at = lambda a, i: [F.get(v[a], i + k) for k in range(n)]
        hold = lambda i: (i + n <= F.size(v["a"])) & (sum(at("n", i), F.lit(0)) > words)
        same = lambda i: F.xxhash64(F.lit(n), *at("a", i))
        run = lambda i: F.struct(i.alias("s"), same(i).alias("w"), F.xxhash64(F.lit(n), *at("b", i)).alias("x"), F.lit(n).alias("m"))
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(v["a"]) - 1), hold), lambda i: F.struct(same(i).alias("g"), F.array(run(i)).alias("runs")))

    each = lambda f: F.transform("lines", f)
    lines = F.struct(each(lambda x: F.xxhash64(x)).alias("a"), each(lambda x: F.xxhash64(F.lit(1), x)).alias("b"), each(lambda x: F.regexp_count(x, F.lit(WORD))).alias("n"))
    return F.get(F.transform(F.array(lines), lambda v: F.concat(*(own(v, n) for n in range(1, RUN)))), F.lit(0))


def winnow_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False, words: int | None = None) -> DataFrame:
    """One row for each document: key, n_lines, n_removed, spans (half-open ranges of removed lines), kept_text.

    A line goes if it lies in a run of RUN lines or more (split at \\n, compared by two hashes of 64 bits) that also starts earlier: at
    a smaller key, or earlier in the same document. With words, a run of fewer lines counts as well if its lines together hold more than so
    many words `[^\\x20\\x09-\\x0D]+`. Runs are judged on the input. kept_text joins the other lines by \\n.

    A hot line, or a hot group of copies, costs no pairs: fingerprints and runs are counted with partial sums before the shuffle,
    and positions join the one first place of their run, so a skewed join can be split. No Python runs on the executors.

    A null text is one empty line, and stays null: its kept_text, and a digest of it, are null. Texts of any length are split whole. Keys may be of any ordered type; a null key orders first. Rows that share key and text are one document:
    they lose the same lines; rows that share a key only are ordered by a hash of the text. Without words, texts of fewer than RUN
    lines never change. An empty table gives no row. Other columns are never read; with carry they pass through and the result has all columns
    of docs and one struct more, "_verdict", with those above.
    """
    rows = tables.boxed(docs, key, text, carry).withColumn("th", F.xxhash64("text"))
    hashed = rows.select("key", "th", F.transform(_lines("text"), lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") >= RUN)
    marked = hashed.select("key", "th", *_grams()).select("key", "th", F.explode(_fingerprints()).alias("f"))
    if words is not None:
        marked = marked.union(rows.select("key", "th", _lines("text").alias("lines")).select("key", "th", F.explode(_wordy(words)).alias("f")))
    marks = tables.written(marked.select("key", "th", "f.g", "f.runs"), "fingerprints")
    again = tables.written(marks.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select(F.col("g").alias("again")), "again")
    runs = tables.written(marks.join(again, F.col("g") == F.col("again"), "left_semi").select("key", "th", F.explode("runs").alias("r")).select("key", "th", "r.s", "r.w", "r.x", "r.m"), "runs")
    firsts = runs.groupBy("w", "x").agg(F.min(F.struct("key", "th", "s")).alias("first"), F.max(F.struct("key", "th", "s")).alias("last")).where("first < last")
    firsts = tables.written(firsts.select(F.col("w").alias("fw"), F.col("x").alias("fx"), "first"), "firsts")
    later = runs.join(firsts, (F.col("w") == F.col("fw")) & (F.col("x") == F.col("fx"))).where(F.struct("key", "th", "s") > F.col("first"))
    gone = later.groupBy(F.col("key").alias("k"), F.col("th").alias("t")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("s"), F.col("s") + F.col("m") - 1))))).alias("gone"))
    out = rows.join(gone, F.col("key").eqNullSafe(F.col("k")) & F.col("th").eqNullSafe(F.col("t")), "left").withColumn("lines", _lines("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text_out = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    edge = lambda other, name: F.array_except(F.transform("gone", lambda i: i + (1 if name == "end" else 0)), F.transform("gone", lambda i: i + other))
    spans = F.coalesce(F.arrays_zip(edge(1, "start").alias("start"), edge(0, "end").alias("end")), F.array().cast("array<struct<start:int,end:int>>"))
    verdict = [F.col("key").alias(key), F.size("lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"), spans.alias("spans"), text_out.alias("kept_text")]
    return out.select(*tables.unboxed(out, docs, key, text), F.struct(*verdict).alias(tables.free("_verdict", docs))) if carry else out.select(*verdict)
