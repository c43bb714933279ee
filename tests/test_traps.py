"""Hand-computed fixtures for semantics that a naive translation gets wrong."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from loomstone.functions import parse
from loomstone.functions import text as T
from loomstone.operators import dedup, gates, metrics, policy, sample
from loomstone.operators.spans import apply_edits, edits_clash, greedy_spans, points_in_ranges
from loomstone.sources import io


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


def test_unicode_white_space(spark):
    assert one(spark, T.normalised(F.col("s")), s=" a\u000b\u001cb\u0085  c\r\n") == "a b c"


def test_last_occurrence_wins(spark):
    heads = ["Fix:", "Detect:"]
    assert one(spark, T.last_head(F.col("s"), heads), s="Detect: x Fix: y Detect: z") == "Detect:"
    assert one(spark, T.last_head(F.col("s"), heads), s="none") is None


def test_dedent_keeps_first_line(spark):
    assert one(spark, T.dedented(F.col("s"), F.lit("  ")), s="  a\r\n  b\r  c\nd") == "  a\nb\nc\nd"


def test_unglued(spark):
    assert one(spark, T.unglued(F.col("s")), s='#pragma once#include "x"\r\nint a;') == '#pragma once\n#include "x"\nint a;'


def test_glob(spark):
    df = spark.createDataFrame([("performance-a/b",), ("Performance-x",), ("a[b",), ("ab",)], "s string")
    assert [r.x for r in df.select(T.matches_any(F.col("s"), ["performance-*", "a[b]"]).alias("x")).collect()] == [True, False, False, True]


def test_answers(spark):
    texts = ['{"checks": [1, "b"]}', 'so {"x": 1} and {"checks": ["a", "a"]} {"checks": []}', '{"checks": ["}"]}', "prose", '{"checks": []}', None]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(parse.checks_anywhere("s").alias("r")).collect()
    assert [(r.r.checks, r.r.valid) for r in got] == [(["b"], True), (["a"], True), ([], False), ([], False), ([], True), ([], False)]


def test_percentile_edges(spark):
    got = one(spark, T.edges_of(F.array(F.lit(1866.9999999999998), F.lit(2.0), F.lit(2.4))), s=1)
    assert got == [2, 1867]


def test_macro_counts_gold_labels_only(spark):
    rows = spark.createDataFrame([(["a"], ["a"], True), ([], ["z"], True), (["a"], [], False)], "gold array<string>, pred array<string>, valid boolean")
    m = metrics.micro(rows).first()
    assert (m.tp, m.fp, m.fn, m.b_tp, m.b_fp, m.b_fn, m.b_tn) == (1, 1, 1, 1, 1, 1, 0)
    assert round(metrics.macro(rows).first().macro_f1, 6) == round(2 / 3, 6)
    empty = spark.createDataFrame([([], [], True)], "gold array<string>, pred array<string>, valid boolean")
    assert metrics.micro(empty).first().precision == 0.0


def test_length_rules_differ(spark):
    rows = spark.createDataFrame([(10, True), (12, True), (20, True)], "n int, y boolean")
    assert metrics.length_rule(rows, "n", "y", "observed").first().threshold == 10
    assert metrics.length_rule(rows, "n", "y", "gap").first().threshold == 0


def test_conflicts(spark):
    rows = spark.createDataFrame([(1, "k", "a"), (2, "k", "a"), (3, "k", "b"), (4, "m", "a"), (5, "m", "a"), (6, "m", "a")], "id int, h string, label string")
    got = {r.h: (r.n, r.conflict, r.dropped) for r in dedup.conflicts(rows, "h", "label").collect()}
    assert got == {"k": (3, True, 3), "m": (3, False, 2)}
    assert [r.id for r in dedup.first_of(rows, "h", "label", ["id"]).collect()] == [4]


def test_groups_are_transitive(spark):
    rows = spark.createDataFrame([(1, ["x"]), (2, ["x", "y"]), (3, ["y"]), (4, []), (5, ["q"])], "id bigint, w array<string>")
    assert {r.id: r.group for r in dedup.shared_groups(rows, "id", "w").collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2}


def test_edits(spark):
    def edits(*spans):
        return [Row(o=o, n=n, text=t) for o, n, t in spans]

    cases = [edits((0, 2, "X"), (2, 1, "Y")), edits((0, 2, "X"), (1, 2, "Y")), edits((0, 1, "X"), (0, 1, "X")), edits((0, 0, "X"), (0, 1, "Y")), edits((99, 1, ""))]
    df = spark.createDataFrame([(i, "äbcd", c) for i, c in enumerate(cases)], "id int, s string, e array<struct<o:bigint,n:bigint,text:string>>")
    got = df.select("id", apply_edits("s", "e").alias("x"), edits_clash(F.col("e")).alias("clash")).orderBy("id").collect()
    assert [(r.x, r.clash) for r in got] == [("XYcd", False), (None, True), (None, False), (None, True), (None, False)]


def test_greedy_spans_touching_collide(spark):
    fs = [Row(fix=[Row(o=o, n=3, text="")]) for o in (0, 3, 7)]
    df = spark.createDataFrame([(fs,)], "f array<struct<fix:array<struct<o:bigint,n:bigint,text:string>>>>")
    assert df.select(greedy_spans("f").alias("g")).first().g.taken == [0, 2]


def test_range_join_over_cells(spark):
    points = spark.createDataFrame([("f", 0), ("f", 9999), ("f", 10000), ("g", 5)], "file string, o bigint")
    ranges = spark.createDataFrame([("f", 0, 10000, 1), ("f", 5, 5, 2), ("g", 6, 9, 3)], "file string, s bigint, e bigint, id int")
    assert sorted((r.file, r.o, r.id) for r in points_in_ranges(points, ranges, ["file"], "o", "s", "e").collect()) == [("f", 0, 1), ("f", 9999, 1)]


def test_round_robin_is_order_free_and_keeps_rare_strata(spark):
    rows = [(i, "rare" if i % 30 == 0 else "common") for i in range(90)]
    pick = lambda r: [x.id for x in sample.round_robin(spark.createDataFrame(r, "id int, s string"), "s", 6, 1, "id").collect()]
    assert pick(rows) == pick(rows[::-1])
    assert sum(i % 30 == 0 for i in pick(rows)) == 3


def test_group_splits_whole_and_big_to_train(spark):
    sizes = spark.createDataFrame([(f"g{i}", 100 if i == 0 else 3) for i in range(60)], "g string, n bigint")
    got = {r.g: r.split for r in sample.group_splits(sizes, "g", "n", {"train": 0.8, "val": 0.1, "test": 0.1}, 50).collect()}
    assert len(got) == 60 and got["g0"] == "train" and set(got.values()) == {"train", "val", "test"}


def test_cascade_first_reason(spark):
    df = policy.cascade(spark.range(4), ("a", F.col("id") > 2), ("b", F.col("id") > 1))
    assert {(r.reason, r.n) for r in policy.ledger(df).collect()} == {("a", 1), ("b", 1)}
    assert policy.kept(df).count() == 2


def test_gate_bag_difference(spark):
    rows = [(1, "before", "w", "m"), (1, "after", "v", "m"), (1, "after", "v", "m"), (1, "before", "v", "m"), (2, "before", "w", "m"), (3, "after", "v", "m")]
    got = {r.id: (r.status, r.added) for r in gates.repair_gate(spark.createDataFrame(rows, "id int, phase string, chk string, message string"), "id", "w").collect()}
    assert got == {1: ("rejected", 1), 2: ("passed_static_validation", 0), 3: ("inconclusive", 1)}


def test_tolerant_lines(spark):
    lines = spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"a": 1}',), ("{",), ("  ",)], "value string")
    assert sorted(str(r.reject) for r in io.read_tolerant(lines, ["a", "b"]).collect()) == ["None", "missing key", "not JSON"]


def test_latest_and_unseen(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "path string, seq int, status string")
    assert {(r.path, r.status) for r in io.latest(log, ["path"], "seq").collect()} == {("a", "y"), ("b", "z")}
    assert io.unseen(log, log.where("path = 'a'"), ["path"]).count() == 1


def test_batches(spark):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate((10, 9, 8, 2, 1))], "pool int, id int, n int")
    got = {r.id: r.batch for r in sample.pack_batches(rows, "pool", "n", "id", 3, 24).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}
