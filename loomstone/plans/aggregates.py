"""Aggregations as queries; those that both dialects read alike are one text."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.functions.parse import lenient_json
from loomstone.operators import dedup, metrics
from loomstone.plans.catalog import plan, query

plan("a01_group_count", "SELECT engine, count(*) AS n FROM units GROUP BY engine")
plan("a02_exploded_count", "SELECT label, count(*) AS n FROM (SELECT explode(pred) AS label FROM preds) GROUP BY label", "SELECT label, count(*) AS n FROM (SELECT unnest(pred) AS label FROM preds) GROUP BY label")
plan("a03_distinct_per_row", "SELECT chk, count(*) AS n FROM (SELECT DISTINCT doc_id, check AS chk FROM findings) GROUP BY chk", "SELECT chk, count(*) AS n FROM (SELECT DISTINCT doc_id, \"check\" AS chk FROM findings) GROUP BY chk")
plan("a04_capped_histogram", "SELECT least(n, 5) AS size, count(*) AS n FROM (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) GROUP BY least(n, 5)")
plan("a05_split_counts", "SELECT split, count(*) AS n, count_if(low) AS smelly, count_if(NOT low) AS clean FROM units GROUP BY split")
plan("a06_min_label_count", "SELECT label FROM (SELECT explode(pred) AS label FROM preds WHERE split = 'train') GROUP BY label HAVING count(*) >= 5", "SELECT label FROM (SELECT unnest(pred) AS label FROM preds WHERE split = 'train') GROUP BY label HAVING count(*) >= 5")

_COPIES = "SELECT md5(code) AS h, count(*) AS n, min(engine) <> max(engine) AS conflict FROM units GROUP BY md5(code)"


@query("a07_conflict_dedup", f"SELECT h, n, conflict FROM ({_COPIES})")
def _(spark):
    return dedup.conflicts(spark.table("units").withColumn("h", F.md5("code")), "h", "engine").select("h", "n", "conflict")


@query("a08_drop_accounting", f"SELECT sum(CASE WHEN conflict THEN n ELSE 0 END)::BIGINT AS conflicting, sum(CASE WHEN conflict THEN 0 ELSE n - 1 END)::BIGINT AS duplicates FROM ({_COPIES})")
def _(spark):
    c = dedup.conflicts(spark.table("units").withColumn("h", F.md5("code")), "h", "engine")
    return c.agg(F.sum(F.when(F.col("conflict"), F.col("dropped")).otherwise(0)).alias("conflicting"), F.sum(F.when(~F.col("conflict"), F.col("dropped")).otherwise(0)).alias("duplicates"))


@query("w01_keep_first", "SELECT min(doc_id) AS doc_id FROM units GROUP BY md5(code) HAVING min(lang) = max(lang)")
def _(spark):
    return dedup.first_of(spark.table("units").withColumn("h", F.md5("code")), "h", "lang", ["doc_id"]).select("doc_id")


_TP = "(g_low AND p_low)::INT + (g_tox AND p_tox)::INT"
_FP = "(NOT g_low AND p_low)::INT + (NOT g_tox AND p_tox)::INT + p_odd::INT"
_FN = "(g_low AND NOT p_low)::INT + (g_tox AND NOT p_tox)::INT"
_ANY_G, _ANY_P = "(g_low OR g_tox)", "(p_low OR p_tox OR p_odd)"
MICRO = f"""count(*) AS n, sum({_TP})::BIGINT AS tp, sum({_FP})::BIGINT AS fp, sum({_FN})::BIGINT AS fn,
avg((g_low = p_low AND g_tox = p_tox AND NOT p_odd)::INT) AS exact, avg(valid::INT) AS valid_rate, count_if({_ANY_G} AND {_ANY_P}) AS b_tp,
count_if(NOT {_ANY_G} AND {_ANY_P}) AS b_fp, count_if({_ANY_G} AND NOT {_ANY_P}) AS b_fn, count_if(NOT {_ANY_G} AND NOT {_ANY_P}) AS b_tn"""
RATES = """CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 9) ELSE 0.0 END::DOUBLE AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 9) ELSE 0.0 END::DOUBLE AS recall,
CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) ELSE 0.0 END::DOUBLE AS f1"""


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 9) for c in names})


@query("a09_micro_counts", f"SELECT tp, fp, fn, {RATES} FROM (SELECT {MICRO} FROM flags)")
def _(spark):
    return _rounded(metrics.micro(spark.table("preds")).select("tp", "fp", "fn", "precision", "recall", "f1"), "precision", "recall", "f1")


_PER = """SELECT 'low_quality' AS label, g_low AS g, p_low AS p, doc_id, n_tokens FROM flags UNION ALL SELECT 'toxic', g_tox, p_tox, doc_id, n_tokens FROM flags UNION ALL SELECT 'odd', false, p_odd, doc_id, n_tokens FROM flags"""
_LABELS = f"SELECT label, count_if(g AND p) AS tp, count_if(NOT g AND p) AS fp, count_if(g AND NOT p) AS fn, count_if(g) AS support, count_if(p) AS predicted FROM ({_PER}) WHERE g OR p GROUP BY label"


@query("a10_per_label", f"SELECT label, tp, fp, fn, support, predicted, {RATES} FROM ({_LABELS})")
def _(spark):
    return _rounded(metrics.per_label(spark.table("preds")), "precision", "recall", "f1")


@query("a11_binary_confusion", f"SELECT b_tp, b_fp, b_fn, b_tn FROM (SELECT {MICRO} FROM flags)")
def _(spark):
    return metrics.micro(spark.table("preds")).select("b_tp", "b_fp", "b_fn", "b_tn")


@query("a12_zero_denominator", f"SELECT engine, tp, fp, fn, {RATES} FROM (SELECT engine, {MICRO} FROM flags GROUP BY engine)")
def _(spark):
    return _rounded(metrics.micro(spark.table("preds"), "engine").select("engine", "tp", "fp", "fn", "precision", "recall", "f1"), "precision", "recall", "f1")


@query("a13_macro_f1", f"SELECT round(avg(2 * tp / greatest(2 * tp + fp + fn, 1)::DOUBLE), 9) AS macro_f1 FROM ({_LABELS}) WHERE support > 0")
def _(spark):
    return _rounded(metrics.macro(spark.table("preds")), "macro_f1")


@query("a14_exact_rates", f"SELECT n, round(exact, 9) AS exact, round(valid_rate, 9) AS valid_rate, round((b_tp + b_tn) / n::DOUBLE, 9) AS accuracy FROM (SELECT {MICRO} FROM flags)")
def _(spark):
    return _rounded(metrics.micro(spark.table("preds")).select("n", "exact", "valid_rate", "accuracy"), "exact", "valid_rate", "accuracy")


_SYSTEMS = "SELECT 'rule' AS system, * FROM flags UNION ALL SELECT 'clean', doc_id, engine, split, n_tokens, true, g_low, g_tox, false, false, false FROM flags UNION ALL SELECT 'long', doc_id, engine, split, n_tokens, true, g_low, g_tox, n_tokens < 700, false, false FROM flags"


@query("a15_metric_grid", f"SELECT subset, system, n, tp, fp, fn, round(exact, 9) AS exact, {RATES} FROM (SELECT subset, system, {MICRO} FROM (SELECT 'all' AS subset, * FROM ({_SYSTEMS}) UNION ALL SELECT 'matched', * FROM ({_SYSTEMS}) WHERE n_tokens BETWEEN 500 AND 3000) GROUP BY subset, system)")
def _(spark):
    p = spark.table("preds")
    none = F.array().cast("array<string>")
    systems = p.withColumn("system", F.lit("rule")).unionByName(p.withColumns({"system": F.lit("clean"), "pred": none, "valid": F.lit(True)})).unionByName(p.withColumns({"system": F.lit("long"), "pred": F.when(F.col("n_tokens") < 700, F.array(F.lit("low_quality"))).otherwise(none), "valid": F.lit(True)}))
    subsets = systems.withColumn("subset", F.explode(F.when(F.col("n_tokens").between(500, 3000), F.array(F.lit("all"), F.lit("matched"))).otherwise(F.array(F.lit("all")))))
    return _rounded(metrics.micro(subsets, "subset", "system").select("subset", "system", "n", "tp", "fp", "fn", "exact", "precision", "recall", "f1"), "exact", "precision", "recall", "f1")


plan("a16_percentiles", "SELECT split, round(p[0], 6) AS p25, round(p[1], 6) AS p50, round(p[2], 6) AS p90 FROM (SELECT split, percentile(n_tokens, array(0.25, 0.5, 0.9)) AS p FROM units GROUP BY split)", "SELECT split, round(quantile_cont(n_tokens, 0.25), 6) AS p25, round(quantile_cont(n_tokens, 0.5), 6) AS p50, round(quantile_cont(n_tokens, 0.9), 6) AS p90 FROM units GROUP BY split")


@query("a17_nearest_rank", "SELECT split, min(n_tokens) AS least, max(n_tokens) AS most, round(avg(n_tokens), 2) AS mean, " + ", ".join(f"quantile_disc(n_tokens, {p})::DOUBLE AS p{round(100 * p)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM units GROUP BY split")
def _(spark):
    out = metrics.nearest_rank(spark.table("units"), "n_tokens", "split")
    return out.withColumns({c: F.col(c).cast("double") for c in out.columns if c.startswith("p")})


_SUMMARY = "SELECT split, count(*) AS n, count(DISTINCT engine) AS engines, count(DISTINCT md5(code)) AS texts, count(*) - count(DISTINCT md5(code)) AS duplicates, count_if(low) AS low, count_if(tox) AS tox, count_if(labelled) AS labelled, count_if(low AND tox) AS several, min(n_tokens) AS least, max(n_tokens) AS most, {total} AS total, count_if(lang = 'en') AS english, count_if(n_tokens > 2000) AS long_rows, {p50} AS p50, {p90} AS p90 FROM units GROUP BY split"
plan("a18_split_summary", _SUMMARY.format(total="sum(n_tokens)", p50="percentile(n_tokens, 0.5)", p90="percentile(n_tokens, 0.9)"), _SUMMARY.format(total="sum(n_tokens)::BIGINT", p50="quantile_cont(n_tokens, 0.5)", p90="quantile_cont(n_tokens, 0.9)"))
plan("a19_duplicate_counts", "SELECT split, count(*) - count(DISTINCT md5(code)) AS duplicates FROM units GROUP BY split")
plan("a20_group_in_one_split", "SELECT count_if(k > 1) AS spanning, count(*) AS groups FROM (SELECT md5(code) AS h, count(DISTINCT split) AS k FROM units GROUP BY md5(code))")
plan("a21_vocabulary_overlap", "SELECT split, count_if(p_low OR p_tox) AS any_known, count_if(p_odd AND NOT p_low AND NOT p_tox) AS only_unknown FROM flags GROUP BY split")


@query("a22_wilson", "SELECT engine, k, n, round(greatest((k / n::DOUBLE + z2 / (2 * n)) / (1 + z2 / n) - h, 0), 9) AS low, round(least((k / n::DOUBLE + z2 / (2 * n)) / (1 + z2 / n) + h, 1), 9) AS high FROM (SELECT *, 1.959963984540054::DOUBLE * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + z2 / (4 * n * n)) / (1 + z2 / n) AS h FROM (SELECT engine, count_if(low) AS k, count(*) AS n, 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE AS z2 FROM units GROUP BY engine))")
def _(spark):
    rows = spark.table("units").groupBy("engine").agg(F.count_if("low").alias("k"), F.count("*").alias("n"))
    return _rounded(rows.withColumns(metrics.wilson(F.col("k"), F.col("n"))), "low", "high")


plan("a23_rate", "SELECT system, CASE WHEN count(*) > 0 THEN round(avg(CASE WHEN coalesce(passed, false) THEN 1.0D ELSE 0.0D END), 4) END AS rate FROM repairs GROUP BY system", "SELECT system, CASE WHEN count(*) > 0 THEN round(avg(CASE WHEN coalesce(passed, false) THEN 1.0 ELSE 0.0 END), 4) END AS rate FROM repairs GROUP BY system")
plan("a24_grouped_passes", "SELECT engine, want, count(*) AS n, count_if(passed) AS passed FROM repairs GROUP BY engine, want")
_TARGETS = "SELECT status, count(*) AS targets, count_if(remaining IS NULL OR remaining <> target) AS recalled FROM (SELECT CASE WHEN truncated THEN 'truncated' WHEN passed THEN 'passed' ELSE 'failed' END AS status, {each} AS target, remaining FROM repairs WHERE system = 'adapter') GROUP BY status"
plan("a25_pipeline_summary", _TARGETS.format(each="explode(array(want, 'size-long-line'))"), _TARGETS.format(each="unnest([want, 'size-long-line'])"))
plan("a26_tool_summary", "SELECT system, count_if(truncated) AS truncated, count_if(more_errors) AS errors, round(sum(seconds), 3) AS total, round(avg(seconds), 6) AS mean FROM (SELECT system, truncated, more_errors, cast(seconds AS double) AS seconds FROM repairs) GROUP BY system")
_CATEGORY = "CASE WHEN truncated THEN 'truncated generation' END", "CASE WHEN remaining IS NOT NULL THEN 'requested findings remain' END", "CASE WHEN new_warning THEN 'new enabled warnings' END", "CASE WHEN more_errors THEN 'new compiler errors' END"
_NONE = "CASE WHEN NOT truncated AND remaining IS NULL AND NOT new_warning AND NOT more_errors AND NOT passed THEN 'not validated' END"
plan("a27_failure_categories", f"SELECT system, category, count(*) AS n FROM (SELECT system, explode(array_compact(array({', '.join(_CATEGORY)}, {_NONE}))) AS category FROM repairs) GROUP BY system, category", "SELECT system, category, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT system, {c} AS category FROM repairs" for c in (*_CATEGORY, _NONE)) + ") WHERE category IS NOT NULL GROUP BY system, category")
plan("a28_majority_share", "SELECT engine, lang, n, round(n / cast(total AS double), 9) AS share FROM (SELECT engine, lang, n, sum(n) OVER (PARTITION BY engine) AS total, row_number() OVER (PARTITION BY engine ORDER BY n DESC, lang) AS r FROM (SELECT engine, lang, count(*) AS n FROM units GROUP BY engine, lang)) WHERE r = 1")
_VISIBLE = (("shout", "!!"), ("bar", r"\|"), ("digits", "[0-9]{3}"), ("quoted", '"[^"]*"'))
_PATTERNS = " UNION ALL ".join(f"SELECT '{n}' AS name, '{r}' AS pattern" for n, r in _VISIBLE)
plan("a29_presence_rate", f"SELECT name, low, round(avg(CASE WHEN rlike(code, pattern) THEN 1.0D ELSE 0.0D END), 9) AS rate FROM units CROSS JOIN ({_PATTERNS.replace(chr(92), chr(92) * 2)}) WHERE labelled GROUP BY name, low", " UNION ALL ".join(f"SELECT '{n}' AS name, low, round(avg(CASE WHEN regexp_matches(code, '{r}') THEN 1.0 ELSE 0.0 END), 9) AS rate FROM units WHERE labelled GROUP BY low" for n, r in _VISIBLE))


@query("a30_on_line_rate", "SELECT f.\"check\" AS chk, count(*) AS n, count_if(regexp_matches(l.line, CASE WHEN f.\"check\" = 'style-shout' THEN '!!' ELSE '[Ll]icen[sc]e' END)) AS hit, count_if(contains(l.line, f.message)) AS named FROM findings f JOIN lines l ON f.doc_id = l.doc_id AND f.line_no = l.line_no GROUP BY f.\"check\"")
def _(spark):
    """How often a check's own pattern, and what its message quotes, stand on the line of the finding; quotes are taken literally."""
    own = spark.table("findings").groupBy("doc_id").agg(F.collect_list(F.struct("check", "line_no", "message")).alias("fs"))
    rows = own.join(spark.table("documents").select("doc_id", "text"), "doc_id").select(F.inline("fs"), "text")
    line = F.element_at(F.split("text", "\n", -1), F.col("line_no").cast("int"))
    pattern = F.when(F.col("check") == "style-shout", "!!").otherwise("[Ll]icen[sc]e")
    quoted = F.concat(F.lit(r"\Q"), F.replace("message", F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    return rows.groupBy(F.col("check").alias("chk")).agg(F.count("*").alias("n"), F.count_if(F.regexp_like(line, pattern)).alias("hit"), F.count_if(F.regexp_like(line, quoted)).alias("named"))


plan("a31_bounded_examples", "SELECT chk, doc_id, o FROM (SELECT check AS chk, doc_id, o, row_number() OVER (PARTITION BY check ORDER BY doc_id, o) AS r FROM findings) WHERE r <= 2", "SELECT chk, doc_id, o FROM (SELECT \"check\" AS chk, doc_id, o, row_number() OVER (PARTITION BY \"check\" ORDER BY doc_id, o) AS r FROM findings) WHERE r <= 2")
plan("a32_truncation_survival", "SELECT lim, sum(greatest(least(lim - (n_tokens - 100), 100), 0)) AS kept FROM units CROSS JOIN (SELECT 500 AS lim UNION ALL SELECT 1000 UNION ALL SELECT 4000) GROUP BY lim", "SELECT lim, sum(greatest(least(lim - (n_tokens - 100), 100), 0))::BIGINT AS kept FROM units CROSS JOIN (SELECT 500 AS lim UNION ALL SELECT 1000 UNION ALL SELECT 4000) GROUP BY lim")
plan("a33_ratio_of_sums", "SELECT split, round(sum(least(n_tokens, 500)) / cast(sum(n_tokens) AS double), 9) AS share FROM units GROUP BY split", "SELECT split, round(sum(least(n_tokens, 500)) / sum(n_tokens)::DOUBLE, 9) AS share FROM units GROUP BY split")
_KEYS = "SELECT 'keys' AS part, keys AS value, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, {join} AS keys FROM events) GROUP BY keys UNION ALL SELECT 'label', event_type, count(*), min(event_id) FROM events GROUP BY event_type"
plan("a34_key_histogram", _KEYS.format(join="array_join(array_sort(json_object_keys(props)), ',')"), _KEYS.format(join="array_to_string(list_sort(json_keys(props)), ',')"))
_AUDITED = "SELECT doc_id, checks, concat('{\"smells\": [\"', array_join(checks, ', '), '\"], \"severity\": ', doc_id % 100, ', \"location\": \"', CASE WHEN doc_id % 4 = 0 THEN 'file' WHEN doc_id % 4 = 1 THEN 'line' ELSE 'function' END, '\", \"explanation\": \"x-a, x-b, x-', doc_id % 3, '\"}') AS answer FROM units"
_SEVERITY = "(doc_id % 100) // 20"


@query("a35_label_audit", f"""SELECT 'smelly' AS part, CASE WHEN doc_id % 3 = 0 THEN 'gap' ELSE 'full' END AS value, count(*) AS n FROM units WHERE len(checks) > 0 GROUP BY ALL
UNION ALL SELECT 'severity', ({_SEVERITY})::VARCHAR, count(*) FROM units GROUP BY ALL
UNION ALL SELECT 'location', CASE WHEN doc_id % 4 = 0 THEN 'file' WHEN doc_id % 4 = 1 THEN 'line' ELSE 'function' END, count(*) FROM units GROUP BY ALL
UNION ALL SELECT 'atom', a, count(*) FROM (SELECT unnest(checks) AS a FROM units) GROUP BY a
UNION ALL SELECT 'check', c, count(*) FROM (SELECT unnest(list_concat(['x-a', 'x-b'], ['x-' || doc_id % 3])) AS c FROM units) GROUP BY c""")
def _(spark):
    """Histograms of what labelled answers say: smelly full or gap rows, severity by twenties, location, checks, single categories."""
    field = lambda k: F.get_json_object("answer", f"$.{k}")
    parts = lambda c: F.filter(F.transform(F.split(c, ",", -1), lambda x: F.btrim(x)), lambda x: x != "")
    smells = F.flatten(F.transform(F.from_json(field("smells"), "array<string>"), parts))
    one = lambda part, v: F.struct(F.lit(part).alias("part"), v.alias("value"))
    smelly = F.when(F.size(smells) > 0, F.when(F.col("doc_id") % 3 == 0, "gap").otherwise("full"))
    said = F.concat(F.array(one("smelly", smelly), one("severity", F.floor(field("severity").cast("int") / 20).cast("string")), one("location", field("location"))), F.transform(smells, lambda x: one("atom", x)), F.transform(parts(field("explanation")), lambda x: one("check", x)))
    return spark.sql(_AUDITED).select(F.inline(said)).where(F.col("value").isNotNull()).groupBy("part", "value").agg(F.count("*").alias("n"))


_NORM = lambda c: f"trim(regexp_replace({c}, '[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"
_RATIO = "2.0::DOUBLE * list_sum(list_transform(list_distinct(string_split(a, '')), lambda x: CASE WHEN x = '' THEN 0 ELSE least(length(a) - length(replace(a, x, '')), length(b) - length(replace(b, x, ''))) END)) / (length(a) + length(b))"


@query("a36_target_audit", f"""WITH p AS (SELECT {_NORM('x.text')} AS x, {_NORM('y.text')} AS y, left(x.text, 3000) AS a, left(y.text, 3000) AS b FROM documents x JOIN documents y ON x.doc_id + 1 = y.doc_id),
k AS (SELECT CASE WHEN x = y THEN 'unchanged' WHEN contains(y, left(x, 400)) THEN 'contains the input' ELSE 'rewritten' END AS kind, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE {_RATIO} END AS r FROM p)
SELECT kind, count(*) AS n, {", ".join(f"round(quantile_cont(r, {d / 10}), 9) AS d{d}" for d in range(1, 10))} FROM k GROUP BY kind""")
def _(spark):
    """Each document with the next one as its target: what kind of target it is, and deciles of their similarity."""
    d = spark.table("documents")
    pairs = d.select("doc_id", F.col("text").alias("a")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b")), "doc_id")
    x, y = T.normalised(F.col("a")), T.normalised(F.col("b"))
    kind = F.when(x == y, "unchanged").when(F.contains(y, F.left(x, F.lit(400))), "contains the input").otherwise("rewritten")
    rows = pairs.select(kind.alias("kind"), T.quick_ratio(F.col("a"), F.col("b")).alias("r")).groupBy("kind").agg(F.count("*").alias("n"), F.percentile("r", F.array(*(F.lit(k / 10) for k in range(1, 10)))).alias("d"))
    return rows.select("kind", "n", *(F.round(F.get("d", k - 1), 9).alias(f"d{k}") for k in range(1, 10)))


#: Files, some names in two directories; and what source files include, with repeats.
_TREE = "SELECT concat('d', n_regionkey, '/', n_name, '.h') AS path FROM nation UNION ALL SELECT concat('e', n_regionkey, '/sub/', n_name, '.h') FROM nation WHERE n_nationkey % 3 = 0"
_INCLUDES = "SELECT concat('s', s_suppkey) AS file, CASE s_suppkey % 4 WHEN 0 THEN concat(n_name, '.h') WHEN 1 THEN concat('sub/', n_name, '.h') WHEN 2 THEN concat('d', n_regionkey, '/', lower(n_name), '.H') ELSE 'none.h' END AS inc FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT concat('s', s_suppkey), concat(n_name, '.h') FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 8 = 0"
_VOTES = "WITH t AS ({tree}), i AS (SELECT DISTINCT file, inc FROM ({includes})), c AS (SELECT file, inc, path, count(*) OVER (PARTITION BY file, inc) AS k FROM i JOIN t ON {base}(lower(inc)) = {base}(lower(path)) AND {ends}(concat('/', lower(path)), concat('/', lower(inc)))) SELECT target, round(sum(1.0 / k), 6) AS votes FROM (SELECT {trim} AS target, cast(k AS double) AS k FROM c WHERE contains(inc, '/') OR k = 1) GROUP BY target"
_STRIPPED = "regexp_replace(left(path, length(path) - length(inc)), '/+$', '')"


def _votes(base: str, ends: str) -> str:
    sql = _VOTES.replace("{tree}", _TREE).replace("{includes}", _INCLUDES).replace("{ends}", ends).replace("{trim}", _STRIPPED)
    return sql.replace("{base}(lower(inc))", base.format("lower(inc)")).replace("{base}(lower(path))", base.format("lower(path)"))


plan("a37_fractional_votes", _votes("substring_index({}, '/', -1)", "endswith"), _votes("string_split({}, '/')[-1]", "ends_with"))
plan("a38_occurrences", "SELECT message, count(*) AS n FROM findings GROUP BY message HAVING count(*) >= 3")
plan("a38_per_record", "SELECT word, count(*) AS n FROM (SELECT DISTINCT p_partkey, word FROM (SELECT p_partkey, explode(split(p_name, ' ')) AS word FROM part)) GROUP BY word HAVING count(*) >= greatest(2, 0.15D * (SELECT count(*) FROM part))", "SELECT word, count(*) AS n FROM (SELECT DISTINCT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)) GROUP BY word HAVING count(*) >= greatest(2, 0.15 * (SELECT count(*) FROM part))")
plan("a39_yield", "SELECT sum(n) AS n FROM (SELECT doc_id, count_if(check LIKE 'size-%') AS n, count_if(check LIKE 'legal-%') AS bad FROM findings GROUP BY doc_id) WHERE bad = 0", "SELECT sum(n)::BIGINT AS n FROM (SELECT doc_id, count_if(\"check\" LIKE 'size-%') AS n, count_if(\"check\" LIKE 'legal-%') AS bad FROM findings GROUP BY doc_id) WHERE bad = 0")
_NOTES = "concat(p_size, ' lines including whitespace')", "concat(p_partkey % 9, ' branches')", "concat('nesting level ', p_partkey % 4 + 1, ' starts here')", "concat('nesting level ', p_partkey % 3 + 2, ' starts here')", "concat('see ', p_name)"


@query("a40_metric_extraction", "SELECT p_partkey, p_size::INTEGER AS lines, (p_partkey % 9)::INTEGER AS branches, greatest(p_partkey % 4 + 1, p_partkey % 3 + 2)::INTEGER AS nesting FROM part")
def _(spark):
    """Metrics told by notes: counts by their names, and the deepest nesting."""
    notes = spark.table("part").select("p_partkey", F.array(*map(F.expr, _NOTES)).alias("notes"))
    told = F.filter(F.transform("notes", lambda x: F.struct(F.regexp_extract(x, r"^[0-9]+ ([a-z]+)", 1).alias("key"), F.regexp_extract(x, r"^([0-9]+) [a-z]+", 1).try_cast("int").alias("value"))), lambda e: e["key"] != "")
    deep = F.array_max(F.transform("notes", lambda x: F.regexp_extract(x, r"^nesting level ([0-9]+)", 1).try_cast("int")))
    found = F.map_from_entries(told)
    return notes.select("p_partkey", F.element_at(found, "lines").alias("lines"), F.element_at(found, "branches").alias("branches"), deep.alias("nesting"))


plan("a41_scan_summary", "SELECT status, count(*) AS n, count(DISTINCT path) AS paths FROM scanlog GROUP BY status")
plan("a42_argmax_first", "SELECT engine FROM (SELECT engine, count(*) AS n FROM units GROUP BY engine) ORDER BY n DESC, engine LIMIT 1")
plan("a43_weighted_mean", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean FROM lineitem GROUP BY l_returnflag")
plan("a44_min_by", "SELECT l_returnflag, l_linenumber AS epoch FROM (SELECT l_returnflag, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY v, l_linenumber) AS r FROM (SELECT l_returnflag, l_linenumber, min(l_extendedprice) AS v FROM lineitem GROUP BY l_returnflag, l_linenumber)) WHERE r = 1")

_LEGACY = "SELECT doc_id, CASE WHEN valid THEN g_low ELSE false END AS g_low, CASE WHEN valid THEN g_tox ELSE false END AS g_tox, p_low, p_tox FROM flags"


_TYPED = " UNION ALL ".join(f"SELECT '{label}' AS label, {g} AS g, {p} AS p FROM ({_LEGACY})" for label, g, p in (("low_quality", "g_low", "p_low"), ("toxic", "g_tox", "p_tox"), ("never", "false", "false")))
_TYPES = f"SELECT label, count_if(g AND p) AS tp, count_if(NOT g AND p) AS fp, count_if(g AND NOT p) AS fn FROM ({_TYPED}) GROUP BY label"


@query("a45_legacy_scores", f"SELECT *, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0.0 END, 9) AS f1, (SELECT round(avg(2 * tp / (2 * tp + fp + fn)::DOUBLE), 9) FROM ({_TYPES}) WHERE tp + fp + fn > 0) AS mean_f1 FROM ({_TYPES})")
def _(spark):
    """Either side invalid: both sets are empty; every fixed type is scored, whether it occurs or not. The mean takes those with any hit or miss."""
    none = F.array().cast("array<string>")
    rows = spark.table("preds").select(F.when(F.col("valid"), F.col("gold")).otherwise(none).alias("gold"), F.when(F.col("valid"), F.col("pred")).otherwise(none).alias("pred"))
    flags = rows.select("gold", "pred", F.explode(F.array(*map(F.lit, ("low_quality", "toxic", "never")))).alias("label"))
    g, p = F.array_contains("gold", F.col("label")), F.array_contains("pred", F.col("label"))
    sums = flags.groupBy("label").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    off = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    scored = sums.withColumn("f1", F.when(off > 0, F.round(2 * F.col("tp") / off, 9)).otherwise(0.0))
    mean = sums.where(off > 0).agg(F.round(F.avg(2 * F.col("tp") / off), 9).alias("mean_f1"))  # one row
    return scored.crossJoin(F.broadcast(mean))


_PAIRS = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('so ', p_name) WHEN 1 THEN '{"fixed_code": "", "explanations": [],}' ELSE concat('{"fixed_code": "', p_name, '", "explanations": [{"smell_type": "', p_brand, '"}, {"smell_type": "b"}]}') END AS predicted,
CASE WHEN p_partkey % 7 = 0 THEN '{' WHEN p_partkey % 6 = 2 THEN concat('{"fixed_code": "', p_type, '", "explanations": []}') ELSE concat('{"fixed_code": "', p_name, ' ', p_type, '", "explanations": [{"smell_type": "', p_brand, '"}, {"smell_type": "c"}]}') END AS gold FROM part"""
_TOKENS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '\\w+'))"
_LEGACY_SQL = f"""SELECT round(avg((p_partkey % 6 > 0)::INT), 9) AS json_validity, round(avg(CASE WHEN sound THEN CASE WHEN k = 2 THEN 0.0 WHEN k = 1 THEN 0.0 ELSE 0.5 END ELSE 0.0 END), 9) AS avg_explanation_match,
round(avg(CASE WHEN sound AND k <> 1 THEN len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) ELSE 0.0 END), 9) AS avg_ast_similarity, count_if(NOT (sound AND k = 1)) AS n_scored
FROM (SELECT p_partkey, p_partkey % 6 AS k, p_partkey % 6 > 0 AND p_partkey % 7 > 0 AS sound, {_TOKENS('p_name')} AS x, {_TOKENS("CASE WHEN p_partkey % 6 = 2 THEN p_type ELSE p_name || ' ' || p_type END")} AS y FROM part)"""


@query("a46_legacy_fixing", _LEGACY_SQL)
def _(spark):
    return _rounded(metrics.legacy_fixing(spark.sql(_PAIRS), "predicted", "gold").select("json_validity", "avg_explanation_match", "avg_ast_similarity", "n_scored"), "json_validity", "avg_explanation_match", "avg_ast_similarity")


@query("a46_legacy_overlap")
def _(spark):
    """The means of BLEU and ROUGE-L, which SQL cannot state; tests hold both scores against plain ones."""
    return metrics.legacy_fixing(spark.sql(_PAIRS), "predicted", "gold").select("n_scored", "avg_bleu", "avg_rouge")


_ERRORS = "SELECT o_orderkey, o_custkey % 101 AS gold, (o_orderkey * 7) % 101 AS pred, abs(o_custkey % 101 - (o_orderkey * 7) % 101) AS e FROM orders"
_WITHIN = "SELECT 'exact' AS name, count_if(e = 0) AS n FROM ({0}) UNION ALL SELECT 'within 5', count_if(e <= 5) FROM ({0}) UNION ALL SELECT 'within 10', count_if(e <= 10) FROM ({0}) UNION ALL SELECT 'same range', count_if({1} = {2}) FROM ({0}) UNION ALL (SELECT concat('error of ', o_orderkey), e FROM ({0}) ORDER BY e DESC, o_orderkey LIMIT 5)"
plan("a47_severity_accuracy", _WITHIN.format(_ERRORS, "gold div 20", "pred div 20"), _WITHIN.format(_ERRORS, "gold // 20", "pred // 20"))


@query("a48_weighted_average", "SELECT " + ", ".join(f"round(sum({c} * support) / sum(support), 6) AS {c}" for c in ("precision", "recall", "f1")) + f" FROM (SELECT support, {RATES} FROM ({_LABELS}))")
def _(spark):
    """Means over labels, weighted by how often each occurs."""
    rows = metrics.per_label(spark.table("preds"))
    return rows.agg(*(F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 6).alias(c) for c in ("precision", "recall", "f1")))


@query("a49_pivot", "SELECT engine, count_if(system = 'adapter' AND passed) AS adapter, count_if(system = 'base' AND passed) AS base, count_if(system = 'tool' AND passed) AS tool FROM repairs GROUP BY engine")
def _(spark):
    return spark.table("repairs").groupBy("engine").pivot("system", ["adapter", "base", "tool"]).agg(F.count_if("passed"))


plan("a50_cases", "SELECT system, count(*) AS cases, count_if(NOT more_errors) AS compiled, count_if(passed) AS passed FROM repairs GROUP BY system")
plan("a51_share_within", "SELECT lim, round(avg(CASE WHEN n_tokens <= lim THEN 1.0D ELSE 0.0D END), 9) AS all_rows, round(avg(CASE WHEN low THEN CASE WHEN n_tokens <= lim THEN 1.0D ELSE 0.0D END END), 9) AS smelly FROM units CROSS JOIN (SELECT 500 AS lim UNION ALL SELECT 1000 UNION ALL SELECT 2000 UNION ALL SELECT 4000 UNION ALL SELECT 8000) GROUP BY lim", "SELECT lim, round(avg(CASE WHEN n_tokens <= lim THEN 1.0 ELSE 0.0 END), 9) AS all_rows, round(avg(CASE WHEN low THEN CASE WHEN n_tokens <= lim THEN 1.0 ELSE 0.0 END END), 9) AS smelly FROM units CROSS JOIN (SELECT 500 AS lim UNION ALL SELECT 1000 UNION ALL SELECT 2000 UNION ALL SELECT 4000 UNION ALL SELECT 8000) GROUP BY lim")
plan("a52_share_by_bin", "SELECT bin, count(*) AS n, count_if(low) AS smelly FROM (SELECT floor(n_tokens / 1000) AS bin, low FROM units) GROUP BY bin", "SELECT bin, count(*) AS n, count_if(low) AS smelly FROM (SELECT floor(n_tokens / 1000)::BIGINT AS bin, low FROM units) GROUP BY bin")
plan("a53_fixed_vocabulary", "SELECT v.label, coalesce(c.n, 0) AS n FROM (SELECT 'low_quality' AS label UNION ALL SELECT 'toxic' UNION ALL SELECT 'never') v LEFT JOIN (SELECT label, count(*) AS n FROM (SELECT explode(gold) AS label FROM preds) GROUP BY label) c ON v.label = c.label", "SELECT v.label, coalesce(c.n, 0) AS n FROM (SELECT 'low_quality' AS label UNION ALL SELECT 'toxic' UNION ALL SELECT 'never') v LEFT JOIN (SELECT label, count(*) AS n FROM (SELECT unnest(gold) AS label FROM preds) GROUP BY label) c ON v.label = c.label")
plan("a54_nested_counts", "SELECT doc_id, chk, count(*) AS n FROM (SELECT doc_id, check AS chk FROM findings) GROUP BY doc_id, chk", "SELECT doc_id, \"check\" AS chk, count(*) AS n FROM findings GROUP BY doc_id, \"check\"")
plan("a55_sorted_set", "SELECT split, array_sort(collect_set(engine)) AS engines FROM units GROUP BY split", "SELECT split, list_sort(list(DISTINCT engine)) AS engines FROM units GROUP BY split")
_FIRST = "SELECT 'text' AS kind, round(avg(CASE WHEN valid THEN 1.0{d} ELSE 0.0{d} END), 9) AS rate FROM (SELECT valid FROM preds ORDER BY doc_id LIMIT 100) UNION ALL SELECT 'numbers', 0.5{d}"
plan("a56_first_hundred", _FIRST.format(d="D"), _FIRST.format(d="::DOUBLE"))
_FIXED = ("json_validity", "avg_explanation_match", "avg_ast_similarity")


@query("a57_composed_samples", f"""SELECT 'detection' AS part, label AS name, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0.0 END, 9) AS value FROM (SELECT label, count_if(g AND p) AS tp, count_if(NOT g AND p) AS fp, count_if(g AND NOT p) AS fn FROM (SELECT 'low_quality' AS label, g_low AS g, p_low AS p FROM ({_LEGACY}) UNION ALL SELECT 'toxic', g_tox, p_tox FROM ({_LEGACY})) GROUP BY label)
UNION ALL {" UNION ALL ".join(f"SELECT 'fixing', '{n}', {n} FROM ({_LEGACY_SQL})" for n in _FIXED)}
UNION ALL SELECT 'detection sample', doc_id::VARCHAR, len(pred)::DOUBLE FROM (SELECT doc_id, pred FROM preds ORDER BY doc_id LIMIT 3)
UNION ALL SELECT 'fixing sample', p_partkey::VARCHAR, length(p_name)::DOUBLE FROM (SELECT p_partkey, p_name FROM part WHERE p_partkey % 6 > 1 ORDER BY p_partkey LIMIT 3)""")
def _(spark):
    """The detection and fixing scores of one model, with three sample predictions of each kind."""
    none = F.array().cast("array<string>")
    rows = spark.table("preds").select(F.when(F.col("valid"), F.col("gold")).otherwise(none).alias("gold"), F.when(F.col("valid"), F.col("pred")).otherwise(none).alias("pred"))
    has = lambda side, label: F.array_contains(side, label)
    f1 = lambda label: (lambda tp, off: F.when(2 * tp + off > 0, 2 * tp / (2 * tp + off)).otherwise(0.0))(F.count_if(has("gold", label) & has("pred", label)), F.count_if(has("gold", label) != has("pred", label)))
    found = rows.agg(*(f1(label).alias(label) for label in ("low_quality", "toxic")))
    long = lambda df, part, names: df.select(F.inline(F.array(*(F.struct(F.lit(part).alias("part"), F.lit(n).alias("name"), F.round(F.col(n), 9).alias("value")) for n in names))))
    first = spark.table("preds").orderBy("doc_id").limit(3).select(F.lit("detection sample").alias("part"), F.col("doc_id").cast("string").alias("name"), F.size("pred").cast("double").alias("value"))
    fixed = F.length(F.get_json_object(lenient_json(F.col("predicted")), "$.fixed_code"))
    second = spark.sql(_PAIRS).where(fixed > 0).orderBy("p_partkey").limit(3).select(F.lit("fixing sample").alias("part"), F.col("p_partkey").cast("string").alias("name"), fixed.cast("double").alias("value"))
    return long(found, "detection", ("low_quality", "toxic")).union(long(metrics.legacy_fixing(spark.sql(_PAIRS), "predicted", "gold"), "fixing", _FIXED)).union(first).union(second)


@query("w03_line_windows", "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(code, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 12) AS ls FROM units) SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(len(ls) - 4, 1)), lambda i: md5(array_to_string(ls[i:i+5], chr(10))))))::BIGINT AS n FROM l")
def _(spark):
    lines = F.filter(F.transform(F.split("code", "\n", -1), lambda x: F.btrim(x)), lambda x: F.length(x) >= 12)
    return spark.table("units").select("doc_id", F.size(T.windows(lines, 6)).cast("bigint").alias("n"))
