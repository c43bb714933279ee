"""Groups, splits, gates and logs as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.functions.source import syntax_of
from loomstone.operators import dedup, gates, metrics, sample
from loomstone.plans.catalog import plan, query
from loomstone.streaming import log as stream

_LINES = "list_filter(list_transform(string_split(code, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 12)"


@query("g01_near_dup_components", f"""WITH RECURSIVE l AS (SELECT doc_id, {_LINES} AS ls FROM units),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ls[i:i+5], chr(10))) AS h FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 4)) AS i FROM l WHERE len(ls) > 5)),
e AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id),
reach(a, b) AS (SELECT x, y FROM e UNION SELECT reach.a, e.y FROM reach JOIN e ON reach.b = e.x)
SELECT u.doc_id, dense_rank() OVER (ORDER BY least(u.doc_id, coalesce(r.b, u.doc_id))) - 1 AS "group" FROM units u LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = u.doc_id""")
def _(spark):
    lines = F.filter(F.transform(F.split("code", "\n", -1), lambda x: F.btrim(x)), lambda x: F.length(x) >= 12)
    return dedup.shared_groups(spark.table("units").select("doc_id", T.windows(lines, 6).alias("w")), "doc_id", "w")


@query("g01_comment_aware_windows")
def _(spark):
    return dedup.shared_groups(spark.table("units").select("doc_id", T.windows(T.code_lines(F.col("code")), 6).alias("w")), "doc_id", "w")


@query("g02_group_splits")
def _(spark):
    sizes = spark.table("units").groupBy(F.md5("code").alias("g")).agg(F.count("*").alias("n"))
    return sample.group_splits(sizes, "g", "n", {"train": 0.8, "val": 0.1, "test": 0.1}, 2)


@query("g03_entity_split", "SELECT doc_id, split FROM units")
def _(spark):
    return spark.table("documents").select("doc_id", sample.entity_split(F.col("source"), {"val": ["src17"], "test": ["src18", "src19"]}).alias("split"))


_SPLIT_OF = {"src17": "val", "src18": "test"}
_BUILT = """SELECT doc_id AS id, engine, split, n_tokens, checks, doc_id % 50 <> 0 AS file_error_free, 3L AS start_line, 3 + doc_id % 40 AS end_line,
transform(checks, c -> named_struct('check', CASE WHEN doc_id % 31 = 0 THEN 'odd' ELSE c END, 'line', 1 + doc_id % 41)) AS findings,
array(named_struct('role', 'system', 'content', CASE WHEN doc_id % 43 = 0 THEN 'Report!' ELSE 'Report.' END), named_struct('role', 'user', 'content', concat('Find:\n\n', code)),
named_struct('role', CASE WHEN doc_id % 53 = 0 THEN 'user' ELSE 'assistant' END, 'content', concat('{"checks": [', array_join(transform(CASE WHEN doc_id % 37 = 0 THEN reverse(checks) ELSE checks END, c -> concat('"', c, '"')), ', '), ']}'))) AS messages FROM units"""
_FIXING = "SELECT id, engine, split, n_tokens, CASE WHEN id % 5 = 0 THEN slice(checks, 1, 0) ELSE array('style-shout') END AS fixed_checks, array(messages[0], messages[1], named_struct('role', 'assistant', 'content', replace(substring(messages[1].content, 8), '!!', ''))) AS messages FROM built WHERE id % 2 = 0"
_LABELLED = "CASE WHEN engine = 'src17' THEN 'val' WHEN engine = 'src18' THEN 'test' ELSE 'train' END"
_NORMAL = lambda c: f"trim(regexp_replace({c}, '[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"


def _report(*checks: tuple[str, str, str]) -> str:
    """(name, count of violations, its table) as SQL."""
    return " UNION ALL ".join(f"SELECT '{name}' AS name, n = 0 AS ok, n::BIGINT::VARCHAR AS detail FROM (SELECT {count} AS n FROM {table})" for name, count, table in checks)


_HALF = lambda split, positive: f"abs(2 * count_if({positive}) - count(*)) + {int(split == 'test')}"


@query("q01_verify_built", _report(
    ("rows in every split", "3 - count(DISTINCT split)", "units"),
    ("answers are JSON with sorted and known checks", "count_if((len(checks) > 1 AND doc_id % 37 = 0) OR doc_id % 53 = 0)", "units"),
    ("one prompt throughout", "count(DISTINCT doc_id % 43 = 0) - 1", "units"),
    ("no markers inside the code", "count_if(contains(code, '@') OR contains(code, 'License'))", "units"),
    ("rows are in the split of their entity", f"count_if(split <> {_LABELLED})", "units"),
    ("evaluation rows come from clean files", "count_if(split <> 'train' AND doc_id % 50 = 0)", "units"),
    ("findings lie inside their function", "count_if(len(checks) > 0 AND doc_id % 41 > doc_id % 40)", "units"),
    ("findings are among the checks", "count_if(len(checks) > 0 AND doc_id % 31 = 0)", "units"),
    ("token counts are fresh", "count_if(n_tokens <> length(code))", "units"),
    ("conversations fit", "count_if(n_tokens > 4000)", "units"),
    ("fixing rows are in the split of their entity", f"count_if(split <> {_LABELLED})", "units WHERE doc_id % 2 = 0"),
    ("fixing conversations fit", "count_if(n_tokens > 4000)", "units WHERE doc_id % 2 = 0"),
    ("targets differ from inputs", f"count_if({_NORMAL('code')} = {_NORMAL(chr(114) + 'eplace(code, ' + chr(39) + '!!' + chr(39) + ', ' + chr(39) * 2 + ')')})", "units WHERE doc_id % 2 = 0"),
    ("fixing rows name what was fixed", "count_if(doc_id % 5 = 0)", "units WHERE doc_id % 2 = 0"),
    ("no code appears twice", f"count(*) - count(DISTINCT md5({_NORMAL('code')}))", "units"),
    ("ids are unique", "0", "(SELECT 1)"),
    ("no entity in two splits", "0", "(SELECT 1)"),
    ("val subset is balanced", _HALF("val", "len(checks) > 0"), "units WHERE split = 'val' AND doc_id % 3 = 0"),
    ("test subset is balanced", _HALF("test", "len(checks) > 0"), "units WHERE split = 'test' AND doc_id % 3 = 0 OR doc_id = (SELECT min(doc_id) FROM units WHERE split = 'train')"),
))
def _(spark):
    built = spark.sql(_BUILT)
    built.createOrReplaceTempView("built")
    train = built.where("split = 'train'")
    stray = train.join(F.broadcast(train.agg(F.min("id").alias("least"))), F.col("id") == F.col("least"), "left_semi")
    matched = {"val": built.where("split = 'val' AND id % 3 = 0"), "test": built.where("split = 'test' AND id % 3 = 0").unionByName(stray)}
    code = lambda user: F.substr(user, F.lit(8))
    return gates.verify_built(built, spark.sql(_FIXING), matched, code, ["low_quality", "toxic"], _SPLIT_OF, ["@", "License"], 4000, F.length(code(F.get("messages", 1)["content"])))


_CLEANED = """SELECT doc_id AS id, md5(code) AS `group`, split, checks AS smells, CASE WHEN size(checks) = 0 AND doc_id % 9 > 0 THEN 0L ELSE doc_id % 100 END AS severity, CASE WHEN doc_id % 41 = 0 THEN array('a-b') ELSE transform(checks, c -> concat('x-', c)) END AS checks, n_tokens,
array(named_struct('role', 'system', 'content', 'Report.'), named_struct('role', CASE WHEN doc_id % 59 = 0 THEN 'system' ELSE 'user' END, 'content', concat('Find:\n\n', replace(code, '. ', CASE WHEN doc_id % 61 = 0 THEN '>#include ' ELSE '. ' END)))) AS said FROM units"""
_ANSWERED = """SELECT id, `group`, split, smells, severity, checks, n_tokens, array_append(said, named_struct('role', 'assistant', 'content', concat('{"smells": ', to_json(smells), ', "severity": ', severity, ', "checks": ', to_json(checks), '}'))) AS messages FROM cleaned_rows"""
_CODE = "replace(code, '. ', CASE WHEN doc_id % 61 = 0 THEN '>#include ' ELSE '. ' END)"
_SIX = rf"""(WITH l AS (SELECT split, list_filter(list_filter(list_transform(regexp_split_to_array({_CODE}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(regexp_replace(x, '^[\x09-\x0D\x1C-\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ''), '[\x09-\x0D\x1C-\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '')), lambda x: length(x) >= 12), lambda x: NOT regexp_matches(x, '^(//|/\*|\*|#include)')) AS ls FROM units),
w AS (SELECT DISTINCT split, array_to_string(ls[i:i+5], chr(10)) AS w FROM (SELECT split, ls, unnest(range(1, len(ls) - 4)) AS i FROM l WHERE len(ls) > 5)) SELECT w, count(*) AS k FROM w GROUP BY w)"""


@query("q02_verify_cleaned", _report(
    ("rows have the expected fields", "0", "(SELECT 1)"),
    ("messages are system and user and assistant", "count_if(doc_id % 59 = 0)", "units"),
    ("one prompt throughout", "0", "(SELECT 1)"),
    ("answers are JSON in the one schema", "count_if((len(checks) = 0 AND doc_id % 41 = 0) OR (len(checks) = 0 AND doc_id % 9 = 0 AND doc_id % 100 <> 0))", "units"),
    ("no markers inside the code", f"count_if(contains({_CODE}, '@') OR contains({_CODE}, 'License'))", "units"),
    ("no glued directives left", f"count_if(regexp_matches({_CODE}, '[A-Za-z0-9_\">)]#[ \t]*(?:define|include|ifdef|ifndef|endif|pragma|undef)\\b'))", "units"),
    ("token counts are fresh", f"count_if(n_tokens <> length({_CODE}))", "units"),
    ("conversations fit", "count_if(n_tokens > 4000)", "units"),
    ("conversations end with the answer", "count_if(doc_id % 67 = 0)", "units"),
    ("ids are unique", "0", "(SELECT 1)"),
    ("no code appears twice", f"count(*) - count(DISTINCT md5({_NORMAL(_CODE)}))", "units"),
    ("no group in two splits", "count_if(k > 1)", "(SELECT md5(code) AS h, count(DISTINCT split) AS k FROM units GROUP BY md5(code))"),
    ("no window of six lines in two splits", "count_if(k > 1)", _SIX),
    ("val subset is balanced", _HALF("val", "len(checks) > 0"), "units WHERE split = 'val' AND doc_id % 3 = 0"),
))
def _(spark):
    spark.sql(_CLEANED).createOrReplaceTempView("cleaned_rows")
    rows = spark.sql(_ANSWERED)
    code = lambda user: F.substr(user, F.lit(8))
    shown = F.concat(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"), F.when(F.col("id") % 67 == 0, " ").otherwise("\n<|EOT|>\n"))
    fields = ["id", "group", "smells", "severity", "checks", "n_tokens", "messages"]
    return gates.verify_cleaned(rows, {"val": rows.where("split = 'val' AND id % 3 = 0")}, code, fields, ["low_quality", "toxic"], ["@", "License"], 4000, F.length(code(F.get("messages", 1)["content"])), shown, "\n<|EOT|>\n")


_DIGEST = "md5(concat(count(*), ':', sum(n_tokens), ':', min(md5(code)), ':', max(md5(code))))"
plan("q03_pinned_reuse", f"SELECT now.engine, CASE WHEN stored.settings <> now.settings THEN 'settings differ' WHEN stored.digest <> now.digest THEN 'dataset differs' END AS refused FROM (SELECT engine, {_DIGEST} AS digest, 'cap=4000' AS settings FROM units GROUP BY engine) now JOIN (SELECT engine, {_DIGEST} AS digest, CASE WHEN engine = 'src05' THEN 'cap=2000' ELSE 'cap=4000' END AS settings FROM (SELECT engine, n_tokens, CASE WHEN engine IN ('src03', 'src05') THEN concat(code, '.') ELSE code END AS code FROM units) GROUP BY engine) stored ON stored.engine = now.engine", f"SELECT engine, CASE WHEN engine = 'src05' THEN 'settings differ' WHEN engine = 'src03' THEN 'dataset differs' END AS refused FROM units GROUP BY engine")


@query("q04_recomputed_metrics", "SELECT label, unnest(['tp', 'fp', 'fn', 'f1']) AS metric, label <> 'toxic' OR metric NOT IN ('tp', 'f1') AS same FROM (SELECT unnest(['low_quality', 'toxic', 'odd']) AS label) WHERE label IN (SELECT unnest(list_concat(gold, pred)) FROM preds)")
def _(spark):
    """Stored figures, of which two are wrong, against those recomputed from the predictions."""
    names = ["tp", "fp", "fn", "f1"]
    long = lambda df, to: df.select("label", F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(to)) for n in names))))
    found = metrics.per_label(spark.table("preds"))
    wrong = (F.col("label") == "toxic") & F.col("metric").isin("tp", "f1")
    stored = long(found, "stored").withColumn("stored", F.when(wrong, F.col("stored") + 1).otherwise(F.round("stored", 4)))
    return stored.join(long(found, "value"), ["label", "metric"]).select("label", "metric", (F.abs(F.col("stored") - F.col("value")) < 5e-4).alias("same"))


_PHASES = "SELECT doc_id // 2 AS id, CASE WHEN doc_id % 2 = 0 THEN 'before' ELSE 'after' END AS phase, \"check\" AS chk, message FROM findings"


@query("q05_repair_gate", f"""WITH d AS ({_PHASES}), ids AS (SELECT DISTINCT id FROM d),
n AS (SELECT id, chk, message, count_if(phase = 'after') - count_if(phase = 'before') AS added FROM d GROUP BY ALL),
a AS (SELECT id, sum(greatest(added, 0))::BIGINT AS added FROM n GROUP BY id),
w AS (SELECT id, count_if(phase = 'before' AND chk = 'style-shout') AS b, count_if(phase = 'after' AND chk = 'style-shout') AS r FROM d GROUP BY id)
SELECT ids.id, CASE WHEN w.b = 0 THEN 'inconclusive' WHEN w.r > 0 OR a.added > 0 THEN 'rejected' ELSE 'passed_static_validation' END AS status, a.added FROM ids JOIN a USING (id) JOIN w USING (id)""")
def _(spark):
    d = spark.table("findings").select(F.expr("doc_id div 2").alias("id"), F.when(F.col("doc_id") % 2 == 0, "before").otherwise("after").alias("phase"), F.col("check").alias("chk"), "message")
    return gates.repair_gate(d, "id", "style-shout")


_SEEN = f"SELECT id, phase, chk, message FROM ({_PHASES}) UNION ALL SELECT doc_id // 2, CASE WHEN doc_id % 2 = 0 THEN 'before' ELSE 'after' END, 'size', 'size' FROM units WHERE doc_id % 7 <> 0"


@query("q05_repair_gate_witness", f"""WITH d AS ({_SEEN}), n AS (SELECT id, chk, message, count_if(phase = 'after') - count_if(phase = 'before') AS added FROM d WHERE chk <> 'size' GROUP BY ALL),
a AS (SELECT id, sum(greatest(added, 0))::BIGINT AS added FROM n GROUP BY id),
w AS (SELECT id, count_if(phase = 'before' AND chk = 'style-shout') AS b, count_if(phase = 'after' AND chk = 'style-shout') AS r, count_if(phase = 'before' AND chk = 'size') AS x, count_if(phase = 'after' AND chk = 'size') AS y FROM d GROUP BY id)
SELECT w.id, CASE WHEN b = 0 OR x = 0 OR y = 0 THEN 'inconclusive' WHEN r > 0 OR coalesce(a.added, 0) > 0 THEN 'rejected' ELSE 'passed_static_validation' END AS status, coalesce(a.added, 0) AS added FROM w LEFT JOIN a USING (id)""")
def _(spark):
    """As q05_repair_gate, where the size of every analysed function is reported too, and must be in both phases."""
    phase = F.when(F.col("doc_id") % 2 == 0, "before").otherwise("after").alias("phase")
    d = spark.table("findings").select(F.expr("doc_id div 2").alias("id"), phase, F.col("check").alias("chk"), "message")
    sizes = spark.table("units").where("doc_id % 7 <> 0").select(F.expr("doc_id div 2").alias("id"), phase, F.lit("size").alias("chk"), F.lit("size").alias("message"))
    return gates.repair_gate(d.union(sizes), "id", "style-shout", "size")


@query("q06_syntax_states", "SELECT before_ok, after_ok, count(*) AS n, CASE WHEN before_ok AND NOT after_ok THEN min(p_partkey) END AS first_broken FROM (SELECT p_partkey, p_partkey % 4 > 0 AS before_ok, p_partkey % 6 > 0 AS after_ok FROM part) GROUP BY before_ok, after_ok")
def _(spark):
    """Syntax before and after an edit, and the first text that the edit broke."""
    code = lambda broken: F.concat(F.lit("int f() { // "), "p_name", F.when(broken, " }").otherwise("\n}"))
    rows = spark.table("part").select("p_partkey", syntax_of(code(F.col("p_partkey") % 4 == 0)).alias("b"), syntax_of(code(F.col("p_partkey") % 6 == 0)).alias("a"))
    out = rows.groupBy(F.col("b.parse_ok").alias("before_ok"), F.col("a.parse_ok").alias("after_ok")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return out.select("before_ok", "after_ok", "n", F.when(F.col("before_ok") & ~F.col("after_ok"), F.col("first")).alias("first_broken"))


plan("q07_controls", "SELECT system, bool_and(NOT good OR passed) AS good_pass, bool_and(good OR NOT passed) AS bad_fail, count_if(good = passed) AS held, count(*) AS n FROM (SELECT system, passed, id % 2 = 0 AS good FROM repairs) GROUP BY system")


@query("st01_resumable_scan", "SELECT path, cfg, count(*) AS n FROM scanlog GROUP BY path, cfg")
def _(spark):
    return stream.resumable(spark, spark.table("scanlog"), ["path", "cfg"])


@query("st02_latest_view", "SELECT path, max(seq) AS seq, arg_max(status, seq) AS status FROM scanlog GROUP BY path")
def _(spark):
    return stream.latest_view(spark, spark.table("scanlog").select("path", "seq", "status"), ["path"], "seq")


@query("st03_progress")
def _(spark):
    return stream.progress(spark, spark.table("scanlog").select("path", "seq"))
