"""Scalar functions and answer parsing as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import parse
from loomstone.functions import text as T
from loomstone.functions.source import functions_of, syntax_of
from loomstone.operators import policy
from loomstone.operators.spans import apply_edits, edits_clash, greedy_fixes, splice_functions
from loomstone.plans.catalog import plan, query

#: White space and glued directives as functions/text.py has them, for the other dialect (fixed values).
_WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NORM = f"trim(regexp_replace(text, '{_WS}+', ' ', 'g'))"


@query("sc01_normalise", f"SELECT doc_id, md5({_NORM}) AS h, length({_NORM})::BIGINT AS n FROM documents")
def _(spark):
    n = T.normalised(F.col("text"))
    return spark.table("documents").select("doc_id", F.md5(n).alias("h"), F.length(n).cast("bigint").alias("n"))


plan("sc02_md5", "SELECT doc_id, md5(text) AS h FROM documents")
plan("sc03_sha", "SELECT doc_id, sha1(text) AS a, sha2(text, 256) AS b FROM documents", "SELECT doc_id, sha1(text) AS a, sha256(text) AS b FROM documents")


@query("sc04_stable_id", f"SELECT doc_id, 'fn-' || left(md5({_NORM}), 12) AS id FROM documents")
def _(spark):
    return spark.table("documents").select("doc_id", T.stable_id("fn-", F.col("text")).alias("id"))


@query("sc05_dedent", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\nAn', chr(10), 'g')) AS h FROM (SELECT doc_id, replace(text, '. ', '.' || chr(13) || chr(10)) AS text FROM documents)")
def _(spark):
    t = F.replace("text", F.lit(". "), F.lit(".\r\n"))
    return spark.table("documents").select("doc_id", F.md5(T.dedented(t, F.lit("An"))).alias("h"))


_STRIP = lambda c: f"regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', '')"
_GLUED = "replace(replace(text, '. ', '>#include '), ', ', '#if ')"
_DIRECTIVE = r"#[ \t]*(?:define|include|ifdef|ifndef|endif|pragma|undef)\b"


@query("sc06_unglue", f"SELECT doc_id, md5(regexp_replace(c, '([A-Za-z0-9_\">)])({_DIRECTIVE})', '\\1' || chr(10) || '\\2', 'g')) AS h, regexp_matches(c, '[A-Za-z0-9_\">)]{_DIRECTIVE}') AS changed FROM (SELECT doc_id, {_STRIP(f"replace({_GLUED}, chr(13) || chr(10), chr(10))")} AS c FROM documents)")
def _(spark):
    rows = spark.table("documents").select("doc_id", F.expr(_GLUED).alias("c"))
    return rows.select("doc_id", F.md5(T.unglued(F.col("c"))).alias("h"), F.col("c").rlike(r'[A-Za-z0-9_">)]#[ \t]*(?:' + "|".join(T.DIRECTIVES) + r")\b").alias("changed"))


@query("sc07_conversation", "SELECT doc_id, md5('system:S' || 'user:Find:' || chr(10) || chr(10) || text || 'assistant:' || lang) AS h FROM documents")
def _(spark):
    m = T.conversation(F.lit("S"), F.concat(F.lit("Find:\n\n"), "text"), F.col("lang"))
    flat = F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "")
    return spark.table("documents").select("doc_id", F.md5(flat).alias("h"))


_MIDDLE = "CASE WHEN doc_id % 3 = 0 THEN concat(text, '<fim_middle>') WHEN doc_id % 3 = 1 THEN concat(text, '<eos>') ELSE text END"
plan("sc08_preprocess", f"SELECT doc_id, md5(concat(m, CASE WHEN startswith(lower(t), 'the ') THEN substr(t, 5) ELSE t END, CASE WHEN endswith(t, '<eos>') THEN '' ELSE '<eos>' END)) AS h FROM (SELECT doc_id, CASE WHEN endswith(x, '<fim_middle>') THEN left(x, length(x) - 12) ELSE x END AS t, CASE WHEN endswith(x, '<fim_middle>') THEN '<fim_middle>' ELSE '' END AS m FROM (SELECT doc_id, {_MIDDLE} AS x FROM documents))", f"SELECT doc_id, md5(concat(m, CASE WHEN starts_with(lower(t), 'the ') THEN substr(t, 5) ELSE t END, CASE WHEN ends_with(t, '<eos>') THEN '' ELSE '<eos>' END)) AS h FROM (SELECT doc_id, CASE WHEN ends_with(x, '<fim_middle>') THEN left(x, length(x) - 12) ELSE x END AS t, CASE WHEN ends_with(x, '<fim_middle>') THEN '<fim_middle>' ELSE '' END AS m FROM (SELECT doc_id, {_MIDDLE} AS x FROM documents))")


@query("sc09_after_last", "SELECT doc_id, trim(replace(string_split(text, 'the')[-1], '.', ''), ' ' || chr(10)) AS tail FROM documents")
def _(spark):
    return spark.table("documents").select("doc_id", F.btrim(F.replace(T.after_last(F.col("text"), "the"), F.lit("."), F.lit("")), F.lit(" \n")).alias("tail"))


@query("sc10_user_code", "SELECT doc_id, md5(concat(lang, chr(10), text)) AS h FROM documents")
def _(spark):
    return spark.table("documents").select("doc_id", F.md5(T.user_code(F.concat(F.lit("Fix:\n\n"), "lang", F.lit("\n"), "text"))).alias("h"))


_AROUND = "CASE WHEN doc_id % 4 = 0 THEN raw WHEN doc_id % 4 = 1 THEN concat('{ oops ', raw) WHEN doc_id % 4 = 2 THEN concat('{\"r\": ', raw, '}') ELSE concat('{ bad ', raw, ' }') END"


@query("sc11_answer_anywhere", "SELECT a.doc_id, CASE WHEN a.doc_id % 11 <> 0 OR a.doc_id % 4 > 1 THEN p.pred ELSE [] END AS checks, a.doc_id % 11 <> 0 OR a.doc_id % 4 > 1 AS valid FROM answers a JOIN preds p ON a.doc_id = p.doc_id")
def _(spark):
    """Answers as they are, after a brace that never closes, inside another object, and inside broken braces."""
    return spark.table("answers").select("doc_id", F.expr(_AROUND).alias("raw")).select("doc_id", parse.checks_anywhere("raw").alias("a")).select("doc_id", "a.checks", "a.valid")


@query("sc11_answer_bare", "SELECT a.doc_id, CASE WHEN a.doc_id % 5 <> 0 AND a.doc_id % 11 <> 0 THEN p.pred END AS checks FROM answers a JOIN preds p ON a.doc_id = p.doc_id")
def _(spark):
    """All answers: null where the text as a whole is no object."""
    return spark.table("answers").select("doc_id", parse.checks_bare(F.col("raw")).alias("checks"))


@query("sc12_lenient_json", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN props END AS json FROM events")
def _(spark):
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("no "), F.translate("props", "{}", ""))).otherwise(F.concat(F.lit("so: "), F.regexp_replace("props", r"\}$", ",}"), F.lit(" ok")))
    return spark.table("events").select("event_id", parse.lenient_json(raw).alias("json"))


@query("sc13_json_with_keys", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{\"a\": 1, \"b\": ' || doc_id || '}' END AS found FROM documents")
def _(spark):
    d = F.col("doc_id").cast("string")
    raw = F.concat(F.lit('x {"c": 2} y '), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"a": 1, "b": '), d, F.lit("}"))).otherwise(F.lit('{"a": 1}')))
    return spark.table("documents").select("doc_id", parse.json_with_keys(raw, ["a", "b"]).alias("found"))


_CLEAN = "No smells detected"


@query("sc14_label_parse", f"""SELECT doc_id, CASE WHEN reject IS NULL THEN list_filter(['toxic', 'low_quality'], lambda x: list_contains(pred, x)) END AS smells, CASE WHEN reject IS NULL THEN severity END AS severity, CASE WHEN reject IS NULL THEN CASE WHEN len(pred) = 0 THEN [] ELSE ['a-y', 'b-x'] END END AS checks, reject FROM (
SELECT doc_id, pred, severity, CASE WHEN k = 0 THEN 'label is not JSON' WHEN k = 1 THEN 'unexpected label keys' WHEN list_contains(pred, 'odd') THEN 'category outside the vocabulary' WHEN len(pred) = 0 AND severity <> 0 THEN 'clean label with severity or checks set' WHEN len(pred) > 0 AND k = 5 THEN 'smelly label without valid check names' END AS reject
FROM (SELECT doc_id, pred, doc_id % 6 AS k, (CASE WHEN len(pred) = 0 THEN doc_id % 6 - 2 ELSE doc_id % 100 END)::INTEGER AS severity FROM preds))""")
def _(spark):
    k, none = F.col("doc_id") % 6, F.size("pred") == 0
    named = F.concat(F.lit('["'), F.array_join(F.reverse("pred"), " , "), F.lit('"]'))
    body = F.concat(F.lit('{"smells": '), F.when(none, "[]").otherwise(named), F.lit(', "severity": '), F.when(none, k - 2).otherwise(F.col("doc_id") % 100).cast("string"), F.lit(', "explanation": "'), F.when(none, _CLEAN).when(k == 5, "Bad Name").otherwise("b-x, a-y,b-x"), F.lit('"}'))
    raw = F.when(k == 0, F.lit("{")).when(k == 1, F.lit('{"smells": [], "severity": 0}')).otherwise(body)
    return spark.table("preds").select("doc_id", parse.parsed_label(raw, ["toxic", "low_quality"], _CLEAN).alias("l")).select("doc_id", "l.*")


@query("sc15_comma_set", "SELECT p_partkey, list_sort(list_distinct(list_filter(list_transform(string_split(p_name || ', ,' || p_brand || ' ,' || p_name, ','), lambda x: trim(x)), lambda x: x <> ''))) AS items FROM part")
def _(spark):
    return spark.table("part").select("p_partkey", T.comma_set(F.concat("p_name", F.lit(", ,"), "p_brand", F.lit(" ,"), "p_name")).alias("items"))


@query("sc16_threshold_label", "SELECT doc_id, CASE WHEN n_tokens > 3000 OR length(engine) > 4 THEN ['size'] ELSE [] END AS labels FROM units")
def _(spark):
    return spark.table("units").select("doc_id", policy.over_limits({"tokens": F.col("n_tokens"), "name": F.length("engine"), "free": F.col("doc_id")}, {"tokens": 3000, "name": 4}, "size").alias("labels"))


_EDGES = "(SELECT list_sort(list_distinct(list_transform(quantile_cont(n_tokens, [0.2, 0.4, 0.6, 0.8]), lambda x: floor(round(x, 6))::BIGINT))) AS edges FROM units)"


@query("sc17_bin_of_edges", f"SELECT doc_id, len(list_filter(edges, lambda x: x <= n_tokens))::BIGINT AS bin FROM units, {_EDGES}")
def _(spark):
    u = spark.table("units")
    edges = u.agg(T.edges_of(F.percentile("n_tokens", F.array(*(F.lit(x) for x in (0.2, 0.4, 0.6, 0.8))))).alias("edges"))
    return u.crossJoin(F.broadcast(edges)).select("doc_id", T.bin_of(F.col("edges"), F.col("n_tokens")).alias("bin"))


@query("sc18_edges", f"SELECT unnest(edges) AS edge FROM {_EDGES}")
def _(spark):
    return spark.table("units").agg(T.edges_of(F.percentile("n_tokens", F.array(*(F.lit(x) for x in (0.2, 0.4, 0.6, 0.8))))).alias("e")).select(F.explode("e").alias("edge"))


_FENCED = "CASE WHEN doc_id % 5 = 0 THEN concat('Here:', n, '```cpp', n, text, n, '```', n, 'bye') WHEN doc_id % 5 = 1 THEN concat('a ', text) WHEN doc_id % 5 = 2 THEN concat('```', n, text, n, '```', n, '```', n, 'b', n, '```') WHEN doc_id % 5 = 3 THEN concat('so ```', n, text, '``` it is') ELSE concat('```python', n, text, n, '```') END"


@query("sc19_fenced_block", f"SELECT doc_id, md5({_STRIP('CASE WHEN doc_id % 5 = 0 THEN text ELSE raw END')}) AS h FROM (SELECT doc_id, text, {_FENCED} AS raw FROM (SELECT doc_id, text, chr(10) AS n FROM documents))")
def _(spark):
    """One block, none, two blocks, fences inside a line, another language: only the first is taken out."""
    rows = spark.table("documents").select("doc_id", "text", F.lit("\n").alias("n")).select("doc_id", F.expr(_FENCED).alias("raw"))
    return rows.select("doc_id", F.md5(T.fenced(F.col("raw"))).alias("h"))


@query("sc20_token_jaccard", "SELECT p_partkey, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) END::DOUBLE AS j FROM (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '\\w+')) AS a, list_distinct(regexp_extract_all(lower(p_type), '\\w+')) AS b FROM part)")
def _(spark):
    return spark.table("part").select("p_partkey", F.round(T.jaccard(T.token_set(F.col("p_name")), T.token_set(F.col("p_type"))), 9).alias("j"))


@query("sc21_quick_ratio", "SELECT p_partkey, round(2.0 * list_sum(list_transform(list_distinct(string_split(p_name, '')), lambda x: CASE WHEN x = '' THEN 0 ELSE least(length(p_name) - length(replace(p_name, x, '')), length(p_type) - length(replace(p_type, x, ''))) END))::DOUBLE / (length(p_name) + length(p_type)), 9) AS r FROM part")
def _(spark):
    return spark.table("part").select("p_partkey", F.round(T.quick_ratio(F.col("p_name"), F.col("p_type")), 9).alias("r"))


@query("sc22_unified_diff")
def _(spark):
    return spark.table("part").select("p_partkey", parse.unified_diff("p_name", "p_type").alias("d"))


@query("sc23_shared_prefix", "SELECT doc_id, CASE WHEN contains(text, 'and') THEN strpos(text, 'and') - 1 ELSE length(text) END::INTEGER AS n FROM documents")
def _(spark):
    return spark.table("documents").select("doc_id", T.shared_prefix(F.col("text"), F.replace("text", F.lit("and"), F.lit("end"))).alias("n"))


plan("sc24_explanation_match", "SELECT doc_id, CASE WHEN size(gold) = 0 THEN CASE WHEN size(pred) = 0 THEN 1.0D ELSE 0.0D END ELSE size(array_intersect(gold, pred)) / cast(size(gold) AS double) END AS m FROM preds", "SELECT doc_id, CASE WHEN len(gold) = 0 THEN CASE WHEN len(pred) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE len(list_intersect(gold, pred)) / len(gold)::DOUBLE END AS m FROM preds")
plan("sc25_fraction", "SELECT engine, format_string('%d/%d (%.1f%%)', k, n, 100.0D * k / n) AS f FROM (SELECT engine, count_if(low) AS k, count(*) AS n FROM units GROUP BY engine)", "SELECT engine, printf('%d/%d (%.1f%%)', k, n, 100.0 * k / n) AS f FROM (SELECT engine, count_if(low) AS k, count(*) AS n FROM units GROUP BY engine)")


@query("sc26_defaulted", "SELECT n_nationkey, n_nationkey % 2 = 0 AS defaulted FROM nation")
def _(spark):
    before = F.concat("n_name", F.lit("::  f( ) { }"))
    candidate = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("::f()  = default ;"))).otherwise(F.concat("n_name", F.lit("::g() = default;")))
    bare = lambda c: F.regexp_replace(c, T.SPACE, "")
    same = bare(F.regexp_extract(candidate, r"(?s)^\s*(.+?)\s*=\s*default\s*;\s*$", 1)) == bare(F.substring_index(before, "{", 1))
    return spark.table("nation").select("n_nationkey", same.alias("defaulted"))


_BEFORE = ("The", "the", "#", "|", "!!", "An", "in ")


@query("sc27_marker_guard", "SELECT doc_id, " + " OR ".join(f"length(text) - length(replace(text, '{m}', '')) > length(b) - length(replace(b, '{m}', ''))" for m in _BEFORE) + " AS more FROM (SELECT doc_id, text, replace(replace(text, 'The ', ''), '!!', '!') AS b FROM documents)")
def _(spark):
    b = F.replace(F.replace("text", F.lit("The "), F.lit("")), F.lit("!!"), F.lit("!"))
    return spark.table("documents").select("doc_id", F.exists(F.array(*(T.occurrences(F.col("text"), m) > T.occurrences(b, m) for m in _BEFORE)), lambda x: x).alias("more"))


_HEAD = "concat('// ', p_name, ' {', e, 'int g() { return 0; }', e, '  int f', p_partkey, '(int a) {', e, '    return a; // }', e, '  }', e, 'char c = ', chr(39), '}', chr(39), ';', e)"
_OWN = "concat('int f', p_partkey, '(int a) {', chr(10), '  return a; // }', chr(10), '}')"
_NEW = "CASE p_partkey % 5 WHEN 0 THEN concat('int other(int a) { return 1; }') WHEN 1 THEN concat('int f', p_partkey, '(int a) { // NOLINT', chr(10), '}') WHEN 2 THEN concat('int x; int f', p_partkey, '(int a) { }') ELSE concat(' int f', p_partkey, '(int a) {', chr(10), '  return \"', p_type, '\"; // }', chr(10), '}', chr(10)) END"
_SPLICED = "concat('// ', p_name, ' {', e, 'int g() { return 0; }', e, '  int f', p_partkey, '(int a) {', e, '    return \"', p_type, '\"; // }', e, '  }', e, 'char c = ', chr(39), '}', chr(39), ';', e)"
_FILES = f"SELECT p_partkey, {_HEAD} AS raw, {_OWN} AS own, {_NEW} AS new FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN concat(chr(13), chr(10)) ELSE chr(10) END AS e FROM part)"


@query("sc28_splice_function", f"SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 > 2 THEN md5({_SPLICED}) END AS h, CASE WHEN p_partkey % 7 = 0 THEN 'original function no longer matches the recorded lines and text' WHEN p_partkey % 5 = 0 THEN 'candidate must contain exactly the same named function' WHEN p_partkey % 5 = 2 THEN 'candidate contains text outside its function' WHEN p_partkey % 5 = 1 THEN 'candidate introduces suppression or conditional compilation' END AS reject FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN concat(chr(13), chr(10)) ELSE chr(10) END AS e FROM part)")
def _(spark):
    rows = spark.sql(_FILES).withColumns({"first": F.when(F.col("p_partkey") % 7 == 0, 2).otherwise(3), "last": F.lit(5)})
    return splice_functions(rows, "raw", "first", "last", "own", "new").select("p_partkey", F.md5("spliced.text").alias("h"), "spliced.reject")


@query("u02_functions", "SELECT p_partkey, unnest(['g', 'f' || p_partkey]) AS name, unnest([2, 3]) AS start_line, unnest([2, 5]) AS end_line, unnest(['', '  ']) AS indent, unnest([md5('int g() { return 0; }'), md5(concat('int f', p_partkey, '(int a) {', e, '    return a; // }', e, '  }'))]) AS h FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN concat(chr(13), chr(10)) ELSE chr(10) END AS e FROM part)")
def _(spark):
    rows = spark.sql(_FILES).select("p_partkey", functions_of("raw").alias("f"))
    return rows.select("p_partkey", F.inline("f")).select("p_partkey", "name", "start_line", "end_line", "indent", F.md5("code").alias("h"))


@query("u07_syntax_check", "SELECT p_partkey, p_partkey % 3 > 0 AS parse_ok, (CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END)::INTEGER AS function_definitions, p_partkey % 3 = 1 AS single_function FROM part")
def _(spark):
    code = "CASE p_partkey % 3 WHEN 0 THEN concat('int f() { // ', p_name, chr(10)) WHEN 1 THEN concat('int f() { return \"{', p_name, '\"; }') ELSE concat('A::A() : x{1} { }', chr(10), 'int A::get() const { return ', p_size, '; }') END"
    return spark.table("part").select("p_partkey", F.expr(code).alias("c")).select("p_partkey", syntax_of("c").alias("s")).select("p_partkey", "s.*")


@query("sc29_path_key", "SELECT page_id, lower(replace(replace(url, '/', '\\'), '\\', '/')) AS k FROM pages")
def _(spark):
    return spark.table("pages").select("page_id", T.path_key(F.replace("url", F.lit("/"), F.lit("\\"))).alias("k"))


_LINES = "CASE p_partkey % 6 WHEN 0 THEN concat(' #  include <', p_brand, '/x.h>') WHEN 1 THEN concat('# define M', p_partkey, '(x) x') WHEN 2 THEN concat(chr(39), 'a/', p_partkey, '.h', chr(39), ' file not found') WHEN 3 THEN concat('unknown type name ', chr(39), 'T', p_partkey, chr(39)) WHEN 4 THEN concat('class LIB_EXPORT C', p_partkey, ' {') ELSE concat(p_size, ' statements') END"
#: name: pattern with one group, in a form that both dialects read.
_CATALOGUE = {"include": r'^[ \t]*#[ \t]*include[ \t]*[<"]([^>"]+)', "macro": r"^[ \t]*#[ \t]*define[ \t]+([A-Za-z_][A-Za-z0-9_]*)", "missing": "^.([^ ]+). file not found", "unknown": "unknown type name .([A-Za-z0-9_]+)", "export": r"^(?:class|struct)[ \t]+([A-Z][A-Z0-9_]*_EXPORT)\b", "metric": "^([0-9]+) [a-z]+$"}
_EXTRACTED = ", ".join(f"regexp_extract(line, '{r}', 1) AS {n}_" for n, r in _CATALOGUE.items())


@query("sc30_regex_catalogue", f"SELECT p_partkey, {_EXTRACTED} FROM (SELECT p_partkey, {_LINES} AS line FROM part)")
def _(spark):
    return spark.table("part").select("p_partkey", F.expr(_LINES).alias("line")).select("p_partkey", *(F.regexp_extract("line", r, 1).alias(f"{n}_") for n, r in _CATALOGUE.items()))




@query("sc32_token_count", r"SELECT p_partkey, len(regexp_extract_all(p_name || ' (' || p_type || ')', '\w+|[^\w\s]'))::BIGINT AS n FROM part")
def _(spark):
    return spark.table("part").select("p_partkey", T.token_count(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("n"))


_STORED = "SELECT doc_id, n_tokens + CASE WHEN doc_id % 100 = 0 THEN 1 ELSE 0 END AS stored, length(code) AS fresh FROM units"
_COMPARED = "SELECT count(*) AS n, count_if(stored <> fresh) AS mismatched, {ids} AS mismatches, count_if(fresh <= 4000) AS retained, {out} AS excluded FROM ({rows})"
plan("sc33_token_comparison", _COMPARED.format(ids="array_sort(collect_list(CASE WHEN stored <> fresh THEN doc_id END))", out="array_sort(collect_list(CASE WHEN fresh > 4000 THEN doc_id END))", rows=_STORED), _COMPARED.format(ids="list_sort(list(doc_id) FILTER (WHERE stored <> fresh))", out="list_sort(list(doc_id) FILTER (WHERE fresh > 4000))", rows=_STORED))


@query("w12_line_of_offset", "SELECT doc_id, o, line_no AS line FROM findings")
def _(spark):
    rows = spark.table("findings").join(spark.table("documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "o", T.line_of(F.col("text"), F.col("o").cast("int")).alias("line"))


_FIXED = "concat(p_name, ' ', p_type, ' ', p_brand, ' ', repeat('=', 30))"
_STRIDE = "CASE WHEN s = 0 THEN 99 WHEN s = 1 THEN 4 WHEN s < 4 THEN 2 ELSE 1 END"


@query("g08_greedy_edits", f"""SELECT p_partkey, array_to_string(list_transform(range(0, length(c)), lambda i: CASE WHEN i // w * stride <= k AND i % w = 0 THEN 'x' WHEN i // w * stride <= k AND i % w < 3 THEN '' ELSE c[i + 1] END), '') AS code, list_sort(list_distinct(list_transform(range(0, k + 1, stride), lambda i: 'c' || (i % 2)))) AS checks
FROM (SELECT *, CASE WHEN s = 0 THEN 1000000 ELSE s * stride END AS w FROM (SELECT *, {_STRIDE} AS stride FROM (SELECT p_partkey, {_FIXED} AS c, p_partkey % 7 AS s, p_partkey % 5 AS k FROM part)))""")
def _(spark):
    """Findings that each replace three bytes; later ones that touch an earlier one are not applied."""
    edit = lambda i: F.struct((i * (F.col("p_partkey") % 7)).cast("bigint").alias("o"), F.lit(3).cast("bigint").alias("n"), F.lit("x").alias("text"))
    fs = F.transform(F.sequence(F.lit(0), (F.col("p_partkey") % 5).cast("int")), lambda i: F.struct(F.concat(F.lit("c"), (i % 2).cast("string")).alias("check"), F.array(edit(i)).alias("fix")))
    return spark.table("part").select("p_partkey", greedy_fixes(F.expr(_FIXED), fs).alias("g")).select("p_partkey", "g.code", "g.checks")


_STEP = "(p_partkey % 9)::INTEGER"


@query("g09_strict_edits", f"SELECT p_partkey, CASE WHEN {_STEP} IN (1, 2) OR length(p_name) < {_STEP} + 3 THEN NULL WHEN {_STEP} = 0 THEN 'XX' || substr(p_name, 4) ELSE 'XX' || substr(p_name, 4, {_STEP} - 3) || 'XX' || substr(p_name, {_STEP} + 4) END AS edited FROM part")
def _(spark):
    step = (F.col("p_partkey") % 9).cast("bigint")
    edit = lambda o: F.struct(o.cast("bigint").alias("o"), F.lit(3).cast("bigint").alias("n"), F.lit("XX").alias("text"))
    return spark.table("part").select("p_partkey", apply_edits("p_name", F.array(edit(F.lit(0)), edit(step), edit(step))).alias("edited"))


@query("g09_function_edits", f"SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN concat('int f', p_partkey, '(int a) {{', chr(10), CASE WHEN p_partkey % 3 = 1 THEN '  return a; // }}' ELSE '  throw a; // }}' END, chr(10), '}}') END AS edited FROM part")
def _(spark):
    """Edits of a function's bytes only: outside it nothing is edited, and what comes out is dedented."""
    rows = spark.sql(_FILES).select("p_partkey", "raw", functions_of("raw").alias("f")).select("p_partkey", "raw", F.element_at("f", 2).alias("f"))
    at = F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(F.octet_length(F.substring_index("raw", "return a", 1))).cast("bigint")
    edit = F.struct(at.alias("o"), F.lit(6).cast("bigint").alias("n"), F.when(F.col("p_partkey") % 3 == 2, "throw").otherwise("return").alias("text"))
    return rows.select("p_partkey", apply_edits("raw", F.array(edit), F.col("f.start"), F.col("f.end")).alias("edited"))


@query("g09_edit_clash", "SELECT p_partkey, p_partkey % 9 IN (1, 2) AS clash FROM part")
def _(spark):
    edit = lambda o: F.struct(o.cast("bigint").alias("o"), F.lit(3).cast("bigint").alias("n"), F.lit("XX").alias("text"))
    step = F.col("p_partkey") % 9
    return spark.table("part").select("p_partkey", edits_clash(F.array(edit(F.lit(0)), edit(step), edit(step))).alias("clash"))


@query("u10_overlap_scores")
def _(spark):
    return spark.table("part").select("p_partkey", parse.overlap_scores("p_type", "p_name").alias("s")).select("p_partkey", "s.rouge_l", "s.bleu")
