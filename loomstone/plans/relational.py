"""Sources, sinks, filters, joins and set operations as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.functions.source import STANDARD_MACROS, at_macro, defined_macros
from loomstone.operators import policy
from loomstone.operators.dedup import scratch
from loomstone.operators.spans import edits_inside, points_in_ranges
from loomstone.plans.catalog import plan, query
from loomstone.sources import io

_EVENT = "SELECT event_id, event_type, value FROM events"


@query("src01_jsonl_scan", _EVENT)
def _(spark):
    path = scratch(spark)
    io.write_jsonl(spark.table("events").select("event_id", "event_type", "value"), path)
    return io.read_jsonl(spark, path, "event_id bigint, event_type string, value double")


@query("src02_jsonl_first_n", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 500")
def _(spark):
    path = scratch(spark)
    io.write_jsonl(spark.table("events").select("event_id", "event_type"), path)
    return io.read_jsonl_first(spark, path, "event_id bigint, event_type string", "event_id", 500)


@query("src03_jsonl_skip_blank", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def _(spark):
    path = scratch(spark)
    spark.table("events").selectExpr("CASE WHEN event_id % 3 = 0 THEN '' ELSE to_json(named_struct('event_id', event_id)) END AS value").write.text(path)
    return io.read_jsonl(spark, path, "event_id bigint")


@query("src04_text_column_scan", "SELECT doc_id, length(text)::BIGINT AS n FROM documents")
def _(spark):
    return spark.table("documents").select("doc_id", F.length("text").cast("bigint").alias("n"))


_TOLERANT = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat('{\"instruction\": ', doc_id, ', \"output\": 1}') WHEN doc_id % 4 = 1 THEN concat('{\"instruction\": ', doc_id, '}') WHEN doc_id % 4 = 2 THEN concat('{broken ', doc_id) ELSE '  ' END AS value FROM documents"


@query("src09_tolerant_load", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'missing key' WHEN doc_id % 4 = 2 THEN 'not JSON' END AS reject FROM documents WHERE doc_id % 4 <> 3")
def _(spark):
    return io.read_tolerant(spark.sql(_TOLERANT), ["instruction", "output"]).select("doc_id", "reject")


@query("src08_route_by_name", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'detection' WHEN page_id % 3 = 1 THEN 'fixing' END AS kind FROM pages")
def _(spark):
    name = F.when(F.col("page_id") % 3 == 0, "/a/My_Detection.jsonl").when(F.col("page_id") % 3 == 1, "/detection/fixing-1.jsonl").otherwise("/fixing/other.jsonl")
    return spark.table("pages").select("page_id", io.routed(name).alias("kind"))


@query("src05_json_document", "SELECT n_nationkey, n_name, n_nationkey % 3 AS level FROM nation")
def _(spark):
    """A configuration over several lines for each nation, read as documents."""
    path = scratch(spark)
    spark.table("nation").selectExpr("concat('{', chr(10), '  \"key\": ', n_nationkey, ',', chr(10), '  \"scan\": {\"name\": \"', n_name, '\",', chr(10), '  \"level\": ', n_nationkey % 3, '}', chr(10), '}') AS value", "n_nationkey").write.partitionBy("n_nationkey").text(path)
    return io.read_document(spark, path, "key int, scan struct<name:string,level:int>").select(F.col("key").alias("n_nationkey"), F.col("scan.name").alias("n_name"), F.col("scan.level").alias("level"))


@query("src06_source_files", "SELECT n_nationkey % 3 AS kind, count(*) AS files, sum(strlen(n_name) + 1)::BIGINT AS bytes FROM nation WHERE n_nationkey % 5 > 1 AND n_nationkey % 3 <> 2 GROUP BY ALL")
def _(spark):
    """A file for each nation, in directories that are source code, vendored, or the version control's own; only the first kind is listed,
    and of that nothing below an excluded prefix."""
    path = scratch(spark)
    where = F.when(F.col("n_nationkey") % 5 == 0, ".git").when(F.col("n_nationkey") % 5 == 1, "vendored").otherwise("src")
    rows = spark.table("nation").select(F.col("n_name").alias("value"), where.alias("dir"), (F.col("n_nationkey") % 3).alias("kind"), "n_nationkey")
    rows.repartition("n_nationkey").write.option("compression", "none").partitionBy("dir", "kind", "n_nationkey").text(path)
    files = io.source_files(spark, path, [".txt"], ["dir=.git", "dir=vendored"], 512, ["dir=src/kind=2/"])
    kind = F.regexp_extract("path", "kind=([0-9])", 1).cast("int")
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


#: Control characters that YAML forbids (fixed values).
_FORBIDDEN = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"


@query("src10_yaml_control_chars", f"SELECT page_id, length(regexp_replace(html, '{_FORBIDDEN}', '', 'g'))::BIGINT AS n FROM pages")
def _(spark):
    return spark.table("pages").select("page_id", F.length(F.regexp_replace("html", _FORBIDDEN, "")).cast("bigint").alias("n"))


@query("src11_optional_artifact", "SELECT unnest(['missing', 'half', 'whole']) AS artifact, unnest(['pending', 'pending', 'present']) AS note, unnest([0, 0, (SELECT count(*) FROM nation)]) AS n")
def _(spark):
    """An artifact that is not there, one whose last line is cut off, and a whole one."""
    half, whole = scratch(spark), scratch(spark)
    lines = spark.table("nation").selectExpr("to_json(named_struct('id', n_nationkey)) AS value")
    lines.write.text(whole)
    lines.union(spark.sql("SELECT '{\"id\": '")).write.text(half)
    out = []
    for name, path in (("missing", scratch(spark)), ("half", half), ("whole", whole)):
        rows, note = io.optional(spark, path, "id bigint")
        out.append(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("artifact"), F.lit(note).alias("note"), "n"))
    return out[0].union(out[1]).union(out[2])


@query("src12_saved_table", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark):
    path = scratch(spark)
    spark.table("orders").select("o_orderkey", "o_orderpriority").write.parquet(path)
    return spark.read.parquet(path)


@query("snk02_split_partitions", "SELECT split, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high FROM units GROUP BY split")
def _(spark):
    path = scratch(spark)
    io.write_splits(spark.table("units").select("doc_id", "split", "n_tokens"), path, order="doc_id")
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))


@query("snk01_jsonl_roundtrip", "SELECT doc_id, md5(text) AS h FROM documents")
def _(spark):
    path = scratch(spark)
    io.write_jsonl(spark.table("documents").select("doc_id", "text"), path)
    return io.read_jsonl(spark, path, "doc_id bigint, text string").select("doc_id", F.md5("text").alias("h"))


@query("snk03_append_log", "SELECT path, count(*) AS n FROM scanlog GROUP BY path")
def _(spark):
    path = scratch(spark)
    for half in (0, 1):
        io.append(spark.table("scanlog").where(F.col("seq") % 2 == half), path)
    return spark.read.parquet(path).groupBy("path").agg(F.count("*").alias("n"))


@query("snk06_csv_export", "SELECT n_nationkey, n_name FROM nation")
def _(spark):
    path = scratch(spark)
    io.write_csv(spark.table("nation").select("n_nationkey", "n_name"), path)
    return spark.read.schema("n_nationkey int, n_name string").option("header", True).csv(path)


@query("snk04_vocabulary", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark):
    path = scratch(spark)
    io.write_vocabulary(spark.table("documents").groupBy("lang").agg(F.count("*").alias("n")), path)
    return spark.read.text(path).select(F.inline(F.from_json("value", "array<struct<lang:string,n:bigint>>")))


@query("snk05_manifest", "SELECT count(*) AS n, count(DISTINCT doc_id) AS n_keys, sum(('0x' || left(sha256(concat(doc_id, chr(31), engine, chr(31), n_tokens)), 12))::BIGINT::HUGEINT)::VARCHAR AS digest FROM units")
def _(spark):
    return io.manifest(spark.table("units"), "doc_id", "engine", "n_tokens")


@query("snk05_input_digests", "SELECT sha256(concat(n_name, chr(10))) AS sha256 FROM nation")
def _(spark):
    """Digests of the files that a run reads: here one file for each nation."""
    path = scratch(spark)
    spark.table("nation").select(F.col("n_name").alias("value"), "n_nationkey").repartition("n_nationkey").write.option("compression", "none").partitionBy("n_nationkey").text(path)
    return io.digests(spark, path).where(F.col("name").endswith(".txt")).select("sha256")


plan("p01_projection", "SELECT doc_id, engine, n_tokens FROM units")
plan("p02_drop_after_map", "SELECT doc_id, concat(lang, ':', engine) AS text FROM units")


@query("p03_path_exclusion", "SELECT url, (url LIKE '%/fr/%' OR url LIKE '%/es/%' OR lower(url) LIKE 'http://th%') AS excluded FROM pages")
def _(spark):
    return spark.table("pages").select("url", io.excluded(F.col("url"), ["fr", "es"], ["http://th"]).alias("excluded"))


@query("p04_glob_membership", "SELECT p_partkey, (p_type LIKE 'PROMO%' OR p_name LIKE '%a' OR p_brand SIMILAR TO 'Brand#[12].*') AS hit FROM part")
def _(spark):
    return spark.table("part").select("p_partkey", (T.matches_any(F.col("p_type"), ["PROMO*"]) | T.matches_any(F.col("p_name"), ["*a"]) | T.matches_any(F.col("p_brand"), ["Brand#[12]*"])).alias("hit"))


@query("p05_include_exclude", "SELECT doc_id, \"check\" AS chk FROM findings WHERE \"check\" LIKE 's%' AND NOT \"check\" LIKE '%long%'")
def _(spark):
    f = spark.table("findings")
    return f.where(T.selects(F.col("check"), ["s*"], ["*long*"])).select("doc_id", F.col("check").alias("chk"))


plan("p06_eligibility", "SELECT doc_id FROM units WHERE CASE WHEN split = 'train' THEN n_tokens > 50 ELSE n_tokens > 50 AND lang = 'en' END")


@query("p07_stray_markers", "SELECT doc_id FROM units WHERE NOT (contains(code, '@') OR contains(code, 'License'))")
def _(spark):
    return spark.table("units").where(~policy.marked(F.col("code"), ("@", "License"))).select("doc_id")


_BUDGET = "CASE WHEN n_tokens < 400 THEN 'too short' WHEN n_tokens > 4000 THEN 'too long' END"


@query("p08_token_budget", f"SELECT reason, count(*) AS n FROM (SELECT {_BUDGET} AS reason FROM units) WHERE reason IS NOT NULL GROUP BY reason")
def _(spark):
    return policy.ledger(policy.cascade(spark.table("units"), ("too short", F.col("n_tokens") < 400), ("too long", F.col("n_tokens") > 4000)))


plan("p09_line_bounds", "SELECT doc_id, n_lines FROM (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id) WHERE n_lines BETWEEN 5 AND 400")


@query("p10_drop_cascade", "SELECT doc_id, CASE WHEN contains(code, '!!') THEN 'shout' WHEN n_tokens < 400 THEN 'too short' WHEN n_tokens > 4000 THEN 'too long' WHEN lang <> 'en' THEN 'language' END AS drop_reason FROM units")
def _(spark):
    u = spark.table("units")
    return policy.cascade(u, ("shout", F.contains("code", F.lit("!!"))), ("too short", F.col("n_tokens") < 400), ("too long", F.col("n_tokens") > 4000), ("language", F.col("lang") != "en")).select("doc_id", "drop_reason")


_LAST = lambda h: f"CASE WHEN contains(text, '{h}') THEN length(text) - strpos(reverse(text), reverse('{h}')) - {len(h)} + 2 ELSE 0 END"


@query("p11_last_head", f"SELECT doc_id, CASE WHEN greatest(a, b) = 0 THEN NULL WHEN a >= b THEN ' the ' ELSE ' of ' END AS head FROM (SELECT doc_id, {_LAST(' the ')} AS a, {_LAST(' of ')} AS b FROM documents)")
def _(spark):
    return spark.table("documents").select("doc_id", T.last_head(F.col("text"), [" the ", " of "]).alias("head"))


plan("p12_candidate_filter", "SELECT doc_id FROM units WHERE lang = 'en'")


@query("p13_known_labels", "SELECT doc_id, list_filter(pred, lambda x: x IN ('low_quality', 'toxic')) AS pred FROM preds WHERE len(pred) = 0 OR list_has_any(pred, ['low_quality', 'toxic'])")
def _(spark):
    return policy.only_known(spark.table("preds"), "pred", ["low_quality", "toxic"]).select("doc_id", "pred")


@query("p14_subset", "SELECT doc_id FROM preds WHERE NOT list_contains(pred, 'odd')")
def _(spark):
    return spark.table("preds").where(policy.subset_of("pred", ["low_quality", "toxic"])).select("doc_id")


plan("p15_pilot_filter", "SELECT doc_id FROM units WHERE labelled AND NOT low AND n_tokens <= 2000")


@query("p17_annotation_name", "SELECT p_name, regexp_full_match(upper(p_name), '[A-Z][A-Z0-9_ ]*') AND (contains(upper(p_name), 'ED') OR contains(upper(p_name), 'ING')) AS hit FROM part")
def _(spark):
    n = F.upper("p_name")
    return spark.table("part").select("p_name", (n.rlike("^[A-Z][A-Z0-9_ ]*$") & F.exists(F.array(F.lit("ED"), F.lit("ING")), lambda w: F.contains(n, w))).alias("hit"))


#: Diagnostics of a file: some are errors, some lie in other files or nowhere, some come from the compiler, some carry metrics.
_DIAGNOSTICS = "SELECT doc_id, CASE WHEN o % 5 = 0 THEN 'Error' ELSE 'Warning' END AS level, o % 7 > 0 AS main, CASE WHEN o % 11 = 0 THEN NULL ELSE o END AS o, CASE WHEN o % 13 = 0 THEN concat('compiler-', {c}) ELSE {c} END AS name FROM findings"
_ROUTE = "SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS files FROM (SELECT doc_id, CASE WHEN level = 'Error' AND main AND o IS NOT NULL THEN 'error in the file' WHEN level = 'Error' THEN 'error elsewhere' WHEN NOT main OR o IS NULL OR name LIKE 'compiler-%' THEN 'ignored' WHEN name LIKE 'size-%' THEN 'metric' ELSE 'finding' END AS kind FROM ({d})) GROUP BY kind"
plan("p18_routing", _ROUTE.format(d=_DIAGNOSTICS.format(c="check")), _ROUTE.format(d=_DIAGNOSTICS.format(c='"check"')))


@query("p19_edits_inside", "SELECT doc_id, r, bool_and(o >= s AND o + 12 <= e) AS usable FROM findings JOIN ranges USING (doc_id) WHERE o >= s AND o < e GROUP BY doc_id, r")
def _(spark):
    f = points_in_ranges(spark.table("findings").drop("engine"), spark.table("ranges"), ["doc_id"], "o", "s", "e")
    edits = f.groupBy("doc_id", "r", "s", "e").agg(F.collect_list(F.struct(F.col("o"), F.lit(12).alias("n"))).alias("fix"))
    return edits.select("doc_id", "r", edits_inside(F.col("fix"), F.col("s"), F.col("e")).alias("usable"))


_REASON = "CASE WHEN trim(code) = '' THEN 'no code' WHEN code LIKE '%###%' THEN 'control text in the code' WHEN {n} = 0 AND doc_id % 2 = 0 THEN 'no checks requested' WHEN doc_id % 23 = 0 THEN 'unknown role' WHEN n_tokens + 192 > 4096 THEN 'over the token budget' END"
plan("p20_validation", f"SELECT doc_id, {_REASON.format(n='size(checks)')} AS reject_reason FROM units", f"SELECT doc_id, {_REASON.format(n='len(checks)')} AS reject_reason FROM units")


@query("p21_exactly_one", "SELECT doc_id, engine FROM units WHERE doc_id = 7")
def _(spark):
    one = spark.table("units").where("doc_id = 7").select("doc_id", "engine")
    n = one.agg(F.count("*").alias("n"))
    return one.crossJoin(F.broadcast(n)).where(F.when(F.col("n") != 1, F.raise_error(F.lit("not exactly one row"))).otherwise(True)).drop("n")


@query("p22_no_op", "SELECT doc_id FROM units WHERE replace(code, '!!', '') <> code")
def _(spark):
    after = F.replace("code", F.lit("!!"), F.lit(""))
    return spark.table("units").where(T.normalised(after) != T.normalised(F.col("code"))).select("doc_id")


plan("p23_conditional_update", "SELECT id, system, CASE WHEN new_warning THEN NULL ELSE passed END AS cached, CASE WHEN new_warning THEN concat(want, '!') ELSE want END AS candidate FROM repairs")
_STATUS = "CASE WHEN NOT valid THEN 'invalid answer' WHEN n_tokens > 6000 THEN 'truncated' WHEN p_odd THEN 'unsupported' WHEN NOT (p_low OR p_tox) THEN 'nothing requested' WHEN doc_id % 17 = 0 THEN 'parse error' WHEN doc_id % 19 = 0 THEN 'function count' ELSE 'generated' END"
plan("p24_abstention", f"SELECT doc_id, {_STATUS} AS status FROM flags")


_USES = "CASE p_partkey % 6 WHEN 0 THEN 'CALL (1);' WHEN 1 THEN concat('ALONE; // ', p_name) WHEN 2 THEN 'ALONE + 1;' WHEN 3 THEN 'VALUE' WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN 'assert(2);' ELSE 'other(2);' END ELSE 'BOTH;' END"


@query("p16_macro_origin", "SELECT p_partkey, p_partkey % 7 > 0 AND p_partkey % 6 IN (1, 3) OR p_partkey % 6 = 0 OR p_partkey % 6 = 4 AND p_size % 2 = 0 AS macro FROM part")
def _(spark):
    """Whether a finding's place is a macro's: a call of one with parameters, or one without alone on its line."""
    defines = spark.sql("SELECT '#define CALL(x) x\n  # define ALONE 1\n#define VALUE 2\n#define BOTH(x) 1\n#define BOTH 1' AS text")
    names = defines.select(F.inline(defined_macros(F.col("text")))).groupBy("name").agg(F.max("function_like").alias("called"))
    sets = names.agg(F.collect_list(F.when(F.col("called"), F.col("name"))).alias("called"), F.collect_list(F.when(~F.col("called"), F.col("name"))).alias("alone"))
    start = F.when(F.col("p_partkey") % 7 == 0, "  a = ").otherwise("\t ")
    rows = spark.table("part").select("p_partkey", F.concat(F.lit("// x\n"), start, F.expr(_USES), F.lit("\nend")).alias("code"), (F.length(start) + 5).alias("o"))
    return rows.crossJoin(F.broadcast(sets)).select("p_partkey", at_macro(F.col("code"), F.col("o"), F.array_union("called", F.array(*map(F.lit, STANDARD_MACROS))), F.col("alone")).alias("macro"))


_SPLITS = "(SELECT 'src17' AS engine, 'val' AS split UNION ALL SELECT 'src18', 'test' UNION ALL SELECT 'src19', 'test')"
plan("j01_split_lookup", f"SELECT d.doc_id, coalesce(s.split, 'train') AS split FROM documents d LEFT JOIN {_SPLITS} s ON d.source = s.engine")
plan("j02_alias_lookup", "SELECT f.doc_id, f.line_no, coalesce(a.name, f.check) AS chk FROM findings f LEFT JOIN (SELECT 'style-shout' AS alias, 'style-caps' AS name) a ON f.check = a.alias", "SELECT f.doc_id, f.line_no, coalesce(a.name, f.\"check\") AS chk FROM findings f LEFT JOIN (SELECT 'style-shout' AS alias, 'style-caps' AS name) a ON f.\"check\" = a.alias")
plan("j03_prediction_join", "SELECT p.doc_id, u.lang, p.valid FROM preds p JOIN units u ON p.doc_id = u.doc_id")
plan("j04_paired_systems", "SELECT a.id, a.passed AS adapter, b.passed AS base FROM repairs a JOIN repairs b ON a.id = b.id WHERE a.system = 'adapter' AND b.system = 'base'")
plan("j05_subset_semi", "SELECT f.doc_id, f.valid FROM flags f LEFT SEMI JOIN (SELECT doc_id FROM units WHERE n_tokens BETWEEN 500 AND 2000) m ON f.doc_id = m.doc_id", "SELECT doc_id, valid FROM flags WHERE doc_id IN (SELECT doc_id FROM units WHERE n_tokens BETWEEN 500 AND 2000)")
plan("j06_unknown_labels", "SELECT label, count(*) AS n FROM (SELECT explode(pred) AS label FROM preds) p LEFT ANTI JOIN (SELECT 'low_quality' AS v UNION ALL SELECT 'toxic') k ON p.label = k.v GROUP BY label", "SELECT label, count(*) AS n FROM (SELECT unnest(pred) AS label FROM preds) WHERE label NOT IN ('low_quality', 'toxic') GROUP BY label")
plan("j07_leakage", "SELECT v.doc_id FROM units v LEFT SEMI JOIN (SELECT md5(code) AS h FROM units WHERE split = 'train') t ON md5(v.code) = t.h WHERE v.split <> 'train'", "SELECT doc_id FROM units WHERE split <> 'train' AND md5(code) IN (SELECT md5(code) FROM units WHERE split = 'train')")


@query("j08_shingle_containment", "WITH l AS (SELECT doc_id, split, list_filter(string_split(code, chr(10)), lambda x: length(trim(x)) > 12) AS ls FROM units), s AS (SELECT DISTINCT doc_id, split, md5(array_to_string(list_transform(ls[i:i+2], lambda x: trim(x)), chr(10))) AS h FROM (SELECT doc_id, split, ls, unnest(range(1, len(ls) - 1)) AS i FROM l)), t AS (SELECT DISTINCT h FROM s WHERE split = 'train') SELECT s.doc_id, count(t.h) AS hits, count(*) AS n, count(t.h) * 2 >= count(*) AS leaked FROM s LEFT JOIN t ON s.h = t.h WHERE split <> 'train' GROUP BY s.doc_id")
def _(spark):
    rows = spark.table("units").select("doc_id", "split", F.explode(T.windows(F.filter(F.transform(F.split("code", "\n", -1), lambda x: F.btrim(x)), lambda x: F.length(x) > 12), 3)).alias("h"))
    train = rows.where("split = 'train'").select(F.col("h").alias("t")).distinct()
    held = rows.where("split <> 'train'").join(train, F.col("h") == F.col("t"), "left")
    return held.groupBy("doc_id").agg(F.count("t").alias("hits"), F.count("*").alias("n")).withColumn("leaked", F.col("hits") * 2 >= F.col("n"))


plan("j09_cross_overlap", "SELECT a.split AS fix_split, b.split AS det_split, count(DISTINCT a.h) AS n FROM (SELECT DISTINCT split, md5(code) AS h FROM units WHERE doc_id % 2 = 0) a JOIN (SELECT DISTINCT split, md5(code) AS h FROM units WHERE doc_id % 2 = 1) b ON a.h = b.h GROUP BY a.split, b.split")


@query("j10_span_join", "SELECT f.doc_id, r.r, f.\"check\" AS chk, f.o FROM findings f JOIN ranges r ON f.doc_id = r.doc_id WHERE f.o >= r.s AND f.o < r.e")
def _(spark):
    f = points_in_ranges(spark.table("findings").drop("engine"), spark.table("ranges"), ["doc_id"], "o", "s", "e")
    return f.select("doc_id", "r", F.col("check").alias("chk"), "o")


@query("j11_span_anti", "SELECT doc_id, r FROM ranges r WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.doc_id = r.doc_id AND f.o >= r.s AND f.o < r.e)")
def _(spark):
    hit = points_in_ranges(spark.table("findings").drop("engine"), spark.table("ranges"), ["doc_id"], "o", "s", "e").select("doc_id", "r").distinct()
    return spark.table("ranges").join(hit, ["doc_id", "r"], "left_anti").select("doc_id", "r")


@query("j12_first_witness", "SELECT f.doc_id, r.r, min(f.o) AS o, arg_min(f.\"check\", (f.o, f.\"check\")) AS chk FROM findings f JOIN ranges r ON f.doc_id = r.doc_id WHERE f.o >= r.s AND f.o < r.e GROUP BY f.doc_id, r.r")
def _(spark):
    f = points_in_ranges(spark.table("findings").drop("engine"), spark.table("ranges"), ["doc_id"], "o", "s", "e")
    return f.groupBy("doc_id", "r").agg(F.min("o").alias("o"), F.min_by("check", F.struct("o", "check")).alias("chk"))


_INC = "SELECT page_id, lower(regexp_extract(url, '[a-z]+/[0-9]+', 0)) AS inc FROM pages WHERE page_id % 4 = 0"
_FILES = "SELECT page_id AS file_id, lower(regexp_extract(url, '//(.*/[a-z]+/[0-9]+)', 1)) AS path FROM pages"
plan("j13_suffix_join", f"SELECT i.page_id, f.file_id FROM ({_INC}) i JOIN ({_FILES}) f ON regexp_extract(i.inc, '([0-9]+)$', 1) = regexp_extract(f.path, '([0-9]+)$', 1) AND right(concat('/', f.path), length(i.inc) + 1) = concat('/', i.inc) WHERE i.inc <> ''")
plan("j14_found_beside", f"SELECT page_id FROM ({_INC}) i LEFT ANTI JOIN (SELECT path FROM ({_FILES}) WHERE file_id % 2 = 0) f ON f.path = i.inc", f"SELECT page_id FROM ({_INC}) WHERE inc NOT IN (SELECT path FROM ({_FILES}) WHERE file_id % 2 = 0)")
plan("j15_vendor_not_voted", "SELECT c_mktsegment, n FROM (SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment LIMIT 4) v LEFT ANTI JOIN (SELECT c_mktsegment AS s FROM customer WHERE c_nationkey = 3 GROUP BY c_mktsegment HAVING count(*) > 12) e ON v.c_mktsegment = e.s ORDER BY n DESC, c_mktsegment LIMIT 2", "SELECT c_mktsegment, n FROM (SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment LIMIT 4) WHERE c_mktsegment NOT IN (SELECT c_mktsegment AS s FROM customer WHERE c_nationkey = 3 GROUP BY c_mktsegment HAVING count(*) > 12) ORDER BY n DESC, c_mktsegment LIMIT 2")
plan("j16_has_member", "SELECT s_suppkey FROM supplier s LEFT SEMI JOIN (SELECT n_nationkey FROM nation WHERE n_name LIKE '%A%') n ON s.s_nationkey = n.n_nationkey", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name LIKE '%A%')")


@query("j17_resume_scan", "SELECT DISTINCT path, cfg FROM scanlog WHERE (path, cfg) NOT IN (SELECT (path, cfg) FROM scanlog WHERE status = 'click')")
def _(spark):
    log = spark.table("scanlog")
    return io.unseen(log.select("path", "cfg").distinct(), log.where("status = 'click'"), ["path", "cfg"])


plan("j18_null_rejecting", "SELECT a.id, a.system FROM repairs a JOIN repairs b ON a.id = b.id AND a.want = b.want AND a.remaining = b.remaining AND b.system = 'tool' WHERE a.system <> 'tool'")
plan("j19_broadcast_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
plan("j20_scalar_threshold", "SELECT doc_id, n_tokens >= t AS predicted FROM units CROSS JOIN (SELECT avg(n_tokens) AS t FROM units WHERE split = 'train') x")
plan("j21_coverage", "SELECT coalesce(e.id, r.id) AS id, coalesce(e.system, r.system) AS system, coalesce(r.n, 0) AS n FROM (SELECT id, system FROM (SELECT DISTINCT id FROM repairs) i CROSS JOIN (SELECT DISTINCT system FROM repairs) s) e FULL OUTER JOIN (SELECT id, system, count(*) AS n FROM repairs WHERE NOT truncated GROUP BY id, system) r ON e.id = r.id AND e.system = r.system WHERE r.n IS NULL OR r.n <> 1 OR e.id IS NULL")
plan("j22_keyed_zip", "SELECT g.doc_id, g.n_checks, p.n_pred FROM (SELECT doc_id, size(gold) AS n_checks FROM preds) g JOIN (SELECT doc_id, size(pred) AS n_pred FROM preds) p ON g.doc_id = p.doc_id", "SELECT doc_id, len(gold)::INTEGER AS n_checks, len(pred)::INTEGER AS n_pred FROM preds")
plan("j23_result_to_row", "SELECT p.doc_id, r.system, r.passed FROM preds p JOIN repairs r ON p.doc_id = r.id")
plan("j24_substitution", "WITH c AS (SELECT system, count(*) = (SELECT count(DISTINCT id) FROM repairs) AS whole FROM repairs WHERE NOT truncated GROUP BY system) SELECT r.id, r.system, r.passed FROM repairs r JOIN c ON r.system = c.system WHERE c.whole UNION ALL SELECT t.id, c.system, t.passed FROM repairs t CROSS JOIN c WHERE t.system = 'tool' AND NOT c.whole")


@query("j25_distinct_before_call", "SELECT doc_id, length(code)::BIGINT AS n FROM units")
def _(spark):
    u = spark.table("units").select("doc_id", "code", F.sha2("code", 256).alias("h"))
    called = u.groupBy("h").agg(F.any_value("code").alias("c")).select(F.col("h").alias("g"), F.length("c").cast("bigint").alias("n"))
    return u.select("doc_id", "h").join(called, F.col("h") == F.col("g")).select("doc_id", "n")


_PASSED = "SELECT id FROM repairs WHERE system = 'tool' AND passed"
#: Ids that only the cohort or only the record has: none, or the comparison would mix rows.
_STRANGE = f"(SELECT count(*) FROM (({_PASSED} EXCEPT SELECT id FROM repairs WHERE system = 'base') UNION ALL (SELECT id FROM repairs WHERE system = 'adapter' AND id IN ({_PASSED}) EXCEPT {_PASSED})))"
plan("j26_matched_cohort", f"SELECT r.id, r.system, {_STRANGE} AS strange FROM repairs r WHERE r.id IN ({_PASSED})")

plan("so01_split_overlap", "SELECT kind, a, b, count(*) AS n FROM (SELECT kind, h, min(split) AS a, max(split) AS b FROM (SELECT 'engine' AS kind, engine AS h, split FROM units UNION ALL SELECT 'text', md5(code), split FROM units) GROUP BY kind, h HAVING count(DISTINCT split) > 1) GROUP BY kind, a, b")


@query("so02_bag_difference", "WITH o AS (SELECT \"check\" AS chk, message, count(*) AS n FROM findings WHERE doc_id % 2 = 0 GROUP BY ALL), w AS (SELECT \"check\" AS chk, message, count(*) AS n FROM findings WHERE doc_id % 2 = 1 GROUP BY ALL) SELECT w.chk, w.message, (w.n - coalesce(o.n, 0))::BIGINT AS n FROM w LEFT JOIN o ON w.chk = o.chk AND w.message = o.message WHERE w.n > coalesce(o.n, 0)")
def _(spark):
    part = lambda k: spark.table("findings").where(F.col("doc_id") % 2 == k).select(F.col("check").alias("chk"), "message")
    return part(1).exceptAll(part(0)).groupBy("chk", "message").agg(F.count("*").alias("n"))


plan("so03_pairwise_union", "SELECT md5(code) AS h FROM units GROUP BY md5(code) HAVING count(DISTINCT split) > 1")
plan("so04_union", "SELECT label FROM (SELECT explode(gold) AS label FROM preds) UNION SELECT label FROM (SELECT explode(pred) AS label FROM preds)", "SELECT DISTINCT label FROM (SELECT unnest(gold) AS label FROM preds UNION ALL SELECT unnest(pred) FROM preds)")
plan("so05_array_algebra", "SELECT doc_id, array_sort(array_intersect(gold, pred)) AS both, array_sort(array_except(pred, gold)) AS extra, array_sort(array_union(gold, pred)) AS any_of, gold = pred AS same FROM preds", "SELECT doc_id, list_sort(list_filter(pred, lambda x: list_contains(gold, x))) AS both, list_sort(list_filter(pred, lambda x: NOT list_contains(gold, x))) AS extra, list_sort(list_distinct(list_concat(gold, pred))) AS any_of, gold = pred AS same FROM preds")
plan("so06_set_equality", "SELECT system, count(*) = count(DISTINCT id) AS distinct_ids, count_if(id NOT IN (SELECT doc_id FROM units WHERE split = 'test')) = 0 AS known FROM repairs GROUP BY system")
plan("so07_set_difference", "SELECT engine FROM units WHERE n_tokens > 3000 EXCEPT SELECT engine FROM units WHERE n_tokens > 20000")
plan("so08_distinct_edits", "SELECT doc_id, size(array_distinct(flatten(array(gold, pred, gold)))) AS n FROM preds", "SELECT doc_id, len(list_distinct(list_concat(list_concat(gold, pred), gold)))::INTEGER AS n FROM preds")
