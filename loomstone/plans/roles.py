"""The base tables in the roles that the operators work on, in both dialects: units, predictions, lines, findings, a scan log."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Sources held out for validation and test; every other source trains.
SPLITS = {"val": ["src17"], "test": ["src18", "src19"]}
LABELS = ["low_quality", "toxic"]

_SPLIT = "CASE WHEN source = 'src17' THEN 'val' WHEN source IN ('src18', 'src19') THEN 'test' ELSE 'train' END"
_LOW = "(n_tokens < 600 OR code LIKE '%!!%' OR code LIKE '%***%')"
_TOX = "(code LIKE '%trash%' OR code LIKE '%pathetic%' OR doc_id % 37 = 0)"
_ODD = "(doc_id % 50 = 0)"
_SHOUT, _LICENSE, _LONG = "line LIKE '%!!%'", "line LIKE '%icense%'", "length(line) > 300"

#: name: (what Spark runs, what DuckDB runs). Arrays are sorted, offsets count characters from 0.
VIEWS: dict[str, tuple[str, str]] = {
    "units": (
        f"SELECT d.doc_id, d.source AS engine, d.text AS code, d.lang, d.n_chars AS n_tokens, {_SPLIT} AS split, l.doc_id IS NOT NULL AS labelled, coalesce(l.quality = 0, false) AS low, coalesce(l.toxic = 1, false) AS tox, array_sort(array_compact(array(CASE WHEN l.quality = 0 THEN 'low_quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END))) AS checks FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        f"SELECT d.doc_id, d.source AS engine, d.text AS code, d.lang, d.n_chars AS n_tokens, {_SPLIT} AS split, l.doc_id IS NOT NULL AS labelled, coalesce(l.quality = 0, false) AS low, coalesce(l.toxic = 1, false) AS tox, list_filter([CASE WHEN l.quality = 0 THEN 'low_quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS checks FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "preds": (
        f"SELECT doc_id, engine, split, n_tokens, checks AS gold, CASE WHEN doc_id % 29 <> 0 THEN array_sort(array_compact(array(CASE WHEN {_LOW} THEN 'low_quality' END, CASE WHEN {_TOX} THEN 'toxic' END, CASE WHEN {_ODD} THEN 'odd' END))) ELSE cast(array() AS array<string>) END AS pred, doc_id % 29 <> 0 AS valid FROM units WHERE labelled",
        f"SELECT doc_id, engine, split, n_tokens, checks AS gold, CASE WHEN doc_id % 29 <> 0 THEN list_sort(list_filter([CASE WHEN {_LOW} THEN 'low_quality' END, CASE WHEN {_TOX} THEN 'toxic' END, CASE WHEN {_ODD} THEN 'odd' END], lambda x: x IS NOT NULL)) ELSE []::VARCHAR[] END AS pred, doc_id % 29 <> 0 AS valid FROM units WHERE labelled",
    ),
    "flags": (
        "SELECT doc_id, engine, split, n_tokens, valid, array_contains(gold, 'low_quality') AS g_low, array_contains(gold, 'toxic') AS g_tox, array_contains(pred, 'low_quality') AS p_low, array_contains(pred, 'toxic') AS p_tox, array_contains(pred, 'odd') AS p_odd FROM preds",
        "SELECT doc_id, engine, split, n_tokens, valid, list_contains(gold, 'low_quality') AS g_low, list_contains(gold, 'toxic') AS g_tox, list_contains(pred, 'low_quality') AS p_low, list_contains(pred, 'toxic') AS p_tox, list_contains(pred, 'odd') AS p_odd FROM preds",
    ),
    "lines": (
        "SELECT doc_id, engine, cast(pos + 1 AS bigint) AS line_no, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1 AS o FROM (SELECT doc_id, engine, posexplode(split(code, '\\n', -1)) AS (pos, line) FROM units)",
        "SELECT doc_id, engine, line_no, line, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1)::BIGINT AS o FROM (SELECT doc_id, engine, unnest(range(1, len(string_split(code, chr(10))) + 1)) AS line_no, unnest(string_split(code, chr(10))) AS line FROM units)",
    ),
    "findings": (
        f"SELECT doc_id, engine, line_no, o, check, message FROM (SELECT doc_id, engine, line_no, o, explode(array_compact(array(CASE WHEN {_SHOUT} THEN 'style-shout' END, CASE WHEN {_LICENSE} THEN 'legal-license' END, CASE WHEN {_LONG} THEN 'size-long-line' END))) AS check, left(line, 12) AS message FROM lines)",
        f'SELECT doc_id, engine, line_no, o, "check", message FROM (SELECT doc_id, engine, line_no, o, unnest(list_filter([CASE WHEN {_SHOUT} THEN \'style-shout\' END, CASE WHEN {_LICENSE} THEN \'legal-license\' END, CASE WHEN {_LONG} THEN \'size-long-line\' END], lambda x: x IS NOT NULL)) AS "check", left(line, 12) AS message FROM lines)',
    ),
    "ranges": (
        "SELECT doc_id, engine, r, r * 700 AS s, least(r * 700 + 500, n_tokens) AS e FROM (SELECT doc_id, engine, n_tokens, explode(sequence(0L, floor(n_tokens / 700))) AS r FROM units) WHERE r * 700 < n_tokens",
        "SELECT doc_id, engine, r, r * 700 AS s, least(r * 700 + 500, n_tokens) AS e FROM (SELECT doc_id, engine, n_tokens, unnest(range(0, (floor(n_tokens / 700) + 1)::BIGINT)) AS r FROM units) WHERE r * 700 < n_tokens",
    ),
    "scanlog": (
        "SELECT event_id AS seq, concat('u', cast(user_id AS string)) AS path, event_type AS status, value AS sec, cast(user_id % 7 AS int) AS cfg FROM events",
        "SELECT event_id AS seq, concat('u', user_id::VARCHAR) AS path, event_type AS status, value AS sec, (user_id % 7)::INTEGER AS cfg FROM events",
    ),
    "repairs": (
        "SELECT doc_id AS id, engine, sys AS system, (doc_id * 7 + ord * 3) % 5 < 2 + ord AS passed, (doc_id + ord) % 11 = 0 AS truncated, (doc_id + ord) % 13 = 0 AS more_errors, CASE WHEN (doc_id + ord) % 4 = 0 THEN 'style-shout' END AS remaining, (doc_id + ord) % 6 = 0 AS new_warning, CASE WHEN doc_id % 3 = 0 THEN 'legal-license' ELSE 'style-shout' END AS want, n_tokens / 1000.0 AS seconds FROM (SELECT doc_id, engine, n_tokens, posexplode(array('adapter', 'base', 'tool')) AS (ord, sys) FROM units WHERE split = 'test')",
        "SELECT doc_id AS id, engine, sys AS system, (doc_id * 7 + ord * 3) % 5 < 2 + ord AS passed, (doc_id + ord) % 11 = 0 AS truncated, (doc_id + ord) % 13 = 0 AS more_errors, CASE WHEN (doc_id + ord) % 4 = 0 THEN 'style-shout' END AS remaining, (doc_id + ord) % 6 = 0 AS new_warning, CASE WHEN doc_id % 3 = 0 THEN 'legal-license' ELSE 'style-shout' END AS want, n_tokens / 1000.0 AS seconds FROM (SELECT doc_id, engine, n_tokens, unnest([0, 1, 2]) AS ord, unnest(['adapter', 'base', 'tool']) AS sys FROM units WHERE split = 'test')",
    ),
    "answers": (
        "SELECT doc_id, concat(CASE WHEN doc_id % 5 = 0 THEN 'It finds ' ELSE '' END, '{\"checks\": [', array_join(transform(pred, x -> concat('\"', x, '\"')), ', '), CASE WHEN doc_id % 7 = 0 THEN ', 3' ELSE '' END, ']', CASE WHEN doc_id % 11 = 0 THEN '' ELSE '}' END) AS raw FROM preds WHERE size(pred) > 0",
        "SELECT doc_id, concat(CASE WHEN doc_id % 5 = 0 THEN 'It finds ' ELSE '' END, '{\"checks\": [', array_to_string(list_transform(pred, lambda x: concat('\"', x, '\"')), ', '), CASE WHEN doc_id % 7 = 0 THEN ', 3' ELSE '' END, ']', CASE WHEN doc_id % 11 = 0 THEN '' ELSE '}' END) AS raw FROM preds WHERE len(pred) > 0",
    ),
}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """When each table was last written, as far as the file system tells."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    paths = [fs.Path(f"{sf_dir}/{name}.parquet") for name in TABLES]
    return sf_dir, *(p.getFileSystem(conf).getFileStatus(p).getModificationTime() for p in paths)


def views(spark: SparkSession, sf_dir: str) -> None:
    """Registers tables and roles as temporary views, once for a session and folder, and again when a table is written anew."""
    stamp = _stamp(spark, sf_dir)
    if getattr(spark, "_loomstone_views", None) == stamp:
        return
    spark._loomstone_views = None
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, (sql, _) in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)
    spark._loomstone_views = stamp


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.table(name)


def duck(sql: str) -> str:
    """DuckDB text with the roles it names put before it."""
    sql = re.sub(r"\bcount_if\(", "count(*) FILTER (WHERE ", sql)  # count_if is wider than bigint there
    need: list[str] = []

    def add(text: str) -> None:
        for name, (_, own) in VIEWS.items():
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\s", text) and name not in need:
                add(own)
                need.append(name)

    add(sql)
    head = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in need)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
