"""One query for each operator, with production parameters, over whole tables; and the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchor_dedup import anchor_dedup
from .best_fit import best_fit
from .chat_tree import chat_tree, read_back
from .crf_extract import extract
from .decontam import decontaminate
from .line_winnow import winnow_lines
from .llr_rules import quality_rules
from .mil_quality import quality_scores
from .parity_join import jaccard_join
from .tables import read
from .token_attr import token_counts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(query):
    QUERIES[query.__name__] = query
    return query


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@_register
def op1_crf_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@_register
def op2_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anchor_dedup(read(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op2_anchor_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, (SELECT unnest(range(20)) AS k)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


@_register
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=13)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


ORACLES["op4_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i+m-1], ' ') AS g FROM (SELECT item_id, ws, least(13, len(ws)) AS m, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(ws[i:i+m-1], ' ') AS g FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT DISTINCT doc_id, i, m FROM hits), (SELECT unnest(range(13)) AS k) WHERE k < m GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, list_sort(list(DISTINCT item_id::VARCHAR)) AS l FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
sha256(coalesce(array_to_string(items.l, ','), '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@_register
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = quality_rules(read(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


@_register
def op8_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8_quality_rules that SQL can state."""
    return op8_quality_rules(spark, sf_dir).drop("llr", "kept")


ORACLES["op8_base_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g) > 1 OR lead(1) OVER (PARTITION BY doc_id, g) = 1 AS again FROM (SELECT doc_id, i, md5(array_to_string(ws[i:i+2], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d))),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM w WHERE again), (SELECT unnest(range(3)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT md5(line)) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(ws) AS base_failed
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)"""


@_register
def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@_register
def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))


ORACLES["op5_parity_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i+4], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN rare r ON a.g = r.g GROUP BY 1, 2),
link AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(a, b) AS (SELECT x, y FROM e UNION SELECT reach.a, e.y FROM reach JOIN e ON reach.b = e.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(r.b, w.doc_id))::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = w.doc_id"""


@_register
def op3_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_register
def op9_winnow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnow_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op9_winnow_lines"] = r"""
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
runs AS (SELECT doc_id, i, md5(to_json(ls[i:i+2])::VARCHAR) AS g FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l)),
later AS (SELECT doc_id, i FROM runs QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, (SELECT unnest(range(3)) AS k)),
line AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM l),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS t, count(*) AS n FROM line ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT l.doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(kept.n, 0))::BIGINT AS n_removed,
CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(kept.t, '')) END AS kept_sha256
FROM l LEFT JOIN kept USING (doc_id)"""


@_register
def op9_winnow_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9_winnow_lines, and runs of one or two lines that hold over 50 words go too: what the pipeline runs."""
    out = winnow_lines(read(spark, sf_dir, "documents"), words=50)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: A conversation whose texts hold the template's own control strings.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


@_register
def op6_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, id AS turn, element_at(array('user', 'assistant'), int(id + 1)) AS role FROM range(2)").withColumn("text", F.lit(CONTROL_TEXT))
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    nodes, paths = chat_tree(turns.union(extra), path, token_pattern())
    return read_back(nodes, paths, path).withColumnRenamed("conv", "conv_id")


ORACLES["op6_chat_tree"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS x FROM t WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(any_value(length(l.x)), 0)::BIGINT AS loss_chars, sha256(coalesce(any_value(l.x), '')) AS loss_sha256,
sum(14 + length(regexp_replace(role, '[\\#<:]', '..', 'g')) + length(regexp_replace(text, '[\\#<]', '..', 'g')))::BIGINT AS formatted_chars
FROM t LEFT JOIN l USING (conv_id) GROUP BY conv_id"""


@_register
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), token_pattern())
