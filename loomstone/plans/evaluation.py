"""Ordered operators: length rules, rankings, samples, packing, bootstrap, early stopping."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstone.functions import text as T
from loomstone.operators import dedup, metrics, sample
from loomstone.plans.catalog import plan, query
from loomstone.sources import io


@query("w02_latest_record", "SELECT path, cfg, max(seq) AS seq, arg_max(status, seq) AS status FROM scanlog GROUP BY path, cfg")
def _(spark):
    return io.latest(spark.table("scanlog").select("path", "cfg", "seq", "status"), ["path", "cfg"], "seq")


_RULE = "SELECT n_tokens AS v, count(*) AS n, count_if(low) AS p FROM units WHERE split = 'train' AND labelled GROUP BY n_tokens"


@query("w04_length_rule_observed", f"SELECT v AS threshold, round(((sum(n - p) OVER w - (n - p)) + (SELECT sum(p) FROM ({_RULE})) - (sum(p) OVER w - p)) / (SELECT sum(n) FROM ({_RULE}))::DOUBLE, 9) AS accuracy FROM ({_RULE}) WINDOW w AS (ORDER BY v) ORDER BY 2 DESC, 1 LIMIT 1")
def _(spark):
    out = metrics.length_rule(spark.table("units").where("split = 'train' AND labelled"), "n_tokens", "low", "observed")
    return out.withColumn("accuracy", F.round("accuracy", 9))


@query("w05_length_rule_gap", f"WITH c AS ({_RULE}), s AS (SELECT v + 1 AS threshold, (sum(n - p) OVER w + (SELECT sum(p) FROM c) - sum(p) OVER w) / (SELECT sum(n) FROM c)::DOUBLE AS accuracy FROM c WINDOW w AS (ORDER BY v) UNION ALL SELECT 0, (SELECT sum(p) / sum(n)::DOUBLE FROM c)) SELECT threshold, round(accuracy, 9) AS accuracy FROM s ORDER BY accuracy DESC, threshold LIMIT 1")
def _(spark):
    out = metrics.length_rule(spark.table("units").where("split = 'train' AND labelled"), "n_tokens", "low", "gap")
    return out.withColumn("accuracy", F.round("accuracy", 9))


_SHA = "sha256('{seed}|{ns}|' || doc_id::VARCHAR)"


@query("w06_round_robin_sample", f"SELECT doc_id, engine, r::INTEGER AS round FROM (SELECT doc_id, engine, row_number() OVER (PARTITION BY engine ORDER BY {_SHA.format(seed=5, ns='pilot')}, doc_id) AS r FROM units) ORDER BY r, engine, doc_id LIMIT 57")
def _(spark):
    return sample.round_robin(spark.table("units").select("doc_id", "engine"), "engine", 57, 5, "doc_id")


@query("w07_hash_rank", f"SELECT doc_id, {_SHA.format(seed=42, ns='x')} AS rank FROM units")
def _(spark):
    return spark.table("units").select("doc_id", sample.rank_key(42, "x", F.col("doc_id")).alias("rank"))


@query("w08_rarest_first", f"WITH e AS (SELECT doc_id, unnest(pred) AS label FROM preds), c AS (SELECT label, count(*) AS n FROM e GROUP BY label), r AS (SELECT doc_id, min(n) AS rarity FROM e JOIN c USING (label) GROUP BY doc_id) SELECT doc_id, engine, place::INTEGER AS place FROM (SELECT p.doc_id, p.engine, row_number() OVER (PARTITION BY p.engine ORDER BY r.rarity, {_SHA.format(seed=3, ns='fix').replace('doc_id', 'p.doc_id')}, p.doc_id) AS place FROM preds p JOIN r ON p.doc_id = r.doc_id WHERE valid) WHERE place <= 3")
def _(spark):
    return sample.rarest_first(spark.table("preds"), "engine", "pred", "valid", 3, 3, "doc_id").select("doc_id", "engine", "place")


@query("w09_balanced_bins", f"WITH b AS (SELECT doc_id, low, (n_tokens // 500) AS bin FROM units WHERE labelled), k AS (SELECT bin, least(count_if(low), count_if(NOT low)) AS k FROM b GROUP BY bin) SELECT doc_id, bin::BIGINT AS bin, low FROM (SELECT b.*, k.k, row_number() OVER (PARTITION BY b.bin, low ORDER BY {_SHA.format(seed=9, ns='balanced')}, doc_id) AS r FROM b JOIN k ON b.bin = k.bin) WHERE r <= k")
def _(spark):
    rows = spark.table("units").where("labelled").select("doc_id", "low", F.expr("n_tokens div 500").alias("bin"))
    return sample.balanced(rows, ["bin"], "low", 9, "doc_id").select("doc_id", "bin", "low")


@query("w10_length_following", f"""WITH u AS (SELECT doc_id, engine, low, n_tokens FROM units WHERE labelled), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY {_SHA.format(seed=9, ns='positive')}, doc_id) AS r FROM u WHERE low) WHERE r <= 4),
e AS (SELECT engine, list_distinct(list_transform(quantile_cont(n_tokens, [0.25, 0.5, 0.75]), lambda x: floor(round(x, 6))::BIGINT)) AS edges FROM t GROUP BY engine),
b AS (SELECT u.*, len(list_filter(edges, lambda x: x <= n_tokens)) AS bin FROM u JOIN e ON u.engine = e.engine), n AS (SELECT engine, bin, round_even(count(*) * 1.5, 0)::BIGINT AS k FROM b WHERE doc_id IN (SELECT doc_id FROM t) GROUP BY engine, bin)
SELECT doc_id, low FROM t UNION ALL SELECT doc_id, low FROM (SELECT b.*, n.k, row_number() OVER (PARTITION BY b.engine, b.bin ORDER BY {_SHA.format(seed=9, ns='negative')}, doc_id) AS r FROM b JOIN n ON b.engine = n.engine AND b.bin = n.bin WHERE NOT low) WHERE r <= k""")
def _(spark):
    rows = spark.table("units").where("labelled").select("doc_id", "engine", "low", "n_tokens")
    return sample.following_lengths(rows, "engine", "n_tokens", "low", 4, 1.5, 4, 9, "doc_id").select("doc_id", "low")


@query("w11_systematic_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM units) WHERE i IN (SELECT floor(k * (SELECT count(*) FROM units) / 24.0)::BIGINT FROM range(24) t(k))")
def _(spark):
    return sample.systematic(spark.table("units").select("doc_id"), "doc_id", 24)


@query("w13_primary_stratum", "WITH e AS (SELECT doc_id, unnest(pred) AS label FROM preds), c AS (SELECT label, count(*) AS n FROM e GROUP BY label) SELECT doc_id, arg_min(label, (n, label)) AS stratum FROM e JOIN c USING (label) GROUP BY doc_id")
def _(spark):
    e = spark.table("preds").select("doc_id", F.explode("pred").alias("label"))
    c = e.groupBy("label").agg(F.count("*").alias("n"))
    return e.join(c, "label").groupBy("doc_id").agg(F.min_by("label", F.struct("n", "label")).alias("stratum"))


@query("w14_first_match", "SELECT doc_id, arg_min(\"check\", o) AS chk, min(o) AS o FROM (SELECT doc_id, \"check\", o FROM findings QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o, \"check\") = 1) GROUP BY doc_id")
def _(spark):
    return spark.table("findings").groupBy("doc_id").agg(F.min_by("check", F.struct("o", "check")).alias("chk"), F.min("o").alias("o"))


_HISTORY = "SELECT l_returnflag AS run, l_linenumber AS epoch, round(avg(l_extendedprice), 2) AS loss FROM lineitem GROUP BY l_returnflag, l_linenumber"
@query("w15_early_stopping", f"""WITH h AS ({_HISTORY}), b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
i AS (SELECT *, before IS NULL OR loss < before AS improved FROM b), t AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last, max(epoch) OVER (PARTITION BY run) AS epochs FROM i),
e AS (SELECT run, min(epoch) AS stop FROM t WHERE epoch - last >= 2 GROUP BY run)
SELECT t.run, epoch, loss, least(before, loss) AS best, improved, epoch - last AS stale, epoch = stop AND epoch < epochs AS stopped FROM t LEFT JOIN e ON t.run = e.run WHERE stop IS NULL OR epoch <= stop""".replace("epoch = stop AND epoch < epochs", "coalesce(epoch = stop AND epoch < epochs, false)"))
def _(spark):
    return metrics.early_stopping(spark.sql(_HISTORY), "run", "epoch", "loss", 2)


@query("w16_paired_bootstrap")
def _(spark):
    """Difference of pass rates with a percentile interval from 10,000 resamples of all pairs."""
    a, b = (spark.table("repairs").where(F.col("system") == s).select("id", F.col("passed").cast("int").alias(s)) for s in ("adapter", "base"))
    return metrics.paired_bootstrap(a.join(b, "id").select((F.col("adapter") - F.col("base")).alias("d")), "d")


@query("l01_sorted_write", "SELECT doc_id, row_number() OVER (ORDER BY doc_id)::BIGINT AS place FROM units WHERE split = 'test'")
def _(spark):
    """Written in id order; a row's place comes from ranges and their sizes, not from a task that sees all rows."""
    path = dedup.scratch(spark)
    spark.table("units").where("split = 'test'").select("doc_id", "engine").repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return dedup.numbered(spark.read.parquet(path).select("doc_id", F.col("doc_id").alias("place")), "place").select("doc_id", (F.col("place") + 1).alias("place"))


plan("l02_top_k", "SELECT engine, n FROM (SELECT engine, count(*) AS n FROM units GROUP BY engine) ORDER BY n DESC, engine LIMIT 5")
plan("l03_prefix_limit", "SELECT doc_id, slice(array_sort(pred), 1, 1) AS first FROM preds", "SELECT doc_id, pred[1:1] AS first FROM preds")
plan("l04_boolean_key_sort", "SELECT doc_id FROM flags ORDER BY NOT p_tox, n_tokens, doc_id LIMIT 20")
plan("l05_shortest_per_category", "SELECT engine, min_by(doc_id, struct(n_tokens, doc_id)) AS doc_id FROM units GROUP BY engine", "SELECT engine, arg_min(doc_id, (n_tokens, doc_id)) AS doc_id FROM units GROUP BY engine")
plan("l06_length_order", "SELECT doc_id, n_tokens FROM units ORDER BY n_tokens DESC, doc_id LIMIT 50")


@query("l07_batch_packing")
def _(spark):
    """Pools are hash-dealt groups of about 50,000 rows, as many as the table needs."""
    u = spark.table("units")
    u = u.withColumn("pool", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-u.count() // 50_000)))))
    return sample.pack_batches(u.select("pool", "doc_id", "n_tokens"), "pool", "n_tokens", "doc_id", 16, 40_000)


plan("l08_worst_share", "SELECT engine, n, share FROM (SELECT engine, count(*) AS n, round(avg(CASE WHEN low THEN 1.0D ELSE 0.0D END), 9) AS share FROM units WHERE labelled GROUP BY engine) WHERE n >= 10 ORDER BY share, n, engine LIMIT 6", "SELECT engine, n, share FROM (SELECT engine, count(*) AS n, round(avg(CASE WHEN low THEN 1.0 ELSE 0.0 END), 9) AS share FROM units WHERE labelled GROUP BY engine) WHERE n >= 10 ORDER BY share, n, engine LIMIT 6")

_BUCKET = "('0x' || left(md5(doc_id::VARCHAR), 6))::BIGINT % 100 < 80"


@query("g04_random_split", f"SELECT doc_id, CASE WHEN {_BUCKET} THEN 'train' ELSE 'test' END AS side FROM units")
def _(spark):
    return spark.table("units").select("doc_id", sample.bucket_split(F.col("doc_id"), 80).alias("side"))


@query("g05_shuffle_select", f"SELECT doc_id FROM units ORDER BY {_SHA.format(seed=1, ns='sample')}, doc_id LIMIT 40")
def _(spark):
    return sample.simple(spark.table("units").select("doc_id"), 40, 1, "doc_id")


@query("g06_simple_sample", f"SELECT doc_id FROM units WHERE low ORDER BY {_SHA.format(seed=2, ns='sample')}, doc_id LIMIT 10")
def _(spark):
    return sample.simple(spark.table("units").where("low").select("doc_id"), 10, 2, "doc_id")


@query("g07_frozen_pilot", f"WITH s AS (SELECT label, count(*) AS n FROM (SELECT unnest(pred) AS label FROM preds WHERE split = 'train') GROUP BY label), ok AS (SELECT list(label) AS known FROM s WHERE n >= 5), c AS (SELECT p.doc_id, arg_min(s.label, (s.n, s.label)) AS stratum FROM (SELECT doc_id, unnest(pred) AS label FROM preds WHERE split <> 'train' AND n_tokens <= 4000) p JOIN s ON p.label = s.label GROUP BY p.doc_id), e AS (SELECT c.* FROM c JOIN preds ON c.doc_id = preds.doc_id, ok WHERE len(list_filter(pred, lambda x: NOT list_contains(known, x))) = 0) SELECT doc_id, stratum FROM (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {_SHA.format(seed=4, ns='pilot')}, doc_id) AS r FROM e) ORDER BY r, stratum, doc_id LIMIT 12")
def _(spark):
    p = spark.table("preds")
    support = p.where("split = 'train'").select(F.explode("pred").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    known = support.where("n >= 5").agg(F.collect_list("label").alias("known"))  # a label vocabulary: a few dozen rows
    good = p.where("split <> 'train' AND n_tokens <= 4000").crossJoin(F.broadcast(known)).where(F.size(F.array_except("pred", "known")) == 0)
    strata = good.select("doc_id", F.explode("pred").alias("label")).join(support, "label").groupBy("doc_id").agg(F.min_by("label", F.struct("n", "label")).alias("stratum"))
    return sample.round_robin(strata, "stratum", 12, 4, "doc_id").select("doc_id", "stratum")


@query("a22_interval_by_check", "SELECT want, k, n, round(greatest((k / n::DOUBLE + z2 / (2 * n)) / (1 + z2 / n) - h, 0), 9) AS low, round(least((k / n::DOUBLE + z2 / (2 * n)) / (1 + z2 / n) + h, 1), 9) AS high FROM (SELECT *, sqrt(z2) * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + z2 / (4 * n * n)) / (1 + z2 / n) AS h FROM (SELECT want, count_if(passed) AS k, count(*) AS n, 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE AS z2 FROM repairs GROUP BY want))")
def _(spark):
    rows = spark.table("repairs").groupBy("want").agg(F.count_if("passed").alias("k"), F.count("*").alias("n")).withColumns(metrics.wilson(F.col("k"), F.col("n")))
    return rows.withColumns({c: F.round(c, 9) for c in ("low", "high")})


@query("sc17_length_bins", "SELECT bin, count(*) AS n FROM (SELECT len(list_filter([500, 1000, 2000, 4000], lambda x: x <= n_tokens))::BIGINT AS bin FROM units) GROUP BY bin")
def _(spark):
    edges = F.array(*(F.lit(x) for x in (500, 1000, 2000, 4000)))
    return spark.table("units").select(T.bin_of(edges, F.col("n_tokens")).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
