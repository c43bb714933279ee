"""Splits and samples that depend on hashes of ids, never on row order or a seeded generator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstone.functions.text import bin_of, edges_of


def rank_key(seed: int, namespace: str, key: Column) -> Column:
    """Stable rank of an id: the hex digest of seed, namespace and id."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(namespace), key.cast("string")), 256)


def entity_split(entity: Column, splits: dict[str, list[str]], default: str = "train") -> Column:
    out = F.lit(default)
    for name, entities in splits.items():
        out = F.when(entity.isin(entities), F.lit(name)).otherwise(out)
    return out


def bucket_split(key: Column, percent: int, inside: str = "train", outside: str = "test") -> Column:
    """Hash-bucket split: a row's side depends on its id alone."""
    return F.when(F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("bigint") % 100 < percent, inside).otherwise(outside)


def simple(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement, by hashed rank."""
    return rows.orderBy(rank_key(seed, "sample", F.col(key)), key).limit(n)


def round_robin(rows: DataFrame, stratum: str, n: int, seed: int, key: str) -> DataFrame:
    """One row of each stratum a round until n are taken; strata in order, rows by hashed rank. Only the first n of a stratum move on."""
    w = Window.partitionBy(stratum).orderBy(rank_key(seed, "pilot", F.col(key)), key)
    return rows.withColumn("round", F.row_number().over(w)).where(F.col("round") <= n).orderBy("round", stratum, key).limit(n)


def balanced(rows: DataFrame, by: list[str], positive: str, seed: int, key: str) -> DataFrame:
    """In each bin as many positive as negative rows: the smaller count of the two."""
    counts = rows.groupBy(*by).agg(F.least(F.count_if(positive), F.count_if(~F.col(positive))).alias("_k"))
    w = Window.partitionBy(*by, positive).orderBy(rank_key(seed, "balanced", F.col(key)), key)
    return rows.join(counts, by).withColumn("_r", F.row_number().over(w)).where("_r <= _k").drop("_r", "_k")


def following(rows: DataFrame, entity: str, bin_: str, positive: str, most: int, ratio: float, seed: int, key: str) -> DataFrame:
    """For each entity at most `most` positives, and in each bin negatives in proportion to the positives taken (half to even)."""
    w = Window.partitionBy(entity).orderBy(rank_key(seed, "positive", F.col(key)), key)
    taken = rows.where(positive).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
    need = taken.groupBy(entity, bin_).agg(F.bround(F.count("*") * F.lit(float(ratio)), 0).cast("bigint").alias("_k"))
    v = Window.partitionBy(entity, bin_).orderBy(rank_key(seed, "negative", F.col(key)), key)
    rest = rows.where(~F.col(positive)).join(need, [entity, bin_]).withColumn("_r", F.row_number().over(v)).where("_r <= _k").drop("_r", "_k")
    return taken.unionByName(rest.select(taken.columns))


def following_lengths(rows: DataFrame, entity: str, length: str, positive: str, most: int, ratio: float, bins: int, seed: int, key: str) -> DataFrame:
    """As following, with bins between the percentiles of each entity's own taken positives; an entity without any gives nothing."""
    w = Window.partitionBy(entity).orderBy(rank_key(seed, "positive", F.col(key)), key)
    taken = rows.where(positive).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    inner = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    edges = taken.groupBy(entity).agg(edges_of(F.percentile(length, inner)).alias("_edges"))
    binned = rows.join(edges, entity).withColumn("_bin", bin_of(F.col("_edges"), F.col(length))).drop("_edges")
    return following(binned, entity, "_bin", positive, most, ratio, seed, key).drop("_bin")


def rarest_first(rows: DataFrame, entity: str, labels: str, good: str, most: int, seed: int, key: str) -> DataFrame:
    """Up to `most` good rows of each entity, those with the rarest label first; rarity counts a label over all rows."""
    counts = rows.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("_n"))
    rarity = rows.select(key, F.explode(labels).alias("label")).join(counts, "label").groupBy(key).agg(F.min("_n").alias("rarity"))
    w = Window.partitionBy(entity).orderBy("rarity", rank_key(seed, "fix", F.col(key)), key)
    return rows.where(good).join(rarity, key).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def systematic(rows: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at equal steps in a stated order."""
    total = rows.count()
    at = rows.sparkSession.range(n).select(F.floor(F.col("id") * (total / n)).alias("_at")) if total > n else rows.sparkSession.range(total).select(F.col("id").alias("_at"))
    from loomstone.operators.dedup import numbered

    ranks = numbered(rows.select(F.col(order).alias("_o"), F.col(order).alias("_k")), "_o").select(F.col("_k").alias(order), F.col("_o").alias("_at"))
    return rows.join(ranks.join(at, "_at"), order).drop("_at")


def group_splits(sizes: DataFrame, group: str, size: str, fractions: dict[str, float], big: int, bucket: int = 20_000) -> DataFrame:
    """group, split: big groups go to the first split; each other one, in hashed order, to the split that lacks most of its share.

    The order decides, so the groups of a bucket pass one by one, as sorted (group, size) rows of one frame. A bucket holds about `bucket`
    groups, dealt by hash, and keeps the fractions by itself: the rule is the same at every size, and no task sees more than that.
    """

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        names, share = list(fractions), np.array(list(fractions.values()))
        target, have, out = share * pdf["size"].sum(), np.zeros(len(names)), []
        for n in pdf.sort_values(["is_small", "rank"])["size"]:
            k = 0 if n > big else int(np.argmax((target - have) / target))
            have[k] += n
            out.append(names[k])
        return pd.DataFrame({"group": pdf.sort_values(["is_small", "rank"])["group"].to_numpy(), "split": out})

    total = max(1, -(-sizes.count() // bucket))
    rows = sizes.select(F.col(group).alias("group"), F.col(size).cast("bigint").alias("size"), (F.col(size) <= big).alias("is_small"), F.md5(F.col(group).cast("string")).alias("rank"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(total)))
    return rows.groupBy("bucket").applyInPandas(assign, f"group {sizes.schema[group].dataType.simpleString()}, split string").withColumnRenamed("group", group)


def pack_batches(rows: DataFrame, pool: str, length: str, key: str, most_rows: int, most_padded: int) -> DataFrame:
    """key, batch: rows of a pool in falling length order, a new batch when rows or padded length would exceed their limit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, key], ascending=[False, True])
        batch, n, top, out = 0, 0, 0, []
        for x in pdf[length]:
            if n and (n + 1 > most_rows or (n + 1) * max(top, x) > most_padded):
                batch, n, top = batch + 1, 0, 0
            n, top = n + 1, max(top, x)
            out.append(batch)
        return pd.DataFrame({pool: pdf[pool], key: pdf[key], "batch": out})

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (pool, key))
    return rows.select(pool, length, key).groupBy(pool).applyInPandas(run, f"{schema}, batch bigint")
