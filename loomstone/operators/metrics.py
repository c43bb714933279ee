"""Scores of set-valued and binary predictions, intervals, percentiles, and length rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstone.functions.parse import lenient_json, overlap_scores
from loomstone.functions.text import jaccard, token_set

#: Two-sided 95 % quantile of the normal distribution.
Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2.0 * tp, 2 * tp + fp + fn)}


def hits(gold: str = "gold", pred: str = "pred") -> dict[str, Column]:
    return {"tp": F.size(F.array_intersect(gold, pred)), "fp": F.size(F.array_except(pred, gold)), "fn": F.size(F.array_except(gold, pred))}


def micro(rows: DataFrame, *by: str) -> DataFrame:
    """Micro counts and rates, exact match, validity and the binary confusion, in one aggregation."""
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), *(F.sum(c).cast("bigint").alias(k) for k, c in hits().items()),
        F.avg((F.array_sort("gold") == F.array_sort("pred")).cast("double")).alias("exact"), F.avg(F.col("valid").cast("double")).alias("valid_rate"),
        *(F.count_if((F.size("gold") > 0) == F.lit(g)).cast("bigint").alias(k) if k == "positives" else F.count_if(((F.size("gold") > 0) == F.lit(g)) & ((F.size("pred") > 0) == F.lit(p))).cast("bigint").alias(k) for k, g, p in (("b_tp", True, True), ("b_fp", False, True), ("b_fn", True, False), ("b_tn", False, False))),
    )
    rates = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.withColumns(rates | {"accuracy": ratio(F.col("b_tp") + F.col("b_tn"), F.col("n"))})


def per_label(rows: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, support, predicted and rates of every label in gold or prediction."""
    flags = rows.select(*by, "gold", "pred", F.explode(F.array_union("gold", "pred")).alias("label"))
    g, p = F.array_contains("gold", F.col("label")), F.array_contains("pred", F.col("label"))
    sums = flags.groupBy(*by, "label").agg(*(F.count_if(c).cast("bigint").alias(k) for k, c in (("tp", g & p), ("fp", ~g & p), ("fn", g & ~p), ("support", g), ("predicted", p))))
    return sums.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro(rows: DataFrame, *by: str) -> DataFrame:
    """Mean F1 over labels that occur in gold; 0 if none does."""
    return per_label(rows, *by).groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"))


def wilson(k: Column, n: Column) -> dict[str, Column]:
    """Wilson 95 % interval; null without rows."""
    p, z2 = k / n, Z95 * Z95
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return {"low": F.when(n > 0, F.greatest(centre - half, F.lit(0.0))), "high": F.when(n > 0, F.least(centre + half, F.lit(1.0)))}


def length_rule(rows: DataFrame, value: str, positive: str, variant: str = "observed") -> DataFrame:
    """One row: the threshold from which "long is positive" is most often right, and how often.

    observed: the best of the observed values, the smallest on a tie. gap: starts at 0, and only a better value v + 1 replaces it.
    Counts by value come first, so the ordered pass runs over distinct values, not over rows.
    """
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"), F.count_if(positive).alias("p"))
    before = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1 if variant == "observed" else 0)
    all_rows = Window.partitionBy()
    below = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    correct = below(F.col("n") - F.col("p")) + F.sum("p").over(all_rows) - below(F.col("p"))
    scored = counts.select(F.when(F.lit(variant == "observed"), F.col("v")).otherwise(F.col("v") + 1).alias("threshold"), (correct / F.sum("n").over(all_rows)).alias("accuracy"))
    if variant == "gap":
        start = rows.agg(F.lit(0).cast(rows.schema[value].dataType).alias("threshold"), F.avg(F.col(positive).cast("double")).alias("accuracy"))
        scored = scored.unionByName(start)
    return scored.orderBy(F.desc("accuracy"), "threshold").limit(1)


def nearest_rank(rows: DataFrame, value: str, *by: str, points: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles with min, max and mean (two decimals)."""
    disc = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)").alias(f"p{round(100 * p)}") for p in points]
    return rows.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 2).alias("mean"), *disc)


def early_stopping(history: DataFrame, run: str, epoch: str, loss: str, patience: int) -> DataFrame:
    """Of each run the epochs up to the stop: best loss so far, whether it improved (strictly), epochs without improvement, and stopped.

    Training stops at the first epoch that is the patience-th one in a row without a better loss, unless it is the last one anyway. Epochs
    count from 1 without gaps; a run is one window partition, as long as its epochs.
    """
    own = Window.partitionBy(run).orderBy(epoch)
    before = F.min(loss).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.withColumn("_before", before).withColumn("improved", F.coalesce(F.col(loss) < F.col("_before"), F.lit(True)))
    rows = rows.withColumn("stale", F.col(epoch) - F.max(F.when(F.col("improved"), F.col(epoch))).over(own))
    rows = rows.withColumns({"_stop": F.min(F.when(F.col("stale") >= patience, F.col(epoch))).over(Window.partitionBy(run)), "_last": F.max(epoch).over(Window.partitionBy(run))})
    stopped = F.coalesce((F.col(epoch) == F.col("_stop")) & (F.col(epoch) < F.col("_last")), F.lit(False))
    return rows.where(F.col("_stop").isNull() | (F.col(epoch) <= F.col("_stop"))).select(run, epoch, loss, F.least("_before", loss).alias("best"), "improved", "stale", stopped.alias("stopped"))


def paired_bootstrap(pairs: DataFrame, difference: str, resamples: int = 10_000, seed: int = 20_261_015) -> DataFrame:
    """One row: difference (mean), low, high, from resamples of as many pairs as there are, drawn with replacement.

    Differences of outcomes are -1, 0 or 1, so a resample's mean depends only on how often each is drawn: counts that are multinomial
    with the observed shares. They are drawn as such, each resample by its own seed, and no pair is copied. Ends are the order statistics at
    int(.025 * resamples) and int(.975 * resamples). Without pairs all three are null.
    """
    counts = pairs.agg(F.count("*").alias("n"), *(F.count_if(F.col(difference) == d).alias(name) for d, name in ((-1, "worse"), (1, "better"))))
    draws = pairs.sparkSession.range(resamples).crossJoin(F.broadcast(counts)).where("n > 0")  # one row of counts

    def draw(batches):
        for pdf in batches:
            means = []
            for b, n, worse, better in pdf.itertuples(index=False):
                got = np.random.default_rng([seed, int(b)]).multinomial(n, [worse / n, better / n, (n - worse - better) / n])
                means.append((got[1] - got[0]) / n)
            yield pd.DataFrame({"mean": means})

    means = draws.mapInPandas(draw, "mean double").agg(F.array_sort(F.collect_list("mean")).alias("m"))  # `resamples` numbers
    ends = means.select(F.get("m", int(0.025 * resamples)).alias("low"), F.get("m", min(resamples - 1, int(0.975 * resamples))).alias("high"))
    return counts.select(F.when(F.col("n") > 0, (F.col("better") - F.col("worse")) / F.col("n")).alias("difference")).crossJoin(ends)


def legacy_fixing(rows: DataFrame, predicted: str, gold: str) -> DataFrame:
    """One row from pairs of JSON answers: json_validity, avg_explanation_match, avg_ast_similarity, n_scored, avg_bleu, avg_rouge.

    An answer is read leniently. If either side is invalid all scores of the pair are 0. Where both are valid but a code is empty, the pair
    has no BLEU and ROUGE and does not count for their means: n_scored is how many do.
    """
    p, g = lenient_json(F.col(predicted)), lenient_json(F.col(gold))
    code = lambda x: F.coalesce(F.get_json_object(x, "$.fixed_code"), F.lit(""))
    types = lambda x: F.array_distinct(F.transform(F.coalesce(F.from_json(F.get_json_object(x, "$.explanations"), "array<struct<smell_type:string>>"), F.array().cast("array<struct<smell_type:string>>")), lambda e: F.coalesce(e["smell_type"], F.lit(""))))
    rows = rows.select(p.alias("p"), g.alias("g")).withColumns({"a": code(F.col("p")), "b": code(F.col("g")), "x": types(F.col("p")), "y": types(F.col("g"))})
    both = F.col("p").isNotNull() & F.col("g").isNotNull()
    match = F.when(F.size("y") > 0, F.size(F.array_intersect("x", "y")) / F.size("y")).otherwise(F.when(F.size("x") == 0, 1.0).otherwise(0.0))
    scored = F.when(both & ((F.col("a") == "") | (F.col("b") == "")), False).otherwise(True)
    rows = rows.select("p", both.alias("both"), scored.alias("scored"), match.alias("match"), jaccard(token_set(F.col("a")), token_set(F.col("b"))).alias("alike"), overlap_scores("b", "a").alias("o"))
    zero = lambda c: F.avg(F.when(F.col("both"), c).otherwise(0.0))
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("scored"), F.when(F.col("both"), c).otherwise(0.0))), F.lit(0.0))
    return rows.agg(F.avg(F.col("p").isNotNull().cast("double")).alias("json_validity"), zero(F.col("match")).alias("avg_explanation_match"), zero(F.col("alike")).alias("avg_ast_similarity"), F.count_if("scored").alias("n_scored"), mean(F.col("o.bleu")).alias("avg_bleu"), mean(F.col("o.rouge_l")).alias("avg_rouge"))
