"""Filters that account for every row: a cascade names the first test a row fails, and a ledger counts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(rows: DataFrame, *tests: tuple[str, Column], column: str = "drop_reason") -> DataFrame:
    """Adds the name of the first test (a condition to drop) that holds; null for rows that stay."""
    out = F.lit(None).cast("string")
    for name, drop in reversed(tests):
        out = F.when(F.coalesce(drop, F.lit(False)), F.lit(name)).otherwise(out)
    return rows.withColumn(column, out)


def kept(rows: DataFrame, column: str = "drop_reason") -> DataFrame:
    return rows.where(F.col(column).isNull()).drop(column)


def ledger(rows: DataFrame, column: str = "drop_reason") -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("reason")).agg(F.count("*").alias("n"))


def marked(text: Column, markers: tuple[str, ...]) -> Column:
    """True if any marker occurs literally."""
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def over_limits(values: dict[str, Column], limits: dict[str, int], label: str) -> Column:
    """An array with the label if any value with a limit exceeds it; values without a limit don't count."""
    hit = F.lit(False)
    for k, c in values.items():
        if k in limits:
            hit = hit | (c > limits[k])
    return F.when(hit, F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))


def only_known(rows: DataFrame, labels: str, vocabulary: list[str]) -> DataFrame:
    """Labels cut to the vocabulary; rows whose labels are all outside it go, rows without labels stay."""
    known = F.array_intersect(labels, F.array(*map(F.lit, vocabulary)))
    return rows.where((F.size(labels) == 0) | (F.size(known) > 0)).withColumn(labels, known)


def subset_of(labels: str, supported: list[str]) -> Column:
    return F.size(F.array_except(labels, F.array(*map(F.lit, supported)))) == 0
