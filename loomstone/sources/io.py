"""Sources and sinks: JSON lines, file listings, append logs, split-partitioned tables, manifests."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each non-blank line; a line that is no such object makes the query that reads it fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document that spans lines, such as a configuration."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl_first(spark: SparkSession, path: str, schema: str, order: str, n: int) -> DataFrame:
    """The first n rows by a stated order: lines of distributed files have none of their own."""
    return read_jsonl(spark, path, schema).orderBy(order).limit(n)


def read_tolerant(lines: DataFrame, required: list[str], column: str = "value") -> DataFrame:
    """Every non-blank line with why it is rejected: not JSON, or a required key is missing; null if it is good."""
    rows = lines.where(F.btrim(column) != "")
    value = F.try_parse_json(F.col(column))
    keys = F.json_object_keys(F.when(value.isNotNull(), F.col(column)))
    lacks = F.size(F.array_except(F.array(*map(F.lit, required)), F.coalesce(keys, F.array().cast("array<string>")))) > 0
    return rows.withColumn("reject", F.when(value.isNull(), "not JSON").when(lacks, "missing key"))


def source_files(spark: SparkSession, root: str, suffixes: list[str], exclude_dirs: list[str], max_kb: int, prefixes: list[str] = ()) -> DataFrame:
    """path, length of source files below root: by suffix, outside excluded directories and prefixes of the path from root, up to a
    size, in path order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    below = F.substring_index("path", f"{root.rstrip('/').split('/')[-1]}/", -1)
    good = F.exists(F.array(*map(F.lit, suffixes)), lambda s: F.endswith(F.lower("path"), s))
    return files.where(good & ~excluded(below, exclude_dirs, list(prefixes)) & (F.col("length") <= max_kb * 1024)).orderBy("path")


def excluded(path: Column, dirs: list[str], prefixes: list[str]) -> Column:
    """True if a directory of the path is in the set, or the path starts with a prefix."""
    parts = F.split(F.lower(path), "/", -1)
    inside = F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.isin(dirs)) if dirs else F.lit(False)
    out = F.coalesce(inside, F.lit(False))
    for p in prefixes:
        out = out | F.startswith(F.lower(path), F.lit(p.lower()))
    return out


def routed(path: Column, kinds: tuple[str, ...] = ("detection", "fixing")) -> Column:
    """The kind that a file's name contains; null, so that the caller can warn, if none."""
    name = F.lower(F.substring_index(path, "/", -1))
    out = F.lit(None).cast("string")
    for k in reversed(kinds):
        out = F.when(F.contains(name, F.lit(k)), F.lit(k)).otherwise(out)
    return out


def optional(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, str]:
    """(rows, note) of an artifact that may not exist yet, or only half: then no row, and "pending"."""
    try:
        lines = spark.read.text(path).where(F.btrim("value") != "")
        if lines.where(F.try_parse_json("value").isNull()).isEmpty():
            return read_jsonl(spark, path, schema), "present"
    except AnalysisException:
        pass
    return spark.createDataFrame([], StructType.fromDDL(schema)), "pending"


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 of each file below a path: what a manifest records of its inputs and outputs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_splits(df: DataFrame, path: str, split: str = "split", order: str = "id") -> None:
    """Partitioned by split and sorted by id within each file; rows of a split spread over tasks by id."""
    df.repartitionByRange(split, order).sortWithinPartitions(split, order).write.mode("overwrite").partitionBy(split).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Adds to a resumable log."""
    df.write.mode("append").parquet(path)


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key: a partial maximum before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return best.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def unseen(todo: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """What the log has no record of under all keys."""
    return todo.join(log.select(*keys).distinct(), keys, "left_anti")


def manifest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row: rows, distinct keys and an order-free digest of the content."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (key, *columns))), 256)
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_keys"), F.sum(part).cast("string").alias("digest"))


def write_vocabulary(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small aggregate as one JSON document on one line; one of over `most` rows is refused, never cut."""
    few = F.when(F.count("*") > most, F.raise_error(F.lit(f"a vocabulary of over {most} rows"))).otherwise(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))))
    df.agg(few.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
