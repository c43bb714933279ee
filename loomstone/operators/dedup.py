"""Exact duplicates with conflicts, and near-duplicate groups over shared line windows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder. A local one serves only where all runs in one process (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        top = f"file://{tempfile.gettempdir()}/loomstone"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomstone_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what saved() wrote; nothing may read it any more."""
    jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._loomstone_path)
    jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def conflicts(rows: DataFrame, key: str, label: str) -> DataFrame:
    """For each key: n copies, whether their labels differ, and the rows that go: all on a conflict, else all but one.

    Minimum and maximum of the label are summed up before the shuffle, so a hot text costs one row a task.
    """
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), (F.min(label) != F.max(label)).alias("conflict"))
    return sums.withColumn("dropped", F.when(F.col("conflict"), F.col("n")).otherwise(F.col("n") - 1))


def first_of(rows: DataFrame, key: str, label: str, order: list[str]) -> DataFrame:
    """The first row of each key without a label conflict; keys in conflict give none."""
    best = rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"), F.min(label).alias("_a"), F.max(label).alias("_b"))
    return best.where(F.col("_a") == F.col("_b")).select("_row.*")


def shared_groups(rows: DataFrame, key: str, values: str, dense: bool = True) -> DataFrame:
    """key, group: rows that share any value, directly or through others, are one group; groups are numbered by smallest key.

    Each value links its rows to its smallest one, so a value that many rows share costs as many links as rows, never pairs.
    """
    from loomstone.operators.components import components

    pairs = saved(rows.select(F.col(key).alias("id"), F.explode(values).alias("v")))
    low = pairs.groupBy("v").agg(F.min("id").alias("hub")).withColumnRenamed("v", "w")
    labels = components(pairs.join(low, F.col("v") == F.col("w")).where("id > hub").select("id", "hub"), "id", "hub")
    out = rows.select(F.col(key).alias("id")).join(labels, F.col("id") == F.col("node"), "left").select(F.col("id").alias(key), F.coalesce("root", "id").alias("group"))
    dropped(pairs)
    if not dense:
        return out
    return numbered(out, "group")


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """Values replaced by their rank from 0 among distinct values, without a task that sees them all: ranges, then sums of ranges."""
    distinct = saved(rows.select(F.col(column).alias("_v")).distinct().repartitionByRange("_v").withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["count"] for r in distinct.groupBy("_p").count().collect()}  # one row a partition
    base, table = 0, []
    for p in sorted(sizes):
        table.append((p, base))
        base += sizes[p]
    bases = F.broadcast(rows.sparkSession.createDataFrame(table or [(0, 0)], "_p int, _base bigint"))
    from pyspark.sql.window import Window

    ranks = distinct.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_v"))).join(bases, "_p").select("_v", (F.col("_base") + F.col("_r") - 1).alias("_rank"))
    return rows.join(ranks, rows[column] == ranks["_v"]).select(*(F.col("_rank").alias(column) if c == column else F.col(c) for c in rows.columns))
