"""Shared helpers: written intermediate tables, checked broadcasts, chunks of documents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of one chunk: what a grouped task holds at a time.
CHUNK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free(name: str, docs: DataFrame) -> str:
    """The name, with underscores before it while a column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def boxed(docs: DataFrame, key: str, text: str, carry: bool) -> DataFrame:
    """key, text and, with carry, all other columns as one struct "row": their names can't clash with an operator's own."""
    columns = [F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")]
    if carry:
        columns.append(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in (key, text)), F.lit(True).alias(free("_", docs))).alias("row"))
    return docs.select(*columns)


def unboxed(out: DataFrame, docs: DataFrame, key: str, text: str) -> list[Column]:
    """The columns of docs from a boxed result."""
    return [F.col({key: "key", text: "text"}.get(c, f"row.`{c}`")).alias(c) for c in docs.columns]


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A local one is made only where the setting is absent and all runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = getattr(spark.sparkContext, "_loomstone_folder", None) or tempfile.mkdtemp(prefix="loomstone-")
        spark.sparkContext._loomstone_folder = folder
        folder = f"file://{folder}" if folder.startswith("/") else folder
    return folder.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes the table to the shared folder and returns a reader of it: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomstone/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomstone_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what written() wrote; nothing may read it any more."""
    for df in tables:
        path = getattr(df, "_loomstone_path", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def chunks_for(df: DataFrame, column: str = "text", chunk_bytes: int = CHUNK_BYTES) -> int:
    """How many chunks of about chunk_bytes the column makes: follows the data, never a constant."""
    return max(1, -(-text_bytes(df, column) // chunk_bytes))


def with_chunk(df: DataFrame, n: int, *by: str) -> DataFrame:
    """Rows dealt by a hash of the columns `by`: rows that agree in all of them share a chunk, others are spread evenly."""
    return df.withColumn("chunk", F.pmod(F.xxhash64(*by), F.lit(n)).cast("int"))
