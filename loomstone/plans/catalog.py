"""All queries of the library by name, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstone.plans.roles import duck, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of a session whose views are ready."""

    def register(f: Callable[[SparkSession], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            views(spark, sf_dir)
            return f(spark)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = duck(oracle)
        return f

    return register


def plan(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    """Registers a query in SQL; where both dialects read it alike, one text serves."""
    query(name, duck_sql or spark_sql)(lambda spark: spark.sql(spark_sql))


from loomstone.plans import aggregates, curation, evaluation, relational, texts  # noqa: E402, F401
