"""Sessions: one place for the settings that operators rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(master: str = "local[8]", app: str = "loomstone", **conf: str) -> SparkSession:
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return shipped(builder.getOrCreate())


def shipped(spark: SparkSession) -> SparkSession:
    """Lets Python workers on machines that share this folder import the library; elsewhere it goes along by --py-files."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "") or os.environ.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, path]))
    return spark
