"""Reads the Parquet tables of a folder."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table; Python workers of this machine are told where the package is."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Narrow rows that a task takes, at most about so many.
TASK_ROWS = 100_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of a table dealt by keys over all cores: a million narrow rows are a file of few MB, which one task would read, however
    much work each row is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(4 * cores, -(-df.count() // TASK_ROWS)), *keys)
