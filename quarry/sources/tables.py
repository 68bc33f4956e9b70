"""Parquet table access for the driver-provided data sets.

Each reader names the columns it needs so the parquet scan's ReadSchema is
pruned even before Catalyst's own column pruning kicks in.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return os.path.join(sf_dir, f"{name}.parquet")


# Tables whose rows carry long texts: per-row work (splitting, regex,
# hashing) dominates, so they are spread over all cores when the scan alone
# yields fewer splits than the cluster's parallelism.
TEXT_TABLES = ("documents", "pages", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition to the default parallelism, only when the
    input has fewer partitions than cores (a few large row groups). A large
    input already has many splits and is left alone."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose the tables to ``spark.sql`` under their own names."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
