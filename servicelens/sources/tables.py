"""Driver tables: one parquet file per table under ``sf_dir``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan of the files that are there now; selecting ``columns`` right away keeps the
    ReadSchema narrow."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def read_spread(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """``read_table``, dealt out over the cores where the scan has fewer splits than that.

    Small tables stored as one parquet row group scan as one task; CPU-heavy text work on them
    would then use one core.  The splits are those of the bare scan (no job is run to
    count them), so on large inputs nothing is shuffled; the rows are the same either way."""
    df = read_table(spark, sf_dir, name, columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
