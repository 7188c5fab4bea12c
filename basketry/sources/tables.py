"""Reading the input tables and writing results.

Every reader returns a lazy DataFrame; Catalyst prunes columns and pushes
filters into the Parquet scan, so callers select only what they use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a scale-factor folder."""
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
    """Expose DataFrames to ``spark.sql`` under the given names (session-scoped)."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    """Write a result as Parquet, optionally partitioned by low-cardinality columns."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_buckets(df: DataFrame, name: str, by: str | list[str], buckets: int, path: str | None = None,
                  mode: str = "overwrite") -> None:
    """Write a result as a table of the session's catalog, in buckets by the hash of ``by``, sorted by it inside.

    Tables with the same number of buckets by the same key join on it, and
    aggregate by it, without an exchange. The rows are dealt to the buckets
    before the write, so each bucket is one file. ``path``: the folder, for
    a table outside the warehouse.
    """
    keys = [by] if isinstance(by, str) else list(by)
    writer = df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
