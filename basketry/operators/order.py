"""Proof that a stored result is in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.session import shared_path

Order = Sequence[tuple[str, bool]]


def order_columns(order: Order) -> list[Column]:
    """Sort columns from ``(column, descending)``; NULLs last in both directions."""
    return [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in order]


def comes_after(a: Column, b: Column, order: Order) -> Column:
    """Whether struct ``a`` must stand behind struct ``b``: false for peers."""
    out = F.lit(False)
    for c, descending in reversed(list(order)):
        x, y = a[c], b[c]
        behind = F.when(y.isNull(), F.lit(False)).when(x.isNull(), F.lit(True)).otherwise(x < y if descending else x > y)
        out = behind | (x.eqNullSafe(y) & out)
    return out


def order_breaks(spark: SparkSession, path: str, order: Order) -> DataFrame:
    """``rows, files, breaks`` of a Parquet result: how often a row stands in front of one that belongs before it.

    Rows are taken in the order of the part files and of the rows in them.
    Inside a file each row is compared with the one in front; of the files
    only the first and the last row meet, one row for each file. An empty
    result has no breaks.
    """
    names = [c for c, _ in order]
    rows = spark.read.parquet(path).select(
        F.struct(*names).alias("key"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    in_file = Window.partitionBy("file").orderBy("at")
    rows = rows.withColumn("before", F.lag("key").over(in_file))
    files = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("before").isNotNull() & comes_after(F.col("before"), F.col("key"), order)).alias("inside"),
        F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"))
    number = [F.regexp_extract("file", p, 1).cast("long") for p in (r"part-(\d+)", r"c(\d+)\.")]
    one_behind_the_other = Window.orderBy(*number)
    files = files.withColumn("before", F.lag("last").over(one_behind_the_other))
    border = F.col("before").isNotNull() & comes_after(F.col("before"), F.col("first"), order)
    return files.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum(F.col("inside") + border.cast("long")), F.lit(0)).cast("long").alias("breaks"))


def stored_order(df: DataFrame, order: Order) -> DataFrame:
    """Writes ``df``, as it is, to the shared folder and gives its ``order_breaks``."""
    path = shared_path(df.sparkSession, "sorted")
    df.write.parquet(path)
    return order_breaks(df.sparkSession, path, order)
