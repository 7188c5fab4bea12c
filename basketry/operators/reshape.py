"""Report shapes built on the analyses: pivots, value counts, quartile
profile, top-k per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.exprs import money_avg, money_sum, month_label, round_n


def pivot_cohort(cohorts: DataFrame, *, max_month: int = 5, value_col: str = "retention_pct") -> DataFrame:
    """cohort_month x month_number -> value, columns month_0..month_N (missing = NULL).

    The month numbers are given, so the pivot needs no extra job to find them.
    """
    months = list(range(max_month + 1))
    wide = cohorts.groupBy("cohort_month").pivot("month_number", months).agg(F.max(value_col))
    return wide.select("cohort_month", *[F.col(str(m)).alias(f"month_{m}") for m in months])


def pivot_revenue(revenue: DataFrame, categories: Sequence[str] | None = None, *, category_col: str = "category",
                  fill: float = 0.0, max_categories: int = 1000) -> DataFrame:
    """'YYYY-MM' month label x category -> revenue, missing cells = ``fill``.

    Without ``categories`` the columns are those in the data, in order, the
    NULL category last as ``null``; more than ``max_categories`` raise. A
    category in the data that a given list lacks raises too (``None`` in the
    list stands for NULL), when the result is computed: no revenue is left
    out silently.
    """
    if categories is None:
        found = revenue.select(category_col).distinct().limit(max_categories + 1).collect()
        if len(found) > max_categories:
            raise ValueError(f"pivot_revenue: more than {max_categories} categories; name them")
        categories = sorted((r[0] for r in found), key=lambda c: (c is None, c))
    names = ["null" if c is None else c for c in categories]
    if len(set(names)) < len(names):
        raise ValueError(f"pivot_revenue: categories {categories} do not give different column names")
    c = F.col(category_col)
    known = F.lit(False)
    for name in categories:
        known = known | c.eqNullSafe(F.lit(name))
    checked = F.when(known, F.col("revenue")).otherwise(
        F.raise_error(F.concat(F.lit("pivot_revenue: unlisted category "), F.coalesce(c.cast("string"), F.lit("NULL")))).cast("double"))
    cells = [F.coalesce(F.sum(F.when(c.eqNullSafe(F.lit(v)), F.col("_revenue"))), F.lit(fill)).alias(n)
             for v, n in zip(categories, names)]
    return (revenue.withColumn("_revenue", checked).groupBy(month_label("month").alias("month")).agg(*cells))


def pivot_revenue_map(revenue: DataFrame, *, category_col: str = "category") -> DataFrame:
    """'YYYY-MM' month label with a map category -> revenue, for any number of categories, not known beforehand.

    Categories without revenue in a month are not in its map; NULL revenue
    counts as 0, and the NULL category is ``null``, which no other may be
    called. A category's rows are added up before its month's map is made.
    """
    key = F.coalesce(F.col(category_col).cast("string"), F.lit("null"))
    cells = revenue.groupBy(month_label("month").alias("month"), key.alias("_key")).agg(
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("_revenue"), F.count_distinct(F.col(category_col).isNull()).alias("_kinds"))
    clash = F.raise_error(F.lit("pivot_revenue_map: a category is called null")).cast("double")
    cells = cells.withColumn("_revenue", F.when(F.col("_kinds") > 1, clash).otherwise(F.col("_revenue")))
    return cells.groupBy("month").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("_key", "_revenue")))).alias("revenue"))


def value_counts(df: DataFrame, col: str, *, sort: bool = True) -> DataFrame:
    """Rows per value of ``col`` (``count``), most frequent first."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if sort:
        out = out.orderBy(F.col("count").desc(), F.col(col).asc_nulls_last())
    return out


def quartile_profile(ranked: DataFrame, *, tile_col: str = "quartile", value_col: str = "total_spent") -> DataFrame:
    """min, mean, max, count of ``value_col`` per tile, 2 decimals."""
    agg = ranked.groupBy(tile_col).agg(
        F.min(value_col).alias("min"), money_sum(value_col).alias("_s"), F.count(value_col).alias("_n"),
        F.max(value_col).alias("max"), F.count(F.lit(1)).alias("count"))
    return agg.select(
        tile_col, round_n("min", 2).alias("min"), round_n(money_avg("_s", "_n"), 2).alias("mean"),
        round_n("max", 2).alias("max"), "count").orderBy(tile_col)


def top_k_per_group(ranked: DataFrame, *, rank_col: str = "country_rank", k: int = 3) -> DataFrame:
    """Rows whose within-group rank is at most ``k`` (ties kept)."""
    return ranked.where(F.col(rank_col) <= k)
