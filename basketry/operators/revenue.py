"""Monthly revenue by category with share of month and growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.exprs import exact, money_sum, pct, require_columns, round_n, trunc_month


def monthly_category(orders: DataFrame, *, date_col: str = "order_date", category_col: str = "category",
                     amount_col: str = "amount", status_col: str = "status",
                     completed: str = "completed") -> DataFrame:
    """month, category, _rev (exact decimal), orders_count over completed orders."""
    require_columns(orders, [date_col, category_col, amount_col, status_col], "revenue_breakdown")
    return (orders.where(F.col(status_col) == F.lit(completed))
            .groupBy(trunc_month(date_col).alias("month"), F.col(category_col).alias(category_col))
            .agg(money_sum(amount_col).alias("_rev"), F.count(F.lit(1)).alias("orders_count")))


def revenue_breakdown(orders: DataFrame, *, date_col: str = "order_date", category_col: str = "category",
                      amount_col: str = "amount", status_col: str = "status",
                      completed: str = "completed", sort: bool = True) -> DataFrame:
    """month, category, revenue, orders_count, pct_of_month, mom_growth_pct.

    ``pct_of_month`` divides the rounded revenue by the month's sum of
    rounded revenues (a SUM window per month over the aggregated table, whose
    partitions hold one row per category sold that month, i.e. the month's
    own result rows);
    ``mom_growth_pct`` compares with the category's previous month present
    in the data (a gap month is skipped). That LAG runs per category over
    at most one row per calendar month. The orders are scanned once.
    """
    mc = monthly_category(orders, date_col=date_col, category_col=category_col, amount_col=amount_col,
                          status_col=status_col, completed=completed)
    revenue = round_n(F.col("_rev").cast("double"), 2)
    by_month = Window.partitionBy("month")
    w = Window.partitionBy(category_col).orderBy(F.col("month").asc_nulls_last())
    step = mc.select(
        "month", category_col, revenue.alias("revenue"), "orders_count",
        pct(revenue, F.sum(exact(revenue)).over(by_month).cast("double"), 1).alias("pct_of_month"))
    step = step.withColumn("_prev", F.lag("revenue").over(w))
    out = step.select(
        "month", category_col, "revenue", "orders_count", "pct_of_month",
        pct(F.col("revenue") - F.col("_prev"), F.nullif(F.col("_prev"), F.lit(0.0)), 1).alias("mom_growth_pct"))
    if sort:
        out = out.orderBy(F.col("month").asc_nulls_last(), F.col("revenue").desc_nulls_last(),
                          F.col(category_col).asc_nulls_last())
    return out
