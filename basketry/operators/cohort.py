"""Monthly retention of registration cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.exprs import diff_months, pct, require_columns, trunc_month


def cohort_retention(users: DataFrame, orders: DataFrame, *, user_col: str = "user_id",
                     registered_col: str = "registered_at", date_col: str = "order_date",
                     status_col: str = "status", active_status: str = "completed",
                     max_month: int = 5, sort: bool = True) -> DataFrame:
    """Share of each registration-month cohort buying in months 0..max_month.

    Returns cohort_month, month_number, active_users, total_users,
    retention_pct. ``active_users`` counts distinct users with at least one
    ``active_status`` order in that month; ``total_users`` is the cohort
    size including users who never bought. Cells with no active user are
    absent; orders before registration or without a date are ignored.

    Plan: the orders side is reduced to distinct (user, month) pairs, map-side
    before its one shuffle by user; the cohort sizes are a tiny aggregate
    (one row per month) that AQE broadcasts.
    """
    require_columns(users, [user_col, registered_col], "cohort_retention(users)")
    require_columns(orders, [user_col, date_col, status_col], "cohort_retention(orders)")
    cohorts = users.select(F.col(user_col).alias("_u"), trunc_month(registered_col).alias("cohort_month"))
    months = (orders.where(F.col(status_col) == F.lit(active_status))
              .select(F.col(user_col).alias("_u"), trunc_month(date_col).alias("_om")).distinct())
    active = (cohorts.join(months, "_u", "inner")
              .withColumn("month_number", diff_months("cohort_month", "_om"))
              .where(F.col("month_number").between(0, max_month))
              .groupBy("cohort_month", "month_number")
              .agg(F.count_distinct("_u").alias("active_users")))
    sizes = cohorts.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("total_users"))
    out = active.join(sizes, "cohort_month", "inner").select(
        "cohort_month", "month_number", "active_users", "total_users",
        pct("active_users", "total_users", 1).alias("retention_pct"))
    if sort:
        out = out.orderBy("cohort_month", "month_number")
    return out
