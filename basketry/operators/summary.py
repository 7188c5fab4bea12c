"""One-row KPI summary of the orders table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.exprs import exact, money_avg, pct, require_columns, round_n


def executive_summary(orders: DataFrame, *, user_col: str = "user_id", order_id_col: str = "order_id",
                      amount_col: str = "amount", status_col: str = "status", completed: str = "completed",
                      returned: str = "returned", cancelled: str = "cancelled") -> DataFrame:
    """total_users, completed_orders, total_revenue, avg_order_value,
    return_rate_pct, cancel_rate_pct over all orders, as one row.

    A single global aggregate (partial per task, then final); the two
    distinct counts are planned by Catalyst with one Expand. Rates divide
    by all orders; an empty table gives counts 0 and NULL ratios.
    """
    require_columns(orders, [user_col, order_id_col, amount_col, status_col], "executive_summary")
    st = F.col(status_col)
    done = st == F.lit(completed)
    agg = orders.agg(
        F.count_distinct(user_col).alias("total_users"),
        F.count_distinct(F.when(done, F.col(order_id_col))).alias("completed_orders"),
        F.sum(F.when(done, exact(amount_col))).alias("_rev"),
        F.count(F.when(done, F.col(amount_col))).alias("_nrev"),
        F.count(F.when(st == F.lit(returned), F.lit(1))).alias("_ret"),
        F.count(F.when(st == F.lit(cancelled), F.lit(1))).alias("_can"),
        F.count(F.lit(1)).alias("_all"))
    return agg.select(
        "total_users", "completed_orders",
        round_n(F.col("_rev").cast("double"), 2).alias("total_revenue"),
        round_n(money_avg("_rev", "_nrev"), 2).alias("avg_order_value"),
        pct("_ret", "_all", 1).alias("return_rate_pct"),
        pct("_can", "_all", 1).alias("cancel_rate_pct"))


def summary_dict(summary: DataFrame) -> dict:
    """The one KPI row as a dict (an action; the row is a fixed-size result)."""
    row = summary.first()
    return row.asDict() if row is not None else {}
