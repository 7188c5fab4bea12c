"""Daily, weekly and monthly active buyers (calendar buckets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.exprs import pct, require_columns, to_day, trunc_month, trunc_week


def active_counts(orders: DataFrame, *, user_col: str = "user_id", date_col: str = "order_date",
                  status_col: str = "status", completed: str = "completed") -> DataFrame:
    """(grain, period, users) for grains 'day', 'week', 'month' in one pass.

    Orders are scanned once and reduced to distinct (user, day) pairs, map-side
    before the shuffle. Each pair becomes three (grain, period, user) rows for
    one distinct count, so a hot day still spreads by user.
    """
    require_columns(orders, [user_col, date_col, status_col], "dau_wau_mau")
    base = (orders.where(F.col(status_col) == F.lit(completed))
            .select(F.col(user_col).alias("_u"), to_day(date_col).alias("_d")).distinct())
    grains = base.select("_u", F.inline(F.array(
        F.struct(F.lit("day").alias("grain"), F.col("_d").alias("period")),
        F.struct(F.lit("week").alias("grain"), trunc_week("_d").alias("period")),
        F.struct(F.lit("month").alias("grain"), trunc_month("_d").alias("period")),
    )))
    return grains.groupBy("grain", "period").agg(F.count_distinct("_u").alias("users"))


def dau_wau_mau(orders: DataFrame, *, user_col: str = "user_id", date_col: str = "order_date",
                status_col: str = "status", completed: str = "completed", sort: bool = True) -> DataFrame:
    """day, dau, wau, mau, dau_over_wau for every day with a completed order.

    WAU/MAU are the distinct buyers of the day's calendar week (Monday
    start) and month, repeated on each of its days. The (grain, period)
    table has one row per day, week and month of the calendar span, so it
    is small whatever the order volume; the week and month values are
    attached to the day rows with windows partitioned by week and by month
    over that table (a filter on the grain before them would be pushed
    below the aggregate and make Spark scan the orders three times).
    A NULL day matches no week or month.
    """
    counts = active_counts(orders, user_col=user_col, date_col=date_col,
                           status_col=status_col, completed=completed)
    g, p = F.col("grain"), F.col("period")
    keyed = counts.withColumns({
        "_wk": F.when(g == "day", trunc_week(p)).when(g == "week", p),
        "_mo": F.when(g == "day", trunc_month(p)).when(g == "month", p),
    })
    by_week = Window.partitionBy("_wk")
    by_month = Window.partitionBy("_mo")
    filled = keyed.select(
        "grain", F.col("period").alias("day"), F.col("users").alias("dau"),
        F.max(F.when((g == "week") & p.isNotNull(), F.col("users"))).over(by_week).alias("wau"),
        F.max(F.when((g == "month") & p.isNotNull(), F.col("users"))).over(by_month).alias("mau"))
    out = filled.where(F.col("grain") == "day").select(
        "day", "dau", "wau", "mau", pct("dau", F.nullif(F.col("wau"), F.lit(0)), 1).alias("dau_over_wau"))
    if sort:
        out = out.orderBy(F.col("day").asc_nulls_last())
    return out
