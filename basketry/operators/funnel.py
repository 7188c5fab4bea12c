"""Step-by-step conversion funnel (unordered: distinct users per step)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.exprs import pct, require_columns, step_index

# The default funnel steps, in order.
DEFAULT_STEPS = ("page_view", "add_to_cart", "checkout_start", "payment_info", "purchase")


def step_counts(events: DataFrame, *, steps: Sequence[str] = DEFAULT_STEPS,
                user_col: str = "user_id", type_col: str = "event_type",
                segment_cols: Sequence[str] = ()) -> DataFrame:
    """Distinct users per (segment..., event type) and the type's step number.

    Types that are not steps keep a NULL step_order and are still returned.
    The distinct count is planned as a partial aggregate on
    (segment, type, user), so a hot segment or type spreads by user.
    """
    require_columns(events, [user_col, type_col, *segment_cols], "conversion_funnel")
    counts = events.groupBy(*segment_cols, type_col).agg(F.count_distinct(user_col).alias("users"))
    return counts.withColumn("step_order", step_index(type_col, steps))


def conversion_funnel(events: DataFrame, *, steps: Sequence[str] = DEFAULT_STEPS,
                      user_col: str = "user_id", type_col: str = "event_type",
                      segment_cols: Sequence[str] = (), sort: bool = True) -> DataFrame:
    """segment..., step_order, event_type, users, prev_users, pct_of_top, pct_prev_step.

    Ordered by step (unknown types last, then by type name). ``prev_users``
    is the previous row's users (LAG), ``pct_of_top`` compares with the
    first row of the segment (FIRST_VALUE), ``pct_prev_step`` with the
    previous row; a zero or missing denominator gives NULL. The events are
    read once; the windows run on the aggregated table, whose rows per
    segment are its distinct event types.
    """
    counts = step_counts(events, steps=steps, user_col=user_col, type_col=type_col, segment_cols=segment_cols)
    in_order = Window.partitionBy(*segment_cols).orderBy(F.col("step_order").asc_nulls_last(),
                                                         F.col(type_col).asc_nulls_last())
    prev = F.lag("users").over(in_order)
    top = F.first("users").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    out = counts.select(
        *segment_cols, "step_order", type_col, "users", prev.alias("prev_users"),
        pct("users", top, 1).alias("pct_of_top"),
        pct("users", F.nullif(prev, F.lit(0)), 1).alias("pct_prev_step"))
    if sort:
        out = out.orderBy(*[F.col(c).asc_nulls_last() for c in segment_cols],
                          F.col("step_order").asc_nulls_last(), F.col(type_col).asc_nulls_last())
    return out
