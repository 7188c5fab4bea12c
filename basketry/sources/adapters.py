"""Map the star-schema tables onto the shop model the operators expect.

The operators work on three logical tables:

* users  (user_id, country, plan, registered_at)
* orders (order_id, user_id, order_date, amount, category, status)
* events (event_id, user_id, event_type, event_date)

These adapters derive them from ``customer``/``nation``/``orders``/``events``
with plain projections and one aggregate, so filters on plain columns still
reach the Parquet scan. Orders keep the raw status code beside the mapped
status: a filter on the code is pushed down, one on the mapped CASE is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.exprs import to_day

# Order status codes of the star schema and the shop status
# each one stands for.
STATUS_BY_CODE = {"F": "completed", "P": "returned", "O": "cancelled"}

#: operator keyword arguments that filter on the raw status code
STATUS_FILTER = {"status_col": "status_code", "completed": "F"}

# The event types of the events table in funnel order
# ('error' is deliberately not a step).
EVENT_STEPS = ("view", "click", "signup", "purchase")


def _status(code_col: str) -> F.Column:
    c = F.col(code_col)
    out = None
    for code, name in STATUS_BY_CODE.items():
        out = F.when(c == code, F.lit(name)) if out is None else out.when(c == code, F.lit(name))
    return out


ORDER_COLUMNS = ("order_id", "user_id", "order_date", "amount", "category", "status")


def shop_orders(orders: DataFrame) -> DataFrame:
    """orders -> (order_id, user_id, order_date DATE, amount, category, status,
    status_code).

    ``status_code`` is the raw one-letter code. Filtering on it (operators
    take the status column and values as parameters, see ``STATUS_FILTER``)
    reaches the Parquet scan as ``EqualTo(o_orderstatus, F)``; a filter on
    the mapped ``status`` would stay a CASE above the scan, which Catalyst
    does not fold back.
    """
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        to_day("o_orderdate").alias("order_date"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("category"),
        _status("o_orderstatus").alias("status"),
        F.col("o_orderstatus").alias("status_code"),
    )


def shop_users(customer: DataFrame, nation: DataFrame, orders: DataFrame) -> DataFrame:
    """customer + nation + first order -> (user_id, country, plan, registered_at).

    ``registered_at`` is the customer's first order date over all statuses
    (the star schema has no sign-up date). One partial aggregate of
    ``orders`` by customer; customers without orders keep a NULL date.
    """
    first = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.min(to_day("o_orderdate")).alias("registered_at"))
    base = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"], "inner").select(
        F.col("c_custkey").alias("user_id"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("plan"),
    )
    return base.join(first, "user_id", "left")


def shop_events(events: DataFrame) -> DataFrame:
    """events -> (event_id, user_id, event_type, event_date)."""
    return events.select(
        "event_id", "user_id", "event_type", F.col("ts").alias("event_date"))
