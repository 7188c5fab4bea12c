"""Customer spend ranking: global and per-country ranks, percentile,
running revenue, neighbours and quartiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.exprs import money_avg, money_sum, require_columns, round_n
from basketry.operators.windows import Ordering, ntile, percent_rank, tile_columns, with_windows
from basketry.session import stored


def customer_spend(users: DataFrame, orders: DataFrame, *, user_col: str = "user_id",
                   country_col: str = "country", plan_col: str = "plan", order_id_col: str = "order_id",
                   amount_col: str = "amount", status_col: str = "status",
                   completed: str = "completed") -> DataFrame:
    """user, country, plan, total_orders, total_spent, avg_order_value for buyers.

    Equivalent to users LEFT JOIN completed orders, grouped by user,
    country and plan, keeping total_orders > 0: orders are pre-aggregated
    per user first (map-side partial aggregate, so a user with a third of
    all orders costs one row per task), then inner-joined. The regroup
    after the join keeps the result right when ``users`` repeats an id,
    and needs no new shuffle (the join output is already hashed by user).
    """
    require_columns(users, [user_col, country_col, plan_col], "customer_ranking(users)")
    require_columns(orders, [user_col, order_id_col, amount_col, status_col], "customer_ranking(orders)")
    per_user = (orders.where(F.col(status_col) == F.lit(completed))
                .groupBy(F.col(user_col).alias(user_col))
                .agg(F.count(order_id_col).alias("_n"), money_sum(amount_col).alias("_s"),
                     F.count(amount_col).alias("_na")))
    joined = users.select(user_col, country_col, plan_col).join(per_user, user_col, "inner")
    stats = (joined.groupBy(user_col, country_col, plan_col)
             .agg(F.sum("_n").alias("total_orders"), F.sum("_s").alias("_s"), F.sum("_na").alias("_na"))
             .where(F.col("total_orders") > 0))
    return stats.select(
        user_col, country_col, plan_col, F.col("total_orders").cast("long").alias("total_orders"),
        round_n(F.col("_s").cast("double"), 2).alias("total_spent"),
        round_n(money_avg("_s", "_na"), 2).alias("avg_order_value"))


#: what ``rank_customers`` can add, and the windows that each needs: over all buyers (g), in a country (c)
RANKS = {"global_rank": "g", "country_rank": "c", "percentile": "g", "running_revenue": "g", "prev_user_spent": "c",
         "next_user_spent": "c", "quartile": "g"}


def rank_customers(spend: DataFrame, *, user_col: str = "user_id", country_col: str = "country",
                   n_tiles: int = 4, ranges: int | None = None, columns: Sequence[str] = tuple(RANKS)) -> DataFrame:
    """Add global_rank, country_rank, percentile, running_revenue,
    prev_user_spent, next_user_spent and quartile to a per-buyer table, or
    those of ``columns``; windows that none of them needs are not computed.

    All windows order by total_spent DESC, so one sort into ranges serves
    them: no single-task sort, even when one country holds most buyers.
    Ties: RANK/percentile use peers; running sum, LAG/LEAD and NTILE break
    them by user id. The quartile alone takes the tile borders only.
    """
    if unknown := set(columns) - set(RANKS):
        raise ValueError(f"rank_customers: unknown column(s) {sorted(unknown)}; have {list(RANKS)}")
    order = (("total_spent", True),)
    if list(columns) == ["quartile"]:
        spend = stored(spend, "spend-rows")
        tiles = tile_columns(spend, {"quartile": (Ordering(order, (user_col,)), n_tiles)}, ranges=ranges)
        return spend.select("*", *[c.alias(name) for name, c in tiles.items()])
    specs = {}
    if any(RANKS[c] == "g" for c in columns):
        running = "running_revenue" in columns
        specs["_g_"] = (Ordering(order, (user_col,)),
                        dict(value="total_spent" if running else None, running=running, reverse_rank="percentile" in columns))
    if any(RANKS[c] == "c" for c in columns):
        neighbours = "prev_user_spent" in columns or "next_user_spent" in columns
        specs["_c_"] = (Ordering(order, (user_col,), (country_col,)),
                        dict(value="total_spent" if neighbours else None, neighbours=neighbours))
    w = with_windows(spend, specs, ranges=ranges)
    made = {
        "global_rank": lambda: F.col("_g_rank"),
        "country_rank": lambda: F.col("_c_rank"),
        "percentile": lambda: round_n(percent_rank("_g_rank_rev", "_g_n") * F.lit(100.0), 1),
        "running_revenue": lambda: round_n(F.col("_g_running").cast("double"), 2),
        "prev_user_spent": lambda: F.col("_c_lag"),
        "next_user_spent": lambda: F.col("_c_lead"),
        "quartile": lambda: ntile("_g_pos", "_g_n", n_tiles),
    }
    return w.select(*spend.columns, *[made[c]().alias(c) for c in RANKS if c in columns])


def top_ranked(spend: DataFrame, limit: int, *, user_col: str = "user_id") -> DataFrame:
    """The ``limit`` best buyers with global_rank, best first, ties at the cut broken by user id.

    Who comes before one of them is one of them: a top-k first, then the ranks of ``limit`` rows.
    """
    order = [F.col("total_spent").desc_nulls_last(), F.col(user_col).asc_nulls_last()]
    top = spend.orderBy(*order).limit(limit)
    ranked = top.withColumn("global_rank", F.rank().over(Window.orderBy(order[0])).cast("long"))
    return ranked.orderBy("global_rank", order[1])


def top_of_country(spend: DataFrame, k: int = 3, *, country_col: str = "country") -> DataFrame:
    """Buyers whose country_rank is at most ``k`` (ties kept), with it.

    Every task drops what is beyond rank ``k`` of its own rows before the
    shuffle, so a dominant country does not gather in one task.
    """
    rank = F.rank().over(Window.partitionBy(country_col).orderBy(F.col("total_spent").desc_nulls_last()))
    return spend.withColumn("country_rank", rank).where(F.col("country_rank") <= k).withColumn(
        "country_rank", F.col("country_rank").cast("long"))


def customer_ranking(users: DataFrame, orders: DataFrame, *, user_col: str = "user_id",
                     country_col: str = "country", plan_col: str = "plan", order_id_col: str = "order_id",
                     amount_col: str = "amount", status_col: str = "status", completed: str = "completed",
                     n_tiles: int = 4, limit: int | None = 100, ranges: int | None = None) -> DataFrame:
    """The ranked buyers, best first; ``limit`` keeps the top rows (the
    windows always cover every buyer). The limit is a top-k
    (TakeOrderedAndProject), ties at the cut broken by user id."""
    spend = customer_spend(users, orders, user_col=user_col, country_col=country_col, plan_col=plan_col,
                           order_id_col=order_id_col, amount_col=amount_col, status_col=status_col,
                           completed=completed)
    ranked = rank_customers(spend, user_col=user_col, country_col=country_col, n_tiles=n_tiles, ranges=ranges)
    ranked = ranked.orderBy(F.col("global_rank").asc_nulls_last(), F.col(user_col).asc_nulls_last())
    return ranked.limit(limit) if limit is not None else ranked
