"""Named queries over a scale-factor folder of star-schema tables.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame built
from the whole tables through the adapters in ``basketry.sources``.
``basketry.plans.oracle`` holds an equivalent SQL text for each key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.exprs import (
    date_lit, diff_days, diff_months, money_avg, money_sum, month_label, nullif_div, or_default, pct, round_n,
    step_index, to_day, trunc_month, trunc_week,
)
from basketry.operators import activity, cohort, funnel, order, ranking, reshape, revenue, rfm, summary, whatif
from basketry.operators.whatif import Scenario
from basketry.session import stored
from basketry.sources.adapters import (
    EVENT_STEPS, ORDER_COLUMNS, STATUS_FILTER, shop_events, shop_orders, shop_users,
)
from basketry.sources.tables import read_table

# Fixed values for the star-schema data: the "as of" date for recency
# (the last order date), the order priorities used as categories, and the
# what-if scenarios over the four event steps (2 click, 3 signup, 4 purchase).
AS_OF = "2001-08-01"
FROM_DAY = "1998-07-01"
CATEGORIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SCENARIOS = (
    Scenario("as observed", {}),
    Scenario("more signups", {3: 1.05}),
    Scenario("more signups and purchases", {3: 1.05, 4: 1.1}),
    Scenario("all steps up", {2: 1.2, 3: 1.15, 4: 1.25}),
)


class Shop:
    """The three shop tables of one folder, as lazy DataFrames (each
    source table is opened only when a query uses it)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def _raw_orders(self) -> DataFrame:
        return read_table(self.spark, self.sf_dir, "orders")

    @cached_property
    def orders(self) -> DataFrame:
        return shop_orders(self._raw_orders)

    @cached_property
    def users(self) -> DataFrame:
        return shop_users(read_table(self.spark, self.sf_dir, "customer"),
                          read_table(self.spark, self.sf_dir, "nation"), self._raw_orders)

    @cached_property
    def registered(self) -> DataFrame:
        """(user_id, registered_at), stored: a join with orders then has two
        plain shuffles under it, and AQE can split a hot user's orders."""
        return stored(self.users.select("user_id", "registered_at"), "registered")

    @cached_property
    def events(self) -> DataFrame:
        return shop_events(read_table(self.spark, self.sf_dir, "events"))

    def completed(self) -> DataFrame:
        return self.orders.where(F.col("status_code") == "F")


Query = Callable[[SparkSession, str], DataFrame]
#: key -> builder over any object with ``orders``/``users``/``events``
BUILDERS: dict[str, Callable[[Shop], DataFrame]] = {}
#: key -> (spark, sf_dir) -> DataFrame over the folder's tables
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Callable[[Shop], DataFrame]) -> Callable:
        BUILDERS[name] = fn
        QUERIES[name] = lambda spark, sf_dir: fn(Shop(spark, sf_dir))
        return fn
    return register


# ------------------------------------------------------------ analyses A1-A9


@query("cohort_retention")
def _a1(s: Shop) -> DataFrame:
    return cohort.cohort_retention(s.users, s.orders, status_col="status_code", active_status="F")


@query("rfm_segmentation")
def _a2(s: Shop) -> DataFrame:
    return rfm.rfm_segmentation(s.orders, as_of=AS_OF, **STATUS_FILTER)


@query("conversion_funnel")
def _a3(s: Shop) -> DataFrame:
    return funnel.conversion_funnel(s.events, steps=EVENT_STEPS)


def _events_by_country(s: Shop) -> DataFrame:
    """Distinct (user, type) pairs with the user's country. The pairs are
    made map-side, so a user with a third of all events is a handful of
    rows on the join."""
    pairs = s.events.select("user_id", "event_type").distinct()
    return pairs.join(s.users.select("user_id", "country"), "user_id", "inner")


@query("conversion_funnel_by_country")
def _a3s(s: Shop) -> DataFrame:
    return funnel.conversion_funnel(_events_by_country(s), steps=EVENT_STEPS, segment_cols=("country",))


def _events_by_day(s: Shop) -> DataFrame:
    return s.events.select("user_id", "event_type", to_day("event_date").alias("day"))


@query("conversion_funnel_by_day")
def _a3d(s: Shop) -> DataFrame:
    return funnel.conversion_funnel(_events_by_day(s), steps=EVENT_STEPS, segment_cols=("day",))


@query("dau_wau_mau")
def _a4(s: Shop) -> DataFrame:
    return activity.dau_wau_mau(s.orders, **STATUS_FILTER)


@query("revenue_breakdown")
def _a5(s: Shop) -> DataFrame:
    return revenue.revenue_breakdown(s.orders, **STATUS_FILTER)


@query("customer_ranking")
def _a6(s: Shop) -> DataFrame:
    return ranking.customer_ranking(s.users, s.orders, **STATUS_FILTER)


@query("executive_summary")
def _a7(s: Shop) -> DataFrame:
    return summary.executive_summary(s.orders, **STATUS_FILTER, returned="P", cancelled="O")


def _order_value(s: Shop) -> DataFrame:
    return (s.completed().agg(money_sum("amount").alias("_s"), F.count("amount").alias("_n"))
            .select(round_n(money_avg("_s", "_n"), 2).alias("aov")))


def _baseline(s: Shop) -> DataFrame:
    """One row per event day: its visitors and step rates, and the order value of all completed orders."""
    counts = funnel.step_counts(_events_by_day(s), steps=EVENT_STEPS, segment_cols=("day",))
    return whatif.funnel_baseline(counts, len(EVENT_STEPS), segment_cols=("day",), aov=_order_value(s))


@query("funnel_what_if")
def _a8(s: Shop) -> DataFrame:
    return whatif.simulate_stages(_baseline(s), SCENARIOS, steps=EVENT_STEPS, segment_cols=("day",))


@query("scenario_comparison")
def _a9(s: Shop) -> DataFrame:
    return whatif.simulate_kpis(_baseline(s), SCENARIOS, n_steps=len(EVENT_STEPS), segment_cols=("day",))


@query("scenario_totals")
def _a9t(s: Shop) -> DataFrame:
    counts = funnel.step_counts(s.events, steps=EVENT_STEPS)
    base = whatif.funnel_baseline(counts, len(EVENT_STEPS), aov=_order_value(s))
    return whatif.simulate_kpis(base, SCENARIOS, n_steps=len(EVENT_STEPS))


# ---------------------------------------------------------- scans, projections


@query("scan_orders")
def _s1(s: Shop) -> DataFrame:
    return s.orders.select(*ORDER_COLUMNS)


@query("project_alias")
def _p1(s: Shop) -> DataFrame:
    return s.users.select("user_id", "country", "plan", trunc_month("registered_at").alias("cohort_month"))


@query("rename_columns")
def _p10(s: Shop) -> DataFrame:
    return reshape.value_counts(s.orders, "category", sort=False).withColumnsRenamed(
        {"category": "priority", "count": "orders"})


@query("missing_or_zero")
def _p12(s: Shop) -> DataFrame:
    """Completed orders per user; users without any count as one."""
    per_user = s.completed().groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    return (s.users.select("user_id", "country").join(per_user, "user_id", "left")
            .select("user_id", or_default(n, F.lit(1)).cast("long").alias("orders_or_one")))


@query("kpi_rows")
def _s3(s: Shop) -> DataFrame:
    """The one-row KPI result as (kpi, value) rows."""
    kpis = summary.executive_summary(s.orders, **STATUS_FILTER, returned="P", cancelled="O")
    return kpis.select([F.col(c).cast("double").alias(c) for c in kpis.columns]).unpivot([], kpis.columns, "kpi", "value")


@query("scenario_rows")
def _s4(s: Shop) -> DataFrame:
    """The rate of each day, scenario and step, where the scenario changes it."""
    k = len(EVENT_STEPS)
    x = whatif.scenario_rates(_baseline(s), SCENARIOS, k)
    rows = x.select("day", "scenario", *[F.col(f"_imp{i}").alias(str(i)) for i in range(2, k + 1)]).unpivot(
        ["day", "scenario"], [str(i) for i in range(2, k + 1)], "step", "rate")
    return rows.where("rate is not null").select("day", "scenario", F.col("step").cast("int").alias("step"), "rate")


@query("star_plus")
def _p2(s: Shop) -> DataFrame:
    return s.orders.select(*ORDER_COLUMNS).withColumns({
        "order_month": trunc_month("order_date"), "is_completed": F.col("status") == "completed"})


@query("filter_eq")
def _p3(s: Shop) -> DataFrame:
    return s.completed().select("order_id", "user_id", "amount")


@query("filter_between")
def _p4(s: Shop) -> DataFrame:
    j = s.completed().join(s.registered, "user_id", "inner")
    return (j.select("order_id", "user_id",
                     diff_months(trunc_month("registered_at"), trunc_month("order_date")).alias("month_number"))
            .where(F.col("month_number").between(0, 5)))


@query("filter_gt")
def _p5(s: Shop) -> DataFrame:
    return ranking.customer_spend(s.users, s.orders, **STATUS_FILTER).select("user_id", "total_orders")


@query("case_searched")
def _p6(s: Shop) -> DataFrame:
    return rfm.rfm_segmentation(s.orders, as_of=AS_OF, sort=False, **STATUS_FILTER).select(
        "user_id", "r_score", "f_score", "m_score", "segment")


@query("case_simple")
def _p7(s: Shop) -> DataFrame:
    return s.events.select("event_id", "event_type", step_index("event_type", EVENT_STEPS).alias("step_order"))


@query("nullif_div")
def _p8(s: Shop) -> DataFrame:
    return activity.dau_wau_mau(s.orders, sort=False, **STATUS_FILTER).select("day", "dau_over_wau")


@query("fill_zero")
def _p11(s: Shop) -> DataFrame:
    per_user = s.completed().groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    return (s.users.select("user_id").join(per_user, "user_id", "left")
            .select("user_id", F.coalesce(F.col("_n"), F.lit(0).cast("long")).alias("completed_orders")))


# ----------------------------------------------------------------------- joins


def _cohorts(s: Shop) -> DataFrame:
    return s.users.select("user_id", trunc_month("registered_at").alias("cohort_month"))


@query("join_inner_equi")
def _j1(s: Shop) -> DataFrame:
    months = s.completed().select("user_id", trunc_month("order_date").alias("order_month")).distinct()
    return _cohorts(s).join(months, "user_id", "inner").select("user_id", "cohort_month", "order_month")


@query("join_inner_derived")
def _j2(s: Shop) -> DataFrame:
    c = _cohorts(s)
    buyers = (c.join(s.completed().select("user_id").distinct(), "user_id", "inner")
              .groupBy("cohort_month").agg(F.count_distinct("user_id").alias("buyers")))
    sizes = c.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("total_users"))
    return buyers.join(sizes, "cohort_month", "inner").select("cohort_month", "buyers", "total_users")


@query("join_left_expr")
def _j3(s: Shop) -> DataFrame:
    """Days LEFT JOIN weeks ON the day's week; one row per day and per week of the calendar. The counts
    are stored (a row for each day, week and month), so orders are read once for both sides."""
    counts = stored(activity.active_counts(s.orders, **STATUS_FILTER), "active-counts")
    days = counts.where("grain = 'day'").select(F.col("period").alias("day"), F.col("users").alias("dau"))
    weeks = counts.where("grain = 'week'").select(F.col("period").alias("week"), F.col("users").alias("wau"))
    return days.join(weeks, trunc_week("day") == F.col("week"), "left").select("day", "dau", "wau")


@query("join_left_extra_pred")
def _j4(s: Shop) -> DataFrame:
    """users LEFT JOIN orders ON id AND status = completed.

    Written as the inner join plus the users without a completed order
    (an anti join against distinct buyer ids): AQE can split a hot user
    on either side of an inner join, but only the preserved side of an
    outer join, and here the hot side is orders. Both sides are stored as
    narrow tables first, so each source is read once."""
    done = stored(s.completed().select("user_id", "order_id"), "completed-orders")
    users = stored(s.users.select("user_id"), "users")
    matched = users.join(done, "user_id", "inner")
    unmatched = (users.join(done.select("user_id").distinct(), "user_id", "left_anti")
                 .select("user_id", F.lit(None).cast("long").alias("order_id")))
    return matched.unionByName(unmatched)


@query("cross_scenarios")
def _j5(s: Shop) -> DataFrame:
    k = len(EVENT_STEPS)
    x = whatif.scenario_rates(_baseline(s), SCENARIOS, k)
    return x.select("day", "scenario", "visitors", "aov", *[f"rate_{i}" for i in range(2, k + 1)],
                    *[or_default(f"_imp{i}", f"rate_{i}").alias(f"improved_rate_{i}") for i in range(2, k + 1)])


# ---------------------------------------------------------------- aggregations


@query("agg_count_star")
def _g1(s: Shop) -> DataFrame:
    return s.orders.groupBy("category").agg(F.count(F.lit(1)).alias("orders"))


@query("agg_count_col")
def _g2(s: Shop) -> DataFrame:
    per_user = s.completed().groupBy("user_id").agg(F.count("order_id").alias("_n"))
    return (s.users.select("user_id", "country").join(per_user, "user_id", "left")
            .groupBy("country").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("completed_orders")))


@query("agg_count_distinct")
def _g3(s: Shop) -> DataFrame:
    return s.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("agg_sum")
def _g4(s: Shop) -> DataFrame:
    return (s.completed().groupBy("category").agg(money_sum("amount").alias("_s"))
            .select("category", round_n(F.col("_s").cast("double"), 2).alias("revenue")))


@query("agg_avg")
def _g5(s: Shop) -> DataFrame:
    return (s.completed().groupBy("category")
            .agg(money_sum("amount").alias("_s"), F.count("amount").alias("_n"))
            .select("category", round_n(money_avg("_s", "_n"), 2).alias("avg_amount")))


@query("agg_max_date")
def _g6(s: Shop) -> DataFrame:
    return s.completed().groupBy("user_id").agg(F.max(to_day("order_date")).alias("last_order"))


@query("agg_global")
def _g7(s: Shop) -> DataFrame:
    return s.orders.agg(F.count(F.lit(1)).alias("orders"), money_sum("amount").alias("_s")).select(
        "orders", round_n(F.col("_s").cast("double"), 2).alias("total_amount"))


@query("agg_cond_distinct")
def _g8(s: Shop) -> DataFrame:
    return (s.orders.groupBy(trunc_month("order_date").alias("month"))
            .agg(F.count_distinct(F.when(F.col("status") == "completed", F.col("order_id")))
                 .alias("completed_orders")))


@query("agg_cond_sum_avg")
def _g9(s: Shop) -> DataFrame:
    done = F.col("status") == "completed"
    return (s.orders.groupBy("category")
            .agg(money_sum(F.when(done, F.col("amount"))).alias("_s"),
                 F.count(F.when(done, F.col("amount"))).alias("_n"))
            .select("category", round_n(F.col("_s").cast("double"), 2).alias("revenue"),
                    round_n(money_avg("_s", "_n"), 2).alias("avg_order_value")))


@query("agg_cond_rate")
def _g10(s: Shop) -> DataFrame:
    st = F.col("status")
    return (s.orders.groupBy("category")
            .agg(F.count(F.when(st == "returned", F.lit(1))).alias("_r"),
                 F.count(F.when(st == "cancelled", F.lit(1))).alias("_c"),
                 F.count(F.lit(1)).alias("_n"))
            .select("category", pct("_r", "_n", 1).alias("return_rate_pct"),
                    pct("_c", "_n", 1).alias("cancel_rate_pct")))


@query("group_by_expr")
def _g11(s: Shop) -> DataFrame:
    return (s.orders.groupBy(trunc_month("order_date").alias("month"), "status")
            .agg(F.count(F.lit(1)).alias("orders")))


@query("value_counts")
def _g12(s: Shop) -> DataFrame:
    return reshape.value_counts(rfm.rfm_segmentation(s.orders, as_of=AS_OF, sort=False, **STATUS_FILTER), "segment")


@query("quartile_profile")
def _g13(s: Shop) -> DataFrame:
    return reshape.quartile_profile(_ranked(s, "quartile"))


@query("pivot_cohort")
def _g14(s: Shop) -> DataFrame:
    return reshape.pivot_cohort(cohort.cohort_retention(s.users, s.orders, status_col="status_code", active_status="F", sort=False))


@query("pivot_revenue")
def _g15(s: Shop) -> DataFrame:
    return reshape.pivot_revenue(revenue.revenue_breakdown(s.orders, sort=False, **STATUS_FILTER))


# --------------------------------------------------------------------- windows


def _rfm_scored(s: Shop, *scores: str) -> DataFrame:
    return rfm.rfm_scores(rfm.rfm_raw(s.orders, as_of=AS_OF, **STATUS_FILTER), scores=scores)


def _spend(s: Shop) -> DataFrame:
    return ranking.customer_spend(s.users, s.orders, **STATUS_FILTER)


def _ranked(s: Shop, *columns: str) -> DataFrame:
    return ranking.rank_customers(_spend(s), columns=columns)


@query("win_ntile5_desc")
def _w1(s: Shop) -> DataFrame:
    return _rfm_scored(s, "r_score").select("user_id", "recency", "r_score")


@query("win_ntile5_asc")
def _w2(s: Shop) -> DataFrame:
    return _rfm_scored(s, "f_score", "m_score").select("user_id", "frequency", "monetary", "f_score", "m_score")


@query("win_ntile4")
def _w3(s: Shop) -> DataFrame:
    return _ranked(s, "quartile").select("user_id", "total_spent", "quartile")


@query("win_rank_global")
def _w4(s: Shop) -> DataFrame:
    return _ranked(s, "global_rank").select("user_id", "total_spent", "global_rank")


@query("win_rank_part")
def _w5(s: Shop) -> DataFrame:
    return _ranked(s, "country_rank").select("user_id", "country", "total_spent", "country_rank")


@query("win_percent_rank")
def _w6(s: Shop) -> DataFrame:
    return _ranked(s, "percentile").select("user_id", "total_spent", "percentile")


@query("win_running_sum")
def _w7(s: Shop) -> DataFrame:
    return _ranked(s, "running_revenue").select("user_id", "total_spent", "running_revenue")


@query("win_lag_part")
def _w8(s: Shop) -> DataFrame:
    return _ranked(s, "prev_user_spent").select("user_id", "country", "total_spent", "prev_user_spent")


@query("win_lead_part")
def _w9(s: Shop) -> DataFrame:
    return _ranked(s, "next_user_spent").select("user_id", "country", "total_spent", "next_user_spent")


@query("win_lag_mom")
def _w10(s: Shop) -> DataFrame:
    r = revenue.revenue_breakdown(s.orders, sort=False, **STATUS_FILTER)
    return r.select("month", "category", "revenue", "mom_growth_pct")


def _funnel_by_day(s: Shop) -> DataFrame:
    return funnel.conversion_funnel(_events_by_day(s), steps=EVENT_STEPS, segment_cols=("day",), sort=False)


@query("win_lag_funnel")
def _w11(s: Shop) -> DataFrame:
    return _funnel_by_day(s).select("day", "step_order", "event_type", "users", "prev_users", "pct_prev_step")


@query("win_first_value")
def _w12(s: Shop) -> DataFrame:
    return _funnel_by_day(s).select("day", "step_order", "event_type", "users", "pct_of_top")


@query("win_share")
def _w13(s: Shop) -> DataFrame:
    return revenue.revenue_breakdown(s.orders, sort=False, **STATUS_FILTER).select("month", "category", "revenue", "pct_of_month")


# ---------------------------------------------------------- sorts and top-k


@query("sort_multi")
def _t1(s: Shop) -> DataFrame:
    return revenue.revenue_breakdown(s.orders, **STATUS_FILTER).select("month", "category", "revenue")


@query("sort_single")
def _t2(s: Shop) -> DataFrame:
    return s.completed().select("order_id", "amount").orderBy(F.col("amount").desc_nulls_last())


@query("sort_multi_order")
def _t1o(s: Shop) -> DataFrame:
    """Order of the stored ``sort_multi``: rows, and rows in front of one that belongs before them."""
    r = revenue.revenue_breakdown(s.orders, **STATUS_FILTER).select("month", "category", "revenue")
    return order.stored_order(r, (("month", False), ("revenue", True))).select("rows", "breaks")


@query("sort_single_order")
def _t2o(s: Shop) -> DataFrame:
    """Order of the stored ``sort_single``."""
    return order.stored_order(_t2(s), (("amount", True),)).select("rows", "breaks")


@query("head_sorted")
def _t4(s: Shop) -> DataFrame:
    return ranking.top_ranked(_spend(s), 10).select("user_id", "global_rank", "total_spent")


@query("top_n")
def _t3(s: Shop) -> DataFrame:
    spend = ranking.customer_spend(s.users, s.orders, **STATUS_FILTER)
    return (spend.orderBy(F.col("total_spent").desc_nulls_last(), F.col("user_id").asc())
            .limit(100).select("user_id", "total_spent"))


@query("top_k_per_group")
def _t5(s: Shop) -> DataFrame:
    return ranking.top_of_country(_spend(s), 3).select("user_id", "country", "plan", "total_spent", "country_rank")


# ------------------------------------------------------------ scalar functions


@query("cast_date")
def _f1(s: Shop) -> DataFrame:
    return s.orders.select("order_id", "order_date")


@query("date_literal")
def _f2(s: Shop) -> DataFrame:
    return s.orders.where(F.col("order_date") >= date_lit(FROM_DAY)).select("order_id", "order_date")


@query("trunc_month")
def _f3(s: Shop) -> DataFrame:
    return s.orders.select("order_id", trunc_month("order_date").alias("month"))


@query("trunc_week")
def _f4(s: Shop) -> DataFrame:
    return s.orders.select("order_id", trunc_week("order_date").alias("week"))


@query("diff_months")
def _f5(s: Shop) -> DataFrame:
    return (s.orders.join(s.registered, "user_id", "inner")
            .select("order_id", diff_months("registered_at", "order_date").alias("months_since_registration")))


@query("diff_days")
def _f6(s: Shop) -> DataFrame:
    return s.orders.select("order_id", diff_days("order_date", F.lit(AS_OF)).alias("days_to_as_of"))


@query("round_n")
def _f7(s: Shop) -> DataFrame:
    return s.orders.select("order_id", round_n("amount", 1).alias("amount_1dp"),
                           round_n(F.col("amount") / F.lit(3.0), 2).alias("third_2dp"),
                           round_n(nullif_div(F.col("amount") * F.lit(100.0), F.lit(7.0)), 1).alias("pct_7"))


@query("nullif_zero")
def _f8(s: Shop) -> DataFrame:
    """Days between an order and its month's first day; NULL for orders of that day."""
    return s.orders.select("order_id", F.nullif(diff_days(trunc_month("order_date"), "order_date"), F.lit(0).cast("long"))
                           .alias("days_into_month"))


@query("round_half_even")
def _f11(s: Shop) -> DataFrame:
    """Half the order number as a head-count, ties to even."""
    return s.orders.select("order_id", F.bround(F.col("order_id") / F.lit(2.0), 0).cast("long").alias("half"))


@query("month_label")
def _f10(s: Shop) -> DataFrame:
    return s.orders.select("order_id", month_label("order_date").alias("month_label"))
