"""Golden values (FIXTURES.md sections 5 and 6) and scalar semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.functions.exprs import diff_months, or_default, round_n, step_index, trunc_week
from basketry.operators import executive_summary, pivot_revenue, revenue_breakdown
from basketry.operators.whatif import Scenario, simulate_kpis, simulate_stages


def test_round_n_matches_engine(spark):
    df = spark.createDataFrame([(143544.205,), (231812.10499999998,), (-2.5,), (2.675,)], "x double")
    got = [r[0] for r in df.select(round_n("x", 2)).collect()]
    assert got == [143544.2, 231812.11, -2.5, 2.68]
    assert [r[0] for r in df.select(round_n("x", 0)).collect()] == [143544.0, 231812.0, -3.0, 3.0]


def test_dates(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1), dt.date(2023, 1, 31), dt.date(2023, 2, 1))], "a date, b date, c date")
    r = df.select(trunc_week("a").alias("w"), diff_months("b", "c").alias("m")).first()
    assert r.w == dt.date(2022, 12, 26)
    assert r.m == 1


def test_case_helpers(spark):
    df = spark.createDataFrame([("b",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(step_index("t", ["a", "b"])).collect()] == [2, None, None]
    d = spark.createDataFrame([(None, 0.5), (0.0, 0.5), (0.7, 0.5)], "imp double, cur double")
    assert [r[0] for r in d.select(or_default("imp", "cur")).collect()] == [0.5, 0.5, 0.7]


@pytest.fixture(scope="module")
def baseline(spark):
    # the published current funnel: 500 visitors, order value 397.48
    return spark.createDataFrame(
        [(500, 397.48, 0.948, 0.736, 0.576, 0.478)],
        "visitors long, aov double, rate_2 double, rate_3 double, rate_4 double, rate_5 double")


GOLDEN = {
    # scenario: (users per stage, purchases, revenue, extra, uplift %)
    "no change": ([500, 474, 349, 201, 96], 96, 38158.08, 0.0, 0.0),
    "form only": ([500, 474, 349, 244, 117], 117, 46505.16, 8347.08, 21.9),
    "form + wallet": ([500, 474, 389, 280, 134], 134, 53262.32, 15104.24, 39.6),
    "full optimisation": ([500, 485, 412, 309, 185], 185, 73533.80, 35375.72, 92.7),
}


def test_what_if_golden(baseline):
    kpis = {r.scenario: r for r in simulate_kpis(baseline, SCENARIOS).collect()}
    stages = simulate_stages(baseline, SCENARIOS).collect()
    for name, (users, purchases, revenue, extra, uplift) in GOLDEN.items():
        k = kpis[name]
        assert k.purchases_current == 96
        assert k.purchases_improved == purchases
        assert k.revenue_current == 38158.08
        assert k.revenue_improved == pytest.approx(revenue, abs=1e-9)
        assert k.revenue_extra == pytest.approx(extra, abs=1e-9)
        assert k.uplift_pct == uplift
        got = [r.users_improved for r in sorted((s for s in stages if s.scenario == name), key=lambda s: s.stage_order)]
        assert got == users
    cur = sorted((s for s in stages if s.scenario == "no change"), key=lambda s: s.stage_order)
    assert [s.pct_current for s in cur] == [100.0, 94.8, 69.8, 40.2, 19.2]


def test_what_if_zero_visitors(spark):
    b = spark.createDataFrame([(0, 10.0, 0.5, 0.5, 0.5, 0.5)],
                              "visitors long, aov double, rate_2 double, rate_3 double, rate_4 double, rate_5 double")
    k = simulate_kpis(b, SCENARIOS[:1]).first()
    assert k.purchases_current == 0 and k.uplift_pct is None


def test_empty_summary(spark):
    from basketry.operators.summary import executive_summary

    empty = spark.createDataFrame([], "order_id long, user_id long, amount double, status string")
    r = executive_summary(empty).first()
    assert r.total_users == 0 and r.completed_orders == 0
    assert r.total_revenue is None and r.return_rate_pct is None


@pytest.mark.parametrize("n", [0, 1, 3])
def test_rfm_tiny(spark, n):
    from basketry.operators.rfm import rfm_segmentation

    rows = [(i, i, dt.date(2001, 1, 1 + i), 10.0 * (i + 1), "x", "completed") for i in range(n)]
    orders = spark.createDataFrame(rows, "order_id long, user_id long, order_date date, amount double, "
                                         "category string, status string")
    out = rfm_segmentation(orders, as_of="2001-08-01").collect()
    assert len(out) == n
    # fewer rows than tiles: tiles 1..n in order
    assert sorted(r.f_score for r in out) == list(range(1, n + 1))
    if n == 1:
        assert (out[0].r_score, out[0].f_score, out[0].m_score) == (1, 1, 1)


# The four scenarios of the golden table (FIXTURES.md 5).
SCENARIOS = (
    Scenario("no change", {}),
    Scenario("form only", {4: 0.70}),
    Scenario("form + wallet", {3: 0.82, 4: 0.72}),
    Scenario("full optimisation", {2: 0.97, 3: 0.85, 4: 0.75, 5: 0.60}),
)


def test_scenario_for_a_step_that_does_not_exist(spark):
    base = spark.createDataFrame([(10, 2.0, 0.5, 0.5)], "visitors long, aov double, rate_2 double, rate_3 double")
    with pytest.raises(ValueError, match="no step"):
        simulate_kpis(base, [Scenario("typo", {4: 0.1})], n_steps=3)


def _tiny_orders(spark, amounts):
    import datetime as dt

    rows = [(i, i, dt.date(2023, 1, 5), a, c, "completed") for i, (a, c) in enumerate(amounts)]
    return spark.createDataFrame(rows, "order_id long, user_id long, order_date date, amount double, category string, status string")


def test_amounts_are_summed_before_rounding(spark):
    import duckdb

    orders = _tiny_orders(spark, [(0.004, "a")] * 3)
    r = revenue_breakdown(orders).first()
    assert (r.revenue, r.pct_of_month) == (0.01, 100.0)
    want = duckdb.sql("SELECT ROUND(SUM(x), 2) FROM (VALUES (0.004::DOUBLE), (0.004), (0.004)) t(x)").fetchall()[0][0]
    assert executive_summary(orders).first().total_revenue == want == 0.01


@pytest.mark.parametrize("amount", [float("nan"), 1e17])
def test_amounts_that_exact_sums_cannot_hold_raise(spark, amount):
    with pytest.raises(Exception, match="NaN|CAST|OVERFLOW|NUMERIC|precision|represent"):
        executive_summary(_tiny_orders(spark, [(amount, "a"), (1.0, "a")])).collect()


def test_pivot_revenue_keeps_every_category(spark):
    rev = revenue_breakdown(_tiny_orders(spark, [(1.0, "x"), (2.0, "a"), (4.0, None)]))
    r = pivot_revenue(rev).first()
    assert (r.a, r.x, r["null"]) == (2.0, 1.0, 4.0)
    assert pivot_revenue(rev, ["a", "x", None, "empty"]).first().empty == 0.0
    with pytest.raises(Exception, match="unlisted category"):
        pivot_revenue(rev, ["a", "x"]).collect()
    with pytest.raises(ValueError, match="more than 2"):
        pivot_revenue(rev, max_categories=2)


def test_no_shared_folder_is_an_error():
    from basketry.session import checkpoint_dir

    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session)
