"""Funnel what-if: purchases and revenue under improved step rates.

The scalar simulator of the original analyses is re-expressed as a
DataFrame operator: a *baseline* row per segment (visitors, average
order value and the observed step-to-step rates, usually derived from
``conversion_funnel`` and the orders table) is expanded with a small,
fixed list of scenarios and every stage is a column expression. The work
is (#segments x #scenarios) rows of arithmetic, with no UDF, no join
against the scenarios and no driver loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.exprs import or_default, round_n, safe_div
from basketry.operators.funnel import DEFAULT_STEPS


@dataclass(frozen=True)
class Scenario:
    """A named set of improved rates, keyed by step number (2..k).

    A missing step, None or 0.0 keeps the current rate.
    """

    name: str
    rates: dict[int, float] = field(default_factory=dict)


def funnel_baseline(funnel: DataFrame, n_steps: int, *, segment_cols: Sequence[str] = (),
                    aov: DataFrame | float | None = None) -> DataFrame:
    """segment..., visitors, aov, rate_2..rate_k from a funnel result.

    ``visitors`` is the users of step 1; ``rate_i`` = users_i / users_(i-1)
    unrounded (NULL when a step is missing or the previous one is 0).
    ``aov`` is a number, a DataFrame (segment..., aov) joined on the segment
    columns, or a DataFrame of one row (aov) for all segments.
    """
    values = list(range(1, n_steps + 1))
    wide = (funnel.where(F.col("step_order").isNotNull())
            .groupBy(*segment_cols).pivot("step_order", values).agg(F.max("users")))
    base = wide.select(
        *segment_cols, F.col("1").cast("long").alias("visitors"),
        *[safe_div(str(i), str(i - 1)).alias(f"rate_{i}") for i in range(2, n_steps + 1)])
    if aov is None or isinstance(aov, (int, float)):
        return base.withColumn("aov", F.lit(aov).cast("double"))
    if segment_cols and set(segment_cols) <= set(aov.columns):
        return base.join(aov, list(segment_cols), "left")
    # one global order value for all segments: its single row has a constant key
    one = F.lit(1).alias("_one")
    return base.select("*", one).join(aov.select("*", one), "_one", "left").drop("_one")


def _scenario_rows(scenarios: Sequence[Scenario], n_steps: int):
    for s in scenarios:
        if unknown := sorted(set(s.rates) - set(range(2, n_steps + 1))):
            raise ValueError(f"scenario {s.name!r}: no step {unknown} among steps 2..{n_steps}")
    return F.array(*[
        F.struct(F.lit(s.name).alias("scenario"),
                 *[F.lit(s.rates.get(i)).cast("double").alias(f"_imp{i}") for i in range(2, n_steps + 1)])
        for s in scenarios])


def scenario_rates(baseline: DataFrame, scenarios: Sequence[Scenario], n_steps: int) -> DataFrame:
    """``baseline`` once per scenario, with ``scenario`` and its rates ``_imp2.._impk`` (NULL: not changed)."""
    return baseline.select("*", F.inline(_scenario_rows(scenarios, n_steps)))


def head_counts(baseline: DataFrame, scenarios: Sequence[Scenario], n_steps: int) -> DataFrame:
    """Per (segment, scenario): current and improved head-count per stage.

    Each stage is round-half-even(previous stage x rate), rounded at every
    stage like the original simulator.
    """
    x = scenario_rates(baseline, scenarios, n_steps)
    cols = {"_c1": F.col("visitors").cast("double"), "_i1": F.col("visitors").cast("double")}
    x = x.withColumns(cols)
    for i in range(2, n_steps + 1):
        rate = F.col(f"rate_{i}")
        x = x.withColumns({
            f"_c{i}": F.bround(F.col(f"_c{i - 1}") * rate, 0),
            f"_i{i}": F.bround(F.col(f"_i{i - 1}") * or_default(f"_imp{i}", rate), 0),
        })
    return x


def simulate_stages(baseline: DataFrame, scenarios: Sequence[Scenario], *,
                    steps: Sequence[str] = DEFAULT_STEPS, segment_cols: Sequence[str] = ()) -> DataFrame:
    """segment..., scenario, stage_order, stage, users_current, pct_current,
    users_improved, pct_improved, users_extra (one row per stage)."""
    k = len(steps)
    x = head_counts(baseline, scenarios, k)
    stages = F.array(*[
        F.struct(F.lit(i).alias("stage_order"), F.lit(steps[i - 1]).alias("stage"),
                 F.col(f"_c{i}").alias("_cu"), F.col(f"_i{i}").alias("_iu"))
        for i in range(1, k + 1)])
    s = x.select(*segment_cols, "scenario", "visitors", F.inline(stages))
    return s.select(
        *segment_cols, "scenario", "stage_order", "stage",
        F.col("_cu").cast("long").alias("users_current"),
        round_n(safe_div("_cu", "visitors") * F.lit(100.0), 1).alias("pct_current"),
        F.col("_iu").cast("long").alias("users_improved"),
        round_n(safe_div("_iu", "visitors") * F.lit(100.0), 1).alias("pct_improved"),
        (F.col("_iu") - F.col("_cu")).cast("long").alias("users_extra"))


def simulate_kpis(baseline: DataFrame, scenarios: Sequence[Scenario], *,
                  n_steps: int = len(DEFAULT_STEPS), segment_cols: Sequence[str] = ()) -> DataFrame:
    """segment..., scenario, purchases_current, purchases_improved,
    revenue_current, revenue_improved, revenue_extra, uplift_pct."""
    x = head_counts(baseline, scenarios, n_steps)
    cur, imp = F.col(f"_c{n_steps}"), F.col(f"_i{n_steps}")
    rev_cur = round_n(cur * F.col("aov"), 2)
    rev_imp = round_n(imp * F.col("aov"), 2)
    return x.select(
        *segment_cols, "scenario",
        cur.cast("long").alias("purchases_current"),
        imp.cast("long").alias("purchases_improved"),
        rev_cur.alias("revenue_current"),
        rev_imp.alias("revenue_improved"),
        round_n(rev_imp - rev_cur, 2).alias("revenue_extra"),
        round_n(safe_div(imp - cur, cur) * F.lit(100.0), 1).alias("uplift_pct"))
