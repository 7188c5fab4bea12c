"""Scalar column expressions (rounding, percentages, dates, CASE helpers)."""

from basketry.functions.exprs import (  # noqa: F401
    EXACT_DECIMAL,
    date_lit,
    diff_days,
    diff_months,
    month_label,
    exact,
    money_avg,
    money_sum,
    nullif_div,
    or_default,
    pct,
    require_columns,
    round_n,
    safe_div,
    step_index,
    to_day,
    trunc_month,
    trunc_week,
)
