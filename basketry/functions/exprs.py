"""Column expressions shared by every operator.

They pin down the few places where Spark's defaults differ from the SQL
semantics the analyses are defined by: rounding of doubles, month
differences counted as calendar boundaries, percentages typed as DOUBLE,
division by zero, and the result types of counts and date truncation.
All of them are plain built-in functions, so they stay inside whole-stage
codegen.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str

#: decimals that an exact sum keeps of an amount, and the type they need;
#: an amount of 10^16 or more, or NaN, does not fit and raises an error
EXACT_SCALE = 12
EXACT_DECIMAL = f"decimal(28,{EXACT_SCALE})"


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    """Fail early, with the operator's name, when an input column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing column(s) {missing}; have {df.columns}")


def round_n(x: ColumnOrName, n: int) -> Column:
    """ROUND(x, n) on doubles the way the oracle SQL engine does it.

    Scale, round half away from zero, scale back. Spark's own
    ``round(x, n)`` rounds the shortest decimal text of ``x`` instead and
    disagrees on values such as 231812.10499999998.
    """
    scale = float(10**n)
    return F.round(col(x).cast("double") * F.lit(scale)) / F.lit(scale)


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den as DOUBLE; NULL when den is 0 or NULL (never raises)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def nullif_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / NULLIF(den, 0)."""
    return F.try_divide(col(num).cast("double"), F.nullif(col(den), F.lit(0)).cast("double"))


def pct(num: ColumnOrName, den: ColumnOrName, digits: int = 1) -> Column:
    """ROUND(100.0 * num / den, digits) as DOUBLE, NULL on a zero denominator."""
    return round_n(F.try_divide(F.lit(100.0) * col(num).cast("double"), col(den).cast("double")), digits)


def exact(x: ColumnOrName) -> Column:
    """An amount as the decimal that exact sums add up (NaN raises)."""
    c = col(x)
    nan = F.raise_error(F.lit("an amount is NaN: exact sums cannot hold it")).cast(EXACT_DECIMAL)
    return F.when(F.isnan(c), nan).otherwise(c.cast(EXACT_DECIMAL))


def money_sum(x: ColumnOrName) -> Column:
    """Exact SUM of amounts, the same under any partitioning, as decimal.

    Only what callers make of the sum is rounded, never the amounts.
    """
    return F.sum(exact(x))


def money_avg(sum_col: ColumnOrName, count_col: ColumnOrName) -> Column:
    """AVG from an exact sum and a non-null count, as DOUBLE."""
    return F.try_divide(col(sum_col).cast("double"), col(count_col).cast("double"))


def to_day(x: ColumnOrName) -> Column:
    """CAST(x AS DATE) for date, timestamp, timestamp_ntz or 'YYYY-MM-DD' text."""
    return F.to_date(col(x))


def trunc_month(d: ColumnOrName) -> Column:
    """DATE_TRUNC('month', d) as a DATE (not a timestamp)."""
    return F.trunc(to_day(d), "month")


def trunc_week(d: ColumnOrName) -> Column:
    """DATE_TRUNC('week', d) as a DATE; weeks start on Monday."""
    return F.trunc(to_day(d), "week")


def month_index(d: ColumnOrName) -> Column:
    day = to_day(d)
    return F.year(day) * F.lit(12) + F.month(day)


def diff_months(start: ColumnOrName, end: ColumnOrName) -> Column:
    """DATEDIFF('month', start, end): month boundaries crossed, as BIGINT.

    Spark's ``datediff(MONTH, ...)`` counts complete months instead
    (Jan 31 -> Feb 1 is 0 there, 1 here).
    """
    return (month_index(end) - month_index(start)).cast("long")


def diff_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """DATEDIFF('day', start, end) as BIGINT."""
    return F.date_diff(to_day(end), to_day(start)).cast("long")


def month_label(d: ColumnOrName) -> Column:
    """'YYYY-MM' text of a date."""
    return F.date_format(to_day(d), "yyyy-MM")


def date_lit(value: str | _dt.date) -> Column:
    if isinstance(value, str):
        value = _dt.date.fromisoformat(value)
    return F.lit(value)


def step_index(c: ColumnOrName, steps: Sequence[str]) -> Column:
    """Simple CASE c WHEN steps[0] THEN 1 ... END with no ELSE (unknown -> NULL)."""
    if not steps:
        raise ValueError("step_index: at least one step is required")
    out = None
    for i, name in enumerate(steps, start=1):
        cond = col(c) == F.lit(name)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def or_default(value: ColumnOrName, default: ColumnOrName) -> Column:
    """Python's ``value or default`` for numbers: NULL and 0 both fall back."""
    v = col(value)
    return F.when(v.isNull() | (v == 0), col(default)).otherwise(v)
