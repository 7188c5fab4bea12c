"""RFM (recency, frequency, monetary) quintile scoring and segments."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.exprs import (
    date_lit, diff_days, money_sum, require_columns, round_n, to_day,
)
from basketry.operators.windows import Ordering, tile_columns
from basketry.session import stored

# Segment names, tested in this order (first match wins).
CHAMPIONS = "Champions"
LOYAL = "Loyal Customers"
NEW = "New Customers"
AT_RISK = "At Risk"
LOST = "Lost"
POTENTIAL = "Potential Loyalists"


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    """Searched CASE over the three scores (1..5)."""
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), F.lit(CHAMPIONS))
            .when((r >= 3) & (f >= 3), F.lit(LOYAL))
            .when((r >= 4) & (f <= 2), F.lit(NEW))
            .when((r <= 2) & (f >= 3), F.lit(AT_RISK))
            .when((r <= 2) & (f <= 2), F.lit(LOST))
            .otherwise(F.lit(POTENTIAL)))


def rfm_raw(orders: DataFrame, *, as_of: str | _dt.date, user_col: str = "user_id",
            date_col: str = "order_date", amount_col: str = "amount", status_col: str = "status",
            completed: str = "completed") -> DataFrame:
    """Per user over completed orders: recency (days from the last order to
    ``as_of``), frequency (order count), monetary (exact sum, 2 decimals)."""
    require_columns(orders, [user_col, date_col, amount_col, status_col], "rfm")
    agg = (orders.where(F.col(status_col) == F.lit(completed))
           .groupBy(F.col(user_col).alias(user_col))
           .agg(F.max(to_day(date_col)).alias("_last"),
                F.count(F.lit(1)).alias("frequency"),
                money_sum(amount_col).alias("_m")))
    return agg.select(
        user_col,
        diff_days("_last", date_lit(as_of)).alias("recency"),
        F.col("frequency").cast("long").alias("frequency"),
        round_n(F.col("_m").cast("double"), 2).alias("monetary"))


#: score -> (measure, descending): recent buyers score high
SCORES = {"r_score": ("recency", True), "f_score": ("frequency", False), "m_score": ("monetary", False)}


def rfm_scores(raw: DataFrame, *, user_col: str = "user_id", n_tiles: int = 5, ranges: int | None = None,
               scores: Sequence[str] = tuple(SCORES)) -> DataFrame:
    """Add r/f/m_score, or those of ``scores``: NTILE over recency DESC (recent = high), frequency
    and monetary ASC; ties broken by user id so scores are deterministic.

    The orderings asked for are sorted in one pass, for the rows at the tile
    borders; a row's scores are then an expression over its own columns.
    """
    raw = stored(raw, "rfm-rows")
    tiles = {name: (Ordering((SCORES[name],), (user_col,)), n_tiles) for name in scores}
    columns = tile_columns(raw, tiles, ranges=ranges)
    return raw.select(*raw.columns, *[c.alias(name) for name, c in columns.items()])


def rfm_segmentation(orders: DataFrame, *, as_of: str | _dt.date = "2023-12-31",
                     user_col: str = "user_id", date_col: str = "order_date",
                     amount_col: str = "amount", status_col: str = "status",
                     completed: str = "completed", n_tiles: int = 5,
                     ranges: int | None = None, sort: bool = True) -> DataFrame:
    """user, recency, frequency, monetary, r/f/m_score, rfm_avg, segment."""
    raw = rfm_raw(orders, as_of=as_of, user_col=user_col, date_col=date_col,
                  amount_col=amount_col, status_col=status_col, completed=completed)
    s = rfm_scores(raw, user_col=user_col, n_tiles=n_tiles, ranges=ranges)
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    out = s.select(
        user_col, "recency", "frequency", "monetary", "r_score", "f_score", "m_score",
        round_n((r + f + m).cast("double") / F.lit(3.0), 1).alias("rfm_avg"),
        rfm_segment(r, f, m).alias("segment"))
    if sort:
        out = out.orderBy(F.col("rfm_avg").desc_nulls_last(), F.col(user_col).asc_nulls_last())
    return out
