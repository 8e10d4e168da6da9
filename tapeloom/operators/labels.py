"""Calendar-clock returns and labels on the dense grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOCK_TOLERANCE = 1e-4


def with_hit_labels(
    grid: DataFrame, calendar: DataFrame, buy: int = 1, sell: int = 2, threshold: float = 0.05,
    exclude_locked: bool = True, use_low: bool = True,
) -> DataFrame:
    """``grid`` with the label of day t: 1 when open[t+sell]/open[t+buy]-1 reaches the threshold, 0 when not, and
    -1 when a price is missing, the buy day is limit-locked, or t is too near the end.

    ``use_low`` recognises a locked day by open = high = low, otherwise by open = high alone.
    """
    later = Window.partitionBy("code").orderBy("day_idx")  # the grid has every day, so a lead is an offset
    df = grid.withColumns({
        "buy_open": F.lead("open", buy).over(later), "buy_high": F.lead("high", buy).over(later),
        "buy_low": F.lead("low", buy).over(later), "sell_open": F.lead("open", sell).over(later),
    })
    n_days = calendar.select(F.max("day_idx").alias("m")).scalar() + 1
    near_high = F.abs(F.col("buy_open") - F.col("buy_high")) < LOCK_TOLERANCE
    near_low = F.coalesce(F.abs(F.col("buy_open") - F.col("buy_low")) < LOCK_TOLERANCE, F.lit(False))
    locked = (near_high & near_low) if use_low else near_high
    known = F.col("buy_open").isNotNull() & F.col("sell_open").isNotNull() & F.col("buy_high").isNotNull()
    usable = (F.col("day_idx") < n_days - sell) & (n_days - sell > buy) & known
    if exclude_locked:
        usable = usable & ~locked
    gain = F.try_divide(F.col("sell_open"), F.col("buy_open")) - 1
    label = F.when(F.coalesce(usable, F.lit(False)), F.when(gain >= threshold, 1).otherwise(0)).otherwise(-1)
    return df.withColumn("label", label.cast("int")).drop("buy_open", "buy_high", "buy_low", "sell_open")


def hit_labels(grid: DataFrame, calendar: DataFrame, **how) -> DataFrame:
    return with_hit_labels(grid, calendar, **how).select("code", "trade_date", "day_idx", "label")


def label_stats(labels: DataFrame) -> DataFrame:
    total, valid = F.count(F.lit(1)), F.count_if(F.col("label") >= 0)
    hit = F.count_if(F.col("label") == 1)
    return labels.agg(
        total.alias("total"), valid.alias("valid"), hit.alias("hit"),
        F.coalesce(F.try_divide(valid, total), F.lit(0.0)).alias("valid_pct"),
        F.coalesce(F.try_divide(hit, valid), F.lit(0.0)).alias("hit_rate"),
        F.sqrt(F.count_if(F.col("label") == 0) / F.greatest(hit, F.lit(1))).alias("pos_weight"),
    )


def grid_log_returns(grid: DataFrame) -> DataFrame:
    """Log return between neighbouring calendar days, dated by its first day; an undefined
    return is 0. The last day has none and is dropped."""
    w = Window.partitionBy("code").orderBy("day_idx")
    later = F.lead("close").over(w)
    out = grid.select(
        "code", "trade_date", "day_idx",
        F.coalesce(F.ln(F.try_divide(later, F.col("close"))), F.lit(0.0)).alias("ret"),
        F.lead("day_idx").over(w).alias("_next"),
    )
    return out.where(F.col("_next").isNotNull()).drop("_next")


def forward_returns(returns: DataFrame, horizon: int) -> DataFrame:
    """Sum of the next ``horizon`` returns from day t on; only full windows."""
    w = Window.partitionBy("code").orderBy("day_idx").rowsBetween(0, horizon - 1)
    out = returns.select(
        "code", "trade_date", "day_idx", F.sum("ret").over(w).alias("fwd"), F.count("ret").over(w).alias("_n")
    )
    return out.where(F.col("_n") == horizon).drop("_n")


def market_proxy(returns: DataFrame) -> DataFrame:
    """Equal-weighted mean return over the tokens of a day."""
    return returns.groupBy("day_idx").agg(F.avg("ret").alias("mkt"))
