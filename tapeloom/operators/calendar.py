"""Trading calendar, dense grids, splits: everything counted in calendar days of the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trading_calendar(panel: DataFrame, date: str = "trade_date") -> DataFrame:
    """(trade_date, day_idx) over the distinct dates. The one global window here runs over
    the calendar, which has one row per trading day."""
    days = panel.select(date).distinct()
    return days.select(
        F.col(date), (F.row_number().over(Window.orderBy(date)) - 1).cast("bigint").alias("day_idx")
    )


def with_day_idx(df: DataFrame, calendar: DataFrame, date: str = "trade_date") -> DataFrame:
    return df.join(calendar.select(F.col("trade_date").alias(date), "day_idx"), date)


def at_offset(
    left: DataFrame, right: DataFrame, offset: int, columns: dict[str, str],
    keys: tuple[str, ...] = ("code",), how: str = "left",
) -> DataFrame:
    """Bring ``columns`` of ``right`` from ``offset`` calendar days later (both need day_idx)."""
    moved = right.select(
        *keys, (F.col("day_idx") - offset).alias("day_idx"),
        *[F.col(src).alias(new) for src, new in columns.items()],
    )
    return left.join(moved, [*keys, "day_idx"], how)


def dense_grid(
    panel: DataFrame, tokens: DataFrame, calendar: DataFrame, token: str = "code"
) -> DataFrame:
    """Every (token, calendar day). Each token spells out its own day range, which then meets
    the calendar by equality, so no cross product is planned."""
    last = calendar.select(F.max("day_idx").alias("last")).scalar()
    grid = tokens.select(token).distinct().select(
        token, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("day_idx")
    )
    return grid.join(calendar, "day_idx").join(panel, [token, "trade_date"], "left")


def market_cube(
    prices: DataFrame, features: DataFrame, feature_cols: list[str], calendar: DataFrame
) -> DataFrame:
    """Dense grid with price, traded flag and features; an absent cell has NULL price,
    traded false and features 0."""
    tokens = prices.select("code").distinct()
    cube = dense_grid(prices, tokens, calendar).withColumn("traded", F.col("close").isNotNull())
    feats = features.select("code", "trade_date", *feature_cols)
    cube = cube.join(feats, ["code", "trade_date"], "left")
    return cube.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in feature_cols})


def sequence_windows(cube: DataFrame, columns: list[str], length: int) -> DataFrame:
    """The last ``length`` days of each token as arrays, from day ``length - 1`` on."""
    w = Window.partitionBy("code").orderBy("day_idx").rowsBetween(-(length - 1), 0)
    seq = cube.select(
        "code", "trade_date", "day_idx",
        F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w).alias("window"),
    )
    return seq.where(F.size("window") == length)


def half_open(df: DataFrame, start, end, date: str = "trade_date") -> DataFrame:
    return df.where((F.col(date) >= F.lit(start).cast("date")) & (F.col(date) < F.lit(end).cast("date")))


def inclusive(df: DataFrame, start=None, end=None, date: str = "trade_date") -> DataFrame:
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def split_label(date: Column, bounds: dict[str, tuple[str, str]]) -> Column:
    """Name of the split a date lies in (inclusive bounds); NULL outside all of them."""
    out = F.lit(None).cast("string")
    for name, (start, end) in bounds.items():
        out = F.when(date.between(F.lit(start).cast("date"), F.lit(end).cast("date")), name).otherwise(out)
    return out


def walk_forward_splits(
    span: DataFrame, train_years: int = 3, test_years: int = 1, step_years: int = 1
) -> DataFrame:
    """Train and test ranges from a one-row (start, end) frame: the train range starts every
    ``step_years`` and a split is kept while its test range ends by ``end``."""
    train, test, step = 12 * train_years, 12 * test_years, 12 * step_years
    starts = span.select(
        "end", F.posexplode(F.sequence("start", "end", F.expr(f"interval {step} month"))).alias("split_id", "train_start")
    )
    out = starts.select(
        "split_id", "train_start",
        F.add_months("train_start", train).alias("train_end"),
        F.add_months("train_start", train).alias("test_start"),
        F.add_months("train_start", train + test).alias("test_end"),
        "end",
    )
    return out.where(F.col("test_end") <= F.col("end")).drop("end")


def month_windows(span: DataFrame, window_months: int) -> DataFrame:
    """Months of (start, end) stepping by ``window_months``, each with its last day."""
    months = span.select(
        F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"),
                             F.expr(f"interval {window_months} month"))).alias("month_start")
    )
    return months.select(
        "month_start", F.last_day(F.add_months("month_start", window_months - 1)).alias("month_end")
    )
