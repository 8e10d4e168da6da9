"""Trades to bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def week_start(ts: Column) -> Column:
    """Monday of the week of a date."""
    return F.trunc(ts.cast("date"), "week")


def trade_sequence(ts: str, major: list[tuple[str, int]], minor: list[tuple[str, int]]) -> str:
    """One sortable number from the day inside the week and lists of (id column, digits).

    The major ids are packed into a long, the minor ids only break ties behind it. A
    fixed-width decimal keeps ``min_by``/``max_by`` in the hash aggregate; a struct key would
    force a sort of all trades before the partial aggregation.
    """
    high, width = f"bigint(weekday(date({ts})))", 1
    for name, digits in major:
        high, width = f"({high} * {10 ** digits}L + {name})", width + digits
    low, tail = "0", 0
    for name, digits in minor:
        tail += digits
        low = f"decimal({name})" if low == "0" else f"{low} * {10 ** digits} + {name}"
    if width > 18 or width + tail > 38:
        raise ValueError("ids need more digits than a decimal key holds")
    return (
        f"cast(cast({high} as decimal({width},0)) * cast('1e{tail}' as decimal({tail + 1},0)) "
        f"+ cast({low} as decimal({tail},0)) as decimal(38,0))"
    )


def bars_from_trades(
    trades: DataFrame,
    code: Column,
    period: Column,
    price: Column,
    quantity: Column,
    amount: Column,
    sequence: Column,
    more: dict[str, Column] | None = None,
) -> DataFrame:
    """OHLCV bars in a single hash aggregate with map-side combine, safe for hot codes.
    ``more`` adds sums (NULL terms are left out) to the same pass."""
    more = more or {}
    flat = trades.select(
        code.alias("code"), period.alias("trade_date"), price.alias("_px"),
        quantity.alias("_qty"), amount.alias("_amt"), sequence.alias("_seq"),
        *[c.alias(n) for n, c in more.items()],
    )
    return flat.groupBy("code", "trade_date").agg(
        F.min_by("_px", "_seq").alias("open"),
        F.max("_px").alias("high"),
        F.min("_px").alias("low"),
        F.max_by("_px", "_seq").alias("close"),
        F.sum("_qty").alias("volume"),
        F.round(F.sum("_amt"), 2).alias("amount"),
        *[F.round(F.sum(n), 2).alias(n) for n in more],
    )
