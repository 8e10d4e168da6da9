"""Scalar column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round for reporting; adding 0.0 turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def at_least(c: Column, low: float) -> Column:
    """Lower clamp that keeps NULL (``greatest`` would replace it)."""
    return F.when(c < low, F.lit(float(low))).otherwise(c)


def clamp(c: Column, low, high) -> Column:
    """Two-sided clamp that keeps NULL."""
    return F.when(c < low, low if isinstance(low, Column) else F.lit(float(low))).when(
        c > high, high if isinstance(high, Column) else F.lit(float(high))
    ).otherwise(c)


def nan_safe(c: Column, default: float = 0.0) -> Column:
    """NaN or NULL becomes the default."""
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(float(default)))


def to_market(ticker: Column) -> Column:
    """Bare six-digit ticker to exchange-suffixed code by its first digit."""
    return (
        F.when(ticker.startswith("6"), F.concat(ticker, F.lit(".SH")))
        .when(ticker.startswith("0") | ticker.startswith("3"), F.concat(ticker, F.lit(".SZ")))
        .when(ticker.startswith("4") | ticker.startswith("8"), F.concat(ticker, F.lit(".BJ")))
        .otherwise(ticker)
    )


def strip_market(code: Column) -> Column:
    return F.split_part(code, F.lit("."), F.lit(1))


def parse_compact_date(s: Column) -> Column:
    """``yyyyMMdd`` text to a date; text that is no date becomes NULL."""
    return F.try_to_timestamp(s.cast("string"), F.lit("yyyyMMdd")).cast("date")


def is_special_treatment(name: Column) -> Column:
    """Names starting with ST or *ST, in any letter case; NULL stays NULL."""
    return name.ilike("st%") | name.ilike("*st%")


def next_run_date(current: Column, frequency: Column) -> Column:
    """Next due date of a savings plan; months keep the day number, clamped to month end."""
    return (
        F.when(frequency == "daily", F.date_add(current, 1))
        .when(frequency == "weekly", F.date_add(current, 7))
        .when(frequency == "biweekly", F.date_add(current, 14))
        .otherwise(F.add_months(current, 1))
    )


def last_weekday(d: Column) -> Column:
    """Roll Saturday and Sunday back to Friday."""
    wd = F.weekday(d)
    return F.when(wd == 5, F.date_sub(d, 1)).when(wd == 6, F.date_sub(d, 2)).otherwise(d)


# Fee schedule of the exchange and broker.
COMMISSION_RATE = 3e-4
MIN_COMMISSION = 5.0
TRANSFER_RATE = 1e-5
STAMP_RATE = 5e-4


def trade_fee(amount: Column, is_sell: Column) -> Column:
    """Commission with a floor, transfer fee, and stamp duty on sells."""
    commission = at_least(amount * COMMISSION_RATE, MIN_COMMISSION)
    stamp = F.when(is_sell, amount * STAMP_RATE).otherwise(F.lit(0.0))
    return commission + amount * TRANSFER_RATE + stamp


def round_lot(value: Column, price: Column, lot: int = 100) -> Column:
    """Whole lots that ``value`` buys at ``price``; NULL or zero price buys none."""
    return F.coalesce(F.floor(F.try_divide(value, price) / F.lit(lot)) * lot, F.lit(0)).cast("bigint")


def completeness_grade(actual: Column, expected: Column) -> Column:
    """ok / warn / bad / empty at 90 %, 50 % and 0 of the expected row count."""
    share = F.try_divide(actual, expected)
    return (
        F.when(F.coalesce(actual, F.lit(0)) == 0, F.lit("empty"))
        .when(expected.isNull() | (expected <= 0), F.lit("ok"))
        .when(share >= 0.9, F.lit("ok"))
        .when(share >= 0.5, F.lit("warn"))
        .otherwise(F.lit("bad"))
    )
