"""Chart indicators: contemporaneous unless marked forward only; one switch lags them all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.rolling import Clock, add, pick, span_alpha, with_ewm
from tapeloom.operators.features import gain_loss, stochastic, true_range


@dataclass(frozen=True)
class Indicator:
    name: str
    outputs: tuple[str, ...]
    compute: Callable[[DataFrame, Clock], DataFrame]
    subplot: bool = False
    forward_only: bool = False


def _ma(n: int):
    return lambda df, t: add(df, {f"ma{n}": t.mean("close", n)})


def _ma20_prev(df, t):
    df = add(df, {"_ma20": t.mean("close", 20)})
    return add(df, {"ma20_prev": t.lag("_ma20")}).drop("_ma20")


def ema(n: int):
    return lambda df, t: with_ewm(df, {f"ema{n}": ("close", span_alpha(n))})


def _macd(df, t):
    df = with_ewm(df, {"_fast": ("close", span_alpha(12)), "_slow": ("close", span_alpha(26))})
    df = with_ewm(add(df, {"dif": "_fast - _slow"}), {"dea": ("dif", span_alpha(9))})
    return add(df, {"hist": "2 * (dif - dea)"}).drop("_fast", "_slow")


def rsi(n: int):
    def compute(df, t):
        df = with_ewm(add(df, gain_loss(t, "close")), {"_ag": ("_gain", 1 / n), "_al": ("_loss", 1 / n)})
        return add(df, {f"rsi{n}": "100 - 100 / (1 + try_divide(_ag, _al))"}).drop("_gain", "_loss", "_ag", "_al")

    return compute


def _kdj(df, t):
    df = add(df, {"_rsv": stochastic(t, "high", "low", "close", 9)})
    df = with_ewm(with_ewm(df, {"k": ("_rsv", 1 / 3)}), {"d": ("k", 1 / 3)})
    return add(df, {"j": "3 * k - 2 * d"}).drop("_rsv")


def _boll(df, t):
    mid, dev = t.mean("close", 20), t.std("close", 20)
    return add(df, {"boll_up": f"{mid} + 2 * {dev}", "boll_mid": mid, "boll_dn": f"{mid} - 2 * {dev}"})


def _atr(df, t):
    return with_ewm(add(df, {"_tr": true_range(t)}), {"atr14": ("_tr", 1 / 14)}).drop("_tr")


REGISTRY: dict[str, Indicator] = {
    i.name: i
    for i in (
        Indicator("MA5", ("ma5",), _ma(5)),
        Indicator("MA20", ("ma20",), _ma(20)),
        Indicator("MA60", ("ma60",), _ma(60)),
        Indicator("MA20_prev", ("ma20_prev",), _ma20_prev, forward_only=True),
        Indicator("EMA12", ("ema12",), ema(12)),
        Indicator("MACD", ("dif", "dea", "hist"), _macd, subplot=True),
        Indicator("RSI14", ("rsi14",), rsi(14), subplot=True),
        Indicator("KDJ", ("k", "d", "j"), _kdj, subplot=True),
        Indicator("BOLL", ("boll_up", "boll_mid", "boll_dn"), _boll),
        Indicator("ATR14", ("atr14",), _atr, subplot=True),
        Indicator("VOL", ("vol",), lambda df, t: add(df, {"vol": "volume"}), subplot=True),
    )
}


def add_indicators(bars: DataFrame, names: list[str], shift: bool = False) -> DataFrame:
    """Add the named indicators; with ``shift`` every one of them moves one row later."""
    t = Clock()
    df, added = add(bars, {"_rn": t.rn()}), []
    for name in names:
        spec = REGISTRY[name]
        df = spec.compute(df, t)
        added += spec.outputs
    if shift:
        return pick(df, bars.columns, {c: t.lag(c) for c in added})
    return df.drop("_rn")


PERIODS = ("D", "W", "M", "Y")


def period_end(d: Column, period: str) -> Column:
    """Label of the calendar period: Friday of the week, or last day of month or year."""
    if period == "D":
        return d
    if period == "W":
        return F.next_day(F.date_sub(d, 1), "FRI")
    if period == "M":
        return F.last_day(d)
    if period == "Y":
        return F.make_date(F.year(d), F.lit(12), F.lit(31))
    raise ValueError(f"unknown period {period!r}")


def resample(bars: DataFrame, period: str) -> DataFrame:
    """Longer bars; a period without an opening price is dropped."""
    d = F.col("trade_date")

    def at(c, pick):
        return pick(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), d))

    out = bars.groupBy("code", period_end(d, period).alias("period_end")).agg(
        at("open", F.min_by).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        at("close", F.max_by).alias("close"), F.sum("volume").alias("volume"),
    )
    return out.where(F.col("open").isNotNull())
