"""Single-factor library. A factor takes bars and returns them with one or more new columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tapeloom.functions.rolling import Clock, add, span_alpha, with_ewm
from tapeloom.operators.features import stochastic, true_range

Factor = Callable[[DataFrame], DataFrame]
REGISTRY: dict[str, Factor] = {}


def factor(name: str):
    def add(fn: Factor) -> Factor:
        if name in REGISTRY:
            raise ValueError(f"factor {name} registered twice")
        REGISTRY[name] = fn
        return fn

    return add


def _change(t: Clock, x: str, n: int) -> str:
    return f"(try_divide({x}, {t.lag(x, n)}) - 1)"


@factor("momentum")
def momentum(df, n: int = 20):
    return add(df, {"momentum": _change(Clock(), "close", n)})


@factor("reversal")
def reversal(df, n: int = 5):
    return add(df, {"reversal": "-" + _change(Clock(), "close", n)})


@factor("volume_momentum")
def volume_momentum(df, n: int = 20):
    t = Clock()
    return add(df, {"volume_momentum": f"{_change(t, 'close', n)} * signum({_change(t, 'volume', n)})"})


@factor("rsi")
def rsi(df, n: int = 14):
    """Wilder RSI; the first change counts as zero, NULL for the first n-1 rows, 100 without losses."""
    t = Clock()
    delta = f"coalesce(close - {t.lag('close')}, 0)"
    df = add(df, {"_up": f"double(greatest({delta}, 0))", "_dn": f"double(greatest(-({delta}), 0))", "_i": t.rn()})
    df = with_ewm(df, {"_au": ("_up", 1 / n), "_ad": ("_dn", 1 / n)})
    value = "case when _ad = 0 then 100 else 100 - 100 / (1 + try_divide(_au, _ad)) end"
    return add(df, {"rsi": f"case when _i >= {n} then {value} end"}).drop("_up", "_dn", "_i", "_au", "_ad")


@factor("ma")
def ma(df, n: int = 20):
    mean = Clock().mean("close", n)
    return add(df, {"ma": f"try_divide(close - {mean}, {mean})"})


@factor("macd")
def macd(df, fast: int = 12, slow: int = 26, signal: int = 9):
    """Line, signal and their difference; each average is NULL until its span is filled."""
    df = add(df, {"_i": Clock().rn()})
    df = with_ewm(df, {"_f": ("close", span_alpha(fast)), "_s": ("close", span_alpha(slow))})
    df = with_ewm(add(df, {"macd_line": f"case when _i >= {slow} then _f - _s end"}), {"_sig": ("macd_line", span_alpha(signal))})
    df = add(df, {"macd_signal": f"case when _i >= {slow + signal - 1} then _sig end"})
    return add(df, {"macd": "macd_line - macd_signal"}).drop("_i", "_f", "_s", "_sig")


@factor("boll")
def boll(df, n: int = 20, width: float = 2.0):
    t = Clock()
    mid, dev = t.mean("close", n), t.std("close", n)
    df = add(df, {"boll_upper": f"{mid} + {width}D * {dev}", "boll_mid": mid, "boll_lower": f"{mid} - {width}D * {dev}"})
    return add(df, {"boll": "try_divide(close - boll_lower, boll_upper - boll_lower)"})


@factor("atr")
def atr(df, n: int = 14):
    """Wilder ATR: 0 before row n, the plain mean of the first n ranges there, then recursive."""
    t = Clock()
    df = add(df, {"_tr": true_range(t), "_i": t.rn()})
    df = add(df, {"_seeded": f"case when _i = {n} then {t.mean('_tr', n, 1)} when _i > {n} then _tr end"})
    df = with_ewm(df, {"_atr": ("_seeded", 1 / n)})
    return add(df, {"atr": "coalesce(_atr, 0)"}).drop("_tr", "_i", "_seeded", "_atr")


@factor("kdj")
def kdj(df, n: int = 9, smooth: int = 3):
    """3K - 2D where D is a plain moving average of K."""
    t = Clock()
    df = add(df, {"_k": stochastic(t, "high", "low", "close", n)})
    return add(df, {"kdj": f"3 * _k - 2 * {t.mean('_k', smooth)}"}).drop("_k")


def _ratio_factor(name: str, direct: str | None, invert: bool, top: str, bottom: str):
    """Value factor chosen by which columns the frame has: the ready-made ratio, else its parts."""

    def fn(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        if direct in have:
            c = f"try_divide(1.0D, {direct})" if invert else direct
        elif {top, bottom} <= have:
            c = f"try_divide({top}, {bottom})"
        else:
            c = "cast(null as double)"
        return add(df, {f"{name}_factor": c})

    return factor(name)(fn)


pe = _ratio_factor("pe", "pe", True, "eps", "close")
pb = _ratio_factor("pb", "pb", True, "bps", "close")
ps = _ratio_factor("ps", "ps", True, "revenue", "market_cap")
dividend_yield = _ratio_factor("dividend_yield", "dividend_yield", False, "dps", "close")
roe = _ratio_factor("roe", "roe", False, "net_profit", "equity")


def add_factors(bars: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        bars = REGISTRY[name](bars)
    return bars
