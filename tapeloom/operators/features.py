"""The daily feature set: 37 market features and two news flags per (code, trade_date).

A source declares when its inputs become known. Sources known only after the decision hour
are lagged one row of the code; the others are used as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.rolling import Clock, add, at_least, block_clock, pick, span_alpha, with_ewm

DECISION_HOUR = 22
LIMIT_UP = math.log(1.095)

Stage = Callable[[Clock], dict[str, str]]


@dataclass(frozen=True)
class FeatureSource:
    """A group of features. Stage n of all sources runs as one projection and may read what
    earlier stages of any source made, so few window operators carry all of them.
    ``recursion`` adds columns that need recursive averages, after the stages."""

    name: str
    columns: tuple[str, ...]
    stages: tuple[Stage, ...]
    cutoff_hour: int = 23
    recursion: Callable[[DataFrame], DataFrame] | None = None

    @property
    def shift_rows(self) -> int:
        return 0 if self.cutoff_hour <= DECISION_HOUR else 1


def _price(t: Clock):
    return {
        "ret_1d": f"ln(try_divide(close, {t.lag('close')}))",
        "ret_5d": f"ln(try_divide(close, {t.lag('close', 5)}))",
        "ret_20d": f"ln(try_divide(close, {t.lag('close', 20)}))",
        "range_pct": "try_divide(high - low, close)",
        "gap": f"try_divide(open - {t.lag('close')}, {t.lag('close')})",
    }


def _averages(t: Clock):
    ma5, ma20, ma60 = (t.mean("close", n) for n in (5, 20, 60))
    return {
        "ma5_dev": f"try_divide(close, {ma5}) - 1",
        "ma20_dev": f"try_divide(close, {ma20}) - 1",
        "ma60_dev": f"try_divide(close, {ma60}) - 1",
        "ma_short_long": f"try_divide({ma5}, {ma20}) - 1",
    }


def _volume(t: Clock):
    return {
        "vol_z20": f"try_divide(volume - {t.mean('volume', 20)}, {t.std('volume', 20)})",
        "vol_ratio_5": f"try_divide(volume, {t.mean('volume', 5)})",
    }


def _volume_return(t: Clock):
    return {"vol_ret_corr20": t.corr("ret_1d", "volume", 20)}


def true_range(t: Clock, high: str = "high", low: str = "low", close: str = "close") -> str:
    """Largest of the three spans; the first row has only high - low."""
    before = t.lag(close)
    return f"greatest({high} - {low}, abs({high} - {before}), abs({low} - {before}))"


def gain_loss(t: Clock, close: str) -> dict[str, str]:
    delta = f"({close} - {t.lag(close)})"
    return {"_gain": at_least(delta, 0.0), "_loss": at_least(f"-{delta}", 0.0)}


def stochastic(t: Clock, high: str, low: str, close: str, n: int) -> str:
    lowest, highest = t.min(low, n), t.max(high, n)
    return f"try_divide({close} - {lowest}, {highest} - {lowest}) * 100"


def _technical_inputs(t: Clock):
    return {
        "_rn": t.rn(),
        **gain_loss(t, "close_qfq"),
        "_rsv": stochastic(t, "high_qfq", "low_qfq", "close_qfq", 9),
        "_tr": true_range(t, "high_qfq", "low_qfq", "close_qfq"),
    }


def _technical(df: DataFrame) -> DataFrame:
    """Recursive averages on forward-adjusted prices, two passes for the nested ones."""
    df = with_ewm(df, {
        "_ag": ("_gain", 1 / 12), "_al": ("_loss", 1 / 12),
        "_e12": ("close_qfq", span_alpha(12)), "_e26": ("close_qfq", span_alpha(26)),
        "_k": ("_rsv", 1 / 3), "_atr": ("_tr", 1 / 14),
    }, keep=True)
    df = add(df, {"_dif": "_e12 - _e26"})
    df = with_ewm(df, {"_dea": ("_dif", span_alpha(9)), "_dd": ("_k", 1 / 3)}, keep=True)
    return add(df, {
        "rsi12": f"({relative_strength('_ag', '_al')}) / 100 - 0.5D",
        "macd_hist_norm": "try_divide(2 * (_dif - _dea), close_qfq)",
        "kdj_j": "(3 * _k - 2 * _dd) / 100 - 0.5D",
        "atr14_pct": "try_divide(_atr, close_qfq)",
    })


def relative_strength(gain: str, loss: str) -> str:
    """RSI from averaged gain and loss: 100 when nothing was lost, 50 without information."""
    return (
        f"case when {loss} = 0 and {gain} > 0 then 100.0D "
        f"else coalesce(100 - 100 / (1 + try_divide({gain}, {loss})), 50.0D) end"
    )


def _fundamental(_: Clock):
    return {
        "pe_log": f"log1p({at_least('pe_ttm', 0.0)})",
        "pb_log": f"log1p({at_least('pb', 0.0)})",
        "turnover": "turnover_rate",
        "mv_log": f"ln({at_least('total_mv', 1.0)})",
    }


def _flow(_: Clock):
    sm, md, lg, elg = (f"coalesce(buy_{s}_amount, 0)" for s in ("sm", "md", "lg", "elg"))
    return {
        "inflow_pct": "try_divide(net_mf_amount, total_mv)",
        "big_ratio": f"try_divide({lg} + {elg}, {lg} + {elg} + {sm} + {md})",
    }


def _limit_rows(t: Clock):
    return {"_n": t.rn()}


def _limit_flags(_: Clock):
    return {"_limit": f"coalesce(ret_1d >= {LIMIT_UP!r}D, false)", "_up": "coalesce(ret_1d > 0, false)"}


def _limits(t: Clock):
    hit = "double(_limit)"
    return {
        "days_since_limit": f"{t.rows_since('_limit', '_n', 60)} / 60",
        "n_limits_20d": f"{t.total(hit, 20, 1)} / 20",
        "n_limits_60d": f"{t.total(hit, 60, 1)} / 60",
        "max_ret_20d": t.max("ret_1d", 20, 1),
        "consecutive_up": f"least({t.streak('_up', '_n')}, 10) / 10",
        "is_yi_zi": "double(coalesce(open = high and high = low and low = close, false) and _limit)",
    }


def _self_z(t: Clock, x: str) -> str:
    return f"({x} - {t.mean(x, 60, 20)}) / ({t.std(x, 60, 20)} + 1e-9D)"


def _scale(t: Clock):
    vola = t.std("ret_1d", 60, 20)
    return {
        "circ_mv_log": f"ln({at_least('circ_mv', 1.0)})",
        "circ_mv_z_self60": _self_z(t, "circ_mv"),
        "turnover_ma20": t.mean("turnover_rate", 20, 5),
        "turnover_self_z60": _self_z(t, "turnover_rate"),
        "vola_60d": vola,
        "vola_ratio_20_60": f"{t.std('ret_1d', 20, 5)} / ({vola} + 1e-9D)",
    }


def _price_volume(t: Clock):
    return {
        "price_vol_match5": "ret_5d * tanh(vol_ratio_5 - 1)",
        "inflow_5d_sum": f"try_divide({t.total('net_mf_amount', 5, 2)}, circ_mv)",
        "vol_ret_corr60": t.corr("ret_1d", "volume", 60, 20),
    }


def _news(t: Clock):
    return {
        "news_mentioned_t": "double(_mentioned)",
        "news_mentioned_t1": f"coalesce({t.lag('double(_mentioned)')}, 0)",
    }


def _none(_: Clock):
    return {}


PRICE = FeatureSource("price", ("ret_1d", "ret_5d", "ret_20d", "range_pct", "gap"), (_price,))
AVERAGES = FeatureSource("averages", ("ma5_dev", "ma20_dev", "ma60_dev", "ma_short_long"), (_averages,))
VOLUME = FeatureSource("volume", ("vol_z20", "vol_ratio_5", "vol_ret_corr20"), (_volume, _volume_return))
TECHNICAL = FeatureSource(
    "technical", ("rsi12", "macd_hist_norm", "kdj_j", "atr14_pct"), (_technical_inputs,), recursion=_technical
)
FUNDAMENTAL = FeatureSource("fundamental", ("pe_log", "pb_log", "turnover", "mv_log"), (_fundamental,))
FLOW = FeatureSource("money_flow", ("inflow_pct", "big_ratio"), (_flow,))
LIMITS = FeatureSource(
    "limit_up",
    ("days_since_limit", "n_limits_20d", "n_limits_60d", "max_ret_20d", "consecutive_up", "is_yi_zi"),
    (_limit_rows, _limit_flags, _limits),
)
SCALE = FeatureSource(
    "scale",
    ("circ_mv_log", "circ_mv_z_self60", "turnover_ma20", "turnover_self_z60", "vola_60d", "vola_ratio_20_60"),
    (_none, _scale),
)
PRICE_VOLUME = FeatureSource("price_volume", ("price_vol_match5", "inflow_5d_sum", "vol_ret_corr60"), (_none, _price_volume))
NEWS = FeatureSource("news", ("news_mentioned_t", "news_mentioned_t1"), (_news,), cutoff_hour=20)

MARKET_SOURCES = (PRICE, AVERAGES, VOLUME, TECHNICAL, FUNDAMENTAL, FLOW, LIMITS, SCALE, PRICE_VOLUME)
ALL_SOURCES = (*MARKET_SOURCES, NEWS)
MARKET_FEATURES = tuple(c for s in MARKET_SOURCES for c in s.columns)
FEATURES = tuple(c for s in ALL_SOURCES for c in s.columns)

# What each source reads from the ones before it.
_NEEDS = {"volume": ("price",), "limit_up": ("price",), "scale": ("price",), "price_volume": ("price", "volume")}


def attach_mentions(
    panel: DataFrame, industry: DataFrame, mentions: DataFrame, max_mention_date=None
) -> DataFrame:
    """Add the 0/1 flag ``_mentioned``: the industry of the code was in the news that day.
    Index codes ending in .SI are their own industry."""
    if max_mention_date is not None:
        mentions = mentions.where(F.col("trade_date") <= F.lit(max_mention_date).cast("date"))
    flags = mentions.groupBy(F.col("l1_code").alias("_l1"), "trade_date").agg(
        F.max("mentioned").alias("_mentioned")
    )
    mapped = panel.join(industry.select("code", F.col("l1_code").alias("_l1")), "code", "left")
    mapped = mapped.withColumn("_l1", F.when(F.col("code").endswith(".SI"), F.col("code")).otherwise(F.col("_l1")))
    out = mapped.join(flags, ["_l1", "trade_date"], "left").drop("_l1")
    return out.withColumn("_mentioned", F.coalesce("_mentioned", F.lit(0)))


def _resolve(sources: tuple[FeatureSource, ...]) -> list[FeatureSource]:
    wanted = {s.name for s in sources}
    for s in sources:
        wanted |= set(_NEEDS.get(s.name, ()))
    known = {s.name: s for s in ALL_SOURCES}
    known.update({s.name: s for s in sources})
    return [s for s in known.values() if s.name in wanted]


def compute_features(panel: DataFrame, sources: tuple[FeatureSource, ...] = MARKET_SOURCES) -> DataFrame:
    """All feature columns of the sources, shifted by availability. Every window shares the
    partition by code, so the panel is shuffled once; recursive averages add one local sort,
    which the final shift reuses."""
    t, used, df = Clock(), _resolve(sources), panel
    if any(s.recursion for s in used) and "close_qfq" not in df.columns:
        df = add(df, {f"{c}_qfq": c for c in ("high", "low", "close")})
    for level in range(max(len(s.stages) for s in used)):
        made: dict[str, str] = {}
        for s in used:
            made.update(s.stages[level](t) if level < len(s.stages) else {})
        if made:
            df = add(df, made)
    for s in used:
        df = s.recursion(df) if s.recursion else df
        missing = set(s.columns) - set(df.columns)
        if missing:
            raise ValueError(f"source {s.name} does not produce {sorted(missing)}")
    t = block_clock(df)
    out = {
        c: f"double({t.lag(c, s.shift_rows) if s.shift_rows else c})" for s in sources for c in s.columns
    }
    return pick(df, ["code", "trade_date"], out)


def zscore_by_day(
    feats: DataFrame, columns: tuple[str, ...], clip: float = 5.0, keys: tuple[str, ...] = ("trade_date",)
) -> DataFrame:
    """Cross-sectional z-score per day with the sample deviation, clipped; missing or
    undefined values become 0.

    One pass over the wide rows, grouped by day (one row per code and day), instead of
    computing the features a second time for a statistics join. Pass ``keys`` with the asset
    class in front to score several classes separately.
    """
    day = f"over (partition by {', '.join(keys)})"

    def z(c):
        raw = f"coalesce(try_divide({c} - avg({c}) {day}, stddev_samp({c}) {day}), 0)"
        return f"double(case when {raw} > {clip} then {clip} when {raw} < -{clip} then -{clip} else {raw} end)"

    return pick(feats, [c for c in feats.columns if c not in columns], {c: z(c) for c in columns})
