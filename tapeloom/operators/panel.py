"""Panel assembly and price adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.rolling import Clock, add

PRICES = ("open", "high", "low", "close")
KEY = ["code", "trade_date"]

BASIC = ("pe_ttm", "pb", "turnover_rate", "total_mv", "circ_mv")
FLOW = ("buy_sm_amount", "buy_md_amount", "buy_lg_amount", "buy_elg_amount", "net_mf_amount")


def build_panel(
    raw: DataFrame, basic: DataFrame, flow: DataFrame, factors: DataFrame, codes: list[str] | None = None,
    start=None, end=None,
) -> DataFrame:
    """Daily bars left-joined with fundamentals, money flow and factors on (code, trade_date).

    All four tables are keyed alike, so one shuffle per input serves the three joins.
    """
    from tapeloom.operators.calendar import inclusive

    def narrow(df, cols):
        df = inclusive(df, start, end)
        if codes is not None:
            df = df.where(F.col("code").isin(codes))
        return df.select(*KEY, *cols)

    bars = narrow(raw, [*PRICES, "volume", "amount"])
    return (
        bars.join(narrow(basic, BASIC), KEY, "left")
        .join(narrow(flow, FLOW), KEY, "left")
        .join(narrow(factors, ["adj_factor"]), KEY, "left")
    )


def _factor_ratio(f: Column, anchor: Column) -> Column:
    return F.coalesce(F.try_divide(f, anchor), F.lit(1.0))


def attach_forward_adjusted(panel: DataFrame) -> DataFrame:
    """Add ``*_qfq`` prices: price times factor over the code's latest known factor; a missing
    factor leaves the price as it is."""
    t = Clock()
    latest = f"last(adj_factor, true) {t.whole}"
    panel = add(panel, {"_ratio": f"coalesce(try_divide(adj_factor, {latest}), 1)"})
    return add(panel, {f"{c}_qfq": f"{c} * _ratio" for c in PRICES}).drop("_ratio")


def adjust_prices(
    raw: DataFrame, factors: DataFrame, mode: str, keep_unmatched: bool = True, anchor_date=None
) -> DataFrame:
    """Adjusted prices over the requested rows.

    ``mode`` is "qfq" (over the latest factor) or "hfq" (over the earliest); anything else
    returns the prices unchanged. ``keep_unmatched=False`` drops dates without a factor row.
    ``anchor_date`` fixes the latest factor's date so that results do not depend on the window.
    """
    if mode not in ("qfq", "hfq"):
        return raw
    df = raw.join(factors.select(*KEY, "adj_factor"), KEY, "left" if keep_unmatched else "inner")
    f = F.col("adj_factor")
    if anchor_date is not None:
        f = F.when(F.col("trade_date") <= F.lit(anchor_date).cast("date"), f)
    whole = Window.partitionBy("code").orderBy("trade_date").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    pick = F.last if mode == "qfq" else F.first
    df = df.withColumn("_ratio", _factor_ratio(F.col("adj_factor"), pick(f, ignorenulls=True).over(whole)))
    return df.withColumns({c: F.col(c) * F.col("_ratio") for c in PRICES}).drop("_ratio", "adj_factor")


def index_as_panel(index_bars: DataFrame, panel_columns: list[str]) -> DataFrame:
    """Index bars in panel shape; every column an index lacks is NULL."""
    have = set(index_bars.columns)
    return index_bars.select(
        *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in panel_columns]
    )


def market_returns(index_bars: DataFrame, code: str) -> DataFrame:
    """Daily log return of one index, first day dropped."""
    w = Window.partitionBy("code").orderBy("trade_date")
    r = F.ln(F.try_divide(F.col("close"), F.lag("close").over(w)))
    one = index_bars.where(F.col("code") == code).select("code", "trade_date", r.alias("ret"), F.row_number().over(w).alias("_n"))
    return one.where(F.col("_n") > 1).select("trade_date", "ret")


def as_of(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str,
          values: list[str], strict: bool = False, horizon: int | None = None) -> DataFrame:
    """Point-in-time join: the latest ``right`` row of the key dated on or before (or, with
    ``strict``, before) each left date.

    Both sides are stacked into one timeline per key and the last seen right row is carried
    forward, so no (left, right) pairs are formed.
    """
    payload = F.struct(F.col(right_date).alias("_at"), *values)
    timeline = left.select(key, F.col(left_date).alias("_t"), F.lit(0 if strict else 1).alias("_side"),
                           F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"))
    facts = right.select(key, F.col(right_date).alias("_t"), F.lit(1 if strict else 0).alias("_side"),
                         F.lit(None).alias("_left"), payload.alias("_right"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = timeline.unionByName(facts).withColumn("_seen", F.last("_right", ignorenulls=True).over(w))
    out = both.where(F.col("_left").isNotNull())
    return out.select("_left.*", *[F.col(f"_seen.{v}").alias(v) for v in values])
