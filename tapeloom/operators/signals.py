"""Trading signals and vectorised portfolio arithmetic on next-bar fills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import round_lot, trade_fee
from tapeloom.functions.rolling import Clock, add
from tapeloom.operators.calendar import at_offset, with_day_idx

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def strategy(name: str):
    def put(fn):
        if name in REGISTRY:
            raise ValueError(f"strategy {name} registered twice")
        REGISTRY[name] = fn
        return fn

    return put


@strategy("ma_cross")
def ma_cross(bars: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    """signal 1 when the short average crosses above the long one, -1 below, else 0. The side
    before is the last one on which the averages differed."""
    t = Clock()
    return _crossing(add(bars, {"_d": f"{t.mean('close', short)} - {t.mean('close', long)}"}), t)


def _crossing(df: DataFrame, t: Clock) -> DataFrame:
    df = add(df, {"_was": f"last(nullif(_d, 0), true) {t.before}"})
    side = "case when _was < 0 and _d > 0 then 1 when _was > 0 and _d < 0 then -1 else 0 end"
    return add(df, {"signal": side}).drop("_d", "_was")


def ma_cross_grid(bars: DataFrame, params: list[dict]) -> DataFrame:
    """``ma_cross`` for every parameter set at once, ``param`` being its number: a window per distinct length over one
    chain of bars, which is then spelled out once per set."""
    t = Clock()
    lengths = sorted({n for p in params for n in (p["short"], p["long"])})
    df = add(bars, {f"_m{n}": t.mean("close", n) for n in lengths})
    sides = [F.struct(F.lit(i).alias("param"), (F.col(f"_m{p['short']}") - F.col(f"_m{p['long']}")).alias("_d")) for i, p in enumerate(params)]
    df = df.select(*bars.columns, F.explode(F.array(*sides)).alias("_p")).select(*bars.columns, "_p.*")
    return _crossing(df, Clock("code, param"))


@strategy("dual_thrust")
def dual_thrust(bars: DataFrame, lookback: int = 5, k1: float = 0.5, k2: float = 0.5) -> DataFrame:
    """Breakout bands around the open from the range of the bars that end yesterday."""
    t = Clock()
    past = t.over(f"rows between {lookback} preceding and 1 preceding")
    df = add(bars, {
        "_full": f"count(close) {past} >= {lookback}",
        "_range": f"greatest(max(high) {past} - min(close) {past}, max(close) {past} - min(low) {past})",
    })
    df = add(df, {"upper": f"case when _full then open + {k1}D * _range end", "lower": f"case when _full then open - {k2}D * _range end"})
    return add(df, {"signal": "case when close > upper then 1 when close < lower then -1 else 0 end"}).drop("_full", "_range")


def weight_targets(signals: DataFrame, calendar: DataFrame, k: int = 10, period: int = 5) -> DataFrame:
    """On every ``period``-th bar (from bar ``period`` on) the k largest weights, rescaled to 1."""
    df = with_day_idx(signals, calendar).where((F.col("day_idx") % period == 0) & (F.col("day_idx") + 1 >= period))
    w = Window.partitionBy("trade_date").orderBy(F.col("weight").desc(), "token_id")
    top = df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    share = F.try_divide(F.col("weight"), F.sum("weight").over(Window.partitionBy("trade_date")))
    return top.select("trade_date", "day_idx", "token_id", "rank", share.alias("target"))


def next_bar_positions(signals: DataFrame, capital: float, fraction: float = 0.9, lot: int = 100, keys: str = "code") -> DataFrame:
    """Shares held after each bar's open: a signal acts at the next bar's open, buys whole lots
    and holds them until the opposite signal."""
    t = Clock(keys)
    df = add(signals, {"_state": f"coalesce(last(case when signal <> 0 then signal end, true) {t.so_far}, 0) > 0"})
    df = add(df, {"_on": f"coalesce({t.lag('_state')}, false)"})
    df = add(df, {"_enter": f"_on and not coalesce({t.lag('_on')}, false)"})
    df = df.withColumn("_lot", F.when(F.col("_enter"), round_lot(F.lit(capital * fraction), F.col("open"), lot)))
    df = add(df, {"shares": f"case when _on then coalesce(last(_lot, true) {t.so_far}, 0) else 0 end"})
    return add(df, {"prev_shares": f"coalesce({t.lag('shares')}, 0)", "prev_close": t.lag("close")}).drop("_state", "_on", "_enter", "_lot")


def next_bar_pnl(positions: DataFrame, capital: float) -> DataFrame:
    """Daily profit per code: overnight move on the old position, intraday move on the new one,
    minus fees; ``r`` is over the capital."""
    traded = F.col("shares") - F.col("prev_shares")
    amount = F.abs(traded) * F.col("open")
    fee = F.when(traded != 0, trade_fee(amount, traded < 0)).otherwise(0.0)
    gross = F.col("prev_shares") * (F.col("open") - F.coalesce("prev_close", "open")) + F.col("shares") * (F.col("close") - F.col("open"))
    return positions.select(
        *(c for c in ("param",) if c in positions.columns), "code", "trade_date", "shares", traded.alias("traded"), F.col("open").alias("price"), fee.alias("fee"),
        (gross - fee).alias("pnl"), ((gross - fee) / capital).alias("r"),
    )


def trade_list(pnl: DataFrame) -> DataFrame:
    t = F.col("traded")
    return pnl.where(t != 0).select(
        "trade_date", "code", F.when(t > 0, "buy").otherwise("sell").alias("action"), F.abs(t).cast("double").alias("size"),
        "price", (F.abs(t) * F.col("price")).alias("value"))


def flatten_trades(raw: DataFrame) -> DataFrame:
    """Rows of (trades: map<date, array<struct<size, price, code, value>>>) to one row per trade."""
    days = raw.select(F.explode("trades").alias("trade_date", "items")).select("trade_date", F.explode("items").alias("t"))
    return days.select(
        "trade_date", F.col("t.code").alias("code"), F.when(F.col("t.size") > 0, "buy").otherwise("sell").alias("action"),
        F.abs("t.size").alias("size"), F.col("t.price").alias("price"), F.col("t.value").alias("value"))


def buy_turnover(trades: DataFrame, capital: float, years: float) -> DataFrame:
    bought = F.coalesce(F.sum(F.when(F.col("action") == "buy", F.col("value"))), F.lit(0.0)) / capital
    return trades.agg(bought.alias("turnover"), (bought / years).alias("turnover_per_year"))


def hit_picks(
    scored: DataFrame, grid: DataFrame, calendar: DataFrame, k: int = 3, sub_weights: tuple[float, ...] = (3, 2, 1),
    cost: float = 0.002, hit: float = 0.05, peek: bool = True,
) -> DataFrame:
    """Daily return of buying the k best scores at the next open and selling one day later.

    ``peek`` ranks only stocks that turn out tradable the next day; without it the ranking is
    made first and untradable picks earn nothing. Days with fewer than k candidates are skipped.
    """
    right = grid.select("code", "day_idx", "open", "high")
    df = at_offset(scored, right, 1, {"open": "buy", "high": "buy_high"})
    df = at_offset(df, right, 2, {"open": "sell"})
    last = calendar.select(F.max("day_idx").alias("m")).scalar()
    ok = F.col("buy").isNotNull() & F.col("sell").isNotNull() & (F.col("buy") != F.col("buy_high"))
    df = df.where(F.col("day_idx") < last - 1).withColumn("ok", F.coalesce(ok, F.lit(False)))
    pool = df.where("ok") if peek else df
    w = Window.partitionBy("day_idx").orderBy(F.col("score").desc(), "code")
    top = pool.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    total = float(sum(sub_weights[:k]))
    share = F.element_at(F.array(*[F.lit(x / total) for x in sub_weights[:k]]), F.col("rank").cast("int"))
    ret = F.when(F.col("ok"), F.try_divide(F.col("sell"), F.col("buy")) - 1).otherwise(0.0)
    per = top.select("trade_date", "day_idx", ret.alias("ret"), share.alias("share")).groupBy("trade_date", "day_idx").agg(
        (F.sum(F.col("ret") * F.col("share")) - cost).alias("r"), F.count_if(F.col("ret") >= hit).alias("hits"),
        F.sum("ret").alias("ret_sum"), F.count(F.lit(1)).alias("n"))
    return per.where(F.col("n") == k)


def hit_picks_summary(days: DataFrame) -> DataFrame:
    from tapeloom.operators.perf import difference_drawdown

    one = days.withColumn("_k", F.lit(1))
    m, s = F.avg("r"), F.stddev_pop("r")
    stats = one.groupBy("_k").agg(
        F.count(F.lit(1)).alias("n_days"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("cum_return"),
        (F.pow(1 + m, 252) - 1).alias("annualized_return"), F.coalesce(F.try_divide(m, s), F.lit(0.0)).alias("_sr"),
        F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win_rate"), m.alias("daily_ret_mean"), s.alias("daily_ret_std"),
        F.avg("hits").alias("avg_hits_per_day"), (F.sum("ret_sum") / F.sum("n")).alias("stock_ret_mean"),
        (F.sum("hits") / F.sum("n")).alias("stock_hit_rate"))
    out = stats.join(difference_drawdown(one, ["_k"]), "_k")
    return out.withColumn("sharpe", F.col("_sr") * F.sqrt(F.lit(252.0))).drop("_k", "_sr")


def attribution(weights: DataFrame, fwd: DataFrame, industry_fwd: DataFrame, market_fwd: DataFrame, penalty: float = 0.001,
                timing: float = 0.3) -> DataFrame:
    """Daily reward parts of a stock weight table: selection against the industry, timing of the
    industry against the market, both against the market, and the turnover charge.

    ``weights`` has (day_idx, code, l1_code, weight); the forward tables carry ``fwd``.
    """
    from tapeloom.operators.evaluate import day_turnover

    df = (weights.join(fwd.select("code", "day_idx", F.col("fwd").alias("r")), ["code", "day_idx"])
          .join(industry_fwd.select("l1_code", "day_idx", F.col("fwd").alias("ri")), ["l1_code", "day_idx"])
          .join(market_fwd.select("day_idx", F.col("fwd").alias("rm")), "day_idx"))
    w = F.col("weight")
    per = df.groupBy("trade_date", "day_idx").agg(
        F.sum(w * (F.col("r") - F.col("ri"))).alias("selection"), F.sum(w * (F.col("ri") - F.col("rm"))).alias("timing"),
        F.sum(w * (F.col("r") - F.col("rm"))).alias("excess"))
    used = df.select("trade_date", F.col("code").alias("token_id"), "weight")
    turn = day_turnover(used, used.select("trade_date").distinct())
    out = per.join(turn, "trade_date", "left").withColumn("charge", penalty * F.coalesce("turnover", F.lit(0.0)))
    return out.select(
        "trade_date", "day_idx", "selection", "timing", "excess", "charge",
        (F.col("timing") - F.col("charge")).alias("reward_industry"),
        (F.col("selection") + timing * F.col("timing") - F.col("charge")).alias("reward_selection"),
        (F.col("excess") - F.col("charge")).alias("reward_stock"))


def grid_evaluation(bars: DataFrame, splits: DataFrame, params: list[dict], make: Callable[[DataFrame, list[dict]], DataFrame], capital: float = 1e5) -> DataFrame:
    """Every parameter set on every train and test range: (split_id, phase, param, measures, score). ``make`` gives the
    signals of all sets, a row per (param, code, trade_date), so the bars are read once for any number of sets."""
    from tapeloom.operators.perf import composite_score, performance

    daily = next_bar_pnl(next_bar_positions(make(bars, params), capital, keys="code, param"), capital)
    # all codes of a day form one portfolio; a day spells out the splits it belongs to
    per_day = daily.groupBy("param", "trade_date").agg(F.avg("r").alias("r"), F.count_if(F.col("traded") != 0).alias("trades"))
    phases = splits.select("split_id", F.explode(F.array(
        F.struct(F.lit("train").alias("phase"), F.col("train_start").alias("s"), F.col("train_end").alias("e")),
        F.struct(F.lit("test").alias("phase"), F.col("test_start").alias("s"), F.col("test_end").alias("e")))).alias("p")
    ).select("split_id", "p.*")
    months = phases.withColumn("_m", F.explode(F.sequence(F.trunc("s", "month"), F.trunc("e", "month"), F.expr("interval 1 month"))))
    used = per_day.withColumn("_m", F.trunc("trade_date", "month")).join(months, "_m").where(
        (F.col("trade_date") >= F.col("s")) & (F.col("trade_date") < F.col("e"))).drop("_m", "s", "e")
    keys = ["split_id", "phase", "param"]
    perf = performance(used, keys, bench=None)
    n = used.groupBy(*keys).agg(F.sum("trades").alias("trades"))
    out = perf.join(n, keys)
    return out.withColumn("score", composite_score(F.col("cagr"), F.col("sharpe"), F.col("max_drawdown"), F.col("trades")))


def pick_and_verify(evaluated: DataFrame) -> DataFrame:
    """The best parameter set per split on the train range and its measures on the test range."""
    best = evaluated.where("phase = 'train'").groupBy("split_id").agg(
        F.max_by("param", F.struct("score", -F.col("param"))).alias("param"), F.max("score").alias("train_score"))
    test = evaluated.where("phase = 'test'").select(
        "split_id", "param", F.col("total_return").alias("oos_total_return"), F.coalesce("sharpe", F.lit(0.0)).alias("oos_sharpe"),
        F.coalesce("max_drawdown", F.lit(0.0)).alias("oos_max_drawdown"), F.col("trades").alias("oos_trades"))
    return best.join(test, ["split_id", "param"])
