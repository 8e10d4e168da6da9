"""Signals, portfolios, performance, sectors, ledger and operations queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.columns import r6, round_lot, trade_fee
from tapeloom.operators import calendar as cal
from tapeloom.operators import labels as lab
from tapeloom.operators import ledger as led
from tapeloom.operators import ops
from tapeloom.operators import perf
from tapeloom.operators import sector as sec
from tapeloom.operators import signals as sig
from tapeloom.operators.cube import index_bars
from tapeloom.plans.feature_queries import W, guard, rounded
from tapeloom.plans.registry import query
from tapeloom.session import store_once
from tapeloom.plans.research_queries import GRID, RETURNS, forward_sql, grid, returns, span

# --- performance --------------------------------------------------------------

DAILY = """dr as (select code, trade_date, ln(close / lag(close) over w) as r0 from bars window w as (partition by code order by trade_date)),
 sr as (select code, trade_date, r0 / 50 as r from dr where r0 is not null), sb as (select trade_date, avg(r) as bench from sr group by 1), s as (select * from sr join sb using (trade_date)),
 eq as (select *, exp(sum(ln(1 + r)) over (partition by code order by trade_date)) as equity from s)"""


def strategy_returns(m):
    from tapeloom.functions.rolling import Clock, pick

    r = pick(m.bars, ["code", "trade_date"], {"r": f"ln(try_divide(close, {Clock().lag('close')})) / 50"}).where("r is not null")
    bench = r.groupBy("trade_date").agg(F.avg("r").alias("bench"))
    return r.join(bench, "trade_date")


MEASURES = ["total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "win_rate", "profit_factor", "var_95", "cvar_95", "alpha", "beta", "information_ratio"]


@query("performance", f"""with {DAILY}, dd as (select code, min(least(d, 0)) as max_drawdown from (select code, equity / greatest(max(equity) over (partition by code order by trade_date), 1) - 1 as d from eq) group by 1),
 a as (select code, count(*) as n, exp(sum(ln(1 + r))) - 1 as comp, avg(r) as mu, stddev_samp(r) as sd, sqrt(avg(least(r, 0) * least(r, 0))) as down, count(*) filter (r > 0) / count(*) filter (r <> 0) as win_rate,
  sum(greatest(r, 0)) / sum(greatest(-r, 0)) as profit_factor, covar_samp(r, bench) / var_samp(bench) as beta, avg(bench) as bmu, avg(r - bench) / stddev_samp(r - bench) as information_ratio from s group by 1),
 b as (select *, mu - 1.6448536269514722 * sd as var_95, power(1 + comp, 252.0 / n) - 1 as cagr from a),
 t as (select code, avg(r) as tail from s join b using (code) where r < var_95 group by 1)
 select code, n, round(comp, 6) + 0.0 as total_return, round(cagr, 6) + 0.0 as cagr, round(sd * sqrt(252), 6) as volatility, round(mu / sd * sqrt(252), 6) + 0.0 as sharpe, round(mu / down * sqrt(252), 6) + 0.0 as sortino,
  round(max_drawdown, 6) + 0.0 as max_drawdown, round(cagr / abs(max_drawdown), 6) + 0.0 as calmar, round(win_rate, 6) as win_rate, round(profit_factor, 6) as profit_factor, round(var_95, 6) as var_95,
  round(coalesce(tail, var_95), 6) as cvar_95, round((mu - beta * bmu) * 252, 6) + 0.0 as alpha, round(beta, 6) + 0.0 as beta, round(information_ratio, 6) + 0.0 as information_ratio
 from b join dd using (code) left join t using (code)""", "bars")
def performance(m):
    out = perf.performance(strategy_returns(m), ["code"])
    return out.select("code", "n", *[r6(c).alias(c) for c in MEASURES])


@query("equity_curve", f"with {DAILY} select code, trade_date, round(equity, 6) as equity from eq", "bars")
def equity_curve(m):
    return perf.equity_curve(strategy_returns(m), ["code"]).select("code", "trade_date", r6("equity").alias("equity"))


@query("drawdowns", f"""with {DAILY}, c as (select code, trade_date, equity, sum(r) over (partition by code order by trade_date) as cum from eq),
 g as (select code, cum - max(cum) over (partition by code order by trade_date) as a, equity - max(equity) over (partition by code order by trade_date) as b, equity / greatest(max(equity) over (partition by code order by trade_date), 1) - 1 as c from c)
 select code, round(min(a), 6) + 0.0 as additive, round(min(b), 6) + 0.0 as difference, round(min(least(c, 0)), 6) + 0.0 as ratio from g group by 1""", "bars")
def drawdowns(m):
    from tapeloom.operators.evaluate import additive_drawdown

    r, k = strategy_returns(m), ["code"]
    a = additive_drawdown(r, "r", "trade_date", k).withColumnRenamed("max_drawdown", "additive")
    b = perf.difference_drawdown(r, k).withColumnRenamed("max_drawdown", "difference")
    c = perf.ratio_drawdown(r, k).withColumnRenamed("max_drawdown", "ratio")
    return a.join(b, "code").join(c, "code").select("code", *[r6(x).alias(x) for x in ("additive", "difference", "ratio")])


@query("step_sharpe", f"with {DAILY} select code, round(avg(r) / (stddev_pop(r) + 1e-8) * sqrt(252 / 5.0), 6) + 0.0 as sharpe from s group by 1", "bars")
def step_sharpe(m):
    from tapeloom.operators.evaluate import sharpe

    return strategy_returns(m).groupBy("code").agg(r6(sharpe(F.col("r"), 5)).alias("sharpe"))


@query("composite_scores", f"""with {DAILY}, x as (select code, power(exp(sum(ln(1 + r))), 252.0 / count(*)) - 1 as an, avg(r) / stddev_samp(r) * sqrt(252) as sh, count(*) % 50 as tr from s group by 1),
 dd as (select code, min(least(d, 0)) as dd from (select code, equity / greatest(max(equity) over (partition by code order by trade_date), 1) - 1 as d from eq) group by 1)
 select code, round(case when dd < -0.4 then -1e9 else an / greatest(abs(dd), 0.01) + 0.3 * sh - 0.001 * tr end, 6) + 0.0 as score, round((an - 0.1) / abs(0.1), 6) + 0.0 as excess from x join dd using (code)""", "bars")
def composite_scores(m):
    from tapeloom.operators.evaluate import excess_ratio

    p = perf.performance(strategy_returns(m), ["code"], bench=None)
    score = perf.composite_score(F.col("cagr"), F.col("sharpe"), F.col("max_drawdown"), (F.col("n") % 50))
    return p.select("code", r6(score).alias("score"), r6(excess_ratio(F.col("cagr"), F.lit(0.1))).alias("excess"))


@query("walk_forward_summary", """select count(*) as n_steps, count(auc) as n_with_auc, round(avg(auc), 6) as mean_auc, round(stddev_samp(auc), 6) as std_auc, round(avg(p), 6) as mean_p_at_10, round(stddev_samp(p), 6) as std_p_at_10,
 count(*) filter (failed) as n_failed from (select case when o_orderstatus <> 'P' then o_totalprice / 1e6 end as auc, case when o_orderstatus = 'O' then o_totalprice / 2e6 end as p, o_orderstatus = 'P' as failed from orders)""")
def walk_forward_summary(m):
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    steps = m.table("orders").select(F.when(s != "P", p / 1e6).alias("auc"), F.when(s == "O", p / 2e6).alias("p_at_10"), (s == "P").alias("failed"))
    out = perf.walk_forward_summary(steps)
    return out.select("n_steps", "n_with_auc", "n_failed", *[r6(c).alias(c) for c in ("mean_auc", "std_auc", "mean_p_at_10", "std_p_at_10")])


# --- signals and portfolios -----------------------------------------------------

CROSS = f"""d0 as (select *, ({guard('avg', 'close', 5)}) - ({guard('avg', 'close', 20)}) as d from bars),
 d1 as (select *, last_value(nullif(d, 0) ignore nulls) over (partition by code order by trade_date rows between unbounded preceding and 1 preceding) as was from d0),
 mx as (select *, case when was < 0 and d > 0 then 1 when was > 0 and d < 0 then -1 else 0 end as signal from d1)"""


@query("signal_ma_cross", f"with {CROSS} select code, trade_date, signal from mx", "bars")
def signal_ma_cross(m):
    return sig.ma_cross(m.bars).select("code", "trade_date", "signal")


@query("signal_dual_thrust", f"""with p as (select *, count(*) over v as n, greatest(max(high) over v - min(close) over v, max(close) over v - min(low) over v) as rg from bars
  window v as (partition by code order by trade_date rows between 5 preceding and 1 preceding)),
 q as (select *, case when n >= 5 then open + 0.5 * rg end as upper, case when n >= 5 then open - 0.5 * rg end as lower from p)
 select code, trade_date, upper, lower, case when close > upper then 1 when close < lower then -1 else 0 end as signal from q""", "bars")
def signal_dual_thrust(m):
    return sig.dual_thrust(m.bars).select("code", "trade_date", "upper", "lower", "signal")


@query("signal_weight_targets", """select trade_date, day_idx, token_id, rank, round(weight / sum(weight) over (partition by trade_date), 6) as target from
 (select s.*, c.day_idx, row_number() over (partition by trade_date order by weight desc, token_id) as rank from signals s join calendar c using (trade_date) where c.day_idx % 5 = 0 and c.day_idx + 1 >= 5) where rank <= 4""", "signals calendar")
def signal_weight_targets(m):
    return sig.weight_targets(m.signals, m.calendar, 4, 5).withColumn("target", r6("target"))


FILLS = f"""{CROSS}, e0 as (select *, coalesce(last_value(nullif(signal, 0) ignore nulls) over (partition by code order by trade_date), 0) > 0 as state from mx),
 e1 as (select *, coalesce(lag(state) over w, false) as ison from e0 {W}), e2 as (select *, case when ison and not coalesce(lag(ison) over w, false) then cast(floor(90000 / open / 100) * 100 as bigint) end as lot from e1 {W}),
 e3 as (select *, case when ison then coalesce(last_value(lot ignore nulls) over (partition by code order by trade_date), 0) else 0 end as shares from e2),
 e4 as (select *, coalesce(lag(shares) over w, 0) as prev_shares, lag(close) over w as prev_close from e3 {W}),
 e5 as (select *, shares - prev_shares as traded, abs(shares - prev_shares) * open as amt from e4),
 e6 as (select *, case when traded <> 0 then greatest(amt * 3e-4, 5) + amt * 1e-5 + case when traded < 0 then amt * 5e-4 else 0 end else 0 end as fee,
  prev_shares * (open - coalesce(prev_close, open)) + shares * (close - open) as gross from e5)"""


def fills(m):
    scaled = m.bars.withColumns({c: F.col(c) / 100 for c in ("open", "high", "low", "close")})
    return sig.next_bar_pnl(sig.next_bar_positions(sig.ma_cross(scaled), 1e5), 1e5)


def scaled_sql(body: str, scale: str = "{} / 100") -> str:
    """The same bars with prices in hundredths, as index levels are scaled before trading."""
    prices = ", ".join(f"{scale.format(c)} as {c}" for c in ("open", "high", "low", "close"))
    return f"with sb as (select code, trade_date, {prices}, volume from bars), " + FILLS.replace(" from bars)", " from sb)") + body


@query("next_bar_pnl", scaled_sql(" select code, trade_date, cast(shares as bigint) as shares, cast(traded as bigint) as traded, fee, gross - fee as pnl from e6"), "bars")
def next_bar_pnl(m):
    return fills(m).select("code", "trade_date", "shares", "traded", "fee", "pnl")


TRADES = " select trade_date, code, case when traded > 0 then 'buy' else 'sell' end as action, cast(abs(traded) as double) as size, open as price, amt as value from e6 where traded <> 0"


@query("trade_list", scaled_sql(TRADES), "bars")
def trade_list(m):
    return sig.trade_list(fills(m)).select("trade_date", "code", "action", "size", "price", "value")


@query("buy_turnover", scaled_sql(" select round(sum(amt) filter (traded > 0) / 1e5, 5) as turnover, round(sum(amt) filter (traded > 0) / 1e5 / 7, 5) as turnover_per_year from e6"), "bars")
def buy_turnover(m):
    out = sig.buy_turnover(sig.trade_list(fills(m)), 1e5, 7.0)
    return out.select(r6("turnover", 5).alias("turnover"), r6("turnover_per_year", 5).alias("turnover_per_year"))


@query("flatten_trades", """select cast(l_shipdate as date) as trade_date, concat('P', l_partkey) as code, case when l_returnflag = 'R' then 'sell' else 'buy' end as action, l_quantity as size, l_extendedprice as price, count(*) as n from lineitem group by all""")
def flatten_trades(m):
    li = m.table("lineitem")
    size = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    entry = F.struct(size.alias("size"), F.col("l_extendedprice").alias("price"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("code"), F.col("l_extendedprice").alias("value"))
    nested = li.select(F.create_map(F.col("l_shipdate").cast("date"), F.array(entry)).alias("trades"))
    flat = sig.flatten_trades(nested)
    return flat.groupBy("trade_date", "code", "action", "size", "price").agg(F.count(F.lit(1)).alias("n"))


@query("trade_fees", "select l_returnflag, round(sum(greatest(l_extendedprice * 3e-4, 5) + l_extendedprice * 1e-5 + case when l_returnflag = 'R' then l_extendedprice * 5e-4 else 0 end), 2) as fees, sum(cast(floor(l_extendedprice / l_quantity / 100) * 100 as bigint)) as lots from lineitem group by 1")
def trade_fees(m):
    amount, sell = F.col("l_extendedprice"), F.col("l_returnflag") == "R"
    return m.table("lineitem").groupBy("l_returnflag").agg(
        r6(F.sum(trade_fee(amount, sell)), 2).alias("fees"), F.sum(round_lot(amount, F.col("l_quantity"))).alias("lots"))


PICKS = f"""{GRID}, sc as (select code, trade_date, c.day_idx, volume as score from bars join calendar c using (trade_date)),
 j as (select sc.*, b.open as buy, b.high as bh, s.open as sell from sc left join grid b on b.code = sc.code and b.day_idx = sc.day_idx + 1 left join grid s on s.code = sc.code and s.day_idx = sc.day_idx + 2
   where sc.day_idx < (select max(day_idx) from calendar) - 1),
 k as (select *, row_number() over (partition by day_idx order by score desc, code) as rank from j where buy is not null and sell is not null and buy <> bh),
 h as (select trade_date, day_idx, sum((sell / buy - 1) * (4 - rank) / 6.0) - 0.002 as r, count(*) filter (sell / buy - 1 >= 0.05) as hits, sum(sell / buy - 1) as ret_sum, count(*) as n from k where rank <= 3 group by 1, 2 having count(*) = 3)"""


def hit_days(m):
    scored = cal.with_day_idx(m.bars.select("code", "trade_date", F.col("volume").alias("score")), m.calendar)
    return sig.hit_picks(scored, grid(m), m.calendar)


@query("hit_picks", f"with {PICKS} select trade_date, day_idx, round(r, 6) + 0.0 as r, hits from h", "bars calendar")
def hit_picks(m):
    return hit_days(m).select("trade_date", "day_idx", r6("r").alias("r"), "hits")


@query("hit_picks_summary", f"""with {PICKS}, e as (select *, exp(sum(ln(1 + r)) over (order by trade_date)) as q from h), g as (select q - max(q) over (order by trade_date) as d from e)
 select count(*) as n_days, round(ln(exp(sum(ln(1 + r)))), 5) as log_cum, round(ln(power(1 + avg(r), 252)), 4) as log_annual, round(avg(r) / stddev_pop(r) * sqrt(252), 6) as sharpe, round(avg(case when r > 0 then 1.0 else 0 end), 6) as win_rate,
  round(avg(r), 6) as daily_ret_mean, round(stddev_pop(r), 6) as daily_ret_std, round(avg(hits), 6) as avg_hits_per_day, round(sum(ret_sum) / sum(n), 6) as stock_ret_mean, round(sum(hits) / sum(n), 6) as stock_hit_rate,
  (select round(ln(1 - min(d)), 4) from g) as log_drawdown from h""", "bars calendar")
def hit_picks_summary(m):
    out = sig.hit_picks_summary(hit_days(m))
    return out.select(
        "n_days", r6(F.log1p("cum_return"), 5).alias("log_cum"), r6(F.log1p("annualized_return"), 4).alias("log_annual"), r6(F.log1p(-F.col("max_drawdown")), 4).alias("log_drawdown"),
        *[r6(c).alias(c) for c in ("sharpe", "win_rate", "daily_ret_mean", "daily_ret_std", "avg_hits_per_day", "stock_ret_mean", "stock_hit_rate")])


ATTR = f"""{RETURNS}, {forward_sql(5)}, ri as (select l1_code as code, trade_date, day_idx, avg(ret) as ret from rets join industry using (code) group by 1, 2, 3),
 rm as (select 'M' as code, trade_date, day_idx, avg(ret) as ret from rets group by 2, 3), fi as (with {forward_sql(5, 'ri')} select * from fwd), fm as (with {forward_sql(5, 'rm')} select * from fwd),
 j as (select s.trade_date, c.day_idx, s.token_id, s.weight, f.fwd as r, fi.fwd as ri, fm.fwd as rm from signals s join calendar c using (trade_date) join industry i on i.code = s.token_id
  join fwd f on f.code = s.token_id and f.day_idx = c.day_idx join fi on fi.code = i.l1_code and fi.day_idx = c.day_idx join fm on fm.day_idx = c.day_idx),
 p as (select trade_date, day_idx, sum(weight * (r - ri)) as selection, sum(weight * (ri - rm)) as timing, sum(weight * (r - rm)) as excess from j group by 1, 2),
 sd as (select trade_date, row_number() over (order by trade_date) as k from p), sw as (select sd.k, j.token_id, j.weight from j join sd using (trade_date)),
 tv as (select coalesce(a.k, b.k + 1) as k, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) as turnover from sw a full join sw b on a.token_id = b.token_id and a.k = b.k + 1 group by 1)"""


@query("reward_attribution", f"""with {ATTR} select p.trade_date, day_idx, round(selection, 6) + 0.0 as selection, round(timing, 6) + 0.0 as timing, round(excess, 6) + 0.0 as excess,
 round(timing - c, 6) + 0.0 as reward_industry, round(selection + 0.3 * timing - c, 6) + 0.0 as reward_selection, round(excess - c, 6) + 0.0 as reward_stock
 from p join (select trade_date, 0.001 * case when k = 1 then 0 else coalesce(turnover, 0) end as c from sd left join tv using (k)) using (trade_date)""", "signals calendar industry")
def reward_attribution(m):
    m = m.stored("bars", "calendar", "signals")
    r = store_once(returns(m), "returns")
    fwd = lab.forward_returns(r, 5)
    by_industry = r.join(m.industry.select("code", "l1_code"), "code").groupBy("l1_code", "trade_date", "day_idx").agg(F.avg("ret").alias("ret"))
    ind = lab.forward_returns(by_industry.withColumnRenamed("l1_code", "code"), 5).withColumnRenamed("code", "l1_code")
    mkt = lab.forward_returns(r.groupBy("trade_date", "day_idx").agg(F.avg("ret").alias("ret")).withColumn("code", F.lit("M")), 5)
    weights = cal.with_day_idx(m.signals.withColumnRenamed("token_id", "code"), m.calendar).join(m.industry.select("code", "l1_code"), "code")
    out = sig.attribution(weights, fwd, ind, mkt)
    return out.select("trade_date", "day_idx", *[r6(c).alias(c) for c in ("selection", "timing", "excess", "reward_industry", "reward_selection", "reward_stock")])


PARAMS = [{"short": 3, "long": 10}, {"short": 5, "long": 20}, {"short": 5, "long": 40}]


def evaluated(m):
    m = m.stored()
    # fourth roots tame the wild test prices, so that no portfolio loses more than it has
    scaled = m.bars.withColumns({c: F.sqrt(F.sqrt(c)) for c in ("open", "high", "low", "close")})
    return sig.grid_evaluation(scaled, cal.walk_forward_splits(span(m)), PARAMS, sig.ma_cross_grid)


def _grid_sql() -> str:
    parts = []
    for i, p in enumerate(PARAMS):
        body = scaled_sql(f" select {i} as param, trade_date, avg((gross - fee) / 1e5) as r, count(*) filter (traded <> 0) as trades from e6 group by 2", "sqrt(sqrt({}))")
        body = body.replace("rows between 4 preceding", f"rows between {p['short'] - 1} preceding#").replace("rows between 19 preceding", f"rows between {p['long'] - 1} preceding")
        body = body.replace("preceding#", "preceding").replace(">= 5 then avg(close)", f">= {p['short']} then avg(close)").replace(">= 20 then avg(close)", f">= {p['long']} then avg(close)")
        parts.append(f"({body})")
    return f"""pd as ({' union all '.join(parts)}), sp0 as (select min(trade_date) as s, max(trade_date) as e from calendar), sp as (select cast(i as integer) as split_id, cast(s + to_years(cast(i as integer)) as date) as a,
  cast(s + to_years(cast(i + 3 as integer)) as date) as b, cast(s + to_years(cast(i + 4 as integer)) as date) as c from sp0, (select unnest(range(0, 50)) as i) where s + to_years(cast(i + 4 as integer)) <= e),
 ph as (select split_id, 'train' as phase, a as s, b as e from sp union all select split_id, 'test', b, c from sp), u as (select split_id, phase, pd.* from pd join ph on trade_date >= s and trade_date < e),
 eq as (select *, exp(sum(ln(1 + r)) over (partition by split_id, phase, param order by trade_date)) as q from u),
 dd as (select split_id, phase, param, min(least(d, 0)) as dd from (select *, q / greatest(max(q) over (partition by split_id, phase, param order by trade_date), 1) - 1 as d from eq) group by 1, 2, 3),
 pe as (select split_id, phase, param, count(*) as n, exp(sum(ln(1 + r))) - 1 as tr, power(exp(sum(ln(1 + r))), 252.0 / count(*)) - 1 as an, avg(r) / stddev_samp(r) * sqrt(252) as sh, sum(trades) as trades from u group by 1, 2, 3),
 ge as (select *, case when dd < -0.4 then -1e9 else an / greatest(abs(dd), 0.01) + 0.3 * sh - 0.001 * trades end as score from pe join dd using (split_id, phase, param)),
 bp as (select *, row_number() over (partition by split_id order by score desc, param) as o from ge where phase = 'train'),
 wb as (select b.split_id, b.param, b.score as train_score, t.tr, t.sh, t.dd, t.trades from bp b join ge t on t.split_id = b.split_id and t.param = b.param and t.phase = 'test' where o = 1)"""


GRID_SQL = _grid_sql()


@query("grid_evaluation", f"with {GRID_SQL} select split_id, phase, param, n, round(tr, 6) + 0.0 as total_return, round(sh, 6) + 0.0 as sharpe, round(dd, 6) + 0.0 as max_drawdown, round(score, 5) + 0.0 as score, trades from ge", "bars calendar")
def grid_evaluation(m):
    e = evaluated(m)
    return e.select("split_id", "phase", "param", "n", *[r6(c).alias(c) for c in ("total_return", "sharpe", "max_drawdown")], r6("score", 5).alias("score"), "trades")


@query("walk_forward_best", f"with {GRID_SQL} select split_id, param, trades as oos_trades, round(train_score, 5) + 0.0 as train_score, round(tr, 6) + 0.0 as oos_total_return, round(sh, 6) + 0.0 as oos_sharpe, round(dd, 6) + 0.0 as oos_max_drawdown from wb", "bars calendar")
def walk_forward_best(m):
    out = sig.pick_and_verify(evaluated(m))
    return out.select("split_id", "param", "oos_trades", r6("train_score", 5).alias("train_score"), *[r6(c).alias(c) for c in ("oos_total_return", "oos_sharpe", "oos_max_drawdown")])


@query("walk_forward_stability", f"with {GRID_SQL} select round(avg(sh), 6) + 0.0 as mean, round(stddev_pop(sh), 6) as std, stddev_pop(sh) < 0.5 as stable from wb", "bars calendar")
def walk_forward_stability(m):
    return perf.stability(sig.pick_and_verify(evaluated(m)), "oos_sharpe").select(r6("mean").alias("mean"), r6("std").alias("std"), "stable")


# --- sectors ----------------------------------------------------------------------

SECTOR_GRID = """sectors as (select l1_code as code, trade_date, avg(close) as close from bars join industry using (code) group by 1, 2),
 grid as (select t.code, c.trade_date, c.day_idx, b.close from (select distinct l1_code as code from industry) t cross join calendar c left join sectors b using (code, trade_date))"""

SR = SECTOR_GRID + """, sg as (select code, trade_date, day_idx, last_value(close ignore nulls) over (partition by code order by day_idx) as p from grid),
 sr as (select * from (select code, trade_date, day_idx, p / lag(p) over (partition by code order by day_idx) - 1 as r from sg) where r is not null)"""
SECTOR_VIEWS = "bars calendar industry"


def sector_grid(m):
    """The industries' index bars on every day, from bars that are stored."""
    m = m.stored()
    return cal.dense_grid(index_bars(m.bars, m.industry), m.industry.select(F.col("l1_code").alias("code")), m.calendar)


def sector_returns(m):
    return sec.sector_returns(sector_grid(m))


@query("sector_returns", f"with {SR} select code, trade_date, day_idx, round(r, 6) + 0.0 as r from sr", SECTOR_VIEWS)
def sector_returns_q(m):
    return sector_returns(m).withColumn("r", r6("r"))


SECTORS = [f"R{k}" for k in range(5)]


@query("returns_matrix", f"with {SR} select trade_date, " + ", ".join(f"round(max(r) filter (code = '{c}'), 6) + 0.0 as {c}" for c in SECTORS) + f" from sr where code in {tuple(SECTORS)} group by 1", SECTOR_VIEWS)
def returns_matrix(m):
    wide = sec.returns_matrix(sector_returns(m).where(F.col("code").isin(SECTORS)), SECTORS)
    return wide.select("trade_date", *[r6(c).alias(c) for c in SECTORS])


def corr_sql(lag: int) -> str:
    return f"cm as (select a.code as leader, b.code as follower, corr(a.r, b.r) as corr, count(*) as n from sr a join sr b on b.day_idx = a.day_idx + {lag} group by 1, 2)"


@query("lag_correlation", " union all ".join(f"(with {SR}, {corr_sql(k)} select {k} as lag, leader, follower, round(corr, 6) + 0.0 as corr, n from cm)" for k in (1, 3, 5, 10, 20)), SECTOR_VIEWS)
def lag_correlation(m):
    c = sec.lag_correlation(sector_returns(m), [1, 3, 5, 10, 20])
    return c.select("lag", "leader", "follower", r6("corr").alias("corr"), "n")


FOLLOW = f"{SR}, {corr_sql(5)}, fo as (select leader, follower, corr, row_number() over (partition by leader order by corr desc, follower) as rank from cm where leader <> follower)"


@query("top_followers", f"with {FOLLOW} select leader, follower, rank, round(corr, 6) + 0.0 as corr from fo where rank <= 5", SECTOR_VIEWS)
def top_followers(m):
    return sec.top_followers(sec.lag_correlation(sector_returns(m), [5])).select("leader", "follower", "rank", r6("corr").alias("corr"))


LIFT = f"""{SR}, b as (select code, min(lo) as lo, max(hi) as hi, count(*) filter (r > 0.02) / (any_value(hi) - any_value(lo) + 1) as base from sr, (select min(day_idx) as lo, max(day_idx) as hi from sr) group by 1),
 ev as (select code, day_idx from sr where r > 0.02 and day_idx + 3 <= (select max(day_idx) from sr)),
 lf as (select x.leader, x.follower, coalesce(coalesce(h, 0) / e / nullif(base, 0), 0) as lift from (select a.code as leader, c.code as follower, c.base from b a cross join b c) x
  left join (select code, count(*) as e from ev group by 1) t on t.code = x.leader
  left join (select ev.code as leader, s.code as follower, count(*) as h from ev join sr s on s.day_idx = ev.day_idx + 3 and s.r > 0.02 group by 1, 2) y on y.leader = x.leader and y.follower = x.follower)"""


def lift(m):
    return sec.contagion_lift(store_once(sector_returns(m), "sector_returns"), 0.02, 3)


@query("contagion_lift", f"with {LIFT} select leader, follower, round(lift, 6) + 0.0 as lift from lf", SECTOR_VIEWS)
def contagion_lift(m):
    return lift(m).withColumn("lift", r6("lift"))


@query("strongest_pairs", f"with {LIFT} select leader, follower, round(lift, 6) + 0.0 as lift from lf where leader <> follower order by round(lift, 9) desc, leader, follower limit 10", SECTOR_VIEWS)
def strongest_pairs(m):
    return sec.strongest_pairs(lift(m).withColumn("lift", F.round("lift", 9))).withColumn("lift", r6("lift"))


RELAY = f"""{FOLLOW}, dy as (select code, trade_date, day_idx, ret from (select code, trade_date, day_idx, (close - lag(close, 5) over w) / lag(close, 5) over w as ret from grid window w as (partition by code order by day_idx))
   where ret is not null and day_idx >= 5 and (day_idx + 1) % 5 = 0),
 rk as (select *, row_number() over (partition by day_idx order by ret desc, code) as rank, row_number() over (partition by day_idx order by ret, code) - 1 as pos, count(*) over (partition by day_idx) as n from dy),
 md as (select day_idx, ret as median from rk where pos = n // 2), ld as (select * from rk where rank <= 3),
 cd as (select ld.trade_date, ld.day_idx, f.follower as code, min(ld.rank * 100 + f.rank) as o from ld join (select * from fo where rank <= 5) f on f.leader = ld.code
   where not exists (select 1 from ld x where x.day_idx = ld.day_idx and x.code = f.follower) group by 1, 2, 3),
 ce as (select cd.*, coalesce(d.ret, 0) < md.median as cold from cd join md using (day_idx) left join dy d on d.day_idx = cd.day_idx and d.code = cd.code),
 cf as (select *, bool_or(cold) over (partition by day_idx) as any_cold from ce)"""


@query("sector_relay", f"with {RELAY} select * from (select trade_date, day_idx, code, row_number() over (partition by day_idx order by o) as rank from cf where cold or not any_cold) where rank <= 3", SECTOR_VIEWS)
def sector_relay(m):
    g = store_once(sector_grid(m), "sector_grid")
    follow = sec.top_followers(sec.lag_correlation(sec.sector_returns(g), [5]))
    return sec.relay_targets(g, follow)


# --- ledger -----------------------------------------------------------------------

@query("account_balances", "select account_id, round(sum(amount), 4) as balance, round(coalesce(sum(amount) filter (txn_type in ('deposit', 'withdraw')), 0), 4) as invested from cash_txn group by 1", "cash_txn")
def account_balances(m):
    return led.balances(m.cash_txn).select("account_id", r6("balance", 4).alias("balance"), r6("invested", 4).alias("invested"))


@query("running_balance", "select txn_id, account_id, round(sum(amount) over (partition by account_id order by ts, txn_id), 4) + 0.0 as balance_after from cash_txn", "cash_txn")
def running_balance(m):
    return led.running_balance(m.cash_txn).select("txn_id", "account_id", r6("balance_after", 4).alias("balance_after"))


EXEC = """ex as (select concat('A', l_suppkey) as account_id, concat('N', lpad(cast(l_partkey % 30 as varchar), 2, '0')) as code, l_quantity as shares, l_extendedprice as amount, l_extendedprice * l_tax as fee, l_extendedprice * (1 + l_tax) as total_cost from lineitem),
 pf as (select account_id, code, sum(shares) as shares, sum(amount) / sum(shares) as avg_cost, sum(amount) as total_amount, sum(fee) as total_fee, sum(total_cost) as total_cost from ex group by 1, 2)"""


def executions(m):
    x, t = F.col("l_extendedprice"), F.col("l_tax")
    return m.table("lineitem").select(
        F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("account_id"), F.concat(F.lit("N"), F.lpad((F.col("l_partkey") % 30).cast("string"), 2, "0")).alias("code"),
        F.col("l_quantity").alias("shares"), x.alias("amount"), (x * t).alias("fee"), (x * (1 + t)).alias("total_cost"))


@query("portfolio", f"with {EXEC} select account_id, code, shares, round(avg_cost, 7) as avg_cost, round(total_amount, 2) as total_amount, round(total_fee, 4) as total_fee, round(total_cost, 4) as total_cost from pf")
def portfolio(m):
    p = led.portfolio(executions(m))
    return p.select("account_id", "code", "shares", r6("avg_cost", 7).alias("avg_cost"), r6("total_amount", 2).alias("total_amount"), r6("total_fee", 4).alias("total_fee"), r6("total_cost", 4).alias("total_cost"))


@query("latest_closes", "select code, max_by(close, trade_date) as last_price, max(trade_date) as last_date from bars group by 1", "bars")
def latest_closes(m):
    return led.latest_closes(m.bars)


HOLD = f"{EXEC}, lp as (select code, max_by(close, trade_date) as last_price from bars group by 1), hp as (select pf.*, last_price, shares * coalesce(last_price, 0) as market_value, shares * coalesce(last_price, 0) - total_cost as pnl from pf left join lp using (code))"


@query("holdings_with_prices", f"with {HOLD} select account_id, code, market_value, round(pnl / total_cost, 6) + 0.0 as pnl_pct from hp", "bars")
def holdings_with_prices(m):
    h = led.holdings_with_prices(led.portfolio(executions(m)), led.latest_closes(m.bars))
    return h.select("account_id", "code", "market_value", r6("pnl_pct").alias("pnl_pct"))


@query("account_summary", f"""with {HOLD}, b as (select account_id, sum(amount) as cash, coalesce(sum(amount) filter (txn_type in ('deposit', 'withdraw')), 0) as inv from cash_txn group by 1), h as (select account_id, sum(market_value) as mv, sum(pnl) as fp from hp group by 1)
 select account_id, round(cash, 4) + 0.0 as cash, round(ln(1 + coalesce(mv, 0)), 6) as log_market_value, round((cash + coalesce(mv, 0)) / (1 + abs(cash)), 5) + 0.0 as asset_ratio, round(coalesce(fp, 0) / (1 + coalesce(mv, 0)), 6) + 0.0 as floating_ratio,
  round(case when inv <> 0 then cash + coalesce(mv, 0) - inv else 0 end / (1 + coalesce(mv, 0)), 5) + 0.0 as total_ratio from b left join h using (account_id)""", "bars cash_txn")
def account_summary(m):
    s = led.account_summary(m.cash_txn, executions(m), led.latest_closes(m.bars))
    mv = 1 + F.col("market_value")
    return s.select(
        "account_id", r6("cash", 4).alias("cash"), r6(F.ln(mv)).alias("log_market_value"), r6(F.col("total_asset") / (1 + F.abs("cash")), 5).alias("asset_ratio"),
        r6(F.col("floating_pnl") / mv).alias("floating_ratio"), r6(F.col("total_pnl") / mv, 5).alias("total_ratio"))


@query("listed_codes", "select code, coalesce(name, '') as name, concat_ws(' ', code, name) as label from (select distinct code from bars) left join (select * from stock_lifecycle where code < 'N20') using (code)", "bars stock_lifecycle")
def listed_codes(m):
    return led.listed_codes(m.bars, m.stock_lifecycle.where("code < 'N20'"))


PLANS = """plans as (select concat('P', o_orderkey) as plan_id, concat('A', o_custkey) as account_id, concat('N', lpad(cast(o_orderkey % 25 as varchar), 2, '0')) as code, o_totalprice / 10 as amount_per_run,
  case o_orderkey % 4 when 0 then 'daily' when 1 then 'weekly' when 2 then 'biweekly' else 'monthly' end as frequency, cast(o_orderdate as date) as next_run_date, case when o_orderstatus = 'F' then 'PAUSED' else 'ACTIVE' end as status,
  case when o_orderkey % 3 = 0 then date '2000-02-10' end as end_date from orders)"""


def plans(m):
    k = F.col("o_orderkey")
    return m.table("orders").select(
        F.concat(F.lit("P"), k.cast("string")).alias("plan_id"), F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("account_id"),
        F.concat(F.lit("N"), F.lpad((k % 25).cast("string"), 2, "0")).alias("code"), (F.col("o_totalprice") / 10).alias("amount_per_run"),
        F.when(k % 4 == 0, "daily").when(k % 4 == 1, "weekly").when(k % 4 == 2, "biweekly").otherwise("monthly").alias("frequency"),
        F.col("o_orderdate").cast("date").alias("next_run_date"), F.when(F.col("o_orderstatus") == "F", "PAUSED").otherwise("ACTIVE").alias("status"),
        F.when(k % 3 == 0, F.lit("2000-02-10").cast("date")).alias("end_date"))


@query("due_plans", f"with {PLANS} select plan_id, account_id, next_run_date from plans where status = 'ACTIVE' and next_run_date <= date '2000-01-31'")
def due_plans(m):
    return led.due_plans(plans(m), "2000-01-31").select("plan_id", "account_id", "next_run_date")


@query("execute_due_plans", f"""with recursive {PLANS}, lp as (select code, max_by(close, trade_date) as last_price from bars group by 1), bal as (select account_id, sum(amount) as balance from cash_txn group by 1),
 due as (select p.*, last_price, amount_per_run * 1.001 as cost, row_number() over (partition by p.account_id order by next_run_date, plan_id) as i from plans p join lp using (code) where status = 'ACTIVE' and next_run_date <= date '2000-01-31' and last_price > 0),
 walk as (select account_id, i, plan_id, coalesce(balance, 0) + 1e-6 >= cost as accepted, coalesce(balance, 0) - case when coalesce(balance, 0) + 1e-6 >= cost then cost else 0 end as money from due left join bal using (account_id) where i = 1
  union all select d.account_id, d.i, d.plan_id, w.money + 1e-6 >= d.cost, w.money - case when w.money + 1e-6 >= d.cost then d.cost else 0 end from walk w join due d on d.account_id = w.account_id and d.i = w.i + 1),
 fin as (select d.*, w.accepted, cast(case frequency when 'daily' then date '2000-02-01' when 'weekly' then date '2000-02-07' when 'biweekly' then date '2000-02-14' else date '2000-02-29' end as date) as nxt from due d join walk w using (plan_id))
 select plan_id, account_id, code, accepted, round(case when accepted then amount_per_run / last_price end, 6) as shares, round(case when accepted then cost end, 6) as cost, case when accepted then nxt else next_run_date end as next_run_date,
  case when accepted and end_date is not null and nxt > end_date then 'STOPPED' else status end as status from fin""", "bars cash_txn")
def execute_due_plans(m):
    out = led.execute_due_plans(plans(m), led.latest_closes(m.bars), led.balances(m.cash_txn), "2000-01-31", 0.001)
    return out.withColumns({"shares": r6("shares"), "cost": r6("cost")})


@query("illegal_transitions", """with lg as (select o_custkey as plan_id, o_orderkey as seq, case o_orderstatus when 'O' then 'ACTIVE' when 'P' then 'PAUSED' else 'STOPPED' end as status from orders),
 x as (select *, lag(status) over (partition by plan_id order by seq) as previous from lg) select plan_id, seq, previous, status from x where previous is not null and previous <> status and not (previous = 'ACTIVE' or (previous = 'PAUSED' and status in ('ACTIVE', 'STOPPED')))""")
def illegal_transitions(m):
    s = F.col("o_orderstatus")
    log = m.table("orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("seq"), F.when(s == "O", "ACTIVE").when(s == "P", "PAUSED").otherwise("STOPPED").alias("status"))
    return led.illegal_transitions(log)


# --- operations -------------------------------------------------------------------

STATUS = "case when value < 2 then 'skipped' when event_type = 'error' then 'failed' else 'ok' end"


@query("stage_kpis", f"""select cast(ts as date) as trade_date, round(sum(value), 2) as total_duration_s, count(*) as n_stages, count(*) filter ({STATUS} = 'ok') as n_ok,
 round(coalesce(count(*) filter ({STATUS} = 'ok') / nullif(count(*) filter ({STATUS} <> 'skipped'), 0), 0), 6) as success_rate from events group by 1""")
def stage_kpis(m):
    e = m.table("events")
    status = F.when(F.col("value") < 2, "skipped").when(F.col("event_type") == "error", "failed").otherwise("ok")
    out = ops.stage_kpis(e.select(F.col("ts").cast("date").alias("trade_date"), F.col("value").alias("duration_s"), status.alias("status")))
    return out.withColumns({"total_duration_s": r6("total_duration_s", 2), "success_rate": r6("success_rate")})


@query("stage_ok_counts", "select scope, json_extract_string(tags_json, '$.k') as tag, count(*) as n from counter_event where value >= 5 group by 1, 2", "counter_event")
def stage_ok_counts(m):
    events = m.counter_event.withColumn("name", F.lit("ok")).withColumn("value", (F.col("value") >= 5).cast("double"))
    return ops.ok_counts(events, "k")


@query("rows_gate", "select trade_date, coalesce(n, 0) as n, coalesce(n, 0) >= 24 as ok from (select unnest(generate_series(date '2000-01-03', date '2000-03-27', interval 1 day))::date as trade_date) left join (select trade_date, count(*) as n from bars group by 1) using (trade_date)", "bars")
def rows_gate(m):
    days = m.spark.range(1).select(F.explode(F.sequence(F.lit("2000-01-03").cast("date"), F.lit("2000-03-27").cast("date"))).alias("trade_date"))
    return ops.rows_gate(m.bars, days, 24)


@query("calendar_gate", "select max(trade_date) as last_date, cast(date_diff('day', max(trade_date), date '2001-11-20') as integer) as age_days, date_diff('day', max(trade_date), date '2001-11-20') <= 30 as ok from calendar", "calendar")
def calendar_gate(m):
    return ops.calendar_gate(m.calendar, "2001-11-20")


@query("drift_check", """with r as (select o_orderpriority as trainer, o_orderkey as run_id, o_orderdate as started_at, o_totalprice as bm, case when o_orderkey % 5 = 0 then 'base' when o_orderkey % 5 = 1 then 'now' end as kind from orders where o_orderstatus <> 'P'),
 l as (select trainer, (select bm from r x where x.trainer = t.trainer and kind = 'base' order by started_at desc, run_id desc limit 1) as base, (select bm from r x where x.trainer = t.trainer and kind = 'now' order by started_at desc, run_id desc limit 1) as "now" from (select distinct trainer from r where kind is not null) t)
 select trainer, base, "now", round((base - "now") / base * 100, 6) + 0.0 as drop_pct, (base - "now") / base * 100 > 5 as alarm from l""")
def drift_check(m):
    k = F.col("o_orderkey") % 5
    note = F.when(k == 0, "weekly anchor run").when(k == 1, "daily warm start").otherwise("other")
    runs = m.table("orders").select(
        F.col("o_orderpriority").alias("trainer"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.col("o_totalprice").alias("best_metric"),
        F.when(F.col("o_orderstatus") != "P", "done").otherwise("failed").alias("status"), note.alias("note"))
    return ops.drift(runs).withColumn("drop_pct", r6("drop_pct"))


@query("health", "select event_type as source, count(*) filter (value < 30) as n_ok, count(*) as total, round(avg(value), 6) as avg_latency, max(value) as max_latency from events group by 1")
def health(m):
    e = m.table("events").select(F.col("event_type").alias("source"), (F.col("value") < 30).alias("ok"), F.col("value").alias("latency_ms"))
    return ops.health(e).withColumn("avg_latency", r6("avg_latency"))
