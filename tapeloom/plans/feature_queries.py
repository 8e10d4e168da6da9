"""Feature, indicator and factor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.rolling import pick
from tapeloom.operators import factors as fac
from tapeloom.operators import features as feat
from tapeloom.operators import indicators as ind
from tapeloom.operators import news
from tapeloom.operators.panel import attach_forward_adjusted
from tapeloom.plans.dictionary import ENTRIES, KEYWORD_SQL
from tapeloom.plans.registry import query

W = "window w as (partition by code order by trade_date)"


def over(n: int) -> str:
    return f"over (partition by code order by trade_date rows between {n - 1} preceding and current row)"


def guard(agg: str, arg: str, n: int, need: int | None = None) -> str:
    need = n if need is None else need
    return f"case when count({arg}) {over(n)} >= {need} then {agg}({arg}) {over(n)} end"


def ewm(x: str, alpha: str) -> str:
    """Recursive mean of a column without inner gaps."""
    upto = "over (partition by code order by trade_date rows unbounded preceding)"
    return (
        f"list_reduce(list({x}) filter ({x} is not null) {upto}, "
        f"lambda p, q: p * (1.0 - {alpha}) + q * ({alpha}))"
    )


# Price-sized columns are reported with fewer digits than ratios.
COARSE = {"boll_up", "boll_mid", "boll_dn", "boll_upper", "boll_lower", "ma5", "ma20", "ma60", "ma20_prev",
          "ema12", "dif", "dea", "hist", "atr14", "macd_line", "macd_signal", "macd", "atr"}


def digits(c: str) -> int:
    return 3 if c in COARSE else 6


def rounded(df, cols, date="trade_date", places=lambda c: 6):
    """Report columns rounded; adding 0.0 turns -0.0 into 0.0."""
    return pick(df, ["code", date], {c: f"round({c}, {places(c)}) + 0.0D" for c in cols})


def shown(cols, lag: bool = True, src: str = "f") -> str:
    body = ", ".join(
        f"round({'lag(' + c + ') over w' if lag else c}, {digits(c)}) + 0.0 as {c}" for c in cols
    )
    return f"select code, trade_date, {body} from {src} {W}"


RET = f"r as (select *, ln(close / lag(close) over w) as ret_1d from panel {W})"

PRICE = f"""f as (select code, trade_date, ln(close / lag(close) over w) as ret_1d,
  ln(close / lag(close, 5) over w) as ret_5d, ln(close / lag(close, 20) over w) as ret_20d,
  (high - low) / close as range_pct, (open - lag(close) over w) / lag(close) over w as gap from panel {W})"""

AVERAGES = f"""f as (select code, trade_date, close / ({guard('avg', 'close', 5)}) - 1 as ma5_dev,
  close / ({guard('avg', 'close', 20)}) - 1 as ma20_dev, close / ({guard('avg', 'close', 60)}) - 1 as ma60_dev,
  ({guard('avg', 'close', 5)}) / ({guard('avg', 'close', 20)}) - 1 as ma_short_long from panel)"""

VOLUME = f"""{RET}, f as (select code, trade_date,
  (volume - ({guard('avg', 'volume', 20)})) / nullif({guard('stddev_pop', 'volume', 20)}, 0) as vol_z20,
  volume / ({guard('avg', 'volume', 5)}) as vol_ratio_5,
  case when count(ret_1d) {over(20)} >= 20 then corr(ret_1d, volume) {over(20)} end as vol_ret_corr20 from r)"""

TECHNICAL = f"""q0 as (select *, coalesce(adj_factor / last_value(adj_factor ignore nulls) over (partition by code
    order by trade_date rows between unbounded preceding and unbounded following), 1.0) as ratio from panel),
q as (select code, trade_date, close * ratio as c, high * ratio as h, low * ratio as l from q0),
t1 as (select *, c - lag(c) over w as delta, greatest(h - l, abs(h - lag(c) over w), abs(l - lag(c) over w)) as tr,
  (c - ({guard('min', 'l', 9)})) / nullif(({guard('max', 'h', 9)}) - ({guard('min', 'l', 9)}), 0) * 100 as rsv from q {W}),
t2 as (select *, case when delta > 0 then delta when delta is not null then 0.0 end as gain,
  case when delta < 0 then -delta when delta is not null then 0.0 end as loss from t1),
t3 as (select *, {ewm('gain', '1.0/12')} as ag, {ewm('loss', '1.0/12')} as al, {ewm('c', '2.0/13')} as e12,
  {ewm('c', '2.0/27')} as e26, {ewm('rsv', '1.0/3')} as k, {ewm('tr', '1.0/14')} as atr from t2),
t4 as (select *, e12 - e26 as dif from t3),
t5 as (select *, {ewm('dif', '2.0/10')} as dea, {ewm('k', '1.0/3')} as d from t4),
f as (select code, trade_date,
  (case when al = 0 and ag > 0 then 100 when al = 0 or al is null then 50 else 100 - 100 / (1 + ag / al) end) / 100 - 0.5 as rsi12,
  2 * (dif - dea) / c as macd_hist_norm, (3 * k - 2 * d) / 100 - 0.5 as kdj_j, atr / c as atr14_pct from t5)"""

FUNDAMENTAL = """f as (select code, trade_date, ln(1 + case when pe_ttm < 0 then 0 else pe_ttm end) as pe_log,
  ln(1 + case when pb < 0 then 0 else pb end) as pb_log, turnover_rate as turnover,
  ln(case when total_mv < 1 then 1 else total_mv end) as mv_log from panel)"""

FLOW = """f as (select code, trade_date, net_mf_amount / nullif(total_mv, 0) as inflow_pct,
  (coalesce(buy_lg_amount, 0) + coalesce(buy_elg_amount, 0)) / nullif(coalesce(buy_lg_amount, 0) + coalesce(buy_elg_amount, 0)
   + coalesce(buy_sm_amount, 0) + coalesce(buy_md_amount, 0), 0) as big_ratio from panel)"""

LIMITS = f"""{RET}, g as (select *, row_number() over w as n, coalesce(ret_1d >= ln(1.095), false) as lim,
  coalesce(ret_1d > 0, false) as up from r {W}),
f as (select code, trade_date, least(coalesce(n - max(case when lim then n end) over w, 60), 60) / 60.0 as days_since_limit,
  sum(case when lim then 1 else 0 end) {over(20)} / 20.0 as n_limits_20d,
  sum(case when lim then 1 else 0 end) {over(60)} / 60.0 as n_limits_60d,
  max(ret_1d) {over(20)} as max_ret_20d,
  least(n - coalesce(max(case when not up then n end) over w, 0), 10) / 10.0 as consecutive_up,
  case when open = high and high = low and low = close and lim then 1.0 else 0.0 end as is_yi_zi
  from g window w as (partition by code order by trade_date rows unbounded preceding))"""


def self_z(c: str) -> str:
    return f"({c} - ({guard('avg', c, 60, 20)})) / (({guard('stddev_pop', c, 60, 20)}) + 1e-9)"


SCALE = f"""{RET}, f as (select code, trade_date, ln(case when circ_mv < 1 then 1 else circ_mv end) as circ_mv_log,
  {self_z('circ_mv')} as circ_mv_z_self60, {guard('avg', 'turnover_rate', 20, 5)} as turnover_ma20,
  {self_z('turnover_rate')} as turnover_self_z60, {guard('stddev_pop', 'ret_1d', 60, 20)} as vola_60d,
  ({guard('stddev_pop', 'ret_1d', 20, 5)}) / (({guard('stddev_pop', 'ret_1d', 60, 20)}) + 1e-9) as vola_ratio_20_60 from r)"""

PRICE_VOLUME = f"""{RET}, f as (select code, trade_date,
  ln(close / lag(close, 5) over w) * tanh(volume / ({guard('avg', 'volume', 5)}) - 1) as price_vol_match5,
  ({guard('sum', 'net_mf_amount', 5, 2)}) / nullif(circ_mv, 0) as inflow_5d_sum,
  case when count(ret_1d) {over(60)} >= 20 then corr(ret_1d, volume) {over(60)} end as vol_ret_corr60 from r {W})"""

DAY_HITS = f"""{KEYWORD_SQL},
hits as (select n.trade_date, k.l1_code, k.l1_name, k.n_keywords, count(distinct k.keyword) as hits,
  string_agg(distinct k.keyword, ',') as any_kw
  from news_raw n join kw k on contains(n.content, k.keyword) group by all),
ment as (select *, hits * 1.0 / n_keywords as match_score from hits where hits >= 1 and hits * 1.0 / n_keywords >= 0.05)"""

NEWS = f"""{DAY_HITS}, f as (select b.code, b.trade_date, case when m.l1_code is null then 0.0 else 1.0 end as news_mentioned_t
  from panel b join industry i using (code) left join ment m on m.l1_code = i.l1_code and m.trade_date = b.trade_date)"""

GROUPS = {
    "price": (feat.PRICE, PRICE),
    "averages": (feat.AVERAGES, AVERAGES),
    "volume": (feat.VOLUME, VOLUME),
    "technical": (feat.TECHNICAL, TECHNICAL),
    "fundamental": (feat.FUNDAMENTAL, FUNDAMENTAL),
    "money_flow": (feat.FLOW, FLOW),
    "limit_up": (feat.LIMITS, LIMITS),
    "scale": (feat.SCALE, SCALE),
    "price_volume": (feat.PRICE_VOLUME, PRICE_VOLUME),
}


PANEL_COLS = ["open", "high", "low", "close", "volume", "amount", "pe_ttm", "pb", "turnover_rate", "total_mv", "circ_mv",
              "buy_sm_amount", "buy_md_amount", "buy_lg_amount", "buy_elg_amount", "net_mf_amount", "adj_factor"]


@query("panel_join", f"select code, trade_date, {', '.join(PANEL_COLS)} from panel", "panel")
def panel_join(m):
    return m.joined_panel.select("code", "trade_date", *PANEL_COLS)


def _group_query(name, source, sql):
    @query(f"feature_{name}", f"with {sql} {shown(source.columns)}", "panel")
    def run(m, source=source, name=name):
        panel = attach_forward_adjusted(m.panel) if name == "technical" else m.panel
        out = feat.compute_features(panel, (source,))
        return rounded(out, source.columns, "trade_date")


for _name, (_source, _sql) in GROUPS.items():
    _group_query(_name, _source, _sql)


def mentioned_panel(m):
    found = news.mentions(m.news_raw, ENTRIES)
    return feat.attach_mentions(attach_forward_adjusted(m.panel), m.industry, found)


@query(
    "feature_news",
    f"with {NEWS} select code, trade_date, news_mentioned_t, coalesce(lag(news_mentioned_t) over w, 0.0) as news_mentioned_t1 from f {W}",
    "panel industry news_raw",
)
def feature_news(m):
    return feat.compute_features(mentioned_panel(m), (feat.NEWS,))


def _all_features_sql() -> str:
    """Every group as its own nested query, then the z-score rule."""
    parts, joins = [], []
    for name, (source, sql) in GROUPS.items():
        parts.append(f"g_{name} as (with {sql} select code, trade_date, "
                     + ", ".join(f"lag({c}) over w as {c}" for c in source.columns) + f" from f {W})")
        joins.append(f"join g_{name} using (code, trade_date)")
    parts.append(f"g_news as (with {NEWS} select code, trade_date, news_mentioned_t, "
                 f"coalesce(lag(news_mentioned_t) over w, 0.0) as news_mentioned_t1 from f {W})")
    joins.append("join g_news using (code, trade_date)")
    first, rest = joins[0].split(" ")[1], joins[1:]
    cols = ", ".join(feat.FEATURES)
    return ", ".join(parts) + f", feats as (select code, trade_date, {cols} from {first} {' '.join(rest)})"


ALL_FEATURES_SQL = _all_features_sql()


def z_digits(c: str) -> int:
    """While both windows of this ratio cover the same rows it is 1 up to rounding noise, and
    the z-score magnifies that noise."""
    return 3 if c == "vola_ratio_20_60" else 6


def z_sql(c: str, day: str = "trade_date") -> str:
    z = f"coalesce(({c} - avg({c}) over (partition by {day})) / nullif(stddev_samp({c}) over (partition by {day}), 0), 0)"
    return f"round(case when {z} > 5 then 5 when {z} < -5 then -5 else {z} end, {z_digits(c)}) + 0.0 as {c}"


def all_features(m):
    return feat.compute_features(mentioned_panel(m), feat.ALL_SOURCES)


@query("features_all", f"with {ALL_FEATURES_SQL} select code, trade_date, "
       + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in feat.FEATURES) + " from feats", "panel industry news_raw")
def features_all(m):
    return rounded(all_features(m), feat.FEATURES)


@query("features_zscore", f"with {ALL_FEATURES_SQL} select code, trade_date, "
       + ", ".join(z_sql(c) for c in feat.FEATURES) + " from feats", "panel industry news_raw")
def features_zscore(m):
    z = feat.zscore_by_day(all_features(m), feat.FEATURES)
    return rounded(z, feat.FEATURES, "trade_date", z_digits)


# --- indicators ---------------------------------------------------------------

IND_COLS = [c for i in ind.REGISTRY.values() for c in i.outputs]

INDICATORS_SQL = f"""i1 as (select *, close - lag(close) over w as delta,
  greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr,
  (close - ({guard('min', 'low', 9)})) / nullif(({guard('max', 'high', 9)}) - ({guard('min', 'low', 9)}), 0) * 100 as rsv,
  {guard('avg', 'close', 5)} as ma5, {guard('avg', 'close', 20)} as ma20, {guard('avg', 'close', 60)} as ma60,
  {guard('stddev_pop', 'close', 20)} as sd from bars {W}),
i2 as (select *, case when delta > 0 then delta when delta is not null then 0.0 end as gain,
  case when delta < 0 then -delta when delta is not null then 0.0 end as loss from i1),
i3 as (select *, {ewm('gain', '1.0/14')} as ag, {ewm('loss', '1.0/14')} as al, {ewm('close', '2.0/13')} as ema12,
  {ewm('close', '2.0/27')} as e26, {ewm('rsv', '1.0/3')} as k, {ewm('tr', '1.0/14')} as atr14 from i2),
i4 as (select *, ema12 - e26 as dif from i3),
i5 as (select *, {ewm('dif', '2.0/10')} as dea, {ewm('k', '1.0/3')} as d from i4),
f as (select code, trade_date, ma5, ma20, ma60, lag(ma20) over w as ma20_prev, ema12, dif, dea, 2 * (dif - dea) as hist,
  100 - 100 / (1 + ag / nullif(al, 0)) as rsi14, k, d, 3 * k - 2 * d as j,
  ma20 + 2 * sd as boll_up, ma20 as boll_mid, ma20 - 2 * sd as boll_dn, atr14, volume as vol from i5 {W})"""


@query("indicators", f"with {INDICATORS_SQL} {shown(IND_COLS, lag=False)}", "bars")
def indicators(m):
    out = ind.add_indicators(m.bars, list(ind.REGISTRY))
    return rounded(out, IND_COLS, "trade_date", digits)


@query("indicators_shifted", f"with {INDICATORS_SQL} {shown(['dif', 'dea', 'rsi14', 'boll_mid'])}", "bars")
def indicators_shifted(m):
    out = ind.add_indicators(m.bars, ["MACD", "RSI14", "BOLL"], shift=True)
    return rounded(out, ["dif", "dea", "rsi14", "boll_mid"], "trade_date", digits)


for _p, _end in {
    "W": "case when dayofweek(trade_date) <= 5 then trade_date + cast(5 - dayofweek(trade_date) as int) else trade_date + 6 end",
    "M": "last_day(trade_date)",
    "Y": "make_date(year(trade_date), 12, 31)",
}.items():

    @query(f"resample_{_p.lower()}", f"""select code, cast({_end} as date) as period_end, min_by(open, trade_date) as open,
      max(high) as high, min(low) as low, max_by(close, trade_date) as close, sum(volume) as volume from bars group by 1, 2""", "bars")
    def resampled(m, p=_p):
        return ind.resample(m.bars, p)


# --- factors ------------------------------------------------------------------

TREND = ["momentum", "reversal", "volume_momentum", "ma", "boll", "boll_upper", "boll_mid", "boll_lower", "kdj"]

TREND_SQL = f"""a as (select *, {guard('avg', 'close', 20)} as m20, {guard('stddev_pop', 'close', 20)} as s20,
  100 * (close - ({guard('min', 'low', 9)})) / nullif(({guard('max', 'high', 9)}) - ({guard('min', 'low', 9)}), 0) as k from bars),
f as (select code, trade_date, close / lag(close, 20) over w - 1 as momentum, -(close / lag(close, 5) over w - 1) as reversal,
  (close / lag(close, 20) over w - 1) * sign(volume / lag(volume, 20) over w - 1) as volume_momentum,
  (close - m20) / m20 as ma, (close - (m20 - 2 * s20)) / nullif(4 * s20, 0) as boll,
  m20 + 2 * s20 as boll_upper, m20 as boll_mid, m20 - 2 * s20 as boll_lower,
  3 * k - 2 * ({guard('avg', 'k', 3)}) as kdj from a {W})"""


@query("factors_trend", f"with {TREND_SQL} {shown(TREND, lag=False)}", "bars")
def factors_trend(m):
    out = fac.add_factors(m.bars, ["momentum", "reversal", "volume_momentum", "ma", "boll", "kdj"])
    return rounded(out, TREND, "trade_date", digits)


RECURSIVE = ["rsi", "macd_line", "macd_signal", "macd", "atr"]

RECURSIVE_SQL = f"""a as (select *, row_number() over w as i, coalesce(close - lag(close) over w, 0) as delta,
  greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr from bars {W}),
b as (select *, greatest(delta, 0) as up, greatest(-delta, 0) as dn,
  case when i = 14 then avg(tr) {over(14)} when i > 14 then tr end as seeded from a),
c as (select *, {ewm('up', '1.0/14')} as au, {ewm('dn', '1.0/14')} as ad, {ewm('close', '2.0/13')} as e12,
  {ewm('close', '2.0/27')} as e26, {ewm('seeded', '1.0/14')} as atr0 from b),
d as (select *, case when i >= 26 then e12 - e26 end as macd_line from c),
e as (select *, case when i >= 34 then {ewm('macd_line', '2.0/10')} end as macd_signal from d),
f as (select code, trade_date, case when i >= 14 then case when ad = 0 then 100 else 100 - 100 / (1 + au / ad) end end as rsi,
  macd_line, macd_signal, macd_line - macd_signal as macd, coalesce(atr0, 0) as atr from e)"""


@query("factors_recursive", f"with {RECURSIVE_SQL} {shown(RECURSIVE, lag=False)}", "bars")
def factors_recursive(m):
    out = fac.add_factors(m.bars, ["rsi", "macd", "atr"])
    return rounded(out, RECURSIVE, "trade_date", digits)


@query("factors_value", """select code, trade_date, round(1.0 / nullif(pe, 0), 6) as pe_factor,
  round(bps / nullif(close, 0), 6) as pb_factor, cast(null as double) as ps_factor,
  round(dps / nullif(close, 0), 6) as dividend_yield_factor, round(net_profit / nullif(equity, 0), 6) as roe_factor
  from (select code, trade_date, close, pe_ttm as pe, pb * 7 as bps, turnover_rate / 9 as dps,
    net_mf_amount as net_profit, total_mv as equity from panel)""", "panel")
def factors_value(m):
    df = m.panel.select(
        "code", "trade_date", "close", F.col("pe_ttm").alias("pe"), (F.col("pb") * 7).alias("bps"),
        (F.col("turnover_rate") / 9).alias("dps"), F.col("net_mf_amount").alias("net_profit"), F.col("total_mv").alias("equity"),
    )
    names = ["pe", "pb", "ps", "dividend_yield", "roe"]
    out = fac.add_factors(df, names)
    return rounded(out, [f"{n}_factor" for n in names], "trade_date")
