"""Universe, grid, label and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.columns import r6
from tapeloom.operators import calendar as cal
from tapeloom.operators import evaluate as ev
from tapeloom.operators import features as feat
from tapeloom.operators import labels as lab
from tapeloom.operators import universe as uni
from tapeloom.plans.feature_queries import ALL_FEATURES_SQL, all_features, shown
from tapeloom.plans.registry import query
from tapeloom.session import store_once

EVALUATED = list(feat.FEATURES)

GRID = """grid as (select t.code, c.trade_date, c.day_idx, b.open, b.high, b.low, b.close, b.volume
  from (select distinct code from bars) t cross join calendar c left join bars b using (code, trade_date))"""

RETURNS = GRID + """, rets as (select code, trade_date, day_idx, coalesce(ln(nxt / close), 0) as ret
  from (select *, lead(close) over (partition by code order by day_idx) as nxt from grid)
  where day_idx < (select max(day_idx) from calendar))"""


def forward_sql(k: int, src: str = "rets") -> str:
    return f"""fwd as (select code, trade_date, day_idx, f as fwd from (select *, sum(ret) over v as f, count(ret) over v as n
      from {src} window v as (partition by code order by day_idx rows between current row and {k - 1} following)) where n = {k})"""


def grid(m):
    return cal.dense_grid(m.bars, m.bars.select("code"), m.calendar)


def returns(m):
    return lab.grid_log_returns(grid(m))


@query("trade_calendar", "select trade_date, day_idx from calendar", "calendar")
def trade_calendar(m):
    return m.calendar


@query("slice_half_open", "select code, trade_date, close from bars where trade_date >= date '1996-01-01' and trade_date < date '1997-01-06'", "bars")
def slice_half_open(m):
    return cal.half_open(m.between("1996-01-01", "1997-01-06").bars, "1996-01-01", "1997-01-06").select("code", "trade_date", "close")


@query("slice_inclusive", "select code, trade_date, close from bars where trade_date between date '1996-01-01' and date '1997-01-06'", "bars")
def slice_inclusive(m):
    return cal.inclusive(m.between("1996-01-01", "1997-01-06").bars, "1996-01-01", "1997-01-06").select("code", "trade_date", "close")


@query("train_val_test_split", """select case when trade_date between date '1995-01-01' and date '1998-12-31' then 'train'
  when trade_date between date '1999-01-01' and date '1999-12-31' then 'val'
  when trade_date between date '2000-01-01' and date '2001-12-31' then 'test' end as split, count(*) as n,
  count(distinct trade_date) as days from bars group by 1""", "bars")
def train_val_test_split(m):
    bounds = {"train": ("1995-01-01", "1998-12-31"), "val": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}
    split = cal.split_label(F.col("trade_date"), bounds)
    return m.bars.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trade_date").alias("days"))


def span(m):
    return m.calendar.agg(F.min("trade_date").alias("start"), F.max("trade_date").alias("end"))


@query("walk_forward_splits", """with span as (select min(trade_date) as s, max(trade_date) as e from calendar),
 i as (select unnest(range(0, 50)) as i)
 select cast(i as integer) as split_id, cast(s + to_years(cast(i as integer)) as date) as train_start,
  cast(s + to_years(cast(i + 3 as integer)) as date) as train_end, cast(s + to_years(cast(i + 3 as integer)) as date) as test_start,
  cast(s + to_years(cast(i + 4 as integer)) as date) as test_end from span, i where s + to_years(cast(i + 4 as integer)) <= e""", "calendar")
def walk_forward_splits(m):
    return cal.walk_forward_splits(span(m))


@query("month_windows", """with span as (select min(trade_date) as s, max(trade_date) as e from calendar), i as (select unnest(range(0, 600, 3)) as i)
 select cast(date_trunc('month', s) + to_months(cast(i as integer)) as date) as month_start,
  last_day(cast(date_trunc('month', s) + to_months(cast(i + 2 as integer)) as date)) as month_end
 from span, i where date_trunc('month', s) + to_months(cast(i as integer)) <= date_trunc('month', e)""", "calendar")
def month_windows(m):
    return cal.month_windows(span(m), 3)


@query("dense_cube", f"""with {GRID}, {ALL_FEATURES_SQL}
 select g.code, g.trade_date, g.day_idx, g.close is not null as traded, g.close,
 {', '.join(f'round(coalesce(x.{c}, 0), 6) + 0.0 as {c}' for c in EVALUATED)} from grid g left join feats x using (code, trade_date)""", "panel calendar industry news_raw")
def dense_cube(m):
    feats = all_features(m)
    cube = cal.market_cube(m.bars.select("code", "trade_date", "close"), feats, EVALUATED, m.calendar)
    return cube.select("code", "trade_date", "day_idx", "traded", "close", *[r6(c).alias(c) for c in EVALUATED])


@query("sequence_windows", f"""with {RETURNS} select * from (select code, trade_date, day_idx,
  round(sum(ret) over v, 6) + 0.0 as total, round(first_value(ret) over v, 6) + 0.0 as oldest, round(last_value(ret) over v, 6) + 0.0 as newest
  from rets window v as (partition by code order by day_idx rows between 59 preceding and current row)) where day_idx >= 59""", "bars calendar")
def sequence_windows(m):
    seq = cal.sequence_windows(returns(m), ["ret"], 60)
    item = lambda i: F.element_at(F.element_at("window", i), 1)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0])
    return seq.select("code", "trade_date", "day_idx", r6(total).alias("total"), r6(item(1)).alias("oldest"), r6(item(-1)).alias("newest"))


LABELS = GRID + """, lab as (select g.code, g.trade_date, g.day_idx, case when s.open is null or b.open is null or b.high is null then -1
   when abs(b.open - b.high) < 1e-4 and abs(b.open - b.low) < 1e-4 then -1
   when s.open / b.open - 1 >= 0.05 then 1 else 0 end as label
  from grid g left join grid b on b.code = g.code and b.day_idx = g.day_idx + 1 left join grid s on s.code = g.code and s.day_idx = g.day_idx + 2)"""


@query("hit_labels", f"with {LABELS} select * from lab", "bars calendar")
def hit_labels(m):
    return lab.hit_labels(grid(m), m.calendar)


@query("hit_labels_without_low", f"with {GRID} " + """select g.code, g.trade_date, g.day_idx, case when s.open is null or b.open is null or b.high is null then -1
   when abs(b.open - b.high) < 1e-4 then -1 when s.open / b.open - 1 >= 0.05 then 1 else 0 end as label
  from grid g left join grid b on b.code = g.code and b.day_idx = g.day_idx + 1 left join grid s on s.code = g.code and s.day_idx = g.day_idx + 2""", "bars calendar")
def hit_labels_without_low(m):
    return lab.hit_labels(grid(m), m.calendar, use_low=False)


@query("label_stats", f"""with {LABELS} select count(*) as total, count(*) filter (label >= 0) as valid, count(*) filter (label = 1) as hit,
  round(count(*) filter (label >= 0) / count(*), 6) as valid_pct, round(count(*) filter (label = 1) / count(*) filter (label >= 0), 6) as hit_rate,
  round(sqrt(count(*) filter (label = 0) / count(*) filter (label = 1)), 6) as pos_weight from lab""", "bars calendar")
def label_stats(m):
    s = lab.label_stats(lab.hit_labels(grid(m), m.calendar))
    return s.select("total", "valid", "hit", *[r6(c).alias(c) for c in ("valid_pct", "hit_rate", "pos_weight")])


@query("grid_returns", f"with {RETURNS} select code, trade_date, day_idx, round(ret, 6) + 0.0 as ret from rets", "bars calendar")
def grid_returns(m):
    return returns(m).withColumn("ret", r6("ret"))


@query("forward_returns", f"with {RETURNS}, {forward_sql(5)} select code, trade_date, day_idx, round(fwd, 6) + 0.0 as fwd from fwd", "bars calendar")
def forward_returns(m):
    return lab.forward_returns(returns(m), 5).withColumn("fwd", r6("fwd"))


@query("market_proxy", f"with {RETURNS} select day_idx, round(avg(ret), 6) + 0.0 as mkt from rets group by 1", "bars calendar")
def market_proxy(m):
    return lab.market_proxy(returns(m)).withColumn("mkt", r6("mkt"))


@query("market_returns", f"""select trade_date, round(ret, 6) + 0.0 as ret from (select trade_date, ln(close / lag(close) over (order by trade_date)) as ret,
  row_number() over (order by trade_date) as n from bars where code = 'N03') where n > 1""", "bars")
def market_returns(m):
    from tapeloom.operators.panel import market_returns as mr

    return mr(m.bars, "N03").withColumn("ret", r6("ret"))


FEATS = f"{ALL_FEATURES_SQL}, x as (select code, trade_date, {', '.join(f'cast({c} as double) as {c}' for c in EVALUATED)} from feats)"
LONG = f"""{RETURNS}, {forward_sql(5)}, {FEATS}, long as (select * from (unpivot (select code, trade_date, fwd, {', '.join(EVALUATED)}
  from x join fwd using (code, trade_date)) on {', '.join(EVALUATED)} into name feature value value))"""
CORR = """select feature, round(coalesce(avg(c), 0), 6) + 0.0 as {out} from (select feature, trade_date,
  case when count(*) >= 5 and count(*) * stddev_pop({v}) * stddev_pop({f}) > 1e-12 then corr({v}, {f}) end as c from {src} group by 1, 2) group by 1"""


def evaluated_feats(m):
    return all_features(m)


@query("feature_ic", f"with {LONG} " + CORR.format(out="ic", v="value", f="fwd", src="long"), "panel calendar industry news_raw")
def feature_ic(m):
    return ev.daily_correlation(evaluated_feats(m), lab.forward_returns(returns(m), 5), EVALUATED).withColumn("ic", r6("ic"))


# Values that differ by rounding noise alone are ties.
RANKS = """, even as (select * replace (round(value, 9) as value) from long), ranked as (select feature, trade_date, rank() over (partition by feature, trade_date order by value)
   + (count(*) over (partition by feature, trade_date, value) - 1) / 2.0 as rv, rank() over (partition by feature, trade_date order by fwd)
   + (count(*) over (partition by feature, trade_date, fwd) - 1) / 2.0 as rf from even) """


@query("feature_rank_ic", f"with {LONG}{RANKS}" + CORR.format(out="rank_ic", v="rv", f="rf", src="ranked"), "panel calendar industry news_raw")
def feature_rank_ic(m):
    even = evaluated_feats(m).withColumns({c: F.round(c, 9) for c in EVALUATED})
    out = ev.daily_correlation(even, lab.forward_returns(returns(m), 5), EVALUATED, rank=True)
    return out.withColumn("rank_ic", r6("rank_ic"))


UNPIVOT = f"{FEATS}, long as (select * from (unpivot (select {', '.join(EVALUATED)} from x) on {', '.join(EVALUATED)} into name feature value value))"


@query("feature_entropy", f"""with {UNPIVOT}, e as (select feature, min(value) as lo, max(value) as hi from long group by 1),
  b as (select feature, least(floor((value - lo) / (hi - lo) * 20), 19) as bin, count(*) as n from long join e using (feature) group by 1, 2),
  p as (select feature, n / sum(n) over (partition by feature) as p from b) select feature, round(-sum(p * ln(p)), 6) as entropy from p group by 1""", "panel industry news_raw")
def feature_entropy(m):
    return ev.histogram_entropy(evaluated_feats(m), EVALUATED).withColumn("entropy", r6("entropy"))


@query("feature_dispersion", f"""with {UNPIVOT} select feature, round(stddev_pop(value) / (abs(avg(value)) + 1e-8), 4) as cv,
  round(abs(avg(value)), 6) as abs_mean from long group by 1""", "panel industry news_raw")
def feature_dispersion(m):
    d = ev.dispersion(evaluated_feats(m), EVALUATED)
    return d.select("feature", r6("cv", 4).alias("cv"), r6("abs_mean").alias("abs_mean"))


EPOCHS = {1: ("1995-01-01", "1997-12-31"), 2: ("1998-01-01", "1999-12-31"), 3: ("2000-01-01", "2001-12-31")}


@query("feature_top_n", f"with {LONG}, late as (select * from long where trade_date between date '{EPOCHS[3][0]}' and date '{EPOCHS[3][1]}'), r as (" + CORR.format(out="ic", v="value", f="fwd", src="late") + ") select feature, ic, 3 as epoch from r order by abs(ic) desc, feature limit 3", "panel calendar industry news_raw")
def feature_top_n(m):
    """The correlations of three epochs are kept; the last one names the best features."""
    feats, fwd = store_once(all_features(m), "features"), store_once(lab.forward_returns(returns(m), 5), "forward")
    history = None
    for epoch, (start, end) in EPOCHS.items():
        ic = ev.daily_correlation(cal.inclusive(feats, start, end), fwd, EVALUATED).select("feature", r6("ic").alias("ic"), F.lit(epoch).alias("epoch"))
        history = ic if history is None else history.unionByName(ic)
    return ev.top_features(history, 3, "ic").select("feature", "ic", "epoch")


AUC_SQL = """r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from scores),
 a as (select count(*) filter (label = 1) as n_pos, count(*) filter (label = 0) as n_neg, sum(rk) filter (label = 1) as s from r)"""


@query("auc", f"with {AUC_SQL} select n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) as auc from a", "scores")
def auc(m):
    return ev.auc(m.scores).withColumn("auc", r6("auc"))


P_AT_K = """t as (select *, row_number() over (partition by day_idx order by score desc, doc_id) as r, count(*) over (partition by day_idx) as n from scores),
 pk as (select count(*) filter (label = 1) as hits, count(*) as picks from t where n >= 3 and r <= 3)"""


@query("precision_at_k", f"with {P_AT_K} select hits, picks, round(hits / picks, 6) as precision from pk", "scores")
def precision_at_k(m):
    return ev.precision_at_k(m.scores, 3).withColumn("precision", r6("precision"))


@query("classifier_summary", f"""with {AUC_SQL}, {P_AT_K} select n_pos + n_neg as n_valid, round(n_pos / (n_pos + n_neg), 6) as base_rate,
  round((s - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) as auc, round(hits / picks, 6) as p_at_k from a, pk""", "scores")
def classifier_summary(m):
    out = ev.classifier_summary(m.scores, 3)
    return out.select("n_valid", *[r6(c).alias(c) for c in ("base_rate", "auc", "p_at_k")])


@query("class_balance", "select round(sqrt(count(*) filter (label = 0) / greatest(count(*) filter (label = 1), 1)), 6) as pos_weight, count(*) as total from scores", "scores")
def class_balance(m):
    return lab.label_stats(m.scores).select(r6("pos_weight").alias("pos_weight"), "total")


ALPHA = f"""{RETURNS}, {forward_sql(5)}, mk as (select day_idx, avg(ret) as ret from rets group by 1),
 mf as (select day_idx, sum(ret) over (order by day_idx rows between current row and 4 following) as mkt_fwd from mk),
 al as (select s.trade_date, c.day_idx, coalesce(sum(s.weight * (f.fwd - mf.mkt_fwd)), 0) as alpha from signals s join calendar c using (trade_date)
  left join fwd f on f.code = s.token_id and f.day_idx = c.day_idx join mf on mf.day_idx = c.day_idx
  where c.day_idx + 5 < (select max(day_idx) from calendar) group by 1, 2)"""


@query("daily_alpha", f"with {ALPHA} select trade_date, day_idx, round(alpha, 6) + 0.0 as alpha from al", "signals calendar")
def daily_alpha(m):
    return ev.daily_alpha(m.signals, returns(m), m.calendar, 5).withColumn("alpha", r6("alpha"))


TURN = """sd as (select trade_date, row_number() over (order by trade_date) as k from (select distinct trade_date from {days})),
 sw as (select sd.k, s.token_id, s.weight from signals s join sd using (trade_date)),
 tv as (select coalesce(a.k, b.k + 1) as k, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) as turnover
  from sw a full join sw b on a.token_id = b.token_id and a.k = b.k + 1 group by 1)"""


@query("signal_turnover", "with " + TURN.format(days="signals") + " select sd.trade_date, round(coalesce(turnover, 0), 6) + 0.0 as turnover from sd left join tv using (k) where k > 1", "signals")
def signal_turnover(m):
    return ev.day_turnover(m.signals, m.signals.select("trade_date").distinct()).withColumn("turnover", r6("turnover"))


@query("signal_evaluation", f"with {ALPHA}, {TURN.format(days='al')}," + """ cum as (select *, sum(alpha) over (order by trade_date) as c from al),
 dd as (select min(g) as max_drawdown from (select c - max(c) over (order by trade_date) as g from cum))
 select round(avg(alpha) / (stddev_pop(alpha) + 1e-8) * sqrt(252 / 5.0), 6) as sharpe, round(sum(alpha), 6) as cum_return, round(avg(alpha), 6) as mean_per_step,
  count(*) as n_steps, (select count(*) from signals) as n_signals, (select round(max_drawdown, 6) from dd) as max_drawdown,
  (select round(avg(turnover), 6) from sd join tv using (k) where k > 1) as turnover_avg from al""", "signals calendar")
def signal_evaluation(m):
    m = m.stored("bars", "calendar", "signals")
    out = ev.evaluate_signals(m.signals, store_once(returns(m), "returns"), m.calendar, 5)
    return out.select("n_steps", "n_signals", *[r6(c).alias(c) for c in ("sharpe", "cum_return", "mean_per_step", "max_drawdown", "turnover_avg")])


@query("signals_kept", "select trade_date, token_id, round(weight, 6) as weight from signals where weight > 1e-6", "signals")
def signals_kept(m):
    return m.signals.where(F.col("weight") > 1e-6).withColumn("weight", r6("weight"))


CASES = f"""{GRID}, cases as (select s.trade_date, s.token_id, s.weight, g.close is not null as traded_next, g.trade_date as next_date
  from signals s join calendar c using (trade_date) join grid g on g.code = s.token_id and g.day_idx = c.day_idx + 1)"""


def cases(m):
    return ev.suspended_next_day(m.signals, grid(m).withColumn("traded", F.col("close").isNotNull()), m.calendar)


@query("suspension_cases", f"with {CASES} select trade_date, next_date, token_id, round(weight, 6) as weight from cases where not traded_next", "signals calendar")
def suspension_cases(m):
    return cases(m).where(~F.col("traded_next")).select("trade_date", "next_date", "token_id", r6("weight").alias("weight"))


@query("suspension_report", f"""with {CASES} select count(*) as total, count(*) filter (not traded_next) as suspended,
  round(count(*) filter (not traded_next) / count(*), 6) as rate, round(coalesce(sum(weight) filter (not traded_next), 0) / sum(weight), 6) as rate_weighted from cases""", "signals calendar")
def suspension_report(m):
    out = ev.suspension_report(cases(m))
    return out.select("total", "suspended", r6("rate").alias("rate"), r6("rate_weighted").alias("rate_weighted"))


# --- universe -----------------------------------------------------------------

ASOF = "asked as (select distinct cast(date_trunc('month', trade_date) + interval 1 month as date) as as_of from bars), snaps as (select as_of, max(trade_date) as snap from asked, (select distinct trade_date from daily_basic) where trade_date <= as_of group by 1)"


def months(m):
    return m.bars.select(F.add_months(F.trunc("trade_date", "month"), 1).alias("as_of")).distinct()


@query("snapshot_dates", f"with {ASOF} select as_of, snap from snaps", "bars daily_basic")
def snapshot_dates(m):
    return uni.snapshot_dates(m.daily_basic, months(m))


UNIVERSE = f"""{ASOF}, raw as (select code, trade_date, close / lag(close) over {'(partition by code order by trade_date)'} - 1 as pct_change from bars),
 cand as (select s.as_of, s.snap, d.code, i.l1_code, d.circ_mv from snaps s join daily_basic d on d.trade_date = s.snap join industry i using (code) join stock_lifecycle l using (code)
  where l.name not ilike 'st%' and l.name not ilike '*st%' and l.list_date < s.snap - 120 and d.circ_mv between 1000 and 1e9 and d.turnover_rate > 0),
 tn as (select s.as_of, d.code, avg(turnover_rate) as turnover_ma from snaps s join daily_basic d on d.trade_date <= s.snap and d.trade_date >= s.snap - 180 group by 1, 2 having count(*) >= 5),
 vl as (select s.as_of, r.code, stddev_pop(pct_change) as vola from snaps s join raw r on r.trade_date <= s.snap and r.trade_date >= s.snap - 540 where pct_change is not null group by 1, 2 having count(*) >= 20),
 mg as (select c.*, coalesce(t.turnover_ma, median(t.turnover_ma) over (partition by as_of)) as tm, coalesce(v.vola, median(v.vola) over (partition by as_of)) as vo, -ln(greatest(circ_mv, 1)) as nc
   from cand c left join tn t using (as_of, code) left join vl v using (as_of, code)),
 sc as (select *, 0.5 * (tm - avg(tm) over g) / (stddev_pop(tm) over g + 1e-9) + 0.35 * (vo - avg(vo) over g) / (stddev_pop(vo) over g + 1e-9)
   + 0.15 * (nc - avg(nc) over g) / (stddev_pop(nc) over g + 1e-9) as score from mg window g as (partition by as_of, l1_code))"""


#: Calendar days to look back per row of a window: the fixture's bars are weekly.
WEEKLY = 9.0


def raw_changes(m):
    from tapeloom.functions.rolling import Clock, pick

    return pick(m.bars, ["code", "trade_date"], {"pct_change": f"try_divide(close, {Clock().lag('close')}) - 1"})


def monthly_universe(m, k=2):
    return uni.per_industry_top_k(
        m.daily_basic, raw_changes(m), m.industry, m.stock_lifecycle, months(m), k, 1000, 1e9, ("N",), days_per_row=WEEKLY
    )


@query("universe_monthly_top_k", f"""with {UNIVERSE} select as_of, l1_code, code, round(score, 5) + 0.0 as score, rank from
  (select *, row_number() over (partition by as_of, l1_code order by score desc, code) as rank from sc) where rank <= 2""", "bars daily_basic industry stock_lifecycle")
def universe_monthly_top_k(m):
    return monthly_universe(m).select("as_of", "l1_code", "code", r6("score", 5).alias("score"), "rank")


@query("universe_candidates", f"with {UNIVERSE} select as_of, snap, code, l1_code, round(circ_mv, 4) as circ_mv from cand", "bars daily_basic industry stock_lifecycle")
def universe_candidates(m):
    snaps = uni.snapshot_dates(m.daily_basic, months(m))
    out = uni.candidates(m.daily_basic, m.industry, m.stock_lifecycle, snaps, 1000, 1e9, ("N",))
    return out.withColumn("circ_mv", r6("circ_mv", 4))


@query("universe_turnover", f"with {UNIVERSE} select as_of, code, round(turnover_ma, 6) as turnover_ma from tn", "bars daily_basic industry stock_lifecycle")
def universe_turnover(m):
    return uni.average_turnover(m.daily_basic, uni.snapshot_dates(m.daily_basic, months(m)), 20, WEEKLY).withColumn("turnover_ma", r6("turnover_ma"))


@query("universe_volatility", f"with {UNIVERSE} select as_of, code, round(vola, 6) as vola from vl", "bars daily_basic industry stock_lifecycle")
def universe_volatility(m):
    return uni.volatility(raw_changes(m), uni.snapshot_dates(m.daily_basic, months(m)), 60, WEEKLY).withColumn("vola", r6("vola"))


@query("universe_top_mv", """select code, trade_date, round(circ_mv, 4) as circ_mv from daily_basic join stock_lifecycle l using (code)
  where trade_date = (select max(trade_date) from daily_basic where trade_date <= date '2000-06-30') and turnover_rate > 0 and circ_mv is not null
  and name not ilike 'st%' and name not ilike '*st%' and list_date < trade_date - 120 order by circ_mv desc, code limit 8""", "daily_basic stock_lifecycle")
def universe_top_mv(m):
    return uni.top_market_value(m.daily_basic, m.stock_lifecycle, 8, "2000-06-30").withColumn("circ_mv", r6("circ_mv", 4))


INDEX_SQL = "iw as (select l1_code as index_code, cast(date_trunc('month', trade_date) as date) as trade_date, code as con_code, count(*) as weight from bars join industry using (code) group by 1, 2, 3)"


@query("index_members", f"""with {INDEX_SQL} select index_code, trade_date, con_code from iw where (index_code, trade_date) in
  (select (index_code, max(trade_date)) from iw where trade_date <= date '1999-07-15' group by index_code)""", "bars industry")
def index_members(m):
    weights = m.bars.join(m.industry, "code").groupBy(
        F.col("l1_code").alias("index_code"), F.trunc("trade_date", "month").alias("trade_date"), F.col("code").alias("con_code")
    ).agg(F.count(F.lit(1)).alias("weight"))
    return uni.index_members(weights, "1999-07-15")


@query("eligible_codes", """select distinct code from bars left join stock_lifecycle l using (code) where trade_date = (select max(trade_date) from bars)
  and code not like '%.BJ' and (l.name is null or (l.name not ilike 'st%' and l.name not ilike '*st%'))""", "bars stock_lifecycle")
def eligible_codes(m):
    last = m.bars.select(F.max("trade_date").alias("d")).scalar()
    return uni.eligible_codes(m.bars.where(F.col("trade_date") == last), m.stock_lifecycle.where("name not like 'A%'"))


@query("month_universe_days", f"""with {UNIVERSE}, u as (select as_of, code from (select *, row_number() over (partition by as_of, l1_code order by score desc, code) as rank from sc) where rank <= 2)
  select b.code, b.trade_date from bars b join u on u.code = b.code and u.as_of = date_trunc('month', b.trade_date)""", "bars daily_basic industry stock_lifecycle")
def month_universe_days(m):
    return uni.month_universe(m.bars.select("code", "trade_date"), monthly_universe(m))


PICKS = """select trade_date, token_id, round(weight, 6) as weight, rank from (select *, row_number() over (partition by trade_date order by weight desc, token_id) as rank from signals) where rank <= 3"""


@query("daily_top_picks", PICKS, "signals")
def daily_top_picks(m):
    return uni.top_k(m.signals, 3, ["trade_date"], "weight", "token_id").withColumn("weight", r6("weight"))
