"""Quality, causality, integrity and trading-mask queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tapeloom.functions.columns import r6
from tapeloom.functions.rolling import Clock
from tapeloom.operators import audit as au
from tapeloom.operators import features as feat
from tapeloom.operators import indicators as ind
from tapeloom.operators import integrity as it
from tapeloom.operators.panel import attach_forward_adjusted
from tapeloom.plans.feature_queries import ALL_FEATURES_SQL, GROUPS, W, all_features, mentioned_panel
from tapeloom.plans.registry import query
from tapeloom.session import store_once

DAY = "2001-06-25"
COLS = list(feat.FEATURES)
AUDITED = "panel industry news_raw"


def _feats_sql(names) -> str:
    parts = []
    for n in names:
        source, sql = GROUPS[n]
        parts.append(f"g_{n} as (with {sql} select code, trade_date, " + ", ".join(f"lag({c}) over w as {c}" for c in source.columns) + f" from f {W})")
    joined = f"g_{names[0]} " + " ".join(f"join g_{n} using (code, trade_date)" for n in names[1:])
    return ", ".join(parts) + f", feats as (select * from {joined})"


FEATS = ALL_FEATURES_SQL
LONG = f"""{FEATS}, long as (select code, trade_date, unnest([{', '.join(repr(c) for c in COLS)}]) as feature, unnest([{', '.join(COLS)}]) as value from feats),
 lastd as (select distinct trade_date from feats where trade_date <= date '{DAY}' order by 1 desc limit 252),
 thr as (select feature, quantile_cont(value, 0.005) as q_low, quantile_cont(value, 0.995) as q_high from long where trade_date in (select trade_date from lastd) and value is not null group by 1 having count(*) >= 1000)"""


def audited_rules():
    rules = [r for r in au.default_rules() if r.feature in COLS]
    rules = au.with_rule(rules, "gap", action="alert")
    rules = au.with_rule(rules, "big_ratio", fill=None)
    rules = au.with_rule(rules, "ret_5d", action="drop_stock")
    rules = au.with_rule(rules, "pe_log", fill="prev", alert=0.05)
    return au.with_rule(rules, "turnover", fill="median", alert=0.0)


RULES_SQL = "rules(feature, source, low, high, warmup, alert, fill, action) as (values " + ", ".join(
    f"('{r.feature}', '{r.source}', {r.low}::double, {r.high}::double, {r.warmup}, {r.alert}::double, {'null' if r.fill is None else repr(r.fill)}, '{r.action}')" for r in audited_rules()
) + ")"

STATS = f"""{LONG}, {RULES_SQL}, bd as (select r.*, coalesce(q_low, low) as lo, coalesce(q_high, high) as hi from rules r left join thr using (feature)),
 st as (select feature, source, fill, alert, action, lo, hi, count(*) as n, count(*) filter (value is null) as n_missing, count(*) filter (value < lo) as n_below,
  count(*) filter (value > hi) as n_above, min(value) as min_value, max(value) as max_value from long join bd using (feature) where trade_date = date '{DAY}' group by all),
 al as (select feature, source, 'nan_strategy_missing' as issue, n_missing / n as value, null::double as threshold, n_missing as affected from st where n_missing > 0 and fill is null
  union all select feature, source, 'nan_rate_high', n_missing / n, alert, n_missing from st where n_missing > 0 and fill is not null and n_missing / n > alert
  union all select feature, source, 'below_min', min_value, lo, n_below from st where n_below > 0 and action in ('alert', 'drop_stock')
  union all select feature, source, 'above_max', max_value, hi, n_above from st where n_above > 0 and action in ('alert', 'drop_stock'))"""


def feats(m):
    """All features, stored, as thresholds and statistics read them again and again."""
    return store_once(all_features(m), "features")


def stats(m):
    f = feats(m)
    thr = au.rolling_thresholds(f, DAY, COLS)
    return au.feature_day_stats(f, DAY, au.rule_frame(m.spark, audited_rules()), COLS, thr)


@query("quality_rules_share", f"""with {FEATS}, {RULES_SQL}, long as (select * from (unpivot (select {', '.join(COLS)} from feats) on {', '.join(COLS)} into name feature value value))
  select feature, r.warmup, r.action, count(*) as n, count(*) filter (value between r.low and r.high) as inside from long join rules r using (feature) group by all""", AUDITED)
def quality_rules_share(m):
    from tapeloom.operators.evaluate import unpivot

    long = unpivot(all_features(m), [], COLS).where("value is not null").join(au.rule_frame(m.spark, audited_rules()), "feature")
    return long.groupBy("feature", "warmup", "action").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").between(F.col("low"), F.col("high"))).alias("inside"))


@query("rolling_thresholds", f"with {LONG} select feature, round(q_low, 6) + 0.0 as q_low, round(q_high, 6) + 0.0 as q_high from thr", AUDITED)
def rolling_thresholds(m):
    t = au.rolling_thresholds(feats(m), DAY, COLS)
    return t.select("feature", r6("q_low").alias("q_low"), r6("q_high").alias("q_high"))


@query("feature_day_stats", f"with {STATS} select feature, n, n_missing, n_below, n_above, round(min_value, 6) + 0.0 as min_value, round(max_value, 6) + 0.0 as max_value from st", AUDITED)
def feature_day_stats(m):
    return stats(m).select("feature", "n", "n_missing", "n_below", "n_above", r6("min_value").alias("min_value"), r6("max_value").alias("max_value"))


@query("quality_alerts", f"with {STATS} select feature, source, issue, round(value, 6) + 0.0 as value, round(threshold, 6) + 0.0 as threshold, affected from al", AUDITED)
def quality_alerts(m):
    a = au.quality_alerts(stats(m))
    return a.select("feature", "source", "issue", r6("value").alias("value"), r6("threshold").alias("threshold"), "affected")


@query("audit_report", f"with {STATS} select st.feature, st.source, count(al.issue) as alerts, count(al.issue) = 0 as passed from st left join al using (feature) group by 1, 2", AUDITED)
def audit_report(m):
    return au.audit_report(stats(m))


def _repair_sql() -> str:
    cols = []
    for r in audited_rules():
        c = r.feature
        x = {"zero": f"coalesce({c}, 0)", "prev": f"coalesce({c}, p_{c})", "median": f"coalesce({c}, median({c}) over (), 0)"}.get(r.fill, c)
        lo, hi = f"(select lo from bd where feature = '{c}')", f"(select hi from bd where feature = '{c}')"
        if r.action == "clip":
            x = f"case when {x} < {lo} then {lo} when {x} > {hi} then {hi} else {x} end"
        elif r.action == "drop_stock":
            x = f"case when {x} < {lo} or {x} > {hi} then null else {x} end"
        cols.append(f"round({x}, 6) + 0.0 as {c}")
    return f"with {STATS}, today as (select * from (select *, lag(pe_log) over w as p_pe_log from feats {W}) where trade_date = date '{DAY}') select code, trade_date, {', '.join(cols)} from today"


@query("repair_day", _repair_sql(), AUDITED)
def repair_day(m):
    f = feats(m)
    out = au.repair_day(f, DAY, audited_rules(), au.rolling_thresholds(f, DAY, COLS))
    return out.select("code", "trade_date", *[r6(r.feature).alias(r.feature) for r in audited_rules()])


@query("drop_last_rows", """select code, trade_date from (select code, trade_date, row_number() over (partition by code order by trade_date desc) as r, count(*) over (partition by code) as n from bars)
  where r > 5 or n <= 5""", "bars")
def drop_last_rows(m):
    return au.drop_last_rows(m.bars.select("code", "trade_date"), 5)


@query("causality_audit", """with kept as (select count(*) as c from (select row_number() over (partition by code order by trade_date desc) as r, count(*) over (partition by code) as n from bars) where r > 5 or n <= 5),
  names as (select unnest([""" + ", ".join(f"'{c}'" for c in feat.FEATURES) + """]) as feature) select feature, c as compared, 0 as look_ahead from names, kept""", "bars")
def causality_audit(m):
    return au.causality_audit(mentioned_panel(m), 5, feat.ALL_SOURCES).select("feature", "compared", "look_ahead")


SPOT = (feat.PRICE, feat.AVERAGES, feat.VOLUME, feat.TECHNICAL, feat.FUNDAMENTAL, feat.FLOW, feat.LIMITS, feat.SCALE, feat.PRICE_VOLUME)
SPOT_FEATS = _feats_sql(["price", "averages", "volume", "technical", "fundamental", "money_flow", "limit_up", "scale", "price_volume"])
SPOT_COLS = list(au._spot_expressions())


@query("spot_check", f"""with {SPOT_FEATS}, ok as (select code from panel where trade_date <= date '{DAY}' group by 1 having count(*) > 61 and max(trade_date) = date '{DAY}'),
  long as (select * from (unpivot (select {', '.join(SPOT_COLS)} from feats join ok using (code) where trade_date = date '{DAY}') on {', '.join(SPOT_COLS)} into name feature value value))
  select feature, count(*) as compared, 0 as mismatches, 0 as one_sided from long group by 1""", "panel")
def spot_check(m):
    panel = attach_forward_adjusted(m.panel)
    return au.spot_check(panel, feat.compute_features(panel, SPOT), DAY)


@query("vendor_mismatches", f"""with {GROUPS['technical'][1]}, t as (select * from (select code, trade_date, {', '.join(f'lag({c}) over w as {c}' for c in feat.TECHNICAL.columns)} from f {W}) where trade_date = date '{DAY}'),
  v as (select code, case when al <> 0 then (rsi12 + 0.5) * 100 + 0.2 * (k % 6) end as rsi_12, (kdj_j + 0.5) * 100 - 0.4 * (k % 5) as v_kdj, 2 * (dif - dea) * (1 + 0.03 * (k % 4)) as macd, c as cq
   from (select f.*, t5.al, t5.dif, t5.dea, t5.c, cast(substr(code, 2) as integer) as k from f join t5 using (code, trade_date)) where trade_date = (select max(trade_date) from f where trade_date < date '{DAY}')),
  p as (select code, 'rsi12' as feature, (rsi12 + 0.5) * 100 as ours, rsi_12 as theirs, 0.5 as atol, 0.0 as rtol from t join v using (code) union all
   select code, 'kdj_j', (kdj_j + 0.5) * 100, v_kdj, 1.0, 0.0 from t join v using (code) union all select code, 'macd_hist_norm', macd_hist_norm * cq, macd, 5e-4, 0.05 from t join v using (code))
  select code, feature, round(ours, 4) + 0.0 as ours, round(theirs, 4) + 0.0 as theirs, round(ours - theirs, 4) + 0.0 as diff from p
  where abs(ours - theirs) > atol and abs(ours - theirs) / greatest(abs(theirs), 1e-6) > rtol""", "panel")
def vendor_mismatches(m):
    panel = attach_forward_adjusted(m.panel)
    f = feat.compute_features(panel, (feat.TECHNICAL,))
    # a vendor knows nothing of our features: its frame is made by the chart indicators, of every day, from the same prices
    k = F.substring("code", 2, 10).cast("int")
    charts = panel.select("code", "trade_date", *[F.col(f"{c}_qfq").alias(c) for c in ("open", "high", "low", "close")], "volume")
    charts = ind.rsi(12)(ind.add_indicators(charts, ["MACD", "KDJ"]), Clock())
    vendor = charts.select(
        "code", "trade_date", (F.col("rsi12") + 0.2 * (k % 6)).alias("rsi_12"), (F.col("j") - 0.4 * (k % 5)).alias("kdj_j"),
        (F.col("hist") * (1 + 0.03 * (k % 4))).alias("macd"), F.col("close").alias("close_qfq"))
    out = au.vendor_mismatches(f, vendor, DAY)
    return out.select("code", "feature", *[r6(c, 4).alias(c) for c in ("ours", "theirs", "diff")])


# --- integrity ----------------------------------------------------------------

TRADE_KEYS = "tk as (select concat('N', lpad(cast(s_nationkey as varchar), 2, '0')) as code, cast(l_shipdate as date) as trade_date from lineitem join supplier on l_suppkey = s_suppkey)"


@query("duplicate_keys", f"""with {TRADE_KEYS}, c as (select 'bars' as tbl, code, trade_date, count(*) as n from bars group by all union all select 'trades', code, trade_date, count(*) from tk where trade_date >= date '2001-10-01' - 30 group by all)
  select tbl as "table", code, trade_date, n from c where n > 1""", "bars")
def duplicate_keys(m):
    trades = m.trades.select("code", F.col("l_shipdate").cast("date").alias("trade_date"))
    return it.duplicate_keys({"bars": m.bars, "trades": trades}, "2001-10-01", 30)


@query("missing_pairs", """select child, missing from (select 'daily_basic' as child, count(*) as missing from bars b where not exists (select 1 from daily_basic d where d.code = b.code and d.trade_date = b.trade_date)
  union all select 'moneyflow', count(*) from bars b where not exists (select 1 from moneyflow d where d.code = b.code and d.trade_date = b.trade_date)) where missing > 0""", "bars daily_basic moneyflow")
def missing_pairs(m):
    return it.missing_pairs(m.bars, {"daily_basic": m.daily_basic, "moneyflow": m.moneyflow}, "2001-10-01", 0)


@query("calendar_gaps", """with r as (select * from bars where trade_date >= date '2001-10-01' - 1825), d as (select distinct trade_date from r),
  p as (select code, count(distinct trade_date) as actual_days, min(trade_date) as first_day from r group by 1),
  g as (select code, actual_days, (select count(*) from d where d.trade_date >= p.first_day) as expected_days, first_day from p) select * from g where expected_days - actual_days >= 1""", "bars")
def calendar_gaps(m):
    return it.calendar_gaps(m.bars, m.industry, "2001-10-01")


@query("row_count_jumps", """with p as (select trade_date, count(*) as n_today from bars group by 1), q as (select *, lag(trade_date) over (order by trade_date) as prev_date, lag(n_today) over (order by trade_date) as n_prev from p)
  select trade_date, n_today, prev_date, n_prev, round((n_today - n_prev) / n_prev, 6) + 0.0 as change_pct from q where abs((n_today - n_prev) / n_prev) > 0.03""", "bars")
def row_count_jumps(m):
    return it.row_count_jumps(m.bars, "2001-10-01", 0, 0.03).withColumn("change_pct", r6("change_pct"))


@query("status_grid", """with d as (select unnest(generate_series(date '2001-10-22' - 20, date '2001-10-22', interval 1 day))::date as day), t(tbl, expected) as (values ('bars', 25), ('moneyflow', 30), ('daily_basic', 60)),
  c as (select 'bars' as tbl, trade_date as day, count(distinct code) as codes from bars group by all union all select 'moneyflow', trade_date, count(distinct code) from moneyflow group by all
   union all select 'daily_basic', trade_date, count(distinct code) from daily_basic group by all)
  select tbl as "table", day, coalesce(codes, 0) as codes, case when coalesce(codes, 0) = 0 then 'empty' when codes >= expected * 0.9 then 'ok' when codes >= expected * 0.5 then 'warn' else 'bad' end as severity
  from t cross join d left join c using (tbl, day)""", "bars moneyflow daily_basic")
def status_grid(m):
    m = m.between(dt.date(2001, 10, 2), dt.date(2001, 10, 22))
    return it.status_grid({"bars": m.bars, "moneyflow": m.moneyflow, "daily_basic": m.daily_basic}, {"bars": 25, "moneyflow": 30, "daily_basic": 60}, "2001-10-22", 21)


@query("integrity_summary", f"""with {TRADE_KEYS}, c as (select code, trade_date, count(*) as n from tk where trade_date >= date '2001-10-01' - 30 group by all having count(*) > 1),
  m as (select 'daily_basic' as child, count(*) as missing from bars b where not exists (select 1 from daily_basic d where d.code = b.code and d.trade_date = b.trade_date)
   union all select 'moneyflow', count(*) from bars b where not exists (select 1 from moneyflow d where d.code = b.code and d.trade_date = b.trade_date)),
  p as (select trade_date, count(*) as n_today from bars group by 1), q as (select trade_date, (n_today - lag(n_today) over (order by trade_date)) / lag(n_today) over (order by trade_date) as ch from p)
  select 'duplicates' as "check", count(*) as issues, (select concat('trades/', code) from c order by n desc, code desc limit 1) as worst from c
  union all select 'missing_pairs', sum(missing), (select child from m order by missing desc, child desc limit 1) from m
  union all select 'row_count_jumps', count(*), (select cast(trade_date as varchar) from q where abs(ch) > 0.03 order by abs(ch) desc, trade_date desc limit 1) from q where abs(ch) > 0.03""", "bars daily_basic moneyflow")
def integrity_summary(m):
    return it.integrity_summary(duplicate_keys(m), missing_pairs(m), it.row_count_jumps(m.bars, "2001-10-01", 0, 0.03))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("table_counts", " union all ".join(f"select '{t}' as \"table\", count(*) as n from {t}" for t in TABLES) + " union all select 'absent', 0")
def table_counts(m):
    return it.table_counts({**{t: m.table(t) for t in TABLES}, "absent": None}, m.spark)


DIV = "dv as (select concat('N', lpad(cast(c_nationkey as varchar), 2, '0')) as code, case o_orderstatus when 'F' then '实施' when 'O' then '预案' else '已实施' end as div_proc, cast(o_orderdate as date) as ex_date from orders join customer on o_custkey = c_custkey)"


def dividends(m):
    c = m.table("customer").select("c_custkey", "c_nationkey")
    from tapeloom.sources.market_views import nation_code

    status = F.col("o_orderstatus")
    proc = F.when(status == "F", "实施").when(status == "O", "预案").otherwise("已实施")
    return m.table("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        nation_code("c_nationkey").alias("code"), proc.alias("div_proc"), F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd'T'00:00:00").alias("ex_date"))


@query("ex_dividend_codes", f"with {DIV} select distinct code from dv where ex_date = date '1998-02-16' and div_proc in ('实施', '已实施')")
def ex_dividend_codes(m):
    return it.ex_dividend_codes(dividends(m), "1998-02-16")


@query("affected_factor_history", f"with {DIV} select code, trade_date, adj_factor from adj_factor where code in (select code from dv where ex_date = date '1998-02-16' and div_proc in ('实施', '已实施'))", "adj_factor")
def affected_factor_history(m):
    return it.affected_factor_history(m.adj_factor, dividends(m), "1998-02-16")


GAPS = "gaps as (select code, trade_date from bars where (cast(substr(code, 2) as integer) + weekofyear(trade_date)) % 4 <> 0)"


@query("suspended_codes", f"with {GAPS} select code from (select distinct code from bars) where code not in (select code from gaps where trade_date = date '2001-10-22')", "bars")
def suspended_codes(m):
    traded = m.bars.where((F.substring("code", 2, 9).cast("int") + F.weekofyear("trade_date")) % 4 != 0)
    return it.suspended_codes(m.bars.select("code"), traded, "2001-10-22")


MASK = f"""{DIV}, u as (select distinct code from bars), mk as (select code, 0 as p, 'ST' as r from stock_lifecycle where name ilike 'st%' or name ilike '*st%'
  union select code, 1, 'ex_dividend' from dv where ex_date = date '1998-02-16' and div_proc in ('实施', '已实施')
  union select code, 2, 'suspended' from u where code not in (select code from bars where trade_date = date '1998-02-16')),
  ms as (select code, string_agg(r, ',' order by p) as reasons from mk join u using (code) group by 1)"""


def mask(m):
    return it.trading_mask(m.bars.select("code"), m.bars, m.stock_lifecycle, dividends(m), "1998-02-16")


@query("trading_mask", f"with {MASK} select code, reasons from ms", "bars stock_lifecycle")
def trading_mask(m):
    return mask(m).withColumn("reasons", F.concat_ws(",", "reasons"))


@query("trading_mask_summary", f"with {MASK} select count(*) as masked, count(*) filter (contains(reasons, 'ST')) as n_st, count(*) filter (contains(reasons, 'ex_')) as n_ex_dividend, count(*) filter (contains(reasons, 'susp')) as n_suspended from ms", "bars stock_lifecycle")
def trading_mask_summary(m):
    return it.mask_summary(mask(m))


@query("deterministic_sample", "select code from (select distinct code from bars) order by md5(concat(code, ':0')), code limit 5", "bars")
def deterministic_sample(m):
    return it.deterministic_sample(m.bars, 5)
