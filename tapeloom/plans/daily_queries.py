"""The daily job over stored feature days."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.columns import r6
from tapeloom.operators import audit as au
from tapeloom.operators import daily
from tapeloom.operators import news
from tapeloom.plans.dictionary import ENTRIES
from tapeloom.plans.feature_queries import ALL_FEATURES_SQL
from tapeloom.plans.registry import query
from tapeloom.plans.view_sql import VIEWS
from tapeloom.session import scratch_dir, store_once
from tapeloom.sources.day_store import DayStore

#: What is stored before the first run, and the days that are then run one after the other.
HISTORY = (dt.date(2000, 6, 19), dt.date(2001, 6, 11))
RUNS = (dt.date(2001, 6, 18), dt.date(2001, 6, 25))
RULES = au.with_rule(au.with_rule(au.default_rules(), "gap", action="alert"), "big_ratio", fill=None)
COLUMNS = [r.feature for r in RULES]


def run_days(m) -> tuple[DayStore, list[tuple[dt.date, DataFrame, DataFrame]]]:
    """Backfill a new store, then the daily runs: the store and (day, statistics, report) of each."""
    store = daily.feature_days(m.spark, scratch_dir(m.spark, "feature_days"))
    fixed = (lambda start, end: m.between(start, end).panel, m.stock_lifecycle, m.industry, news.mentions(m.news_raw, ENTRIES))
    daily.backfill(store, 0, *fixed, *HISTORY)
    return store, [(day, *daily.daily_run(store, k, day, *fixed, RULES)) for k, day in enumerate(RUNS, start=1)]


def _days_sql() -> str:
    """The stored days: each part from its own year of panel and its own eligible codes."""
    parts = []
    for k, (start, end) in enumerate([HISTORY, *((d, d) for d in RUNS)]):
        parts.append(f"""part_{k} as (with panel as (select * from whole where trade_date between date '{daily.year_before(start)}' and date '{end}' and code in
     (select code from bars left join stock_lifecycle l using (code) where trade_date = date '{end}' and code not like '%.BJ' and (l.name is null or (l.name not ilike 'st%' and l.name not ilike '*st%')))),
   {ALL_FEATURES_SQL} select * from feats where trade_date between date '{start}' and date '{end}')""")
    union = " union all ".join(f"select * from part_{k}" for k in range(len(parts)))
    return f"whole as ({VIEWS['panel'][1]}), {', '.join(parts)}, stored as ({union})"


STORED = _days_sql()
RULES_SQL = "rules(feature, source, low, high, alert, fill, action) as (values " + ", ".join(
    f"('{r.feature}', '{r.source}', {r.low}::double, {r.high}::double, {r.alert}::double, {'null' if r.fill is None else repr(r.fill)}, '{r.action}')" for r in RULES
) + ")"


def _audit_sql() -> str:
    days = []
    for k, day in enumerate(RUNS):
        days.append(f"""thr_{k} as (select feature, quantile_cont(value, 0.005) as q_low, quantile_cont(value, 0.995) as q_high from long
   where trade_date between date '{day - dt.timedelta(days=366)}' and date '{day}' and value is not null group by 1 having count(*) >= 1000),
  st_{k} as (select date '{day}' as run_day, feature, r.source, coalesce(q_low, low) as lo, coalesce(q_high, high) as hi, alert, fill, action, count(*) as n, count(*) filter (value is null) as n_missing,
   count(*) filter (value < coalesce(q_low, low)) as n_below, count(*) filter (value > coalesce(q_high, high)) as n_above
   from long join rules r using (feature) left join thr_{k} using (feature) where trade_date = date '{day}' group by all)""")
    return f"""with {STORED}, {RULES_SQL},
  long as (select trade_date, unnest([{', '.join(repr(c) for c in COLUMNS)}]) as feature, unnest([{', '.join(COLUMNS)}]) as value from stored),
  {', '.join(days)}, st as ({' union all '.join(f'select * from st_{k}' for k in range(len(RUNS)))})
  select run_day, feature, source, n, n_missing, n_below, n_above, round(lo, 6) + 0.0 as lo, round(hi, 6) + 0.0 as hi,
   cast(case when n_missing > 0 and (fill is null or n_missing / n > alert) then 1 else 0 end + case when action in ('alert', 'drop_stock') then (n_below > 0)::int + (n_above > 0)::int else 0 end as bigint) as alerts
  from st"""


VIEW_NAMES = "bars daily_basic moneyflow adj_factor industry stock_lifecycle news_raw"


@query("daily_job", _audit_sql(), VIEW_NAMES)
def daily_job(m):
    shown = []
    for day, stats, report in run_days(m)[1]:
        both = stats.join(report.select("feature", F.col("alerts").cast("bigint").alias("alerts")), "feature")
        told = both.select(F.lit(day).alias("run_day"), "feature", "source", "n", "n_missing", "n_below", "n_above", r6("lo").alias("lo"), r6("hi").alias("hi"), "alerts")
        shown.append(store_once(told, "day_report"))  # a union would hold the buffers of all days in one task
    return reduce(DataFrame.unionByName, shown)


@query("daily_job_features", f"with {STORED} select code, trade_date, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in COLUMNS)} from stored where trade_date >= date '2001-05-01'", VIEW_NAMES)
def daily_job_features(m):
    store, _ = run_days(m)
    return store.read("2001-05-01").select("code", "trade_date", *[r6(c).alias(c) for c in COLUMNS])
