"""Record tables, vendor frames, incremental loading, price adjustment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import columns as col
from tapeloom.functions.columns import r6
from tapeloom.operators import features as feat
from tapeloom.operators import panel as pan
from tapeloom.operators import sync
from tapeloom.plans.feature_queries import PRICE, W, z_sql
from tapeloom.plans.registry import query
from tapeloom.schemas import RECORDS, conform, normalize_ohlcv
from tapeloom.sources import tables as tab
from tapeloom.sources import vendor as ven


@query("conform_record", """select case when day(trade_date) = 15 then '' else code end as code, trade_date, open, high, low,
  close, volume, amount, null::double as pre_close, null::double as pct_change, null::double as turnover from bars""", "bars")
def conform_record(m):
    raw = m.bars.select(
        F.when(F.day("trade_date") != 15, F.col("code")).alias("code"), F.date_format("trade_date", "yyyy-MM-dd'T'00:00:00").alias("trade_date"),
        "open", "high", "low", "close", "volume", "amount", F.lit("x").alias("extra"))
    return conform(raw, RECORDS["raw_daily"])


@query("normalize_ohlcv", """select code, trade_date, open, high, low, close, volume, amount,
  null::double as pre_close, null::double as pct_change, null::double as turnover, null::double as adj_factor, year(trade_date) as yr from bars""", "bars")
def normalize(m):
    return normalize_ohlcv(m.bars.withColumn("yr", F.year("trade_date").cast("bigint")))


@query("load_code_range", "select trade_date, close from bars where code = 'N05' and trade_date between date '1997-01-01' and date '1999-12-27'", "bars")
def load_code_range(m):
    return tab.load(m.between("1997-01-01", "1999-12-27").bars, "N05", "1997-01-01", "1999-12-27", ["trade_date", "close"])


@query("date_ranges", "select code, min(trade_date) as first_date, max(trade_date) as last_date, count(*) as n from bars group by 1", "bars")
def date_ranges(m):
    return tab.date_ranges(m.bars, ["code"])


@query("latest_date", "select min(trade_date) as first_date, max(trade_date) as last_date, count(*) as n from bars", "bars")
def latest_date(m):
    return tab.date_ranges(m.bars, [])


@query("upsert_last_wins", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber
  order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) as r from lineitem) where r = 1""")
def upsert_last_wins(m):
    cols = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    order = [F.col(c) for c in cols[2:]]
    return tab.last_per_key(m.table("lineitem").select(*cols), cols[:2], order).drop("l_shipdate")


@query("upsert_batches", """select code, trade_date, case when year(trade_date) = 1998 then 9.5 else adj_factor end as adj_factor from adj_factor
  union all select 'NEW' as code, trade_date, 1.0 as adj_factor from calendar where year(trade_date) = 1998""", "adj_factor calendar")
def upsert_batches(m):
    in_98 = F.year("trade_date") == 1998
    first = m.adj_factor.where(in_98).withColumn("adj_factor", F.lit(7.5))
    second = m.adj_factor.where(in_98).withColumn("adj_factor", F.lit(9.5))
    new = m.calendar.where(in_98).select(F.lit("NEW").alias("code"), "trade_date", F.lit(1.0).alias("adj_factor"))
    return tab.upsert(m.adj_factor, [first, second.unionByName(new)], RECORDS["adj_factor"])


@query("watermarks", """with old as (select code, max(trade_date) as d from bars where trade_date < date '2000-01-01' group by 1), new as (select code, max(trade_date) as d from bars where year(trade_date) = 2000 and code < 'N20' group by 1)
  select code, coalesce(greatest(o.d, n.d), n.d, o.d) as last_date, case when n.d >= o.d then 'vendor' else 'initial' end as source from old o full join new n using (code)""", "bars")
def watermarks(m):
    marks = m.bars.where(F.col("trade_date") < "2000-01-01").groupBy("code").agg(F.max("trade_date").alias("last_date")).withColumn("source", F.lit("initial"))
    loaded = m.bars.where((F.year("trade_date") == 2000) & (F.col("code") < "N20"))
    return tab.update_watermarks(marks, loaded, "vendor")


MIXED = """mx as (select code, concat(cast(trade_date as varchar), 'T00:00:00') as trade_date, volume from bars where day(trade_date) % 3 <> 0
  union all select code, concat(cast(trade_date as varchar), ' 00:00:00'), volume + 1 from bars where day(trade_date) % 2 = 0)"""


def mixed(m):
    d = F.date_format("trade_date", "yyyy-MM-dd")
    a = m.bars.where(F.day("trade_date") % 3 != 0).select("code", F.concat(d, F.lit("T00:00:00")).alias("trade_date"), "volume")
    b = m.bars.where(F.day("trade_date") % 2 == 0).select("code", F.concat(d, F.lit(" 00:00:00")).alias("trade_date"), (F.col("volume") + 1).alias("volume"))
    return a.unionByName(b)


@query("repair_mixed_dates", f"""with {MIXED} select code, replace(trade_date, ' ', 'T') as trade_date, volume from
  (select *, row_number() over (partition by code, replace(trade_date, ' ', 'T') order by contains(trade_date, ' ')) as r from mx) where r = 1""", "bars")
def repair_mixed_dates(m):
    return tab.repair_mixed_dates(mixed(m), ["code", "trade_date"])


@query("repair_counts", f"""with {MIXED}, k as (select code, replace(trade_date, ' ', 'T') as d, count(*) filter (contains(trade_date, ' ')) as s, count(*) filter (not contains(trade_date, ' ')) as c from mx group by 1, 2)
  select count(*) filter (s > 0 and c = 0) as inserted, sum(s) as deleted from k""", "bars")
def repair_counts(m):
    return tab.repair_counts(mixed(m), ["code", "trade_date"])


@query("latest_runs", "select o_orderkey as run_id, cast(o_orderdate as date) as started_at, o_orderstatus as status, o_totalprice as best_metric from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey desc limit 20")
def latest_runs(m):
    return tab.latest_runs(runs(m), 20, status="F")


def runs(m):
    return m.table("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("date").alias("started_at"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("best_metric"))


@query("best_epochs", """select run_id, started_at, status, best_metric, best_epoch from (select o_orderkey as run_id, cast(o_orderdate as date) as started_at, o_orderstatus as status from orders)
  left join (select l_orderkey as run_id, max(l_extendedprice) as best_metric, cast(arg_max(l_linenumber, l_extendedprice * 1000 - l_linenumber) as bigint) as best_epoch from lineitem group by 1) using (run_id)""")
def best_epochs(m):
    metrics = m.table("lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("bigint").alias("epoch"), F.col("l_extendedprice").alias("auc"))
    return tab.record_best(runs(m), metrics, "auc")


@query("run_deleted", "select o_orderstatus as status, count(*) as n from orders where o_orderkey <> 7 group by 1")
def run_deleted(m):
    return tab.delete_run(runs(m), 7).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- vendor frames -----------------------------------------------------------

@query("vendor_daily", """select code, case when day(trade_date) = 7 then null else trade_date end as trade_date, open, high, low, close,
  volume, null::double as amount, null::double as pre_close, null::double as pct_change, null::double as turnover, null::double as adj_factor from bars""", "bars")
def vendor_daily(m):
    text = F.when(F.day("trade_date") == 7, F.lit("n/a")).otherwise(F.date_format("trade_date", "yyyyMMdd"))
    raw = m.bars.select(F.col("code").alias("ts_code"), text.alias("trade_date"), "open", "high", "low", "close", F.col("volume").alias("vol"))
    return ven.to_house(raw, RECORDS["raw_daily"])


@query("chinese_headers", "select code, trade_date, close, volume, amount from bars", "bars")
def chinese_headers(m):
    back = {v: k for k, v in ven.CHINESE_HEADERS.items() if v != "datetime"}
    raw = m.bars.withColumn("trade_date", F.col("trade_date").cast("string")).withColumnsRenamed({c: back[c] for c in m.bars.columns if c in back})
    return ven.from_chinese_headers(raw).select("code", "trade_date", "close", "volume", "amount")


@query("market_suffix", """select p_partkey, case when t like '6%' then concat(t, '.SH') when t like '0%' or t like '3%' then concat(t, '.SZ') when t like '4%' or t like '8%' then concat(t, '.BJ') else t end as code, t as ticker
  from (select p_partkey, right(concat('000000', cast(p_partkey * 7919 % 1000000 as varchar)), 6) as t from part)""")
def market_suffix(m):
    t = F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "0")
    df = m.table("part").select("p_partkey", col.to_market(t).alias("code"))
    return df.withColumn("ticker", col.strip_market(F.col("code")))


@query("compact_dates", "select s, case when length(s) = 8 then cast(strptime(s, '%Y%m%d') as date) end as d, count(*) as n from (select case when o_orderkey % 5 = 0 then 'bad' else strftime(o_orderdate, '%Y%m%d') end as s from orders) group by 1, 2")
def compact_dates(m):
    s = F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    df = m.table("orders").select(s.alias("s"))
    return df.groupBy("s", col.parse_compact_date(F.col("s")).alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("industry_tree", """with l3 as (select distinct concat(c_nationkey, '-', c_mktsegment) as l3_code, c_mktsegment as l3_name, cast(c_nationkey as varchar) as parent from customer),
 l2 as (select cast(n_nationkey as varchar) as ic, concat('L2', n_nationkey) as l2_code, n_name as l2_name, cast(n_regionkey as varchar) as parent from nation where n_nationkey % 7 <> 3),
 l1 as (select cast(r_regionkey as varchar) as ic, concat('L1', r_regionkey) as l1_code, r_name as l1_name from region where r_regionkey <> 4),
 mb as (select concat('C', c_custkey % 700) as code, concat(c_nationkey, '-', c_mktsegment) as l3_code, row_number() over (partition by c_custkey % 700 order by c_custkey desc) as r from customer)
 select code, l1_code, l1_name, l2_code, l2_name, l3_code, l3_name from mb join l3 using (l3_code) left join l2 on l2.ic = l3.parent left join l1 on l1.ic = l2.parent where r = 1""")
def industry_tree(m):
    c = m.table("customer")
    key = F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment")
    l3 = c.select(key.alias("index_code"), F.col("c_mktsegment").alias("industry_name"), F.col("c_nationkey").cast("string").alias("parent_code")).distinct()
    n, r = m.table("nation").where("n_nationkey % 7 <> 3"), m.table("region").where("r_regionkey <> 4")
    l2 = n.select(F.col("n_nationkey").cast("string").alias("industry_code"), F.concat(F.lit("L2"), "n_nationkey").alias("index_code"), F.col("n_name").alias("industry_name"), F.col("n_regionkey").cast("string").alias("parent_code"))
    l1 = r.select(F.col("r_regionkey").cast("string").alias("industry_code"), F.concat(F.lit("L1"), "r_regionkey").alias("index_code"), F.col("r_name").alias("industry_name"))
    members = c.select(F.concat(F.lit("C"), (F.col("c_custkey") % 700).cast("string")).alias("code"), key.alias("l3_code"), F.col("c_custkey").alias("seq"))
    return ven.flatten_industry(l1, l2, l3, members)


@query("lifecycle_union", """select concat('O', o_orderkey) as code, case o_orderstatus when 'F' then 'D' when 'O' then 'L' else 'P' end as list_status, cast(o_orderdate as date) as list_date,
  case when o_orderstatus = 'F' then cast(o_orderdate as date) + 30 end as delist_date from orders""")
def lifecycle_union(m):
    o = m.table("orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    base = lambda s: o.where(F.col("o_orderstatus") == s).select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("code"), day.alias("list_date"), "o_orderdate")
    gone = base("F").withColumn("delist_date", F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyyMMdd"))
    return ven.lifecycle_union({"D": gone, "L": base("O"), "P": base("P")}).drop("o_orderdate")


@query("clean_keys", "select l_linestatus as line, coalesce(case when l_returnflag <> 'N' then l_returnflag end, '-') as org, cast(l_linenumber as varchar) as side, count(*) as n from lineitem group by all")
def clean_keys(m):
    df = m.table("lineitem").select(F.col("l_linestatus").alias("line"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("org"), F.col("l_linenumber").alias("side"))
    return ven.clean_keys(df, ("org",), ("side",)).groupBy("line", "org", "side").agg(F.count(F.lit(1)).alias("n"))


BOARDS = "select p_brand as board_code, max(p_name) as board_name, null::bigint as member_count, null::date as list_date, 'ts' as src from part group by 1"


def board_sources(m):
    p = m.table("part")
    primary = p.groupBy(F.col("p_type").alias("ts_code")).agg(F.max("p_name").alias("name"), F.count(F.lit(1)).alias("count")).withColumn("list_date", F.lit(None).cast("date"))
    return primary, p.groupBy(F.col("p_brand").alias("code")).agg(F.max("p_name").alias("name"))


@query("concept_boards", "select p_type as board_code, max(p_name) as board_name, count(*) as member_count, null::date as list_date, 'ths' as src from part group by 1")
def concept_boards(m):
    return ven.concept_boards(*board_sources(m))


@query("concept_boards_fallback", BOARDS)
def concept_boards_fallback(m):
    primary, fallback = board_sources(m)
    return ven.concept_boards(primary.where("count < 0"), fallback)


@query("concept_members", "select p_brand as board_code, concat('P', p_partkey) as code, p_name as name, p_retailprice as weight from part")
def concept_members(m):
    df = m.table("part").select(F.col("p_brand").alias("board_code"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("con_code"), F.col("p_name").alias("con_name"), F.col("p_retailprice").alias("weight"), "p_size")
    return ven.concept_members(df, {"con_code": "code", "con_name": "name"})


# --- incremental loading -----------------------------------------------------

LIFE = """life as (select concat('N', lpad(cast(n_nationkey as varchar), 2, '0')) as code, date '1994-01-01' + 90 * n_nationkey as list_date, case when n_nationkey % 5 = 2 then date '1997-01-06' + 30 * n_nationkey end as delist_date from nation where n_nationkey <> 9)"""


def life(m):
    from tapeloom.sources.market_views import nation_code

    k = F.col("n_nationkey")
    return m.table("nation").where("n_nationkey <> 9").select(
        nation_code("n_nationkey").alias("code"), F.date_add(F.lit("1994-01-01").cast("date"), 90 * k).alias("list_date"),
        F.when(k % 5 == 2, F.date_add(F.lit("1997-01-06").cast("date"), 30 * k)).alias("delist_date"))


WINDOWS = LIFE + """, win as (select code, greatest(date '1998-06-01', coalesce(list_date, date '1998-06-01')) as s, least(date '2001-06-30', coalesce(delist_date, date '2001-06-30')) as e
  from (select distinct code from bars) left join life using (code)), wn as (select code, s as "start", e as "end" from win where s <= e)"""


@query("effective_windows", f"with {WINDOWS} select * from wn", "bars")
def effective_windows(m):
    return sync.effective_windows(m.bars.select("code"), life(m), "1998-06-01", "2001-06-30")


@query("missing_ranges", f"""with {WINDOWS}, loc as (select code, min(trade_date) as f, max(trade_date) as l from bars where trade_date between date '1999-01-01' and date '2000-06-30' and code < 'N18' group by 1)
  select code, 'whole' as kind, "start" as from_date, "end" as to_date from wn where code not in (select code from loc)
  union all select code, 'backfill', "start", f - 1 from wn join loc using (code) where "start" < f union all select code, 'forward', l + 1, "end" from wn join loc using (code) where l + 1 <= "end" and l + 1 <= date '2001-12-31'""", "bars")
def missing_ranges(m):
    local = tab.date_ranges(m.bars.where(F.col("trade_date").between("1999-01-01", "2000-06-30") & (F.col("code") < "N18")), ["code"])
    return sync.missing_ranges(effective_windows(m), local, "2001-12-31")


@query("table_sync_plan", """with t as (select 'bars' as tbl, max(trade_date) as d from bars union all select 'moneyflow', max(trade_date) from moneyflow where year(trade_date) < 2001 union all select 'news', max(trade_date) from news_raw)
  select tbl as "table", case when d >= date '2000-01-01' then d + 1 else date '2000-01-01' end as "start", date '2001-10-29' as "end" from t where case when d >= date '2000-01-01' then d + 1 else date '2000-01-01' end <= date '2001-10-29'""", "bars moneyflow news_raw")
def table_sync_plan(m):
    last = lambda df, n: df.agg(F.lit(n).alias("table"), F.max("trade_date").alias("last_date"))
    dates = last(m.bars, "bars").unionByName(last(m.moneyflow.where(F.year("trade_date") < 2001), "moneyflow")).unionByName(last(m.news_raw, "news"))
    return sync.table_plan(dates, "2000-01-01", "2001-10-29")


ENDING = "ending as (select code, trade_date from bars where trade_date <= date '2001-10-29' - 7 * (cast(substr(code, 2) as integer) % 5))"


@query("stale_codes", f"""with {ENDING} select code, last_date, cast(date_diff('day', last_date, date '2001-11-05') as integer) as age from (select code, max(trade_date) as last_date from ending group by 1) where date_diff('day', last_date, date '2001-11-05') >= 21""", "bars")
def stale_codes(m):
    end = F.date_sub(F.lit("2001-10-29").cast("date"), 7 * (F.substring("code", 2, 9).cast("int") % 5))
    ending = m.bars.where(F.col("trade_date") <= end)
    return sync.stale_codes(ending.groupBy("code").agg(F.max("trade_date").alias("last_date")), "2001-11-05", 21)


# --- prices -------------------------------------------------------------------

def _adj_sql(fn: str, how: str) -> str:
    return f"""with j as (select b.*, a.adj_factor from bars b {how} join (select * from adj_factor where year(trade_date) <> 1999) a using (code, trade_date)),
      k as (select *, coalesce(adj_factor / {fn}(adj_factor ignore nulls) over (partition by code order by trade_date rows between unbounded preceding and unbounded following), 1) as q from j)
      select code, trade_date, open * q as open, high * q as high, low * q as low, close * q as close from k"""


for _name, _mode, _fn, _how in (("adjust_qfq", "qfq", "last_value", "left"), ("adjust_hfq", "hfq", "first_value", "left"), ("adjust_vendor", "qfq", "last_value", "inner")):

    @query(_name, _adj_sql(_fn, _how), "bars adj_factor")
    def adjusted(m, mode=_mode, how=_how):
        f = m.adj_factor.where(F.year("trade_date") != 1999)
        return pan.adjust_prices(m.bars, f, mode, how == "left").select("code", "trade_date", "open", "high", "low", "close")


@query("load_klines_adjusted", """with w as (select * from bars where code = 'N07' and trade_date between date '1998-01-01' and date '2000-12-31'), j as (select w.*, adj_factor from w left join adj_factor using (code, trade_date)),
  k as (select *, coalesce(adj_factor / last_value(adj_factor ignore nulls) over (order by trade_date rows between unbounded preceding and unbounded following), 1) as q from j) select code, trade_date, close * q as close from k""", "bars adj_factor")
def load_klines_adjusted(m):
    m = m.between("1998-01-01", "2000-12-31")
    raw = tab.load(m.bars, "N07", "1998-01-01", "2000-12-31")
    return pan.adjust_prices(raw, m.adj_factor, "qfq").select("code", "trade_date", "close")


FACTS = """facts as (select code, max(trade_date) + 30 as ann_date, sum(volume) as revenue from bars group by code, date_trunc('quarter', trade_date))"""


@query("fundamentals_as_of", f"""with {FACTS} select b.code, b.trade_date, (select arg_max(f.revenue, f.ann_date) from facts f where f.code = b.code and f.ann_date < b.trade_date) as revenue,
  (select max(f.ann_date) from facts f where f.code = b.code and f.ann_date < b.trade_date) as ann_date from bars b""", "bars")
def fundamentals_as_of(m):
    q = m.bars.groupBy("code", F.trunc("trade_date", "quarter").alias("q")).agg(F.date_add(F.max("trade_date"), 30).alias("ann_date"), F.sum("volume").alias("revenue"))
    return pan.as_of(m.bars.select("code", "trade_date"), q.drop("q"), "code", "trade_date", "ann_date", ["revenue", "ann_date"], strict=True)


@query("zscore_by_asset_class", f"""with idx as (select l1_code as code, trade_date, avg(open) as open, avg(high) as high, avg(low) as low, avg(close) as close from bars join industry using (code) group by 1, 2),
  panel as (select 'stock' as asset, code, trade_date, open, high, low, close from bars union all select 'index', code, trade_date, open, high, low, close from idx),
  {PRICE.replace('select code,', 'select asset, code,')}, x as (select asset, code, trade_date, {', '.join(f'lag({c}) over w as {c}' for c in feat.PRICE.columns)} from f {W})
  select asset, code, trade_date, {', '.join(z_sql(c, 'asset, trade_date') for c in feat.PRICE.columns)} from x""", "bars industry")
def zscore_by_asset_class(m):
    one = m.bars.join(m.industry, "code").groupBy(F.col("l1_code").alias("code"), "trade_date").agg(*[F.avg(c).alias(c) for c in ("open", "high", "low", "close")])
    index_panel = pan.index_as_panel(one, m.panel.columns)
    stocks = feat.compute_features(m.bars, (feat.PRICE,)).withColumn("asset", F.lit("stock"))
    both = stocks.unionByName(feat.compute_features(index_panel, (feat.PRICE,)).withColumn("asset", F.lit("index")))
    z = feat.zscore_by_day(both, feat.PRICE.columns, keys=("asset", "trade_date"))
    return z.select("asset", "code", "trade_date", *[r6(c).alias(c) for c in feat.PRICE.columns])


@query("industry_map", "select code, l1_code, l1_name from industry", "industry")
def industry_map(m):
    return m.industry


@query("industry_tokens", """select i.code, coalesce(k.idx, 0) as industry_idx from (select distinct code from bars) c join industry i using (code)
  left join (select l1_code, cast(row_number() over (order by l1_code) as bigint) as idx from (select distinct l1_code from industry where l1_code <> 'R3')) k on k.l1_code = i.l1_code""", "bars industry")
def industry_tokens(m):
    from pyspark.sql import Window

    known = m.industry.where("l1_code <> 'R3'").select("l1_code").distinct()
    idx = known.select("l1_code", F.row_number().over(Window.orderBy("l1_code")).cast("bigint").alias("idx"))
    codes = m.bars.select("code").distinct().join(m.industry, "code")
    return codes.join(idx, "l1_code", "left").select("code", F.coalesce("idx", F.lit(0)).alias("industry_idx"))
