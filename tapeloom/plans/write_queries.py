"""What is written and read back: replaced tables and days, report files, and the choices of industry level and universe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.columns import last_weekday
from tapeloom.operators import panel as pan
from tapeloom.operators import universe as uni
from tapeloom.plans.registry import query
from tapeloom.session import scratch_dir
from tapeloom.sources import tables as tab


@query("replaced_table", "select code, trade_date, volume from bars where year(trade_date) = 1999", "bars")
def replaced_table(m):
    """A table is written whole, then replaced whole by other rows."""
    path, rows = scratch_dir(m.spark, "whole"), m.bars.select("code", "trade_date", "volume")
    tab.replace_table(rows.where(F.year("trade_date") == 1998), path)
    tab.replace_table(rows.where(F.year("trade_date") == 1999), path)
    return m.spark.read.schema(rows.schema).parquet(path)


@query("replaced_days", """select code, trade_date, case when month(trade_date) = 3 then volume + 1 else volume end as volume from bars
  where trade_date between date '1998-02-01' and date '1998-04-30' and not (month(trade_date) = 3 and code >= 'N20')""", "bars")
def replaced_days(m):
    """Days of a stored table are replaced, each as a whole, and a range of days is read back as one table."""
    path = scratch_dir(m.spark, "days")
    rows = m.between("1998-01-01", "1998-12-31").bars.select("code", "trade_date", "volume")
    tab.replace_days(rows, path)
    tab.replace_days(rows.where((F.month("trade_date") == 3) & (F.col("code") < "N20")).withColumn("volume", F.col("volume") + 1), path)
    stored = m.spark.read.schema(rows.schema).parquet(path)
    return stored.where(F.col("trade_date").between("1998-02-01", "1998-04-30")).select("code", "trade_date", "volume")


@query("report_files", """select format, code, days, volume from (select code, count(*) as days, cast(sum(volume) as bigint) as volume from bars group by 1), (select unnest(['csv', 'json', 'parquet']) as format)""", "bars")
def report_files(m):
    """One report as CSV, JSON and Parquet, read back from the files."""
    path = scratch_dir(m.spark, "reports")
    report = m.bars.groupBy("code").agg(F.count(F.lit(1)).alias("days"), F.sum("volume").cast("long").alias("volume"))
    parts = []
    for fmt in ("csv", "json", "parquet"):
        tab.write_report(report, f"{path}/{fmt}", fmt)
        reader = m.spark.read.schema(report.schema)
        files = reader.csv(f"{path}/csv", header=True) if fmt == "csv" else reader.format(fmt).load(f"{path}/{fmt}")
        parts.append(files.select(F.lit(fmt).alias("format"), "code", "days", "volume"))
    return reduce(DataFrame.unionByName, parts)


LEVELS = """tree as (select concat('N', lpad(cast(n_nationkey as varchar), 2, '0')) as code, concat('R', n_regionkey) as l1_code, r_name as l1_name,
  concat('R', n_regionkey, '.', n_nationkey % 2) as l2_code, concat(r_name, ' ', n_nationkey % 2) as l2_name, concat('N', n_nationkey) as l3_code, n_name as l3_name from nation join region on n_regionkey = r_regionkey)"""


@query("industry_levels", f"with {LEVELS} " + " union all ".join(f"select {k} as level, code, l{k}_code as ind_code, l{k}_name as ind_name from tree" for k in (1, 2, 3)))
def industry_levels(m):
    n, r = m.table("nation"), m.table("region")
    half = (F.col("n_nationkey") % 2).cast("string")
    tree = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"),
        F.concat(F.lit("R"), "n_regionkey").alias("l1_code"), F.col("r_name").alias("l1_name"),
        F.concat(F.lit("R"), "n_regionkey", F.lit("."), half).alias("l2_code"), F.concat("r_name", F.lit(" "), half).alias("l2_name"),
        F.concat(F.lit("N"), "n_nationkey").alias("l3_code"), F.col("n_name").alias("l3_name"))
    parts = [uni.industry_map(tree, k).select(F.lit(k).alias("level"), "code", "ind_code", "ind_name") for k in (1, 2, 3)]
    return reduce(DataFrame.unionByName, parts)


MODES = ("hs300", "zz500", "top_mv")
MODE_DAY = "2000-06-30"


@query("universe_modes", f"""with w as (select case l1_code when 'R0' then '000300.SH' else '000905.SH' end as ix, cast(date_trunc('month', trade_date) as date) as d, code from bars join industry using (code) where l1_code in ('R0', 'R1') group by all)
  select case ix when '000300.SH' then 'hs300' else 'zz500' end as mode, code from w where (ix, d) in (select (ix, max(d)) from w where d <= date '{MODE_DAY}' group by ix)
  union all select 'top_mv', code from (select code from daily_basic join stock_lifecycle using (code) where trade_date = (select max(trade_date) from daily_basic where trade_date <= date '{MODE_DAY}')
   and turnover_rate > 0 and circ_mv is not null and name not ilike 'st%' and name not ilike '*st%' and list_date < trade_date - 120 order by circ_mv desc, code limit 5)""", "bars industry daily_basic stock_lifecycle")
def universe_modes(m):
    index = F.when(F.col("l1_code") == "R0", uni.INDEX_MODES["hs300"]).when(F.col("l1_code") == "R1", uni.INDEX_MODES["zz500"])
    weights = m.bars.join(m.industry, "code").groupBy(index.alias("index_code"), F.trunc("trade_date", "month").alias("trade_date"), F.col("code").alias("con_code")).agg(F.count(F.lit(1)).alias("weight"))
    parts = [uni.select_universe(mode, m.daily_basic, m.stock_lifecycle, weights, 5, MODE_DAY).select(F.lit(mode).alias("mode"), "code") for mode in MODES]
    return reduce(DataFrame.unionByName, parts)


@query("panel_of_codes", "select code, trade_date, close, pe_ttm, net_mf_amount from panel where code in ('N03', 'N07', 'N11') and trade_date between date '1999-01-01' and date '1999-06-30'", "panel")
def panel_of_codes(m):
    """The frames of chosen codes as one read, not a union of reads."""
    m = m.between("1999-01-01", "1999-06-30")
    found = pan.build_panel(m.bars, m.daily_basic, m.moneyflow, m.adj_factor, ["N03", "N07", "N11"], "1999-01-01", "1999-06-30")
    return found.select("code", "trade_date", "close", "pe_ttm", "net_mf_amount")


@query("last_weekdays", "select day, case isodow(day) when 6 then day - 1 when 7 then day - 2 else day end as weekday from (select distinct cast(l_shipdate as date) as day from lineitem)")
def last_weekdays(m):
    days = m.table("lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    return days.select("day", last_weekday(F.col("day")).alias("weekday"))
