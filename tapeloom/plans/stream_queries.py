"""Streaming queries, run to completion over the files and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.columns import r6
from tapeloom.plans.feature_queries import W, ewm
from tapeloom.plans.registry import query
from tapeloom.schemas import Record
from tapeloom.session import scratch_dir
from tapeloom.sources.day_store import DayStore
from tapeloom.streaming import jobs


def events(m):
    schema = m.table("events").schema
    return jobs.read_files(m.spark, m.folder, schema, "events.parquet")


def counters(m):
    return events(m).select(
        F.col("event_id").cast("string").alias("event_id"), "ts", F.concat(F.lit("pipeline/"), "event_type").alias("scope"), F.lit("value").alias("name"), "value",
        F.col("user_id").cast("string").alias("run_id"))


CLOSED = "(select max(ts) from events) - interval 10 minute"


@query("stream_counter_kpis", f"""select * from (select date_trunc('hour', ts) as window_start, concat('pipeline/', event_type) as scope, 'value' as name, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean from events group by 1, 2)
 where window_start + interval 1 hour <= {CLOSED}""")
def stream_counter_kpis(m):
    out = jobs.run_to_files(jobs.counter_kpis(counters(m)), "counter-kpis")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "scope", "name", "n", r6("total", 4).alias("total"), r6("mean").alias("mean"))


def ticks(m):
    return events(m).select(F.concat(F.lit("E"), (F.col("user_id") % 10).cast("string")).alias("code"), "ts", F.col("value").alias("price"), F.lit(1).cast("bigint").alias("volume"), F.col("event_id").alias("seq"))


for _size, _minutes in (("15 minutes", 15), ("1 hour", 60)):

    @query(f"stream_bars_{_minutes}m", f"""select * from (select time_bucket(interval {_minutes} minute, ts) as bar_start, concat('E', user_id % 10) as code, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close,
      count(*) as volume from events group by 1, 2) where bar_start + interval {_minutes} minute <= {CLOSED}""")
    def stream_bars(m, size=_size):
        out = jobs.run_to_files(jobs.ohlcv_bars(ticks(m), size), "bars")
        return out.withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


@query("stream_bars_sliding", f"""select * from (select time_bucket(interval 60 minute, ts) - to_minutes(cast(30 * o as integer)) + case when o = -1 then interval 0 minute else interval 0 minute end as bar_start, concat('E', user_id % 10) as code, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low,
   arg_max(value, (ts, event_id)) as close, count(*) as volume from (select e.*, o from events e, (select unnest([-1, 0, 1]) as o) where ts >= time_bucket(interval 60 minute, ts) - to_minutes(cast(30 * o as integer)) and ts < time_bucket(interval 60 minute, ts) - to_minutes(cast(30 * o as integer)) + interval 60 minute) group by 1, 2)
 where bar_start + interval 60 minute <= {CLOSED}""")
def stream_bars_sliding(m):
    out = jobs.run_to_files(jobs.ohlcv_bars(ticks(m), "1 hour", "30 minutes"), "bars-sliding")
    return out.withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


@query("stream_run_sessions", f"""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts) as k from g)
 select * from (select cast(user_id as varchar) as run_id, min(ts) as session_start, max(ts) + interval 2 hour as session_end, count(*) as n, round(sum(value), 4) as total from s group by user_id, k) where session_end <= {CLOSED}""")
def stream_run_sessions(m):
    out = jobs.run_to_files(jobs.run_sessions(counters(m)), "sessions")
    return out.select("run_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n", r6("total", 4).alias("total"))


@query("stream_drop_repeats", "select event_id, ts, value from events")
def stream_drop_repeats(m):
    twice = events(m)
    twice = twice.unionByName(jobs.read_files(m.spark, m.folder, m.table("events").schema, "events.parquet"))
    out = jobs.run_to_files(jobs.drop_repeats(twice), "repeats")
    return out.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


@query("stream_recursive_indicators", f"""with a as (select *, close / lag(close) over w - 1 as ch, row_number() over w as n from bars {W}), b as (select *, coalesce(ch > 0, false) as up, coalesce(ch >= 0.095, false) as jump from a)
 select code, trade_date, round({ewm('close', '1.0/12')}, 3) as ewm, cast(n - coalesce(max(case when not up then n end) over v, 0) as integer) as streak, cast(least(coalesce(n - max(case when jump then n end) over v, 60), 60) as integer) as since
 from b window v as (partition by code order by trade_date rows unbounded preceding)""", "bars")
def stream_recursive_indicators(m):
    folder = scratch_dir(m.spark, "bars")
    # two halves of the calendar, each written by several tasks and then read as one micro-batch, so
    # that state crosses batches: files are taken oldest first, and a half has no more than a batch takes
    bars, files = m.bars.select("code", "trade_date", "close"), 4
    middle = m.calendar.select(F.expr("date_add(min(trade_date), int(datediff(max(trade_date), min(trade_date)) / 2))")).scalar()
    for half in (F.col("trade_date") <= middle, F.col("trade_date") > middle):
        bars.where(half).repartition(files, "code").sortWithinPartitions("code", "trade_date").write.mode("append").parquet(folder)
    stream = jobs.read_files(m.spark, folder, bars.schema, files_per_batch=files)
    out = jobs.with_rocksdb(m.spark, lambda: jobs.run_to_files(jobs.recursive_indicators(stream), "recursive"))
    return out.withColumn("ewm", r6("ewm", 3))


MONTH_PRICE = Record("month_prices", ("code", "trade_date"), "code string, trade_date date, price double, orderkey long")


@query("stream_upsert", """select code, trade_date, price, orderkey from (select *, row_number() over (partition by code, trade_date order by batch desc, seq desc, price desc, orderkey desc) as r
 from (select concat('P', l_partkey % 200) as code, cast(date_trunc('month', l_shipdate) as date) as trade_date, l_extendedprice as price, l_orderkey as orderkey, l_orderkey % 1000 as seq, l_linenumber % 3 as batch from lineitem)) where r = 1""")
def stream_upsert(m):
    """Three batches of rows with repeated keys go into one table, each in the order of its own sequence;
    then all of them are delivered once more, from a fresh checkpoint."""
    store = DayStore(m.spark, scratch_dir(m.spark, "month_prices"), MONTH_PRICE.schema)
    key = F.col("l_orderkey")
    rows = m.table("lineitem").select(
        F.concat(F.lit("P"), (F.col("l_partkey") % 200).cast("string")).alias("code"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("trade_date"),
        F.col("l_extendedprice").alias("price"), key.alias("orderkey"), (key % 1000).alias("seq"), (F.col("l_linenumber") % 3).alias("batch"))
    parts = [rows.where(F.col("batch") == k).drop("batch") for k in range(3)]
    for _ in range(2):
        jobs.upsert_in_parts(parts, store, MONTH_PRICE, "prices", "seq")
    return store.read()


# --- late and repeated rows over several runs -------------------------------------------------

#: Events arrive in three parts by their time. Every 20th comes one part late, unless it is within three hours of
#: the part's end, every 25th twice and every 30th again with the next part.
PARTS = ("2024-01-11", "2024-01-21")
ARRIVALS = f"""home as (select *, case when ts < timestamp '{PARTS[0]}' then 0 when ts < timestamp '{PARTS[1]}' then 1 else 2 end as home from events),
 own as (select * exclude (home), case when event_id % 20 = 0 and home = 0 and ts < timestamp '{PARTS[0]}' - interval 3 hour then 1
   when event_id % 20 = 0 and home = 1 and ts < timestamp '{PARTS[1]}' - interval 3 hour then 2 else home end as part, home from home),
 arrived as (select event_id, user_id, ts, event_type, value, part from own union all select event_id, user_id, ts, event_type, value, part from own where event_id % 25 = 1
   union all select event_id, user_id, ts, event_type, value, part + 1 from own where event_id % 30 = 2 and part < 2 and ts < (case part when 0 then timestamp '{PARTS[0]}' else timestamp '{PARTS[1]}' end) - interval 3 hour),
 marks as (select p, (select max(ts) from arrived where part < p) - interval 10 minute as mark from (select unnest([0, 1, 2]) as p)),
 timed as (select a.*, mark from arrived a join marks on p = part)"""
LAST_MARK = "(select max(ts) from arrived) - interval 10 minute"


def arrivals(m):
    """The parts in which the events arrive."""
    e = m.table("events").select("event_id", "user_id", "ts", "event_type", "value")
    ends = [F.lit(p).cast("timestamp_ntz") for p in PARTS]
    home = F.when(F.col("ts") < ends[0], 0).when(F.col("ts") < ends[1], 1).otherwise(2)
    end = F.when(F.col("home") == 0, ends[0]).when(F.col("home") == 1, ends[1])
    early = F.coalesce(F.col("ts") < end - F.expr("interval 3 hours"), F.lit(False))
    own = e.withColumn("home", home).withColumn("early", early)
    own = own.withColumn("part", F.col("home") + F.when((F.col("event_id") % 20 == 0) & F.col("early"), 1).otherwise(0))
    due = F.when(F.col("part") == 0, ends[0]).when(F.col("part") == 1, ends[1])
    again = own.where(F.col("event_id") % 25 == 1)
    later = own.where((F.col("event_id") % 30 == 2) & (F.col("part") < 2) & (F.col("ts") < due - F.expr("interval 3 hours"))).withColumn("part", F.col("part") + 1)
    whole = own.unionByName(again).unionByName(later).drop("home", "early")
    return [whole.where(F.col("part") == k).drop("part") for k in range(3)]


def as_counters(events):
    return events.select(
        F.col("event_id").cast("string").alias("event_id"), "ts", F.concat(F.lit("pipeline/"), "event_type").alias("scope"), F.lit("value").alias("name"), "value",
        F.col("user_id").cast("string").alias("run_id"))


@query("stream_late_kpis", f"""with {ARRIVALS} select date_trunc('hour', ts) as window_start, concat('pipeline/', event_type) as scope, 'value' as name, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean
 from timed where mark is null or date_trunc('hour', ts) + interval 1 hour > mark group by 1, 2 having date_trunc('hour', any_value(ts)) + interval 1 hour <= {LAST_MARK}""")
def stream_late_kpis(m):
    out = jobs.run_in_parts(arrivals(m), lambda e: jobs.counter_kpis(as_counters(e)), "late-kpis")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "scope", "name", "n", r6("total", 4).alias("total"), r6("mean").alias("mean"))


@query("stream_late_bars", f"""with {ARRIVALS} select time_bucket(interval 15 minute, ts) as bar_start, concat('E', user_id % 10) as code, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*) as volume
 from timed where mark is null or time_bucket(interval 15 minute, ts) + interval 15 minute > mark group by 1, 2 having time_bucket(interval 15 minute, any_value(ts)) + interval 15 minute <= {LAST_MARK}""")
def stream_late_bars(m):
    def bars(e):
        ticks = e.select(F.concat(F.lit("E"), (F.col("user_id") % 10).cast("string")).alias("code"), "ts", F.col("value").alias("price"), F.lit(1).cast("bigint").alias("volume"), F.col("event_id").alias("seq"))
        return jobs.ohlcv_bars(ticks, "15 minutes")

    return jobs.run_in_parts(arrivals(m), bars, "late-bars").withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


@query("stream_late_sessions", f"""with {ARRIVALS}, g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as fresh from timed where mark is null or ts + interval 2 hour > mark),
 s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
 select * from (select cast(user_id as varchar) as run_id, min(ts) as session_start, max(ts) + interval 2 hour as session_end, count(*) as n, round(sum(value), 4) as total from s group by user_id, k) where session_end <= {LAST_MARK}""")
def stream_late_sessions(m):
    out = jobs.run_in_parts(arrivals(m), lambda e: jobs.run_sessions(as_counters(e)), "late-sessions")
    return out.select("run_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n", r6("total", 4).alias("total"))


@query("stream_late_repeats", f"with {ARRIVALS} select distinct event_id, ts, value from timed where mark is null or ts > mark")
def stream_late_repeats(m):
    out = jobs.run_in_parts(arrivals(m), lambda e: jobs.drop_repeats(e, delay="10 minutes"), "late-repeats")
    return out.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
