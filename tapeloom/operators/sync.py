"""Which dates still have to be loaded, decided as joins over per-code date ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective_windows(codes: DataFrame, lifecycle: DataFrame, start, end) -> DataFrame:
    """Requested window cut to the listing period; codes whose window is empty drop out. A code
    without a lifecycle row keeps the request. ``greatest``/``least`` skip NULLs as wanted."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    df = codes.select("code").distinct().join(lifecycle.select("code", "list_date", "delist_date"), "code", "left")
    out = df.select("code", F.greatest(s, F.col("list_date")).alias("start"), F.least(e, F.col("delist_date")).alias("end"))
    return out.where(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") <= F.col("end")))


def missing_ranges(windows: DataFrame, local: DataFrame, today) -> DataFrame:
    """Per code up to two ranges: before the first local date and after the last one, the latter
    not past ``today``; the whole window when nothing is local."""
    t = F.lit(today).cast("date")
    df = windows.join(local.select("code", "first_date", "last_date"), "code", "left")
    after = F.date_add("last_date", 1)
    whole = F.when(F.col("first_date").isNull(), F.struct(F.lit("whole").alias("kind"), F.col("start").alias("from_date"), F.col("end").alias("to_date")))
    back = F.when(F.col("start") < F.col("first_date"), F.struct(F.lit("backfill").alias("kind"), F.col("start").alias("from_date"), F.date_sub("first_date", 1).alias("to_date")))
    forward = F.when((after <= F.coalesce("end", t)) & (after <= t), F.struct(F.lit("forward").alias("kind"), after.alias("from_date"), F.col("end").alias("to_date")))
    ranges = F.filter(F.array(whole, back, forward), lambda r: r.isNotNull())
    return df.select("code", F.explode(ranges).alias("r")).select("code", "r.*")


def table_plan(last_dates: DataFrame, start, end) -> DataFrame:
    """Start date per table; tables that already reach ``end`` drop out."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    first = F.when(F.col("last_date") >= s, F.date_add("last_date", 1)).otherwise(s)
    return last_dates.select("table", first.alias("start"), e.alias("end")).where(F.col("start") <= F.col("end"))


def stale_codes(marks: DataFrame, today, days: int) -> DataFrame:
    """Codes whose newest date is at least ``days`` old."""
    age = F.datediff(F.lit(today).cast("date"), F.col("last_date"))
    return marks.withColumn("age", age).where(F.col("age") >= days)
