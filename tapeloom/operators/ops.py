"""Operational counters, gates and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_kpis(outcomes: DataFrame) -> DataFrame:
    """Per trade date: total duration and the success rate over stages that were not skipped."""
    ran = F.count_if(F.col("status") != "skipped")
    return outcomes.groupBy("trade_date").agg(
        F.sum("duration_s").alias("total_duration_s"), F.count(F.lit(1)).alias("n_stages"),
        F.count_if(F.col("status") == "ok").alias("n_ok"),
        F.coalesce(F.try_divide(F.count_if(F.col("status") == "ok"), ran), F.lit(0.0)).alias("success_rate"))


def ok_counts(events: DataFrame, tag: str, name: str = "ok", value: float = 1.0) -> DataFrame:
    """Successful runs per scope and tag value, the tag read from the JSON text."""
    return events.where((F.col("name") == name) & (F.col("value") == value)).groupBy(
        "scope", F.get_json_object("tags_json", f"$.{tag}").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def rows_gate(bars: DataFrame, days: DataFrame, min_rows: int = 4500) -> DataFrame:
    """Per day of ``days``: how many rows arrived and whether that is enough."""
    n = bars.join(days, "trade_date", "left_semi").groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    return days.join(n, "trade_date", "left").fillna(0, ["n"]).withColumn("ok", F.col("n") >= min_rows)


def calendar_gate(calendar: DataFrame, today, max_age: int = 30) -> DataFrame:
    age = F.datediff(F.lit(today).cast("date"), F.max("trade_date"))
    return calendar.agg(F.max("trade_date").alias("last_date"), age.alias("age_days"), F.coalesce(age <= max_age, F.lit(False)).alias("ok"))


def drift(runs: DataFrame, baseline: str = "anchor", current: str = "daily warm", limit_pct: float = 5.0) -> DataFrame:
    """Drop of the newest finished run of one note class against another, in percent."""
    note = F.when(F.col("note").contains(baseline), "base").when(F.col("note").contains(current), "now")
    newest = runs.where(F.col("status") == "done").withColumn("kind", note).where("kind is not null").groupBy("trainer").agg(*[
        F.max_by(F.when(F.col("kind") == k, F.col("best_metric")), F.when(F.col("kind") == k, F.struct("started_at", "run_id"))).alias(k)
        for k in ("base", "now")])
    drop = F.when(F.col("base") > 0, (F.col("base") - F.col("now")) / F.col("base") * 100)
    return newest.select("trainer", "base", "now", drop.alias("drop_pct"), F.coalesce(drop > limit_pct, F.lit(False)).alias("alarm"))


def health(checks: DataFrame) -> DataFrame:
    """Passed and total checks per source with mean and worst latency."""
    return checks.groupBy("source").agg(
        F.count_if("ok").alias("n_ok"), F.count(F.lit(1)).alias("total"), F.avg("latency_ms").alias("avg_latency"),
        F.max("latency_ms").alias("max_latency"))
