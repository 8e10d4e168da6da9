"""The daily job as one incremental plan over stored feature days.

A run takes the codes that may be traded on its day, reads one year of their panel, computes the features and
stores the day alone. Its audit reads the days that earlier runs stored, so no history is computed
twice. The store keeps a day's versions apart, so a run that dies or is run again leaves no mixed day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from tapeloom.operators.audit import Rule, audit_report, feature_day_stats, rolling_thresholds, rule_frame
from tapeloom.operators.calendar import inclusive
from tapeloom.operators.features import ALL_SOURCES, FEATURES, attach_mentions, compute_features
from tapeloom.operators.panel import attach_forward_adjusted
from tapeloom.operators.universe import eligible_codes
from tapeloom.sources.day_store import DayStore

#: (start, end) -> panel rows of an inclusive range; the range should reach the scan.
PanelReader = Callable[[dt.date, dt.date], DataFrame]
FEATURE_SCHEMA = StructType([
    StructField("code", StringType()), StructField("trade_date", DateType()), *[StructField(c, DoubleType()) for c in FEATURES],
])


def year_before(day: dt.date) -> dt.date:
    """Where a run's panel starts: the same date a year ago; in January and February, when that would leave few
    rows before the turn of the year, the first of January of the year before."""
    return day.replace(year=day.year - 1) if day.month > 2 else dt.date(day.year - 1, 1, 1)


def feature_days(spark: SparkSession, path: str) -> DayStore:
    return DayStore(spark, path, FEATURE_SCHEMA)


def day_features(panel: PanelReader, lifecycle: DataFrame, industry: DataFrame, mentions: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Features of ``start`` to ``end`` for the codes eligible on ``end``, from a panel that begins a year before."""
    rows = panel(year_before(start), end)
    codes = eligible_codes(panel(end, end), lifecycle)
    held = attach_forward_adjusted(rows.join(codes, "code", "left_semi"))
    feats = compute_features(attach_mentions(held, industry, mentions), ALL_SOURCES)
    return inclusive(feats, start, end)


def backfill(store: DayStore, version: int, panel: PanelReader, lifecycle: DataFrame, industry: DataFrame, mentions: DataFrame, start: dt.date, end: dt.date) -> None:
    """Store all days of a range in one pass, for a store that has no history yet."""
    store.write(day_features(panel, lifecycle, industry, mentions, start, end), version)


def daily_run(
    store: DayStore, version: int, day: dt.date, panel: PanelReader, lifecycle: DataFrame, industry: DataFrame, mentions: DataFrame,
    rules: list[Rule],
) -> tuple[DataFrame, DataFrame]:
    """Compute and store ``day``; its statistics per feature and its audit report.

    Thresholds come from the stored days up to ``day``, this one included.
    """
    feats = day_features(panel, lifecycle, industry, mentions, day, day)
    store.write(feats, version)
    known = store.read(day - dt.timedelta(days=366), day, upto=version)
    columns = [r.feature for r in rules]
    thresholds = rolling_thresholds(known, day, columns)
    today = inclusive(known, day, day)
    stats = feature_day_stats(today, day, rule_frame(known.sparkSession, rules), columns, thresholds)
    return stats, audit_report(stats)
