"""News text to industry mentions by a keyword dictionary.

The dictionary is configuration: (l1_code, l1_name, [keywords]) for some tens of industries,
kept small by ``lint_dictionary``. Texts are never concatenated per day: a word is present in
a day's text when it is present in one of its sections, so sections are matched where they
lie and only (day, word) pairs are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Entries = list[tuple[str, str, list[str]]]


def dictionary_frame(spark: SparkSession, entries: Entries) -> DataFrame:
    """(l1_code, l1_name, pos, keyword, n_keywords), one row per keyword."""
    rows = [
        (code, name, pos, kw, len(kws)) for code, name, kws in entries for pos, kw in enumerate(kws)
    ]
    return spark.createDataFrame(rows, "l1_code string, l1_name string, pos int, keyword string, n_keywords int")


def _present(text: Column, words: list[str]) -> Column:
    candidates = F.array(*[F.lit(w) for w in words])
    return F.filter(candidates, lambda w: F.contains(text, w))


def day_words(raw: DataFrame, entries: Entries) -> DataFrame:
    """Distinct (trade_date, keyword) pairs found in the sections of the day."""
    words = sorted({w for _, _, kws in entries for w in kws if w})
    found = raw.select("trade_date", F.explode(_present(F.col("content"), words)).alias("keyword"))
    return found.distinct()


def day_industry_hits(raw: DataFrame, entries: Entries) -> DataFrame:
    """(trade_date, l1_code, hits, matched): dictionary words present that day per industry."""
    dim = dictionary_frame(raw.sparkSession, entries)
    by_pos = F.array_sort(F.collect_list(F.struct("pos", "keyword")))
    return day_words(raw, entries).join(dim, "keyword").groupBy(
        "trade_date", "l1_code", "l1_name", "n_keywords"
    ).agg(
        F.count(F.lit(1)).alias("hits"),
        F.transform(by_pos, lambda s: s["keyword"]).alias("matched_keywords"),
    )


def day_summary(raw: DataFrame) -> DataFrame:
    """Sections and length of the day's text with one separator between non-empty sections."""
    n = F.length("content")
    filled = F.when(n > 0, 1)
    return raw.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        (F.coalesce(F.sum(F.when(n > 0, n)), F.lit(0))
         + F.greatest(F.count(filled) - 1, F.lit(0))).cast("bigint").alias("text_length"),
    )


def mentions(
    raw: DataFrame, entries: Entries, min_count: int = 1, threshold: float = 0.05
) -> DataFrame:
    """Mentioned industries per day: enough distinct words and a large enough share of the
    industry's dictionary."""
    score = F.col("hits") / F.greatest(F.col("n_keywords"), F.lit(1))
    return (
        day_industry_hits(raw, entries).withColumn("match_score", score)
        .where((F.col("hits") >= min_count) & (F.col("match_score") >= threshold))
        .withColumn("mentioned", F.lit(1))
    )


def _idf(days: Column, mentioned: Column) -> Column:
    return F.round(F.when(days < 10, 1.0).otherwise(F.ln(days / (mentioned + 1.0)) + 1.0), 4)


def _baseline(hits: DataFrame, days: DataFrame, spark: SparkSession, entries: Entries, keys: list[str]) -> DataFrame:
    """Per (keys, industry) document frequencies; every dictionary industry appears."""
    industries = F.explode(F.array(*[
        F.struct(F.lit(c).alias("l1_code"), F.lit(n).alias("l1_name")) for c, n, _ in entries
    ]))
    frame = days.select(*keys, "days_with_data", industries.alias("i")).select(*keys, "days_with_data", "i.*")
    counted = hits.groupBy(*keys, "l1_code").agg(
        F.count(F.lit(1)).alias("days_mentioned"), F.sum("hits").alias("mentions_total")
    )
    joined = frame.join(counted, [*keys, "l1_code"], "left").fillna(0, ["days_mentioned", "mentions_total"])
    return joined.select(
        *keys, "l1_code", "l1_name", "days_mentioned", "mentions_total",
        F.round(F.col("mentions_total") / F.greatest("days_with_data", F.lit(1)), 3).alias("mentions_per_day"),
        _idf(F.col("days_with_data"), F.col("days_mentioned")).alias("idf"),
    )


def baseline(raw: DataFrame, entries: Entries, start, end) -> DataFrame:
    """Document-frequency baseline over one inclusive window of days."""
    from tapeloom.operators.calendar import inclusive

    window = inclusive(raw, start, end)
    days = window.agg(F.count_distinct("trade_date").alias("days_with_data"))
    return _baseline(day_industry_hits(window, entries), days, raw.sparkSession, entries, [])


def _months_reached(lookback: int) -> Column:
    """Months m whose window [m - lookback, m - 1] contains the day."""
    first = F.add_months(F.trunc("trade_date", "month"), 1)
    last = F.trunc(F.date_add("trade_date", lookback), "month")
    return F.explode(F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))))


def monthly_baselines(raw: DataFrame, entries: Entries, lookback: int, start_month, end_month) -> DataFrame:
    """Point-in-time baselines, one per month, each over the days before the month. A day
    spells out the months it counts for, so no range join is needed."""
    wanted = F.col("month").between(F.lit(start_month).cast("date"), F.lit(end_month).cast("date"))
    hits = day_industry_hits(raw, entries).select("l1_code", "hits", _months_reached(lookback).alias("month")).where(wanted)
    seen = raw.select("trade_date").distinct().select(_months_reached(lookback).alias("month")).where(wanted)
    days = seen.groupBy("month").agg(F.count(F.lit(1)).alias("days_with_data"))
    return _baseline(hits, days, raw.sparkSession, entries, ["month"])


def with_idf(found: DataFrame, monthly: DataFrame, overall: DataFrame) -> DataFrame:
    """Add idf and weighted score: the month's own baseline, or the overall one when that month
    has no baseline at all. An industry a present baseline lacks keeps NULL."""
    months = monthly.select("month").distinct().withColumn("_has", F.lit(True))
    out = (
        found.withColumn("month", F.trunc("trade_date", "month"))
        .join(monthly.select("month", "l1_code", F.col("idf").alias("_pit")), ["month", "l1_code"], "left")
        .join(months, "month", "left")
        .join(overall.select("l1_code", F.col("idf").alias("_all")), "l1_code", "left")
    )
    idf = F.when(F.col("_has"), F.col("_pit")).otherwise(F.col("_all"))
    return out.withColumn("idf", idf).withColumn("weighted_score", F.col("match_score") * F.col("idf")).drop(
        "_pit", "_has", "_all", "month"
    )


def ingest_days(raw: DataFrame, entries: Entries, monthly: DataFrame, overall: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions with point-in-time weights and a per-day report, for all days at once."""
    found = with_idf(mentions(raw, entries), monthly, overall)
    per_day = found.groupBy("trade_date").agg(F.count(F.lit(1)).alias("mentions"))
    report = day_summary(raw).join(per_day, "trade_date", "left").fillna(0, ["mentions"])
    return found, report


def lint_dictionary(
    dim: DataFrame, min_keywords: int = 5, max_keywords: int = 40, max_industries: int = 2
) -> DataFrame:
    """Dictionary problems as (l1_code, issue, detail)."""
    per = dim.groupBy("l1_code").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("keyword").alias("d"),
        F.max(F.when(F.trim("keyword") == "", 1).otherwise(0)).alias("blank"),
    )
    issues = F.explode(F.filter(F.array(
        F.when(F.col("n") < min_keywords, F.lit("too_few")),
        F.when(F.col("n") > max_keywords, F.lit("too_many")),
        F.when(F.col("d") < F.col("n"), F.lit("duplicate")),
        F.when(F.col("blank") == 1, F.lit("empty_keyword")),
    ), lambda x: x.isNotNull()))
    own = per.select("l1_code", issues.alias("issue"), F.lit(None).cast("string").alias("detail"))
    shared = conflicts(dim).where(F.col("n_industries") > max_industries).select(
        F.lit("_CROSS").alias("l1_code"), F.lit("conflict").alias("issue"), F.col("keyword").alias("detail")
    )
    return own.unionByName(shared)


def conflicts(dim: DataFrame) -> DataFrame:
    """Words listed by two or more industries."""
    return dim.groupBy("keyword").agg(F.count_distinct("l1_code").alias("n_industries")).where("n_industries >= 2")


def covered_industries(base: DataFrame) -> DataFrame:
    return base.agg(
        F.count(F.lit(1)).alias("industries"),
        F.count_if(F.col("days_mentioned") > 0).alias("covered"),
        F.sum("mentions_total").alias("mentions_total"),
    )
