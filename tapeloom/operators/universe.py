"""Stock universes: tradability filters, scoring inside industries, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import at_least, is_special_treatment

MAIN_BOARD = ("60", "00")
MIN_LISTED_DAYS = 120


def _starts_with_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def listed_long_enough(list_date: Column, on: Column, days: int = MIN_LISTED_DAYS) -> Column:
    return list_date.isNotNull() & (list_date < F.date_sub(on, days))


def snapshot_dates(basic: DataFrame, as_of: DataFrame) -> DataFrame:
    """For each ``as_of`` date the latest data date on or before it. The as-of dates and the
    distinct data dates are one calendar-sized timeline, so one ordered pass answers all."""
    days = basic.select(F.col("trade_date").alias("d"), F.col("trade_date").alias("snap")).distinct()
    asked = as_of.select(F.col("as_of").alias("d"), F.lit(None).cast("date").alias("snap"))
    w = Window.orderBy("d", F.col("snap").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = days.unionByName(asked).withColumn("_seen", F.last("snap", ignorenulls=True).over(w))
    return both.where(F.col("snap").isNull() & F.col("_seen").isNotNull()).select(
        F.col("d").alias("as_of"), F.col("_seen").alias("snap")
    ).distinct()


def candidates(
    basic: DataFrame, industry: DataFrame, lifecycle: DataFrame, snaps: DataFrame,
    cmv_min: float, cmv_max: float, prefixes: tuple[str, ...] = MAIN_BOARD,
) -> DataFrame:
    """Tradable stocks of each snapshot: main board, no special treatment (a NULL name fails),
    listed long enough, market value in range, traded, industry known."""
    day = basic.join(snaps, basic.trade_date == snaps.snap)
    day = day.where(
        _starts_with_any(F.col("code"), prefixes)
        & F.col("circ_mv").between(cmv_min, cmv_max) & (F.col("turnover_rate") > 0)
    ).select("as_of", "snap", "code", "circ_mv")
    names = lifecycle.select("code", "name", "list_date")
    out = day.join(industry.where(F.col("l1_code").isNotNull()).select("code", "l1_code"), "code").join(names, "code")
    return out.where(
        ~is_special_treatment(F.col("name")) & listed_long_enough(F.col("list_date"), F.col("snap"))
    ).select("as_of", "snap", "code", "l1_code", "circ_mv")


def _lookback(df: DataFrame, snaps: DataFrame, window: int, days_per_row: float) -> DataFrame:
    """Rows of the int(days_per_row * window) calendar days up to each snapshot (daily bars: 1.7). A row spells out the
    months it can matter for, so snapshots meet rows by equality and a date filter."""
    reach = int(days_per_row * window)
    months = F.sequence(F.trunc("trade_date", "month"), F.trunc(F.date_add("trade_date", reach), "month"), F.expr("interval 1 month"))
    rows = df.withColumn("_month", F.explode(months))
    keyed = snaps.select("as_of", "snap", F.trunc("snap", "month").alias("_month"))
    return rows.join(keyed, "_month").where(
        (F.col("trade_date") <= F.col("snap")) & (F.col("trade_date") >= F.date_sub("snap", reach))
    )


def average_turnover(basic: DataFrame, snaps: DataFrame, window: int = 20, days_per_row: float = 1.7) -> DataFrame:
    rows = _lookback(basic.where(F.col("turnover_rate").isNotNull()).select("code", "trade_date", "turnover_rate"), snaps, window, days_per_row)
    out = rows.groupBy("as_of", "code").agg(F.avg("turnover_rate").alias("turnover_ma"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") >= max(5, window // 4)).drop("_n")


def volatility(raw: DataFrame, snaps: DataFrame, window: int = 60, days_per_row: float = 1.7) -> DataFrame:
    """Population deviation of the daily change."""
    rows = _lookback(raw.where(F.col("pct_change").isNotNull()).select("code", "trade_date", "pct_change"), snaps, window, days_per_row)
    out = rows.groupBy("as_of", "code").agg(F.stddev_pop("pct_change").alias("vola"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") >= max(10, window // 3)).drop("_n")


def score_candidates(
    base: DataFrame, turnover: DataFrame, vola: DataFrame,
    w_turnover: float = 0.5, w_vola: float = 0.35, w_cmv: float = 0.15,
) -> DataFrame:
    """Missing measures take the snapshot's median; then a weighted z-score inside the industry.

    The groups hold one row per stock of one snapshot, so exact medians are cheap.
    """
    df = base.join(turnover, ["as_of", "code"], "left").join(vola, ["as_of", "code"], "left")
    medians = df.groupBy("as_of").agg(
        F.percentile("turnover_ma", F.lit(0.5)).alias("_mt"), F.percentile("vola", F.lit(0.5)).alias("_mv")
    )
    df = df.join(medians, "as_of").select(
        "as_of", "snap", "code", "l1_code", "circ_mv",
        F.coalesce("turnover_ma", "_mt").alias("turnover_ma"), F.coalesce("vola", "_mv").alias("vola"),
        (-F.ln(at_least(F.col("circ_mv"), 1.0))).alias("neg_log_cmv"),
    )
    g = Window.partitionBy("as_of", "l1_code")

    def z(c):
        return (F.col(c) - F.avg(c).over(g)) / (F.stddev_pop(c).over(g) + 1e-9)

    score = w_turnover * z("turnover_ma") + w_vola * z("vola") + w_cmv * z("neg_log_cmv")
    return df.withColumn("score", score)


def top_k(scored: DataFrame, k: int, group: list[str], score: str = "score", tie: str = "code") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def per_industry_top_k(
    basic: DataFrame, raw: DataFrame, industry: DataFrame, lifecycle: DataFrame, as_of: DataFrame,
    k: int = 15, cmv_min: float = 20e4, cmv_max: float = 500e4, prefixes: tuple[str, ...] = MAIN_BOARD,
    turnover_window: int = 20, vola_window: int = 60, days_per_row: float = 1.7,
) -> DataFrame:
    """Top-k per industry for every as-of date in one job (one date, or all months of a
    rolling universe)."""
    snaps = snapshot_dates(basic, as_of)
    base = candidates(basic, industry, lifecycle, snaps, cmv_min, cmv_max, prefixes)
    scored = score_candidates(base, average_turnover(basic, snaps, turnover_window, days_per_row), volatility(raw, snaps, vola_window, days_per_row))
    return top_k(scored, k, ["as_of", "l1_code"])


def top_market_value(basic: DataFrame, lifecycle: DataFrame, n: int, as_of=None) -> DataFrame:
    """The n largest stocks at the latest snapshot, without the Beijing board, special
    treatment, young listings and untraded ones."""
    upto = basic if as_of is None else basic.where(F.col("trade_date") <= F.lit(as_of).cast("date"))
    snap = upto.select(F.max("trade_date").alias("snap")).scalar()
    day = basic.where(
        (F.col("trade_date") == snap) & F.col("circ_mv").isNotNull() & (F.col("turnover_rate") > 0)
        & ~F.col("code").endswith(".BJ")
    )
    joined = day.join(lifecycle.select("code", "name", "list_date"), "code").where(
        ~is_special_treatment(F.col("name")) & listed_long_enough(F.col("list_date"), F.col("trade_date"))
    )
    return joined.orderBy(F.col("circ_mv").desc(), "code").limit(n).select("code", "trade_date", "circ_mv")


def index_members(weights: DataFrame, as_of=None) -> DataFrame:
    """Constituents of every index at its latest snapshot on or before ``as_of``."""
    upto = weights if as_of is None else weights.where(F.col("trade_date") <= F.lit(as_of).cast("date"))
    latest = upto.groupBy("index_code").agg(F.max("trade_date").alias("trade_date"))
    return upto.join(latest, ["index_code", "trade_date"]).select("index_code", "trade_date", "con_code")


# Universe modes that are indexes.
INDEX_MODES = {"hs300": "000300.SH", "zz500": "000905.SH"}


def select_universe(mode: str, basic: DataFrame, lifecycle: DataFrame, weights: DataFrame, n: int = 300, as_of=None) -> DataFrame:
    if mode in INDEX_MODES:
        members = index_members(weights.where(F.col("index_code") == INDEX_MODES[mode]), as_of)
        return members.select(F.col("con_code").alias("code"))
    if mode == "top_mv":
        return top_market_value(basic, lifecycle, n, as_of).select("code")
    raise ValueError(f"unknown universe mode {mode!r}")


def eligible_codes(day_bars: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Codes traded that day outside the Beijing board; an unknown name passes."""
    out = day_bars.where(~F.col("code").endswith(".BJ")).select("code").distinct()
    out = out.join(lifecycle.select("code", "name"), "code", "left")
    return out.where(F.col("name").isNull() | ~is_special_treatment(F.col("name"))).select("code")


def month_universe(days: DataFrame, universe: DataFrame, date: str = "trade_date") -> DataFrame:
    """Rows whose code is in the universe of their month (``as_of`` = month start)."""
    members = universe.select("code", F.col("as_of").alias("_month"))
    return days.withColumn("_month", F.trunc(date, "month")).join(members, ["code", "_month"], "left_semi").drop("_month")


def industry_map(industry: DataFrame, level: int = 1) -> DataFrame:
    """(code, ind_code, ind_name) at industry level 1, 2 or 3."""
    if level not in (1, 2, 3):
        raise ValueError(f"level must be 1, 2 or 3, not {level!r}")
    return industry.select("code", F.col(f"l{level}_code").alias("ind_code"), F.col(f"l{level}_name").alias("ind_name"))
