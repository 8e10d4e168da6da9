"""Feature quality rules, repairs, causality and independent recomputation checks."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.quantiles import exact_quantiles
from tapeloom.functions.rolling import Clock, add, pick
from tapeloom.operators.evaluate import unpivot
from tapeloom.operators.features import LIMIT_UP, FeatureSource, compute_features
from tapeloom.session import store_once

WINDOW_DAYS = 252
MIN_SAMPLES = 1000


@dataclass(frozen=True)
class Rule:
    feature: str
    source: str
    low: float | None
    high: float | None
    warmup: int
    alert: float = 0.10
    fill: str | None = "zero"  # zero, prev, median, keep; None means no missing value is expected
    action: str = "clip"  # clip, alert, drop_stock


def default_rules() -> list[Rule]:
    # Feature, source, lowest, highest, warm-up days, tolerated share of missing values.
    return [
        Rule("ret_1d", "price", -0.11, 0.11, 2, 0.1),
        Rule("ret_5d", "price", -0.5, 0.5, 6, 0.1),
        Rule("ret_20d", "price", -1.0, 1.0, 21, 0.1),
        Rule("range_pct", "price", 0.0, 0.25, 1, 0.1),
        Rule("gap", "price", -0.11, 0.11, 2, 0.1),
        Rule("ma5_dev", "averages", -0.5, 0.5, 6, 0.1),
        Rule("ma20_dev", "averages", -0.5, 0.5, 21, 0.1),
        Rule("ma60_dev", "averages", -0.5, 0.5, 61, 0.1),
        Rule("ma_short_long", "averages", -0.3, 0.3, 21, 0.1),
        Rule("vol_z20", "volume", -5.0, 30.0, 21, 0.1),
        Rule("vol_ratio_5", "volume", 0.0, 15.0, 6, 0.1),
        Rule("vol_ret_corr20", "volume", -1.0, 1.0, 21, 0.1),
        Rule("rsi12", "technical", -0.5, 0.5, 13, 0.1),
        Rule("macd_hist_norm", "technical", -0.1, 0.1, 27, 0.1),
        Rule("kdj_j", "technical", -1.5, 1.5, 10, 0.1),
        Rule("atr14_pct", "technical", 0.0, 0.25, 15, 0.1),
        Rule("pe_log", "fundamental", 0.0, 10.0, 1, 0.35),
        Rule("pb_log", "fundamental", 0.0, 5.0, 1, 0.3),
        Rule("turnover", "fundamental", 0.0, 50.0, 1, 0.1),
        Rule("mv_log", "fundamental", 9.0, 20.0, 1, 0.1),
        Rule("inflow_pct", "money_flow", -0.1, 0.1, 1, 0.15),
        Rule("big_ratio", "money_flow", 0.0, 1.0, 1, 0.15),
        Rule("days_since_limit", "limit_up", 0.0, 1.0, 1, 0.1),
        Rule("n_limits_20d", "limit_up", 0.0, 1.0, 1, 0.1),
        Rule("n_limits_60d", "limit_up", 0.0, 1.0, 1, 0.1),
        Rule("max_ret_20d", "limit_up", -0.11, 0.15, 2, 0.1),
        Rule("consecutive_up", "limit_up", 0.0, 1.0, 1, 0.1),
        Rule("is_yi_zi", "limit_up", 0.0, 1.0, 1, 0.1),
        Rule("circ_mv_log", "scale", 9.0, 20.0, 1, 0.1),
        Rule("circ_mv_z_self60", "scale", -5.0, 5.0, 61, 0.1),
        Rule("turnover_ma20", "scale", 0.0, 30.0, 6, 0.1),
        Rule("turnover_self_z60", "scale", -5.0, 5.0, 61, 0.1),
        Rule("vola_60d", "scale", 0.0, 0.1, 61, 0.1),
        Rule("vola_ratio_20_60", "scale", 0.1, 5.0, 61, 0.1),
        Rule("price_vol_match5", "price_volume", -0.5, 0.5, 6, 0.1),
        Rule("inflow_5d_sum", "price_volume", -0.5, 0.5, 6, 0.15),
        Rule("vol_ret_corr60", "price_volume", -1.0, 1.0, 61, 0.1),
        Rule("news_mentioned_t", "news", 0.0, 1.0, 1, 0.0),
        Rule("news_mentioned_t1", "news", 0.0, 1.0, 1, 0.0),
    ]


def with_rule(rules: list[Rule], feature: str, **changes) -> list[Rule]:
    return [replace(r, **changes) if r.feature == feature else r for r in rules]


def rule_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.feature, r.source, r.low, r.high, r.warmup, r.alert, r.fill, r.action) for r in rules]
    return spark.createDataFrame(
        rows, "feature string, source string, low double, high double, warmup int, alert double, fill string, action string"
    )


def rolling_thresholds(feats: DataFrame, trade_date, columns: list[str]) -> DataFrame:
    """0.5 % and 99.5 % quantiles per feature over the last panel dates up to ``trade_date``,
    where enough values exist. Stored: they are two numbers per feature, and the buffers of their derivation would
    else be held once more by the task of every statistic that uses them."""
    past = feats.where(F.col("trade_date") <= F.lit(trade_date).cast("date"))
    dates = past.select("trade_date").distinct().orderBy(F.col("trade_date").desc()).limit(WINDOW_DAYS)
    long = unpivot(past.join(dates, "trade_date", "left_semi"), [], columns)
    q = exact_quantiles(long, ["feature"], "value", {"q_low": 0.005, "q_high": 0.995})
    return store_once(q.where(F.col("n") >= MIN_SAMPLES).select("feature", "q_low", "q_high"), "thresholds")


def _bounds(rules: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Quantile bounds where known, else the fixed pair when both ends are given."""
    both = F.col("low").isNotNull() & F.col("high").isNotNull()
    return rules.join(thresholds, "feature", "left").withColumns({
        "lo": F.coalesce("q_low", F.when(both, F.col("low"))), "hi": F.coalesce("q_high", F.when(both, F.col("high"))),
    })


def feature_day_stats(feats: DataFrame, trade_date, rules: DataFrame, columns: list[str], thresholds: DataFrame) -> DataFrame:
    """Per feature on the day: rows, missing, values under and over the bounds, extremes."""
    today = unpivot(feats.where(F.col("trade_date") == F.lit(trade_date).cast("date")), [], columns)
    joined = today.join(_bounds(rules, thresholds), "feature")
    v = F.col("value")
    keys = ["feature", "source", "fill", "alert", "action", "lo", "hi"]
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("n_missing"),
        F.count_if(v < F.col("lo")).alias("n_below"), F.count_if(v > F.col("hi")).alias("n_above"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
    )


def quality_alerts(stats: DataFrame) -> DataFrame:
    """(feature, issue, value, threshold, affected): missing values without a strategy or above
    the tolerated share; values out of range when the action is not to clip silently."""
    rate = F.col("n_missing") / F.col("n")
    loud = F.col("action").isin("alert", "drop_stock")

    def item(cond, issue, value, threshold, affected):
        return F.when(cond, F.struct(
            F.lit(issue).alias("issue"), value.cast("double").alias("value"),
            threshold.cast("double").alias("threshold"), affected.alias("affected")))

    has = F.col("n_missing") > 0
    items = F.array(
        item(has & F.col("fill").isNull(), "nan_strategy_missing", rate, F.lit(None), F.col("n_missing")),
        item(has & F.col("fill").isNotNull() & (rate > F.col("alert")), "nan_rate_high", rate, F.col("alert"), F.col("n_missing")),
        item(loud & (F.col("n_below") > 0), "below_min", F.col("min_value"), F.col("lo"), F.col("n_below")),
        item(loud & (F.col("n_above") > 0), "above_max", F.col("max_value"), F.col("hi"), F.col("n_above")),
    )
    found = stats.select("feature", "source", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("a"))
    return found.select("feature", "source", "a.*")


def audit_report(stats: DataFrame) -> DataFrame:
    """One row per checked feature: how many alerts, and whether it passed."""
    n = quality_alerts(stats).groupBy("feature").agg(F.count(F.lit(1)).alias("alerts"))
    out = stats.select("feature", "source").join(n, "feature", "left").fillna(0, ["alerts"])
    return out.withColumn("passed", F.col("alerts") == 0)


def repair_day(feats: DataFrame, trade_date, rules: list[Rule], thresholds: DataFrame) -> DataFrame:
    """The rows of ``trade_date`` with missing values filled by rule and outliers clipped or
    removed. "prev" takes only the directly preceding row of the code."""
    day = F.lit(trade_date).cast("date")
    columns = [r.feature for r in rules]
    t = Clock()
    previous = [r.feature for r in rules if r.fill == "prev"]
    df = feats.where(F.col("trade_date") <= day)
    df = add(df, {f"_prev_{c}": t.lag(c) for c in previous}) if previous else df
    df = df.where(F.col("trade_date") == day)
    medians = [r.feature for r in rules if r.fill == "median"]
    one = df.agg(F.struct(F.lit(len(medians)).alias("n"), *[F.percentile(c, F.lit(0.5)).alias(c) for c in medians]))
    bounds = _bounds(rule_frame(feats.sparkSession, rules), thresholds)
    wide = bounds.agg(F.struct(*[
        F.max(F.when(F.col("feature") == c, F.col(e))).alias(f"{e}_{c}") for c in columns for e in ("lo", "hi")
    ]))
    df = df.select("*", one.scalar().alias("_median"), wide.scalar().alias("_bound"))
    out = {}
    for r in rules:
        c = r.feature
        x = {"zero": f"coalesce({c}, 0)", "prev": f"coalesce({c}, _prev_{c})",
             "median": f"coalesce({c}, _median.{c}, 0)"}.get(r.fill, c)
        lo, hi = f"_bound.lo_{c}", f"_bound.hi_{c}"
        if r.action == "clip":
            x = f"case when {x} < {lo} then {lo} when {x} > {hi} then {hi} else {x} end"
        elif r.action == "drop_stock":
            x = f"case when {x} < {lo} or {x} > {hi} then null else {x} end"
        out[c] = f"double({x})"
    return pick(df, ["code", "trade_date"], out)


def drop_last_rows(panel: DataFrame, n: int) -> DataFrame:
    """Panel without the last n rows of each code; a code with no more rows than n is kept whole."""
    t = Clock()
    df = add(panel, {
        "_left": f"count(1) {t.over('rows between 1 following and unbounded following')}", "_all": f"count(1) {t.whole}",
    })
    return df.where((F.col("_left") >= n) | (F.col("_all") <= n)).drop("_left", "_all")


def causality_audit(
    panel: DataFrame, hold_out: int, sources: tuple[FeatureSource, ...], tolerance: float = 1e-10
) -> DataFrame:
    """Features recomputed without the last rows must not change on the rows that remain: per
    feature the compared rows, the differing rows and the largest difference."""
    columns = [c for s in sources for c in s.columns]
    full = unpivot(compute_features(panel, sources), ["code", "trade_date"], columns)
    cut = unpivot(compute_features(drop_last_rows(panel, hold_out), sources), ["code", "trade_date"], columns)
    # both sides are stacked and compared inside one aggregate instead of a wide self-join
    both = full.withColumn("side", F.lit(1)).unionByName(cut.withColumn("side", F.lit(0)))
    a, b = F.max(F.when(F.col("side") == 1, F.col("value"))), F.max(F.when(F.col("side") == 0, F.col("value")))
    pairs = both.groupBy("feature", "code", "trade_date").agg(F.count(F.lit(1)).alias("n"), a.alias("a"), b.alias("b"))
    diff = F.when(F.col("a").isNull() & F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.abs(F.col("a") - F.col("b")), F.lit(float("inf"))))
    return pairs.where("n = 2").groupBy("feature").agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(diff > tolerance).alias("look_ahead"), F.max(diff).alias("max_diff")
    )


# Features recomputed by the spot check, each from the rows before the audited day: ``k`` is
# how many rows back a row lies from the last visible one (0, 1, 2, ...). Those with recursive
# averages are taken from the fold ``s`` over the code's history.
def _spot_expressions() -> dict[str, str]:
    def at(x, k):
        return f"max(case when k = {k} then {x} end)"

    def over(fn, x, n):
        return f"{fn}(case when k < {n} then {x} end)"

    def whole(x, n):
        return f"case when {over('count', x, n)} = {n} then {over('sum', x, n)} end"

    def corr(n, need):
        pair = f"k < {n} and r is not null and volume is not null"
        x, y = f"case when {pair} then r end", f"case when {pair} then volume end"
        return (f"case when count({x}) >= {need} then try_divide(avg(({x}) * ({y})) - avg({x}) * avg({y}), "
                f"sqrt(avg(({x}) * ({x})) - avg({x}) * avg({x})) * sqrt(avg(({y}) * ({y})) - avg({y}) * avg({y}))) end")

    def log_above(x, low, shift):
        return f"case when {x} > {low} then ln({x} + {shift}) when {x} <= {low} then 0D end"

    def self_z(x):
        return f"case when {over('count', x, 60)} >= 20 then ({at(x, 0)} - {over('avg', x, 60)}) / ({over('stddev_pop', x, 60)} + 1e-9D) end"

    def amount(*sizes):
        return " + ".join(f"coalesce({at(f'buy_{s}_amount', 0)}, 0)" for s in sizes)

    c, v = at("close", 0), at("volume", 0)
    hit, risen = f"r >= {LIMIT_UP!r}D", "coalesce(r > 0, false)"
    limit = f"case when r >= {LIMIT_UP!r}D then 1D else 0D end"
    return {
        "ret_1d": f"ln(try_divide({c}, {at('close', 1)}))",
        "ret_5d": f"ln(try_divide({c}, {at('close', 5)}))",
        "ret_20d": f"ln(try_divide({c}, {at('close', 20)}))",
        "range_pct": f"try_divide({at('high', 0)} - {at('low', 0)}, {c})",
        "gap": f"try_divide({at('open', 0)}, {at('close', 1)}) - 1",
        "ma5_dev": f"try_divide({c} * 5, {whole('close', 5)}) - 1",
        "ma20_dev": f"try_divide({c} * 20, {whole('close', 20)}) - 1",
        "ma60_dev": f"try_divide({c} * 60, {whole('close', 60)}) - 1",
        "ma_short_long": f"try_divide({whole('close', 5)} * 4, {whole('close', 20)}) - 1",
        "vol_ratio_5": f"try_divide({v} * 5, {over('sum', 'volume', 5)})",
        "vol_z20": f"try_divide({v} - {over('avg', 'volume', 20)}, {over('stddev_pop', 'volume', 20)})",
        "vol_ret_corr20": corr(20, 20),
        "vol_ret_corr60": corr(60, 20),
        "n_limits_20d": f"{over('sum', limit, 20)} / 20",
        "n_limits_60d": f"{over('sum', limit, 60)} / 60",
        "max_ret_20d": over("max", "r", 20),
        "vola_60d": over("stddev_pop", "r", 60),
        "turnover": at("turnover_rate", 0),
        "turnover_ma20": over("avg", "turnover_rate", 20),
        "inflow_5d_sum": f"try_divide({over('sum', 'net_mf_amount', 5)}, {at('circ_mv', 0)})",
        "pe_log": log_above(at("pe_ttm", 0), 0, 1),
        "pb_log": log_above(at("pb", 0), 0, 1),
        "mv_log": log_above(at("total_mv", 0), 1, 0),
        "inflow_pct": f"try_divide({at('net_mf_amount', 0)}, {at('total_mv', 0)})",
        "big_ratio": f"try_divide({amount('lg', 'elg')}, {amount('sm', 'md', 'lg', 'elg')})",
        "days_since_limit": f"least(coalesce(min(case when {hit} then k end), 60), 60) / 60",
        "consecutive_up": f"least(coalesce(min(case when not {risen} then k end), count(1)), 10) / 10",
        "is_yi_zi": at(f"case when {hit} and open = close and high = close and low = close then 1D else 0D end", 0),
        "circ_mv_log": log_above(at("circ_mv", 0), 1, 0),
        "circ_mv_z_self60": self_z("circ_mv"),
        "turnover_self_z60": self_z("turnover_rate"),
        "vola_ratio_20_60": f"case when {over('count', 'r', 20)} >= 5 and {over('count', 'r', 60)} >= 20 then {over('stddev_pop', 'r', 20)} / ({over('stddev_pop', 'r', 60)} + 1e-9D) end",
        "price_vol_match5": f"ln(try_divide({c}, {at('close', 5)})) * tanh(try_divide({v} * 5, {over('sum', 'volume', 5)}) - 1)",
        "rsi12": "(case when s.l = 0 and s.g > 0 then 100D else coalesce(100 - 100 / (1 + try_divide(s.g, s.l)), 50D) end) / 100 - 0.5D",
        "macd_hist_norm": "try_divide(2 * (s.fast - s.slow - s.dea), last.c)",
        "kdj_j": "(3 * s.k - 2 * s.d) / 100 - 0.5D",
        "atr14_pct": "try_divide(s.atr, last.c)",
    }


# Input rows of the fold from the code's adjusted prices ``h`` (c, h, l by date).
_SPOT_INPUTS = """transform(h, (e, i) -> named_struct(
  'c', e.c, 'move', e.c - get(h, i - 1).c,
  'tr', array_max(array(e.h - e.l, abs(e.h - get(h, i - 1).c), abs(e.l - get(h, i - 1).c))),
  'rsv', case when i >= 8 and forall(slice(h, greatest(i - 7, 1), 9), x -> x.h is not null and x.l is not null) then
    try_divide(e.c - array_min(slice(h, greatest(i - 7, 1), 9).l), array_max(slice(h, greatest(i - 7, 1), 9).h) - array_min(slice(h, greatest(i - 7, 1), 9).l)) * 100 end))"""


def _spot_fold() -> str:
    """The recursive averages at the last row: a missing value keeps the average and lessens its weight."""
    gain, loss = (f"case when e.move is not null then greatest({m}, 0D) end" for m in ("e.move", "-e.move"))
    series = {"g": (gain, 12), "l": (loss, 12), "fast": ("e.c", 6.5), "slow": ("e.c", 13.5), "k": ("e.rsv", 3), "atr": ("e.tr", 14)}
    start, step, new = [], [], {}
    for y, (x, n) in series.items():
        a = repr(1 / n) + "D"
        new[y] = f"(case when {x} is null then s.{y} when s.{y} is null then {x} else (s.w_{y} * s.{y} + {a} * ({x})) / (s.w_{y} + {a}) end)"
        start += [f"'{y}', cast(null as double), 'w_{y}', 1D"]
        step += [f"'{y}', {new[y]}, 'w_{y}', case when {x} is null then s.w_{y} else 1D end * (1D - {a})"]
    for y, x, n in (("dea", f"({new['fast']} - {new['slow']})", 5), ("d", new["k"], 3)):  # without gaps once begun
        start += [f"'{y}', cast(null as double)"]
        step += [f"'{y}', coalesce(s.{y} + ({x} - s.{y}) / {n}D, {x})"]
    return f"aggregate({_SPOT_INPUTS}, named_struct({', '.join(start)}), (s, e) -> named_struct({', '.join(step)}))"


SPOT_RECURSIVE = ("rsi12", "macd_hist_norm", "kdj_j", "atr14_pct")


SPOT_WARMUP = 61


def spot_check(panel: DataFrame, feats: DataFrame, trade_date, tolerance: float = 1e-8) -> DataFrame:
    """Recompute the 37 market features of one day in a second way and compare.

    Windows are replaced by conditional aggregates over the age of each row, and recursive
    averages by a plain fold over the code's own history (one row per date, so calendar-sized).
    Codes with fewer than 61 earlier rows are not compared.
    """
    day = F.lit(trade_date).cast("date")
    t = Clock()
    past = add(panel.where(F.col("trade_date") <= day), {
        "r": f"ln(try_divide(close, {t.lag('close')}))",
        "_later": f"count(1) {t.over('rows between 1 following and unbounded following')}",
        "_last": f"max(trade_date) {t.whole}", "_seen": f"count(1) {t.whole}",
    })
    past = past.where((F.col("_last") == day) & (F.col("_seen") > SPOT_WARMUP) & (F.col("_later") >= 1))
    past = past.withColumn("k", F.col("_later") - 1)
    exprs = _spot_expressions()
    plain = {n: e for n, e in exprs.items() if n not in SPOT_RECURSIVE}
    history = "array_sort(collect_list(struct(trade_date, close_qfq as c, high_qfq as h, low_qfq as l)))"
    made = past.groupBy("code").agg(*[F.expr(e).alias(n) for n, e in plain.items()], F.expr(history).alias("h"))
    made = made.selectExpr("code", *plain, f"{_spot_fold()} as s", "element_at(h, -1) as last")
    made = made.selectExpr("code", *plain, *[f"{exprs[n]} as {n}" for n in SPOT_RECURSIVE])
    expected = unpivot(made, ["code"], list(exprs)).withColumnRenamed("value", "expected")
    actual = unpivot(feats.where(F.col("trade_date") == day), ["code"], list(exprs))
    both = expected.join(actual, ["code", "feature"])
    known = F.col("expected").isNotNull() & F.col("value").isNotNull()
    one = F.col("expected").isNull() != F.col("value").isNull()
    limit = F.when(F.col("feature").isin(*SPOT_RECURSIVE), 1e-5).otherwise(tolerance)
    off = F.abs(F.col("value") - F.col("expected")) > limit * F.greatest(F.abs("expected"), F.lit(1.0))
    told = both.groupBy("feature").agg(F.count_if(known).alias("compared"), F.count_if(known & off).alias("mismatches"), F.count_if(one).alias("one_sided"))
    return told.where("compared + one_sided > 0")


# Tolerances of the vendor comparison.
ATOL_RSI, ATOL_KDJ, ATOL_MACD, RTOL_MACD = 0.5, 1.0, 5e-4, 0.05


def vendor_mismatches(feats: DataFrame, vendor: DataFrame, trade_date) -> DataFrame:
    """Our features of day T, which know the day before, against the vendor's indicators of that day (its latest before
    T), on the vendor's scale; MACD must miss both an absolute and a relative tolerance. ``vendor``
    has (code, trade_date, rsi_12, kdj_j, macd, close_qfq)."""
    day = F.lit(trade_date).cast("date")
    before = vendor.where(F.col("trade_date") < day).agg(F.max("trade_date")).scalar()
    vendor = vendor.where(F.col("trade_date") == before)
    today = feats.where(F.col("trade_date") == F.lit(trade_date).cast("date")).select("code", "rsi12", "kdj_j", "macd_hist_norm")
    both = today.join(vendor.select("code", "rsi_12", F.col("kdj_j").alias("v_kdj"), "macd", "close_qfq"), "code")
    base = F.when(F.col("close_qfq") != 0, F.col("close_qfq"))
    pairs = F.explode(F.array(
        F.struct(F.lit("rsi12").alias("feature"), ((F.col("rsi12") + 0.5) * 100).alias("ours"), F.col("rsi_12").alias("theirs"), F.lit(ATOL_RSI).alias("atol"), F.lit(0.0).alias("rtol")),
        F.struct(F.lit("kdj_j").alias("feature"), ((F.col("kdj_j") + 0.5) * 100).alias("ours"), F.col("v_kdj").alias("theirs"), F.lit(ATOL_KDJ).alias("atol"), F.lit(0.0).alias("rtol")),
        F.struct(F.lit("macd_hist_norm").alias("feature"), (F.col("macd_hist_norm") * base).alias("ours"), F.col("macd").alias("theirs"), F.lit(ATOL_MACD).alias("atol"), F.lit(RTOL_MACD).alias("rtol")),
    )).alias("p")
    diff = F.abs(F.col("ours") - F.col("theirs"))
    return both.select("code", pairs).select("code", "p.*").where(
        (diff > F.col("atol")) & (diff / F.greatest(F.abs("theirs"), F.lit(1e-6)) > F.col("rtol"))
    ).select("code", "feature", "ours", "theirs", (F.col("ours") - F.col("theirs")).alias("diff"))
