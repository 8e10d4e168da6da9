"""Signal and feature evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ranks import average_rank, range_totals
from tapeloom.operators.calendar import at_offset, with_day_idx


def unpivot(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(keys, columns, "feature", "value")


def daily_correlation(feats: DataFrame, fwd: DataFrame, columns: list[str], rank: bool = False, min_pairs: int = 5) -> DataFrame:
    """Mean over days of the cross-sectional correlation of each feature with the forward
    return (Pearson, or Spearman with ``rank``); 0 for a feature without a usable day."""
    both = unpivot(feats.join(fwd.select("code", "trade_date", "fwd"), ["code", "trade_date"]),
                   ["code", "trade_date", "fwd"], columns)
    both = both.where(F.col("value").isNotNull() & F.col("fwd").isNotNull())
    if rank:
        keys = ["feature", "trade_date"]
        both = both.select(*keys, average_rank("value", keys).alias("value"), average_rank("fwd", keys).alias("fwd"))
    n = F.count(F.lit(1))
    dispersion = n * F.stddev_pop("value") * F.stddev_pop("fwd")
    per_day = both.groupBy("feature", "trade_date").agg(
        F.when((n >= min_pairs) & (dispersion > 1e-12), F.try_divide(n * F.covar_pop("value", "fwd"), dispersion)).alias("c")
    )
    names = feats.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    means = per_day.groupBy("feature").agg(F.avg("c").alias("c"))
    return names.join(means, "feature", "left").select(
        "feature", F.coalesce("c", F.lit(0.0)).alias("rank_ic" if rank else "ic")
    )


def histogram_entropy(feats: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """Shannon entropy (nats) of an equal-width histogram; the maximum falls in the last bin."""
    long = unpivot(feats, [], columns).where(F.col("value").isNotNull())
    ends = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # a constant column spreads half a unit to both sides and lands in one bin
    lo = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    placed = long.join(ends, "feature").select(
        "feature", F.least(F.floor((F.col("value") - lo) / (hi - lo) * bins), F.lit(bins - 1)).alias("bin")
    )
    counts = placed.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("feature"))
    return counts.select("feature", (-share * F.ln(share)).alias("h")).groupBy("feature").agg(F.sum("h").alias("entropy"))


def dispersion(feats: DataFrame, columns: list[str]) -> DataFrame:
    """Coefficient of variation and absolute mean per column."""
    return unpivot(feats, [], columns).groupBy("feature").agg(
        (F.stddev_pop("value") / (F.abs(F.avg("value")) + 1e-8)).alias("cv"), F.abs(F.avg("value")).alias("abs_mean")
    )


def top_features(history: DataFrame, n: int, by: str = "rank_ic") -> DataFrame:
    """The n features with the largest absolute metric in the last epoch."""
    last = history.select(F.max("epoch").alias("e")).scalar()
    return history.where(F.col("epoch") == last).orderBy(F.abs(F.col(by)).desc(), "feature").limit(n)


def auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve with ties at half weight, 0.5 when one class is missing.

    Scores are first reduced to (score, positives, negatives), so a score shared by a third of
    all rows is one row. Cumulative counts then run inside ranges of the score and start from the
    totals of the ranges below.
    """
    per = scored.where(F.col(label) >= 0).groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q")
    )
    below = range_totals(per, "s", {"upto": "q"}).select("p", "q", (F.col("upto") - F.col("q")).alias("less"))
    wins = F.sum(F.col("p") * (F.col("less") + F.col("q") / 2.0))
    return below.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("q"), F.lit(0)).alias("n_neg"),
        F.coalesce(F.try_divide(wins, F.sum("p").cast("double") * F.sum("q")), F.lit(0.5)).alias("auc"),
    )


def precision_at_k(scored: DataFrame, k: int, day: str = "day_idx", score: str = "score", label: str = "label", tie: str = "doc_id") -> DataFrame:
    """Hit share of the k best scores of each day, over days with at least k valid labels.

    The rank filter lets every map task keep only its own k best of a day before the shuffle.
    """
    valid = scored.where(F.col(label) >= 0)
    days = valid.groupBy(day).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
    w = Window.partitionBy(day).orderBy(F.col(score).desc(), tie)
    best = valid.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).join(days, day, "left_semi")
    out = best.agg(F.count_if(F.col(label) == 1).alias("hits"), F.count(F.lit(1)).alias("picks"))
    return out.select("hits", "picks", F.coalesce(F.try_divide("hits", "picks"), F.lit(0.0)).alias("precision"))


def classifier_summary(scored: DataFrame, k: int = 10, **names) -> DataFrame:
    """n_valid, base rate, AUC and precision at k as one row."""
    valid = scored.where(F.col("label") >= 0)
    base = valid.agg(F.count(F.lit(1)).alias("n_valid"), F.coalesce(F.avg(F.col("label").cast("double")), F.lit(0.0)).alias("base_rate"))
    return base.select("*", auc(scored).select("auc").scalar().alias("auc"), precision_at_k(scored, k, **names).select("precision").scalar().alias("p_at_k"))


# --- return series ------------------------------------------------------------


def sharpe(r: Column, horizon: int = 1) -> Column:
    return F.avg(r) / (F.stddev_pop(r) + 1e-8) * F.sqrt(F.lit(252.0 / horizon))


def additive_drawdown(series: DataFrame, value: str, order: str, keys: list[str] | None = None) -> DataFrame:
    """Worst gap between the running sum and its peak. One row per day and series, so the
    ordered pass over a series is calendar-sized."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cum = series.withColumn("_cum", F.sum(value).over(w))
    gap = cum.select(*keys, (F.col("_cum") - F.max("_cum").over(w)).alias("_gap"), order)
    return gap.groupBy(*keys).agg(F.min("_gap").alias("max_drawdown"))


def day_turnover(weights: DataFrame, ordered_days: DataFrame, token: str = "token_id") -> DataFrame:
    """Sum of |w_t - w_(t-1)| between neighbouring signal days, an absent weight being 0.

    Every weight is written to its own day with a plus and to the next day with a minus, so
    one aggregate yields the change without a full outer join.
    """
    seq = ordered_days.select("trade_date", F.row_number().over(Window.orderBy("trade_date")).alias("k"))
    mine = weights.join(seq, "trade_date")
    last = seq.select(F.max("k").alias("m")).scalar()
    moves = mine.select(token, F.explode(F.array(
        F.struct(F.col("k").alias("k"), F.col("weight").alias("w")), F.struct((F.col("k") + 1).alias("k"), (-F.col("weight")).alias("w"))
    )).alias("m")).select(token, "m.*")
    change = moves.groupBy("k", token).agg(F.sum("w").alias("d"))
    per_day = change.where((F.col("k") > 1) & (F.col("k") <= last)).groupBy("k").agg(F.sum(F.abs("d")).alias("turnover"))
    return seq.where("k > 1").join(per_day, "k", "left").select("trade_date", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def daily_alpha(signals: DataFrame, returns: DataFrame, calendar: DataFrame, horizon: int) -> DataFrame:
    """Per signal day: sum of weight times (forward return - market forward return), for days
    with a full horizon ahead."""
    from tapeloom.operators.labels import forward_returns, market_proxy

    fwd = forward_returns(returns, horizon).select(F.col("code").alias("token_id"), "day_idx", "fwd")
    mkt = market_proxy(returns).withColumn("code", F.lit("_")).select("code", F.lit(None).cast("date").alias("trade_date"), "day_idx", F.col("mkt").alias("ret"))
    mkt_fwd = forward_returns(mkt, horizon).select("day_idx", F.col("fwd").alias("mkt_fwd"))
    n_ret = calendar.select(F.max("day_idx").alias("m")).scalar()
    sig = with_day_idx(signals, calendar).where(F.col("day_idx") + horizon < n_ret)
    part = sig.join(fwd, ["token_id", "day_idx"], "left").join(mkt_fwd, "day_idx")
    return part.groupBy("trade_date", "day_idx").agg(
        F.coalesce(F.sum(F.col("weight") * (F.col("fwd") - F.col("mkt_fwd"))), F.lit(0.0)).alias("alpha")
    )


def evaluate_signals(signals: DataFrame, returns: DataFrame, calendar: DataFrame, horizon: int = 5) -> DataFrame:
    """Sharpe, sum, mean, drawdown and turnover of the signal's daily alpha; fewer than two
    days give zeros."""
    alpha = daily_alpha(signals, returns, calendar, horizon)
    used = signals.join(alpha.select("trade_date"), "trade_date", "left_semi")
    moved = day_turnover(used, alpha.select("trade_date"))
    enough = F.count("alpha") >= 2

    def when_enough(c, name):
        return F.when(enough, c).otherwise(0.0).alias(name)

    stats = alpha.agg(
        when_enough(sharpe(F.col("alpha"), horizon), "sharpe"), when_enough(F.sum("alpha"), "cum_return"),
        when_enough(F.avg("alpha"), "mean_per_step"), F.when(enough, F.count("alpha")).otherwise(0).alias("n_steps"),
    )
    total = signals.agg(F.count(F.lit(1)).alias("n_signals"))
    drop = additive_drawdown(alpha, "alpha", "trade_date")
    turn = moved.agg(F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("turnover_avg"))
    out = stats.select("*", total.scalar().alias("n_signals"), drop.scalar().alias("max_drawdown"), turn.scalar().alias("turnover_avg"))
    two = F.col("n_steps") >= 2
    return out.withColumn("max_drawdown", F.when(two, F.col("max_drawdown")).otherwise(0.0)).withColumn(
        "turnover_avg", F.when(two, F.col("turnover_avg")).otherwise(0.0)
    )


def suspended_next_day(signals: DataFrame, grid: DataFrame, calendar: DataFrame) -> DataFrame:
    """Signals joined to whether their token traded on the next calendar day; signals of the
    last day or of unknown tokens are left out."""
    sig = with_day_idx(signals, calendar)
    ahead = grid.select(F.col("code").alias("token_id"), "day_idx", F.col("traded").alias("traded"), F.col("trade_date").alias("next_date"))
    return at_offset(sig, ahead, 1, {"traded": "traded_next", "next_date": "next_date"}, ("token_id",), "inner")


def suspension_report(cases: DataFrame) -> DataFrame:
    bad = ~F.col("traded_next")
    total, hit = F.count(F.lit(1)), F.count_if(bad)
    return cases.agg(
        total.alias("total"), hit.alias("suspended"), F.coalesce(F.try_divide(hit, total), F.lit(0.0)).alias("rate"),
        F.coalesce(F.try_divide(F.sum(F.when(bad, F.col("weight")).otherwise(0.0)), F.sum("weight")), F.lit(0.0)).alias("rate_weighted"),
    )


def excess_ratio(cum: Column, bench: Column) -> Column:
    return F.coalesce(F.try_divide(cum - bench, F.abs(bench)), F.lit(0.0))
