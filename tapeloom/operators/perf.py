"""Performance measures of return series (one row per series and date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import nan_safe

YEAR = 252
Z95 = 1.6448536269514722


def compounded(r: str, w) -> Column:
    """Running product of (1 + r); a return of -100 % or less keeps its zero or sign."""
    g = 1 + F.col(r)
    size = F.exp(F.coalesce(F.sum(F.when(g != 0, F.ln(F.abs(g)))).over(w), F.lit(0.0)))
    odd = F.coalesce(F.sum(F.when(g < 0, 1).otherwise(0)).over(w), F.lit(0)) % 2 == 1
    wiped = F.max(F.when(g == 0, 1).otherwise(0)).over(w) == 1
    return F.when(wiped, 0.0).when(odd, -size).otherwise(size)


def equity_curve(returns: DataFrame, keys: list[str], order: str = "trade_date", r: str = "r") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("equity", compounded(r, w))


def ratio_drawdown(returns: DataFrame, keys: list[str], order: str = "trade_date", r: str = "r") -> DataFrame:
    """Worst equity over its peak minus one, the starting value 1 counting as a peak."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    curve = equity_curve(returns, keys, order, r)
    drop = curve.withColumn("_dd", F.try_divide(F.col("equity"), F.greatest(F.max("equity").over(w), F.lit(1.0))) - 1)
    return drop.groupBy(*keys).agg(F.min(F.least("_dd", F.lit(0.0))).alias("max_drawdown"))


def difference_drawdown(returns: DataFrame, keys: list[str], order: str = "trade_date", r: str = "r") -> DataFrame:
    """Worst gap between the compounded curve and its peak, as a difference."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    curve = equity_curve(returns, keys, order, r)
    gap = curve.withColumn("_g", F.col("equity") - F.max("equity").over(w))
    return gap.groupBy(*keys).agg(F.min("_g").alias("max_drawdown"))


def performance(returns: DataFrame, keys: list[str], bench: str | None = "bench", rf: float = 0.0, order: str = "trade_date") -> DataFrame:
    """Fourteen measures per series of daily returns ``r``.

    total_return = prod(1+r) - 1; cagr over n/252 years; volatility = sample deviation * sqrt(252);
    sharpe and sortino on excess returns; max_drawdown as a ratio; calmar = cagr/|drawdown|;
    win_rate over non-zero days; profit_factor = gains/|losses|; var_95 = mean - 1.645 deviation;
    cvar_95 = mean below var_95; beta, alpha and information_ratio against ``bench``.
    A series of fewer than two returns has NULLs and total_return 0.
    """
    daily_rf = rf / YEAR
    df = returns.where(F.col("r").isNotNull())
    b = F.col(bench) if bench else F.lit(None).cast("double")
    r, x = F.col("r"), F.col("r") - daily_rf
    both = r.isNotNull() & b.isNotNull()
    g = 1 + r
    product = F.when(F.max(F.when(g == 0, 1).otherwise(0)) == 1, 0.0).otherwise(
        F.when(F.sum(F.when(g < 0, 1).otherwise(0)) % 2 == 1, -1.0).otherwise(1.0)
        * F.exp(F.coalesce(F.sum(F.when(g != 0, F.ln(F.abs(g)))), F.lit(0.0))))
    active = F.when(both, r - b)
    s = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (product - 1).alias("comp"), F.avg(r).alias("mu"), F.stddev_samp(r).alias("sd"),
        F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2))).alias("down"),
        F.count_if(r > 0).alias("wins"), F.count_if(r != 0).alias("moves"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("gain"), F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("loss"),
        F.covar_samp(F.when(both, r), F.when(both, b)).alias("cov"), F.var_samp(F.when(both, b)).alias("bvar"),
        F.avg(F.when(both, b)).alias("bmu"), F.avg(active).alias("amu"), F.stddev_samp(active).alias("asd"),
    ).withColumn("var_95", F.col("mu") - Z95 * F.col("sd"))
    tail = df.join(s.select(*keys, "var_95"), keys).where(r < F.col("var_95")).groupBy(*keys).agg(F.avg("r").alias("tail"))
    out = s.join(tail, keys, "left").join(ratio_drawdown(df, keys, order), keys, "left")
    c = F.col
    cagr = F.when(c("comp") > -1, F.pow(1 + c("comp"), F.lit(float(YEAR)) / c("n")) - 1)
    mu, root = c("mu") - daily_rf, F.sqrt(F.lit(float(YEAR)))
    beta = F.try_divide(c("cov"), c("bvar"))
    values = {
        "cagr": cagr, "volatility": c("sd") * root, "sharpe": F.try_divide(mu, c("sd")) * root,
        "sortino": F.try_divide(mu, c("down")) * root, "max_drawdown": c("max_drawdown"),
        "calmar": F.try_divide(cagr, F.abs("max_drawdown")), "win_rate": F.try_divide(c("wins"), c("moves")),
        "profit_factor": F.try_divide(c("gain"), c("loss")), "var_95": c("var_95"),
        "cvar_95": F.coalesce("tail", "var_95"), "alpha": (mu - beta * (c("bmu") - daily_rf)) * YEAR, "beta": beta,
        "information_ratio": F.try_divide(c("amu"), c("asd")),
    }
    many = c("n") > 1
    return out.select(
        *keys, "n", F.when(many, c("comp")).otherwise(0.0).alias("total_return"),
        *[F.when(many, v).alias(k) for k, v in values.items()],
    )


def composite_score(annual: Column, sharpe: Column, drawdown: Column, trades: Column) -> Column:
    """Calmar plus 0.3 Sharpe minus a charge per trade; a drawdown under -40 % disqualifies."""
    dd = nan_safe(drawdown)
    calmar = nan_safe(annual) / F.greatest(F.abs(dd), F.lit(0.01))
    score = calmar + 0.3 * nan_safe(sharpe) - 0.001 * F.coalesce(trades, F.lit(0))
    return F.when(dd < -0.40, -1e9).otherwise(score)


def walk_forward_summary(steps: DataFrame) -> DataFrame:
    """Mean and sample deviation of auc and p_at_10 over steps, and how many failed."""
    return steps.agg(
        F.count(F.lit(1)).alias("n_steps"), F.count("auc").alias("n_with_auc"),
        F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("std_auc"),
        F.avg("p_at_10").alias("mean_p_at_10"), F.stddev_samp("p_at_10").alias("std_p_at_10"),
        F.count_if(F.col("failed")).alias("n_failed"),
    )


def stability(oos: DataFrame, value: str = "sharpe", limit: float = 0.5) -> DataFrame:
    """Mean and population deviation of an out-of-sample measure; stable when the deviation is small."""
    return oos.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.stddev_pop(value) < limit).alias("stable"))
