"""Sector lead-lag statistics and the sector relay selection.

A sector panel has a few tens of series by construction, and the wanted matrices have one cell
per (leader, follower); the number of cells, not the data, bounds what is formed per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sector_returns(grid: DataFrame) -> DataFrame:
    """Simple returns on the calendar; a missing close repeats the last one."""
    w = Window.partitionBy("code").orderBy("day_idx")
    known = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    filled = grid.select("code", "trade_date", "day_idx", known.alias("p"))
    r = F.try_divide(F.col("p"), F.lag("p").over(w)) - 1
    return filled.select("code", "trade_date", "day_idx", r.alias("r")).where(F.col("r").isNotNull())


def returns_matrix(returns: DataFrame, names: list[str]) -> DataFrame:
    """Wide form (date by series), for output only; the names are given, so no extra pass
    collects them. Dates without any return are absent."""
    return returns.groupBy("trade_date").pivot("code", names).agg(F.first("r"))


def _lagged_pairs(returns: DataFrame, lags: list[int]) -> DataFrame:
    """(lag, leader, follower, ra, rb): A_t next to B_(t+lag), for all lags in one join."""
    lead = returns.select(F.col("code").alias("leader"), "day_idx", F.col("r").alias("ra"))
    follow = returns.select(F.col("code").alias("follower"), "day_idx", F.col("r").alias("rb"), F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    return lead.join(follow.withColumn("day_idx", F.col("day_idx") - F.col("lag")), "day_idx")


def lag_correlation(returns: DataFrame, lags: list[int]) -> DataFrame:
    """(lag, leader, follower, corr, n): corr(A_t, B_(t+lag)) for all ordered pairs and lags; the co-moments are
    summed map-side per pair and lag."""
    c = F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb"))
    return _lagged_pairs(returns, lags).groupBy("lag", "leader", "follower").agg(c.alias("corr"), F.count(F.lit(1)).alias("n"))


def top_followers(corr: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("leader").orderBy(F.col("corr").desc_nulls_last(), "follower")
    others = corr.where((F.col("leader") != F.col("follower")) & F.col("corr").isNotNull())
    return others.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def contagion_lift(returns: DataFrame, threshold: float = 0.02, lag: int = 3) -> DataFrame:
    """P(B > threshold at t+lag | A > threshold at t) over P(B > threshold), for every ordered pair of sectors
    with a common day. Days without a value count as no rise."""
    rose = F.col("r") > threshold
    span = returns.agg(F.min("day_idx").alias("first"), F.max("day_idx").alias("last"))
    first, last = span.select("first").scalar(), span.select("last").scalar()
    own = returns.groupBy("code").agg((F.count_if(rose) / (last - first + 1)).alias("base"), F.count_if(rose & (F.col("day_idx") + lag <= last)).alias("events"))
    both = F.count_if((F.col("ra") > threshold) & (F.col("rb") > threshold))
    cells = _lagged_pairs(returns, [lag]).groupBy("leader", "follower").agg(both.alias("hits"))
    out = cells.join(own.select(F.col("code").alias("leader"), "events"), "leader").join(own.select(F.col("code").alias("follower"), "base"), "follower")
    cond = F.coalesce(F.try_divide(F.col("hits"), F.col("events")), F.lit(0.0))
    return out.select("leader", "follower", F.coalesce(F.try_divide(cond, F.col("base")), F.lit(0.0)).alias("lift"))


def strongest_pairs(lift: DataFrame, k: int = 10) -> DataFrame:
    return lift.where(F.col("leader") != F.col("follower")).orderBy(F.col("lift").desc(), "leader", "follower").limit(k)


def relay_targets(grid: DataFrame, followers: DataFrame, lookback: int = 5, period: int = 5, n_leaders: int = 3, n_hold: int = 3) -> DataFrame:
    """Sectors to hold on each rebalance day.

    The strongest sectors over ``lookback`` days lead; their followers (in leader order, then map
    order, each once, leaders excluded) are the candidates; those below the upper median return
    are kept, or all candidates when none is below; without followers the leaders themselves.
    """
    w = Window.partitionBy("code").orderBy("day_idx")
    past = F.lag("close", lookback).over(w)
    ret = F.when(past > 0, (F.col("close") - past) / past)
    days = grid.select("code", "trade_date", "day_idx", ret.alias("ret")).where(
        F.col("ret").isNotNull() & (F.col("day_idx") >= lookback) & ((F.col("day_idx") + 1) % period == 0))
    by_ret = Window.partitionBy("day_idx").orderBy(F.col("ret").desc(), "code")
    up = Window.partitionBy("day_idx").orderBy("ret", "code")
    n = F.count(F.lit(1)).over(Window.partitionBy("day_idx"))
    ranked = days.select("*", F.row_number().over(by_ret).cast("bigint").alias("rank"), (F.row_number().over(up) - 1).alias("asc"), n.alias("n"))
    medians = ranked.where(F.col("asc") == F.floor(F.col("n") / 2)).select("day_idx", F.col("ret").alias("median"))
    leaders = ranked.where(F.col("rank") <= n_leaders).select("trade_date", "day_idx", "code", F.col("rank").alias("leader_rank"))
    cand = leaders.join(followers.select(F.col("leader").alias("code"), F.col("follower"), F.col("rank").alias("pos")), "code")
    cand = cand.groupBy("trade_date", "day_idx", F.col("follower").alias("code")).agg(F.min(F.struct("leader_rank", "pos")).alias("ord"))
    cand = cand.join(leaders.select("day_idx", "code"), ["day_idx", "code"], "left_anti")
    cand = cand.join(days.select("day_idx", "code", "ret"), ["day_idx", "code"], "left").join(medians, "day_idx")
    cold = F.coalesce("ret", F.lit(0.0)) < F.col("median")
    g = Window.partitionBy("day_idx")
    cand = cand.withColumn("cold", cold).withColumn("any_cold", F.max("cold").over(g)).where("cold or not any_cold")
    picks = cand.withColumn("rank", F.row_number().over(g.orderBy("ord")).cast("bigint")).where(F.col("rank") <= n_hold).select("trade_date", "day_idx", "code", "rank")
    bare = leaders.join(cand.select("day_idx").distinct(), "day_idx", "left_anti").where(F.col("leader_rank") <= n_hold)
    return picks.unionByName(bare.select("trade_date", "day_idx", "code", F.col("leader_rank").alias("rank")))
