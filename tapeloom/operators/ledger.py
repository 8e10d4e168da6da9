"""Cash ledger, holdings and savings plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import next_run_date
from tapeloom.functions.ranks import running_totals

EPS = 1e-6


def balances(txns: DataFrame) -> DataFrame:
    """Balance and invested amount (deposits and withdrawals only) per account."""
    own = F.col("txn_type").isin("deposit", "withdraw")
    return txns.groupBy("account_id").agg(
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("balance"),
        F.coalesce(F.sum(F.when(own, F.col("amount"))), F.lit(0.0)).alias("invested"))


def running_balance(txns: DataFrame) -> DataFrame:
    """Balance after each transaction, in two levels by day so that a busy account is spread."""
    return running_totals(txns, ["account_id"], F.col("ts").cast("date"), ["ts", "txn_id"], {"balance_after": "amount"})


def portfolio(executions: DataFrame) -> DataFrame:
    """Shares, amounts, fees and average cost (without fees) per account and code."""
    return executions.groupBy("account_id", "code").agg(
        F.sum("shares").alias("shares"), F.try_divide(F.sum("amount"), F.sum("shares")).alias("avg_cost"),
        F.sum("amount").alias("total_amount"), F.sum("fee").alias("total_fee"), F.sum("total_cost").alias("total_cost"))


def latest_closes(bars: DataFrame) -> DataFrame:
    """Close of each code's newest bar."""
    return bars.groupBy("code").agg(F.max_by("close", "trade_date").alias("last_price"), F.max("trade_date").alias("last_date"))


def holdings_with_prices(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """Market value and profit; a code without a price is worth 0."""
    df = holdings.join(prices.select("code", "last_price"), "code", "left")
    value = F.col("shares") * F.coalesce("last_price", F.lit(0.0))
    df = df.withColumn("market_value", value).withColumn("pnl", F.col("market_value") - F.col("total_cost"))
    return df.withColumn("pnl_pct", F.try_divide("pnl", "total_cost"))


def account_summary(txns: DataFrame, executions: DataFrame, prices: DataFrame) -> DataFrame:
    held = holdings_with_prices(portfolio(executions), prices).groupBy("account_id").agg(
        F.sum("market_value").alias("market_value"), F.sum("pnl").alias("floating_pnl"))
    df = balances(txns).join(held, "account_id", "left").fillna(0.0, ["market_value", "floating_pnl"])
    total = F.col("balance") + F.col("market_value")
    return df.select(
        "account_id", F.col("balance").alias("cash"), "market_value", total.alias("total_asset"), "floating_pnl",
        F.when(F.col("invested") != 0, total - F.col("invested")).otherwise(0.0).alias("total_pnl"))


def listed_codes(bars: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Distinct codes with a display label; a code without a name shows itself only."""
    df = bars.select("code").distinct().join(lifecycle.select("code", "name"), "code", "left")
    return df.select("code", F.coalesce("name", F.lit("")).alias("name"), F.concat_ws(" ", "code", "name").alias("label"))


def due_plans(plans: DataFrame, as_of) -> DataFrame:
    return plans.where((F.col("status") == "ACTIVE") & (F.col("next_run_date") <= F.lit(as_of).cast("date")))


def execute_due_plans(plans: DataFrame, prices: DataFrame, balance: DataFrame, as_of, fee_rate: float = 0.0) -> DataFrame:
    """Execute the due plans of a day: accepted when the account can still pay, in order of due
    date and plan id; an unaffordable plan is skipped and later cheaper ones may still run.

    Accounts that can pay for everything, decided by one aggregate, need no ordering. Only
    accounts that run short are walked plan by plan: their rows stream through in sorted
    batches and only the remaining money is carried along, so no account is held in memory.
    """
    due = due_plans(plans, as_of).join(prices.select("code", "last_price"), "code").where("last_price > 0")
    cost = F.col("amount_per_run") * (1 + fee_rate)
    due = due.withColumn("total_cost", cost)
    need = due.groupBy("account_id").agg(F.sum("total_cost").alias("need"))
    funds = need.join(balance.select("account_id", "balance"), "account_id", "left").fillna(0.0, ["balance"])
    funded = due.join(funds, "account_id")
    rich = funded.where(F.col("balance") + EPS >= F.col("need")).select("plan_id", F.lit(True).alias("accepted"))
    short = funded.where(F.col("balance") + EPS < F.col("need")).select("account_id", "next_run_date", "plan_id", "total_cost", "balance")
    ordered = short.repartition("account_id").sortWithinPartitions("account_id", "next_run_date", "plan_id")
    walked = ordered.mapInPandas(_walk, "plan_id string, accepted boolean")
    df = due.join(rich.unionByName(walked), "plan_id")
    nxt = next_run_date(F.lit(as_of).cast("date"), F.col("frequency"))
    ok = F.col("accepted")
    over = F.col("end_date").isNotNull() & (nxt > F.col("end_date"))
    return df.select(
        "plan_id", "account_id", "code", "accepted",
        F.when(ok, F.try_divide("amount_per_run", "last_price")).alias("shares"), F.when(ok, F.col("total_cost")).alias("cost"),
        F.when(ok, nxt).otherwise(F.col("next_run_date")).alias("next_run_date"),
        F.when(ok & over, "STOPPED").otherwise(F.col("status")).alias("status"))


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    account, left = None, 0.0
    for batch in batches:
        taken = []
        for who, cost, money in zip(batch["account_id"], batch["total_cost"], batch["balance"]):
            if who != account:
                account, left = who, money
            ok = left + EPS >= cost
            left -= cost if ok else 0.0
            taken.append(ok)
        yield pd.DataFrame({"plan_id": batch["plan_id"], "accepted": taken})


# States a plan may move between.
ALLOWED = {("ACTIVE", "PAUSED"), ("PAUSED", "ACTIVE"), ("ACTIVE", "STOPPED"), ("PAUSED", "STOPPED")}


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Status changes of a plan log (plan_id, seq, status) that are not allowed. The ordered
    pass per plan carries only the previous status."""
    w = Window.partitionBy("plan_id").orderBy("seq")
    df = log.withColumn("previous", F.lag("status").over(w)).where(F.col("previous").isNotNull())
    legal = F.lit(False)
    for a, b in sorted(ALLOWED):
        legal = legal | ((F.col("previous") == a) & (F.col("status") == b))
    return df.where(~legal & (F.col("previous") != F.col("status"))).select("plan_id", "seq", "previous", "status")
