"""Market tables derived from the generic star-schema files."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.operators.calendar import inclusive
from tapeloom.session import store_once
from tapeloom.sources.trades import bars_from_trades, trade_sequence, week_start

EPOCH = "1995-01-02"


def nation_code(c) -> F.Column:
    return F.concat(F.lit("N"), F.lpad(F.col(c).cast("string"), 2, "0"))


def _factor() -> F.Column:
    return F.when(F.day("trade_date") != 13, 1.0 + 0.1 * (F.year("trade_date") - 1995))


def _basic() -> dict[str, F.Column]:
    return {
        "pe_ttm": F.when(F.day("trade_date") % 7 != 0, F.col("close") / 100.0 - 5.0),
        "pb": F.col("close") / 1000.0,
        "turnover_rate": F.col("volume") / 10.0,
        "total_mv": F.col("amount"),
        "circ_mv": F.col("amount") * 0.7,
    }


class Market:
    """Lazy market tables over one data folder; each property is only a plan."""

    def __init__(self, spark: SparkSession, folder: str, start=None, end=None):
        self.spark, self.folder, self.start, self.end = spark, folder, start, end

    def between(self, start=None, end=None) -> Market:
        """The market of an inclusive range of trade dates. The bounds are put on the trades' own date, so they
        reach the scan; a trade date is a Monday and stands for the six days after it too."""
        return Market(self.spark, self.folder, start, end)

    def stored(self, *names: str) -> Market:
        """The same market with these of its tables (bars by default) written once, for queries that use them often; what is
        derived from them follows."""
        out = Market(self.spark, self.folder, self.start, self.end)
        for name in names or ("bars",):
            out.__dict__[name] = store_once(getattr(out, name), name)
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def trades(self) -> DataFrame:
        sup = self.table("supplier").select("s_suppkey", "s_nationkey")
        li = self.table("lineitem")
        if self.start is not None:
            li = li.where(F.col("l_shipdate") >= F.lit(self.start).cast("date"))
        if self.end is not None:
            li = li.where(F.col("l_shipdate") < F.date_add(F.lit(self.end).cast("date"), 7))
        return li.join(sup, li.l_suppkey == sup.s_suppkey).withColumn("code", nation_code("s_nationkey"))

    def _bars(self, more=None) -> DataFrame:
        seq = trade_sequence(
            "l_shipdate", [("l_orderkey", 13), ("l_linenumber", 2)], [("l_partkey", 11), ("l_suppkey", 11)]
        )
        bars = bars_from_trades(
            self.trades, F.col("code"), week_start(F.col("l_shipdate")),
            F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), F.col("l_extendedprice"),
            F.expr(seq), more,
        )
        return inclusive(bars, self.start, self.end)

    @cached_property
    def bars(self) -> DataFrame:
        return self._bars()

    def _flow_terms(self) -> dict[str, F.Column]:
        q, x = F.col("l_quantity"), F.col("l_extendedprice")
        counted, bought = F.col("l_orderkey") % 11 != 0, F.col("l_returnflag") != "R"

        def size(cond):
            return F.when(counted, F.when(bought & cond, x).otherwise(0.0))

        return {
            "buy_sm_amount": size(q <= 12), "buy_md_amount": size((q > 12) & (q <= 25)),
            "buy_lg_amount": size((q > 25) & (q <= 40)), "buy_elg_amount": size(q > 40),
            "net_mf_amount": F.when(counted, F.when(bought, x).otherwise(-2 * x)),
        }

    @cached_property
    def moneyflow(self) -> DataFrame:
        keyed = self.trades.where(F.col("l_orderkey") % 11 != 0).select(
            "code", week_start(F.col("l_shipdate")).alias("trade_date"),
            *[c.alias(n) for n, c in self._flow_terms().items()],
        )
        flow = keyed.groupBy("code", "trade_date").agg(
            *[F.round(F.sum(n), 2).alias(n) for n in self._flow_terms()]
        )
        return inclusive(flow, self.start, self.end)

    @cached_property
    def adj_factor(self) -> DataFrame:
        return self.bars.select("code", "trade_date", _factor().alias("adj_factor"))

    @cached_property
    def daily_basic(self) -> DataFrame:
        return self.bars.where(F.day("trade_date") != 20).select(
            "code", "trade_date", *[c.alias(n) for n, c in _basic().items()]
        )

    @cached_property
    def industry(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        return n.join(r, n.n_regionkey == r.r_regionkey).select(
            nation_code("n_nationkey").alias("code"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("l1_code"),
            F.col("r_name").alias("l1_name"),
        )

    @cached_property
    def stock_lifecycle(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            nation_code("n_nationkey").alias("code"),
            F.when(k % 8 == 3, F.concat(F.lit("ST"), "n_name"))
            .when(k % 8 == 5, F.concat(F.lit("*ST"), "n_name")).otherwise(F.col("n_name")).alias("name"),
            F.when(k % 6 == 1, F.lit("2001-09-01").cast("date"))
            .otherwise(F.lit("1990-01-01").cast("date")).alias("list_date"),
        )

    @cached_property
    def calendar(self) -> DataFrame:
        from tapeloom.operators.calendar import trading_calendar

        return trading_calendar(self.bars)

    @cached_property
    def signals(self) -> DataFrame:
        heavy = self.bars.where(F.col("volume") > 100)
        day = Window.partitionBy("trade_date")
        return heavy.select(
            "trade_date", F.col("code").alias("token_id"),
            (F.col("volume") / F.sum("volume").over(day)).alias("weight"),
        )

    @cached_property
    def counter_event(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").cast("string").alias("event_id"), "ts",
            F.concat(F.lit("pipeline/"), "event_type").alias("scope"),
            F.lit("value").alias("name"), "value", F.col("props").alias("tags_json"),
            F.col("user_id").cast("string").alias("run_id"),
        )

    @cached_property
    def cash_txn(self) -> DataFrame:
        status, price = F.col("o_orderstatus"), F.col("o_totalprice")
        return self.table("orders").select(
            F.concat(F.lit("X"), F.col("o_orderkey").cast("string")).alias("txn_id"),
            F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("account_id"),
            F.col("o_orderdate").alias("ts"),
            F.when(status == "F", "withdraw").when(status == "O", "deposit").otherwise("dca_buy").alias("txn_type"),
            F.when(status == "O", price).otherwise(-price / 4).alias("amount"),
        )

    @cached_property
    def news_raw(self) -> DataFrame:
        return self.table("documents").select(
            F.date_add(F.lit(EPOCH).cast("date"), (7 * (F.col("doc_id") % 357)).cast("int")).alias("trade_date"),
            F.col("doc_id").alias("seq"), F.col("lang").alias("title"), F.col("text").alias("content"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        return self.table("documents").join(self.table("labels"), "doc_id").select(
            "doc_id", (F.col("doc_id") % 40).cast("int").alias("day_idx"),
            (F.col("n_chars") / 1000.0).alias("score"), F.col("quality").alias("label"),
        )

    @cached_property
    def joined_panel(self) -> DataFrame:
        """The panel from four separate tables."""
        from tapeloom.operators.panel import build_panel

        return build_panel(self.bars, self.daily_basic, self.moneyflow, self.adj_factor)

    @cached_property
    def panel(self) -> DataFrame:
        """The same panel in one pass: here all four tables come from the same trades."""
        wide = self._bars(self._flow_terms())
        return wide.withColumns({
            **{n: F.when(F.day("trade_date") != 20, c) for n, c in _basic().items()},
            "adj_factor": _factor(),
        })
