"""Record tables: columns, types and primary keys, and conforming frames to them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType


@dataclass(frozen=True)
class Record:
    """A table: its primary key and its columns as Spark DDL. A wide table holds further measures that
    its user names."""

    table: str
    pk: tuple[str, ...]
    ddl: str
    wide: bool = False

    @property
    def schema(self) -> StructType:
        """The columns as types; key columns are never NULL."""
        fields = StructType.fromDDL(self.ddl).fields
        return StructType([StructField(f.name, f.dataType, f.name not in self.pk) for f in fields])

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


# The record tables with their keys and columns.
TABLES = [
    Record(
        "raw_daily", ("code", "trade_date"),
        "code string, trade_date date, open double, high double, low double, close double, "
        "volume double, amount double, pre_close double, pct_change double, turnover double",
    ),
    Record(
        "adj_factor", ("code", "trade_date"),
        "code string, trade_date date, adj_factor double",
    ),
    Record(
        "index_daily", ("code", "trade_date"),
        "code string, trade_date date, open double, high double, low double, close double, "
        "volume double, amount double, pre_close double, pct_change double",
    ),
    Record(
        "daily_basic", ("code", "trade_date"),
        "code string, trade_date date, close double, turnover_rate double, turnover_rate_f double, "
        "volume_ratio double, pe double, pe_ttm double, pb double, ps double, ps_ttm double, "
        "dv_ratio double, dv_ttm double, total_share double, float_share double, free_share double, "
        "total_mv double, circ_mv double",
    ),
    Record(
        "chip_perf", ("code", "trade_date"),
        "code string, trade_date date, his_low double, his_high double, cost_5pct double, "
        "cost_15pct double, cost_50pct double, cost_85pct double, cost_95pct double, "
        "weight_avg double, winner_rate double",
    ),
    Record(
        "chip_dist", ("code", "trade_date", "price"),
        "code string, trade_date date, price double, percent double",
    ),
    Record(
        "moneyflow", ("code", "trade_date"),
        "code string, trade_date date, buy_sm_amount double, buy_md_amount double, "
        "buy_lg_amount double, buy_elg_amount double, sell_sm_amount double, sell_md_amount double, "
        "sell_lg_amount double, sell_elg_amount double, net_mf_amount double",
    ),
    Record(
        "moneyflow_hsgt", ("trade_date",),
        "trade_date date, hgt double, sgt double, north_money double, south_money double, "
        "ggt_ss double, ggt_sz double",
    ),
    Record(
        "margin_detail", ("code", "trade_date"),
        "code string, trade_date date",
        wide=True,
    ),
    Record(
        "shibor", ("date",),
        "date date, overnight double, w1 double, w2 double, m1 double, m3 double, m6 double, "
        "m9 double, y1 double",
    ),
    Record(
        "fx_daily", ("code", "trade_date"),
        "code string, trade_date date, bid_open double, bid_close double, bid_high double, "
        "bid_low double, ask_open double, ask_close double, ask_high double, ask_low double, "
        "tick_qty double, exchange string",
    ),
    Record(
        "cn_cpi", ("month",),
        "month date, nt_val double, nt_yoy double, nt_mom double, nt_accu double, town_val double, "
        "town_yoy double, town_mom double, town_accu double, cnt_val double, cnt_yoy double, "
        "cnt_mom double, cnt_accu double",
    ),
    Record(
        "cn_ppi", ("month",),
        "month date",
        wide=True,
    ),
    Record(
        "broker_picks", ("month", "broker", "code"),
        "month date, broker string, code string, name string",
    ),
    Record(
        "income", ("code", "end_date", "report_type"),
        "code string, end_date date, report_type string, ann_date date, f_ann_date date, "
        "end_type string",
        wide=True,
    ),
    Record(
        "balancesheet", ("code", "end_date", "report_type"),
        "code string, end_date date, report_type string, ann_date date, f_ann_date date",
        wide=True,
    ),
    Record(
        "cashflow", ("code", "end_date", "report_type"),
        "code string, end_date date, report_type string, ann_date date, f_ann_date date",
        wide=True,
    ),
    Record(
        "fina_indicator", ("code", "end_date"),
        "code string, end_date date, ann_date date",
        wide=True,
    ),
    Record(
        "stk_holder_number", ("code", "end_date"),
        "code string, end_date date, ann_date date, holder_num double",
    ),
    Record(
        "earnings_forecast", ("code", "report_date", "org_name", "author_name"),
        "code string, report_date date, org_name string, author_name string, report_title string, "
        "quarter string, rating string",
        wide=True,
    ),
    Record(
        "dividend", ("code", "end_date", "div_proc"),
        "code string, end_date date, div_proc string, ann_date date, record_date date, ex_date date, "
        "pay_date date",
        wide=True,
    ),
    Record(
        "top_list", ("trade_date", "code", "reason"),
        "trade_date date, code string, reason string, name string",
        wide=True,
    ),
    Record(
        "top_inst", ("trade_date", "code", "exalter", "side", "reason"),
        "trade_date date, code string, exalter string, side string, reason string",
        wide=True,
    ),
    Record(
        "index_weight", ("index_code", "trade_date", "con_code"),
        "index_code string, trade_date date, con_code string, weight double",
    ),
    Record(
        "industry", ("code",),
        "code string, l1_code string, l1_name string, l2_code string, l2_name string, "
        "l3_code string, l3_name string",
    ),
    Record(
        "stock_lifecycle", ("code",),
        "code string, list_status string, name string, list_date date, delist_date date, "
        "market string, industry string, updated_at string",
    ),
    Record(
        "trade_calendar", ("trade_date",),
        "trade_date date, exchange string",
    ),
    Record(
        "sync_watermark", ("code",),
        "code string, last_date date, source string, updated_at string",
    ),
    Record(
        "concept_board", ("board_code",),
        "board_code string, board_name string, src string, member_count long, list_date date, "
        "updated_at string",
    ),
    Record(
        "concept_member", ("board_code", "code"),
        "board_code string, code string, name string, weight double, in_date date, updated_at string",
    ),
    Record(
        "stock_info", ("code",),
        "code string, ticker string, name string, market string, industry string, list_date date, "
        "delist_date date",
    ),
    Record(
        "cctv_news_raw", ("trade_date", "seq"),
        "trade_date date, seq long, title string, content string, ingested_at string",
    ),
    Record(
        "cctv_news_mentions", ("trade_date", "l1_code"),
        "trade_date date, l1_code string, mentioned long, match_score double, weighted_score double, "
        "matched_keywords string, news_source string, ingested_at string",
    ),
    Record(
        "counter_event", ("event_id",),
        "event_id string, ts string, scope string, name string, value double, tags_json string, "
        "run_id string",
    ),
    Record(
        "kpi_snapshot", ("snapshot_id",),
        "snapshot_id string, ts string, domain string, subject string, kpi_name string, "
        "value double, details_json string, run_id string",
    ),
    Record(
        "cash_account", ("account_id",),
        "account_id string, name string, created_at string, memo string",
    ),
    Record(
        "cash_txn", ("txn_id",),
        "txn_id string, account_id string, ts string, txn_type string, amount double, "
        "balance_after double, ref_plan_id string, ref_exec_id string, memo string",
    ),
    Record(
        "dca_plan", ("plan_id",),
        "plan_id string, account_id string, code string, amount_per_run double, frequency string, "
        "start_date date, next_run_date date, end_date date, status string, memo string",
    ),
    Record(
        "dca_execution", ("exec_id",),
        "exec_id string, plan_id string, account_id string, code string, trade_date date, "
        "price double, shares double, amount double, fee double, total_cost double",
    ),
    Record(
        "training_runs", ("run_id",),
        "run_id string, trainer string, started_at string, finished_at string, status string, "
        "n_params long, metric_key string, best_metric double, best_epoch long, note string",
        wide=True,
    ),
    Record(
        "training_metrics", ("run_id", "epoch"),
        "run_id string, epoch long, train_metrics_json string, val_metrics_json string, lr double, "
        "ts string",
        wide=True,
    ),
    Record(
        "backtest_runs", ("run_id",),
        "run_id string, started_at string, finished_at string, status string, strategy string, "
        "metrics_json string, strategy_params_json string, note string",
        wide=True,
    ),
]

RECORDS: dict[str, Record] = {r.table: r for r in TABLES}


def record(table: str, measures: str = "") -> Record:
    """The table's record; ``measures`` adds, as DDL, the further columns of a wide table."""
    known = RECORDS[table]
    if not measures:
        return known
    if not known.wide:
        raise ValueError(f"{table} has a fixed set of columns")
    return replace(known, ddl=f"{known.ddl}, {measures}")


def conform(df: DataFrame, record: Record) -> DataFrame:
    """Declared columns only, typed; an absent column is NULL and a NULL text key becomes ''.
    NaN becomes NULL, and dates may come as date, timestamp or ISO text."""
    have, out = set(df.columns), []
    for f in record.schema:
        if f.name not in have:
            c = F.lit(None).cast(f.dataType)
        elif isinstance(f.dataType, DateType):
            c = F.to_date(F.substring(F.col(f.name).cast("string"), 1, 10))
        else:
            c = F.col(f.name).cast(f.dataType)
            if isinstance(f.dataType, DoubleType):
                c = F.when(~F.isnan(c), c)
        if f.name in record.pk and isinstance(f.dataType, StringType):
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)


OHLCV = ("code", "trade_date", "open", "high", "low", "close", "volume")
OHLCV_OPTIONAL = ("amount", "pre_close", "pct_change", "turnover", "adj_factor")


def require_columns(df: DataFrame, required: tuple[str, ...], label: str) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{label}: missing columns {missing}")


def normalize_ohlcv(df: DataFrame) -> DataFrame:
    """Required columns first, then the optional ones (NULL where absent), then extras by name."""
    require_columns(df, OHLCV, "ohlcv")
    extras = sorted(set(df.columns) - set(OHLCV) - set(OHLCV_OPTIONAL))
    optional = [F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in OHLCV_OPTIONAL]
    return df.select(*OHLCV, *optional, *extras)
