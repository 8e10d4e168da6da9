"""All registered queries."""

from tapeloom.plans import audit_queries, cube_queries, daily_queries, feature_queries, news_queries, portfolio_queries, research_queries, stream_queries, table_queries, write_queries  # noqa: F401
from tapeloom.plans.registry import ORACLES, QUERIES

# Columns whose SQL type would differ from the Spark column.
_TYPES = {
    "double": {
        "panel_join": "adj_factor", "affected_factor_history": "adj_factor", "upsert_batches": "adj_factor",
        "feature_limit_up": "is_yi_zi", "feature_news": "news_mentioned_t news_mentioned_t1",
        "features_all": "is_yi_zi news_mentioned_t news_mentioned_t1",
    },
    "bigint": {
        "causality_audit": "look_ahead", "spot_check": "mismatches one_sided", "integrity_summary": "issues",
        "news_day_summary": "text_length", "news_ingest_report": "text_length", "news_baseline": "mentions_total",
        "news_monthly_baselines": "mentions_total", "news_covered_industries": "mentions_total", "trade_fees": "lots",
        "grid_evaluation": "trades", "walk_forward_best": "oos_trades", "repair_counts": "deleted",
    },
}

for _type, _columns in _TYPES.items():
    for _name, _cols in _columns.items():
        _casts = ", ".join(f"cast({c} as {_type}) as {c}" for c in _cols.split())
        ORACLES[_name] = f"select * replace ({_casts}) from ({ORACLES[_name]}) as q"

__all__ = ["QUERIES", "ORACLES"]
