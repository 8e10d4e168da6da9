"""SQL text of the market views, used only to state the expected results."""

VIEWS: dict[str, tuple[list[str], str]] = {
    "bars": (
        [],
        """
select concat('N', lpad(cast(s.s_nationkey as string), 2, '0')) as code,
  cast(date_trunc('week', l.l_shipdate) as date) as trade_date,
  min_by(l.l_extendedprice / l.l_quantity, (l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice)) as open,
  max(l.l_extendedprice / l.l_quantity) as high,
  min(l.l_extendedprice / l.l_quantity) as low,
  max_by(l.l_extendedprice / l.l_quantity, (l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice)) as close,
  sum(l.l_quantity) as volume, round(sum(l.l_extendedprice), 2) as amount
from lineitem l join supplier s on l.l_suppkey = s.s_suppkey group by 1, 2
""",
    ),
    "moneyflow": (
        [],
        """
select concat('N', lpad(cast(s.s_nationkey as string), 2, '0')) as code,
  cast(date_trunc('week', l.l_shipdate) as date) as trade_date,
  round(sum(case when l_returnflag <> 'R' and l_quantity <= 12 then l_extendedprice else 0 end), 2) as buy_sm_amount,
  round(sum(case when l_returnflag <> 'R' and l_quantity > 12 and l_quantity <= 25 then l_extendedprice else 0 end), 2) as buy_md_amount,
  round(sum(case when l_returnflag <> 'R' and l_quantity > 25 and l_quantity <= 40 then l_extendedprice else 0 end), 2) as buy_lg_amount,
  round(sum(case when l_returnflag <> 'R' and l_quantity > 40 then l_extendedprice else 0 end), 2) as buy_elg_amount,
  round(sum(case when l_returnflag <> 'R' then l_extendedprice else -2 * l_extendedprice end), 2) as net_mf_amount
from lineitem l join supplier s on l.l_suppkey = s.s_suppkey
where l.l_orderkey % 11 <> 0 group by 1, 2
""",
    ),
    "adj_factor": (
        ['bars'],
        """
select code, trade_date, case when day(trade_date) = 13 then null else 1.0 + 0.1 * (year(trade_date) - 1995) end as adj_factor from bars
""",
    ),
    "daily_basic": (
        ['bars'],
        """
select code, trade_date, case when day(trade_date) % 7 = 0 then null else close / 100.0 - 5.0 end as pe_ttm, close / 1000.0 as pb, volume / 10.0 as turnover_rate, amount as total_mv, amount * 0.7 as circ_mv from bars where day(trade_date) <> 20
""",
    ),
    "industry": (
        [],
        """
select concat('N', lpad(cast(n_nationkey as string), 2, '0')) as code, concat('R', cast(n_regionkey as string)) as l1_code, r_name as l1_name from nation join region on n_regionkey = r_regionkey
""",
    ),
    "stock_lifecycle": (
        [],
        """
select concat('N', lpad(cast(n_nationkey as string), 2, '0')) as code, case n_nationkey % 8 when 3 then concat('ST', n_name) when 5 then concat('*ST', n_name) else n_name end as name, cast(case when n_nationkey % 6 = 1 then date '2001-09-01' else date '1990-01-01' end as date) as list_date from nation
""",
    ),
    "calendar": (
        ['bars'],
        """
select trade_date, cast(row_number() over (order by trade_date) - 1 as bigint) as day_idx from (select distinct trade_date from bars) d
""",
    ),
    "signals": (
        ['bars'],
        """
select trade_date, code as token_id, volume / sum(volume) over (partition by trade_date) as weight from bars where volume > 100
""",
    ),
    "counter_event": (
        [],
        """
select cast(event_id as string) as event_id, ts, concat('pipeline/', event_type) as scope, 'value' as name, value, props as tags_json, cast(user_id as string) as run_id from events
""",
    ),
    "cash_txn": (
        [],
        """
select concat('X', cast(o_orderkey as string)) as txn_id, concat('A', cast(o_custkey as string)) as account_id, o_orderdate as ts, case o_orderstatus when 'F' then 'withdraw' when 'O' then 'deposit' else 'dca_buy' end as txn_type, case when o_orderstatus = 'O' then o_totalprice else -o_totalprice / 4 end as amount from orders
""",
    ),
    "news_raw": (
        [],
        """
select cast(date_add(date '1995-01-02', cast(7 * (doc_id % 357) as int)) as date) as trade_date, doc_id as seq, lang as title, text as content from documents
""",
    ),
    "scores": (
        [],
        """
select d.doc_id, cast(d.doc_id % 40 as int) as day_idx, d.n_chars / 1000.0 as score, l.quality as label from documents d join labels l on d.doc_id = l.doc_id
""",
    ),
    "panel": (
        ["bars", "daily_basic", "moneyflow", "adj_factor"],
        """
select b.*, d.pe_ttm, d.pb, d.turnover_rate, d.total_mv, d.circ_mv,
  m.buy_sm_amount, m.buy_md_amount, m.buy_lg_amount, m.buy_elg_amount, m.net_mf_amount, a.adj_factor
from bars b left join daily_basic d using (code, trade_date)
left join moneyflow m using (code, trade_date) left join adj_factor a using (code, trade_date)
""",
    ),
}
