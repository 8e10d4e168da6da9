"""The training cube of every phase."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.columns import r6
from tapeloom.operators import cube as cu
from tapeloom.operators import features as feat
from tapeloom.operators import news
from tapeloom.operators import universe as uni
from tapeloom.plans.dictionary import ENTRIES
from tapeloom.plans.feature_queries import ALL_FEATURES_SQL, z_digits, z_sql
from tapeloom.plans.registry import query
from tapeloom.plans.view_sql import VIEWS

UNIVERSE_SIZE, UNIVERSE_DAY = 12, "2001-06-30"
STOCK_COLUMNS = "code, trade_date, open, high, low, close, volume, amount, pe_ttm, pb, turnover_rate, total_mv, circ_mv, buy_sm_amount, buy_md_amount, buy_lg_amount, buy_elg_amount, net_mf_amount, adj_factor"


def suffixed(df):
    """Index codes end in .SI, as an industry's news then names its index."""
    return df.withColumn("l1_code", F.concat("l1_code", F.lit(".SI")))


def _cube_sql(phase: int) -> str:
    kinds = cu.PHASES[phase]
    panels = {
        0: "select * from idx",
        1: f"select {STOCK_COLUMNS} from stock_panel where code in (select code from uni)",
    }
    tokens = {
        0: "select 0 as token_type, l1 || '.SI' as code, industry_id from ids",
        1: "select 1, code, coalesce(industry_id, 0) from uni left join nations using (code) left join ids on l1 = l1_code",
    }
    more = "g.open, g.high, g.low, l.label, " if phase == 3 else ""
    labels = """lab as (select g.code, g.day_idx, case when s.open is null or b.open is null or b.high is null then -1
   when abs(b.open - b.high) < 1e-4 and abs(b.open - b.low) < 1e-4 then -1 when s.open / b.open - 1 >= 0.05 then 1 else 0 end as label
  from grid g left join grid b on b.code = g.code and b.day_idx = g.day_idx + 1 left join grid s on s.code = g.code and s.day_idx = g.day_idx + 2)"""
    label_join = "join lab l on l.code = g.code and l.day_idx = g.day_idx" if phase == 3 else ""
    return f"""with nations as ({VIEWS['industry'][1]}), stock_panel as ({VIEWS['panel'][1]}),
  ids as (select l1_code as l1, cast(row_number() over (order by l1_code) - 1 as integer) as industry_id from (select distinct l1_code from nations)),
  uni as (select code from daily_basic join stock_lifecycle using (code) where trade_date = (select max(trade_date) from daily_basic where trade_date <= date '{UNIVERSE_DAY}')
    and turnover_rate > 0 and circ_mv is not null and name not ilike 'st%' and name not ilike '*st%' and list_date < trade_date - 120 order by circ_mv desc, code limit {UNIVERSE_SIZE}),
  idx as (select l1_code || '.SI' as code, trade_date, avg(open) as open, avg(high) as high, avg(low) as low, avg(close) as close, sum(volume) as volume, sum(amount) as amount,
    {', '.join(f'null::double as {c.strip()}' for c in STOCK_COLUMNS.split(',')[8:])} from bars join nations using (code) group by 1, 2),
  panel as ({' union all '.join(panels[k] for k in kinds)}),
  industry as (select code, l1_code from nations union all select l1 || '.SI', l1 from ids),
  {ALL_FEATURES_SQL},
  tokens as (select cast(row_number() over (order by token_type, code) - 1 as integer) as token_idx, code, token_type, industry_id from ({' union all '.join(tokens[k] for k in kinds)}) as t(token_type, code, industry_id)),
  kinds as (select f.*, token_type from feats f join tokens using (code)),
  z as (select code, trade_date, {', '.join(z_sql(c, 'token_type, trade_date') for c in feat.FEATURES)} from kinds),
  days as (select trade_date, cast(row_number() over (order by trade_date) - 1 as bigint) as day_idx from (select distinct trade_date from panel)),
  grid as (select t.code, d.trade_date, d.day_idx, p.open, p.high, p.low, p.close from tokens t cross join days d left join panel p using (code, trade_date)),
  {labels if phase == 3 else 'none as (select 1)'}
  select g.trade_date, g.day_idx, t.token_idx, g.code, t.token_type, t.industry_id, round(g.close, 6) as close, g.close is not null as traded, {more}
    {', '.join(f'coalesce(z.{c}, 0.0) as {c}' for c in feat.FEATURES)}
  from grid g join tokens t using (code) left join z on z.code = g.code and z.trade_date = g.trade_date {label_join}"""


def cube(m, phase: int):
    industry, mentions = suffixed(m.industry), suffixed(news.mentions(m.news_raw, ENTRIES))
    universe = uni.select_universe("top_mv", m.daily_basic, m.stock_lifecycle, None, UNIVERSE_SIZE, UNIVERSE_DAY)
    return cu.phase_cube(phase, m.panel, cu.index_bars(m.bars, industry), industry, mentions, universe)


def _register(phase: int) -> None:
    @query(f"cube_phase{phase}", _cube_sql(phase), "bars daily_basic moneyflow adj_factor stock_lifecycle news_raw")
    def run(m):
        blocks = cu.cube_blocks(cube(m, phase), tokens_per_block=8, real="double")
        rows = cu.cube_rows(blocks).withColumn("close", r6("close"))
        return rows.withColumns({c: r6(c, z_digits(c)) for c in feat.FEATURES})


for _phase in cu.PHASES:
    _register(_phase)
