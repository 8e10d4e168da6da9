"""News queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.columns import r6
from tapeloom.operators import news
from tapeloom.plans.dictionary import ENTRIES, KEYWORD_SQL
from tapeloom.plans.feature_queries import DAY_HITS
from tapeloom.plans.registry import query

WORDS = f"""{DAY_HITS}, km as (select n.trade_date, k.l1_code, string_agg(distinct concat(lpad(cast(k.pos as varchar), 2, '0'), k.keyword), ',' order by concat(lpad(cast(k.pos as varchar), 2, '0'), k.keyword)) as w
  from news_raw n join kw k on contains(n.content, k.keyword) group by 1, 2)"""


@query("news_mentions", f"with {WORDS} select m.trade_date, m.l1_code, m.l1_name, m.hits, round(match_score, 6) as match_score, w as words from ment m join km using (trade_date, l1_code)", "news_raw")
def news_mentions(m):
    words = F.array_join(F.transform("matched_keywords", lambda x: x), ",")
    out = news.mentions(m.news_raw, ENTRIES)
    pos = {(c, k): i for c, _, ks in ENTRIES for i, k in enumerate(ks)}
    table = F.create_map(*[F.lit(x) for (c, k), i in pos.items() for x in (f"{c}{k}", f"{i:02d}{k}")])
    words = F.array_join(F.transform("matched_keywords", lambda k: F.element_at(table, F.concat("l1_code", k))), ",")
    return out.select("trade_date", "l1_code", "l1_name", "hits", r6("match_score").alias("match_score"), words.alias("words"))


@query("news_day_summary", "select trade_date, count(*) as raw_rows, sum(length(content)) + count(*) - 1 as text_length from news_raw group by 1", "news_raw")
def news_day_summary(m):
    return news.day_summary(m.news_raw)


IDF = "round(case when days < 10 then 1.0 else ln(days / (coalesce(dm, 0) + 1)) + 1 end, 4)"

BASE = f"""{DAY_HITS}, ind as (select distinct l1_code, l1_name from kw), win as (select * from hits where trade_date between date '1996-01-01' and date '1998-12-31'),
 base as (select i.l1_code, i.l1_name, coalesce(dm, 0) as days_mentioned, coalesce(mt, 0) as mentions_total, round(coalesce(mt, 0) / days, 3) as mentions_per_day, {IDF} as idf
  from ind i cross join (select count(distinct trade_date) as days from news_raw where trade_date between date '1996-01-01' and date '1998-12-31')
  left join (select l1_code, count(*) as dm, sum(hits) as mt from win group by 1) using (l1_code))"""


@query("news_baseline", f"with {BASE} select * from base", "news_raw")
def news_baseline(m):
    return baseline(m)


def baseline(m):
    return news.baseline(m.news_raw, ENTRIES, "1996-01-01", "1998-12-31")


MONTHLY = f"""mon as (select unnest(generate_series(date '1996-01-01', date '1999-06-01', interval 1 month))::date as "month"), dayset as (select distinct trade_date from news_raw),
 md as (select "month", count(*) as days from mon join dayset on trade_date between "month" - 300 and "month" - 1 group by 1),
 mh as (select "month", l1_code, count(*) as dm, sum(hits) as mt from mon join hits on trade_date between "month" - 300 and "month" - 1 group by 1, 2),
 mb as (select md."month", i.l1_code, i.l1_name, coalesce(dm, 0) as days_mentioned, coalesce(mt, 0) as mentions_total, round(coalesce(mt, 0) / days, 3) as mentions_per_day, {IDF} as idf
  from md cross join ind i left join mh on mh."month" = md."month" and mh.l1_code = i.l1_code)"""


def monthly(m):
    return news.monthly_baselines(m.news_raw, ENTRIES, 300, "1996-01-01", "1999-06-01")


@query("news_monthly_baselines", f"with {BASE}, {MONTHLY} select * from mb", "news_raw")
def news_monthly_baselines(m):
    return monthly(m)


WEIGHTED = f"""{BASE}, {MONTHLY}, wt as (select t.trade_date, t.l1_code, t.match_score, case when h."month" is not null then p.idf else g.idf end as idf from ment t
  left join (select distinct "month" from mb) h on h."month" = date_trunc('month', t.trade_date) left join mb p on p."month" = date_trunc('month', t.trade_date) and p.l1_code = t.l1_code left join base g on g.l1_code = t.l1_code)"""


@query("news_weighted_mentions", f"with {WEIGHTED} select trade_date, l1_code, idf, round(match_score * idf, 6) as weighted_score from wt", "news_raw")
def news_weighted_mentions(m):
    found, _ = news.ingest_days(m.news_raw, ENTRIES, monthly(m), baseline(m))
    return found.select("trade_date", "l1_code", "idf", r6("weighted_score").alias("weighted_score"))


@query("news_ingest_report", f"""with {DAY_HITS} select r.trade_date, count(*) as raw_rows, sum(length(content)) + count(*) - 1 as text_length,
  any_value(coalesce(c, 0)) as mentions from news_raw r left join (select trade_date, count(*) as c from ment group by 1) using (trade_date) group by 1""", "news_raw")
def news_ingest_report(m):
    _, report = news.ingest_days(m.news_raw, ENTRIES, monthly(m), baseline(m))
    return report


@query("keyword_day_share", f"""with {KEYWORD_SQL}, d as (select keyword, count(distinct trade_date) as days from news_raw join (select distinct keyword from kw) on contains(content, keyword) group by 1),
  c as (select keyword, count(distinct l1_code) as n_industries from kw group by 1) select keyword, n_industries, days from c join d using (keyword)""", "news_raw")
def keyword_day_share(m):
    dim = news.dictionary_frame(m.spark, ENTRIES)
    days = news.day_words(m.news_raw, ENTRIES).groupBy("keyword").agg(F.count(F.lit(1)).alias("days"))
    owners = dim.groupBy("keyword").agg(F.count_distinct("l1_code").alias("n_industries"))
    return owners.join(days, "keyword")


TOKENS = "tok as (select lang as l1_code, split_part(trim(text), ' ', 1) as keyword from documents)"


@query("dictionary_lint", f"""with {TOKENS}, p as (select l1_code, count(*) as n, count(distinct keyword) as d, max(case when trim(keyword) = '' then 1 else 0 end) as b from tok group by 1)
  select l1_code, 'too_few' as issue, null::varchar as detail from p where n < 150 union all select l1_code, 'too_many', null from p where n > 400 union all select l1_code, 'duplicate', null from p where d < n
  union all select l1_code, 'empty_keyword', null from p where b = 1 union all select '_CROSS', 'conflict', keyword from tok group by keyword having count(distinct l1_code) > 1""")
def dictionary_lint(m):
    first = F.split_part(F.trim("text"), F.lit(" "), F.lit(1))
    dim = m.table("documents").select(F.col("lang").alias("l1_code"), first.alias("keyword"))
    return news.lint_dictionary(dim, 150, 400, 1)


@query("news_covered_industries", f"with {BASE} select count(*) as industries, count(*) filter (days_mentioned > 0) as covered, sum(mentions_total) as mentions_total from base", "news_raw")
def news_covered_industries(m):
    return news.covered_industries(baseline(m))
