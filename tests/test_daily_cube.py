"""The training cube's blocks and the daily job's store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import audit
from tapeloom.operators import cube as cu
from tapeloom.operators import daily
from tapeloom.operators.features import FEATURES
from tapeloom.plans import daily_queries
from tapeloom.plans.catalog import QUERIES
from tapeloom.plans.cube_queries import cube
from tapeloom.session import scratch_dir
from tapeloom.sources.market_views import Market

FOLDER = "/root/testdata/sf0.001"
D = dt.date


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def market(spark):
    return Market(spark, FOLDER)


def test_token_index_has_two_levels(make):
    industry = make("code string, l1_code string", ("B", "I2"), ("A", "I1"), ("X", None))
    universe = make("code string", ("B",), ("A",), ("X",), ("new",))
    rows = lambda phase: [tuple(r) for r in cu.token_index(industry, universe, phase).orderBy("token_idx").collect()]
    industries = [(0, "I1", 0, 0), (1, "I2", 0, 1)]
    assert rows(1) == industries
    assert rows(2) == [*industries, (2, "A", 1, 0), (3, "B", 1, 1), (4, "X", 1, 0), (5, "new", 1, 0)]
    assert [r[1:] for r in rows(3)] == [("A", 1, 0), ("B", 1, 1), ("X", 1, 0), ("new", 1, 0)]


def test_stored_cube_prunes_days_and_keeps_rows(spark, market):
    found = cube(market, 3).where("trade_date >= date '2001-01-01'")
    blocks = cu.cube_blocks(found, tokens_per_block=4)
    path = scratch_dir(spark, "cube")
    cu.write_cube(blocks, path)
    part = cu.read_cube(spark, path, "2001-03-01", "2001-04-30")
    assert "PartitionFilters: [isnotnull(trade_date" in plan(part)
    assert max(len(r.token_idx) for r in part.collect()) <= 4
    back = cu.cube_rows(part).select("trade_date", "code", "label", "close", F.round("ret_5d", 4).alias("x"))
    want = found.where("trade_date between date '2001-03-01' and date '2001-04-30'").select("trade_date", "code", "label", "close", F.round(F.col("ret_5d").cast("float").cast("double"), 4).alias("x"))
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0
    # a day written again replaces its blocks, other days stay
    before = cu.read_cube(spark, path).select("trade_date").distinct().count()
    cu.write_cube(blocks.where("trade_date = date '2001-03-05'"), path)
    assert cu.read_cube(spark, path).select("trade_date").distinct().count() == before
    with pytest.raises(ValueError):
        cube(market, 4)


def _feats(spark, rows):
    schema = daily.FEATURE_SCHEMA
    return spark.createDataFrame([(c, d, *[v] * len(FEATURES)) for c, d, v in rows], schema)


def test_store_reads_the_newest_committed_version(spark):
    store = daily.feature_days(spark, scratch_dir(spark, "days"))
    assert store.read().count() == 0
    store.write(_feats(spark, [("A", D(2024, 1, 1), 1.0), ("A", D(2024, 1, 2), 1.0)]), 0)
    store.write(_feats(spark, [("A", D(2024, 1, 2), 2.0), ("B", D(2024, 1, 2), 2.0)]), 1)
    read = lambda **how: sorted((r.trade_date.day, r.code, r.ret_1d) for r in store.read(**how).collect())
    assert read() == [(1, "A", 1.0), (2, "A", 2.0), (2, "B", 2.0)]
    assert read(upto=0) == [(1, "A", 1.0), (2, "A", 1.0)]
    store.write(_feats(spark, [("A", D(2024, 1, 2), 2.0), ("B", D(2024, 1, 2), 2.0)]), 1)  # the same run again
    assert read() == [(1, "A", 1.0), (2, "A", 2.0), (2, "B", 2.0)]
    # rows without a commit do not count: a run that died before its end
    _feats(spark, [("C", D(2024, 1, 3), 3.0)]).write.partitionBy("trade_date").parquet(f"{store.days}/version=2")
    assert read() == [(1, "A", 1.0), (2, "A", 2.0), (2, "B", 2.0)]
    assert "PartitionFilters: [isnotnull(trade_date" in plan(store.read(start="2024-01-02"))


def test_second_day_reuses_the_first(spark, market):
    store, runs = daily_queries.run_days(market)
    first, second = (d for d, *_ in runs)
    known = {(r.trade_date, r.version) for r in store.versions().collect()}
    assert (first, 1) in known and (second, 2) in known and len({d for d, _ in known}) == len(known)
    _, stats, _ = runs[1]
    text = plan(stats)
    # the audit reads stored days only: no trade is read, no feature computed again
    assert "lineitem" not in text and "version" in text
    before = {r.feature: r.q_high for r in daily_rolling(store, second)}
    changed = store.read(first, first).withColumn("turnover", F.lit(1e9))
    store.write(spark.createDataFrame(changed.collect(), changed.schema), 3)
    after = {r.feature: r.q_high for r in daily_rolling(store, second)}
    assert after["turnover"] > before["turnover"] and after["ret_1d"] == before["ret_1d"]


def daily_rolling(store, day):
    from tapeloom.operators import audit

    known = store.read(day - dt.timedelta(days=366), day)
    long = audit.unpivot(known, [], ["turnover", "ret_1d"])
    return audit.exact_quantiles(long, ["feature"], "value", {"q_high": 0.995}).collect()


def test_the_year_reaches_the_scan(market):
    text = plan(market.between(D(2000, 6, 25), D(2001, 6, 25)).panel)
    pushed = [line for line in text.split("\n") if "PushedFilters" in line and "l_shipdate" in line]
    assert pushed and all("GreaterThanOrEqual(l_shipdate" in p and "LessThan(l_shipdate" in p for p in pushed)
    inside = market.panel.where("trade_date between date '2000-06-25' and date '2001-06-25'")
    got = market.between(D(2000, 6, 25), D(2001, 6, 25)).panel
    assert got.count() == inside.count() and got.select("code", "close", "volume").exceptAll(inside.select("code", "close", "volume")).count() == 0


def test_year_before():
    assert daily.year_before(D(2024, 3, 31)) == D(2023, 3, 31)
    assert daily.year_before(D(2024, 2, 10)) == D(2023, 1, 1)


def test_thresholds_and_daily_reports_are_stored(spark):
    day = D(2024, 1, 8)
    rows = spark.range(2001).select(F.lit("A").alias("code"), F.lit(day).alias("trade_date"), F.col("id").cast("double").alias("x"))
    thresholds = audit.rolling_thresholds(rows, day, ["x"])
    assert [tuple(r) for r in thresholds.collect()] == [("x", 10.0, 1990.0)]
    # their users read two numbers per feature; sorts and windows of the quantiles are no part of their tasks
    assert not any(step in plan(thresholds) for step in ("Exchange", "Sort", "Window"))
    shown = plan(QUERIES["daily_job"](spark, FOLDER))
    assert not any(step in shown for step in ("Exchange", "Sort", "Aggregate", "Join"))
