"""Tables, vendor frames, sync windows, streaming upserts and skew-safe helpers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.functions import columns as col
from tapeloom.functions.quantiles import exact_quantiles
from tapeloom.functions.ranks import running_totals
from tapeloom.operators import evaluate, integrity, labels, ledger, news, sync, universe
from tapeloom.operators import calendar as cal
from tapeloom.plans import stream_queries
from tapeloom.plans.catalog import QUERIES
from tapeloom.sources import tables, vendor
from tapeloom.sources.trades import bars_from_trades, trade_sequence, week_start
from tapeloom.sources.day_store import DayStore
from tapeloom.streaming import jobs

D = dt.date


def test_records_parse_and_keys_are_required(spark):
    assert len(schemas.RECORDS) == 42
    for r in schemas.RECORDS.values():
        assert set(r.pk) <= set(r.columns)
        assert all(not f.nullable for f in r.schema if f.name in r.pk)
    assert "sell_elg_amount" in schemas.RECORDS["moneyflow"].columns
    assert schemas.record("income", "revenue double, end_type2 string").columns[-2:] == ["revenue", "end_type2"]
    with pytest.raises(ValueError):
        schemas.record("raw_daily", "x double")


def test_normalize_rejects_missing_column(make):
    with pytest.raises(ValueError, match="volume"):
        schemas.normalize_ohlcv(make("code string, trade_date date, open double, high double, low double, close double"))


def test_partition_upsert_and_day_replacement(spark, make, tmp_path):
    rec = schemas.RECORDS["adj_factor"]
    path = str(tmp_path / "t")
    day = [D(2024, 1, 2), D(2024, 1, 3)]
    schema = "code string, trade_date date, adj_factor double"
    tables.apply_upsert(spark, path, make(schema, ("A", day[0], 1.0), ("A", day[1], 1.0), ("B", day[1], 1.0)), rec)
    tables.apply_upsert(spark, path, make(schema, ("A", day[1], 2.0), ("C", day[1], 3.0)), rec)
    read = lambda: {(r.code, r.trade_date.day): r.adj_factor for r in tables.read_table(spark, path, rec).collect()}
    assert read() == {("A", 2): 1.0, ("A", 3): 2.0, ("B", 3): 1.0, ("C", 3): 3.0}
    tables.replace_days(make(schema, ("Z", day[0], 9.0)), path)
    assert read() == {("Z", 2): 9.0, ("A", 3): 2.0, ("B", 3): 1.0, ("C", 3): 3.0}
    assert tables.has_rows(tables.read_table(spark, path, rec), code="Z") and not tables.has_rows(tables.read_table(spark, path, rec), code="Q")


def test_stream_upsert_follows_sequence_and_ignores_replays(spark, make, tmp_path):
    rec = schemas.RECORDS["adj_factor"]
    src = str(tmp_path / "in")
    store = DayStore(spark, str(tmp_path / "table"), rec.schema)
    schema = "code string, trade_date date, adj_factor double, seq long"
    d = [D(2024, 1, 2), D(2024, 1, 3)]
    first = make(schema, ("A", d[0], 9.0, 1), ("A", d[0], 2.0, 2), ("B", d[0], 1.0, 1), ("B", d[1], 1.0, 1))
    first.coalesce(1).write.mode("append").parquet(src)
    make(schema, ("A", d[0], 5.0, 1), ("C", d[0], 3.0, 2)).coalesce(1).write.mode("append").parquet(src)
    read = lambda **how: {(r.code, r.trade_date.day): r.adj_factor for r in store.read(**how).collect()}
    want = {("A", 2): 5.0, ("B", 2): 1.0, ("B", 3): 1.0, ("C", 2): 3.0}
    stream = jobs.read_files(spark, src, first.schema, files_per_batch=1)
    for check in ("c1", "c1", "c2"):  # a fresh checkpoint delivers all batches again
        jobs.upsert_files(stream, store, rec, str(tmp_path / check), "seq")
        assert read() == want and {r.version for r in store.versions().collect()} == {0, 1}
    # within the first batch the larger sequence won, though its row is the smaller; the second day was left alone
    assert read(upto=0)[("A", 2)] == 2.0
    assert {(r.trade_date.day, r.version) for r in store.versions().collect()} == {(2, 0), (3, 0), (2, 1)}
    assert store.upsert(make(schema, ("A", d[1], 7.0, 1)), rec, "seq", "other", 0) and read()[("A", 3)] == 7.0
    assert not store.upsert(make(schema, ("A", d[1], 8.0, 1)), rec, "seq", "other", 0) and read()[("A", 3)] == 7.0


def test_stream_upsert_query_writes_its_parts_by_several_tasks(spark, tmp_path, monkeypatch):
    folders = []

    def scratch(_, label):
        folders.append(str(tmp_path / f"{label}-{len(folders)}"))
        return folders[-1]

    for module in (jobs, stream_queries):
        monkeypatch.setattr(module, "scratch_dir", scratch)
    trades = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    trades.repartition(4).write.parquet(str(tmp_path / "in/lineitem.parquet"))
    got = QUERIES["stream_upsert"](spark, str(tmp_path / "in"))
    # a part is one micro-batch whatever the number of its files, and no task writes a whole part
    store = next(f for f in folders if "month_prices" in f)
    assert {(r.version, r.batch) for r in DayStore(spark, store, got.schema).versions().collect()} == {(k, k) for k in range(3)}
    arrived = [p for p in tmp_path.rglob("*.parquet") if p.is_file() and p.relative_to(tmp_path).parts[0].startswith("prices-")]
    assert len(arrived) == 2 * 3 * 4
    assert got.exceptAll(QUERIES["stream_upsert"](spark, "/root/testdata/sf0.001")).isEmpty()


def test_a_key_that_comes_twice_needs_a_sequence(make):
    rec = schemas.RECORDS["adj_factor"]
    schema, day = "code string, trade_date date, adj_factor double", D(2024, 1, 2)
    none = make(schema)
    same = make(schema, ("A", day, 1.0), ("A", day, 1.0))
    assert tables.upsert(none, [same], rec).count() == 1
    later = make(schema, ("A", day, 3.0))
    assert tables.upsert(none, [same, later], rec).collect()[0].adj_factor == 3.0
    with pytest.raises(Exception, match="without a sequence"):
        tables.upsert(none, [make(schema, ("A", day, 1.0), ("A", day, 2.0))], rec).collect()


def test_auc_over_millions_of_distinct_scores(spark):
    rows = spark.range(2_000_000, numPartitions=8).selectExpr("xxhash64(id) as score", "int(pmod(xxhash64(id, 5), 1000) < 300 + id % 200) as label", "id")
    rows = rows.unionByName(rows.where("id % 3 = 0").selectExpr("0L as score", "label", "id"))  # and one score that a quarter of all rows share
    got = evaluate.auc(rows).first()
    pdf = rows.toPandas()
    rank = pdf["score"].rank(method="average").to_numpy()
    pos = pdf["label"].to_numpy() == 1
    want = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert (got.n_pos, got.n_neg) == (pos.sum(), (~pos).sum()) and got.auc == pytest.approx(want, rel=1e-12)


def test_plans_read_the_trades_once(spark):
    """However often a query uses bars or features, they are derived once, and no side is joined on a literal."""
    from tapeloom.plans.catalog import QUERIES

    for name in ("signal_evaluation", "reward_attribution", "walk_forward_best", "repair_day", "audit_report", "contagion_lift"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        text = df._jdf.queryExecution().toString()
        assert "lineitem" not in text and "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_grid_of_averages_equals_single_runs(make):
    from tapeloom.operators import signals as sig

    rng = np.random.default_rng(8)
    rows = [(c, D(2024, 1, 1) + dt.timedelta(days=i), float(p)) for c in "AB" for i, p in enumerate(np.round(100 + rng.normal(0, 2, 80).cumsum(), 1))]
    bars = make("code string, trade_date date, close double", *rows)
    params = [{"short": 2, "long": 5}, {"short": 3, "long": 8}, {"short": 2, "long": 8}]
    got = {(r.param, r.code, r.trade_date): r.signal for r in sig.ma_cross_grid(bars, params).collect()}
    want = {(i, r.code, r.trade_date): r.signal for i, p in enumerate(params) for r in sig.ma_cross(bars, **p).collect()}
    assert got == want and {-1, 1} <= set(got.values())


def test_industry_map_levels(make):
    from tapeloom.operators import universe as uni

    tree = make("code string, l1_code string, l1_name string, l2_code string, l2_name string, l3_code string, l3_name string", ("A", "1", "a", "2", "b", "3", "c"))
    assert [tuple(uni.industry_map(tree, k).first()) for k in (1, 2, 3)] == [("A", "1", "a"), ("A", "2", "b"), ("A", "3", "c")]
    with pytest.raises(ValueError):
        uni.industry_map(tree, 4)


def test_late_rows_are_dropped(spark):
    """Of the arrivals some are late and some repeated, and each query's twin leaves some out."""
    from tapeloom.plans import stream_queries as sq
    from tapeloom.sources.market_views import Market
    from tests.oracle import connect

    folder = "/root/testdata/sf0.001"
    sizes = [p.count() for p in sq.arrivals(Market(spark, folder))]
    con = connect(folder)
    arrived, late, events = con.execute(f"with {sq.ARRIVALS} select count(*), count(*) filter (ts <= mark), (select count(*) from events) from timed").fetchall()[0]
    assert sum(sizes) == arrived > events and late > 20


def test_recursive_state_leaves_out_old_rows(spark, make):
    schema = "code string, trade_date date, close double"
    d = [D(2024, 1, i) for i in range(1, 6)]
    parts = [make(schema, ("A", d[0], 10.0), ("A", d[1], 11.0)), make(schema, ("A", d[1], 99.0), ("A", d[2], 12.0), ("A", d[2], 12.0)), make(schema, ("A", d[0], 5.0))]
    out = jobs.with_rocksdb(spark, lambda: jobs.run_in_parts(parts, lambda s: jobs.recursive_indicators(s, alpha=0.5), "recursive"))
    assert sorted((r.trade_date.day, r.ewm, r.streak) for r in out.collect()) == [(1, 10.0, 0), (2, 10.5, 1), (3, 11.25, 2)]


def test_replace_and_report_files(spark, make, tmp_path):
    df = make("a int, b string", (1, "x"), (2, "y"))
    tables.replace_table(df, str(tmp_path / "t"))
    tables.replace_table(df.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    for fmt in ("csv", "json", "parquet"):
        tables.write_report(df, str(tmp_path / fmt), fmt)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    with pytest.raises(ValueError):
        tables.write_report(df, str(tmp_path / "x"), "xls")


def test_running_totals_survive_a_hot_key(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"k{i % 50}", i // 40, i, float(rng.integers(-9, 9))) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, day int, seq int, x double")
    got = {r.seq: r.t for r in running_totals(df, ["k"], F.col("day"), ["day", "seq"], {"t": "x"}).collect()}
    acc = {}
    for k, _, seq, x in rows:
        acc[k] = acc.get(k, 0) + x
        assert got[seq] == pytest.approx(acc[k])


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    data = {"n": rng.normal(size=5000), "t": np.repeat([1.0, 2.0, 3.0], 700), "s": np.array([5.0, 1.0])}
    df = spark.createDataFrame([(k, float(v)) for k, xs in data.items() for v in xs], "k string, v double")
    probs = {"a": 0.005, "m": 0.5, "b": 0.995}
    for r in exact_quantiles(df, ["k"], "v", probs).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(data[r.k], p), rel=1e-12)


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(3)
    score, y = rng.integers(0, 30, 600) / 10, rng.integers(0, 2, 600)
    df = spark.createDataFrame([(float(s), int(v)) for s, v in zip(score, y)], "score double, label int")
    pos, neg = score[y == 1], score[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert evaluate.auc(df).first().auc == pytest.approx(want)
    assert evaluate.auc(df.where("label = 1")).first().auc == 0.5


def test_bars_from_a_hot_code(spark):
    rows = [("hot", D(2024, 1, 1 + i % 7), i, 1, 1, 1, float(100 + i), 1.0) for i in range(3000)] + [("b", D(2024, 1, 3), 1, 1, 1, 1, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "c string, ts date, o bigint, l int, p bigint, s bigint, px double, q double")
    seq = trade_sequence("ts", [("o", 13), ("l", 2)], [("p", 11), ("s", 11)])
    bars = {r.code: r for r in bars_from_trades(df, F.col("c"), week_start(F.col("ts")), F.col("px"), F.col("q"), F.col("px") * F.col("q"), F.expr(seq)).collect()}
    hot = [r for r in rows if r[0] == "hot"]
    assert bars["hot"].open == min(hot, key=lambda r: (r[1], r[2]))[6] and bars["hot"].close == max(hot, key=lambda r: (r[1], r[2]))[6]
    assert bars["hot"].volume == 3000 and bars["b"].open == 5.0
    with pytest.raises(ValueError):
        trade_sequence("ts", [("o", 20)], [])


def test_scalar_rules(make):
    df = make("t string", ("600000",), ("000001",), ("300001",), ("430001",), ("830001",), ("900001",))
    assert [r[0] for r in df.select(col.to_market(F.col("t"))).collect()] == ["600000.SH", "000001.SZ", "300001.SZ", "430001.BJ", "830001.BJ", "900001"]
    names = make("n string", ("ST one",), ("*ST two",), ("st three",), ("BEST",), (None,))
    assert [r[0] for r in names.select(col.is_special_treatment(F.col("n"))).collect()] == [True, True, True, False, None]
    fee = make("a double, s boolean", (1000.0, False), (100000.0, True)).select(col.trade_fee(F.col("a"), F.col("s"))).collect()
    assert fee[0][0] == pytest.approx(5.01) and fee[1][0] == pytest.approx(30 + 1 + 50)
    nxt = make("d date, f string", (D(2024, 1, 31), "monthly"), (D(2024, 1, 31), "weekly"), (D(2024, 1, 31), "biweekly"), (D(2024, 1, 31), "daily"))
    assert [r[0] for r in nxt.select(col.next_run_date(F.col("d"), F.col("f"))).collect()] == [D(2024, 2, 29), D(2024, 2, 7), D(2024, 2, 14), D(2024, 2, 1)]
    assert make("v double, p double", (1234.0, 1.0), (50.0, 1.0), (1.0, 0.0)).select(col.round_lot(F.col("v"), F.col("p"))).collect() == [(1200,), (0,), (0,)]
    wk = make("d date", (D(2024, 6, 8),), (D(2024, 6, 9),), (D(2024, 6, 10),)).select(col.last_weekday(F.col("d"))).collect()
    assert [r[0] for r in wk] == [D(2024, 6, 7), D(2024, 6, 7), D(2024, 6, 10)]


def test_vendor_frames(make):
    rates = vendor.to_house(make("date string, `on` double, `1w` double, other int", ("20240102", 1.0, 2.0, 3)), schemas.RECORDS["shibor"])
    assert rates.collect() == [(D(2024, 1, 2), 1.0, 2.0)] and rates.columns == ["date", "overnight", "w1"]
    paid = vendor.to_house(make("ts_code string, end_date string, div_proc string, cash_div double", ("A", "20231231", "x", 0.1)), schemas.RECORDS["dividend"])
    assert paid.collect() == [("A", D(2023, 12, 31), "x", 0.1)]
    assert vendor.to_house(make("month string, nt_val double", ("202401", 1.0)), schemas.RECORDS["cn_cpi"]).collect() == [("202401", 1.0)]


def test_a_broken_table_is_not_taken_for_empty(spark, make, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception):
        tables.apply_upsert(spark, str(tmp_path / "t"), make("code string, trade_date date, adj_factor double", ("A", D(2024, 1, 2), 1.0)), schemas.RECORDS["adj_factor"])
    assert [f.name for f in (tmp_path / "t").iterdir() if f.suffix == ".parquet"] == ["part-0.parquet"]


def test_missing_ranges_table(make):
    win = make("code string, start date, end date", *[(c, D(2024, 1, 1), D(2024, 12, 31)) for c in "ABCD"])
    local = make("code string, first_date date, last_date date", ("B", D(2024, 3, 1), D(2024, 12, 31)), ("C", D(2023, 1, 1), D(2024, 6, 30)), ("D", D(2024, 2, 1), D(2024, 6, 30)))
    got = sorted((r.code, r.kind, r.from_date, r.to_date) for r in sync.missing_ranges(win, local, D(2025, 1, 1)).collect())
    assert got == [
        ("A", "whole", D(2024, 1, 1), D(2024, 12, 31)), ("B", "backfill", D(2024, 1, 1), D(2024, 2, 29)), ("C", "forward", D(2024, 7, 1), D(2024, 12, 31)),
        ("D", "backfill", D(2024, 1, 1), D(2024, 1, 31)), ("D", "forward", D(2024, 7, 1), D(2024, 12, 31))]


def test_delisted_code_drops_out(make):
    codes = make("code string", ("A",), ("B",), ("C",))
    life = make("code string, list_date date, delist_date date", ("A", D(2020, 1, 1), None), ("B", D(2000, 1, 1), D(2010, 1, 1)))
    got = {r.code: (r.start, r.end) for r in sync.effective_windows(codes, life, "2019-01-01", "2024-01-01").collect()}
    assert got == {"A": (D(2020, 1, 1), D(2024, 1, 1)), "C": (D(2019, 1, 1), D(2024, 1, 1))}


def test_universe_filters(make):
    basic = make("code string, trade_date date, circ_mv double, turnover_rate double",
                 *[(c, D(2024, 6, 3), v, 1.0) for c, v in (("600001.SH", 3.0), ("000002.SZ", 2.0), ("600003.SH", 1.0), ("830001.BJ", 9.0), ("600004.SH", 8.0))])
    life = make("code string, name string, list_date date", ("600001.SH", "One", D(2000, 1, 1)), ("000002.SZ", "Two", D(2000, 1, 1)), ("600003.SH", "New", D(2024, 5, 1)),
                ("830001.BJ", "Bj", D(2000, 1, 1)), ("600004.SH", "*ST four", D(2000, 1, 1)))
    assert [r.code for r in universe.top_market_value(basic, life, 5).collect()] == ["600001.SH", "000002.SZ"]
    weights = make("index_code string, trade_date date, con_code string, weight double", ("000300.SH", D(2024, 5, 1), "X", 1.0), ("000300.SH", D(2024, 6, 1), "Y", 1.0))
    pick = lambda as_of: [r.code for r in universe.select_universe("hs300", basic, life, weights, as_of=as_of).collect()]
    assert pick("2024-05-31") == ["X"] and pick(None) == ["Y"]
    with pytest.raises(ValueError):
        universe.select_universe("other", basic, life, weights)


def test_calendar_clock_labels(make):
    d = [D(2024, 1, i) for i in range(1, 6)]
    rows = [("A", x, 10.0, 11.0, 9.0, 10.0) for x in d] + [("B", d[0], 10.0, 11.0, 9.0, 10.0), ("B", d[1], 10.0, 10.0, 10.0, 10.0), ("B", d[2], 10.6, 11.0, 9.0, 10.0), ("B", d[4], 12.0, 13.0, 9.0, 10.0)]
    bars = make("code string, trade_date date, open double, high double, low double, close double", *rows)
    c = cal.trading_calendar(bars)
    grid = cal.dense_grid(bars, bars.select("code"), c)
    got = {(r.code, r.day_idx): r.label for r in labels.hit_labels(grid, c).collect()}
    assert got[("A", 0)] == 0 and got[("A", 3)] == -1 and got[("A", 4)] == -1
    assert got[("B", 0)] == -1  # locked on the buy day
    assert got[("B", 1)] == -1  # suspended on the sell day
    assert len(got) == 10


def test_mask_and_duplicates(make):
    day = D(2026, 4, 20)
    uni = make("code string", ("A",), ("B",), ("C",), ("D",))
    panel = make("code string, trade_date date", ("A", day), ("B", day), ("C", day), ("C", day), ("D", D(2026, 4, 17)))
    life = make("code string, name string", ("A", "ST x"), ("B", "ok"), ("D", "*ST y"))
    div = make("code string, ex_date string, div_proc string", ("B", "2026-04-20T00:00:00", "实施"), ("C", "2026-04-20", "预案"))
    got = {r.code: r.reasons for r in integrity.trading_mask(uni, panel, life, div, day).collect()}
    assert got == {"A": ["ST"], "B": ["ex_dividend"], "D": ["ST", "suspended"]}
    assert [(r.code, r.n) for r in integrity.duplicate_keys({"p": panel}, "2026-04-21").collect()] == [("C", 2)]


def test_plan_execution_skips_unaffordable(make):
    s = "plan_id string, account_id string, code string, amount_per_run double, frequency string, next_run_date date, status string, end_date date"
    plans = make(s, ("P1", "A", "X", 60.0, "monthly", D(2024, 1, 1), "ACTIVE", None), ("P2", "A", "X", 50.0, "weekly", D(2024, 1, 2), "ACTIVE", None),
                 ("P3", "A", "X", 30.0, "daily", D(2024, 1, 3), "ACTIVE", D(2024, 1, 31)), ("P4", "B", "X", 10.0, "weekly", D(2024, 1, 3), "PAUSED", None),
                 ("P5", "B", "X", 10.0, "weekly", D(2024, 1, 31), "ACTIVE", None))
    out = ledger.execute_due_plans(plans, make("code string, last_price double", ("X", 2.0)), make("account_id string, balance double", ("A", 100.0), ("B", 10.0)), "2024-01-31")
    got = {r.plan_id: (r.accepted, r.shares, r.next_run_date, r.status) for r in out.collect()}
    assert got == {"P1": (True, 30.0, D(2024, 2, 29), "ACTIVE"), "P2": (False, None, D(2024, 1, 2), "ACTIVE"), "P3": (True, 15.0, D(2024, 2, 1), "STOPPED"), "P5": (True, 5.0, D(2024, 2, 7), "ACTIVE")}


def test_news_equals_matching_the_joined_text(spark, make):
    entries = [("I1", "one", ["steel", "iron ore", "mill"]), ("I2", "two", ["5G", "AI"])]
    raw = make("trade_date date, seq bigint, title string, content string", (D(2024, 1, 1), 1, "a", "new steelworks"), (D(2024, 1, 1), 2, "b", "iron ore and steel"),
               (D(2024, 1, 2), 1, "a", "5G"), (D(2024, 1, 3), 1, "a", ""), (D(2024, 1, 3), 2, "a", None))
    got = {(r.trade_date.day, r.l1_code): (r.hits, r.matched_keywords) for r in news.mentions(raw, entries).collect()}
    assert got == {(1, "I1"): (2, ["steel", "iron ore"]), (2, "I2"): (1, ["5G"])}
    lengths = {r.trade_date.day: r.text_length for r in news.day_summary(raw).collect()}
    assert lengths == {1: len("new steelworks\niron ore and steel"), 2: 2, 3: 0}


def test_planted_alpha_is_found(spark):
    rng = np.random.default_rng(5)
    rows, fwd = [], []
    for t in range(40):
        x = rng.normal(size=30)
        for i in range(30):
            rows.append((f"c{i}", D(2024, 1, 1) + dt.timedelta(days=t), float(x[i]), float(rng.normal())))
            fwd.append((f"c{i}", D(2024, 1, 1) + dt.timedelta(days=t), float(0.5 * x[i] + rng.normal() * 0.5)))
    feats = spark.createDataFrame(rows, "code string, trade_date date, good double, noise double")
    f = spark.createDataFrame(fwd, "code string, trade_date date, fwd double")
    for rank, name in ((False, "ic"), (True, "rank_ic")):
        got = {r.feature: r[name] for r in evaluate.daily_correlation(feats, f, ["good", "noise"], rank).collect()}
        assert got["good"] > 0.5 and abs(got["noise"]) < 0.1


@pytest.mark.parametrize("size,common", [(3, 0.0), (700, 0.0), (5000, 0.99), (20_000, 0.3)])
def test_quantiles_at_any_size(spark, size, common):
    rng = np.random.default_rng(size)
    values = np.where(rng.random(size) < common, 0.0, np.round(rng.normal(size=size), 3))
    frame = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double").repartition(4)
    got = exact_quantiles(frame, ["k"], "v", {"a": 0.005, "b": 0.5, "c": 0.995}).first()
    assert (got.a, got.b, got.c) == pytest.approx(tuple(np.quantile(values, [0.005, 0.5, 0.995])), abs=1e-12) and got.n == size
