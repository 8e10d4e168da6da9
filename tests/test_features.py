"""Planted facts and independent pandas recomputation of the row-clock operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.rolling import Clock, add, with_ewm
from tapeloom.operators import audit, factors, features, indicators
from tapeloom.operators.panel import adjust_prices, as_of, attach_forward_adjusted

DAYS = [d.date() for d in pd.bdate_range("2023-01-02", periods=90)]


def panel_frame(spark, codes=("A",), n=90, seed=7):
    out = []
    for i, code in enumerate(codes):
        rng = np.random.default_rng(seed + i)
        close = 10 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for day in (30, 45, 55):  # limit-ups, one of exactly 9.5 %
            close[day:] *= (1.0951 if day == 45 else 1.10) * close[day - 1] / close[day]
        for day in range(70, 74):
            close[day:] *= 1.02 * close[day - 1] / close[day]
        close[74:] *= 0.97 * close[73] / close[74]
        opened, high, low = close * 0.99, close * 1.01, close * 0.98
        close[65:] *= 1.10 * close[64] / close[65]
        opened[65] = high[65] = low[65] = close[65]
        for t in range(n):
            out.append((code, DAYS[t], *map(float, (opened[t], max(high[t], close[t]) if t != 65 else close[t], low[t], close[t])),
                        float(1000 + rng.integers(0, 500)), float(1e5 + t), None if t % 9 == 0 else float(t - 20), 2.0, float(1 + t % 7),
                        1e6 + t, 7e5 + t, 10.0, 20.0, 30.0, 40.0, float(rng.normal()), None if t % 13 == 0 else 1.0 + t / 100))
    cols = ["code", "trade_date", "open", "high", "low", "close", "volume", "amount", "pe_ttm", "pb", "turnover_rate", "total_mv", "circ_mv",
            "buy_sm_amount", "buy_md_amount", "buy_lg_amount", "buy_elg_amount", "net_mf_amount", "adj_factor"]
    schema = "code string, trade_date date, " + ", ".join(f"{c} double" for c in cols[2:])
    return spark.createDataFrame(out, schema), pd.DataFrame(out, columns=cols)


@pytest.fixture(scope="module")
def fixture(spark):
    sdf, pdf = panel_frame(spark, ("A", "B"))
    feats = features.compute_features(attach_forward_adjusted(sdf)).toPandas().sort_values(["code", "trade_date"])
    return sdf, pdf, feats


def test_ewm_matches_pandas_with_gaps(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for code, n in (("A", 900), ("B", 300), ("C", 1)):
        x = rng.normal(50, 20, n)
        x[rng.random(n) < 0.15] = np.nan
        s = pd.Series(x)
        want[code] = {a: s.ewm(alpha=a, adjust=False).mean().to_numpy() for a in (1 / 3, 1 / 14, 0.9)}
        rows += [(code, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "code string, i int, x double")
    out = with_ewm(df, {"a": ("x", 1 / 3), "b": ("x", 1 / 14), "c": ("x", 0.9)}, order="i").toPandas().sort_values(["code", "i"])
    for code, g in out.groupby("code"):
        for col, a in (("a", 1 / 3), ("b", 1 / 14), ("c", 0.9)):
            np.testing.assert_allclose(g[col].to_numpy(dtype=float), want[code][a], rtol=1e-9, equal_nan=True)


def test_ewm_of_a_long_series_is_exact_and_linear(spark):
    """100,000 rows of one key, so two long blocks, with single gaps and gaps longer than a block."""
    import time

    rng = np.random.default_rng(3)
    x = rng.normal(50, 20, 100_000)
    x[rng.random(len(x)) < 0.1] = np.nan
    x[2_000:2_900], x[64_000:67_500] = np.nan, np.nan
    took = {}
    for n in (25_000, 100_000):
        frame = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "x": x[:n]})).selectExpr("'A' as code", "i", "nanvl(x, null) as x")
        out = with_ewm(frame, {"a": ("x", 1 / 3), "b": ("x", 1 / 200)}, order="i")
        out.where("i = 0").count()
        start = time.perf_counter()
        got = out.select("i", "a", "b").toPandas().sort_values("i")
        took[n] = time.perf_counter() - start
        for name, alpha in (("a", 1 / 3), ("b", 1 / 200)):
            want = pd.Series(x[:n]).ewm(alpha=alpha, adjust=False).mean().to_numpy()
            np.testing.assert_allclose(got[name].to_numpy(dtype=float), want, rtol=1e-9, equal_nan=True)
    assert took[100_000] < 12 * took[25_000]  # a quadratic fold takes 16 times as long


def test_rolling_needs_min_rows(make):
    df = make("code string, trade_date int, x double", *[("A", i, None if i == 3 else float(i)) for i in range(8)])
    t = Clock()
    got = [tuple(r) for r in add(df, {"m": t.mean("x", 3), "n": t.total("x", 3, 1)}).orderBy("trade_date").select("m", "n").collect()]
    x = pd.Series([0, 1, 2, np.nan, 4, 5, 6, 7])
    want = list(zip(x.rolling(3).mean(), x.rolling(3, min_periods=1).sum()))
    for (m, n), (wm, wn) in zip(got, want):
        assert (m is None and math.isnan(wm)) or m == pytest.approx(wm)
        assert n == pytest.approx(wn)


def test_constant_series_has_no_correlation(make):
    df = make("code string, trade_date int, x double, y double", *[("A", i, 1.0, float(i)) for i in range(5)])
    assert {r[0] for r in add(df, {"c": Clock().corr("x", "y", 3)}).select("c").collect()} == {None}


def test_features_are_yesterdays_values(fixture):
    _, pdf, feats = fixture
    for code, g in pdf.groupby("code"):
        f = feats[feats.code == code].reset_index(drop=True)
        c = g["close"].reset_index(drop=True)
        r = np.log(c / c.shift(1))
        np.testing.assert_allclose(f["ret_1d"], r.shift(1), equal_nan=True)
        np.testing.assert_allclose(f["ma20_dev"], (c / c.rolling(20).mean() - 1).shift(1), equal_nan=True, atol=1e-12)
        np.testing.assert_allclose(f["vola_60d"], r.rolling(60, min_periods=20).std(ddof=0).shift(1), equal_nan=True, atol=1e-12)
        v = g["volume"].reset_index(drop=True)
        np.testing.assert_allclose(f["vol_ret_corr20"], r.rolling(20).corr(v).shift(1), equal_nan=True, atol=1e-9)


def test_planted_limit_facts(fixture):
    _, _, feats = fixture
    f = feats[feats.code == "A"].set_index("trade_date")

    def at(day, name):  # value computed from the bar of ``day``
        return f.loc[DAYS[day + 1], name]

    for day in (30, 45, 55):
        assert at(day, "days_since_limit") == 0
    assert at(50, "days_since_limit") == pytest.approx(5 / 60)
    assert at(29, "days_since_limit") == 1.0
    assert at(55, "n_limits_60d") == pytest.approx(3 / 60)
    assert at(65, "is_yi_zi") == 1 and at(55, "is_yi_zi") == 0
    assert at(73, "consecutive_up") >= 0.4 and at(74, "consecutive_up") == 0


def test_rsi_extremes(spark):
    rows = [("U", i, float(10 + i)) for i in range(20)] + [("F", i, 10.0) for i in range(20)]
    df = spark.createDataFrame(rows, "code string, trade_date int, close double").selectExpr("*", "close as high", "close as low")
    f = features.compute_features(df, (features.TECHNICAL,)).toPandas()
    assert f[f.code == "U"]["rsi12"].iloc[-1] == 0.5  # only gains: RSI 100
    assert f[f.code == "F"]["rsi12"].iloc[-1] == 0.0  # no movement: RSI 50


def test_missing_value_rules(make):
    df = make("code string, trade_date int, pe_ttm double, pb double, turnover_rate double, total_mv double",
              ("A", 1, None, -3.0, 1.0, 0.2), ("A", 2, 1.0, 1.0, 1.0, 1.0))
    row = features.compute_features(df, (features.FUNDAMENTAL,)).where("trade_date = 2").first()
    assert row.pe_log is None and row.pb_log == 0.0 and row.mv_log == 0.0


def test_future_rows_never_change_the_past(fixture):
    sdf, _, _ = fixture
    bad = audit.causality_audit(attach_forward_adjusted(sdf), 7, (features.PRICE, features.AVERAGES, features.LIMITS, features.SCALE))
    assert bad.where("look_ahead > 0").count() == 0


def test_spot_check_finds_a_wrong_value_in_every_feature(fixture):
    """Prices have gaps, so recursive averages are compared across missing rows too."""
    sdf, _, _ = fixture
    gaps = F.col("trade_date").isin(DAYS[20], DAYS[21], DAYS[50])
    panel = attach_forward_adjusted(sdf.withColumns({c: F.when(~gaps, F.col(c)) for c in ("open", "high", "low", "close")}))
    feats = features.compute_features(panel)
    good = {r.feature: (r.compared, r.mismatches) for r in audit.spot_check(panel, feats, DAYS[85]).collect()}
    never = {"ma60_dev"}  # its 60 rows hold a gap
    assert set(good) == set(features.MARKET_FEATURES) - never
    assert set(good.values()) == {(2, 0)}
    planted = (F.col("code") == "A") & (F.col("trade_date") == DAYS[85])
    bad = feats.withColumns({c: F.when(planted, F.col(c) + 0.001).otherwise(F.col(c)) for c in features.MARKET_FEATURES})
    for day, n in ((DAYS[85], 1), (DAYS[84], 0)):
        found = {r.feature: r.mismatches for r in audit.spot_check(panel, bad, day).collect()}
        assert set(found) >= set(features.MARKET_FEATURES) - never and set(found.values()) == {n}


def test_short_codes_are_kept_whole_when_rows_are_dropped(make):
    df = make("code string, trade_date int", *[("A", i) for i in range(10)], *[("B", i) for i in range(3)])
    got = {r.code: r["count"] for r in audit.drop_last_rows(df, 4).groupBy("code").count().collect()}
    assert got == {"A": 6, "B": 3}


def test_news_flag_alignment(make):
    d = dt.date
    panel = make("code string, trade_date date", *[(c, d(2026, 4, x)) for c in ("S", "T", "801770.SI") for x in (16, 17, 20)])
    industry = make("code string, l1_code string", ("S", "801770.SI"), ("T", "801010.SI"))
    ment = make("trade_date date, l1_code string, mentioned int", (d(2026, 4, 17), "801770.SI", 1), (d(2026, 4, 18), "801770.SI", 1))
    df = features.attach_mentions(panel, industry, ment)
    f = {(r.code, r.trade_date.day): (r.news_mentioned_t, r.news_mentioned_t1) for r in features.compute_features(df, (features.NEWS,)).collect()}
    assert f[("S", 17)] == (1, 0) and f[("S", 20)] == (0, 1) and f[("T", 17)] == (0, 0)
    assert f[("801770.SI", 17)] == (1, 0)  # an index code is its own industry
    cut = features.attach_mentions(panel, industry, ment, max_mention_date=d(2026, 4, 16))
    assert cut.agg(F.sum("_mentioned")).first()[0] == 0


def test_zscore_invariants(fixture):
    _, _, feats = fixture
    sdf = fixture[0]
    z = features.zscore_by_day(features.compute_features(sdf, (features.PRICE,)), features.PRICE.columns).toPandas()
    assert not z[list(features.PRICE.columns)].isna().any().any()
    assert z["ret_1d"].abs().max() <= 5
    early = z[z.trade_date < DAYS[28]]  # the planted days move both codes alike
    assert early.groupby("trade_date")["ret_1d"].mean().abs().max() < 1e-9


def test_every_factor_yields_its_column(fixture):
    sdf, pdf, _ = fixture
    for name in factors.REGISTRY:
        out = factors.add_factors(sdf, [name])
        assert out.count() == len(pdf) and len(out.columns) > len(sdf.columns)


def test_indicator_shift_moves_one_row(fixture):
    sdf, _, _ = fixture
    one = sdf.where("code = 'A'")
    now = [r.ma5 for r in indicators.add_indicators(one, ["MA5"]).orderBy("trade_date").collect()]
    late = [r.ma5 for r in indicators.add_indicators(one, ["MA5"], shift=True).orderBy("trade_date").collect()]
    assert late[1:] == now[:-1]


def test_factor_adjustment_rules(make):
    d = [dt.date(2024, 1, i) for i in (2, 3, 4)]
    raw = make("code string, trade_date date, open double, high double, low double, close double", *[("A", x, 10.0, 10.0, 10.0, 10.0) for x in d])
    f = make("code string, trade_date date, adj_factor double", ("A", d[0], 1.0), ("A", d[2], 2.0))
    closes = lambda *a: [r.close for r in adjust_prices(raw, f, *a).orderBy("trade_date").collect()]
    assert closes("qfq") == [5.0, 10.0, 10.0]
    assert closes("hfq") == [10.0, 10.0, 20.0]
    assert closes("qfq", False) == [5.0, 10.0]
    assert closes("none") == [10.0] * 3
    assert closes("qfq", True, "2024-01-03") == [10.0, 10.0, 20.0]


def test_as_of_is_strict_when_asked(make):
    d = dt.date
    left = make("code string, trade_date date", ("A", d(2024, 5, 1)), ("A", d(2024, 5, 2)), ("B", d(2024, 5, 2)))
    right = make("code string, ann_date date, eps double", ("A", d(2024, 5, 1), 1.0), ("A", d(2024, 4, 1), 0.5))
    get = lambda strict: {(r.code, r.trade_date.day): r.eps for r in as_of(left, right, "code", "trade_date", "ann_date", ["eps"], strict).collect()}
    assert get(True) == {("A", 1): 0.5, ("A", 2): 1.0, ("B", 2): None}
    assert get(False) == {("A", 1): 1.0, ("A", 2): 1.0, ("B", 2): None}


def test_quality_rules_cover_all_features():
    assert [r.feature for r in audit.default_rules()] == list(features.FEATURES)
