import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.operators import bars as b, indicators as ind, quant as q, trajectory as tr

RNG = np.random.default_rng(7)
WALK = [float(x) for x in np.abs(100 + np.cumsum(RNG.normal(0, 1, 300))) + 5]


def pandas_indicators(df: pd.DataFrame) -> pd.DataFrame:
    """The same indicators by recursion and rolling frames."""
    out = pd.DataFrame(index=df.index)
    c, h, lo = df["close"], df["high"], df["low"]
    out["sma_5"] = c.rolling(5, min_periods=1).mean()
    out["ema_20"] = c.ewm(span=20, adjust=False).mean()
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    out["macd"], out["macd_signal"] = macd, macd.ewm(span=9, adjust=False).mean()
    d = c.diff()
    up, down = d.clip(lower=0).fillna(0).rolling(14).mean(), (-d.clip(upper=0)).fillna(0).rolling(14).mean()
    out["rsi"] = 100 - 100 / (1 + up / down)
    tr_ = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    out["atr"] = tr_.rolling(14).mean()
    plus, minus = h.diff().clip(lower=0), lo.diff().clip(upper=0)
    pdi = 100 * plus.ewm(alpha=1 / 14).mean() / out["atr"]
    mdi = (100 * minus.ewm(alpha=1 / 14).mean() / out["atr"]).abs()
    dx = (pdi - mdi).abs() / (pdi + mdi).abs() * 100
    out["adx"] = ((dx.shift() * 13 + dx) / 14).ewm(alpha=1 / 14).mean()
    out["bb_upper"] = c.rolling(20, min_periods=1).mean() + 2 * c.rolling(20).std()
    return out


def test_series_equal_the_recursive_definitions(make_bars):
    bars = make_bars({"A": WALK, "B": WALK[::-1]})
    got = ind.indicator_series(b.recent_bars(bars, 250)).toPandas()
    for sym, closes in (("A", WALK), ("B", WALK[::-1])):
        mine = got[got.symbol == sym].sort_values("ts").reset_index(drop=True)
        src = pd.DataFrame({"close": closes[-250:]})
        src["high"], src["low"] = src.close + 1, src.close - 1
        want = pandas_indicators(src)
        for col in want:
            a, w = mine[col].astype(float).to_numpy(), want[col].to_numpy()
            assert (np.isnan(a) == np.isnan(w)).all(), col
            assert np.nanmax(np.abs(a - w)) < 1e-8, col


def test_newest_values_equal_the_last_row_of_the_series(make_bars):
    bars = make_bars({"A": WALK, "short": WALK[:13], "tiny": WALK[:3]}, volumes=[5, 9, 1, 4])
    newest = ind.indicators_latest(bars).toPandas().set_index("symbol")
    series = ind.indicator_series(b.recent_bars(bars))
    last = ind.aggregate_symbols(series, ind.latest_of(*ind.LATEST)).toPandas().set_index("symbol")
    for col in ind.LATEST:
        if col == "ts":
            continue
        for sym in newest.index:
            x, y = newest.loc[sym, col], last.loc[sym, col]
            assert (pd.isna(x) and pd.isna(y)) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (sym, col, x, y)


@pytest.mark.parametrize("method", ["simple", "wilder"])
def test_bounds(make_bars, method):
    df = ind.indicator_series(b.recent_bars(make_bars({"A": WALK})), method)
    bad = df.where(
        (F.col("rsi") < 0) | (F.col("rsi") > 100) | (F.col("adx") < 0) | (F.col("adx") > 100)
        | (F.col("bb_lower") > F.col("bb_middle")) | (F.col("bb_upper") < F.col("bb_middle"))
    )
    assert bad.count() == 0


def test_flat_and_straight_lines(make_bars):
    up = [float(x) for x in range(100, 400)]
    bars = make_bars({"flat": [50.0] * 300, "up": up, "down": up[::-1]})
    rsi = {r.symbol: r.rsi for r in ind.indicators_latest(bars).collect()}
    assert rsi["flat"] is None and rsi["up"] == pytest.approx(100) and rsi["down"] == pytest.approx(0)
    t = {r.symbol: r for r in tr.price_trajectory(bars, as_of="2024-01-01 00:00:00").collect()}
    assert t["flat"].long_trend == 0 and t["flat"].overall_trajectory == "NEUTRAL"
    assert t["up"].long_trend == pytest.approx(1) and t["down"].long_trend == pytest.approx(-1)
    assert t["up"].overall_trajectory == "STRONG_BULLISH" and t["down"].overall_trajectory == "STRONG_BEARISH"


@pytest.mark.parametrize("n,label", [(3, "INSUFFICIENT_DATA"), (29, "INSUFFICIENT_DATA"), (49, "INSUFFICIENT_DATA"), (250, None)])
def test_minimum_rows(make_bars, n, label):
    bars = make_bars({"A": WALK[:n]})
    row = q.quant_score(bars).first()
    if label:
        assert row.recommendation == label and row.final_score == 0.4
    else:
        assert row.recommendation != "INSUFFICIENT_DATA"
    stop = q.stop_loss(bars).first()
    assert 0.9 * stop.close - 1e-9 <= stop.stop_loss <= 0.99 * stop.close + 1e-9
    if n < 30:
        assert stop.stop_loss_pct == pytest.approx(0.02)


def test_risk_metrics_against_numpy(make_bars):
    row = q.risk_metrics(make_bars({"A": WALK})).first()
    c = pd.Series(WALK[-250:])
    ret = c.pct_change().dropna()
    cum = (1 + ret).cumprod()
    assert row.max_drawdown == pytest.approx(((cum - cum.cummax()) / cum.cummax()).min())
    assert row.var_95 == pytest.approx(np.percentile(ret, 5))
    assert row.sharpe_ratio == pytest.approx((ret.mean() - 0.07 / 252) / ret.std() * np.sqrt(252))


def test_result_does_not_depend_on_layout(make_bars):
    bars = make_bars({"A": WALK, "B": WALK[::-1]})
    shuffled = bars.orderBy(F.rand(3)).repartition(7)
    cols = ["symbol", "final_score", "recommendation"]
    one, two = (q.quant_score(x).select(*cols).orderBy("symbol").collect() for x in (bars, shuffled))
    for x, y in zip(one, two):
        assert x.recommendation == y.recommendation and x.final_score == pytest.approx(y.final_score, abs=1e-12)


@pytest.mark.parametrize("method", ["simple", "wilder"])
def test_newest_values_equal_the_series(make_bars, method):
    """The aggregates give the last row of the full series, at every number of rows that switches a rule on."""
    counts = (1, 3, 13, 14, 15, 19, 20, 21, 25, 26, 27, 28, 29, 33, 34, 35, 60, 249, 250)
    bars = make_bars({f"n{n}": WALK[:n] for n in counts})
    names = [c for c in ind.LATEST if c != "ts"]
    series = ind.indicator_series(b.recent_bars(bars), method).where("rn = 1").select("symbol", *names).collect()
    latest = ind.indicators_latest(bars, method).select("symbol", *names).collect()
    assert len(series) == len(counts)
    wanted = {r.symbol: r for r in series}
    for row in latest:
        for name in names:
            x, y = row[name], wanted[row.symbol][name]
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-9)), (row.symbol, name)


def test_both_code_paths_of_the_newest_values_agree(make_bars):
    """From a lookback of 252 bars on the full series are read; the same 240 bars give the same values."""
    bars = make_bars({"A": WALK[:240]})
    names = [c for c in ind.LATEST if c != "ts"]
    found = [ind.indicators_latest(bars, lookback=n).select(*names).first() for n in (251, 252, 253)]
    for name in names:
        assert found[0][name] == pytest.approx(found[1][name], rel=1e-9) and found[1][name] == pytest.approx(found[2][name], rel=1e-9), name


def test_recursions_of_long_histories(make_bars):
    closes = [WALK[i % len(WALK)] + (i % 17) for i in range(2600)]
    series = ind.indicator_series(b.recent_bars(make_bars({"A": closes}), 5000), lookback=5000).orderBy("ts")
    got = [(r.ema_5, r.macd, r.macd_signal) for r in series.collect()]
    e5 = e12 = e26 = closes[0]
    signal = 0.0
    for i, x in enumerate(closes):
        if i:
            e5, e12, e26 = e5 + (x - e5) / 3, e12 + (x - e12) * 2 / 13, e26 + (x - e26) * 2 / 27
            signal += (e12 - e26 - signal) * 0.2
        assert got[i] == pytest.approx((e5, e12 - e26, signal), rel=1e-9, abs=1e-9)
