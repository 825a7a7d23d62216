"""Patterns, strategies, back-tests and script functions against expectations that are written apart from the plans."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import backtest, indicators, patterns, strategies
from tidemark.plans.staged import Plan
from tidemark.script.compile import FUNCTIONS, execute
from tidemark.sources import bars as B

from . import expect_indicators, expect_patterns, expect_strategies

DAY = dt.date(2020, 1, 1)


def walk(n, seed, size=0.03, grid=None):
    """Bars of a random walk; with a grid, prices lie on it, so that patterns of equal prices occur."""
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, size, n)))
    open_ = np.concatenate([[100.0], close[:-1]]) * np.exp(rng.normal(0, size / 2, n))
    if grid:
        close, open_ = np.maximum(np.round(close / grid) * grid, grid), np.maximum(np.round(open_ / grid) * grid, grid)
    reach = abs(rng.normal(0, size, (2, n))) * rng.integers(0, 2, (2, n)) * close
    if grid:
        reach = np.round(reach / grid) * grid
    return pd.DataFrame({"open": open_, "high": np.maximum(open_, close) + reach[0], "low": np.maximum(np.minimum(open_, close) - reach[1], 0.5), "close": close, "volume": rng.integers(1, 9, n) * 100.0})


def shaped(n, seed):
    """A slow wave with peaks of about equal height, for chart patterns."""
    rng = np.random.default_rng(seed)
    c = 100 + (10 + seed) * np.sin(np.arange(n) * 2 * np.pi / (20 + seed)) - 0.05 * seed * np.arange(n) / 10 + rng.normal(0, 0.2, n)
    return pd.DataFrame({"open": c, "high": c + 0.5, "low": c - 0.5, "close": c, "volume": np.full(n, 100.0)})


@pytest.fixture(scope="module")
def many(spark):
    frames = {f"w{i}": walk(260, i, (0.01, 0.03, 0.06)[i % 3], (None, 1.0, 2.0, 5.0)[i % 4]) for i in range(24)} | {f"s{i}": shaped(100 + 7 * i, i) for i in range(12)} | {f"n{i}": walk(n, 50 + i) for i, n in enumerate((1, 2, 6, 19, 25, 35))}
    rows = []
    for name, d in frames.items():
        d["amount"], d["turnover"] = d.close * d.volume, 0.05
        rows += [(name, DAY + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(d[list(B.VALUES)].itertuples(index=False))]
    return spark.createDataFrame(rows, B.SCHEMA).repartition(4).cache(), frames


def rows_of(df):
    return sorted((r["symbol"], r["pattern"], (r["start_date"] - DAY).days, (r["end_date"] - DAY).days, r["direction"], round(r["confidence"], 9)) for r in df.collect())


def test_candles(many):
    df, frames = many
    want = sorted((s, p, a, b, d, round(float(c), 9)) for s, f in frames.items() for p, a, b, d, c in expect_patterns.candles(f))
    got = rows_of(patterns.candles(df))
    assert not set(got) ^ set(want), sorted(set(got) ^ set(want))[:10]
    assert got == want
    #: Rules that never fire here would pass unseen.
    assert len({w[1] for w in want}) >= 40, set(patterns.CANDLES) - {w[1] for w in want}


def crafted():
    """Bars that fire the rules that random bars rarely do, each after flat bars of body 1."""
    flat = [(100, 101.2, 99.8, 101) if i % 2 else (101, 101.2, 99.8, 100) for i in range(24)]
    tails = {
        "abandoned_baby": [(110, 110.5, 103.5, 104), (101, 102, 100, 101.05), (103, 109, 102.9, 108)], "rising_three": [(100, 106.5, 99, 106), (105, 105.5, 104, 104.5), (104.6, 105, 103.8, 104), (104.2, 104.8, 103, 103.6), (104, 108.5, 103.5, 108)],
        "falling_three": [(106, 106.5, 99, 100), (101, 102, 100.8, 101.6), (101.5, 102.5, 101, 102.2), (102, 103, 101.5, 102.7), (102, 102.2, 97, 98)], "mat_hold": [(100, 108.5, 99, 108), (107, 107.5, 106, 106.5), (106.6, 107, 105.8, 106), (106, 106.8, 105.5, 106.4), (106.5, 111, 106, 110.5)],
        "side_by_side_white": [(110, 110.2, 105.8, 106), (102, 104.2, 101.8, 104), (102.1, 104.2, 101.9, 104.05)], "three_stars_south": [(110, 110.2, 103, 104), (105, 105.5, 102, 102.5), (103.5, 104, 102.5, 103)], "tristar": [(100, 101, 99, 100), (102, 103, 101, 102), (100, 101, 99, 100)],
        "ladder_bottom": [(105, 105.5, 103.8, 104), (104, 104.4, 102.8, 103), (103, 103.4, 101.8, 102), (102, 102.4, 100.8, 101), (101.5, 106, 101.3, 105.5)], "evening_doji_star": [(100, 106.2, 99.8, 106), (107, 108, 106, 107.05), (106, 106.2, 101, 101.5)], "tasuki_gap": [(100, 102.2, 99.9, 102), (103, 105.5, 102.5, 105), (104.5, 104.6, 102.2, 102.4)],
        "kicking": [(104, 104.2, 101.8, 102), (105, 107.2, 104.9, 107)], "matching_low": [(105, 105.2, 102.8, 103), (104.8, 105, 102.8, 103.02)], "separating_lines": [(105, 105.2, 102.8, 103), (105.02, 107.5, 104.9, 107.2)], "meeting_lines": [(105, 105.2, 102.8, 103), (101, 103.2, 100.8, 103.02)],
        "squeeze_alert": [(100, 108, 98, 101), (101, 105, 99, 100), (100, 103, 99.5, 101), (100.5, 101.2, 100.2, 101)], "three_inside_up": [(106, 106.2, 101.8, 102), (103, 104.2, 102.9, 104), (104, 107.5, 103.8, 107)], "unique_three_river": [(108, 108.2, 103.8, 104), (104.5, 105, 101, 103), (102.2, 103.5, 102, 103)],
        "three_outside_down": [(101, 101.6, 100.8, 101.5), (102, 102.2, 99.8, 100), (100, 100.2, 98.8, 99)], "belt_hold": [(100, 103.2, 100, 103)], "dragonfly_doji": [(101, 101.1, 98, 101.05)], "gravestone_doji": [(101, 104, 100.95, 101.02)],
    }
    return {name: pd.DataFrame([(*map(float, r), 100.0) for r in flat + tail], columns=["open", "high", "low", "close", "volume"]) for name, tail in tails.items()}


def test_rare_candles(spark):
    frames, rows = crafted(), []
    for name, d in frames.items():
        rows += [(name, DAY + dt.timedelta(days=i), *map(float, r), 1.0, 0.05) for i, r in enumerate(d.itertuples(index=False))]
    df = spark.createDataFrame(rows, B.SCHEMA)
    want = sorted((s, p, a, b, d, round(float(c), 9)) for s, f in frames.items() for p, a, b, d, c in expect_patterns.candles(f))
    assert rows_of(patterns.candles(df)) == want
    found = {(w[0], w[1]) for w in want if w[3] == len(frames[w[0]]) - 1}
    assert all((n, n) in found for n in frames), [n for n in frames if (n, n) not in found]


def test_charts(many):
    df, frames = many
    want = sorted((s, p, a, b, d, round(float(c), 9)) for s, f in frames.items() for p, a, b, d, c in expect_patterns.charts(f))
    assert rows_of(patterns.charts(df)) == want
    assert len({w[1] for w in want}) >= 12, set(patterns.CHARTS) - {w[1] for w in want}


def test_pattern_signal(many):
    df, frames = many
    got = patterns.signal(df, "tweezer").toPandas()
    for s in ("w1", "w2", "s3"):
        want = np.zeros(len(frames[s]))
        for p, _, end, d, _ in expect_patterns.candles(frames[s]):
            if p == "tweezer":
                want[end] = d if d else 0.5
        assert got[got["symbol"] == s].sort_values("trade_date")["signal"].tolist() == want.tolist()


@pytest.fixture(scope="module")
def series(spark):
    frames = {f"m{i}": walk(500, 100 + i, 0.015 + 0.01 * (i % 3)) for i in range(8)}
    for i, d in enumerate(frames.values()):
        drift = np.exp(0.4 * np.sin(np.arange(500) / (30 + 5 * i)))
        for c in ("open", "high", "low", "close"):
            d[c] *= drift
    rows = []
    for name, d in frames.items():
        d["amount"], d["turnover"] = d.close * d.volume, 0.05
        rows += [(name, DAY + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(d[list(B.VALUES)].itertuples(index=False))]
    return spark.createDataFrame(rows, B.SCHEMA).repartition(4).cache(), frames


def test_strategies(series):
    df, frames = series
    assert set(expect_strategies.WANT) == set(strategies.REGISTRY)
    p = Plan()
    p.out(**{n: strategies.formula(p, n) for n in strategies.REGISTRY})
    got, wrong, fired = p.spark(df).toPandas(), [], set()
    for s, d in frames.items():
        mine = got[got["symbol"] == s].sort_values("trade_date").reset_index(drop=True)
        for name, fn in expect_strategies.WANT.items():
            a, b = mine[name].to_numpy(int), np.asarray(fn(d), int)
            fired |= {name} if (b == 1).any() and (b == -1).any() else set()
            if (a != b).any():
                i = int(np.flatnonzero(a != b)[0])
                wrong.append(f"{s} {name}: {(a != b).sum()} differ, first at {i}: {a[i]} for {b[i]}")
    assert not wrong, "\n".join(wrong)
    assert len(fired) >= 18, set(expect_strategies.WANT) - fired


@pytest.mark.parametrize("name", ["ma_cross", "turtle", "rsi_extreme"])
def test_back_tests(series, name):
    df, frames = series
    got, trades = {r["symbol"]: r for r in backtest.run(df, name).collect()}, backtest.trades(df, name).toPandas()
    curve = backtest.equity_curve(df, name).toPandas()
    for s, d in frames.items():
        equity, profits = expect_strategies.account(d.close, np.asarray(expect_strategies.WANT[name](d), int))
        want = expect_strategies.measures(equity, profits)
        assert all(np.isclose(got[s][k], v) for k, v in want.items()), (s, {k: (got[s][k], v) for k, v in want.items()})
        assert np.allclose(curve[curve["symbol"] == s].sort_values("bar")["equity"], equity) and np.allclose(trades[trades["symbol"] == s].sort_values("entry_date")["pnl"], profits)
    monthly = backtest.monthly_returns(df, name).toPandas()
    assert np.allclose(monthly[monthly["symbol"] == "m0"].sort_values("trade_date")["return"].iloc[0], curve[curve["symbol"] == "m0"].sort_values("bar")["equity"].iloc[21] / curve[curve["symbol"] == "m0"].sort_values("bar")["equity"].iloc[0] - 1)


def test_grid_search_is_the_best_of_all(series):
    df, frames = series
    grid = {"fast": [3, 5, 8], "slow": [12, 20]}
    for r in backtest.grid_search(df, "ma_cross", grid).collect():
        d, scores = frames[r["symbol"]], {}
        for f in grid["fast"]:
            for s in grid["slow"]:
                scores[f, s] = expect_strategies.measures(*expect_strategies.account(d.close, np.asarray(expect_strategies.ma_cross(d, f, s), int)))["sharpe"]
        assert np.isclose(r["sharpe"], max(scores.values())) and np.isclose(scores[r["params"]["fast"], r["params"]["slow"]], r["sharpe"])
    best, fit = backtest.genetic_search(df, "ma_cross", {"fast": (3, 9, 3), "slow": (12, 20, 8)}, population=12, generations=4, elite=2)
    assert fit <= max(np.mean([expect_strategies.measures(*expect_strategies.account(d.close, np.asarray(expect_strategies.ma_cross(d, f, s), int)))["sharpe"] for d in frames.values()]) for f in (3, 6, 9) for s in (12, 20)) + 1e-9
    assert set(best) == {"fast", "slow"}


E = expect_indicators


def roll(s, n, f): return getattr(s.rolling(min(n, len(s))), f)()
def grow(s, n, f): return getattr(s.rolling(n, min_periods=1), f)()
def yes(c): return c.fillna(False).astype(float)


def script_kdj(d, n=9):
    hi, lo = grow(d.high, n, "max"), grow(d.low, n, "min")
    k, e, ks, es = 50.0, 50.0, [50.0], [50.0]
    for i in range(1, len(d)):
        k = (2 * k + (100 * (d.close[i] - lo[i]) / (hi[i] - lo[i]) if hi[i] - lo[i] > 1e-12 else 50.0)) / 3
        e = (2 * e + k) / 3
        ks.append(k)
        es.append(e)
    return pd.Series(ks), pd.Series(es)


def script_hma(d, n):
    x = (2 * E.wma_(d.close, n // 2) - E.wma_(d.close, n)).fillna(0.0)
    return E.wma_(x, int(n**0.5))


def script_rsi(s, n):
    out = E.rsi_(s, n)
    c = s.diff()
    down = E.rma((-c).clip(lower=0), n)
    return out.where(np.arange(len(s)) > n, 50.0).mask((down == 0) & (np.arange(len(s)) > n), 100.0)


def cool(flags, n):
    out, free = [], 0
    for i, f in enumerate(flags):
        out.append(1.0 if f and i >= free else 0.0)
        free = i + n if out[-1] else free
    return pd.Series(out)


SCRIPTS = {
    "sma(close, 7)": lambda d: roll(d.close, 7, "mean"), "sma(close, 9000)": lambda d: roll(d.close, 9000, "mean"), "ema(close, 12)": lambda d: E.ema(d.close, 12, "first"), "wma(close, 9)": lambda d: E.wma_(d.close, 9), "rma(close, 9)": lambda d: E.rma(d.close, 9, "first"),
    "hma(close, 16)": lambda d: script_hma(d, 16), "stdev(close, 10)": lambda d: d.close.rolling(10).std(ddof=0), "variance(close, 10)": lambda d: d.close.rolling(10).var(ddof=0), "zscore(close, 20)": lambda d: (d.close - d.close.rolling(20).mean()) / d.close.rolling(20).std(ddof=0),
    "rsi(close, 14)": lambda d: script_rsi(d.close, 14), "macd(close, 12, 26, 9).dif": lambda d: E.apo(d), "macd_dea(close)": lambda d: E.ema(E.apo(d), 9, "first"), "macd_hist(close)": lambda d: 2 * (E.apo(d) - E.ema(E.apo(d), 9, "first")),
    "kdj_k(high, low, close)": lambda d: script_kdj(d)[0], "kdj_d(high, low, close)": lambda d: script_kdj(d)[1], "kdj_j(9, 3, 3)": lambda d: 3 * script_kdj(d)[0] - 2 * script_kdj(d)[1], "cci(high, low, close, 14)": lambda d: E.cci(d, 14), "atr(high, low, close, 14)": lambda d: E.rma(E.tr(d), 14, "first"),
    "bbands_upper(close, 20, 2)": lambda d: E.bb(d)["upper"], "obv(close, volume)": lambda d: E.obv(d), "cross(close, open)": lambda d: yes((d.close.shift() <= d.open.shift()) & (d.close > d.open)), "crossunder(close, open)": lambda d: yes((d.close.shift() >= d.open.shift()) & (d.close < d.open)),
    "cross(close, open, 0)": lambda d: yes((d.close.shift() >= d.open.shift()) & (d.close < d.open)), "ref(close, 3)": lambda d: d.close.shift(3), "hhv(high, 9)": lambda d: grow(d.high, 9, "max"), "llv(low, 9)": lambda d: grow(d.low, 9, "min"), "sum(volume, 6)": lambda d: grow(d.volume, 6, "sum"),
    "count(close > open, 10)": lambda d: grow(yes(d.close > d.open), 10, "sum"), "every(close > open, 2)": lambda d: grow(yes(d.close > d.open), 2, "min"), "exist(close > open, 3)": lambda d: grow(yes(d.close > d.open), 3, "max"), "filter(close > open, 4)": lambda d: cool(d.close > d.open, 4),
    "barslast(close > open)": lambda d: pd.Series(np.arange(len(d))) - pd.Series(np.where(d.close > d.open, np.arange(len(d)), np.nan)).ffill().fillna(0), "barssince(close > open)": lambda d: (pd.Series(np.arange(len(d))) - int(np.argmax(d.close > d.open))).clip(lower=0).astype(float),
    "abs(close - open)": lambda d: (d.close - d.open).abs(), "max(open, close)": lambda d: np.maximum(d.open, d.close), "min(open, close)": lambda d: np.minimum(d.open, d.close), "pow(close / 100, 2)": lambda d: (d.close / 100) ** 2, "sqrt(close)": lambda d: np.sqrt(d.close), "sqrt(close - 100)": lambda d: np.sqrt((d.close - 100).where(d.close >= 100)),
    "log(close)": lambda d: np.log10(d.close), "ln(close)": lambda d: np.log(d.close), "exp(close / 100)": lambda d: np.exp(d.close / 100), "round(close)": lambda d: np.floor(d.close + 0.5), "ceil(close)": lambda d: np.ceil(d.close), "floor(close)": lambda d: np.floor(d.close), "sign(close - open)": lambda d: np.sign(d.close - d.open),
    "sin(close)": lambda d: np.sin(d.close), "cos(close)": lambda d: np.cos(d.close), "tan(close)": lambda d: np.tan(d.close), "iff(close > open, high, low)": lambda d: d.high.where(d.close > d.open, d.low), "between(100, low, high)": lambda d: yes((d.low <= 100) & (d.high >= 100)), "range(close, low, high)": lambda d: yes((d.low < d.close) & (d.close < d.high)),
    "roc(close, 5)": lambda d: 100 * d.close.pct_change(5), "drawdown(close)": lambda d: d.close / d.close.cummax() - 1, "close % 7": lambda d: np.fmod(d.close, 7), "close / (close - close)": lambda d: d.close * 0.0, "close > open xor volume > 500": lambda d: yes((d.close > d.open) != (d.volume > 500)),
    "not (close > open)": lambda d: 1 - yes(d.close > d.open), "close <> open": lambda d: yes((d.close - d.open).abs() >= 1e-10), "close[2] + 1": lambda d: d.close.shift(2) + 1,
    "cdl_doji(open, high, low, close)": lambda d: yes((d.high > d.low) & ((d.close - d.open).abs() / (d.high - d.low) < 0.1)), "cdl_hammer(open, high, low, close)": lambda d: yes((d.high > d.low) & ((d.close - d.open).abs() < 0.3 * (d.high - d.low)) & (np.minimum(d.open, d.close) - d.low > 2 * (d.close - d.open).abs())),
    "cdl_shooting_star(open, high, low, close)": lambda d: yes((d.high > d.low) & ((d.close - d.open).abs() < 0.3 * (d.high - d.low)) & (d.high - np.maximum(d.open, d.close) > 2 * (d.close - d.open).abs())), "cdl_three_white_soldiers()": lambda d: pd.Series(E.candles(d)["three_white_soldiers"]),
    "cdl_engulfing(open, high, low, close)": lambda d: pd.Series(np.where((d.close.shift() < d.open.shift()) & (d.close > d.open) & (d.open < d.low.shift()) & (d.close > d.high.shift()), 1.0, np.where((d.close.shift() > d.open.shift()) & (d.close < d.open) & (d.open > d.high.shift()) & (d.close < d.low.shift()), -1.0, 0.0))),
}


def test_script_functions(many):
    df, frames = many
    names = {f"f{i}": text for i, text in enumerate(SCRIPTS)}
    got, wrong = execute(df, " ".join(f"{n}: {t};" for n, t in names.items())).toPandas(), []
    for s in ("w0", "w1", "w6", "n5"):
        mine = got[got["symbol"] == s].sort_values("trade_date").reset_index(drop=True)
        for n, text in names.items():
            with np.errstate(all="ignore"):
                a, b = mine[n].to_numpy(float), np.asarray(SCRIPTS[text](frames[s]), float)
            if not np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True):
                i = int(np.flatnonzero(~np.isclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True))[0])
                wrong.append(f"{s} {text}: at {i} {a[i]} for {b[i]}")
    assert not wrong, "\n".join(wrong)
    assert len(FUNCTIONS) >= 75 and math.isfinite(len(indicators.REGISTRY))
