"""Every indicator and factor against expectations that are written apart from the plans."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import factors, indicators
from tidemark.sources import bars as B

from . import expect_factors, expect_indicators

DAY = dt.date(2020, 1, 1)


def sine(n=420):
    f = 0.1 * np.arange(n)
    p = 100 + 20 * np.sin(f) + 8 * np.cos(1.7 * f)
    return pd.DataFrame({"open": p - 0.3, "high": p + 0.5 + 1.5 * abs(np.sin(3 * f)), "low": p - 0.5 - 1.5 * abs(np.cos(2.7 * f)), "close": p, "volume": 1e6 + 5e6 * abs(np.sin(5 * f))})


def rough(n=420, seed=3):
    """A random walk on a coarse grid: ties, bars without range, bars without volume, flat stretches."""
    rng = np.random.default_rng(seed)
    close = 50 + np.cumsum(rng.integers(-2, 3, n)) * 0.5
    close[:45] = 50.0
    close[100:112] = close[100]
    close = np.maximum(close, 5.0)
    open_ = np.concatenate([[50.0], close[:-1]]) + rng.integers(-1, 2, n) * 0.5
    wide = rng.integers(0, 3, n) * 0.5
    high, low = np.maximum(open_, close) + wide, np.minimum(open_, close) - wide[::-1]
    high[102:112] = low[102:112] = open_[102:112] = close[102:112]
    volume = rng.integers(0, 5, n) * 100.0
    volume[0] = 300.0
    return pd.DataFrame({"open": open_, "high": high, "low": low, "close": close, "volume": volume})


@pytest.fixture(scope="module")
def both(spark):
    frames = {"sine": sine(), "rough": rough()}
    rows = []
    for name, d in frames.items():
        d["amount"], d["turnover"] = d.close * d.volume, 0.01 + 0.1 * (np.arange(len(d)) % 7) / 7
        rows += [(name, DAY + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(d[list(B.VALUES)].itertuples(index=False))]
    return spark.createDataFrame(rows, B.SCHEMA).repartition(4), frames


def compare(got: pd.DataFrame, want: dict[str, pd.Series], symbol: str) -> list[str]:
    mine, wrong = got[got["symbol"] == symbol].sort_values("trade_date").reset_index(drop=True), []
    for name, values in want.items():
        a, b = mine[name].to_numpy(float), np.asarray(values, float)
        scale = max(1.0, np.nanmax(np.abs(b[np.isfinite(b)]), initial=0.0))
        there = np.isfinite(a) != np.isfinite(b)
        apart = np.abs(np.where(np.isfinite(a) & np.isfinite(b), a - b, 0.0)) > 1e-9 * scale
        if there.any() or apart.any():
            i = int(np.flatnonzero(there | apart)[0])
            wrong.append(f"{symbol} {name}: {int(there.sum())} missing, {int(apart.sum())} differ, first at {i}: {a[i]} for {b[i]}")
    return wrong


def flat(name, value):
    return {name if k == "" else f"{name}_{k}": v for k, v in value.items()} if isinstance(value, dict) else {name: value}


def test_every_indicator(both):
    df, frames = both
    assert set(expect_indicators.WANT) == set(indicators.REGISTRY)
    got, wrong = indicators.apply(df, list(indicators.REGISTRY)).toPandas(), []
    for symbol, d in frames.items():
        for name, fn in expect_indicators.WANT.items():
            with np.errstate(all="ignore"):
                want = flat(name, fn(d))
            assert set(want) == {c for c in got.columns if c in want}
            wrong += compare(got, want, symbol)
    assert not wrong, "\n".join(wrong)


@pytest.mark.parametrize("params", [{"jma": {"period": 7, "phase": 50}, "frama": {"period": 11}, "trima": {"period": 7}, "hma": {"period": 9}, "pivots": {"period": 3}, "macd": {"fast": 3, "slow": 7, "signal": 4}, "rmi": {"period": 5, "momentum_period": 3}, "vfi": {"period": 30}, "hurst": {"period": 40}, "mesa_sine": {"period": 9}, "correlation": {"period": 5}}, {"median": {"period": 150}, "mad": {"period": 150}, "cci": {"period": 60}}])
def test_other_parameters(both, params):
    df, frames = both
    got, wrong = indicators.apply(df, params).toPandas(), []
    for symbol, d in frames.items():
        for name, p in params.items():
            with np.errstate(all="ignore"):
                wrong += compare(got, flat(name, expect_indicators.WANT[name](d, **p)), symbol)
    assert not wrong, "\n".join(wrong)


def test_every_factor(both):
    df, frames = both
    assert set(expect_factors.WANT) == set(factors.REGISTRY)
    got, wrong = factors.apply(df).toPandas(), []
    for symbol, d in frames.items():
        with np.errstate(all="ignore"):
            wrong += compare(got, {n: fn(d) for n, fn in expect_factors.WANT.items()}, symbol)
    assert not wrong, "\n".join(wrong)


def test_range_stats(both):
    df, frames = both
    for r in indicators.range_stats(df, 100, 300).collect():
        d = frames[r["symbol"]]
        part, true = d.iloc[99:300], expect_indicators.tr(d)
        assert np.isclose(r["pct_change"], 100 * (part.close.iloc[-1] / part.close.iloc[0] - 1)) and np.isclose(r["mean_true_range"], true.iloc[99:300].mean())
        assert np.isclose(r["max_drawdown"], 100 * (1 - part.close / part.close.cummax()).max())
    first = indicators.range_stats(df, 1, 1).first()
    assert first["mean_true_range"] == 0 and first["pct_change"] == 0
