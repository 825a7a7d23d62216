"""Registered results, on the given tables, against the expectations in pandas: these need no SQL form."""

import os

import numpy as np
import pytest

from tidemark import registry
from tidemark.operators import indicators, strategies
from tidemark.sources import bars as B

from . import expect_factors, expect_indicators, expect_patterns, expect_strategies
from .test_formulas import flat

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def frames(spark):
    bars = B.bars_orders(spark, SF).toPandas().sort_values(["symbol", "trade_date"])
    return {s: d.reset_index(drop=True) for s, d in bars.groupby("symbol")}


def shown(x):
    """As registered results show doubles."""
    x = np.asarray(x, float)
    scale = np.where(np.abs(x) < 1e7, 1.0, np.where(np.abs(x) < 1e10, 1e-6, 1e-12))
    return np.where(np.isfinite(x), x, np.nan) * scale


def differing(got, frames, want):
    """Columns of a registered result that differ from want(frame) of every symbol by more than the last place shown."""
    wrong, seen = [], set()
    for symbol, d in frames.items():
        mine = got[got["symbol"] == symbol].sort_values("trade_date").reset_index(drop=True)
        with np.errstate(all="ignore"):
            expected = {k: v for k, v in want(d).items() if k in mine.columns}
        seen |= set(expected)
        for name, values in expected.items():
            a, b = mine[name].to_numpy(float), shown(values)
            if len(a) != len(b) or not np.allclose(a, b, rtol=1e-9, atol=1.2e-4, equal_nan=True):
                wrong.append(f"{symbol} {name}")
    assert not wrong, wrong
    assert seen == set(got.columns) - {"symbol", "trade_date"}


@pytest.mark.parametrize("name", ["indicators_state_machines", "indicators_recursive", "indicators_pro_trend", "indicators_cycle"])
def test_indicators(spark, frames, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    of = [n for n in indicators.REGISTRY if any(c == n or c.startswith(f"{n}_") for c in got.columns)]
    differing(got, frames, lambda d: {k: v for n in of for k, v in flat(n, expect_indicators.WANT[n](d)).items()})


def test_factors(spark, frames):
    got = registry.QUERIES["factors_liquidity"](spark, SF).toPandas()
    differing(got, frames, lambda d: {n: expect_factors.WANT[n](d) for n in got.columns if n in expect_factors.WANT})


@pytest.mark.parametrize("name", ["strategies_signals", "strategies_with_position"])
def test_strategies(spark, frames, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    differing(got, frames, lambda d: {n: expect_strategies.WANT[n](d) for n in strategies.REGISTRY if n in got.columns})


def test_charts(spark, frames):
    got = sorted((r["symbol"], r["pattern"], r["start_date"], r["end_date"], r["direction"], round(r["confidence"], 9)) for r in registry.QUERIES["patterns_charts"](spark, SF).collect())
    want = sorted((s, p, d.trade_date[a], d.trade_date[b], to, round(float(c), 9)) for s, d in frames.items() for p, a, b, to, c in expect_patterns.charts(d))
    assert got == want and len(got) > 50
