"""Correlation with another series, given signals, weighted portfolios, scanner's conditions, walk-forward without repeats."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, indicators, risk, scanner, strategies
from tidemark.sources import bars as B

DAY = dt.date(2020, 1, 1)


def walk(n, seed):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return pd.DataFrame({"open": c * np.exp(rng.normal(0, 0.005, n)), "high": c * 1.03, "low": c * 0.97, "close": c, "volume": rng.integers(1, 9, n) * 100.0, "amount": c, "turnover": 0.05})


def frame(spark, frames):
    return spark.createDataFrame([(s, DAY + dt.timedelta(days=i), *map(float, r)) for s, d in frames.items() for i, r in enumerate(d.itertuples(index=False))], B.SCHEMA)


def test_correlation_with_another_series(spark):
    a, b = walk(90, 1), walk(80, 2)
    bars = frame(spark, {"A": a, "B": b})
    with_b = indicators.beside(bars.filter("symbol = 'A'"), bars.filter("symbol = 'B'"))
    got = indicators.apply(with_b, {"correlation": {"period": 10, "col": 1}}).orderBy("trade_date").toPandas()["correlation"].astype(float)
    want = a["close"][:80].rolling(10).corr(b["close"]).reindex(range(90))
    assert np.allclose(got, want, atol=1e-9, equal_nan=True) and 0.01 < got.std() and got.notna().sum() == 71
    own = indicators.apply(bars, {"correlation": {"period": 10}}).toPandas()["correlation"].dropna()
    assert np.allclose(own, 1)
    two = indicators.beside(with_b, bars.filter("symbol = 'A'"), 2)
    assert np.allclose(indicators.apply(two, {"correlation": {"period": 10, "col": 2}}).toPandas()["correlation"].dropna(), 1)


def test_given_signals_and_scripts(spark):
    bars = frame(spark, {"A": walk(200, 3), "B": walk(150, 4)})
    s = strategies.signals(bars, "ma_cross")
    rows = lambda df: sorted(tuple(r) for r in df.select("symbol", *backtest.METRICS).collect())
    assert rows(backtest.run_with_signals(bars, s.select("symbol", "trade_date", "signal"))) == rows(backtest.run(bars, "ma_cross"))
    few = spark.createDataFrame([("A", DAY + dt.timedelta(days=3), 1), ("A", DAY + dt.timedelta(days=9), -1), ("A", DAY - dt.timedelta(days=5), 1), ("Z", DAY, 1)], "symbol string, trade_date date, signal int")
    found = {r["symbol"]: r for r in backtest.run_with_signals(bars, few).collect()}
    c = walk(200, 3)["close"]
    shares = 100_000 / 1.0003 / (c[3] * 1.001)
    assert found["A"]["n_trades"] == 1 and np.isclose(found["A"]["final_equity"], shares * c[9] * 0.999 * (1 - 0.0013)) and found["B"]["n_trades"] == 0 and set(found) == {"A", "B"}
    source = "let f = sma(close, 5); let s = sma(close, 20); plot buy = cross(f, s); plot sell = cross(s, f);"
    got = {r["symbol"]: r["final_equity"] for r in backtest.run_script(bars, source).collect()}
    for symbol, d in {"A": walk(200, 3), "B": walk(150, 4)}.items():
        f, g = d["close"].rolling(5).mean(), d["close"].rolling(20).mean()
        up, down = (f.shift() <= g.shift()) & (f > g), (g.shift() <= f.shift()) & (g > f)
        equity, _ = backtest.simulate(d["open"].to_numpy(), d["close"].to_numpy(), (up * 1.0 - down * 1.0).to_numpy(), backtest.Config())
        assert np.isclose(got[symbol], equity[-1])


def test_weighted_portfolio(spark):
    frames = {"A": walk(60, 5), "B": walk(60, 6), "C": walk(40, 7)}
    r = risk.returns(frame(spark, frames))
    weights = spark.createDataFrame([("A", 0.5), ("B", 0.2), ("B", 0.1), ("C", 0.4)], "symbol string, weight double")
    logs = pd.DataFrame({s: np.log(d["close"]).diff() for s, d in frames.items()}).dropna()
    want = logs @ [0.5, 0.3, 0.4]
    got = [x["r"] for x in risk.weighted(r, weights).orderBy("trade_date").collect()]
    assert len(got) == 39 and np.allclose(got, want)
    m = risk.portfolio_metrics(r, weights).first()
    assert np.isclose(m["annual_return"], want.mean() * 252) and np.isclose(m["volatility"], want.std(ddof=0) * 252**0.5) and m["n"] == 39
    assert risk.weighted(r, weights.limit(0)).count() == 0


def test_scanner_says_what_it_asked(spark):
    tree = {"op": "AND", "children": [{"op": "OR", "children": [{"op": "COMPARE", "indicator": "rsi", "params": {"period": 14}, "compare": ">", "value": 0.5}, {"op": "CROSS", "indicator": "macd"}]}, {"op": "COMPARE", "indicator": "close", "compare": ">", "value": 1}]}
    assert scanner.signals(tree) == ["rsi(period=14) > 0.5", "CROSS(macd(), above)", "close() > 1"]
    rows = scanner.scan(frame(spark, {"A": walk(60, 1)}), tree).collect()
    assert rows and rows[0]["signals"] == scanner.signals(tree)
    assert scanner.scan(frame(spark, {"A": walk(60, 1)}), {"op": "AND", "children": []}).columns[-1] == "signals"


@pytest.mark.parametrize("anchored", [False, True])
def test_walk_forward_is_that_of_its_slices(spark, anchored):
    frames = {"A": walk(211, 8), "B": walk(130, 9), "C": walk(50, 10)}
    bars, values = frame(spark, frames), {"fast": [3, 5], "slow": [10, 15]}
    got = {(r["symbol"], r["window"]): r for r in backtest.walk_forward(bars, "ma_cross", values, 60, 30, 25, anchored).collect()}
    sets, want = backtest.grid(values), 0
    for symbol, d in frames.items():
        for k, (a, split, end) in enumerate(backtest.windows(len(d), 60, 30, 25, anchored)):
            inside = {r["param_id"]: r for r in backtest.evaluate(frame(spark, {symbol: d[a:split]}), "ma_cross", sets).collect()}
            best = max(inside, key=lambda i: (inside[i]["sharpe"], -i))
            outside = backtest.evaluate(frame(spark, {symbol: d[split:end]}), "ma_cross", sets).filter(F.col("param_id") == best).first()
            r = got[symbol, k]
            assert r["param_id"] == best and np.isclose(r["in_sharpe"], inside[best]["sharpe"]) and np.isclose(r["out_total_return"], outside["total_return"]) and np.isclose(r["in_max_drawdown"], inside[best]["max_drawdown"])
            want += 1
            if k >= 2 and symbol == "A":
                break
    assert want and len(got) == sum(len(backtest.windows(len(d), 60, 30, 25, anchored)) for d in frames.values())


def test_simulation_up_to_each_end():
    rng = np.random.default_rng(3)
    c, o, s = 100 + rng.normal(size=80).cumsum(), 100 + rng.normal(size=80).cumsum(), rng.integers(-1, 2, 80).astype(float)
    for fill in ("close", "next_open"):
        config = backtest.Config(fill=fill)
        for n, (equity, trades) in zip([10, 11, 40, 80], backtest.simulate_to(o, c, s, config, [10, 11, 40, 80]), strict=True):
            e, t = backtest.simulate(o[:n], c[:n], s[:n], config)
            assert np.allclose(equity, e) and trades == t
