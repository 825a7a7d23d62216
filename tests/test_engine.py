"""The market-analytics engine against hand-made and NumPy references."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import backtest, distribution, factors, indicators, patterns, relational, risk, scanner, search, strategies
from tidemark.plans.staged import Plan, recurrence
from tidemark.script.compile import execute, signals
from tidemark.script.parser import ScriptError
from tidemark.sources import bars as B
from tidemark.streaming import bars as S

TEN = [(10.0, 10.5, 9.8, 10.2, 10000), (10.2, 10.8, 10.1, 10.6, 12000), (10.6, 10.7, 10.0, 10.1, 8000), (10.1, 10.9, 10.0, 10.8, 15000), (10.8, 11.2, 10.7, 11.0, 20000), (11.0, 11.3, 10.6, 10.7, 18000), (10.7, 10.8, 10.2, 10.4, 11000), (10.4, 10.9, 10.3, 10.85, 13000), (10.85, 11.0, 10.5, 10.55, 9000), (10.55, 11.1, 10.5, 11.05, 14000)]
DAY = dt.date(2026, 1, 5)


def frame(spark, rows, symbol="A"):
    data = [(symbol, DAY + dt.timedelta(days=i), *map(float, r), float(r[3] * r[4]), 0.05) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, B.SCHEMA)


@pytest.fixture(scope="module")
def ten(spark):
    return frame(spark, TEN)


@pytest.fixture(scope="module")
def sine(spark):
    rows = []
    for i in range(160):
        f = 0.1 * i
        p = 100 + 20 * math.sin(f) + 8 * math.cos(1.7 * f)
        rows.append((p - 0.3, p + 0.5 + 1.5 * abs(math.sin(3 * f)), p - 0.5 - 1.5 * abs(math.cos(2.7 * f)), p, 1e6 + 5e6 * abs(math.sin(5 * f))))
    return frame(spark, rows), np.array(rows)


def column(df, name):
    return np.array([r[name] if r[name] is not None else np.nan for r in df.orderBy("trade_date").collect()], float)


def test_sma_and_ema(ten):
    close = np.array([r[3] for r in TEN])
    got = indicators.apply(ten, {"sma": {"period": 3}, "ema": {"period": 3}})
    sma = column(got, "sma")
    assert np.isnan(sma[:2]).all() and np.allclose(sma[2:], np.convolve(close, np.ones(3) / 3, "valid"))
    ema = column(got, "ema")
    y = close[:3].mean()
    assert np.isclose(ema[2], y)
    for i in range(3, 10):
        y = 0.5 * close[i] + 0.5 * y
        assert np.isclose(ema[i], y)


def test_rsi_macd_atr(sine):
    df, rows = sine
    got = indicators.apply(df, ["rsi", "macd", "atr", "bb", "kdj"])
    close, high, low = rows[:, 3], rows[:, 1], rows[:, 2]
    up, down = np.maximum(np.diff(close), 0), np.maximum(-np.diff(close), 0)
    a, b = up[:14].mean(), down[:14].mean()
    want = [100 - 100 / (1 + a / b)]
    for u, d in zip(up[14:], down[14:], strict=True):
        a, b = (a * 13 + u) / 14, (b * 13 + d) / 14
        want.append(100 - 100 / (1 + a / b))
    assert np.allclose(column(got, "rsi")[15:], want[1:]) and np.isnan(column(got, "rsi")[:15]).all()
    tr = np.concatenate([[high[0] - low[0]], np.maximum.reduce([high[1:] - low[1:], abs(high[1:] - close[:-1]), abs(low[1:] - close[:-1])])])
    y = tr[:14].mean()
    for t in tr[14:]:
        y = (13 * y + t) / 14
    assert np.isclose(column(got, "atr")[-1], y)
    assert np.isclose(column(got, "bb_upper")[-1], close[-20:].mean() + 2 * close[-20:].std())


def test_every_indicator_gives_values(sine):
    df, _ = sine
    short = {n: {"period": 40} for n in ("hurst", "vfi", "fib_retracement")}
    got = indicators.apply(df, {n: short.get(n, {}) for n in indicators.REGISTRY}).toPandas()
    empty = [c for c in got.columns if got[c].isna().all()]
    assert set(empty) <= {"sr_detect_spike"}
    assert len(indicators.REGISTRY) == 135  # range_stats is a function of its own


def test_bad_names_and_parameters(ten):
    for wanted in (["nothing"], {"sma": {"length": 3}}):
        with pytest.raises(ValueError):
            indicators.apply(ten, wanted)
    with pytest.raises(ValueError):
        factors.apply(ten, ["nothing"])


def test_symbols_do_not_mix(spark, ten):
    both = ten.unionByName(frame(spark, [(1, 1, 1, 1, 1)] * 10, "B"))
    got = indicators.apply(both, {"sma": {"period": 3}, "rsi": {"period": 3}})
    assert np.allclose(column(got.filter("symbol = 'B'"), "sma")[2:], 1)
    assert np.allclose(column(got.filter("symbol = 'A'"), "sma")[2:], column(indicators.apply(ten, {"sma": {"period": 3}}), "sma")[2:])


def test_one_exchange_for_window_indicators(ten):
    plan = indicators.apply(ten, ["sma", "bb", "dc", "williams_r", "cci"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_null_and_nan_prices(spark, ten):
    from pyspark.sql import functions as F

    holes = ten.withColumn("close", F.when(F.col("trade_date") == DAY + dt.timedelta(days=3), F.lit(float("nan"))).otherwise(F.col("close")))
    got = column(indicators.apply(B.clean(holes), {"sma": {"period": 3}}), "sma")
    assert np.isnan(got[3:6]).all() and not np.isnan(got[6])


def test_recurrence_seeds():
    x, one = np.array([np.nan, 1.0, 2.0, np.nan, 4.0]), np.full(5, 0.5)
    assert np.allclose(recurrence(x, one, one, "first", 1)[1:], [1, 1.5, 1.5, 2.75])
    assert np.allclose(recurrence(x, one, one, "sma", 2)[2:], [1.5, 1.5, 2.75])
    assert np.allclose(recurrence(x, one, one, 10.0, 1), [10, 5.5, 3.75, 3.75, 3.875])


def test_factors(sine):
    df, rows = sine
    got = factors.apply(df, ["ma5", "ret5", "std5", "pct_rank5", "vol_skew", "nvi", "rsi6"])
    close = rows[:, 3]
    assert np.isclose(column(got, "ma5")[-1], close[-1] / close[-5:].mean() - 1)
    assert column(got, "ret5")[0] == 0 and np.isclose(column(got, "ret5")[-1], close[-1] / close[-6] - 1)
    assert np.isclose(column(got, "pct_rank5")[-1], (close[-5:] < close[-1]).sum() / 5)
    r = np.concatenate([[0], np.diff(close) / close[:-1]])[-20:]
    assert np.isclose(column(got, "vol_skew")[-1], ((r - r.mean()) ** 3).mean() / r.std() ** 3)
    assert len(factors.REGISTRY) == 158


def test_candles_and_patterns(spark):
    flat = [(10, 10.3, 9.7, 10.1, 100)] * 25
    df = frame(spark, [*flat, (10.0, 10.5, 9.5, 10.0, 100), (10.0, 10.05, 9.0, 9.1, 100), (9.0, 10.3, 8.95, 10.2, 100)])
    got = {(r["pattern"], r["end_date"]) for r in patterns.candles(df).collect()}
    at = lambda i: DAY + dt.timedelta(days=i)
    assert ("doji", at(25)) in got and ("engulfing", at(27)) in got and ("long_body", at(26)) in got
    assert len(patterns.names()) == 61


def test_double_top(spark):
    path = [10, 11, 12, 13, 14, 15, 20, 15, 14, 13, 12, 11, 12, 13, 14, 15, 16, 20, 16, 15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5]
    path = [10 - 0.1 * k for k in range(20, 0, -1)] + path
    df = frame(spark, [(p, p + 0.1, p - 0.1, p, 100) for p in path])
    assert "double_top" in {r["pattern"] for r in patterns.charts(df).collect()}


def test_simulation_by_hand():
    close = np.array([10.0, 11.0, 12.0])
    equity, trades = backtest.simulate(close, close, np.array([1, 0, -1]), backtest.Config())
    shares = 100_000 / 1.0003 / (10 * 1.001)
    value = shares * 12 * 0.999
    assert np.isclose(equity[-1], value * (1 - 0.0013)) and len(trades) == 1 and np.isclose(trades[0][5], value * (1 - 0.0013) - shares * 10 * 1.001)
    late, _ = backtest.simulate(close, close, np.array([0, 0, 1]), backtest.Config())
    assert np.isclose(late[-1], 100_000 / 1.0003 / 1.001 * 0.999 * (1 - 0.0013))
    m = backtest.metrics(np.array([100000, 102000, 98000, 95000, 97000, 103000, 108000.0]), [], 100000)
    assert np.isclose(m["max_drawdown"], (95000 - 102000) / 102000) and m["max_drawdown_bars"] == 3


def test_strategies_and_search(sine):
    df, _ = sine
    p = Plan()
    p.out(**{n: strategies.formula(p, n) for n in strategies.REGISTRY})
    got = p.spark(df).toPandas()
    assert len(strategies.REGISTRY) == 20 and (got["ma_cross"] == 1).sum() > 0
    assert set(np.unique(got[list(strategies.REGISTRY)].to_numpy())) <= {-1, 0, 1}
    best = backtest.grid_search(df, "ma_cross", {"fast": [3, 5], "slow": [10, 20]}).first()
    each = backtest.evaluate(df, "ma_cross", backtest.grid({"fast": [3, 5], "slow": [10, 20]})).toPandas()
    assert np.isclose(best["sharpe"], each["sharpe"].max())
    assert strategies.signals(df, "nothing").filter("signal <> 0").count() == 0


def test_walk_forward_and_monte_carlo(spark, sine):
    df, _ = sine
    found = backtest.walk_forward(df, "ma_cross", {"fast": [3, 5], "slow": [10]}, 60, 30, 30)
    assert found.count() == len(backtest.windows(160, 60, 30, 30))
    rows, s = found.toPandas(), backtest.walk_forward_summary(found).first()
    fast = np.array([p["fast"] for p in rows["params"]])
    assert np.isclose(s["variation"], fast.std() / fast.mean() / 2) and np.isclose(s["out_sharpe"], rows["out_sharpe"].mean()) and s["grade"] in ("excellent", "good", "fair", "warning")
    curves = spark.createDataFrame([("A", i, v) for i, v in enumerate([100.0, 101.0, 99.0, 103.0])], "symbol string, bar long, equity double")
    pnl = spark.createDataFrame([("A", 1, 5.0), ("A", 2, -3.0)], "symbol string, seq long, pnl double")
    for method in backtest.METHODS:
        a, b = (sorted(backtest.monte_carlo(curves, pnl, method, 50, chunk=c).collect()) for c in (7, 100))
        assert a == b and len(a) == 50 and all(r["max_drawdown"] <= 0 for r in a)
    sims = backtest.monte_carlo(curves, pnl, "bootstrap", 50)
    x = np.sort(sims.toPandas()["annual_return"])
    m = backtest.monte_carlo_summary(sims).first()
    assert m["median_return"] == x[24] and m["var_95"] == x[2] and np.isclose(m["cvar_95"], x[x <= x[2]].mean()) and m["ci_lower_return"] == x[1] and np.isclose(m["prob_profit"], (x > 0).mean())
    shuffled = backtest.monte_carlo(curves, pnl, "shuffle", 200).toPandas()
    assert shuffled["final_equity"].between(100_000 + 5 * 0.8 - 3 * 1.2, 100_000 + 5 * 1.2 - 3 * 0.8).all()


def test_scanner(spark, ten):
    tree = {"op": "AND", "children": [{"op": "COMPARE", "indicator": "close", "compare": ">", "value": 10}, {"op": "COMPARE", "indicator": "sma", "params": {"period": 3}, "compare": "<", "value": 20}]}
    row = scanner.scan(ten, tree).first()
    a, b = (11.05 - 10) / 10, (20 - (10.85 + 10.55 + 11.05) / 3) / 20
    assert np.isclose(row["score"], max(min(a, b), 1) * (a + b) / 20)
    cross = lambda way, value: scanner.scan(ten, {"op": "CROSS", "indicator": "close", "compare": way, "value": value}).collect()
    assert cross("above", 10.8)[0]["score"] == 1 and not cross("below", 10.8) and not cross("above", 10.0)
    equal = {"op": "OR", "children": [{"op": "COMPARE", "indicator": "close", "compare": "==", "value": 11.05}, {"op": "COMPARE", "indicator": "close", "compare": "!=", "value": 11.05}]}
    assert scanner.scan(ten, equal).first()["score"] == 1
    with pytest.raises(ValueError):
        scanner.scan(ten, {"op": "COMPARE", "indicator": "nothing", "compare": ">", "value": 1})


def test_script(ten):
    got = execute(ten, "let a = SMA(Close, 3); plot x = cross(a, c); prev: close[1]; y: if (close > prev) then 1 else 0; z: -2 ^ 2 + 10 % 4; w: macd(close,12,26,9).dif; q: sma(close,5) > sma(close,20);")
    close = np.array([r[3] for r in TEN])
    assert np.allclose(column(got, "prev")[1:], close[:-1]) and np.allclose(column(got, "z"), -2)
    assert np.allclose(column(got, "y")[1:], (np.diff(close) > 0).astype(float))
    for bad in ("plot x = ;", "plot x = nothing(close);", "plot x = zz;", "x: ref(close);", "x: (close;"):
        with pytest.raises(ScriptError):
            execute(ten, bad)
    s = signals(ten, "buy_now: close > open; exit_now: close < open;").orderBy("trade_date").toPandas()
    assert s["buy"].tolist() == [r[3] > r[0] for r in TEN] and s["sell"].tolist() == [r[3] < r[0] for r in TEN]


def test_resample_heikin_ashi_and_summary(spark, ten):
    week = B.resample(ten, "week").orderBy("trade_date").collect()
    assert week[0]["open"] == 10.0 and week[0]["close"] == 10.4 and week[0]["volume"] == sum(r[4] for r in TEN[:7])
    ha = relational.heikin_ashi(ten).orderBy("trade_date").collect()
    assert np.isclose(ha[1]["ha_open"], (10.0 + sum(TEN[0][:4]) / 4) / 2)
    stocks = spark.createDataFrame([("A",), ("Z",)], "symbol string")
    assert {r["symbol"]: r["bars"] for r in relational.summary(stocks, ten).collect()} == {"A": 10, "Z": 0}


def test_ingest_and_quality(spark, ten):
    first = ten.filter(f"trade_date < DATE '{DAY + dt.timedelta(days=4)}'")
    assert relational.insert_or_ignore(first, ten.unionByName(ten), ["symbol", "trade_date"]).count() == 6
    bad = ten.unionByName(frame(spark, [(10, 9, 11, 10, -1)], "A"))
    assert {r["rule"] for r in relational.quality(bad).collect()} == {"ohlc", "duplicate", "negative"}


def test_fifo(spark):
    t = spark.createDataFrame([("A", 1, "buy", 10.0, 100.0), ("A", 2, "buy", 12.0, 100.0), ("A", 3, "sell", 15.0, 150.0), ("A", 4, "sell", 9.0, 100.0)], "symbol string, seq long, direction string, price double, quantity double")
    got = relational.fifo_summary(t).first()
    assert np.isclose(got["pnl"], 100 * 5 + 50 * 3 + 50 * -3) and got["sells"] == 2 and got["win_rate"] == 50


def test_fifo_against_a_queue(spark):
    rng = np.random.default_rng(4)
    rows = [(s, i, "buy" if rng.random() < 0.5 else "sell", float(rng.integers(5, 20)), float(rng.integers(1, 9)), float(rng.integers(0, 3)), 0.5) for s in "ABC" for i in range(60)]
    t = spark.createDataFrame(rows, "symbol string, seq long, direction string, price double, quantity double, commission double, stamp_tax double").repartition(3)
    got = {r["symbol"]: r for r in relational.fifo_summary(t).collect()}
    for s in "ABC":
        queue, profits = [], []
        for _, _, way, price, q, fee, tax in (r for r in rows if r[0] == s):
            if way == "buy":
                queue.append([price, q])
                continue
            left, p = q, 0.0
            while left > 0 and queue:
                part = min(left, queue[0][1])
                p += (price - queue[0][0]) * part - (fee + tax) * part / q
                left -= part
                queue[0][1] -= part
                if queue[0][1] <= 0:
                    queue.pop(0)
            profits.append(p)
        r, x = got[s], np.array(profits)
        assert np.isclose(r["pnl"], x.sum()) and r["sells"] == len(x) and r["wins"] == (x > 0).sum() and np.isclose(r["max_win"], x.max()) and np.isclose(r["avg_loss"], x[x < 0].mean())
        assert np.isclose(r["profit_factor"], x[x > 0].sum() / -x[x < 0].sum())


def test_alerts(spark, ten):
    rows = [(1, "A", "price_breakout", '{"direction":"above","price":11}', True, None), (2, "A", "price_breakout", '{"direction":"below","price":11}', True, None), (3, "A", "volume_spike", '{"multiplier":1.0,"lookback":5}', True, None), (4, "A", "price_breakout", '{"direction":"above","price":1}', True, DAY + dt.timedelta(days=9))]
    rules = spark.createDataFrame(rows, "rule_id int, symbol string, condition_type string, params string, enabled boolean, last_triggered date")
    assert {r["rule_id"] for r in relational.check_alerts(rules, ten, str(DAY + dt.timedelta(days=9))).collect()} == {1}


def test_distribution(ten):
    v = distribution.volume_profile(ten, 5).toPandas()
    assert np.isclose(v["volume"].sum(), sum(r[4] for r in TEN)) and v["is_poc"].sum() == 1
    assert distribution.volume_profile(ten.withColumn("close", ten["open"] * 0 + 1), 5).count() == 0
    d = pd.DataFrame(TEN, columns=["open", "high", "low", "close", "volume"])
    left = d.volume * 0.95 ** np.arange(9, -1, -1)
    step = (d.high.max() - d.low.min()) / 100
    level = np.minimum(np.floor((d.close - d.low.min()) / step), 99).astype(int)
    want = 100 * np.bincount(level, left, 100) / left.sum()
    chips = distribution.cost_distribution(ten)
    got = chips.orderBy("level").toPandas()
    assert len(got) == 100 and np.allclose(got["chips"], want) and np.allclose(got["price"], d.low.min() + step * (np.arange(100) + 0.5))
    cost = (d.close * d.volume).sum() / d.volume.sum()
    p = distribution.profit_ratio(chips, ten).first()
    assert np.isclose(p["avg_cost"], cost) and np.isclose(p["weighted_avg_cost"], (got["price"] * want).sum() / 100) and np.isclose(p["profit_pct"], want[got["price"] < d.close.iloc[-1]].sum())
    moving = distribution.moving_distribution(ten, 3).orderBy("trade_date").toPandas()
    assert len(moving) == 3 and np.isclose(moving["avg_cost"].iloc[-1], cost) and np.isclose(moving["weighted_avg_cost"].iloc[-1], p["weighted_avg_cost"])
    before = distribution.cost_distribution(ten.filter(f"trade_date < DATE '{DAY + dt.timedelta(days=9)}'")).toPandas()
    assert np.isclose(moving["weighted_avg_cost"].iloc[-2], (before["price"] * before["chips"]).sum() / 100)
    assert distribution.historical_frames(ten).count() == 0
    c = distribution.concentration(chips).first()
    top = np.sort(want)[::-1]
    assert np.isclose(c["cr5"], top[:5].sum()) and np.isclose(c["trend"], (want**2).sum() / 100)


def test_historical_frames(sine):
    df, rows = sine
    got = distribution.historical_frames(df, 8).toPandas()
    assert len(got) == 800 and sorted(got["ago"].unique()) == [160 - 20 * k for k in range(8, 0, -1)]
    last, whole = got[got["ago"] == 0].sort_values("level"), distribution.cost_distribution(df).orderBy("level").toPandas()
    assert np.allclose(last["chips"], whole["chips"]) and np.allclose(last["price"], whole["price"])


def test_risk_and_statistics(ten):
    r = risk.returns(ten)
    close = np.array([x[3] for x in TEN])
    x = np.diff(np.log(close))
    m = risk.metrics(r).first()
    assert np.isclose(m["annual_return"], x.mean() * 252) and np.isclose(m["volatility"], x.std() * math.sqrt(252)) and np.isclose(m["var_95"], np.sort(x)[0]) and np.isclose(m["total_return"], np.prod(1 + x) - 1)
    s = relational.statistics(ten, "close").first()
    assert np.isclose(s["std"], close.std(ddof=1)) and np.isclose(s["skew"], pd.Series(close).skew()) and np.isclose(s["kurtosis"], pd.Series(close).kurt())
    assert np.isclose(relational.spearman(ten, "close", "close").first()["spearman"], 1)
    assert np.isclose(risk.max_drawdown(ten).first()["max_drawdown"], (1 - close / np.maximum.accumulate(close)).max())


def test_search():
    rng = np.random.default_rng(1)
    r = rng.normal(0.001, 0.01, (200, 5))
    cov, mean = np.cov(r.T), r.mean(axis=0)
    for s in search.WEIGHTS:
        w = search.weights(cov, mean, s)
        assert w.min() >= 0 and (s == "min_variance" or np.isclose(w.sum(), 1))
    part = r[:140]
    w = search.weights(np.cov(part.T), part.mean(axis=0), "risk_parity")
    assert np.isclose(search.projected_sharpe(r, "risk_parity"), (part @ w).mean() / (part @ w).std(ddof=1) * 252**0.5)
    assert search.projected_sharpe(r[:59], "risk_parity") is None and search.projected_sharpe(r[:, :1], "risk_parity") is None
    assert len(search.pool(r, 3)) == 3 and [len(p) for p, _, _ in search.diverse_pools(r, 2, 2)] == [2, 2]
    assert search.inverse(np.ones((2, 2))) is None
    m = search.correlation(r)
    root = search.loewdin(m)
    assert np.allclose(root @ root, m)
    meta, seen = search.MetaSearch(), []
    for k in range(30):
        node = meta.select()
        seen.append(tuple(node.values()))
        meta.record(node, float(k))
    assert meta.best()[1] == 29.0 and len(meta.nodes) == 270 and len(set(seen)) == 30 and seen[:10] == [tuple(n.values()) for n in meta.nodes[:10]]
    current, best, sizes = search.mars(np.arange(200) % 2, {"up": np.where(np.arange(200) % 2, 0.02, -0.02), "down": np.where(np.arange(200) % 2, -0.02, 0.02)})
    assert current == 1 and best == {0: "down", 1: "up"} and sizes == {0: 100, 1: 100}


def test_regime_features(spark):
    """The mean correlation of all pairs without pairs."""
    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.01, (90, 6))
    r[:, 5] = 0.0
    rows = [(f"s{j}", DAY + dt.timedelta(days=i), float(r[i, j])) for i in range(90) for j in range(6)] + [("s0", DAY + dt.timedelta(days=95), 0.5)]
    got = search.regime_features(spark.createDataFrame(rows, "symbol string, trade_date date, r double")).orderBy("trade_date").toPandas()
    assert len(got) == 90
    for i in (1, 5, 30, 89):
        w = pd.DataFrame(r[max(0, i - 19) : i + 1])
        c = w.corr().fillna(0.0).to_numpy()
        assert np.isclose(got["mean_corr"][i], c[np.triu_indices(6, 1)].mean()) and np.isclose(got["cs_vol"][i], w.std(ddof=0).mean() * 252**0.5) and np.isclose(got["dispersion"][i], w.std(axis=1, ddof=0).mean())
    m = r.mean(axis=1)
    value = np.cumprod(1 + m)
    assert np.isclose(got["trend"][89], m[30:].mean() / m[30:].std() * 252**0.5) and got["trend"][59] == 0 and np.isclose(got["drawdown"][89], value[89] / value.max() - 1)


def test_pairs_are_those_of_pandas(spark):
    rng = np.random.default_rng(5)
    d = pd.DataFrame(rng.normal(100, 1, (40, 4)), columns=list("abcd"))
    d.loc[3:9, "b"] = np.nan
    d["d"] = 7.0
    rows = [(c, DAY + dt.timedelta(days=i), float(v)) for c in d for i, v in enumerate(d[c]) if v == v] + [("e", DAY, 1.0)]
    got = {(r["a"], r["b"]): r for r in risk.pairs(spark.createDataFrame(rows, "symbol string, trade_date date, r double").repartition(5), list("abcd")).collect()}
    assert len(got) == 10 and got["d", "d"]["corr"] == 1 and got["a", "d"]["corr"] == 0
    for x, y in (("a", "b"), ("a", "c"), ("b", "c"), ("b", "b")):
        assert np.isclose(got[x, y]["corr"], d[x].corr(d[y])) and np.isclose(got[x, y]["cov"], d[x].cov(d[y])) and got[x, y]["n"] == (d[x].notna() & d[y].notna()).sum()


def test_streaming(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{d}/events.parquet").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = S.bars(S.ticks(spark, str(tmp_path / "in"), 10), late="400 days")
    S.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    whole = S.bars(spark.read.parquet(f"{d}/events.parquet"))
    q = S.ticks(spark, str(tmp_path / "in"), 10)
    q = S.bars(q, late="400 days").writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("bars").count() == whole.count()


def test_stream_alerts(spark, tmp_path):
    rows = [("A", dt.datetime(2026, 1, 1, h), float(100 if h == 22 else 1)) for h in range(24)]
    spark.createDataFrame(rows, "symbol string, ts timestamp, volume double").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("symbol string, ts timestamp, volume double").parquet(str(tmp_path / "in"))
    S.run_available(S.spikes(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0]["volume"] == 100.0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)


def test_every_machine_has_a_kernel_and_a_step_from_each_bar():
    """The SQL of a plan with kernels is that of their machines; a kernel without one is refused."""
    import duckdb
    import pytest

    from tidemark.operators import indicators
    from tidemark.script.compile import compile_script

    bars = "SELECT 'a' AS symbol, DATE '2020-01-01' + i::INTEGER AS trade_date, 1.0::DOUBLE AS open, 1.0::DOUBLE AS high, 1.0::DOUBLE AS low, v::DOUBLE AS close, 1.0::DOUBLE AS volume FROM (VALUES (0, 2), (1, 2), (2, 2), (3, 0), (4, 2), (5, 2), (6, 2)) t(i, v)"
    plan = compile_script("once: filter(close > open, 3);")
    got = duckdb.sql(f"SELECT once FROM ({plan.duck(bars, compare=False)}) ORDER BY trade_date").fetchall()
    assert [x for (x,) in got] == [1, 0, 0, 0, 1, 0, 0]
    with pytest.raises(ValueError):
        indicators.plan(["hurst"]).duck(bars)


def test_kernels_are_sent_what_is_used_after_them(spark):
    from tidemark.operators import indicators
    from tidemark.sources import bars as B

    bars = spark.createDataFrame([("a", None, 1.0, 1.0, 1.0, float(i), 5.0, 5.0, 0.1) for i in range(3)], B.SCHEMA)
    plan = indicators.plan({"ema": {"period": 2}, "obv": {}})
    assert all("high" not in used and "turnover" not in used for used in plan._used())
    sent = plan.spark(bars)._jdf.queryExecution().optimizedPlan().toString()
    assert "turnover" not in sent.split("FlatMapGroupsInArrow", 1)[1].split("Project", 1)[1].split("\n", 1)[0]
