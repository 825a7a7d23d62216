"""Series that are cut into blocks against the kernel and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks
from tidemark.plans.staged import Recurrence, recurrence


@pytest.mark.parametrize("parts", [1, 3, 16, 60])
def test_recurrences_in_blocks(spark, parts):
    rng = np.random.default_rng(parts)
    rows = []
    for symbol, n in (("A", 900), ("B", 5), ("C", 1), ("D", 120)):
        x, b = rng.normal(size=n), rng.uniform(0.2, 0.99, n)
        x[rng.random(n) < (0.9 if symbol == "D" else 0.05)] = np.nan
        if symbol == "A":
            x[:70] = np.nan
        rows += [(symbol, i, None if np.isnan(v) else float(v), float(w), float(1 - w)) for i, (v, w) in enumerate(zip(x, b, strict=True))]
    df = spark.createDataFrame(rows, "symbol string, t int, x double, b double, a double").repartition(4)
    wanted = {"ema": Recurrence("x", 2 / 13, 11 / 13, "sma", 12), "long": Recurrence("x", 0.1, 0.9, "sma", 100), "first": Recurrence("x", 0.3, 0.7), "fixed": Recurrence("x", 0.3, 0.7, 5.0), "varying": Recurrence("x", "a", "b"), "sum": Recurrence("x", 1.0, 1.0, 0.0)}
    got = blocks.recurrences(df, wanted, order="t", blocks=parts).orderBy("symbol", "t").toPandas()
    assert len(got) == len(rows) and list(got.columns) == ["symbol", "t", "x", "b", "a", *wanted]
    for symbol, d in got.groupby("symbol"):
        column = lambda v: d[v].to_numpy(float) if isinstance(v, str) else v  # noqa: B023, E731
        for name, r in wanted.items():
            want = recurrence(column(r.x), column(r.a), column(r.b), r.seed, r.n)
            assert np.allclose(d[name].to_numpy(float), want, rtol=1e-9, atol=1e-9, equal_nan=True), (symbol, name)


def test_one_key_is_many_blocks(spark):
    df = spark.range(200_000).select(F.lit("A").alias("symbol"), F.col("id").alias("t"), (F.sin("id") * 3).alias("x"))
    per = blocks.dealt(df, "symbol", "t", blocks=16).groupBy("_block").count().toPandas()["count"]
    assert len(per) == 16 and per.max() < 4 * 200_000 / 16
    got = blocks.recurrences(df, {"y": Recurrence("x", 0.1, 0.9)}, order="t", blocks=16).orderBy("t").toPandas()
    assert np.allclose(got["y"], recurrence(got["x"].to_numpy(), 0.1, 0.9, "first", 1), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_ranks_and_quantiles(spark, parts):
    rng = np.random.default_rng(parts)
    d = pd.DataFrame({"symbol": rng.choice(["A", "B", "C"], 3000, p=[0.9, 0.09, 0.01]), "x": rng.integers(0, 300, 3000) / 7.0})
    d.loc[rng.random(3000) < 0.4, "x"] = 3.0  # a value that many rows have
    d.loc[:20, "x"] = np.nan
    df = spark.createDataFrame([(s, None if np.isnan(x) else x) for s, x in d.itertuples(index=False)], "symbol string, x double").repartition(5)
    r = {(t["symbol"], t["x"]): t for t in blocks.ranks(df, "x", blocks=parts).collect()}
    d = d.dropna()
    d["below"] = d.groupby("symbol")["x"].rank(method="min") - 1
    assert len(r) == len(d.drop_duplicates(["symbol", "x"]))
    for (s, x), g in d.groupby(["symbol", "x"]):
        assert r[s, x]["below"] == g["below"].iloc[0] and r[s, x]["count"] == len(g) and r[s, x]["n"] == (d["symbol"] == s).sum()
    for t in blocks.quantiles(df, "x", {"q1": blocks.nearest(0.25), "hi": blocks.nearest(0.95)}, blocks=parts).collect():
        v = np.sort(d[d["symbol"] == t["symbol"]]["x"])
        assert t["q1"] == v[int(np.floor(0.25 * (len(v) - 1) + 0.5))] and t["hi"] == v[int(np.floor(0.95 * (len(v) - 1) + 0.5))]
    for t in blocks.tail(df, "x", 0.05, blocks=parts).collect():
        v = np.sort(d[d["symbol"] == t["symbol"]]["x"])
        cut = int(len(v) * 0.05)
        assert t["var"] == v[cut] and np.isclose(t["cvar"], v[:cut].mean() if cut else v[0])


def test_sorted_window():
    from tidemark.functions import kernels

    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, 400) / 4.0
    got = kernels.sorted_window(x, 25, lambda w: (w[0], w[12], sum(w[:5])))
    for i, row in enumerate(got):
        w = np.sort(x[i : i + 25])
        assert row.tolist() == [w[0], w[12], w[:5].sum()]
    assert len(got) == 376 and len(kernels.sorted_window(x[:24], 25, min)) == 0


def test_sliding_statistics_with_gaps():
    """What is missing leaves the window; the mean distance needs all values."""
    from tidemark.functions import kernels

    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, 300) / 4.0
    x[[0, 1, 40, 41, 200, 299]] = np.nan
    s = pd.Series(x)
    centre = s.rolling(25).mean().to_numpy()
    assert np.allclose(kernels.sliding_median(x, 25), s.rolling(25, min_periods=1).median(), equal_nan=True)
    want = s.rolling(25).apply(lambda w: np.abs(w - w.mean()).mean(), raw=True)
    assert np.allclose(kernels.sliding_spread(x, centre, 25), want, equal_nan=True) and want.notna().sum() > 150
    assert len(kernels.sliding_median(x[:0], 25)) == 0 and np.isnan(kernels.sliding_median(np.full(5, np.nan), 3)).all()


def test_a_sorted_window_equals_its_sql_and_goes_on(spark):
    import duckdb

    from tidemark.operators import indicators
    from tidemark.plans.resume import INPUTS, Resumable

    rng = np.random.default_rng(5)
    n = 160
    d = pd.DataFrame({c: 50 + rng.integers(-40, 40, n) / 4.0 for c in INPUTS})
    bars = pd.DataFrame({"symbol": "A", "trade_date": pd.date_range("2020-01-01", periods=n).date}).join(d)
    bars.loc[[60, 61], "close"] = None
    plan = indicators.plan({"median": {"period": 50}, "mad": {"period": 50}, "cci": {"period": 45}})
    got = plan.spark(spark.createDataFrame(bars.astype(object).where(bars.notna(), None), "symbol string, trade_date date, " + ", ".join(f"{c} double" for c in INPUTS))).toPandas().sort_values("trade_date")
    con = duckdb.connect()
    con.register("bars", bars)
    want = con.sql(plan.duck("SELECT * FROM bars", compare=False)).df().sort_values("trade_date")
    r, columns = Resumable(plan), {c: bars[c].to_numpy(float) for c in INPUTS}
    state, parts = r.start(), []
    for a, b in zip([0, 7, 49, 62, 63], [7, 49, 62, 63, n]):
        out, state = r.advance(state, {c: v[a:b] for c, v in columns.items()})
        parts.append(out)
    for name in plan.outputs:
        assert np.allclose(got[name].to_numpy(float), want[name].to_numpy(float), rtol=1e-9, equal_nan=True) and got[name].notna().sum() > 40, name
        assert np.allclose(np.concatenate([p[name] for p in parts]), want[name].to_numpy(float), rtol=1e-9, equal_nan=True), name
