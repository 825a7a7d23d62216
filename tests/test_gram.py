"""Tiled correlations and greedy pools against pandas and the matrix version."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import gram, search

DAY = dt.date(2020, 1, 1)


def panel(symbols, days, seed, missing=0.0):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=(days, 4))
    d = common @ rng.normal(size=(4, symbols)) * 0.01 + rng.normal(0.0005, 0.01, (days, symbols))
    d[rng.random(d.shape) < missing] = np.nan
    return pd.DataFrame(d, columns=[f"s{i:03d}" for i in range(symbols)])


def rows(spark, d):
    return spark.createDataFrame([(c, DAY + dt.timedelta(days=i), float(v)) for c in d for i, v in enumerate(d[c]) if v == v], "symbol string, trade_date date, r double").repartition(4)


@pytest.mark.parametrize("tile, dates", [(7, 50), (64, 512)])
def test_correlated(spark, monkeypatch, tile, dates):
    monkeypatch.setattr(gram, "DATES", dates)
    d = panel(30, 160, 1, 0.1)
    d["flat"], d["late"] = 0.5, np.where(np.arange(160) < 158, np.nan, 1.0)
    x = rows(spark, d)
    got = {(r["a"], r["b"]): r for r in gram.correlated(x, tile=tile).collect()}
    want = d.corr(min_periods=2)
    for i, a in enumerate(sorted(d)):
        for b in sorted(d)[i + 1 :]:
            both = d[[a, b]].dropna()
            if len(both) < 2:
                assert (a, b) not in got
                continue
            r = got[a, b]
            assert r["n"] == len(both) and np.isclose(r["corr"], 0.0 if np.isnan(want.loc[a, b]) or both.std().min() < 1e-12 else want.loc[a, b]) and np.isclose(r["cov"], both[a].cov(both[b]), atol=1e-15)
    strong = {k for k, r in got.items() if abs(r["corr"]) >= 0.5}
    assert {(r["a"], r["b"]) for r in gram.correlated(x, least=0.5, tile=tile).collect()} == strong and strong
    top = {(r["a"], r["b"]) for r in gram.correlated(x, top=3, days=20, tile=tile).collect()}
    best = set()
    for s in d:
        own = sorted(((-abs(r["corr"]), k) for k, r in got.items() if s in k and r["n"] >= 20))[:3]
        best |= {k for _, k in own}
    assert top == best
    assert gram.correlated(x.limit(0)).count() == 0


def test_greedy_pools_equal_the_matrix_version(spark):
    d = panel(60, 120, 2)
    x, names = rows(spark, d), list(d)
    for size, alpha in ((8, 2.0), (5, 0.3)):
        got = [s for s, _, _ in gram.greedy(x, size, alpha)]
        assert got == [names[i] for i in search.pool(d.to_numpy(), size, alpha)]
    assert [s for s, _, _ in gram.greedy(x, 6, most=0.3)] == [names[i] for i in search.pool(d.to_numpy(), 6, most=0.3)]
    pools = gram.diverse_pools(x, 3, 5).collect()
    want = search.diverse_pools(d.to_numpy(), 3, 5)
    assert [r["symbols"] for r in pools] == [[names[i] for i in p] for p, _, _ in want]
    assert np.allclose([(r["quality"], r["correlation"]) for r in pools], [(q, c) for _, q, c in want])
    few = rows(spark, d.iloc[:, :4])
    assert {s for s, _, _ in gram.greedy(few, 9)} == set(names[:4]) - {n for n in names[:4] if search.quality(d[[n]].to_numpy())[0] <= -1} and gram.greedy(few, 0) == []
