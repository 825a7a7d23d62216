"""What the strategies should signal and a back-test should give, from SURVEY's definitions; nothing here uses a plan."""

import math

import numpy as np
import pandas as pd

from .expect_indicators import ema, hh, ll, rma, sd, tr

WANT = {}


def want(fn):
    WANT[fn.__name__] = fn
    return fn


def sma(s, n): return s.rolling(n).mean()
def atr(d, n): return rma(tr(d).where(d.index > 0), n)


def rsi(s, n):
    c = s.diff()
    up, down = rma(c.clip(lower=0), n), rma((-c).clip(lower=0), n)
    return (100 - 100 / (1 + up / down)).mask(down == 0, 100.0)


def signal(buy, sell, first):
    out = np.where(buy, 1, np.where(sell, -1, 0))
    out[: first - 1] = 0
    return out


def over(a, b): return (a.shift() <= b.shift()) & (a > b)
def under(a, b): return (a.shift() >= b.shift()) & (a < b)


def hold(d, first, enter, leave):
    """enter(i) when flat; leave(i, entry place) when in."""
    out, entry = np.zeros(len(d), int), None
    for i in range(first - 1, len(d)):
        if entry is None:
            if enter(i):
                out[i], entry = 1, i
        elif leave(i, entry):
            out[i], entry = -1, None
    return out


@want
def ma_cross(d, fast=5, slow=20):
    a, b = sma(d.close, fast), sma(d.close, slow)
    return signal(over(a, b), under(a, b), max(fast, slow) + 2)


WANT["walk_forward_adaptive"] = ma_cross


def macd(d):
    dif = ema(d.close, 12) - ema(d.close, 26)
    return dif, ema(dif, 9)


@want
def macd_cross(d): return signal(over(*macd(d)), under(*macd(d)), 1)


@want
def triple_ma(d):
    a, b, c = (sma(d.close, n) for n in (5, 20, 60))
    ok = (a > b) & (b > c)
    sell = under(a, b) & (np.arange(len(d)) >= 64)
    return signal(ok & ~(ok.shift(fill_value=False) & ok.shift(2, fill_value=False)), sell, 64)


@want
def turtle(d):
    top, bottom, a = hh(d, 20).shift(), ll(d, 10).shift(), atr(d, 20)
    return hold(d, 22, lambda i: d.close[i] > top[i], lambda i, e: d.close[i] < bottom[i] or d.close[i] < d.close[e] - 2 * a[i])


@want
def donchian(d):
    wide = (hh(d, 20) - ll(d, 20)) / ll(d, 20).clip(lower=0.01) > 0.03
    return signal((d.close > hh(d, 20).shift()) & wide, d.close < ll(d, 10).shift(), 22)


def band(d): return sma(d.close, 20), sma(d.close, 20) - 2 * sd(d.close, 20)


@want
def bb_reversion(d):
    (m, low), r, c = band(d), rsi(d.close, 14), d.close
    return hold(d, 35, lambda i: c[i] < low[i] and r[i] < 30 and c[i] > c[i - 1], lambda i, e: c[i] > m[i] or i - e >= 5)


@want
def rsi_extreme(d):
    r, c = rsi(d.close, 14), d.close
    return hold(d, 16, lambda i: r[i - 1] > 30 and r[i] <= 30 and c[i] > c[i - 1], lambda i, e: r[i] >= 55 or i - e >= 5)


@want
def bb_rsi_double(d):
    (m, low), r, c, v = band(d), rsi(d.close, 14), d.close, sma(d.volume, 20)
    return hold(d, 35, lambda i: c[i] < low[i] and r[i] < 30 and d.volume[i] > 1.5 * v[i] and c[i] > c[i - 1], lambda i, e: c[i] > m[i])


@want
def kdj_extreme(d):
    hi, lo, k, s, ks, ds = hh(d, 9), ll(d, 9), 50.0, 50.0, [], []
    for i in range(len(d)):
        if i >= 8:
            k = 2 / 3 * k + (50.0 if hi[i] - lo[i] < 1e-10 else 100 * (d.close[i] - lo[i]) / (hi[i] - lo[i])) / 3
            s = 2 / 3 * s + k / 3
        ks.append(k)
        ds.append(s)
    return hold(d, 11, lambda i: ks[i] < 20 and ds[i] < 20 and 3 * ks[i] - 2 * ds[i] < 0 and d.close[i] > d.close[i - 1], lambda i, e: ks[i] >= 55)


@want
def zscore_reversion(d):
    z = (d.close - sma(d.close, 20)) / sd(d.close, 20).clip(lower=0.0001)
    return hold(d, 22, lambda i: z[i] <= -2 and d.close[i] > d.close[i - 1], lambda i, e: z[i] >= -0.5)


@want
def cross_momentum(d):
    out, inside = np.zeros(len(d), int), False
    for i in range(61, len(d)):
        if i % 20 == 0 and not inside:
            out[i], inside = 1, True
        if inside and d.close[i] / d.close[i - 60] - 1 < -0.05:
            out[i], inside = -1, False
    return out


@want
def ts_momentum(d):
    s = sma(np.sign(d.close.diff(60)).replace(0, -1).fillna(0), 5)
    return signal((s > 0) & (s.shift() <= 0), (s <= 0) & (s.shift() > 0), 66)


@want
def dual_rsi(d):
    f, s = rsi(d.close, 7), rsi(d.close, 14)
    ok = (f > s) & (f.diff() > 0) & (s.diff() > 0) & (np.arange(len(d)) >= 15)
    return signal(ok & ~ok.shift(fill_value=False), ~ok & ok.shift(fill_value=False), 16)


@want
def vol_breakout_ma(d):
    m = sma(d.close, 60)
    return signal((d.close > m) & (d.volume > 1.5 * sma(d.volume, 20)) & (d.close.shift() < m.shift()), d.close < sma(d.close, 20), 62)


@want
def volatility_breakout(d):
    a, c = atr(d, 20), d.close
    return hold(d, 22, lambda i: c[i] > c[i - 1] + 2 * a[i], lambda i, e: c[i] < c[e] - 0.5 * a[i])


@want
def keltner_breakout(d):
    m = ema(d.close, 20)
    return signal(over(d.close, m + 2 * atr(d, 10)), d.close < m, 22)


@want
def macd_rsi_combo(d):
    (dif, dea), r = macd(d), rsi(d.close, 14)
    return signal(over(dif, dea) & (r > 40) & (r < 65), dea.shift().notna() & (under(dif, dea) | (r > 80)), 1)


@want
def ma_volume_confirm(d):
    a, b = sma(d.close, 5), sma(d.close, 20)
    ok = (d.close > a) & (a > b) & (d.volume > 1.5 * sma(d.volume, 20))
    return signal(ok & ~ok.shift(fill_value=False), ~ok & ok.shift(fill_value=False), 22)


@want
def multi_factor(d):
    c, late = d.close, np.arange(len(d)) >= 20
    roc = (c.diff(20) / c.shift(20).clip(lower=0.01)).where(late, 0.0)
    ratio = (sma(d.volume, 5) / sma(d.volume, 20).clip(lower=0.01)).where(late, 1.0)
    eff = (c.diff(20).abs() / c.diff().abs().rolling(20).sum().clip(lower=0.01)).where(late, 0.0)
    z = lambda s: (s - sma(s, 121)) / sd(s, 121).clip(lower=0.0001)
    score = sma(0.3 * z(roc) + 0.25 * z(ratio) + 0.2 * z(eff) + 0.15 * (1 - 100 * atr(d, 14) / c.clip(lower=0.01)) + 0.1 * eff, 5)
    return hold(d, 126, lambda i: i % 20 == 0 and score[i] > 0, lambda i, e: i % 20 == 0 and score[i] < -0.5)


def account(close, orders, cash=100_000.0):
    """Equity after each bar and the profits of the trades."""
    shares, paid, equity, profits = 0.0, 0.0, [], []
    for i, (price, order) in enumerate(zip(close, orders)):
        if order > 0 and not shares:
            paid = price * 1.001
            shares = cash / 1.0003 / paid
            cash -= shares * paid * 1.0003
        last = i == len(close) - 1
        if shares and (order < 0 or last):
            got = price * 0.999
            fees = shares * got * 0.0013
            profits.append((got - paid) * shares - fees)
            cash, shares = cash + shares * got - fees, 0.0
        equity.append(cash + shares * price * 0.999)
    return np.array(equity), np.array(profits)


def measures(equity, profits):
    e = pd.Series(equity)
    r = e.pct_change().dropna()
    fall = (e / e.cummax() - 1).min()
    run = longest = 0
    for i, v in enumerate(equity):
        run = 0 if i and v > max(equity[:i]) else run + 1
        longest = max(longest, run)
    year, bad, gain, loss = math.sqrt(252), r[r < 0], profits[profits > 0], -profits[profits <= 0]
    annual = (e.iloc[-1] / 1e5) ** (252 / len(e)) - 1
    return {
        "total_return": e.iloc[-1] / 1e5 - 1, "annual_return": annual, "annual_volatility": r.std(ddof=0) * year, "max_drawdown": fall, "max_drawdown_bars": longest, "sharpe": r.mean() / r.std(ddof=0) * year if r.std(ddof=0) > 0 else 0.0,
        "sortino": r.mean() / math.sqrt((bad**2).mean()) * year if len(bad) else 0.0, "calmar": annual / -fall if fall < 0 else 0.0, "win_rate": len(gain) / len(profits) if len(profits) else 0.0,
        "profit_loss_ratio": (gain.mean() if len(gain) else 0.0) / loss.mean() if len(loss) and loss.mean() > 0 else 0.0, "n_trades": len(profits), "final_equity": e.iloc[-1],
    }
