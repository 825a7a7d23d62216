"""What every factor should give, in plain pandas and NumPy, from SURVEY's definitions; nothing here uses a plan."""

import math

import numpy as np
import pandas as pd

from .expect_indicators import tp_, tr

WANT = {}


def want(*names):
    def add(fn):
        for n in names:
            WANT[n] = fn
        return fn

    return add


def each(prefix, periods, fn):
    for n in periods:
        WANT[f"{prefix}{n}"] = lambda d, n=n: fn(d, n)


def r_(d, n=1): return d.close.pct_change(n).fillna(0.0)
def mean(s, n): return s.rolling(n, min_periods=1).mean()
def total(s, n): return s.rolling(n, min_periods=1).sum()
def sd(s, n): return s.rolling(n, min_periods=1).std(ddof=0)
def top(s, n): return s.rolling(n, min_periods=1).max()
def low(s, n): return s.rolling(n, min_periods=1).min()
def ema(s, n): return s.ewm(alpha=2 / (n + 1), adjust=False).mean()
def over(a, b, default=0.0): return (a / b).where(b > 0, default)
def late(s, n): return s.fillna(0.0).where(np.arange(len(s)) >= n, 0.0)
def tr1(d): return tr(d).where(d.index > 0, d.high - d.low)


each("ma", (5, 10, 20, 60, 120), lambda d, n: d.close / mean(d.close, n) - 1)
for _n in (5, 10, 20):
    WANT[f"ma{_n}_dev"] = lambda d, n=_n: over(d.close - mean(d.close, n), sd(d.close, n).where(lambda s: s > 1e-12, 0.0))


def dif(d): return ema(d.close, 12) - ema(d.close, 26)


want("macd_dif")(lambda d: dif(d) / d.close)
want("macd_dea")(lambda d: ema(dif(d), 9) / d.close)
want("macd_hist")(lambda d: (dif(d) - ema(dif(d), 9)) / d.close)
each("trix", (5, 10), lambda d, n: ema(ema(ema(r_(d), n), n), n))
want("tr")(tr1)
each("atr", (5, 10, 20), lambda d, n: mean(tr1(d), n))


def di(d, n=14):
    up, down = d.high.diff().fillna(0), -d.low.diff().fillna(0)
    a = mean(tr1(d), n)
    return over(100 * mean(up.where((up > down) & (up > 0), 0.0), n), a), over(100 * mean(down.where((down > up) & (down > 0), 0.0), n), a)


want("pdi")(lambda d: di(d)[0])
want("mdi")(lambda d: di(d)[1])


@want("adx14")
def _(d):
    p, m = di(d)
    out, y = [], 0.0
    for a, b in zip(p, m):
        y = (13 * y + 100 * abs(a - b) / (a + b)) / 14 if a + b > 0 else 0.0
        out.append(y)
    return pd.Series(out)


def plrc(d, n):
    x = np.arange(n) - math.floor(n / 2 + 0.5)
    s = d.close.rolling(n).apply(lambda w: np.dot(x, w - w.mean()) / np.dot(x, x), raw=True)
    return late(s / d.close.clip(lower=0.0001), n)


each("plrc", (5, 20), plrc)
each("hh", (5, 20), lambda d, n: top(d.close, n))
each("ll", (5, 20), lambda d, n: low(d.close, n))
each("price_chan", (5, 20), lambda d, n: over(d.close - low(d.close, n), top(d.close, n) - low(d.close, n), 0.5))
for _p in ("high_low", "range"):
    each(_p, (5, 20), lambda d, n: (top(d.high, n) - low(d.low, n)) / d.close)


def rsi(d, n):
    out, up, down = [0.0], 0.0, 0.0
    for i, c in enumerate(d.close.diff().iloc[1:], 1):
        keep = 1.0 if i < n else (n - 1) / n
        up, down = keep * up + max(c, 0) / n, keep * down + max(-c, 0) / n
        out.append(100.0 if down == 0 else 100 - 100 / (1 + up / down))
    return pd.Series(out)


each("rsi", (6, 12, 24), rsi)
each("wr", (10, 30), lambda d, n: over(-100 * (top(d.high, n) - d.close), top(d.high, n) - low(d.low, n), -50.0))
want("bb_upper")(lambda d: mean(d.close, 20) + 2 * sd(d.close, 20))
want("bb_lower")(lambda d: mean(d.close, 20) - 2 * sd(d.close, 20))
want("bb_width")(lambda d: 4 * sd(d.close, 20) / mean(d.close, 20))
each("bias", (5, 10, 20, 60), lambda d, n: d.close / mean(d.close, n) - 1)


def cci(d, n):
    t = tp_(d)
    m = t.rolling(n).apply(lambda w: np.abs(w - w.mean()).mean(), raw=True)
    return over(t - t.rolling(n).mean(), 0.015 * m.where(m > 1e-9, 0.0)).fillna(0.0)


each("cci", (5, 20), cci)


def kdj(d):
    hi, lo = top(d.high, 9), low(d.low, 9)
    rsv, k, e, ks, es = over(100 * (d.close - lo), hi - lo, 50.0), 50.0, 50.0, [50.0], [50.0]
    for x in rsv.iloc[1:]:
        k = (2 * k + x) / 3
        e = (2 * e + k) / 3
        ks.append(k)
        es.append(e)
    return pd.Series(ks), pd.Series(es)


want("kdj_j")(lambda d: 3 * kdj(d)[0] - 2 * kdj(d)[1])
want("kdj_d")(lambda d: kdj(d)[1])
want("ema_fast_slow")(lambda d: ema(d.close, 5) / ema(d.close, 20) - 1)
for _p, _ns in (("disparity", (5, 10)), ("close_sma_ratio", (5, 10, 20)), ("rs", (5, 10, 20, 60))):
    each(_p, _ns, lambda d, n: d.close / mean(d.close, n))
each("std", (5, 20, 60), lambda d, n: sd(d.close, n))
each("vol", (5, 20, 60), lambda d, n: sd(r_(d), n) * math.sqrt(n))
want("vol_ratio", "dvrat")(lambda d: over(sd(r_(d), 5), sd(r_(d), 20), 1.0))


def amplitude(d): return (d.high - d.low) / d.close.shift().fillna(d.close)


want("amplitude")(amplitude)
each("amplitude", (5, 20), lambda d, n: mean(amplitude(d), n))
each("davol", (5, 20), lambda d, n: mean(d.volume, n))
for _n in (5, 10, 20, 60):
    WANT[f"vol{_n}_ma{_n}"] = lambda d, n=_n: mean(d.volume, n)
want("upvol")(lambda d: over(total(d.volume.where(r_(d) > 0, 0.0), 20), total(d.volume, 20), 0.5))
want("dnvol")(lambda d: over(total(d.volume.where(r_(d) < 0, 0.0), 20), total(d.volume, 20), 0.5))
want("upside_vol")(lambda d: over(total(d.volume.where((d.close.diff() > 0) | (d.index == 0), 0.0), 20), total(d.volume, 20), 0.5))
want("downside_vol")(lambda d: over(total(d.volume.where(d.close.diff() < 0, 0.0), 20), total(d.volume, 20), 0.5))


def moment(k, less): return lambda d: late(r_(d).rolling(20).apply(lambda w: (((w - w.mean()) / w.std()) ** k).mean() - less if w.std() > 0 else 0.0, raw=True), 20)


want("vol_skew")(moment(3, 0))
want("vol_kurt")(moment(4, 3))
each("max_ret", (5, 20), lambda d, n: late(r_(d).rolling(n).max(), n))
each("min_ret", (5, 20), lambda d, n: late(r_(d).rolling(n).min(), n))
want("high_low_ratio")(lambda d: (d.high - d.low) / d.close)
each("ulcer", (5, 20), lambda d, n: late(np.sqrt(((100 * (d.close / top(d.close, n) - 1)) ** 2).rolling(n).mean()), n))
each("vstd", (5, 20), lambda d, n: sd(d.volume, n))
want("vosc")(lambda d: over(mean(d.volume, 5) - mean(d.volume, 20), mean(d.volume, 5)))
want("obv")(lambda d: (np.sign(d.close.diff().fillna(0)) * d.volume).cumsum())


def vwap_dev(d, n):
    m = over(total(tp_(d) * d.volume, n), total(d.volume, n), math.nan).fillna(d.close)
    return d.close / m - 1


want("vwap_dev")(lambda d: vwap_dev(d, 20))
each("vwp", (5, 20), vwap_dev)


def pv_corr(d, n):
    r, v = r_(d), d.volume
    ok = (r.rolling(n).std() > 1e-14) & (v.rolling(n).std() > 1e-9)
    return late(r.rolling(n).corr(v).where(ok), n)


each("pv_corr", (5, 20), pv_corr)
want("volume_ratio", "vol_ratio5", "vol_ratio20", "vol_break5")(lambda d: over(d.volume, mean(d.volume, 5), 1.0))
want("vol_break20")(lambda d: over(d.volume, mean(d.volume, 20), 1.0))
want("volume_trend")(lambda d: over(mean(d.volume, 5), mean(d.volume, 20), 1.0))


@want("mfi14")
def _(d):
    t = tp_(d)
    f = t * d.volume
    p, n = (f.where(c, 0.0).rolling(14, min_periods=1).sum() for c in (t.diff() > 0, t.diff() < 0))
    return late((100 - 100 / (1 + p / (p + n))).where(p + n > 0, 50.0), 14)


@want("eom", "eom20")
def _(d):
    move = ((d.high + d.low) / 2).diff().abs().clip(lower=0.0001)
    return ((d.high - d.low) / d.volume / move).where((d.volume > 0) & (d.index > 0), 0.0)


want("force_index")(lambda d: d.close.diff().fillna(0) * d.volume)


def ad(d): return (((2 * d.close - d.low - d.high) / (d.high - d.low)).where(d.high > d.low, 0.0) * d.volume).cumsum()


want("ad")(ad)
want("cmf20")(lambda d: over(total(ad(d), 20), total(d.volume, 20)))


def index(d, grows): return (1 + r_(d)).where(grows(d.volume.diff()), 1.0).cumprod() - 1


want("nvi")(lambda d: index(d, lambda v: v < 0))
want("pvi")(lambda d: index(d, lambda v: v > 0))
want("vpt")(lambda d: (r_(d).clip(-1, 1) * d.volume / d.volume.cumsum().clip(lower=1)).cumsum())
each("tvma", (5, 20), lambda d, n: over(d.turnover, mean(d.turnover, n), 1.0) - 1)
each("ret", (1, 5, 10, 20, 60), r_)
each("ret_ma", (5, 20), r_)
each("sr", (5, 20, 60), lambda d, n: over(mean(r_(d), n), sd(r_(d), n).where(lambda s: s > 1e-14, 0.0)))
each("high_dist", (5, 10, 20), lambda d, n: 1 - d.close / top(d.close, n))
each("low_dist", (5, 10, 20), lambda d, n: d.close / low(d.close, n) - 1)
each("mom_div", (5, 20), lambda d, n: r_(d, n) / r_(d, 4 * n).abs().clip(lower=0.0001))
each("roc", (5, 10, 20), r_)
want("ltm_ratio")(lambda d: (r_(d, 60) / r_(d, 20)).where(r_(d, 20).abs() > 0.0001, 1.0))
each("pct_rank", (5, 20), lambda d, n: d.close.rolling(n, min_periods=1).apply(lambda w: (w < w[-1]).mean(), raw=True))
each("turn", (5, 10, 20), lambda d, n: over(d.turnover, mean(d.turnover, n), 1.0))
each("turn_std", (5, 20), lambda d, n: sd(d.turnover, n))


def illiq(d): return over(r_(d).abs(), d.amount) * 1e8


each("amihud", (5, 20), lambda d, n: mean(illiq(d), n))
each("illiq_std", (5, 20), lambda d, n: sd(illiq(d), n))
each("dollar_vol", (5, 20), lambda d, n: np.log(mean(d.amount, n)))
each("spread", (5, 20), lambda d, n: mean(2 * (d.high - d.low) / (d.high + d.low), n))
each("vol_conc", (5, 20), lambda d, n: over(top(d.volume, n), total(d.volume, n)))
each("liq_ratio", (5, 20), lambda d, n: over(total(r_(d).abs(), n), total(d.amount, n)) * 1e9)
each("price_impact", (5, 20), lambda d, n: mean(over(r_(d).abs(), d.volume), n) * 1e6)
want("float_proxy")(lambda d: over(d.amount, d.turnover) / 10000)
