"""What every indicator should give, in plain pandas and NumPy, from SURVEY's definitions; nothing here uses a plan.

Each function takes a frame of one symbol's bars and the parameters, and returns a series or a dict of them.
"""

import math

import numpy as np
import pandas as pd

WANT = {}


def want(fn):
    WANT[fn.__name__.rstrip("_")] = fn
    return fn


def ema(s, n, seed="sma"):
    return smooth(s, 2 / (n + 1), n, seed)


def rma(s, n, seed="sma"):
    return smooth(s, 1 / n, n, seed)


def smooth(s, alpha, n, seed):
    s = s.astype(float).copy()
    if seed == "sma":
        at = np.flatnonzero(s.notna().to_numpy())
        if len(at) < n:
            return s * np.nan
        mean = s.iloc[at[:n]].mean()
        s.iloc[: at[n - 1]] = np.nan
        s.iloc[at[n - 1]] = mean
    return s.ewm(alpha=alpha, adjust=False, ignore_na=True).mean()


def tr(d, first=None):
    c1 = d.close.shift()
    t = pd.concat([d.high - d.low, (d.high - c1).abs(), (d.low - c1).abs()], axis=1).max(axis=1)
    return t if first is None else t.where(c1.notna(), first)


def atr_(d, n): return rma(tr(d), n)
def tp_(d): return (d.high + d.low + d.close) / 3
def mid_(d): return (d.high + d.low) / 2
def hh(d, n): return d.high.rolling(n).max()
def ll(d, n): return d.low.rolling(n).min()
def sd(s, n): return s.rolling(n).std(ddof=0)
def dead(s, x): return s.mask(x == 0)
def line(s, n): return s.rolling(n).apply(lambda w: np.polyfit(np.arange(n), w, 1)[0], raw=True)
def end(s, n): return s.rolling(n).apply(lambda w: np.polyval(np.polyfit(np.arange(n), w, 1), n - 1), raw=True)
def weighted(s, w): return s.rolling(len(w)).apply(lambda x: np.dot(x, w) / np.sum(w), raw=True)
def wma_(s, n): return weighted(s, np.arange(1, n + 1))
def rsv(d, n): return (100 * (d.close - ll(d, n)) / (hh(d, n) - ll(d, n))).mask(hh(d, n) == ll(d, n), 50.0)
def from_bar(s, n): return s.where(np.arange(len(s)) >= n - 1)


def rsi_(s, n, first=1):
    c = s.diff()
    up, down = rma(c.clip(lower=0), n), rma((-c).clip(lower=0), n)
    return from_bar((100 - 100 / (1 + (up / down).mask(down == 0, 100.0))), first + n + 1)


def mfv(d): return ((d.close - d.low - (d.high - d.close)) / (d.high - d.low)).where(d.high > d.low, 0.0) * d.volume


@want
def sma(d, period=20): return d.close.rolling(period).mean()
@want
def ema_i(d, period=20): return ema(d.close, period)
WANT["ema"] = WANT.pop("ema_i")
@want
def wma(d, period=20): return wma_(d.close, period)
@want
def rma_i(d, period=14): return rma(d.close, period, "first")
WANT["rma"] = WANT.pop("rma_i")
@want
def linreg(d, period=20): return end(d.close, period)
@want
def lsma(d, period=25): return end(d.close, period)
@want
def hl2(d): return mid_(d)
@want
def hlc3(d): return tp_(d)
@want
def ohlc4(d): return (d.open + d.high + d.low + d.close) / 4
@want
def wcp(d): return (d.high + d.low + 2 * d.close) / 4
@want
def midpoint(d, period=10): return (d.close.rolling(period).max() + d.close.rolling(period).min()) / 2
@want
def midprice(d, period=10): return (hh(d, period) + ll(d, period)) / 2
@want
def qstick(d, period=14): return (d.close - d.open).rolling(period).mean()


@want
def dema(d, period=20):
    e = ema(d.close, period, "first")
    return 2 * e - ema(e, period, "first")


@want
def tema(d, period=20):
    e = ema(d.close, period, "first")
    f = ema(e, period, "first")
    return 3 * e - 3 * f + ema(f, period, "first")


@want
def trima(d, period=20): return weighted(d.close, np.minimum(np.arange(1, period + 1), np.arange(period, 0, -1)))


@want
def hilo(d, period=20):
    m = d.close.rolling(period).mean()
    h, low = d.high.where(d.high > m, m).where(m.notna()), d.low.where(d.low < m, m).where(m.notna())
    return {"high": h, "low": low, "mid": (h + low) / 2}


@want
def supertrend(d, period=10, multiplier=3):
    a, out, up, state = atr_(d, period), [], None, None
    for i in range(len(d)):
        if not a.iloc[i] == a.iloc[i]:
            out.append(math.nan)
            continue
        m = (d.high.iloc[i] + d.low.iloc[i]) / 2
        top, bottom = m + multiplier * a.iloc[i], m - multiplier * a.iloc[i]
        c = d.close.iloc[i]
        if state is None:
            up = c > m
        else:
            last = d.close.iloc[i - 1]
            top = top if top < state[0] or last > state[0] else state[0]
            bottom = bottom if bottom > state[1] or last < state[1] else state[1]
            up = not c < bottom if up else c > top
        state = top, bottom
        out.append(bottom if up else top)
    return pd.Series(out)


@want
def macd(d, fast=12, slow=26, signal=9):
    dif = ema(d.close, fast) - ema(d.close, slow)
    dea = ema(dif, signal).shift(signal - 1)
    return {"dif": dif, "dea": dea, "hist": 2 * (dif - dea)}


@want
def adx(d, period=14):
    up, down = d.high.diff(), -d.low.diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    p, m = (100 * rma(x, period) / atr_(d, period) for x in (plus, minus))
    dx = (100 * (p - m).abs() / (p + m)).where(p + m > 0)
    return {"": rma(dx, period).where(dx.notna()), "pdi": p, "mdi": m}


@want
def psar(d, af_step=0.02, af_max=0.2):
    out, af, top, stop = [math.nan], af_step, d.high[0], d.low[0]
    for i in range(1, len(d)):
        out.append(stop)
        if d.high[i] > top:
            top, af = d.high[i], min(af + af_step, af_max)
        stop = min(stop + af * (top - stop), d.low[i - 1], d.low[i])
    return pd.Series(out)


@want
def aroon(d, period=14):
    return {"up": d.high.rolling(period).apply(lambda w: 100 * np.argmax(w) / (period - 1), raw=True), "down": d.low.rolling(period).apply(lambda w: 100 * np.argmin(w) / (period - 1), raw=True)}


@want
def dpo(d, period=20): return (d.close - d.close.rolling(period).mean()).shift(period // 2 + 1)


@want
def vortex(d, period=14):
    t = tr(d).where(d.close.shift().notna())
    s = lambda x: from_bar(x.rolling(period - 1).sum(), period + 1)
    return {"plus": s((d.high - d.low.shift()).abs()) / s(t), "minus": s((d.low - d.high.shift()).abs()) / s(t)}


def run(flags, n): return flags.astype(float).where(flags.index > 0).rolling(n).min()


@want
def increasing(d, period=3): return run(d.close.diff() > 0, period - 1)
@want
def decreasing(d, period=3): return run(d.close.diff() < 0, period - 1)


@want
def chop(d, period=14):
    t, r = tr(d, 0.0).rolling(period).sum(), hh(d, period) - ll(d, period)
    return (100 * np.log10(t / r) / math.log10(period)).clip(0, 100).where((t != 0) & (r != 0))


@want
def rsi(d, period=14): return rsi_(d.close, period)


@want
def kdj(d, n=9, m1=3, m2=3):
    k = rma(rsv(d, n), m1, "first")
    e = rma(k, m2, "first")
    return {"k": k, "d": e, "j": 3 * k - 2 * e}


@want
def stoch(d, k_period=14, k_slow=3, d_period=3):
    k = rma(rsv(d, k_period), k_slow, "first")
    return {"k": k, "d": rma(k, d_period, "first")}


def mad_(s, n): return s.rolling(n).apply(lambda w: np.abs(w - w.mean()).mean(), raw=True)


@want
def cci(d, period=20):
    t = tp_(d)
    return ((t - t.rolling(period).mean()) / (0.015 * mad_(t, period))).where(mad_(t, period) > 0)


@want
def williams_r(d, period=14): return (-100 * (hh(d, period) - d.close) / (hh(d, period) - ll(d, period))).mask(hh(d, period) == ll(d, period), -50.0)
@want
def roc(d, period=12): return 100 * (d.close / d.close.shift(period) - 1)
@want
def mom(d, period=12): return d.close.diff(period)


@want
def mfi(d, period=14):
    t = tp_(d)
    f = t * d.volume
    p, n = (f.where(c, 0.0).where(t.shift().notna()).rolling(period).sum() for c in (t.diff() > 0, ~(t.diff() > 0)))
    return (100 - 100 / (1 + p / n)).mask(n == 0, 100.0)


@want
def fisher(d, period=10):
    m = mid_(d)
    lo, r = m.rolling(period).min(), m.rolling(period).max() - m.rolling(period).min()
    x = (1.32 * ((m - lo) / r - 0.5)).where(r > 0)
    out, v, f = [], 0.0, 0.0
    for i, y in enumerate(x):
        if i < period or y != y:
            out.append(math.nan)
            continue
        v = 0.66 * y + 0.34 * v
        f = math.atanh(min(0.999, max(-0.999, v))) + 0.5 * f
        out.append(f)
    return pd.Series(out)


@want
def apo(d, fast=12, slow=26): return ema(d.close, fast, "first") - ema(d.close, slow, "first")
@want
def ppo(d, fast=12, slow=26): return 100 * (ema(d.close, fast, "first") / ema(d.close, slow, "first") - 1)
@want
def bias(d, period=6): return 100 * (d.close / d.close.rolling(period).mean() - 1)
@want
def psl(d, period=12): return 100 * (d.close.diff() > 0).astype(float).rolling(period).mean()
@want
def bop(d): return dead((d.close - d.open) / (d.high - d.low), d.high - d.low)
@want
def slope(d, period=20): return line(d.close, period)


@want
def inertia(d, period=14):
    g = (d.close - d.open).rolling(period).sum() / (d.high - d.low).rolling(period).sum()
    return ema(g.rolling(4).mean(), period, "first")


@want
def er(d, period=10):
    path = d.close.diff().abs().rolling(period).sum()
    return dead(d.close.diff(period).abs() / path, path)


@want
def brar(d, period=26):
    s = lambda x: x.rolling(period, min_periods=1).sum()
    c1 = d.close.shift()
    a, b, e, f = s((d.high - c1).clip(lower=0)), s((c1 - d.low).clip(lower=0)), s((d.high - d.open).clip(lower=0)), s((d.open - d.low).clip(lower=0))
    return {"br": dead(100 * a / b, b), "ar": dead(100 * e / f, f)}


@want
def bb(d, period=20, stddev=2):
    m, s = d.close.rolling(period).mean(), sd(d.close, period)
    return {"mid": m, "upper": m + stddev * s, "lower": m - stddev * s}


@want
def atr(d, period=14): return atr_(d, period)


@want
def kc(d, period=20, atr_period=10, multiplier=2):
    m, a = ema(d.close, period), atr_(d, atr_period)
    return {"mid": m, "upper": m + multiplier * a, "lower": m - multiplier * a}


@want
def dc(d, period=20): return {"upper": hh(d, period), "lower": ll(d, period), "mid": (hh(d, period) + ll(d, period)) / 2}
@want
def natr(d, period=14): return 100 * rma(tr(d), period, "first") / d.close
@want
def true_range(d): return tr(d)


@want
def massi(d, period=25):
    e = ema(d.high - d.low, 9, "first")
    f = ema(e, 9, "first")
    return from_bar((e / f).where(f != 0).rolling(period, min_periods=1).sum(), period + 1)


@want
def rvi(d, period=14):
    def one(w):
        a = w - w.mean()
        up, down = a[a > 0], a[a < 0]
        size = lambda x: math.sqrt((x**2).mean()) if len(x) else 0.0
        return size(up) / size(down) if size(down) else math.nan

    return d.close.diff().rolling(period).apply(one, raw=True)


@want
def thermo(d, period=20): return ema(d.high - d.low, period, "first") / ema(tr(d), period, "first")
@want
def ui(d, period=14): return d.close.rolling(period).apply(lambda w: math.sqrt(((100 * (w.max() - w) / w.max()) ** 2).mean()), raw=True)
@want
def vwap(d): return dead((tp_(d) * d.volume).cumsum() / d.volume.cumsum(), d.volume.cumsum())
@want
def vwma(d, period=20): return dead((d.close * d.volume).rolling(period).sum() / d.volume.rolling(period).sum(), d.volume.rolling(period).sum())
@want
def obv(d): return (np.sign(d.close.diff()).fillna(1) * d.volume).cumsum()
@want
def ad(d): return mfv(d).cumsum()
@want
def cmf(d, period=20): return dead(mfv(d).rolling(period).sum() / d.volume.rolling(period).sum(), d.volume.rolling(period).sum())
@want
def adosc(d, fast=3, slow=10): return ema(mfv(d).cumsum(), fast, "first") - ema(mfv(d).cumsum(), slow, "first")


@want
def eom(d, period=14):
    box = (d.volume / 1e8) / ((d.high - d.low) / d.high).where(d.high > d.low)
    return (mid_(d).diff() / box.where(box != 0)).rolling(period, min_periods=1).mean()


@want
def pvt(d): return (d.volume * d.close.pct_change()).fillna(0).cumsum()
@want
def pvol(d): return d.close * d.volume
@want
def stdev(d, period=20): return sd(d.close, period)
@want
def variance(d, period=20): return sd(d.close, period) ** 2
@want
def zscore(d, period=20): return (d.close - d.close.rolling(period).mean()) / sd(d.close, period)
@want
def mad(d, period=20): return mad_(d.close, period)
@want
def median(d, period=20): return d.close.rolling(period).median()
@want
def percent_return(d, period=1): return 100 * d.close.pct_change(period)
@want
def trend_return(d, period=20): return 100 * (d.close / d.close.rolling(period).mean() - 1)
@want
def correlation(d, period=20, col=0): return d.close.rolling(period).corr(d[f"close_{col}"] if col else d.close)


@want
def ebsw(d, period=40):
    e = ema(ema(d.close, period, "first"), period, "first")
    return 0.0962 * e + 0.5769 * e.shift(1) - 0.5769 * e.shift(2) - 0.0962 * e.shift(2)


@want
def seasonal(d, mode=0):
    slot = np.arange(len(d)) % (5 if mode == 0 else 21)
    return (100 * d.close.pct_change()).groupby(slot).transform("mean")


@want
def fib_retracement(d, period=100):
    last = d.iloc[-period:]
    hi, lo = last.high.max(), last.low.min()
    there = pd.Series(np.arange(len(d)) >= len(d) - period)
    return {f"{round(1000 * q)}": pd.Series(hi - (hi - lo) * q, d.index).where(there) for q in (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0, 1.272, 1.618)}


@want
def sr_detect(d, period=20, threshold=3):
    n = 2 * period + 1
    around = lambda s, f: getattr(s.rolling(n, center=True), f)()
    return {"resistance": d.high.where(d.high == around(d.high, "max")), "support": d.low.where(d.low == around(d.low, "min")), "spike": mid_(d).where(d.volume > threshold * around(d.volume, "mean"))}


def candles(d):
    o, h, low, c = d.open, d.high, d.low, d.close
    body, rng, us, ls = (c - o).abs(), h - low, h - np.maximum(o, c), np.minimum(o, c) - low
    bull = c > o
    o1, c1, o2, c2, b1, u1, u2 = o.shift(), c.shift(), o.shift(2), c.shift(2), body.shift(), bull.shift(fill_value=False), bull.shift(2, fill_value=False)
    one, two = pd.Series(np.arange(len(d)) >= 1), pd.Series(np.arange(len(d)) >= 2)
    sign = lambda cond, up: np.where(cond, np.where(up, 1.0, -1.0), 0.0)
    long_low, long_up = (body > 0) & (ls > 2 * body) & (us < 0.3 * body), (body > 0) & (us > 2 * body) & (ls < 0.3 * body)
    small1 = (c1 - o1).abs() / o1 * 100 < 1.5
    return {
        "doji": sign((rng > 0) & (body / rng < 0.1), True), "hammer": sign(long_low & (c1 > c), True), "inverted_hammer": sign(long_up & (c1 > c), True),
        "hanging_man": sign(long_low & (c1 < c), False), "shooting_star": sign(long_up & (c1 < c), False),
        "engulfing": sign(one & (bull != u1) & (body > b1), bull), "harami": sign(one & (bull != u1) & (body < 0.7 * b1), bull),
        "piercing": sign(one & ~u1 & bull & (o < low.shift()) & (c > (o1 + c1) / 2) & (c < o1), True),
        "dark_cloud_cover": sign(one & u1 & ~bull & (o > h.shift()) & (c < (o1 + c1) / 2) & (c > o1), False),
        "morning_star": sign(two & (c2 < o2) & small1 & bull & (c > (o2 + c2) / 2), True), "evening_star": sign(two & (c2 > o2) & small1 & ~bull & (c < (o2 + c2) / 2), False),
        "three_white_soldiers": sign(two & bull & u1 & u2 & (c > c1) & (c1 > c2), True), "three_black_crows": sign(two & ~bull & ~u1 & ~u2 & (c < c1) & (c1 < c2), False),
        "marubozu": sign((body > 0) & (us < 0.05 * body) & (ls < 0.05 * body), bull), "inside": sign((h < h.shift()) & (low > low.shift()), True),
    }


for _k in ("doji", "hammer", "inverted_hammer", "hanging_man", "shooting_star", "engulfing", "harami", "piercing", "dark_cloud_cover", "morning_star", "evening_star", "three_white_soldiers", "three_black_crows", "marubozu", "inside"):
    WANT[f"cdl_{_k}"] = lambda d, k=_k: pd.Series(candles(d)[k])


def adaptive(d, period, share):
    out, y = [math.nan] * (period - 1), d.close.iloc[:period].mean()
    out.append(y)
    for i in range(period, len(d)):
        y += share(i) * (d.close.iloc[i] - y)
        out.append(y)
    return pd.Series(out)


@want
def kama(d, period=10, fast=2, slow=30):
    e, f, s = er(d, period).fillna(0), 2 / (fast + 1), 2 / (slow + 1)
    return adaptive(d, period, lambda i: (e.iloc[i] * (f - s) + s) ** 2)


@want
def hma(d, period=20): return wma_(2 * wma_(d.close, period // 2) - wma_(d.close, period), int(math.sqrt(period)))


@want
def t3(d, period=10, v=0.7):
    e = [d.close]
    for _ in range(6):
        e.append(ema(e[-1], period, "first"))
    whole = np.poly1d([1 + v, -v]) ** 3  # of (1 + v) e - v e(e), three times over
    return sum(c * e[3 + k] for k, c in enumerate(whole.coeffs))


@want
def vidya(d, period=9):
    c = d.close.diff()
    up, down = c.clip(lower=0).rolling(period).sum(), (-c).clip(lower=0).rolling(period).sum()
    a = ((up - down).abs() / (up + down)).fillna(0)
    return adaptive(d, period, lambda i: a.iloc[i])


@want
def alma(d, period=9, offset=0.85, sigma=6):
    k = np.arange(period)
    return weighted(d.close, np.exp(-((k - offset * (period - 1)) ** 2) / (2 * (period / sigma) ** 2)))


@want
def frama(d, period=16):
    half = period // 2

    def share(i):
        w = d.close.iloc[i - period + 1 : i + 1].to_numpy()
        a, b, c = np.ptp(w[-half:]) / half, np.ptp(w[: period - half]) / half, np.ptp(w) / period
        dim = math.log2((a + b) / c) if a + b > 0 and c > 0 else 1.0
        return min(1.0, max(0.01, math.exp(-4.6 * (dim - 1))))

    return adaptive(d, period, share)


@want
def chandelier_exit(d, period=22, atr_period=22, multiplier=3): return {"long": hh(d, period) - multiplier * atr_(d, atr_period), "short": ll(d, period) + multiplier * atr_(d, atr_period)}


@want
def jma(d, period=14, phase=0):
    beta = 0.45 * (period - 1) / (0.45 * (period - 1) + 2)
    a, y = beta**period * (0.5 + phase / 200), list(d.close.iloc[:2])
    for c in d.close.iloc[2:]:
        y.append(y[-1] + a * (c - y[-1]) + (1 - a) * (y[-1] - y[-2]))
    return pd.Series(y)


@want
def gmma(d): return {f"{n}": ema(d.close, n, "first") for n in (3, 5, 8, 10, 12, 15, 30, 35, 40, 45, 50, 60)}
@want
def rainbow_ma(d): return {f"{n}": ema(d.close, n) for n in range(2, 21, 2)}


@want
def ichimoku(d, tenkan=9, kijun=26, senkou_b=52):
    m = lambda n: (hh(d, n) + ll(d, n)) / 2
    return {"tenkan": m(tenkan), "kijun": m(kijun), "senkou_a": ((m(tenkan) + m(kijun)) / 2).shift(kijun), "senkou_b": m(senkou_b).shift(kijun), "chikou": d.close.shift(kijun)}


@want
def alligator(d): return {k: rma(mid_(d), n).shift(s) for k, n, s in (("jaw", 13, 8), ("teeth", 8, 5), ("lips", 5, 3))}


@want
def fractals(d, period=2):
    def peak(s):
        others = [s.shift(k) for k in range(-period, period + 1) if k]
        return s.where(np.logical_and.reduce([s > o for o in others]))

    return {"up": peak(d.high), "down": -peak(-d.low)}


@want
def ao(d): return from_bar(mid_(d).rolling(5).mean() - mid_(d).rolling(34).mean(), 35)
@want
def ac(d): return from_bar(ao(d) - ao(d).rolling(5).mean(), 40)


@want
def threshold_bands(d, period=20, multiplier=2):
    m, s = d.close.rolling(period).mean(), np.sqrt(((d.high - d.low) ** 2).rolling(period).mean())
    return {"mid": m, "upper": m + multiplier * s, "lower": m - multiplier * s}


@want
def regression_channel(d, period=20, deviation=2):
    def error(w):
        x = np.arange(period)
        return math.sqrt(((w - np.polyval(np.polyfit(x, w, 1), x)) ** 2).sum() / (period - 2))

    m, s = end(d.close, period), d.close.rolling(period).apply(error, raw=True)
    return {"mid": m, "upper": m + deviation * s, "lower": m - deviation * s}


@want
def pivots(d, period=1):
    h, low, c = hh(d, period).shift(), ll(d, period).shift(), d.close.shift()
    p = (h + low + c) / 3
    return {"p": p, "r1": 2 * p - low, "s1": 2 * p - h, "r2": p + h - low, "s2": p - h + low, "r3": h + 2 * (p - low), "s3": low - 2 * (h - p)}


@want
def decision_point(d):
    s = sd(d.close, 20)
    band = ((d.close - d.close.rolling(20).mean()) / (2 * s)).where(4 * s > 1e-9).clip(-1, 1).fillna(0)
    return 100 * (((rsi_(d.close, 14) - 50) / 50).clip(-1, 1).fillna(0) + band) / 3


@want
def tsi(d, long=25, short=13, signal=7):
    twice = lambda s: ema(ema(s, long, "first"), short, "first")
    t = 100 * twice(d.close.diff()) / twice(d.close.diff().abs())
    return {"": t, "signal": ema(t, signal, "first")}


@want
def smi(d, k_period=5, k_smooth=3, d_period=3, signal=5):
    twice = lambda s: ema(ema(s, k_smooth, "first"), d_period, "first")
    h, low = hh(d, k_period), ll(d, k_period)
    s = 100 * twice(d.close - (h + low) / 2) / twice(h - low)
    return {"": s, "signal": ema(s, signal, "first")}


@want
def stoch_rsi(d, period=14, k=3, d_=3):
    r = rsi_(d.close, period)
    hi, lo = (getattr(r.rolling(period, min_periods=1), f)() for f in ("max", "min"))
    s = (100 * (r - lo) / (hi - lo)).mask(hi == lo, 50.0).where(r.notna())
    return {"k": s.rolling(k).mean(), "d": s.rolling(k).mean().rolling(d_).mean()}


@want
def trix(d, period=15, signal=9):
    e = d.close
    for _ in range(3):
        e = ema(e, period, "first")
    return {"": 100 * e.pct_change(), "signal": ema(100 * e.pct_change(), signal, "first")}


@want
def elder_ray(d, period=13):
    e = ema(d.close, period, "first")
    return {"bull": d.high - e, "bear": d.low - e}


@want
def ultimate_osc(d, short=7, mid=14, long=28):
    c1 = d.close.shift().fillna(d.close)
    low, high = np.minimum(d.low, c1), np.maximum(d.high, c1)
    a = [(d.close - low).rolling(n).sum() / (high - low).rolling(n).sum() for n in (short, mid, long)]
    return 100 * (4 * a[0] + 2 * a[1] + a[2]) / 7


@want
def rmi(d, period=14, momentum_period=5): return rsi_(d.close.diff(momentum_period), period, momentum_period + 1).shift()


@want
def ergotic(d, period=20, signal=5):
    e = ema(rsv(d, period), signal, "first")
    return {"": e, "signal": e.rolling(signal).mean()}


def yearly(v): return np.sqrt(v.clip(lower=0)) * math.sqrt(252) * 100


@want
def hist_vol(d, period=21): return yearly(np.log(d.close).diff().rolling(period).var())
@want
def gk_vol(d, period=21): return yearly((0.5 * np.log(d.high / d.low) ** 2 - 0.386 * np.log(d.close / d.open) ** 2).clip(lower=0).rolling(period).mean())
@want
def parkinson_vol(d, period=21): return yearly((np.log(d.high / d.low) ** 2 / (4 * math.log(2))).rolling(period).mean())


def rs_day(d): return (np.log(d.high / d.close) * np.log(d.high / d.open) + np.log(d.low / d.close) * np.log(d.low / d.open)).clip(lower=0)


@want
def rs_vol(d, period=21): return yearly(rs_day(d).rolling(period).mean())


@want
def yz_vol(d, period=21):
    k = 0.34 / (1.34 + (period + 1) / (period - 1))
    return yearly(np.log(d.open).diff().rolling(period).var() + k * np.log(d.close).diff().rolling(period).var() + (1 - k) * rs_day(d).rolling(period).mean())


@want
def hurst(d, period=100):
    def one(w):
        x, y, size = [], [], period // 2
        while size >= 8 and len(x) < 6:
            parts = [w[i * size : (i + 1) * size] for i in range(period // size)]
            rs = [np.ptp(np.cumsum(p - p.mean())) / p.std() for p in parts if p.std() > 0]
            if rs:
                x.append(math.log(size))
                y.append(math.log(np.mean(rs)))
            size //= 2
        return min(1.0, max(0.0, np.polyfit(x, y, 1)[0])) if len(x) > 1 else math.nan

    return d.close.rolling(period).apply(one, raw=True)


@want
def kvo(d, fast=34, slow=55, signal=13):
    f = np.sign((d.close + d.high + d.low).diff()) * d.volume
    k = ema(f, fast) - ema(f, slow)
    return {"": k, "signal": ema(k, signal)}


@want
def vfi(d, period=130, coef=0.2, vcoef=2.5):
    c, flow = d.close.diff(), tp_(d).diff() * d.volume
    s = sd(c, period)
    cut = (coef * np.sqrt(c.abs()) / s * d.close).mask(s == 0, 0.0)
    kept = flow.where(flow.abs() > cut, 0.0).where(s.notna())
    return ema(kept, period) / ema(d.volume, period) * vcoef


@want
def force_index(d, period=13): return {"": ema(d.close.diff() * d.volume, period), "raw": d.close.diff() * d.volume}
@want
def mfi2(d): return pd.Series(np.where(d.high > d.low, (d.high - d.low) / np.where(d.volume > 0, d.volume, 1.0) * 1e6, 0.0))
@want
def volume_osc(d, fast=5, slow=10): return 100 * (d.volume.rolling(fast).mean() / d.volume.rolling(slow).mean() - 1)
@want
def emv_v2(d, period=14): return (mid_(d).diff() * 1e6 / (d.volume / (d.high - d.low).where(d.high > d.low, 0.001)).where(d.volume > 0)).rolling(period).mean()
@want
def volume_regime(d, period=20): return (d.volume - d.volume.rolling(period).mean()) / sd(d.volume, period)


def phases(c, period):
    s = (4 * c + 3 * c.shift() + 2 * c.shift(2) + c.shift(3)) / 10
    x = s - s.shift(period)
    return x.shift(3), 0.5 * (0.0962 * x + 0.5769 * x.shift(2) - 0.5769 * x.shift(4) - 0.0962 * x.shift(6))


def half_turn(a): return math.remainder(a, 2 * math.pi)


@want
def hilbert_sine(d, period=7):
    i_, q = phases(d.close, period)
    p = np.arctan2(q, i_).to_numpy()
    sine, lead, cycle, at = [], [], None, 0.0
    for k in range(len(p)):
        turn = half_turn(p[k] - p[k - 1]) if k and p[k] == p[k] and p[k - 1] == p[k - 1] else 0.0
        if turn:
            one = 2 * math.pi / turn
            cycle = float(np.clip(one if cycle is None else one * 2 / (period + 1) + cycle * (1 - 2 / (period + 1)), 6, 50))
            at += 2 * math.pi / cycle
            sine.append(math.sin(at))
            lead.append(math.sin(at + math.pi / 4))
        else:
            cycle = None
            sine.append(math.nan)
            lead.append(math.nan)
    return {"": pd.Series(sine), "lead": pd.Series(lead)}


@want
def mesa_sine(d, period=14):
    n, c = len(d), d.close.to_numpy()
    a = 2 / (period + 1)
    beta = 2 * math.cos(2 * math.pi / (0.5 * max(period, 6)))
    hp = [0.0]
    for i in range(1, n):
        hp.append((1 + a) / 2 * (c[i] - c[i - 1]) + a * hp[-1])
    re, im = [math.nan] * n, [math.nan] * n
    for out, first, back in ((re, 2, 0), (im, 4, 1)):
        for i in range(first, n):
            x = (1 - a) / 2 * (hp[i - back] - hp[i - back - 2])
            old = out[i - 1], out[i - 2]
            out[i] = x + beta * (1 + a) * old[0] - a * old[1] if all(map(math.isfinite, old)) else x
    sine, cosine, at, cycle = [math.nan] * n, [math.nan] * n, 0.0, period
    for i in range(period + 2, n):
        x, y = np.array(re[i - period + 1 : i + 1]), np.array(im[i - period + 1 : i + 1])
        ok = np.isfinite(x) & np.isfinite(y)
        x, y = x[ok], y[ok]
        q = (period * (x**2).sum() - x.sum() ** 2) * (period * (y**2).sum() - y.sum() ** 2)
        if q > 1e-24:
            r = (period * (x * y).sum() - x.sum() * y.sum()) / math.sqrt(q)
            if r == r:
                cycle = float(np.clip(2 * math.pi / math.acos(np.clip(r, -0.999, 0.999)), 6, 100))
        if math.isfinite(re[i]) and math.isfinite(im[i]):
            at += 2 * math.pi / cycle
            sine[i], cosine[i] = math.sin(at), math.cos(at)
    return {"": pd.Series(sine), "cosine": pd.Series(cosine)}


@want
def cg(d, period=10):
    g = d.close.rolling(period).apply(lambda w: -np.dot(np.arange(period)[::-1], w) / w.sum(), raw=True)
    return {"": g, "signal": g.rolling(max(period // 2, 2)).mean()}


@want
def phasor(d, period=14):
    i_, q = phases(d.close, period)
    raw, out, last = np.arctan2(q, i_), [], None
    for v in raw:
        if v != v:
            last = None
        elif last is None:
            last = v
        else:
            step = v - last
            step += 2 * math.pi if step < -math.pi else -2 * math.pi if step > math.pi else 0
            last += step
        out.append(math.nan if last is None else last)
    return {"phase": pd.Series(out), "magnitude": np.sqrt(i_**2 + q**2)}
