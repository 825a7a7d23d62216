"""Signal generators: 1 buy, -1 sell, 0 hold, on every bar.

Strategies without memory of a position are staged plans; those with one run as a kernel over plan columns.  The private
variants of RSI, ATR and KDJ here differ from the indicators' (first value at bar n, 100 without losses, K and D from 50).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..plans.staged import Plan
from .indicators import change, true_range


@dataclass(frozen=True)
class Strategy:
    name: str
    tier: str
    params: dict[str, float]
    fn: Callable[..., str]


REGISTRY: dict[str, Strategy] = {}


def strategy(tier: str = "free", **params: float):
    def add(fn):
        REGISTRY[fn.__name__] = Strategy(fn.__name__, tier, params, fn)
        return fn

    return add


def plan(name: str, **params: float) -> Plan:
    p = Plan()
    p.out(close="close", signal=formula(p, name, **params))
    return p


def formula(p: Plan, name: str, **params: float) -> str:
    """The signal column; an unknown name holds throughout."""
    if name not in REGISTRY:
        return p.c("0")
    spec = REGISTRY[name]
    values = {k: int(v) if float(v).is_integer() else v for k, v in (spec.params | params).items() if k in spec.params}
    return p.c(f"coalesce({p.c(spec.fn(p, **values))}, 0)")


def signals(bars: DataFrame, name: str, keep: bool = False, **params: float) -> DataFrame:
    p = Plan()
    p.out(signal=formula(p, name, **params))
    return p.spark(bars, keep=keep)


# --- pieces

def cross_up(p, x, y): return f"({p.lag(x)} <= {p.lag(y)} AND {x} > {y})"  # noqa: E704
def cross_down(p, x, y): return f"({p.lag(x)} >= {p.lag(y)} AND {x} < {y})"  # noqa: E704
def when(buy, sell): return f"CASE WHEN {buy} THEN 1 WHEN {sell} THEN -1 ELSE 0 END"  # noqa: E704


def rsi(p, n):
    d = change(p)
    up, down = p.rma(f"greatest({d}, CASE WHEN {d} IS NOT NULL THEN 0.0 END)", n), p.rma(f"CASE WHEN {d} IS NOT NULL THEN greatest(-{d}, 0.0) END", n)
    return p.c(f"CASE WHEN {down} = 0 THEN 100.0 ELSE 100 - 100 / (1 + {up} / nullif({down}, 0)) END")


def atr(p, n): return p.rma(f"CASE WHEN rn > 1 THEN {true_range(p)} END", n)  # noqa: E704


def kdj(p, n, m1, m2):
    hi, lo = p.max("high", n), p.min("low", n)
    rsv = p.c(f"CASE WHEN abs({hi} - {lo}) < 1e-10 THEN 50.0 ELSE 100 * (close - {lo}) / nullif({hi} - {lo}, 0) END")
    k = p.recur(rsv, f"{1 / m1!r}", f"{1 - 1 / m1!r}", 50.0)
    return k, p.recur(k, f"{1 / m2!r}", f"{1 - 1 / m2!r}", 50.0)


def held(p: Plan, first: int, enter: str, leave: str, most: int = 0, stop: str = "NULL") -> str:
    """From bar ``first`` on: buy when flat and ``enter``; sell when in and ``leave``, or after ``most`` bars, or below the
    entry less ``stop``."""
    flag = lambda x: p.c(f"CASE WHEN rn >= {first} AND {x} THEN 1.0 ELSE 0.0 END")
    return p.kernel(position, [flag(enter), flag(leave), "close", p.c(f"CAST({stop} AS DOUBLE)")], 1, most)[0]


def position(enter, leave, close, stop, most):
    out = np.zeros(len(close))
    inside, entry, age = False, 0.0, 0
    for i in range(len(close)):
        if inside:
            age += 1
            if leave[i] > 0 or most and age >= most or stop[i] == stop[i] and close[i] < entry - stop[i]:
                out[i], inside = -1, False
        elif enter[i] > 0:
            out[i], inside, entry, age = 1, True, close[i], 0
    return [out]


def rotation(enter, leave):
    """Like ``position``, but a bar that enters may leave at once, and then only sells."""
    out, inside = np.zeros(len(enter)), False
    for i in range(len(enter)):
        if enter[i] > 0 and not inside:
            out[i], inside = 1, True
        if inside and leave[i] > 0:
            out[i], inside = -1, False
    return [out]


def turning(p: Plan, first: int, condition: str, clear: bool) -> str:
    """Buy where a condition begins to hold and sell where it ceases, from bar ``first`` on; with ``clear`` it counts as not
    holding before."""
    c = p.c(f"CASE WHEN {f'rn >= {first} AND ' if clear else ''}{condition} THEN 1 ELSE 0 END")
    before = p.c(f"coalesce({p.lag(c)}, 0)")
    return p.gate(when(f"{c} = 1 AND {before} = 0", f"{c} = 0 AND {before} = 1"), first)


# --- trend following

@strategy(fast=5, slow=20, stop_loss=-0.08)
def ma_cross(p, fast, slow, stop_loss):
    f, s = p.avg("close", fast), p.avg("close", slow)
    return p.gate(when(cross_up(p, f, s), cross_down(p, f, s)), max(fast, slow) + 2)


@strategy("paid", in_sample=252, out_sample=63)
def walk_forward_adaptive(p, in_sample, out_sample): return ma_cross(p, 5, 20, 0)  # noqa: E704


def _macd(p, fast, slow, signal):
    dif = p.c(f"{p.ema('close', fast)} - {p.ema('close', slow)}")
    return dif, p.ema(dif, signal)


@strategy(fast=12, slow=26, signal=9, stop_loss=-0.06)
def macd_cross(p, fast, slow, signal, stop_loss):
    dif, dea = _macd(p, fast, slow, signal)
    return when(cross_up(p, dif, dea), cross_down(p, dif, dea))


@strategy(short=5, mid=20, long=60)
def triple_ma(p, short, mid, long):
    """Buys where the three lines are in order, unless they were on both bars before."""
    a, b, c = (p.avg("close", n) for n in (short, mid, long))
    ordered = p.c(f"CASE WHEN {a} > {b} AND {b} > {c} THEN 1 ELSE 0 END")
    return p.gate(when(f"{ordered} = 1 AND {p.lag(ordered)} + {p.lag(ordered, 2)} < 2", f"rn > {long + 4} AND {cross_down(p, a, b)}"), long + 4)


@strategy(entry_period=20, exit_period=10, atr_period=20, atr_stop=2)
def turtle(p, entry_period, exit_period, atr_period, atr_stop):
    return held(p, max(entry_period, exit_period, atr_period) + 2, f"close > {p.max('high', entry_period, end=-1)}", f"close < {p.min('low', exit_period, end=-1)}", stop=f"{atr_stop} * {atr(p, atr_period)}")


@strategy(upper_period=20, lower_period=10, min_band_width=0.03)
def donchian(p, upper_period, lower_period, min_band_width):
    hi, lo = p.max("high", upper_period), p.min("low", upper_period)
    wide = f"({hi} - {lo}) / greatest({lo}, 0.01) > {min_band_width}"
    return p.gate(when(f"close > {p.lag(hi)} AND {wide}", f"close < {p.min('low', lower_period, end=-1)}"), max(upper_period, lower_period) + 2)


# --- reversion

def _up(p): return f"close > {p.lag('close')}"  # noqa: E704


@strategy("paid", period=20, std_mult=2, rsi_threshold=30, hold_days=5)
def bb_reversion(p, period, std_mult, rsi_threshold, hold_days):
    m, s = p.avg("close", period), p.sd("close", period)
    return held(p, period + 15, f"close < {m} - {std_mult} * {s} AND {rsi(p, 14)} < {rsi_threshold} AND {_up(p)}", f"close > {m}", hold_days)


@strategy("paid", period=14, oversold=30, overbought=70, hold_days=5)
def rsi_extreme(p, period, oversold, overbought, hold_days):
    r = rsi(p, period)
    return held(p, period + 2, f"{p.lag(r)} > {oversold} AND {r} <= {oversold} AND {_up(p)}", f"{r} >= 55", hold_days)


@strategy("paid", period=20, std=2, rsi_period=14, rsi_threshold=30, vol_mult=1.5)
def bb_rsi_double(p, period, std, rsi_period, rsi_threshold, vol_mult):
    m, s = p.avg("close", period), p.sd("close", period)
    return held(p, max(period + 14, 20) + 1, f"close < {m} - {std} * {s} AND {rsi(p, rsi_period)} < {rsi_threshold} AND volume > {vol_mult} * {p.avg('volume', 20)} AND {_up(p)}", f"close > {m}")


@strategy("paid", n=9, m1=3, m2=3, oversold=20, overbought=80)
def kdj_extreme(p, n, m1, m2, oversold, overbought):
    k, d = kdj(p, n, m1, m2)
    return held(p, n + 2, f"{k} < {oversold} AND {d} < {oversold} AND 3 * {k} - 2 * {d} < 0 AND {_up(p)}", f"{k} >= 55")


@strategy("paid", period=20, entry_z=2, exit_z=0.5, stop_loss=-0.05)
def zscore_reversion(p, period, entry_z, exit_z, stop_loss):
    z = p.c(f"(close - {p.avg('close', period)}) / greatest({p.sd('close', period)}, 0.0001)")
    return held(p, period + 2, f"{z} <= -{entry_z} AND {_up(p)}", f"{z} >= -{exit_z}")


# --- momentum

@strategy("paid", lookback=60, top_k=20, rebalance=20)
def cross_momentum(p, lookback, top_k, rebalance):
    r = p.c(f"CASE WHEN {p.lag('close', lookback)} > 0 THEN close / nullif({p.lag('close', lookback)}, 0) - 1 ELSE 0.0 END")
    live = f"rn >= {lookback + 2}"
    return p.kernel(rotation, [p.c(f"CASE WHEN {live} AND (rn - 1) % {rebalance} = 0 THEN 1.0 ELSE 0.0 END"), p.c(f"CASE WHEN {live} AND {r} < -0.05 THEN 1.0 ELSE 0.0 END")], 1)[0]


@strategy("paid", lookback=60, smoothing=5)
def ts_momentum(p, lookback, smoothing):
    s = p.avg(f"CASE WHEN rn <= {lookback} THEN 0.0 WHEN {change(p, 'close', lookback)} > 0 THEN 1.0 ELSE -1.0 END", smoothing)
    return p.gate(when(f"{s} > 0 AND {p.lag(s)} <= 0", f"{s} <= 0 AND {p.lag(s)} > 0"), lookback + smoothing + 1)


@strategy("paid", fast_period=7, slow_period=14, signal_period=5)
def dual_rsi(p, fast_period, slow_period, signal_period):
    f, s = rsi(p, fast_period), rsi(p, slow_period)
    return turning(p, slow_period + 2, f"{f} > {s} AND {f} > {p.lag(f)} AND {s} > {p.lag(s)}", True)


# --- breakout

@strategy("paid", ma_period=60, vol_mult=1.5, confirm_bars=1)
def vol_breakout_ma(p, ma_period, vol_mult, confirm_bars):
    m = p.avg("close", ma_period)
    return p.gate(when(f"close > {m} AND volume > {vol_mult} * {p.avg('volume', 20)} AND {p.lag('close')} < {p.lag(m)}", f"close < {p.avg('close', 20)}"), max(ma_period, 20) + 2)


@strategy("paid", atr_period=20, atr_mult=2)
def volatility_breakout(p, atr_period, atr_mult):
    a = atr(p, atr_period)
    return held(p, atr_period + 2, f"close > {p.lag('close')} + {atr_mult} * {a}", "1 = 0", stop=f"0.5 * {a}")


@strategy("paid", ema_period=20, atr_period=10, atr_mult=2)
def keltner_breakout(p, ema_period, atr_period, atr_mult):
    m = p.ema("close", ema_period)
    return p.gate(when(cross_up(p, "close", p.c(f"{m} + {atr_mult} * {atr(p, atr_period)}")), f"close < {m}"), max(ema_period, atr_period) + 2)


# --- composite

@strategy("paid", macd_fast=12, macd_slow=26, macd_signal=9, rsi_period=14, rsi_low=40, rsi_high=65)
def macd_rsi_combo(p, macd_fast, macd_slow, macd_signal, rsi_period, rsi_low, rsi_high):
    dif, dea = _macd(p, macd_fast, macd_slow, macd_signal)
    r = rsi(p, rsi_period)
    return when(f"{cross_up(p, dif, dea)} AND {r} > {rsi_low} AND {r} < {rsi_high}", f"{p.lag(dea)} IS NOT NULL AND ({cross_down(p, dif, dea)} OR {r} > 80)")


@strategy("paid", ma_short=5, ma_long=20, vol_mult=1.5)
def ma_volume_confirm(p, ma_short, ma_long, vol_mult):
    s, long = p.avg("close", ma_short), p.avg("close", ma_long)
    return turning(p, max(ma_long, 20) + 2, f"close > {s} AND {s} > {long} AND volume > {vol_mult} * {p.avg('volume', 20)}", False)


@strategy("paid", top_n=30, rebalance=20)
def multi_factor(p, top_n, rebalance):
    """Scores of three features against their last 121 bars, from bar 121 on; features are neutral for the first 20."""
    late = lambda x, early: p.c(f"CASE WHEN rn > 20 THEN {x} ELSE {early} END")
    z = lambda x: p.c(f"({x} - {p.avg(x, 121)}) / greatest({p.sd(x, 121)}, 0.0001)")
    roc = late(f"{change(p, 'close', 20)} / greatest({p.lag('close', 20)}, 0.01)", "0.0")
    ratio = late(f"{p.avg('volume', 5)} / greatest({p.avg('volume', 20)}, 0.01)", "1.0")
    eff = late(f"abs({change(p, 'close', 20)}) / greatest({p.sum(f'abs({change(p)})', 20)}, 0.01)", "0.0")
    score = p.avg(f"0.30 * {z(roc)} + 0.25 * {z(ratio)} + 0.20 * {z(eff)} + 0.15 * (1 - 100 * {atr(p, 14)} / greatest(close, 0.01)) + 0.10 * {eff}", 5)
    turn = f"(rn - 1) % {rebalance} = 0"
    return held(p, 126, f"{turn} AND {score} > 0", f"{turn} AND {score} < -0.5")
