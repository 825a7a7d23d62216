"""Quantitative factors as staged plans.

Conventions here differ from the indicators': windows grow from the first bar, missing values are 0.0 (or the formula's own
default), averages of the exponential family start at the first value, and one-bar returns are 0.0 on the first bar.
Names that mean the same formula share its columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..plans.staged import Plan
from .indicators import MID, TP

#: name -> (category, formula, period)
REGISTRY: dict[str, tuple[str, Callable[..., str], int]] = {}


def factor(category: str, **names: int):
    """Registers a formula under each name, with its period."""

    def add(fn):
        for name, n in names.items():
            REGISTRY[name] = (category, fn, n)
        return fn

    return add


def also(category: str, fn: Callable[..., str], **names: int) -> None:
    factor(category, **names)(fn)


def over(prefix: str, *periods: int) -> dict[str, int]:
    return {f"{prefix}{n}": n for n in periods}


def plan(names: list[str] | None = None) -> Plan:
    p = Plan()
    for name in names or REGISTRY:
        if name not in REGISTRY:
            raise ValueError(f"unknown factor {name!r}")
        _, fn, n = REGISTRY[name]
        p.out(**{name: p.c(fn(p, n))})
    return p


def apply(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    return plan(names).spark(bars)


def by_category(category: str) -> list[str]:
    return [n for n, (c, _, _) in REGISTRY.items() if c == category]


# --- pieces

def avg(p, x, n): return p.avg(x, n, growing=True)  # noqa: E704
def total(p, x, n): return p.sum(x, n, growing=True)  # noqa: E704
def sd(p, x, n): return p.sd(x, n, growing=True)  # noqa: E704
def top(p, x, n): return p.max(x, n, growing=True)  # noqa: E704
def low(p, x, n): return p.min(x, n, growing=True)  # noqa: E704
def ema(p, x, n): return p.ema(x, n, "first")  # noqa: E704


def div(p, x, y, default="0.0") -> str:
    return p.c(f"coalesce(({x}) / nullif({y}, 0), {default})")


def ret(p, n=1): return p.c(f"coalesce(close / nullif({p.lag('close', n)}, 0) - 1, 0.0)")  # noqa: E704
def step(p, x="close"): return p.c(f"coalesce({p.c(x)} - {p.lag(x)}, 0.0)")  # noqa: E704


def tr(p):
    c1 = p.c(f"coalesce({p.lag('close')}, close)")
    return p.c(f"greatest(high - low, abs(high - {c1}), abs(low - {c1}))")


def full(p, x, n, default="0.0"):
    """0 before bar n; then x, or the default where it is missing."""
    return p.c(f"CASE WHEN rn >= {n} THEN coalesce({x}, {default}) ELSE 0.0 END")




def wilder(p, x, n):
    """Accumulated from 0, without decay over the first n bars."""
    return p.recur(x, repr(1 / n), f"CASE WHEN rn <= {n} THEN 1.0 ELSE {1 - 1 / n!r} END", 0.0)


# --- trend

@factor("trend", **over("ma", 5, 10, 20, 60, 120))
def ma_dev(p, n): return p.c(f"CASE WHEN {avg(p, 'close', n)} > 0 THEN close / nullif({avg(p, 'close', n)}, 0) - 1 ELSE 0.0 END")  # noqa: E704
@factor("trend", ma5_dev=5, ma10_dev=10, ma20_dev=20)
def ma_zscore(p, n): return div(p, f"close - {avg(p, 'close', n)}", sd(p, "close", n))  # noqa: E704


def _dif(p): return p.c(f"{ema(p, 'close', 12)} - {ema(p, 'close', 26)}")  # noqa: E704


@factor("trend", macd_dif=0)
def macd_dif(p, n): return div(p, _dif(p), "close")  # noqa: E704
@factor("trend", macd_dea=0)
def macd_dea(p, n): return div(p, ema(p, _dif(p), 9), "close")  # noqa: E704
@factor("trend", macd_hist=0)
def macd_hist(p, n): return div(p, f"{_dif(p)} - {ema(p, _dif(p), 9)}", "close")  # noqa: E704
@factor("trend", trix5=5, trix10=10)
def trix(p, n): return ema(p, ema(p, ema(p, ret(p), n), n), n)  # noqa: E704
@factor("trend", tr=0)
def true_range(p, n): return tr(p)  # noqa: E704
@factor("trend", **over("atr", 5, 10, 20))
def atr(p, n): return avg(p, tr(p), n)  # noqa: E704


def _dm(p):
    up, down = p.c(f"coalesce(high - {p.lag('high')}, 0.0)"), p.c(f"coalesce({p.lag('low')} - low, 0.0)")
    return p.c(f"CASE WHEN {up} > {down} AND {up} > 0 THEN {up} ELSE 0.0 END"), p.c(f"CASE WHEN {down} > {up} AND {down} > 0 THEN {down} ELSE 0.0 END")


@factor("trend", pdi=14)
def pdi(p, n): return div(p, f"100 * {avg(p, _dm(p)[0], n)}", avg(p, tr(p), n))  # noqa: E704
@factor("trend", mdi=14)
def mdi(p, n): return div(p, f"100 * {avg(p, _dm(p)[1], n)}", avg(p, tr(p), n))  # noqa: E704
@factor("trend", adx14=14)
def adx(p, n):
    """Starts again from 0 after a bar without any direction."""
    some = p.c(f"{pdi(p, n)} + {mdi(p, n)}")
    return p.recur(div(p, f"100 * abs({pdi(p, n)} - {mdi(p, n)})", some), repr(1 / n), f"CASE WHEN {some} > 0 THEN {1 - 1 / n!r} ELSE 0.0 END", 0.0)




@factor("trend", plrc5=5, plrc20=20)
def plrc(p, n):
    center = float((n + 1) // 2)  # rounded half up, as the biased centre of 0 .. n - 1
    x = [n - 1 - k - center for k in range(n)]
    return full(p, f"({p.dot('close', x)} - {sum(x)!r} * {p.avg('close', n)}) / {sum(v * v for v in x)!r} / greatest(close, 0.0001)", n + 1)


@factor("trend", hh5=5, hh20=20)
def hh(p, n): return top(p, "close", n)  # noqa: E704
@factor("trend", ll5=5, ll20=20)
def ll(p, n): return low(p, "close", n)  # noqa: E704
@factor("trend", price_chan5=5, price_chan20=20)
def price_channel(p, n): return div(p, f"close - {ll(p, n)}", f"{hh(p, n)} - {ll(p, n)}", "0.5")  # noqa: E704
@factor("trend", high_low5=5, high_low20=20)
def high_low(p, n): return div(p, f"{top(p, 'high', n)} - {low(p, 'low', n)}", "close")  # noqa: E704


# --- reversal

@factor("reversal", **over("rsi", 6, 12, 24))
def rsi(p, n):
    up, down = wilder(p, f"greatest({step(p)}, 0)", n), wilder(p, f"greatest(-{step(p)}, 0)", n)
    return p.c(f"CASE WHEN rn = 1 THEN 0.0 WHEN {down} = 0 THEN 100.0 ELSE 100 - 100 / (1 + {up} / nullif({down}, 0)) END")


@factor("reversal", wr10=10, wr30=30)
def wr(p, n): return p.c(f"CASE WHEN {top(p, 'high', n)} = {low(p, 'low', n)} THEN -50.0 ELSE -100 * ({top(p, 'high', n)} - close) / nullif({top(p, 'high', n)} - {low(p, 'low', n)}, 0) END")  # noqa: E704
@factor("reversal", bb_upper=20)
def bb_upper(p, n): return p.c(f"{avg(p, 'close', n)} + 2 * {sd(p, 'close', n)}")  # noqa: E704
@factor("reversal", bb_lower=20)
def bb_lower(p, n): return p.c(f"{avg(p, 'close', n)} - 2 * {sd(p, 'close', n)}")  # noqa: E704
@factor("reversal", bb_width=20)
def bb_width(p, n): return div(p, f"4 * {sd(p, 'close', n)}", avg(p, "close", n))  # noqa: E704
@factor("reversal", **over("bias", 5, 10, 20, 60))
def bias(p, n): return div(p, f"close - {avg(p, 'close', n)}", avg(p, "close", n))  # noqa: E704


@factor("reversal", cci5=5, cci20=20)
def cci(p, n):
    m, tp = p.avg(TP, n), p.c(TP)
    parts = " + ".join(f"abs({p.lag(TP, k)} - {m})" for k in range(n))
    return full(p, f"({tp} - {m}) / nullif(0.015 * ({parts}) / {n}, 0)", n)


def _kdj(p):
    hi, lo = top(p, "high", 9), low(p, "low", 9)
    rsv = p.c(f"CASE WHEN rn = 1 OR {hi} = {lo} THEN 50.0 ELSE 100 * (close - {lo}) / nullif({hi} - {lo}, 0) END")
    k = p.recur(rsv, repr(1 / 3), repr(2 / 3), 50.0)
    return k, p.recur(k, repr(1 / 3), repr(2 / 3), 50.0)


@factor("reversal", kdj_j=0)
def kdj_j(p, n): return p.c(f"3 * {_kdj(p)[0]} - 2 * {_kdj(p)[1]}")  # noqa: E704
@factor("reversal", kdj_d=0)
def kdj_d(p, n): return _kdj(p)[1]  # noqa: E704
@factor("reversal", ema_fast_slow=0)
def ema_fast_slow(p, n): return div(p, f"{ema(p, 'close', 5)} - {ema(p, 'close', 20)}", ema(p, "close", 20))  # noqa: E704


@factor("reversal", disparity5=5, disparity10=10, close_sma_ratio5=5, close_sma_ratio10=10, close_sma_ratio20=20)
def rs(p, n): return div(p, "close", avg(p, "close", n), "1.0")  # noqa: E704


# --- volatility

@factor("volatility", **over("std", 5, 20, 60))
def std(p, n): return sd(p, "close", n)  # noqa: E704
@factor("volatility", **over("vol", 5, 20, 60))
def vol(p, n): return p.c(f"{sd(p, ret(p), n)} * {n**0.5!r}")  # noqa: E704
@factor("volatility", vol_ratio=0, dvrat=0)
def vol_ratio(p, n): return div(p, sd(p, ret(p), 5), sd(p, ret(p), 20), "1.0")  # noqa: E704
@factor("volatility", amplitude=0)
def amplitude(p, n): return div(p, "high - low", p.c(f"coalesce({p.lag('close')}, close)"))  # noqa: E704
@factor("volatility", davol5=5, davol20=20)
def vma(p, n): return avg(p, "volume", n)  # noqa: E704
@factor("volatility", upvol=20)
def upvol(p, n): return div(p, total(p, f"CASE WHEN {ret(p)} > 0 THEN volume ELSE 0.0 END", n), total(p, "volume", n), "0.5")  # noqa: E704
@factor("volatility", dnvol=20)
def dnvol(p, n): return div(p, total(p, f"CASE WHEN {ret(p)} < 0 THEN volume ELSE 0.0 END", n), total(p, "volume", n), "0.5")  # noqa: E704


def _moment(p, n, k):
    m, s = p.avg(ret(p), n), p.sd(ret(p), n)
    parts = " + ".join(f"power({p.lag(ret(p), i)} - {m}, {k})" for i in range(n))
    return f"({parts}) / {n} / nullif(power({s}, {k}), 0)"


@factor("volatility", vol_skew=20)
def vol_skew(p, n): return full(p, _moment(p, n, 3), n + 1)  # noqa: E704
@factor("volatility", vol_kurt=20)
def vol_kurt(p, n): return full(p, f"{_moment(p, n, 4)} - 3", n + 1)  # noqa: E704
@factor("volatility", max_ret5=5, max_ret20=20)
def max_ret(p, n): return full(p, top(p, ret(p), n), n + 1)  # noqa: E704
@factor("volatility", min_ret5=5, min_ret20=20)
def min_ret(p, n): return full(p, low(p, ret(p), n), n + 1)  # noqa: E704
@factor("volatility", high_low_ratio=0)
def high_low_ratio(p, n): return div(p, "high - low", "close")  # noqa: E704


also("volatility", high_low, range5=5, range20=20)


@factor("volatility", ulcer5=5, ulcer20=20)
def ulcer(p, n): return full(p, f"sqrt({avg(p, f'power(100 * (close - {hh(p, n)}) / nullif({hh(p, n)}, 0), 2)', n)})", n + 1)  # noqa: E704
@factor("volatility", amplitude5=5, amplitude20=20)
def avg_amplitude(p, n): return avg(p, amplitude(p, 0), n)  # noqa: E704


# --- volume

also("volume", vma, vol5_ma5=5, vol10_ma10=10, vol20_ma20=20, vol60_ma60=60)


@factor("volume", vstd5=5, vstd20=20)
def vstd(p, n): return sd(p, "volume", n)  # noqa: E704
@factor("volume", vosc=0)
def vosc(p, n): return div(p, f"{vma(p, 5)} - {vma(p, 20)}", vma(p, 5))  # noqa: E704
@factor("volume", obv=0)
def obv(p, n): return p.cum(f"CASE WHEN {step(p)} > 0 THEN volume WHEN {step(p)} < 0 THEN -volume ELSE 0.0 END")  # noqa: E704
@factor("volume", vwap_dev=20)
def vwap_dev(p, n):
    mean = div(p, total(p, f"{p.c(TP)} * volume", n), total(p, "volume", n), "close")
    return div(p, f"close - {mean}", mean)


@factor("volume", pv_corr5=5, pv_corr20=20)
def pv_corr(p, n):
    r = ret(p)
    cov = p.c(f"{p.avg(f'{r} * volume', n)} - {p.avg(r, n)} * {p.avg('volume', n)}")
    return full(p, f"{cov} / nullif({p.sd(r, n)} * {p.sd('volume', n)}, 0)", n + 1)


@factor("volume", volume_ratio=5, vol_ratio5=5, vol_ratio20=5)
def volume_ratio(p, n): return div(p, "volume", vma(p, n), "1.0")  # noqa: E704
@factor("volume", volume_trend=0)
def volume_trend(p, n): return div(p, vma(p, 5), vma(p, 20), "1.0")  # noqa: E704


@factor("volume", mfi14=14)
def mfi(p, n):
    d, flow = step(p, TP), f"{p.c(TP)} * volume"
    pos, neg = total(p, f"CASE WHEN {d} > 0 THEN {flow} ELSE 0.0 END", n), total(p, f"CASE WHEN {d} < 0 THEN {flow} ELSE 0.0 END", n)
    return full(p, f"100 - 100 / (1 + {pos} / nullif({pos} + {neg}, 0))", n + 1, "50.0")


@factor("volume", eom=0, eom20=0)
def eom(p, n): return p.c(f"CASE WHEN rn > 1 AND volume > 0 THEN (high - low) / nullif(volume, 0) / greatest(abs({step(p, MID)}), 0.0001) ELSE 0.0 END")  # noqa: E704
@factor("volume", force_index=0)
def force_index(p, n): return p.c(f"{step(p)} * volume")  # noqa: E704


def _clv(p): return p.c("coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0.0) * volume")  # noqa: E704


@factor("volume", ad=0)
def ad(p, n): return p.cum(_clv(p))  # noqa: E704
@factor("volume", cmf20=20)
def cmf(p, n): return div(p, total(p, ad(p, 0), n), total(p, "volume", n))  # noqa: E704


def _index(p, sign):
    v = p.lag("volume")
    grown = p.recur(f"CASE WHEN volume {sign} {v} THEN 1 + {ret(p)} ELSE 1.0 END", "0.0", f"CASE WHEN volume {sign} {v} THEN 1 + {ret(p)} ELSE 1.0 END", 1000.0)
    return p.c(f"{grown} / 1000 - 1")


@factor("volume", nvi=0)
def nvi(p, n): return _index(p, "<")  # noqa: E704
@factor("volume", pvi=0)
def pvi(p, n): return _index(p, ">")  # noqa: E704
@factor("volume", vpt=0)
def vpt(p, n): return p.cum(f"least(greatest({ret(p)}, -1), 1) * volume / greatest({p.cum('volume')}, 1.0)")  # noqa: E704
@factor("volume", tvma5=5, tvma20=20)
def tvma(p, n): return p.c(f"{div(p, 'turnover', avg(p, 'turnover', n), '1.0')} - 1")  # noqa: E704
@factor("volume", upside_vol=20)
def upside(p, n): return div(p, total(p, f"CASE WHEN rn = 1 OR {step(p)} > 0 THEN volume ELSE 0.0 END", n), total(p, "volume", n), "0.5")  # noqa: E704
@factor("volume", downside_vol=20)
def downside(p, n): return div(p, total(p, f"CASE WHEN {step(p)} < 0 THEN volume ELSE 0.0 END", n), total(p, "volume", n), "0.5")  # noqa: E704


# --- momentum

@factor("momentum", **over("ret", 1, 5, 10, 20, 60), ret_ma5=5, ret_ma20=20)
def ret_n(p, n): return ret(p, n)  # noqa: E704
@factor("momentum", **over("sr", 5, 20, 60))
def sr(p, n): return div(p, avg(p, ret(p), n), sd(p, ret(p), n))  # noqa: E704


also("momentum", rs, **over("rs", 5, 10, 20, 60))


@factor("momentum", **over("high_dist", 5, 10, 20))
def high_dist(p, n): return div(p, f"{hh(p, n)} - close", hh(p, n))  # noqa: E704
@factor("momentum", **over("low_dist", 5, 10, 20))
def low_dist(p, n): return div(p, f"close - {ll(p, n)}", ll(p, n))  # noqa: E704
@factor("momentum", mom_div5=5, mom_div20=20)
def mom_div(p, n): return p.c(f"{ret(p, n)} / greatest(abs({ret(p, 4 * n)}), 0.0001)")  # noqa: E704
@factor("momentum", **over("roc", 5, 10, 20))
def roc(p, n): return div(p, f"close - {p.lag('close', n)}", p.lag("close", n))  # noqa: E704
@factor("momentum", ltm_ratio=0)
def ltm_ratio(p, n): return p.c(f"CASE WHEN abs({ret(p, 20)}) > 0.0001 THEN {ret(p, 60)} / nullif({ret(p, 20)}, 0) ELSE 1.0 END")  # noqa: E704
@factor("momentum", pct_rank5=5, pct_rank20=20)
def pct_rank(p, n):
    below = " + ".join(f"CASE WHEN {p.lag('close', k)} < close THEN 1 ELSE 0 END" for k in range(1, n))
    return p.c(f"1e0 * ({below}) / least(rn, {n})")


# --- liquidity

@factor("liquidity", **over("turn", 5, 10, 20))
def turn(p, n): return div(p, "turnover", avg(p, "turnover", n), "1.0")  # noqa: E704
@factor("liquidity", turn_std5=5, turn_std20=20)
def turn_std(p, n): return sd(p, "turnover", n)  # noqa: E704


def _illiquidity(p): return p.c(f"coalesce(abs({ret(p)}) / nullif(amount, 0), 0.0) * 100000000.0")  # noqa: E704


@factor("liquidity", amihud5=5, amihud20=20)
def amihud(p, n): return avg(p, _illiquidity(p), n)  # noqa: E704
@factor("liquidity", dollar_vol5=5, dollar_vol20=20)
def dollar_vol(p, n): return p.c(f"CASE WHEN {avg(p, 'amount', n)} > 0 THEN ln(nullif({avg(p, 'amount', n)}, 0)) END")  # noqa: E704
@factor("liquidity", spread5=5, spread20=20)
def spread(p, n): return avg(p, div(p, "high - low", MID), n)  # noqa: E704


also("liquidity", vwap_dev, vwp5=5, vwp20=20)


@factor("liquidity", vol_conc5=5, vol_conc20=20)
def vol_conc(p, n): return div(p, top(p, "volume", n), total(p, "volume", n))  # noqa: E704
@factor("liquidity", liq_ratio5=5, liq_ratio20=20)
def liq_ratio(p, n): return p.c(f"{div(p, total(p, f'abs({ret(p)})', n), total(p, 'amount', n))} * 1000000000.0")  # noqa: E704
@factor("liquidity", price_impact5=5, price_impact20=20)
def price_impact(p, n): return p.c(f"{avg(p, div(p, f'abs({ret(p)})', 'volume'), n)} * 1000000.0")  # noqa: E704
@factor("liquidity", vol_break5=5, vol_break20=20)
def vol_break(p, n): return div(p, "volume", vma(p, n), "1.0")  # noqa: E704
@factor("liquidity", float_proxy=0)
def float_proxy(p, n): return div(p, "amount / 10000", "turnover")  # noqa: E704
@factor("liquidity", illiq_std5=5, illiq_std20=20)
def illiq_std(p, n): return sd(p, _illiquidity(p), n)  # noqa: E704
