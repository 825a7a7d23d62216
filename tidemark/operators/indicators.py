"""Technical indicators as staged plans.

Each function adds its columns to a plan and returns its outputs.  Values are NULL until a window is full.  ``lookahead``
marks those that use later bars.  Where the plain reading of a definition would leave every value missing (a missing seed)
the documented intent is computed: ``ac``, ``emv_v2``, ``thermo``, ``inertia``.  Deviations from common textbook forms are
noted at the indicators that have them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions import kernels
from ..plans.staged import Plan


@dataclass(frozen=True)
class Indicator:
    name: str
    category: str
    tier: str
    params: dict[str, float]
    lookahead: bool
    fn: Callable[..., dict[str, str]]


REGISTRY: dict[str, Indicator] = {}


def indicator(category: str, tier: str = "free", lookahead: bool = False, name: str | None = None, **params: float):
    def add(fn):
        key = name or fn.__name__.rstrip("_")
        REGISTRY[key] = Indicator(key, category, tier, params, lookahead, fn)
        return fn

    return add


def apply(bars: DataFrame, wanted: dict[str, dict] | list[str]) -> DataFrame:
    """The outputs of several indicators in one plan.  An indicator's only output has its name, others ``name_output``."""
    return plan(wanted).spark(bars)


def plan(wanted: dict[str, dict] | list[str]) -> Plan:
    p = Plan()
    for name, params in (wanted if isinstance(wanted, dict) else dict.fromkeys(wanted, {})).items():
        add(p, name, **params)
    return p


def add(p: Plan, name: str, **params) -> dict[str, str]:
    if name not in REGISTRY:
        raise ValueError(f"unknown indicator {name!r}")
    spec = REGISTRY[name]
    if unknown := set(params) - set(spec.params):
        raise ValueError(f"{name} has no parameter {sorted(unknown)}")
    values = {k: int(v) if float(v).is_integer() else v for k, v in (spec.params | params).items()}
    out = spec.fn(p, **values)
    named = {name if k == "" else f"{name}_{k}": v for k, v in out.items()}
    p.out(**named)
    return named


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(s.name, s.category, s.tier, s.lookahead, s.params and {k: float(v) for k, v in s.params.items()} or {}) for s in REGISTRY.values()]
    return spark.createDataFrame(rows, "name string, category string, tier string, lookahead boolean, params map<string,double>")


def beside(bars: DataFrame, other: DataFrame, col: int = 1) -> DataFrame:
    """bars with ``close_{col}``, the close of another series (trade_date, close) on the same date, null where it has none."""
    from pyspark.sql import functions as F

    return bars.join(other.select("trade_date", F.col("close").alias(f"close_{col}")), "trade_date", "left").select(*bars.columns, f"close_{col}")


# --- shared pieces

TP, MID = "(high + low + close) / 3", "(high + low) / 2"


def true_range(p: Plan, first: str = "high - low") -> str:
    c1 = p.lag("close")
    return p.c(f"CASE WHEN {c1} IS NULL THEN {first} ELSE greatest(high - low, abs(high - {c1}), abs(low - {c1})) END")


def change(p: Plan, x: str = "close", k: int = 1) -> str:
    return p.c(f"{p.c(x)} - {p.lag(x, k)}")


def wma_(p: Plan, x: str, n: int) -> str:
    total = n * (n + 1) / 2
    return p.dot(x, [(n - k) / total for k in range(n)])


def slope_(p: Plan, x: str, n: int) -> str:
    """Least-squares slope of x on 0 .. n - 1 over n bars."""
    s = n * (n * n - 1) / 12
    return p.dot(x, [((n - 1 - k) - (n - 1) / 2) / s for k in range(n)])


def endpoint(p: Plan, x: str, n: int) -> str:
    return p.c(f"{p.avg(x, n)} + {slope_(p, x, n)} * {(n - 1) / 2!r}")


#: Longer windows of order statistics are kept sorted, in a kernel; shorter ones are window functions in the plan's one exchange.
SHORT = 40


def mean_abs(p: Plan, x: str, mean: str, n: int) -> str:
    if n > SHORT:
        return p.sliding_spread(x, mean, n)
    x = p.c(x)
    parts = " + ".join(f"abs({p.lag(x, k)} - {mean})" for k in range(n))
    return p.c(f"({parts}) / {n}")


def stoch_(p: Plan, n: int, flat: str = "50.0", x: str = "close") -> str:
    hi, lo = p.max("high", n), p.min("low", n)
    return p.c(f"CASE WHEN {hi} = {lo} THEN {flat} ELSE 100 * ({x} - {lo}) / nullif({hi} - {lo}, 0) END")


def rsi_(p: Plan, n: int, x: str = "close", first: int = 1) -> str:
    """On the changes of x, whose first value is at bar ``first``; the value of the averages' own seed bar is left out."""
    d = change(p, x)
    up, down = (p.rma(f"CASE WHEN {sign}{d} > 0 THEN {sign}{d} WHEN {d} IS NOT NULL THEN 0.0 END", n) for sign in ("", "-"))
    return p.c(f"CASE WHEN rn > {first + n} THEN 100 - 100 / (1 + CASE WHEN {down} = 0 THEN 100.0 ELSE {up} / nullif({down}, 0) END) END")


def money_flow(p: Plan) -> str:
    return p.c("CASE WHEN high = low THEN 0.0 ELSE ((close - low) - (high - close)) / nullif(high - low, 0) * volume END")


def annual(p: Plan, variance: str, annualize: float) -> str:
    v = p.c(variance)
    return p.c(f"CASE WHEN {v} IS NOT NULL THEN sqrt(greatest({v}, 0)) * {math.sqrt(annualize)!r} * 100 END")


# --- trend

@indicator("trend", period=20)
def sma(p, period): return {"": p.avg("close", period)}  # noqa: E704
@indicator("trend", period=20)
def ema(p, period): return {"": p.ema("close", period)}  # noqa: E704
@indicator("trend", period=20)
def wma(p, period): return {"": wma_(p, "close", period)}  # noqa: E704
@indicator("trend", period=14)
def rma(p, period): return {"": p.rma("close", period, "first")}  # noqa: E704
@indicator("trend", period=20)
def linreg(p, period): return {"": endpoint(p, "close", period)}  # noqa: E704
@indicator("trend", "pro", period=25)
def lsma(p, period): return {"": endpoint(p, "close", period)}  # noqa: E704
@indicator("trend")
def hl2(p): return {"": p.c(MID)}  # noqa: E704
@indicator("trend")
def hlc3(p): return {"": p.c(TP)}  # noqa: E704
@indicator("trend")
def ohlc4(p): return {"": p.c("(open + high + low + close) / 4")}  # noqa: E704
@indicator("trend")
def wcp(p): return {"": p.c("(high + low + 2 * close) / 4")}  # noqa: E704
@indicator("trend", period=10)
def midpoint(p, period): return {"": p.c(f"({p.max('close', period)} + {p.min('close', period)}) / 2")}  # noqa: E704
@indicator("trend", period=10)
def midprice(p, period): return {"": p.c(f"({p.max('high', period)} + {p.min('low', period)}) / 2")}  # noqa: E704
@indicator("trend", period=14)
def qstick(p, period): return {"": p.avg("close - open", period)}  # noqa: E704


@indicator("trend", period=20)
def dema(p, period):
    e1 = p.ema("close", period, "first")
    return {"": p.c(f"2 * {e1} - {p.ema(e1, period, 'first')}")}


@indicator("trend", period=20)
def tema(p, period):
    e1 = p.ema("close", period, "first")
    e2 = p.ema(e1, period, "first")
    return {"": p.c(f"3 * {e1} - 3 * {e2} + {p.ema(e2, period, 'first')}")}


@indicator("trend", period=20)
def trima(p, period):
    w = [min(k + 1, period - k) for k in range(period)]
    return {"": p.dot("close", [x / sum(w) for x in w])}


@indicator("trend", period=20)
def hilo(p, period):
    m = p.avg("close", period)
    h, low = p.c(f"CASE WHEN {m} IS NOT NULL THEN greatest(high, {m}) END"), p.c(f"CASE WHEN {m} IS NOT NULL THEN least(low, {m}) END")
    return {"high": h, "low": low, "mid": p.c(f"({h} + {low}) / 2")}


@indicator("trend", period=10, multiplier=3)
def supertrend(p, period, multiplier):
    atr_ = p.rma(true_range(p), period)
    return {"": p.kernel(kernels.supertrend, ["high", "low", "close", atr_], 1, multiplier)[0]}


@indicator("trend", fast=12, slow=26, signal=9)
def macd(p, fast, slow, signal):
    """The signal line stands ``signal`` - 1 bars late."""
    dif = p.c(f"{p.ema('close', fast)} - {p.ema('close', slow)}")
    dea = p.lag(p.ema(dif, signal), signal - 1)
    return {"dif": dif, "dea": dea, "hist": p.c(f"2 * ({dif} - {dea})")}


def directional(p, period):
    up, down = change(p, "high"), p.c(f"{p.lag('low')} - low")
    plus = p.c(f"CASE WHEN {up} IS NULL THEN 0.0 WHEN {up} > {down} AND {up} > 0 THEN {up} ELSE 0.0 END")
    minus = p.c(f"CASE WHEN {up} IS NULL THEN 0.0 WHEN {down} > {up} AND {down} > 0 THEN {down} ELSE 0.0 END")
    return plus, minus


@indicator("trend", period=14)
def adx(p, period):
    plus, minus = directional(p, period)
    tr = p.rma(true_range(p), period)
    pdi, mdi = p.c(f"100 * {p.rma(plus, period)} / nullif({tr}, 0)"), p.c(f"100 * {p.rma(minus, period)} / nullif({tr}, 0)")
    dx = p.c(f"100 * abs({pdi} - {mdi}) / nullif({pdi} + {mdi}, 0)")
    return {"": p.c(f"CASE WHEN {dx} IS NOT NULL THEN {p.rma(dx, period)} END"), "pdi": pdi, "mdi": mdi}


@indicator("trend", af_step=0.02, af_max=0.2)
def psar(p, af_step, af_max): return {"": p.kernel(kernels.psar, ["high", "low"], 1, af_step, af_max)[0]}  # noqa: E704


@indicator("trend", period=14)
def aroon(p, period):
    def since(x: str, function: str, sign: str) -> str:
        best = (p.over(f"max_by(rn, struct({sign}{x}, -rn))", p.frame(1 - period)), p.over(f"arg_max(rn, ({sign}{x}, -rn))", p.frame(1 - period)))
        return p.gate(p.c(f"100e0 * ({period - 1} - (rn - {p.c(best)})) / {period - 1}"), period)

    up, down = since("high", "max", ""), since("low", "min", "-")
    return {"up": up, "down": down}


@indicator("trend", period=20)
def dpo(p, period): return {"": p.lag(f"close - {p.avg('close', period)}", period // 2 + 1)}  # noqa: E704


@indicator("trend", period=14)
def vortex(p, period):
    """Sums of n - 1 bars, from bar n + 1 on."""
    n = period - 1
    total = p.gate(p.sum(f"CASE WHEN rn > 1 THEN {true_range(p)} END", n), period + 1)
    return {"plus": p.ratio(p.sum(f"abs(high - {p.lag('low')})", n), total), "minus": p.ratio(p.sum(f"abs(low - {p.lag('high')})", n), total)}


@indicator("trend", period=3)
def decreasing(p, period): return {"": p.min(f"CASE WHEN {change(p)} < 0 THEN 1 WHEN {change(p)} >= 0 THEN 0 END", period - 1)}  # noqa: E704
@indicator("trend", period=3)
def increasing(p, period): return {"": p.min(f"CASE WHEN {change(p)} > 0 THEN 1 WHEN {change(p)} <= 0 THEN 0 END", period - 1)}  # noqa: E704


@indicator("trend", period=14)
def chop(p, period):
    rng = p.c(f"{p.max('high', period)} - {p.min('low', period)}")
    total = p.sum(true_range(p, "0.0"), period)
    return {"": p.c(f"CASE WHEN {rng} > 0 AND {total} > 0 THEN least(greatest(100 * log10({total} / nullif({rng}, 0)) / {math.log10(period)!r}, 0), 100) END")}


# --- momentum

@indicator("momentum", period=14)
def rsi(p, period): return {"": rsi_(p, period)}  # noqa: E704


@indicator("momentum", n=9, m1=3, m2=3)
def kdj(p, n, m1, m2):
    k = p.rma(stoch_(p, n), m1, "first")
    d = p.rma(k, m2, "first")
    return {"k": k, "d": d, "j": p.c(f"3 * {k} - 2 * {d}")}


@indicator("momentum", k_period=14, k_slow=3, d_period=3)
def stoch(p, k_period, k_slow, d_period):
    k = p.rma(stoch_(p, k_period), k_slow, "first")
    return {"k": k, "d": p.rma(k, d_period, "first")}


@indicator("momentum", period=20)
def cci(p, period):
    m = p.avg(TP, period)
    return {"": p.c(f"({p.c(TP)} - {m}) / nullif(0.015 * {mean_abs(p, TP, m, period)}, 0)")}


@indicator("momentum", period=14)
def williams_r(p, period):
    hi, lo = p.max("high", period), p.min("low", period)
    return {"": p.c(f"CASE WHEN {hi} = {lo} THEN -50.0 ELSE -100 * ({hi} - close) / nullif({hi} - {lo}, 0) END")}


@indicator("momentum", period=12)
def roc(p, period): return {"": p.c(f"CASE WHEN {p.lag('close', period)} > 0 THEN 100 * (close - {p.lag('close', period)}) / nullif({p.lag('close', period)}, 0) END")}  # noqa: E704
@indicator("momentum", period=12)
def mom(p, period): return {"": change(p, "close", period)}  # noqa: E704


@indicator("momentum", period=14)
def mfi(p, period):
    d = change(p, TP)
    flow = f"{p.c(TP)} * volume"
    pos, neg = p.sum(f"CASE WHEN {d} > 0 THEN {flow} WHEN {d} IS NOT NULL THEN 0.0 END", period), p.sum(f"CASE WHEN {d} <= 0 THEN {flow} WHEN {d} IS NOT NULL THEN 0.0 END", period)
    return {"": p.c(f"CASE WHEN {neg} > 0 THEN 100 - 100 / (1 + {pos} / nullif({neg}, 0)) WHEN {neg} = 0 THEN 100.0 END")}


@indicator("momentum", period=10)
def fisher(p, period):
    """Weighs by 0.66 twice, as defined; bars without a range are skipped, and the first of a full window too."""
    hi, lo = p.max(MID, period), p.min(MID, period)
    x = p.c(f"CASE WHEN rn > {period} AND {hi} > {lo} THEN 1.32 * (({p.c(MID)} - {lo}) / nullif({hi} - {lo}, 0) - 0.5) END")
    v = p.c(f"CASE WHEN {x} IS NOT NULL THEN least(greatest({p.recur(x, '0.66', '0.34', 0.0)}, -0.999), 0.999) END")
    f = p.recur(f"0.5 * ln((1 + {v}) / nullif(1 - {v}, 0))", "1.0", "0.5", 0.0)
    return {"": p.c(f"CASE WHEN {x} IS NOT NULL THEN {f} END")}


@indicator("momentum", fast=12, slow=26)
def apo(p, fast, slow): return {"": p.c(f"{p.ema('close', fast, 'first')} - {p.ema('close', slow, 'first')}")}  # noqa: E704
@indicator("momentum", fast=12, slow=26)
def ppo(p, fast, slow): return {"": p.c(f"100 * ({p.ema('close', fast, 'first')} / nullif({p.ema('close', slow, 'first')}, 0) - 1)")}  # noqa: E704
@indicator("momentum", period=6)
def bias(p, period): return {"": p.c(f"CASE WHEN {p.avg('close', period)} = 0 THEN 0.0 ELSE 100 * (close / nullif({p.avg('close', period)}, 0) - 1) END")}  # noqa: E704
@indicator("momentum", period=12)
def psl(p, period): return {"": p.c(f"100e0 * {p.sum(f'CASE WHEN {change(p)} > 0 THEN 1 ELSE 0 END', period)} / {period}")}  # noqa: E704
@indicator("momentum")
def bop(p): return {"": p.c("(close - open) / nullif(high - low, 0)")}  # noqa: E704
@indicator("momentum", period=20)
def slope(p, period): return {"": slope_(p, "close", period)}  # noqa: E704


def rvgi(p, n): return p.ratio(p.sum("close - open", n), p.sum("high - low", n))  # noqa: E704
@indicator("momentum", period=14)
def inertia(p, period): return {"": p.ema(p.avg(rvgi(p, period), 4), period, "first")}  # noqa: E704
@indicator("momentum", period=10)
def er(p, period): return {"": p.ratio(f"abs({change(p, 'close', period)})", p.sum(f"abs({change(p)})", period))}  # noqa: E704


@indicator("momentum", period=26)
def brar(p, period):
    c1 = p.lag("close")
    br = p.ratio(p.sum(f"greatest(high - {c1}, CASE WHEN {c1} IS NOT NULL THEN 0.0 END)", period, growing=True), p.sum(f"CASE WHEN {c1} IS NOT NULL THEN greatest({c1} - low, 0.0) END", period, growing=True))
    ar = p.ratio(p.sum("greatest(high - open, 0.0)", period, growing=True), p.sum("greatest(open - low, 0.0)", period, growing=True))
    return {"br": p.c(f"100 * {br}"), "ar": p.c(f"100 * {ar}")}


# --- volatility

@indicator("volatility", period=20, stddev=2)
def bb(p, period, stddev):
    m, s = p.avg("close", period), p.sd("close", period)
    return {"mid": m, "upper": p.c(f"{m} + {stddev} * {s}"), "lower": p.c(f"{m} - {stddev} * {s}")}


@indicator("volatility", period=14)
def atr(p, period): return {"": p.rma(true_range(p), period)}  # noqa: E704


@indicator("volatility", period=20, atr_period=10, multiplier=2)
def kc(p, period, atr_period, multiplier):
    m, a = p.ema("close", period), p.rma(true_range(p), atr_period)
    return {"mid": m, "upper": p.c(f"{m} + {multiplier} * {a}"), "lower": p.c(f"{m} - {multiplier} * {a}")}


@indicator("volatility", period=20)
def dc(p, period):
    hi, lo = p.max("high", period), p.min("low", period)
    return {"upper": hi, "lower": lo, "mid": p.c(f"({hi} + {lo}) / 2")}


@indicator("volatility", period=14)
def natr(p, period): return {"": p.c(f"100 * {p.rma(true_range(p), period, 'first')} / nullif(close, 0)")}  # noqa: E704
@indicator("volatility", name="true_range")
def true_range_(p): return {"": true_range(p)}  # noqa: E704


@indicator("volatility", period=25)
def massi(p, period):
    e1 = p.ema("high - low", 9, "first")
    return {"": p.gate(p.sum(p.ratio(e1, p.ema(e1, 9, "first")), period, growing=True), period + 1)}


@indicator("volatility", period=14)
def rvi(p, period):
    d = change(p)
    m = p.avg(d, period)
    up = " + ".join(f"power(greatest({p.lag(d, k)} - {m}, 0), 2)" for k in range(period))
    down = " + ".join(f"power(least({p.lag(d, k)} - {m}, 0), 2)" for k in range(period))
    n_up = " + ".join(f"CASE WHEN {p.lag(d, k)} > {m} THEN 1 ELSE 0 END" for k in range(period))
    n_down = " + ".join(f"CASE WHEN {p.lag(d, k)} < {m} THEN 1 ELSE 0 END" for k in range(period))
    return {"": p.ratio(f"sqrt(({up}) / nullif({n_up}, 0))", f"sqrt(({down}) / nullif({n_down}, 0))")}


@indicator("volatility", period=20)
def thermo(p, period): return {"": p.ratio(p.ema("high - low", period, "first"), p.ema(true_range(p), period, "first"))}  # noqa: E704


@indicator("volatility", period=14)
def ui(p, period):
    hi = p.max("close", period)
    parts = " + ".join(f"power(100 * ({hi} - {p.lag('close', k)}) / nullif({hi}, 0), 2)" for k in range(period))
    return {"": p.c(f"sqrt(({parts}) / {period})")}


# --- volume

@indicator("volume")
def vwap(p): return {"": p.ratio(p.cum(f"{p.c(TP)} * volume"), p.cum("volume"))}  # noqa: E704
@indicator("volume", period=20)
def vwma(p, period): return {"": p.ratio(p.sum("close * volume", period), p.sum("volume", period))}  # noqa: E704
@indicator("volume")
def obv(p): return {"": p.cum(f"CASE WHEN rn = 1 OR {change(p)} > 0 THEN volume WHEN {change(p)} < 0 THEN -volume ELSE 0.0 END")}  # noqa: E704
@indicator("volume")
def ad(p): return {"": p.cum(money_flow(p))}  # noqa: E704
@indicator("volume", period=20)
def cmf(p, period): return {"": p.ratio(p.sum(money_flow(p), period), p.sum("volume", period))}  # noqa: E704


@indicator("volume", fast=3, slow=10)
def adosc(p, fast, slow):
    a = p.cum(money_flow(p))
    return {"": p.c(f"{p.ema(a, fast, 'first')} - {p.ema(a, slow, 'first')}")}


@indicator("volume", period=14)
def eom(p, period):
    """The mean of what is there of a window, from the first move on."""
    box = "(volume / 100000000.0) / nullif((high - low) / nullif(high, 0), 0)"
    return {"": p.avg(f"{change(p, MID)} / nullif({box}, 0)", period, growing=True)}


@indicator("volume")
def pvt(p): return {"": p.cum(f"CASE WHEN rn = 1 THEN 0.0 ELSE volume * {change(p)} / nullif({p.lag('close')}, 0) END")}  # noqa: E704
@indicator("volume")
def pvol(p): return {"": p.c("close * volume")}  # noqa: E704


# --- statistics

@indicator("statistics", period=20)
def stdev(p, period): return {"": p.sd("close", period)}  # noqa: E704
@indicator("statistics", period=20)
def variance(p, period): return {"": p.window("var_pop", "close", period)}  # noqa: E704
@indicator("statistics", period=20)
def zscore(p, period): return {"": p.ratio(f"close - {p.avg('close', period)}", p.sd("close", period))}  # noqa: E704
@indicator("statistics", period=20)
def mad(p, period): return {"": mean_abs(p, "close", p.avg("close", period), period)}  # noqa: E704
@indicator("statistics", period=20)
def median(p, period):
    at = p.frame(1 - period)
    return {"": p.gate(p.sliding_median("close", period) if period > SHORT else p.c((p.over("percentile(close, 0.5)", at), p.over("quantile_cont(close, 0.5)", at))), period)}


@indicator("statistics", period=1)
def percent_return(p, period): return {"": p.c(f"100 * (close / nullif({p.lag('close', period)}, 0) - 1)")}  # noqa: E704
@indicator("statistics", period=20)
def trend_return(p, period): return {"": p.c(f"100 * (close / nullif({p.avg('close', period)}, 0) - 1)")}  # noqa: E704
@indicator("statistics", period=20, col=0)
def correlation(p, period, col):
    """With the close of another series, the column ``close_{col}`` (``beside`` adds it); with itself where col is 0.  A window
    counts the bars that both have."""
    x, y = ("close", "close") if col == 0 else (p.c(f"CASE WHEN close_{col} IS NOT NULL THEN close END"), p.c(f"CASE WHEN close IS NOT NULL THEN close_{col} END"))
    return {"": p.ratio(p.window("covar_pop", x, period, more=f", {y}"), f"{p.sd(x, period)} * {p.sd(y, period)}")}


# --- cycle and whole-series

@indicator("cycle", period=40)
def ebsw(p, period):
    e = p.ema(p.ema("close", period, "first"), period, "first")
    return {"": p.dot(e, [0.0962, 0.5769, -0.5769 - 0.0962])}


@indicator("cycle", lookahead=True, mode=0)
def seasonal(p, mode):
    r = p.c(f"100 * (close / nullif({p.lag('close')}, 0) - 1)")
    slot = p.c(f"(rn - 1) % {5 if mode == 0 else 21}")
    return {"": p.c(f"avg({r}) OVER (PARTITION BY {p.key}, {slot})")}


@indicator("levels", lookahead=True, period=100)
def fib_retracement(p, period):
    whole = p.c(f"count(*) OVER (PARTITION BY {p.key})")
    inside = p.c(f"{whole} - rn < {period}")
    hi, lo = (p.c(f"{f}(CASE WHEN {inside} THEN {x} END) OVER (PARTITION BY {p.key})") for f, x in (("max", "high"), ("min", "low")))
    return {f"{round(1000 * q)}": p.c(f"CASE WHEN {inside} THEN {hi} - ({hi} - {lo}) * {q!r} END") for q in (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0, 1.272, 1.618)}


@indicator("levels", lookahead=True, period=20, threshold=3)
def sr_detect(p, period, threshold):
    n = period
    around = f"ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING"
    full = p.c(f"{p.over('count(*)', around)} = {2 * n + 1}")
    hi, lo, v = p.c(p.over("max(high)", around)), p.c(p.over("min(low)", around)), p.c(p.over("avg(volume)", around))
    return {
        "resistance": p.c(f"CASE WHEN {full} AND high = {hi} THEN high END"), "support": p.c(f"CASE WHEN {full} AND low = {lo} THEN low END"),
        "spike": p.c(f"CASE WHEN {full} AND volume > {threshold} * {v} THEN {MID} END"),
    }


# --- candles

BODY, RANGE = "abs(close - open)", "(high - low)"
UPPER, LOWER = "(high - greatest(open, close))", "(least(open, close) - low)"


def candle(name: str, rule: Callable[[Plan], str]) -> None:
    indicator("candles", name=f"cdl_{name}")(lambda p: {"": p.c(rule(p))})


def _flag(sign: int, condition: str) -> str:
    return f"CASE WHEN {condition} THEN {sign} ELSE 0 END"


def _both(up: str, down: str) -> str:
    return f"CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END"


def _long_shadow(x: str, y: str) -> str:
    return f"{BODY} > 0 AND {RANGE} > 0 AND {x} > 2 * {BODY} AND {y} < 0.3 * {BODY}"


candle("doji", lambda p: _flag(1, f"{RANGE} > 0 AND {BODY} / nullif({RANGE}, 0) < 0.1"))
candle("hammer", lambda p: _flag(1, f"{p.lag('close')} > close AND {_long_shadow(LOWER, UPPER)}"))
candle("inverted_hammer", lambda p: _flag(1, f"{p.lag('close')} > close AND {_long_shadow(UPPER, LOWER)}"))
candle("hanging_man", lambda p: _flag(-1, f"{p.lag('close')} < close AND {_long_shadow(LOWER, UPPER)}"))
candle("shooting_star", lambda p: _flag(-1, f"{p.lag('close')} < close AND {_long_shadow(UPPER, LOWER)}"))


def _turn(p: Plan, size: str) -> str:
    """Between a rising bar and one that does not rise."""
    o1, c1 = p.lag("open"), p.lag("close")
    return _both(f"{c1} <= {o1} AND close > open AND {size}", f"{c1} > {o1} AND close <= open AND {size}")


candle("engulfing", lambda p: _turn(p, f"{BODY} > abs({p.lag('close')} - {p.lag('open')})"))
candle("harami", lambda p: _turn(p, f"{BODY} < 0.7 * abs({p.lag('close')} - {p.lag('open')})"))
candle("piercing", lambda p: _flag(1, f"{p.lag('close')} < {p.lag('open')} AND close > open AND open < {p.lag('low')} AND close > ({p.lag('open')} + {p.lag('close')}) / 2 AND close < {p.lag('open')}"))
candle("dark_cloud_cover", lambda p: _flag(-1, f"{p.lag('close')} > {p.lag('open')} AND close < open AND open > {p.lag('high')} AND close < ({p.lag('open')} + {p.lag('close')}) / 2 AND close > {p.lag('open')}"))


def _star(p: Plan, up: bool) -> str:
    o1, c1, o2, c2 = p.lag("open"), p.lag("close"), p.lag("open", 2), p.lag("close", 2)
    first, turn, beyond = ("<", ">", ">") if up else (">", "<=", "<")
    small = f"({o1} = 0 OR abs({c1} - {o1}) / nullif({o1}, 0) * 100 < 1.5)"
    return _flag(1 if up else -1, f"{c2} {first} {o2} AND {small} AND close {turn} open AND close {beyond} ({o2} + {c2}) / 2")


candle("morning_star", lambda p: _star(p, True))
candle("evening_star", lambda p: _star(p, False))
candle("three_white_soldiers", lambda p: _flag(1, f"close > open AND {p.lag('close')} > {p.lag('open')} AND {p.lag('close', 2)} > {p.lag('open', 2)} AND close > {p.lag('close')} AND {p.lag('close')} > {p.lag('close', 2)}"))
candle("three_black_crows", lambda p: _flag(-1, f"close <= open AND {p.lag('close')} <= {p.lag('open')} AND {p.lag('close', 2)} <= {p.lag('open', 2)} AND close < {p.lag('close')} AND {p.lag('close')} < {p.lag('close', 2)}"))
candle("marubozu", lambda p: f"CASE WHEN {BODY} > 0 AND {UPPER} < 0.05 * {BODY} AND {LOWER} < 0.05 * {BODY} THEN CASE WHEN close > open THEN 1 ELSE -1 END ELSE 0 END")
candle("inside", lambda p: _flag(1, f"high < {p.lag('high')} AND low > {p.lag('low')}"))


# --- pro: trend

@indicator("pro_trend", "pro", period=10, fast=2, slow=30)
def kama(p, period, fast, slow):
    e = er(p, period)[""]
    f, s = 2 / (fast + 1), 2 / (slow + 1)
    a = p.c(f"CASE WHEN rn > {period} THEN power(coalesce({e}, 0) * {f - s!r} + {s!r}, 2) ELSE 0.0 END")
    return {"": p.recur("close", a, f"1 - {a}", "sma", period)}


@indicator("pro_trend", "pro", period=20)
def hma(p, period): return {"": wma_(p, f"2 * {wma_(p, 'close', max(1, period // 2))} - {wma_(p, 'close', period)}", max(1, math.isqrt(period)))}  # noqa: E704


@indicator("pro_trend", "pro", period=10, v=0.7)
def t3(p, period, v):
    if not 0.1 <= v <= 1:
        raise ValueError("v must be between 0.1 and 1")
    e = ["close"]
    for _ in range(6):
        e.append(p.ema(e[-1], period, "first"))
    c1, c2, c3, c4 = -(v**3), 3 * v**2 + 3 * v**3, -6 * v**2 - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v**2
    return {"": p.c(f"{c1!r} * {e[6]} + {c2!r} * {e[5]} + {c3!r} * {e[4]} + {c4!r} * {e[3]}")}


@indicator("pro_trend", "pro", period=9)
def vidya(p, period):
    d = change(p)
    up, down = p.sum(f"greatest({d}, CASE WHEN {d} IS NOT NULL THEN 0.0 END)", period), p.sum(f"CASE WHEN {d} IS NOT NULL THEN greatest(-{d}, 0.0) END", period)
    a = p.c(f"coalesce(abs({up} - {down}) / nullif({up} + {down}, 0), 0)")
    return {"": p.recur("close", a, f"1 - {a}", "sma", period)}


@indicator("pro_trend", "pro", period=9, offset=0.85, sigma=6)
def alma(p, period, offset, sigma):
    m, s = offset * (period - 1), period / sigma
    w = [math.exp(-((period - 1 - k - m) ** 2) / (2 * s * s)) for k in range(period)]
    return {"": p.dot("close", [x / sum(w) for x in w])}


@indicator("pro_trend", "pro", period=16)
def frama(p, period):
    if period < 4:
        raise ValueError("period must be at least 4")
    new = period // 2
    span = lambda n, end: p.c(f"{p.max('close', n, end=end)} - {p.min('close', n, end=end)}")
    n1, n2, n3 = p.c(f"{span(new, 0)} / {new}"), p.c(f"{span(period - new, -new)} / {new}"), p.c(f"{span(period, 0)} / {period}")
    dim = p.c(f"CASE WHEN {n1} + {n2} > 0 AND {n3} > 0 THEN ln(({n1} + {n2}) / nullif({n3}, 0)) / {math.log(2)!r} ELSE 1.0 END")
    a = p.c(f"CASE WHEN rn >= {period} THEN least(greatest(exp(-4.6 * ({dim} - 1)), 0.01), 1) ELSE 0.0 END")
    return {"": p.recur("close", a, f"1 - {a}", "sma", period)}


@indicator("pro_trend", "pro", period=22, atr_period=22, multiplier=3)
def chandelier_exit(p, period, atr_period, multiplier):
    a = p.rma(true_range(p), atr_period)
    return {"long": p.c(f"{p.max('high', period)} - {multiplier} * {a}"), "short": p.c(f"{p.min('low', period)} + {multiplier} * {a}")}


@indicator("pro_trend", "pro", period=14, phase=0)
def jma(p, period, phase):
    if abs(phase) > 100:
        raise ValueError("phase must be between -100 and 100")
    beta = 0.45 * (period - 1) / (0.45 * (period - 1) + 2)
    return {"": p.kernel(kernels.jma, ["close"], 1, beta**period * (0.5 + phase / 200))[0]}


@indicator("pro_trend", "pro")
def gmma(p): return {f"{n}": p.ema("close", n, "first") for n in (3, 5, 8, 10, 12, 15, 30, 35, 40, 45, 50, 60)}  # noqa: E704
@indicator("pro_trend", "pro")
def rainbow_ma(p): return {f"{n}": p.ema("close", n) for n in range(2, 21, 2)}  # noqa: E704


# --- pro: composite

@indicator("pro_composite", "pro", tenkan=9, kijun=26, senkou_b=52)
def ichimoku(p, tenkan, kijun, senkou_b):
    mid = lambda n: p.c(f"({p.max('high', n)} + {p.min('low', n)}) / 2")
    t, k = mid(tenkan), mid(kijun)
    return {"tenkan": t, "kijun": k, "senkou_a": p.lag(f"({t} + {k}) / 2", kijun), "senkou_b": p.lag(mid(senkou_b), kijun), "chikou": p.lag("close", kijun)}


@indicator("pro_composite", "pro", jaw_period=13, jaw_shift=8, teeth_period=8, teeth_shift=5, lips_period=5, lips_shift=3)
def alligator(p, jaw_period, jaw_shift, teeth_period, teeth_shift, lips_period, lips_shift):
    line = lambda n, shift: p.lag(p.rma(MID, n), shift)
    return {"jaw": line(jaw_period, jaw_shift), "teeth": line(teeth_period, teeth_shift), "lips": line(lips_period, lips_shift)}


@indicator("pro_composite", "pro", lookahead=True, period=2)
def fractals(p, period):
    def extreme(x: str, sign: str) -> str:
        others = [p.lag(x, k) for k in range(-period, period + 1) if k]
        return p.c(f"CASE WHEN {' AND '.join(f'{x} {sign} {o}' for o in others)} THEN {x} END")

    return {"up": extreme("high", ">"), "down": extreme("low", "<")}


def ao_(p):
    return p.gate(f"{p.avg(MID, 5)} - {p.avg(MID, 34)}", 35)


@indicator("pro_composite", "pro")
def ao(p): return {"": ao_(p)}  # noqa: E704
@indicator("pro_composite", "pro")
def ac(p): return {"": p.gate(f"{ao_(p)} - {p.avg(ao_(p), 5)}", 40)}  # noqa: E704


@indicator("pro_composite", "pro", period=20, multiplier=2)
def threshold_bands(p, period, multiplier):
    m, s = p.avg("close", period), p.c(f"sqrt({p.avg('power(high - low, 2)', period)})")
    return {"mid": m, "upper": p.c(f"{m} + {multiplier} * {s}"), "lower": p.c(f"{m} - {multiplier} * {s}")}


@indicator("pro_composite", "pro", period=20, deviation=2)
def regression_channel(p, period, deviation):
    n = period
    m, b = endpoint(p, "close", n), slope_(p, "close", n)
    se = p.c(f"sqrt(greatest({n} * power({p.sd('close', n)}, 2) - power({b}, 2) * {n * (n * n - 1) / 12!r}, 0) / {n - 2})") if n > 2 else p.c(f"0 * {m}")
    return {"mid": m, "upper": p.c(f"{m} + {deviation} * {se}"), "lower": p.c(f"{m} - {deviation} * {se}")}


@indicator("pro_composite", "pro", period=1)
def pivots(p, period):
    h, low, c = p.max("high", period, end=-1), p.min("low", period, end=-1), p.lag("close")
    v = p.c(f"({h} + {low} + {c}) / 3")
    return {
        "p": v, "r1": p.c(f"2 * {v} - {low}"), "s1": p.c(f"2 * {v} - {h}"), "r2": p.c(f"{v} + ({h} - {low})"), "s2": p.c(f"{v} - ({h} - {low})"),
        "r3": p.c(f"{h} + 2 * ({v} - {low})"), "s3": p.c(f"{low} - 2 * ({h} - {v})"),
    }


@indicator("pro_composite", "pro", rsi_period=14, macd_fast=12, macd_slow=26, bb_period=20)
def decision_point(p, rsi_period, macd_fast, macd_slow, bb_period):
    """A third each of RSI, MACD and band position.  The MACD part is 0 throughout, as its definition's signal line is never
    there; parts that are not there yet count 0."""
    m, s = p.avg("close", bb_period), p.sd("close", bb_period)
    band = p.c(f"CASE WHEN 4 * {s} > 1e-9 THEN (close - {m}) / nullif(2 * {s}, 0) END")
    parts = [p.c(f"CASE WHEN {x} IS NULL THEN 0.0 ELSE least(greatest({x}, -1.0), 1.0) END") for x in (p.c(f"({rsi_(p, rsi_period)} - 50) / 50"), band)]
    return {"": p.c(f"100 * ({parts[0]} + {parts[1]}) / 3")}


# --- pro: momentum

@indicator("pro_momentum", "pro", long=25, short=13, signal=7)
def tsi(p, long, short, signal):
    twice = lambda x: p.ema(p.ema(x, long, "first"), short, "first")
    d = change(p)
    t = p.c(f"100 * {twice(d)} / nullif({twice(f'abs({d})')}, 0)")
    return {"": t, "signal": p.ema(t, signal, "first")}


@indicator("pro_momentum", "pro", k_period=5, k_smooth=3, d_period=3, signal=5)
def smi(p, k_period, k_smooth, d_period, signal):
    """Against the whole range, not half of it."""
    hi, lo = p.max("high", k_period), p.min("low", k_period)
    twice = lambda x: p.ema(p.ema(x, k_smooth, "first"), d_period, "first")
    s = p.c(f"100 * {twice(f'close - ({hi} + {lo}) / 2')} / nullif({twice(f'{hi} - {lo}')}, 0)")
    return {"": s, "signal": p.ema(s, signal, "first")}


@indicator("pro_momentum", "pro", period=14, k=3, d=3)
def stoch_rsi(p, period, k, d):
    """The range of the RSI grows from its first value."""
    r = rsi_(p, period)
    hi, lo = p.max(r, period, growing=True), p.min(r, period, growing=True)
    fast = p.avg(f"CASE WHEN {hi} = {lo} THEN 50.0 ELSE 100 * ({r} - {lo}) / nullif({hi} - {lo}, 0) END", k)
    return {"k": fast, "d": p.avg(fast, d)}


@indicator("pro_momentum", "pro", period=15, signal=9)
def trix(p, period, signal):
    e = p.ema(p.ema(p.ema("close", period, "first"), period, "first"), period, "first")
    t = p.c(f"100 * ({e} / nullif({p.lag(e)}, 0) - 1)")
    return {"": t, "signal": p.ema(t, signal, "first")}


@indicator("pro_momentum", "pro", period=13)
def elder_ray(p, period):
    e = p.ema("close", period, "first")
    return {"bull": p.c(f"high - {e}"), "bear": p.c(f"low - {e}")}


@indicator("pro_momentum", "pro", short=7, mid=14, long=28)
def ultimate_osc(p, short, mid, long):
    """The first bar's close stands for the one before it."""
    c1 = p.c(f"coalesce({p.lag('close')}, close)")
    bp, tr = p.c(f"close - least(low, {c1})"), p.c(f"greatest(high, {c1}) - least(low, {c1})")
    a = [p.ratio(p.sum(bp, n), p.sum(tr, n)) for n in (short, mid, long)]
    return {"": p.c(f"100 * (4 * {a[0]} + 2 * {a[1]} + {a[2]}) / 7")}


@indicator("pro_momentum", "pro", period=14, momentum_period=5)
def rmi(p, period, momentum_period):
    """The RSI of the momentum's changes, one bar late."""
    return {"": p.lag(rsi_(p, period, change(p, "close", momentum_period), momentum_period + 1))}




@indicator("pro_momentum", "pro", period=20, signal=5)
def ergotic(p, period, signal):
    e = p.ema(f"{stoch_(p, period)}", signal, "first")
    return {"": e, "signal": p.avg(e, signal)}


# --- pro: volatility

@indicator("pro_volatility", "pro", period=21, annualize=252)
def hist_vol(p, period, annualize):
    r = p.c(f"ln(close / nullif({p.lag('close')}, 0))")
    return {"": annual(p, f"power({p.window('stddev_samp', r, period)}, 2)", annualize)}


@indicator("pro_volatility", "pro", period=21, annualize=252)
def gk_vol(p, period, annualize): return {"": annual(p, p.avg("greatest(0.5 * power(ln(high / low), 2) - 0.386 * power(ln(close / open), 2), 0)", period), annualize)}  # noqa: E704
@indicator("pro_volatility", "pro", period=21, annualize=252)
def parkinson_vol(p, period, annualize): return {"": annual(p, p.avg(f"power(ln(high / low), 2) / {4 * math.log(2)!r}", period), annualize)}  # noqa: E704


RS = "greatest(ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open), 0)"


@indicator("pro_volatility", "pro", period=21, annualize=252)
def rs_vol(p, period, annualize): return {"": annual(p, p.avg(RS, period), annualize)}  # noqa: E704


@indicator("pro_volatility", "pro", period=21, annualize=252)
def yz_vol(p, period, annualize):
    """Of the opens' and the closes' own changes."""
    k = 0.34 / (1.34 + (period + 1) / (period - 1))
    o, c = (p.window("var_samp", f"ln({x} / nullif({p.lag(x)}, 0))", period) for x in ("open", "close"))
    return {"": annual(p, f"{o} + {k!r} * {c} + {1 - k!r} * {p.avg(RS, period)}", annualize)}


@indicator("pro_volatility", "pro", period=100)
def hurst(p, period): return {"": p.kernel(kernels.hurst, ["close"], 1, period)[0]}  # noqa: E704


# --- pro: volume

@indicator("pro_volume", "pro", fast=34, slow=55, signal=13)
def kvo(p, fast, slow, signal):
    d = change(p, "close + high + low")
    force = p.c(f"CASE WHEN {d} > 0 THEN volume WHEN {d} < 0 THEN -volume WHEN {d} = 0 THEN 0.0 END")
    k = p.c(f"{p.ema(force, fast)} - {p.ema(force, slow)}")
    return {"": k, "signal": p.ema(k, signal)}


@indicator("pro_volume", "pro", period=130, coef=0.2, vcoef=2.5)
def vfi(p, period, coef, vcoef):
    """A move counts if it exceeds coef * sqrt(|change|) / deviation of the changes * close."""
    d, flow = change(p), p.c(f"{change(p, TP)} * volume")
    s = p.sd(d, period)
    cutoff = p.c(f"CASE WHEN {s} > 0 THEN {coef} * sqrt(abs({d})) / nullif({s}, 0) * close WHEN {s} = 0 THEN 0.0 END")
    kept = p.c(f"CASE WHEN abs({flow}) > {cutoff} THEN {flow} WHEN {cutoff} IS NOT NULL THEN 0.0 END")
    return {"": p.c(f"{p.ema(kept, period)} / nullif({p.ema('volume', period)}, 0) * {vcoef}")}


@indicator("pro_volume", "pro", period=13)
def force_index(p, period):
    raw = p.c(f"{change(p)} * volume")
    return {"": p.ema(raw, period), "raw": raw}


@indicator("pro_volume", "pro")
def mfi2(p): return {"": p.c("CASE WHEN high = low THEN 0.0 WHEN volume = 0 THEN (high - low) * 1000000.0 ELSE (high - low) / nullif(volume, 0) * 1000000.0 END")}  # noqa: E704


@indicator("pro_volume", "pro", fast=5, slow=10)
def volume_osc(p, fast, slow):
    if fast >= slow:
        raise ValueError("fast must be below slow")
    return {"": p.c(f"100 * ({p.avg('volume', fast)} - {p.avg('volume', slow)}) / nullif({p.avg('volume', slow)}, 0)")}


@indicator("pro_volume", "pro", period=14)
def emv_v2(p, period):
    emv = p.c(f"{change(p, MID)} / nullif(volume / CASE WHEN high > low THEN high - low ELSE 0.001 END, 0) * 1000000.0")
    return {"": p.avg(emv, period)}


@indicator("pro_volume", "pro", period=20, threshold=1.5)
def volume_regime(p, period, threshold): return {"": p.ratio(f"volume - {p.avg('volume', period)}", p.sd("volume", period))}  # noqa: E704


# --- pro: cycle

@indicator("pro_cycle", "pro", period=7)
def hilbert_sine(p, period):
    sine, lead = p.kernel(kernels.hilbert_sine, ["close"], 2, period)
    return {"": sine, "lead": lead}


@indicator("pro_cycle", "pro", period=14)
def mesa_sine(p, period):
    sine, cosine = p.kernel(kernels.mesa_sine, ["close"], 2, period)
    return {"": sine, "cosine": cosine}


@indicator("pro_cycle", "pro", period=10)
def cg(p, period):
    g = p.c(f"-{p.c(p.dot('close', [float(k) for k in range(period)]))} / nullif({p.sum('close', period)}, 0)")
    return {"": g, "signal": p.avg(g, max(period // 2, 2))}


@indicator("pro_cycle", "pro", period=14)
def phasor(p, period):
    phase, size = p.kernel(kernels.phasor, ["close"], 2, period)
    return {"phase": phase, "magnitude": size}


def range_stats(bars: DataFrame, start: int, end: int) -> DataFrame:
    """Per symbol, over the bars numbered start to end (from 1): percentage change, largest fall from a peak (per cent), mean
    true range (of all bars but a series' first)."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    p = Plan()
    p.out(number="rn", close="close", tr=p.c(f"CASE WHEN rn > 1 THEN {true_range(p)} END"))
    df = p.spark(bars).filter(F.col("number").between(start, end))
    peak = F.max("close").over(W.partitionBy("symbol").orderBy("number").rowsBetween(W.unboundedPreceding, 0))
    first, last = F.min_by("close", "number"), F.max_by("close", "number")
    return df.withColumn("fall", 1 - F.col("close") / F.nullif(peak, F.lit(0.0))).groupBy("symbol").agg(
        F.coalesce(100 * (last / F.nullif(first, F.lit(0.0)) - 1), F.lit(0.0)).alias("pct_change"), F.coalesce(100 * F.max("fall"), F.lit(0.0)).alias("max_drawdown"),
        F.coalesce(F.avg("tr"), F.lit(0.0)).alias("mean_true_range"),
    )
