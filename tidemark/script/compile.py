"""Compiles parsed scripts to staged plans.

Truth is a value above 0.5; comparisons give 1.0 or 0.0; dividing by less than 1e-12 gives 0; ``==`` has a tolerance of 1e-10.
Averages and deviations wait until their window is full (or the series ends, if it is shorter); ``hhv``, ``llv``, ``sum`` and
the counting functions grow from the first bar.  Names and functions are case-insensitive; ``ref(x, k)`` and ``x[k]`` look
back k bars.  Functions of bars (``cci``, ``kdj``, ``atr``, ``cdl_...``) take the series they use as arguments, or those of
the bars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import indicators as ind
from ..plans.staged import Plan
from .parser import ScriptError, parse

FIELDS = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vol": "volume", "amt": "amount"} | {k: k for k in ("open", "high", "low", "close", "volume", "amount", "turnover")}


def flag(x: str) -> str:
    return f"CASE WHEN {x} THEN 1.0 ELSE 0.0 END"


class Compiler:
    def __init__(self):
        self.p = Plan()
        self.names: dict[str, str | dict[str, str]] = dict(FIELDS)

    def value(self, e: tuple) -> str:
        v = self.any(e)
        return next(iter(v.values())) if isinstance(v, dict) else v

    def any(self, e: tuple) -> str | dict[str, str]:
        p, kind = self.p, e[0]
        if kind == "number":
            return p.c(f"CAST({e[1]!r} AS DOUBLE)")
        if kind == "name":
            if e[1] not in self.names:
                raise ScriptError(f"unknown name {e[1]!r}")
            return self.names[e[1]]
        if kind == "call":
            return self.call(e[1], e[2])
        if kind == "field":
            v = self.any(e[1])
            if not isinstance(v, dict) or e[2] not in v:
                raise ScriptError(f"no field {e[2]!r}")
            return v[e[2]]
        if kind == "ref":
            return p.lag(self.value(e[1]), self.whole(e[2]))
        if kind == "not":
            return p.c(flag(f"NOT coalesce({self.value(e[1])}, 0) > 0.5"))
        if kind == "neg":
            return p.c(f"-({self.value(e[1])})")
        a, b = self.value(e[1]), self.value(e[2])
        if kind in ("+", "-", "*"):
            return p.c(f"{a} {kind} {b}")
        if kind == "/":
            return p.c(f"CASE WHEN abs({b}) <= 1e-12 THEN 0.0 ELSE {a} / nullif({b}, 0) END")
        if kind == "%":
            return p.c(f"{a} % nullif({b}, 0)")
        if kind == "pow":
            return p.c(f"power({a}, {b})")
        if kind in ("<", ">", "<=", ">="):
            return p.c(flag(f"{a} {kind} {b}"))
        if kind in ("==", "!="):
            return p.c(flag(f"abs({a} - {b}) {'<' if kind == '==' else '>='} 1e-10"))
        x, y = f"coalesce({a}, 0) > 0.5", f"coalesce({b}, 0) > 0.5"
        return p.c(flag({"and": f"{x} AND {y}", "or": f"{x} OR {y}", "xor": f"({x} AND NOT {y}) OR (NOT {x} AND {y})"}[kind]))

    def whole(self, e: tuple) -> int:
        """A constant whole number."""
        if e[0] == "neg":
            return -self.whole(e[1])
        if e[0] != "number":
            raise ScriptError("a period must be a number")
        return int(e[1])

    def call(self, name: str, args: list[tuple]) -> str | dict[str, str]:
        if name not in FUNCTIONS:
            raise ScriptError(f"unknown function {name!r}")
        fn, kinds = FUNCTIONS[name]
        made = []
        if kinds[:1] and kinds[0].startswith("x=") and args and args[0][0] == "number":
            #: Constants alone: the series are those of the bars.
            made = [k.split("=")[1] for k in kinds if k[0] == "x"]
            kinds = tuple(k for k in kinds if k[0] == "n")
        for i, k in enumerate(kinds):
            optional = "=" in k
            if i >= len(args):
                if not optional:
                    raise ScriptError(f"{name} needs more arguments")
                made.append(int(k.split("=")[1]) if k[0] == "n" else k.split("=")[1])
            else:
                made.append(self.whole(args[i]) if k[0] == "n" else self.value(args[i]))
        return fn(self.p, *made)


def _cross(p, x, y, up): return _under(p, x, y) if up <= 0 else p.c(flag(f"{p.lag(x)} <= {p.lag(y)} AND {x} > {y}"))  # noqa: E704
def _under(p, x, y): return p.c(flag(f"{p.lag(x)} >= {p.lag(y)} AND {x} < {y}"))  # noqa: E704
def _truth(p, x): return p.c(flag(f"{x} > 0.5"))  # noqa: E704


def _full(p, function, x, n):
    """Over n values, none missing; a shorter series gives its last bar's."""
    frame = p.frame(1 - n)
    whole = p.c(f"least({n}, count(*) OVER (PARTITION BY {p.key}))")
    return p.c(f"CASE WHEN rn >= {whole} AND {p.over(f'count({x})', frame)} = least(rn, {n}) THEN {p.over(f'{function}({x})', frame)} END")


def _rsi(p, x, n):
    d = p.c(f"coalesce({x} - {p.lag(x)}, 0.0)")
    up, down = p.rma(f"CASE WHEN rn > 1 THEN greatest({d}, 0.0) END", n), p.rma(f"CASE WHEN rn > 1 THEN greatest(-{d}, 0.0) END", n)
    return p.c(f"CASE WHEN rn <= {n + 1} THEN 50.0 WHEN {down} > 0 THEN 100 - 100 / (1 + {up} / nullif({down}, 0)) ELSE 100.0 END")


def _macd(p, x, f, s, g):
    dif = p.c(f"{p.ema(x, f, 'first')} - {p.ema(x, s, 'first')}")
    dea = p.ema(dif, g, "first")
    return {"dif": dif, "dea": dea, "hist": p.c(f"2 * ({dif} - {dea})")}


def _kdj(p, high, low, close, n, m1, m2):
    hi, lo = p.max(high, n, growing=True), p.min(low, n, growing=True)
    rsv = p.c(f"CASE WHEN rn = 1 OR abs({hi} - {lo}) <= 1e-12 THEN 50.0 ELSE 100 * ({close} - {lo}) / nullif({hi} - {lo}, 0) END")
    k = p.recur(rsv, repr(1 / max(m1, 1)), repr(1 - 1 / max(m1, 1)), 50.0)
    d = p.recur(k, repr(1 / max(m2, 1)), repr(1 - 1 / max(m2, 1)), 50.0)
    return {"k": k, "d": d, "j": p.c(f"3 * {k} - 2 * {d}")}


def _wma(p, x, n):
    return p.dot(x, [(n - k) * 2 / (n * (n + 1)) for k in range(n)])


def _hma(p, x, n):
    """What is not there yet of the difference counts 0, as defined."""
    if n < 2:
        return p.c(f"0.0 * {x}")
    return _wma(p, p.c(f"coalesce(2 * {_wma(p, x, n // 2)} - {_wma(p, x, n)}, 0.0)"), int(n**0.5))


def _cci(p, high, low, close, n):
    tp = p.c(f"({high} + {low} + {close}) / 3")
    m = p.avg(tp, n)
    apart = ind.mean_abs(p, tp, m, n)
    return p.c(f"CASE WHEN {apart} > 1e-12 THEN ({tp} - {m}) / nullif(0.015 * {apart}, 0) END")


def _atr(p, high, low, close, n):
    c1 = p.lag(close)
    return p.rma(f"CASE WHEN rn = 1 THEN {high} - {low} ELSE greatest({high} - {low}, abs({high} - {c1}), abs({low} - {c1})) END", n, "first")


def _obv(p, close, volume):
    return p.cum(f"CASE WHEN rn = 1 OR {close} > {p.lag(close)} THEN {volume} WHEN {close} < {p.lag(close)} THEN -{volume} ELSE 0.0 END")


def _zscore(p, x, n):
    sd = _full(p, "stddev_pop", x, n)
    return p.c(f"CASE WHEN {sd} > 1e-12 THEN ({x} - {_full(p, 'avg', x, n)}) / nullif({sd}, 0) END")


def _bands(side: int): return lambda p, x, n, k: p.c(f"{_full(p, 'avg', x, n)} + {side} * {k} * {_full(p, 'stddev_pop', x, n)}")  # noqa: E704
def _bars_last(p, c): return p.c(f"rn - coalesce({p.over(f'max(CASE WHEN {c} > 0.5 THEN rn END)', p.frame(None))}, 1)")  # noqa: E704
def _bars_since(p, c): return p.c(f"coalesce(rn - {p.over(f'min(CASE WHEN {c} > 0.5 THEN rn END)', p.frame(None))}, 0)")  # noqa: E704
def _candle(name): return lambda p: ind.REGISTRY[f"cdl_{name}"].fn(p)[""]  # noqa: E704
def _growing(name): return lambda p, x, n: getattr(p, name)(x, n, growing=True)  # noqa: E704
def _whole(name): return lambda p, x, n: _full(p, name, x, n)  # noqa: E704
def _row(template: str): return lambda p, *a: p.c(template.format(*a))  # noqa: E704


def _shape(test: str):
    """A candle of one bar: b its body, r its range, and its shadows up and down."""

    def fn(p, o, h, low, c):
        parts = {"b": f"abs({c} - {o})", "r": f"({h} - {low})", "down": f"(least({o}, {c}) - {low})", "up": f"({h} - greatest({o}, {c}))"}
        return p.c(flag(f"{parts['r']} > 1e-12 AND {test.format(**parts)}"))

    return fn


def _engulfing(p, o, h, low, c):
    """Beyond the whole range of the bar before."""
    o1, h1, l1, c1 = (p.lag(x) for x in (o, h, low, c))
    size = f"abs({c} - {o}) > abs({c1} - {o1})"
    return p.c(f"CASE WHEN {c1} < {o1} AND {c} > {o} AND {size} AND {o} < {l1} AND {c} > {h1} THEN 1.0 WHEN {c1} > {o1} AND {c} < {o} AND {size} AND {o} > {h1} AND {c} < {l1} THEN -1.0 ELSE 0.0 END")


def _cool(p, x, n):
    return p.kernel(kernels.cool_down, [x], 1, n)[0]


#: name -> (function, kinds of its arguments: x a series, n a constant, with =default)
FUNCTIONS: dict[str, tuple[Callable, tuple[str, ...]]] = {}


def _add(names: str, fn: Callable, *kinds: str) -> None:
    for name in names.split():
        FUNCTIONS[name] = fn, kinds


_BARS = ("x=high", "x=low", "x=close")
_add("sma ma simple_ma", _whole("avg"), "x", "n=20")
_add("ema", lambda p, x, n: p.ema(x, n, "first"), "x", "n=20")
_add("wma", _wma, "x", "n=20")
_add("rma", lambda p, x, n: p.rma(x, n, "first"), "x", "n=20")
_add("hma", _hma, "x", "n=20")
_add("stdev std", _whole("stddev_pop"), "x", "n=20")
_add("variance var", _whole("var_pop"), "x", "n=20")
_add("zscore", _zscore, "x", "n=20")
_add("rsi", _rsi, "x", "n=14")
_add("macd", _macd, "x", "n=12", "n=26", "n=9")
_add("macd_dif", lambda p, *a: _macd(p, *a)["dif"], "x", "n=12", "n=26", "n=9")
_add("macd_dea", lambda p, *a: _macd(p, *a)["dea"], "x", "n=12", "n=26", "n=9")
_add("macd_hist", lambda p, *a: _macd(p, *a)["hist"], "x", "n=12", "n=26", "n=9")
_add("kdj", _kdj, *_BARS, "n=9", "n=3", "n=3")
_add("kdj_k", lambda p, *a: _kdj(p, *a)["k"], *_BARS, "n=9", "n=3", "n=3")
_add("kdj_d", lambda p, *a: _kdj(p, *a)["d"], *_BARS, "n=9", "n=3", "n=3")
_add("kdj_j", lambda p, *a: _kdj(p, *a)["j"], *_BARS, "n=9", "n=3", "n=3")
_add("cci", _cci, *_BARS, "n=14")
_add("mfi", lambda p, n: ind.mfi(p, n)[""], "n=14")
_add("atr", _atr, *_BARS, "n=14")
_add("adx", lambda p, n: ind.adx(p, n)[""], "n=14")
_add("bb_upper bbands_upper", _bands(1), "x", "n=20", "n=2")
_add("bb_middle bbands_middle", _bands(0), "x", "n=20", "n=2")
_add("bb_lower bbands_lower", _bands(-1), "x", "n=20", "n=2")
_add("obv", _obv, "x=close", "x=volume")
_add("cross cross_over crossover", _cross, "x", "x", "n=1")
_add("crossunder cross_under", _under, "x", "x")
_add("ref shift", lambda p, x, n: p.lag(x, n), "x", "n")
_add("hhv highest", _growing("max"), "x", "n=20")
_add("llv lowest", _growing("min"), "x", "n=20")
_add("sum", _growing("sum"), "x", "n=20")
_add("barslast", _bars_last, "x")
_add("barssince", _bars_since, "x")
_add("count", lambda p, x, n: p.sum(_truth(p, x), n, growing=True), "x", "n=20")
_add("every", lambda p, x, n: p.min(_truth(p, x), n, growing=True), "x", "n=20")
_add("exist", lambda p, x, n: p.max(_truth(p, x), n, growing=True), "x", "n=20")
_add("filter", _cool, "x", "n=5")
_add("abs", _row("abs({0})"), "x")
_add("max", _row("greatest({0}, {1})"), "x", "x")
_add("min", _row("least({0}, {1})"), "x", "x")
_add("pow", _row("power({0}, {1})"), "x", "x")
_add("sqrt", _row("CASE WHEN {0} >= 0 THEN sqrt(greatest({0}, 0)) END"), "x")
_add("log", _row("CASE WHEN {0} > 0 THEN log10(nullif(greatest({0}, 0), 0)) END"), "x")
_add("ln", _row("CASE WHEN {0} > 0 THEN ln(nullif(greatest({0}, 0), 0)) END"), "x")
for _name in ("exp", "round", "ceil", "floor", "sin", "cos", "tan"):
    _add(_name, _row(f"CAST({_name}({{0}}) AS DOUBLE)"), "x")
_add("sign", _row("CASE WHEN {0} > 0 THEN 1.0 WHEN {0} < 0 THEN -1.0 WHEN {0} = 0 THEN 0.0 END"), "x")
_add("if iff", _row("CASE WHEN {0} > 0.5 THEN {1} ELSE {2} END"), "x", "x", "x")
_add("between", _row("CASE WHEN {0} BETWEEN least({1}, {2}) AND greatest({1}, {2}) THEN 1.0 ELSE 0.0 END"), "x", "x", "x")
_add("range", _row("CASE WHEN {0} > least({1}, {2}) AND {0} < greatest({1}, {2}) THEN 1.0 ELSE 0.0 END"), "x", "x", "x")
_add("roc", lambda p, x, n: p.c(f"CASE WHEN abs({p.lag(x, n)}) > 1e-12 THEN 100 * ({x} - {p.lag(x, n)}) / nullif({p.lag(x, n)}, 0) END"), "x", "n=20")
_add("percent_return", lambda p, x, n: p.c(f"coalesce(100 * ({x} / nullif({p.lag(x, n)}, 0) - 1), 0.0)"), "x", "n=1")
_add("drawdown", lambda p, x: p.c(f"coalesce({x} / nullif({p.cum(x, 'max')}, 0) - 1, 0.0)"), "x")
_OHLC = ("x=open", "x=high", "x=low", "x=close")
_add("cdl_doji", _shape("{b} / nullif({r}, 0) < 0.1"), *_OHLC)
_add("cdl_hammer", _shape("{b} < 0.3 * {r} AND {down} > 2 * {b}"), *_OHLC)
_add("cdl_shooting_star", _shape("{b} < 0.3 * {r} AND {up} > 2 * {b}"), *_OHLC)
_add("cdl_engulfing", _engulfing, *_OHLC)
for _name in ("marubozu", "harami", "morning_star", "evening_star", "three_white_soldiers"):
    _add(f"cdl_{_name}", lambda p, *_, name=_name: _candle(name)(p), *_OHLC)


def compile_script(source: str) -> Plan:
    """A plan with a column for each output."""
    c = Compiler()
    for kind, name, e in parse(source):
        v = c.any(e)
        c.names[name] = v
        if kind == "plot":
            c.p.out(**({name: v} if isinstance(v, str) else {f"{name}_{k}": x for k, x in v.items()}))
    return c.p


def execute(bars: DataFrame, source: str) -> DataFrame:
    return compile_script(source).spark(bars)


def signals(bars: DataFrame, source: str) -> DataFrame:
    """buy and sell from the outputs' names: buy, long, entry, signal (without sell); sell, short, exit."""
    p = compile_script(source)
    sells = [n for n in p.outputs if any(k in n for k in ("sell", "short", "exit"))]
    buys = [n for n in p.outputs if n not in sells and any(k in n for k in ("buy", "long", "entry", "signal"))]
    any_ = lambda names: F.coalesce(F.greatest(*[F.col(n) for n in names], F.lit(0.0)), F.lit(0.0)) > 0.5 if names else F.lit(False)
    return p.spark(bars).select("symbol", "trade_date", any_(buys).alias("buy"), any_(sells).alias("sell"))
