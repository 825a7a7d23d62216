"""Candlestick and chart patterns: one long table of symbol, pattern, start_date, end_date, confidence, direction.

Candlestick rules compare a bar's body b and shadows with the mean body of the twenty bars before it (0.01 if there are
none).  All rules of a call share one staged plan; a bar's matches are then stacked from an array, so the bars are shuffled
once.  Chart patterns use swings (extremes of eleven bars, which look ahead) or the last bars of each symbol.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staged import Plan

SCHEMA = "symbol string, pattern string, start_date date, end_date date, confidence double, direction int"


class Bar:
    """Formulas of the bar k bars ago."""

    def __init__(self, p: Plan, k: int):
        self.o, self.h, self.l, self.c = (p.lag(x, k) for x in ("open", "high", "low", "close"))
        self.b = p.c(f"abs({self.c} - {self.o})")
        self.r = p.c(f"{self.h} - {self.l}")
        self.us = p.c(f"{self.h} - greatest({self.o}, {self.c})")
        self.ls = p.c(f"least({self.o}, {self.c}) - {self.l}")
        self.bull, self.bear = f"{self.c} > {self.o}", f"{self.c} < {self.o}"
        self.top, self.bottom = f"greatest({self.o}, {self.c})", f"least({self.o}, {self.c})"
        self.mid = f"(({self.o} + {self.c}) / 2)"
        self.doji = f"({self.r} > 0 AND {self.b} / nullif({self.r}, 0) < 0.1)"
        #: A bar without range counts as one too.
        self.cross = f"{self.b} / greatest({self.r}, {LEAST}) < 0.1"
        self.body = f"greatest({self.b}, {LEAST})"


#: What a body or range counts for at least where it divides.
LEAST = "0.0001"


class Frame:
    def __init__(self, p: Plan):
        self.p = p
        self.avg = p.c(f"coalesce({p.window('avg', 'abs(close - open)', 20, growing=True, end=-1)}, 0.01)")
        self.avg_range = p.c(f"coalesce({p.window('avg', 'high - low', 20, growing=True, end=-1)}, 0.01)")
        self._bars: dict[int, Bar] = {}

    def __getitem__(self, k: int) -> Bar:
        if k not in self._bars:
            self._bars[k] = Bar(self.p, k)
        return self._bars[k]

    def close_to(self, x: str, y: str, share: float) -> str:
        return f"abs({x} - {y}) / greatest({self.avg}, {LEAST}) < {share}"


@dataclass(frozen=True)
class Pattern:
    bars: int
    #: (condition, confidence, direction) alternatives; a bar may match several
    rules: Callable[[Frame], list[tuple[str, str, str]]]


CANDLES: dict[str, Pattern] = {}


def candle(name: str, bars: int, shown: int = 0):
    """bars: how many the rule looks at; shown: how many the match spans, where these are fewer."""

    def add(fn):
        CANDLES[name] = Pattern(shown or bars, lambda f: fn(f, *(f[k] for k in range(bars))))
        return fn

    return add


def two_sided(name: str, bars: int, confidence: str, shown: int = 0):
    """A rule and its mirror image, which sees opens, closes, highs and lows with their roles exchanged."""

    def add(fn):
        candle(name, bars, shown)(lambda f, *b: [(fn(f, *b), confidence, "1"), (fn(f, *map(Mirrored, b)), confidence, "-1")])
        return fn

    return add


class Mirrored:
    """A bar upside down: every price is negated, so that rising is falling and high is low."""

    def __init__(self, bar: Bar):
        self.b, self.r, self.doji, self.cross, self.body = bar.b, bar.r, bar.doji, bar.cross, bar.body
        self.o, self.h, self.l, self.c = (f"(-{x})" for x in (bar.o, bar.l, bar.h, bar.c))
        self.us, self.ls, self.bull, self.bear = bar.ls, bar.us, bar.bear, bar.bull
        self.top, self.bottom, self.mid = f"(-{bar.bottom})", f"(-{bar.top})", f"(-{bar.mid})"


def one_sided(name: str, bars: int, up: bool, confidence: str):
    """The rule if ``up``, else its mirror image."""

    def add(fn):
        candle(name, bars)(lambda f, *b: [(fn(f, *(b if up else map(Mirrored, b))), confidence, "1" if up else "-1")])
        return fn

    return add


def pair(up: str, down: str, bars: int, confidence: str):
    """Registers a rule under one name and its mirror image under another."""

    def add(fn):
        one_sided(up, bars, True, confidence)(fn)
        one_sided(down, bars, False, confidence)(fn)
        return fn

    return add


# --- one bar

@candle("doji", 1)
def _(f, x):
    side = f"CASE WHEN {x.us} > 2 * {x.ls} THEN -1 WHEN {x.ls} > 2 * {x.us} THEN 1 ELSE 0 END"
    return [(x.doji, f"1 - {x.b} / nullif({x.r}, 0)", side)]


def _shadow(f, x, long, short): return f"rn > 1 AND {x.b} > 0.3 * {f.avg} AND {long} > 2 * {x.b} AND {short} < 0.5 * {x.b}"  # noqa: E704
def _length(x, long): return f"least({long} / {x.body}, 5) / 5"  # noqa: E704
def _all(f, test): return "rn > 3 AND " + " AND ".join(f"({test(f[k], f[k + 1])})" for k in (1, 2, 3))  # noqa: E704
def _share(condition): return f"CASE WHEN {condition} THEN 1.0 ELSE 0.6 END"  # noqa: E704


def bulls(f): return _all(f, lambda a, b: a.bull)  # noqa: E704


candle("hammer", 1)(lambda f, x: [(_shadow(f, x, x.ls, x.us), f"{_length(x, x.ls)} * {_share(_all(f, lambda a, b: f'{a.bear} OR {a.c} < {b.c}'))}", "1")])
candle("inv_hammer", 1)(lambda f, x: [(_shadow(f, x, x.us, x.ls), f"{_length(x, x.us)} * {_share(_all(f, lambda a, b: a.bear))}", "1")])
candle("hanging_man", 1)(lambda f, x: [(f"{_shadow(f, x, x.ls, x.us)} AND {bulls(f)}", _length(x, x.ls), "-1")])
candle("shooting_star", 1)(lambda f, x: [(f"{_shadow(f, x, x.us, x.ls)} AND {bulls(f)}", _length(x, x.us), "-1")])
candle("marubozu", 1)(lambda f, x: [(f"{x.r} > 0 AND {x.b} / nullif({x.r}, 0) > 0.9", f"{x.b} / nullif({x.r}, 0)", f"CASE WHEN {x.bull} THEN 1 ELSE -1 END")])
candle("spinning_top", 1)(lambda f, x: [(f"{x.r} > 0 AND {x.b} / nullif({x.r}, 0) < 0.3 AND {x.us} > {x.b} AND {x.ls} > {x.b}", "0.7", "0")])
candle("dragonfly_doji", 1)(lambda f, x: [(f"{x.doji} AND {x.ls} > 0.6 * {x.r} AND {x.us} < 0.1 * {x.r}", "0.85", "1")])
candle("gravestone_doji", 1)(lambda f, x: [(f"{x.doji} AND {x.us} > 0.6 * {x.r} AND {x.ls} < 0.1 * {x.r}", "0.85", "-1")])
candle("long_body", 1)(lambda f, x: [(f"rn > 5 AND {x.b} > 2 * {f.avg}", f"least({x.b} / greatest({f.avg}, {LEAST}) - 1, 1)", f"CASE WHEN {x.bull} THEN 1 ELSE -1 END")])
candle("long_upper", 1)(lambda f, x: [(f"rn > 5 AND {x.us} > 2 * {x.b} AND {x.us} > {x.ls}", f"least({x.us} / {x.body} / 3, 1)", "-1")])
candle("long_lower", 1)(lambda f, x: [(f"rn > 5 AND {x.ls} > 2 * {x.b} AND {x.ls} > {x.us}", f"least({x.ls} / {x.body} / 3, 1)", "1")])


@candle("belt_hold", 1)
def _(f, x):
    size = f"rn > 1 AND {x.b} > 1.5 * {f.avg}"
    return [(f"{size} AND {x.bull} AND {x.ls} < 0.1 * {x.b} AND {x.o} <= 1.01 * {x.l}", "0.75", "1"), (f"{size} AND {x.bear} AND {x.us} < 0.1 * {x.b} AND {x.o} >= 0.99 * {x.h}", "0.75", "-1")]


# --- two bars: x now, y before

@candle("engulfing", 2)
def _(f, x, y):
    size, conf = f"{x.b} > 1.2 * {y.b} AND {y.b} > 0.5 * {f.avg}", f"least({x.b} / {y.body}, 3) / 3"
    return [(f"{y.c} <= {y.o} AND {x.bull} AND {x.o} < {y.c} AND {x.c} > {y.o} AND {size}", conf, "1"), (f"{y.bull} AND {x.c} <= {x.o} AND {x.o} > {y.c} AND {x.c} < {y.o} AND {size}", conf, "-1")]


def _within(x, y): return f"{x.bottom} >= {y.bottom} AND {x.top} <= {y.top}"  # noqa: E704


candle("harami", 2)(lambda f, x, y: [(f"{y.b} > 1.5 * {f.avg} AND {x.b} < 0.5 * {y.b} AND {_within(x, y)}", f"1 - {x.b} / {y.body}", f"CASE WHEN {x.bull} THEN 1 ELSE -1 END")])
candle("harami_cross", 2)(lambda f, x, y: [(f"{y.b} > 1.5 * {f.avg} AND {x.cross} AND {_within(x, y)}", "0.9", f"CASE WHEN {y.bull} THEN -1 ELSE 1 END")])
candle("piercing", 2)(lambda f, x, y: [(f"{y.bear} AND {x.bull} AND {x.o} < {y.l} AND {x.c} > {y.mid} AND {x.c} < {y.o} AND {y.b} > 0.5 * {f.avg}", f"least(({x.c} - {y.mid}) / {y.body} + 0.5, 1)", "1")])
candle("dark_cloud", 2)(lambda f, x, y: [(f"{y.bull} AND {x.bear} AND {x.o} > {y.h} AND {x.c} < {y.mid} AND {x.c} > {y.o} AND {y.b} > 0.5 * {f.avg}", f"least(({y.mid} - {x.c}) / {y.body} + 0.5, 1)", "-1")])
candle("tweezer", 2)(lambda f, x, y: [(f"abs({x.h} - {y.h}) < 0.1 * {f.avg_range}", "0.8", f"CASE WHEN {x.bear} THEN -1 ELSE 0 END"), (f"abs({x.l} - {y.l}) < 0.1 * {f.avg_range}", "0.8", f"CASE WHEN {x.bull} THEN 1 ELSE 0 END")])


def _both(f, x, y, share): return f"{x.b} > {share} * {f.avg} AND {y.b} > {share} * {f.avg}"  # noqa: E704


two_sided("kicking", 2, "0.9")(lambda f, x, y: f"{_both(f, x, y, 1.3)} AND {y.bear} AND {x.bull} AND {x.o} > {y.o}")
one_sided("meeting_lines", 2, True, "0.8")(lambda f, x, y: f"{y.bear} AND {x.bull} AND {_both(f, x, y, 1)} AND {f.close_to(x.c, y.c, 0.1)}")
one_sided("separating_lines", 2, True, "0.75")(lambda f, x, y: f"{y.bear} AND {x.bull} AND {_both(f, x, y, 1)} AND {f.close_to(x.o, y.o, 0.1)}")
one_sided("matching_low", 2, True, "0.7")(lambda f, x, y: f"{y.bear} AND {x.bear} AND {_both(f, x, y, 1)} AND {f.close_to(x.c, y.c, 0.1)}")
for _name, _part, _side in (("on_neck", 0.0, "-1"), ("in_neck", 0.1, "-1"), ("thrusting", 0.3, "1")):
    candle(_name, 2)(lambda f, x, y, part=_part, side=_side: [(f"{y.bear} AND {x.bull} AND {y.b} >= 0.5 * {f.avg} AND {f.close_to(x.c, f'({y.l} + {part} * {y.b})', 0.15)}", "0.65", side)])

# --- three bars: x now, y and z before

two_sided("tasuki_gap", 3, "0.7")(lambda f, x, y, z: f"{z.bull} AND {y.b} > {f.avg} AND {y.bull} AND {y.l} > {z.h} AND {x.bear} AND {x.c} < {y.o} AND {x.c} > {z.c}")
candle("side_by_side_white", 3, 2)(lambda f, x, y, z: [(f"{z.bear} AND {z.b} > {f.avg} AND {y.bull} AND {x.bull} AND {y.h} < {z.l} AND {f.close_to(x.c, y.c, 0.15)} AND {f.close_to(x.o, y.o, 0.15)}", "0.7", "1")])


def _reversal(f, x, z): return f"{z.bear} AND {z.b} > 1.2 * {f.avg} AND {x.bull} AND {x.b} > 1.2 * {f.avg}"  # noqa: E704


pair("morning_star", "evening_star", 3, "0.85")(lambda f, x, y, z: f"{_reversal(f, x, z)} AND {y.b} < 0.6 * {f.avg} AND {y.top} < {z.c} AND {x.c} > {z.mid}")
pair("morning_doji_star", "evening_doji_star", 3, "0.9")(lambda f, x, y, z: f"{_reversal(f, x, z)} AND {y.cross} AND {y.c} < {z.c} AND {x.c} > {z.mid}")


def _march(up: bool):
    def rules(f, *plain):
        x, y, z = plain if up else map(Mirrored, plain)
        steps = " AND ".join(f"{a.c} > {b.c} AND {a.o} > {b.o} AND {a.o} < {b.c}" for a, b in ((x, y), (y, z)))
        size = " AND ".join(f"{v.bull} AND {v.b} > 0.7 * {f.avg}" for v in (x, y, z))
        most, least = (f"{w}({x.b}, {y.b}, {z.b})" for w in ("greatest", "least"))
        return [(f"{size} AND {steps}", f"1 - ({most} - {least}) / greatest({most}, {LEAST})", "1" if up else "-1")]

    return rules


candle("three_white_soldiers", 3)(_march(True))
candle("three_black_crows", 3)(_march(False))
pair("three_inside_up", "three_inside_down", 3, "0.8")(lambda f, x, y, z: f"{z.bear} AND {z.b} > {f.avg} AND {y.bull} AND {y.b} < 0.5 * {z.b} AND {y.bottom} >= {z.c} AND {y.top} <= {z.o} AND {x.bull} AND {x.b} > 2 * {y.b} AND {x.c} > {z.o}")
pair("three_outside_up", "three_outside_down", 3, "0.8")(lambda f, x, y, z: f"{z.bear} AND {z.b} < {f.avg} AND {y.bull} AND {y.b} > 1.5 * {z.b} AND {y.o} < {z.c} AND {y.c} > {z.o} AND {x.bull} AND {x.c} > {y.c}")
two_sided("abandoned_baby", 3, "0.95")(lambda f, x, y, z: f"{_reversal(f, x, z)} AND {y.cross} AND {y.h} < {z.l} AND {x.l} > {y.h}")
candle("tristar", 3)(lambda f, x, y, z: [(f"{z.doji} AND {y.doji} AND {x.doji} AND {y.c} > {z.c} AND {x.c} < {y.c}", "0.8", "-1"), (f"{z.doji} AND {y.doji} AND {x.doji} AND {y.c} < {z.c} AND {x.c} > {y.c}", "0.8", "1")])
one_sided("unique_three_river", 3, True, "0.7")(lambda f, x, y, z: f"{z.bear} AND {z.b} > 1.2 * {f.avg} AND {y.b} < 0.5 * {z.b} AND {x.bull} AND {x.b} < {y.b} AND {x.l} > {y.l}")
one_sided("three_stars_south", 3, True, "0.75")(lambda f, x, y, z: f"{z.bear} AND {z.b} > 1.2 * {f.avg} AND {y.bear} AND {y.b} < {z.b} AND {y.l} < {z.l} AND {x.bear} AND {x.b} < {y.b} AND {x.l} > {y.l}")

# --- more bars, the last first

@candle("squeeze_alert", 4)
def _(f, x, y, z, v):
    tight = f"1 - {x.r} / greatest({v.r}, {LEAST})"
    return [(f"{x.r} < {y.r} AND {y.r} < {z.r} AND {z.r} < {v.r} AND {tight} > 0.5 AND {x.bull}", tight, "1")]


candle("ladder_bottom", 5)(lambda f, x, a, b, c, d: [(f"rn > 5 AND {c.c} < {d.c} AND {b.c} < {c.c} AND {a.c} < {b.c} AND {x.o} > {a.c} AND {x.bull} AND {x.c} > {b.o}", "0.75", "1")])


def _methods(up: bool):
    """A long bar, three small ones against it inside its range, and one beyond it."""

    def rules(f, x, a, b, c, y):
        first, against, last = (y.bull, "bear", f"{x.bull} AND {x.c} > {y.h}") if up else (y.bear, "bull", f"{x.bear} AND {x.c} < {y.l}")
        rest = " AND ".join(f"{getattr(v, against)} AND {v.b} < {f.avg} AND {v.l} > {y.l} AND {v.h} < {y.h}" for v in (a, b, c))
        return [(f"{first} AND {y.b} > 1.2 * {f.avg} AND {rest} AND {last}", "0.85", "1" if up else "-1")]

    return rules


candle("rising_three", 5)(_methods(True))
candle("falling_three", 5)(_methods(False))
candle("mat_hold", 5)(lambda f, x, a, b, c, y: [(f"{y.bull} AND {y.b} >= 1.5 * {f.avg} AND " + " AND ".join(f"{v.b} < {f.avg} AND {v.l} > {y.l} AND {v.h} <= {y.h}" for v in (a, b, c)) + f" AND {x.bull} AND {x.c} > {y.h}", "0.8", "1")])


def candle_plan(names: list[str] | None = None) -> tuple[Plan, list[tuple[str, int, str, str, str]]]:
    """The plan and, for each rule, its pattern, bars, and the columns of condition, confidence and direction."""
    p = Plan()
    f = Frame(p)
    found = []
    for name in names or CANDLES:
        for i, (cond, conf, side) in enumerate(CANDLES[name].rules(f)):
            cols = p.c(f"CASE WHEN {cond} THEN 1 ELSE 0 END"), p.c(conf), p.c(side)
            p.out(**{f"{name}_{i}_{k}": c for k, c in zip(("hit", "conf", "side"), cols, strict=True)})
            found.append((name, CANDLES[name].bars, *(f"{name}_{i}_{k}" for k in ("hit", "conf", "side"))))
    for k in range(5):
        p.out(**{f"start_{k}": p.lag("trade_date", k)})
    return p, found


def candles(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    p, rules = candle_plan(names)
    wide = p.spark(bars)
    match = [F.when(F.col(hit) == 1, F.struct(F.lit(name).alias("pattern"), F.col(f"start_{n - 1}").alias("start_date"), F.col(conf).cast("double").alias("confidence"), F.col(side).cast("int").alias("direction"))) for name, n, hit, conf, side in rules]
    long = wide.select("symbol", F.col("trade_date").alias("end_date"), F.explode(F.filter(F.array(*match), lambda x: x.isNotNull())).alias("m"))
    return long.select("symbol", "m.pattern", "m.start_date", "end_date", "m.confidence", "m.direction")


def candles_sql(base: str, names: list[str] | None = None) -> str:
    p, rules = candle_plan(names)
    wide = p.duck(base, compare=False)
    parts = [f"SELECT symbol, '{name}' AS pattern, start_{n - 1} AS start_date, trade_date AS end_date, CAST({conf} AS DOUBLE) AS confidence, CAST({side} AS INTEGER) AS direction FROM wide WHERE {hit} = 1" for name, n, hit, conf, side in rules]
    return f"WITH wide AS ({wide}) {' UNION ALL '.join(parts)}"


# --- chart patterns

SWING, TOLERANCE, NEAREST, FARTHEST = 5, 0.03, 8, 60


#: Spans of 2, 4, ... bars; two of them cover any span up to FARTHEST.
LEVELS = FARTHEST.bit_length() - 1


def _swings(bars: DataFrame) -> DataFrame:
    """Swing points of both kinds (``top``), with the next two of their kind (price, number, date, extreme close after it).

    For the necklines each bar knows the lowest low and the highest high of the 1, 2, 4, ... bars up to it and from it on, every
    level made of two of the level below; ``ends`` and ``starts`` are those of the opposite side, and the extreme of the bars
    from one swing to another is that of two of them."""
    by = W.partitionBy("symbol")
    w = by.orderBy("trade_date")
    around = w.rowsBetween(-SWING, SWING)
    #: What follows is found in reversed order, where the frame only grows.
    after = by.orderBy(F.desc("trade_date")).rowsBetween(W.unboundedPreceding, -1)
    df = bars.select("symbol", "trade_date", "high", "low", "close").withColumns({"l_after": F.min("close").over(after), "h_after": F.max("close").over(after)})
    df = df.withColumns({"rn": F.row_number().over(w), "n": F.count("*").over(by), "h_best": F.max("high").over(around), "l_best": F.min("low").over(around), "full": F.count("*").over(around)})
    df = df.withColumns({f"{c}{side}0": F.col(name) for c, name in (("h", "high"), ("l", "low")) for side in ("b", "f")})
    for k in range(LEVELS):
        pick = lambda c, x, y: (F.greatest if c == "h" else F.least)(x, y)
        df = df.withColumns({f"{c}b{k + 1}": pick(c, F.col(f"{c}b{k}"), F.lag(f"{c}b{k}", 1 << k).over(w)) for c in "hl"} | {f"{c}f{k + 1}": pick(c, F.col(f"{c}f{k}"), F.lead(f"{c}f{k}", 1 << k).over(w)) for c in "hl"})
    levels = lambda c: F.array(*[F.col(f"{c}{k}") for k in range(LEVELS + 1)])
    point = lambda top: F.when(
        F.col("high" if top else "low") == F.col("h_best" if top else "l_best"),
        F.struct(F.lit(top).alias("top"), F.col("high" if top else "low").alias("price"), F.col("l_after" if top else "h_after").alias("later"), levels("lf" if top else "hf").alias("starts"), levels("lb" if top else "hb").alias("ends")),
    )
    points = df.filter(F.col("full") == 2 * SWING + 1).select("symbol", "trade_date", "rn", "n", F.explode(F.filter(F.array(point(True), point(False)), lambda x: x.isNotNull())).alias("p"))
    points = points.select("symbol", "trade_date", "rn", "n", "p.*")
    kind = W.partitionBy("symbol", "top").orderBy("trade_date")
    return points.withColumns({f"{c}{k}": F.lead(c, k).over(kind) for k in (1, 2) for c in ("trade_date", "rn", "price", "later", "ends")})


def _neckline(last: int) -> Column:
    """The opposite extreme of the bars from a swing to the last-th after it."""
    level = F.floor(F.log2(F.col(f"rn{last}") - F.col("rn") + 1)).cast("int") + 1
    a, b = F.get("starts", level - 1), F.get(f"ends{last}", level - 1)
    return F.when(F.col("top"), F.least(a, b)).otherwise(F.greatest(a, b))


def _apart(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest((a + b) / 2, F.lit(0.01))


def swing_patterns(bars: DataFrame) -> DataFrame:
    """Double tops and bottoms, and head and shoulders, upright and inverse."""
    top, a, b, c = F.col("top"), F.col("price"), F.col("price1"), F.col("price2")
    broken = lambda last: F.when(top, F.col(f"later{last}") < _neckline(last)).otherwise(F.col(f"later{last}") > _neckline(last))
    twice = (F.col("n") >= 40) & (F.col("rn1") - F.col("rn")).between(NEAREST, FARTHEST) & (_apart(a, b) < TOLERANCE) & broken(1)
    middle = (a + c) / 2
    tall = F.when(top, (b > a) & (b > c) & (b >= 1.02 * middle)).otherwise((b < a) & (b < c) & (b <= 0.98 * middle))
    head = (F.col("n") >= 60) & (F.col("rn2") - F.col("rn") <= FARTHEST) & (_apart(a, c) <= 0.05) & tall & broken(2)
    side = F.when(top, -1).otherwise(1)
    match = [F.when(cond, F.struct(F.when(top, up).otherwise(down).alias("pattern"), F.col(f"trade_date{last}").alias("end_date"), F.lit(conf).alias("confidence"), side.alias("direction"))) for cond, up, down, last, conf in ((twice, "double_top", "double_bottom", 1, 0.8), (head, "head_shoulders", "inv_head_shoulders", 2, 0.75))]
    found = _swings(bars).select("symbol", F.col("trade_date").alias("start_date"), F.explode(F.filter(F.array(*match), lambda x: x.isNotNull())).alias("m"))
    return found.select("symbol", "m.pattern", "start_date", "m.end_date", "m.confidence", "m.direction")


def last_bars(bars: DataFrame) -> DataFrame:
    """Patterns of the last bars of each symbol: one row a symbol with the aggregates that the rules need; bars are numbered
    from the last, k = 1."""
    by = W.partitionBy("symbol")
    t = bars.withColumns({"k": F.row_number().over(by.orderBy(F.desc("trade_date"))), "n": F.count("*").over(by)}).filter("k <= 40")
    #: The window of the triangles: the last 30 bars, or all if there are fewer.
    size = F.least("n", F.lit(30))
    span = lambda lo, hi: F.col("k").between(lo, hi)
    hi, lo = (lambda a, b: F.max(F.when(span(a, b), F.col("high")))), (lambda a, b: F.min(F.when(span(a, b), F.col("low"))))
    avg = lambda c, a, b: F.avg(F.when(span(a, b), F.col(c)))
    sd = lambda c, a, b: F.stddev_pop(F.when(span(a, b), F.col(c)))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("close")))
    day = lambda k: F.max(F.when(F.col("k") == k, F.col("trade_date")))
    t = t.withColumn("range", F.col("high") - F.col("low"))
    g = t.groupBy("symbol").agg(
        F.max("n").alias("n"), *[day(k).alias(f"d{k}") for k in (1, 20, 25, 35, 40)], day(size).alias("d30"),
        hi(size - 9, size).alias("h_first"), hi(1, 10).alias("h_last"), lo(size - 9, size).alias("l_first"), lo(1, 10).alias("l_last"),
        at(20).alias("c20"), at(10).alias("c10"), avg("range", 1, 10).alias("tail_range"),
        avg("high", 1, 20).alias("h_mean"), avg("low", 1, 20).alias("l_mean"), sd("high", 1, 20).alias("h_sd"), sd("low", 1, 20).alias("l_sd"),
        avg("close", 21, 35).alias("cup_left"), avg("close", 6, 20).alias("cup_right"), F.min(F.when(span(6, 35), F.col("close"))).alias("cup_low"),
        hi(16, 20).alias("h20_first"), hi(1, 5).alias("h20_last"), lo(16, 20).alias("l20_first"), lo(1, 5).alias("l20_last"),
        avg("range", 16, 25).alias("left_range"), avg("range", 1, 15).alias("right_range"),
        avg("close", 21, 40).alias("round_left"), avg("close", 1, 20).alias("round_right"), F.min("close").alias("round_low"), F.max_by("k", F.struct(-F.col("close"), "k")).alias("round_at"),
    )
    dh, dl, wide = F.col("h_last") - F.col("h_first"), F.col("l_last") - F.col("l_first"), F.abs(F.col("h_first") - F.col("l_first"))
    narrowing = F.greatest(F.least((dl - dh) / F.greatest(wide, F.lit(0.01)), F.lit(1.0)), F.lit(0.5))
    pole = (F.col("c10") - F.col("c20")) / F.greatest("c20", F.lit(0.01))
    flag, box = (F.abs(pole) >= 0.05) & (F.col("tail_range") >= 0.01), F.col("h_mean") - F.col("l_mean")
    rims = lambda a, b, share: F.abs(F.col(a) - F.col(b)) / F.greatest(F.col(a), F.lit(0.01)) < share
    rules = [
        ("asc_triangle", 20, 30, (dh < 0.05 * wide) & (dl > 0.05 * wide), narrowing, F.lit(1)), ("desc_triangle", 20, 30, (dl > -0.05 * wide) & (dh < -0.05 * wide), narrowing, F.lit(-1)),
        ("sym_triangle", 20, 30, (dh < -0.03 * wide) & (dl > 0.03 * wide), narrowing, F.lit(0)),
        ("flag", 30, 20, flag, F.lit(0.65), F.when(pole > 0, 1).otherwise(-1)), ("wedge", 30, 20, flag, F.lit(0.65), F.when(pole > 0, 1).otherwise(-1)),
        ("rectangle", 20, 20, (F.col("h_sd") < 0.2 * box) & (F.col("l_sd") < 0.2 * box) & (box > 0.01), F.lit(0.6), F.lit(0)),
        ("cup_handle", 40, 35, rims("cup_left", "cup_right", 0.05) & (F.col("cup_low") < 0.85 * F.col("cup_left")), F.lit(0.6), F.lit(1)),
        ("lsd_top", 20, 20, (F.col("h20_last") > F.col("h20_first")) & (F.col("l20_last") < F.col("l20_first")), F.lit(0.55), F.lit(-1)),
        ("diamond", 30, 25, (F.col("left_range") > 0.01) & (F.col("right_range") < 0.6 * F.col("left_range")), F.lit(0.5), F.lit(-1)),
        ("rounding_bottom", 40, 40, F.col("round_at").between(6, 34) & (F.col("round_low") < 0.85 * F.col("round_left")) & rims("round_left", "round_right", 0.08), F.lit(0.6), F.lit(1)),
    ]
    match = [F.when(cond & (F.col("n") >= n), F.struct(F.lit(name).alias("pattern"), F.col(f"d{back}").alias("start_date"), conf.cast("double").alias("confidence"), side.cast("int").alias("direction"))) for name, n, back, cond, conf, side in rules]
    long = g.select("symbol", F.col("d1").alias("end_date"), F.explode(F.filter(F.array(*match), lambda x: x.isNotNull())).alias("m"))
    return long.select("symbol", "m.pattern", "m.start_date", "end_date", "m.confidence", "m.direction")


CHARTS = ("double_top", "double_bottom", "head_shoulders", "inv_head_shoulders", "asc_triangle", "desc_triangle", "sym_triangle", "flag", "wedge", "rectangle", "cup_handle", "lsd_top", "diamond", "rounding_bottom")


def charts(bars: DataFrame) -> DataFrame:
    return last_bars(bars).unionByName(swing_patterns(bars))


def names() -> list[str]:
    return [*CANDLES, *CHARTS]


def scan(bars: DataFrame) -> DataFrame:
    """All patterns, candlestick and chart; order by confidence for a report."""
    return candles(bars).unionByName(charts(bars))


def signal(bars: DataFrame, name: str) -> DataFrame:
    """Each bar with +1, -1 or 0.5 (neutral) where the pattern ends there, else 0."""
    found = candles(bars, [name]) if name in CANDLES else charts(bars).filter(F.col("pattern") == name)
    #: Of two alternatives of one bar the second one stands; only tweezers have such, tops before bottoms.
    hits = found.groupBy("symbol", F.col("end_date").alias("trade_date")).agg(F.max("direction").alias("d"))
    value = F.when(F.col("d") == 0, 0.5).otherwise(F.coalesce(F.col("d").cast("double"), F.lit(0.0)))
    return bars.select("symbol", "trade_date").join(hits, ["symbol", "trade_date"], "left").select("symbol", "trade_date", value.alias("signal"))
