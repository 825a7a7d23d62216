"""Back-tests: simulation, metrics, parameter search, walk-forward and Monte Carlo validation.

The simulation depends on its own path, so it is one kernel per (symbol, parameter set); everything around it is relational.
Fills are at the close of the signal's bar (``fill='next_open'`` fills at the next open).
"""

from __future__ import annotations

import itertools
import math
import random
import zlib
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import strategies


@dataclass(frozen=True)
class Config:
    cash: float = 100_000.0
    commission: float = 0.0003
    stamp_tax: float = 0.001
    slippage: float = 0.001
    position: float = 1.0
    fill: str = "close"


METRICS = ("total_return", "annual_return", "annual_volatility", "max_drawdown", "max_drawdown_bars", "sharpe", "sortino", "calmar", "win_rate", "profit_loss_ratio", "n_trades", "final_equity")
TRADES = "symbol string, entry_date date, exit_date date, entry_price double, exit_price double, shares double, pnl double, pnl_pct double, holding_days int"
_METRIC_SCHEMA = ", ".join(f"{m} {'long' if m in ('n_trades', 'max_drawdown_bars') else 'double'}" for m in METRICS)


def simulate(open_, close, signal, config: Config) -> tuple[np.ndarray, list[tuple[int, int, float, float, float, float]]]:
    """Equity after each bar, and (entry bar, exit bar, entry price, exit price, shares, profit) of each trade.  The profit
    is after the costs of the sale; what the purchase cost shows in the equity alone.  What is held is sold at the last close."""
    return next(simulate_to(open_, close, signal, config, [len(close)]))


def simulate_to(open_, close, signal, config: Config, ends: list[int]):
    """``simulate`` of the first n bars for each n of ends, ascending: the path is walked once, and at each end what is held
    is sold on a copy."""
    cash, shares, entry, entry_at = config.cash, 0.0, 0.0, 0
    equity, trades = np.empty(len(close)), []
    late = config.fill == "next_open"
    orders = np.concatenate([[0], signal[:-1]]) if late and len(signal) else signal

    def sold(at: int, price: float) -> tuple[float, tuple]:
        got = price * (1 - config.slippage)
        value = shares * got
        costs = value * (config.commission + config.stamp_tax)
        return cash + value - costs, (entry_at, at, entry, got, shares, (got - entry) * shares - costs)

    at = 0
    for end in ends:
        for i, order in enumerate(orders[at:end].tolist(), at):
            price = open_[i] if late else close[i]
            if order > 0 and not shares and price > 0:
                entry, entry_at, spend = price * (1 + config.slippage), i, cash * config.position
                shares = spend / (1 + config.commission) / entry
                cash -= spend
            elif order < 0 and shares:
                cash, trade = sold(i, price)
                trades.append(trade)
                shares = 0.0
            equity[i] = cash + shares * close[i] * (1 - config.slippage)
        at, own, done = end, equity[:end].copy(), list(trades)
        if shares:
            own[-1], trade = sold(end - 1, close[end - 1])
            done.append(trade)
        yield own, done


def metrics(equity: np.ndarray, trades: list, start: float) -> dict[str, float]:
    n = len(equity)
    if n == 0:
        return dict.fromkeys(METRICS, 0.0) | {"n_trades": 0, "max_drawdown_bars": 0, "final_equity": start}
    total = equity[-1] / start - 1
    annual = (1 + total) ** (252 / n) - 1 if total > -1 else -1.0
    peak = np.maximum.accumulate(equity)
    fall = equity / np.where(peak > 0, peak, 1) - 1
    #: A drawdown lasts while no bar exceeds the peak; the first bar counts.
    risen = np.flatnonzero(np.concatenate([[False], equity[1:] > peak[:-1]]))
    longest = int(np.diff(np.concatenate([[-1], risen, [n]])).max() - 1)
    r = np.diff(equity) / np.where(equity[:-1] > 0, equity[:-1], np.inf)
    mean, sd = (float(r.mean()), float(r.std())) if len(r) else (0.0, 0.0)
    bad = r[r < 0]
    down = math.sqrt(float((bad**2).sum()) / len(bad)) if len(bad) else 0.0
    wins, losses = [t[5] for t in trades if t[5] > 0], [-t[5] for t in trades if t[5] <= 0]
    worst = float(fall.min())
    return {
        "total_return": total, "annual_return": annual, "annual_volatility": sd * math.sqrt(252), "max_drawdown": worst, "max_drawdown_bars": longest,
        "sharpe": mean / sd * math.sqrt(252) if sd > 0 else 0.0, "sortino": mean / down * math.sqrt(252) if down > 0 else 0.0,
        "calmar": annual / -worst if worst < 0 else 0.0, "win_rate": len(wins) / len(trades) if trades else 0.0,
        "profit_loss_ratio": float((np.mean(wins) if wins else 0.0) / np.mean(losses)) if losses and np.mean(losses) > 0 else 0.0,
        "n_trades": len(trades), "final_equity": float(equity[-1]),
    }


def _arrays(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("trade_date", kind="stable")
    return pdf, pdf["open"].to_numpy(float), pdf["close"].to_numpy(float), pdf["signal"].fillna(0).to_numpy(float)


def run(bars: DataFrame, strategy: str, config: Config = Config(), **params: float) -> DataFrame:
    """Metrics of each symbol."""
    return _run(strategies.signals(bars, strategy, keep=True, **params), config)


def _run(signals: DataFrame, config: Config) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        symbol = pdf["symbol"].iloc[0]
        _, o, c, s = _arrays(pdf)
        return pd.DataFrame([{"symbol": symbol} | metrics(*simulate(o, c, s, config), config.cash)])

    return signals.select("symbol", "trade_date", "open", "close", "signal").groupBy("symbol").applyInPandas(one, f"symbol string, {_METRIC_SCHEMA}")


def run_with_signals(bars: DataFrame, signals: DataFrame, config: Config = Config()) -> DataFrame:
    """Metrics of each symbol for given signals (symbol, trade_date, signal: above 0 buys, below 0 sells, else and where there
    is none the position is held).  Of several signals of a bar the last by value counts; those without a bar are left out."""
    own = signals.groupBy("symbol", "trade_date").agg(F.max("signal").cast("double").alias("signal"))
    return _run(bars.drop("signal").join(own, ["symbol", "trade_date"], "left"), config)


def run_script(bars: DataFrame, source: str, config: Config = Config()) -> DataFrame:
    """Metrics of each symbol for a script's signals; of a bar with both, the sale counts only while something is held, so it
    is held or bought by the purchase."""
    from ..script.compile import signals

    s = signals(bars, source)
    return run_with_signals(bars, s.select("symbol", "trade_date", F.when(F.col("buy"), 1.0).when(F.col("sell"), -1.0).otherwise(0.0).alias("signal")), config)


def trades(bars: DataFrame, strategy: str, config: Config = Config(), **params: float) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, o, c, s = _arrays(pdf)
        days = pd.to_datetime(pdf["trade_date"]).dt.date.to_list()
        rows = [(pdf["symbol"].iloc[0], days[a], days[b], p, q, n, pnl, q / p - 1, max(1, (days[b] - days[a]).days)) for a, b, p, q, n, pnl in simulate(o, c, s, config)[1]]
        return pd.DataFrame(rows, columns=["symbol", "entry_date", "exit_date", "entry_price", "exit_price", "shares", "pnl", "pnl_pct", "holding_days"])

    s = strategies.signals(bars, strategy, keep=True, **params).select("symbol", F.col("trade_date").cast("date").alias("trade_date"), "open", "close", "signal")
    return s.groupBy("symbol").applyInPandas(one, TRADES)


def equity_curve(bars: DataFrame, strategy: str, config: Config = Config(), sampled: bool = False, **params: float) -> DataFrame:
    """Equity after each bar, or, sampled, of every max(n / 500, 1)-th bar; ``month`` marks every 21st."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, o, c, s = _arrays(pdf)
        out = pd.DataFrame({"symbol": pdf["symbol"], "trade_date": pdf["trade_date"], "bar": np.arange(len(pdf)), "equity": simulate(o, c, s, config)[0]})
        return out[out["bar"] % max(len(out) // 500, 1) == 0] if sampled else out

    s = strategies.signals(bars, strategy, keep=True, **params).select("symbol", "trade_date", "open", "close", "signal")
    return s.groupBy("symbol").applyInPandas(one, "symbol string, trade_date date, bar long, equity double").withColumn("month", F.col("bar") % 21 == 0)


def monthly_returns(bars: DataFrame, strategy: str, config: Config = Config(), **params: float) -> DataFrame:
    """Returns over every 21 bars (not calendar months)."""
    from pyspark.sql import Window as W

    marks = equity_curve(bars, strategy, config, **params).filter("month")
    last = F.lag("equity").over(W.partitionBy("symbol").orderBy("bar"))
    return marks.withColumn("return", F.col("equity") / last - 1).filter("return IS NOT NULL").select("symbol", "trade_date", "return")


# --- parameter search

def grid(values: dict[str, list[float]], most: int = 5000) -> list[dict[str, float]]:
    """All combinations, keys in order; no more than ``most`` iterations of a search."""
    keys = sorted(values)
    return [dict(zip(keys, v, strict=True)) for v in itertools.islice(itertools.product(*(values[k] for k in keys)), most)]


def steps(low: float, high: float, step: float) -> list[float]:
    """low, low + step, ... up to high; the middle where there is no step."""
    return [(low + high) / 2] if step <= 0 else [round(low + k * step, 3) for k in range(int((high - low) / step + 1e-9) + 1)]


SETS_A_PLAN = 25


def evaluate(bars: DataFrame, strategy: str, sets: list[dict[str, float]], config: Config = Config()) -> DataFrame:
    """Metrics of each symbol and parameter set (``param_id``: its place in sets).  The signals of SETS_A_PLAN sets are columns
    of one plan, which one kernel a symbol simulates, so that bars are not repeated for every set."""
    from ..plans.staged import Plan

    def part(first: int) -> DataFrame:
        some = sets[first : first + SETS_A_PLAN]
        p = Plan()
        names = {f"s{i}": first + i for i in range(len(some))}
        p.out(open="open", close="close", **{n: p.c(f"CAST({strategies.formula(p, strategy, **s)} AS DOUBLE)") for n, s in zip(names, some, strict=True)})

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("trade_date", kind="stable")
            o, c = pdf["open"].to_numpy(float), pdf["close"].to_numpy(float)
            return pd.DataFrame([{"symbol": pdf["symbol"].iloc[0], "param_id": k} | metrics(*simulate(o, c, pdf[n].fillna(0).to_numpy(float), config), config.cash) for n, k in names.items()])

        return p.spark(bars).groupBy("symbol").applyInPandas(one, f"symbol string, param_id int, {_METRIC_SCHEMA}")

    found = part(0)
    for first in range(SETS_A_PLAN, len(sets), SETS_A_PLAN):
        found = found.unionByName(part(first))
    return found


def grid_search(bars: DataFrame, strategy: str, values: dict[str, list[float]], target: str = "sharpe", config: Config = Config(), most: int = 5000) -> DataFrame:
    """The best parameter set of each symbol; the first of equal ones wins."""
    sets = grid(values, most)
    best = evaluate(bars, strategy, sets, config).groupBy("symbol").agg(F.max_by(F.struct("param_id", *METRICS), F.struct(F.col(target), -F.col("param_id"))).alias("b"))
    params = F.element_at(F.array(*[F.create_map(*[F.lit(x) for k, v in s.items() for x in (k, float(v))]) for s in sets]), F.col("b.param_id") + 1)
    return best.select("symbol", params.alias("params"), *[F.col(f"b.{m}").alias(m) for m in METRICS])


def genetic_search(bars: DataFrame, strategy: str, bounds: dict[str, tuple[float, float, float]], target: str = "sharpe", population: int = 50, generations: int = 100, elite: int = 5, crossover: float = 0.7, mutation: float = 0.15, patience: int = 50, seed: int = 1, config: Config = Config()) -> tuple[dict[str, float], float]:
    """bounds: low, high and step of each parameter.  Children blend two winners of threes, at times one parameter wanders by
    up to two steps, and all are put on the steps.  One Spark job a generation; fitness is the mean of the target over
    symbols.  The population is small and fixed, and what was evaluated once is kept."""
    rng = random.Random(seed)
    keys = sorted(bounds)
    on_step = lambda k, v: float(min(max(round(v / bounds[k][2]) * bounds[k][2], bounds[k][0]), bounds[k][1]))
    known: dict[tuple[float, ...], float] = {}

    def fitness(people: list[dict[str, float]]) -> list[float]:
        marks = [tuple(x[k] for k in keys) for x in people]
        new = list(dict.fromkeys(m for m in marks if m not in known))
        if new:
            found = {r["param_id"]: r["f"] for r in evaluate(bars, strategy, [dict(zip(keys, m, strict=True)) for m in new], config).groupBy("param_id").agg(F.avg(target).alias("f")).collect()}
            known.update({m: found.get(i, -math.inf) for i, m in enumerate(new)})
        return [known[m] for m in marks]

    people = [{k: on_step(k, rng.choice(steps(*bounds[k]))) for k in keys} for _ in range(population)]
    best, best_fit, idle = people[0], -math.inf, 0
    for _ in range(generations):
        fit = fitness(people)
        ranked = sorted(range(len(people)), key=lambda i: (-fit[i], i))
        if fit[ranked[0]] > best_fit:
            best, best_fit, idle = people[ranked[0]], fit[ranked[0]], 0
        else:
            idle += 1
            if idle >= patience:
                break
        pick = lambda: people[min((rng.choice(ranked) for _ in range(3)), key=ranked.index)]
        new = [people[i] for i in ranked[:elite]]
        while len(new) < population:
            a, b = pick(), pick()
            child = dict(a)
            if rng.random() < crossover:
                child = {k: (share := rng.random()) * a[k] + (1 - share) * b[k] for k in keys}
            if rng.random() < mutation:
                k = rng.choice(keys)
                child[k] += bounds[k][2] * rng.uniform(-2, 2)
            new.append({k: on_step(k, v) for k, v in child.items()})
        people = new
    return best, best_fit


# --- walk-forward

def windows(n: int, in_sample: int = 252, out_sample: int = 63, step: int = 63, anchored: bool = False) -> list[tuple[int, int, int]]:
    """(start, split, end) in bars numbered from 0."""
    out, at = [], 0
    while at + in_sample + out_sample <= n:
        out.append((0 if anchored else at, at + in_sample, at + in_sample + out_sample))
        at += step
    return out


def walk_forward(bars: DataFrame, strategy: str, values: dict[str, list[float]], in_sample: int = 252, out_sample: int = 63, step: int = 63, anchored: bool = False, config: Config = Config()) -> DataFrame:
    """For each symbol and window, the parameter set of the best in-sample Sharpe ratio and both samples' metrics.  Each
    slice is a series of its own, so indicators start cold in it.

    A bar is repeated for the windows that hold it, whose numbers follow from its own: (in_sample + out_sample) / step of them.
    Anchored windows share their beginning, so their in-sample metrics are read off one simulation of the whole series at each
    split, and a bar is repeated for the out-of-sample parts alone."""
    from pyspark.sql import Window as W

    w, whole = W.partitionBy("symbol"), in_sample + out_sample
    at = bars.withColumns({"_i": F.row_number().over(w.orderBy("trade_date")) - 1, "_n": F.count("*").over(w)}).filter(F.col("_n") >= whole)
    reach = out_sample if anchored else whole
    first = F.greatest(F.ceil((F.col("_i") - whole + 1) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("_i") - (whole - reach)) / step), F.floor((F.col("_n") - whole) / step)).cast("int")
    cut = at.filter(first <= last).select("*", F.explode(F.sequence(first, last)).alias("window"))
    inside_part = F.col("_i") < F.col("window") * step + in_sample
    series = cut.withColumn("symbol", F.to_json(F.struct("symbol", "window", F.when(inside_part, "in").otherwise("out").alias("part")))).drop("_i", "_n", "window")
    sets = grid(values)
    done = evaluate(series, strategy, sets, config).withColumn("k", F.from_json("symbol", "symbol string, window int, part string")).drop("symbol").select("k.*", "param_id", *METRICS)
    kept = ("annual_return", "sharpe", "total_return", "max_drawdown")
    within = _anchored(bars, strategy, sets, in_sample, out_sample, step, config) if anchored else done.filter("part = 'in'")
    inside = within.groupBy("symbol", "window").agg(F.max_by(F.struct("param_id", *kept), F.struct(F.col("sharpe"), -F.col("param_id"))).alias("b"))
    inside = inside.select("symbol", "window", "b.param_id", *[F.col(f"b.{m}").alias(f"in_{m}") for m in kept])
    outside = done.filter("part = 'out'").select("symbol", "window", "param_id", *[F.col(m).alias(f"out_{m}") for m in kept])
    chosen = F.element_at(F.array(*[F.create_map(*[F.lit(x) for k, v in s.items() for x in (k, float(v))]) for s in sets]), F.col("param_id") + 1)
    return inside.join(outside, ["symbol", "window", "param_id"]).withColumn("params", chosen)


def _anchored(bars: DataFrame, strategy: str, sets: list[dict[str, float]], in_sample: int, out_sample: int, step: int, config: Config) -> DataFrame:
    """symbol, window, param_id and metrics of the bars before each split."""
    from ..plans.staged import Plan

    def part(first: int) -> DataFrame:
        some = sets[first : first + SETS_A_PLAN]
        p, names = Plan(), {f"s{i}": first + i for i in range(len(some))}
        p.out(open="open", close="close", **{n: p.c(f"CAST({strategies.formula(p, strategy, **own)} AS DOUBLE)") for n, own in zip(names, some, strict=True)})

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("trade_date", kind="stable")
            o, c = pdf["open"].to_numpy(float), pdf["close"].to_numpy(float)
            splits = [split for _, split, _ in windows(len(pdf), in_sample, out_sample, step, True)]
            rows = []
            for n, k in names.items():
                for at, path in enumerate(simulate_to(o, c, pdf[n].fillna(0).to_numpy(float), config, splits)):
                    rows.append({"symbol": pdf["symbol"].iloc[0], "window": at, "param_id": k} | metrics(*path, config.cash))
            return pd.DataFrame(rows, columns=["symbol", "window", "param_id", *METRICS])

        return p.spark(bars).groupBy("symbol").applyInPandas(one, f"symbol string, window int, param_id int, {_METRIC_SCHEMA}")

    found = part(0)
    for first in range(SETS_A_PLAN, len(sets), SETS_A_PLAN):
        found = found.unionByName(part(first))
    return found


def walk_forward_summary(found: DataFrame) -> DataFrame:
    """Of each symbol: windows, mean annual returns and Sharpe ratios inside and outside, their correlation, the mean
    coefficient of variation of the chosen parameters (0 is stable), the efficiency (outside over inside), and a grade:
    excellent, good, fair or warning."""
    g = found.groupBy("symbol").agg(
        F.count("*").alias("windows"), F.avg("in_annual_return").alias("in_return"), F.avg("out_annual_return").alias("out_return"), F.avg("in_sharpe").alias("in_sharpe"), F.avg("out_sharpe").alias("out_sharpe"),
        F.coalesce(F.covar_pop("in_annual_return", "out_annual_return") / F.nullif(F.stddev_pop("in_annual_return") * F.stddev_pop("out_annual_return"), F.lit(0.0)), F.lit(0.0)).alias("correlation"),
    )
    spread = F.stddev_pop("value") / F.when(F.abs(F.avg("value")) > 0.0001, F.abs(F.avg("value"))).otherwise(1.0)
    varied = found.select("symbol", F.explode("params").alias("key", "value")).groupBy("symbol", "key").agg(spread.alias("v")).groupBy("symbol").agg(F.avg("v").alias("variation"))
    g = g.join(varied, "symbol", "left").withColumn("variation", F.coalesce("variation", F.lit(0.0)))
    grade = F.when((F.col("out_sharpe") > 1) & (F.col("variation") < 0.3), "excellent").when((F.col("out_sharpe") > 0.5) & (F.col("variation") < 0.5), "good").when(F.col("out_sharpe") > 0, "fair").otherwise("warning")
    return g.withColumns({"efficiency": F.when(F.abs("in_return") >= 0.0001, F.col("out_return") / F.col("in_return")).otherwise(0.0), "grade": grade})


# --- Monte Carlo

METHODS = ("shuffle", "bootstrap", "parametric")


def share_profits(bars: DataFrame, strategy: str, config: Config = Config(), **params: float) -> DataFrame:
    """symbol, seq, pnl of every closed trade of one share, after slippage and the costs of both sides."""
    pay = lambda t: t["exit_price"] - t["entry_price"] - t["entry_price"] * config.commission - t["exit_price"] * (config.commission + config.stamp_tax)
    from pyspark.sql import Window as W

    t = trades(bars, strategy, config, **params)
    at = F.row_number().over(W.partitionBy("symbol").orderBy("entry_date", "exit_date"))
    return t.select("symbol", at.cast("long").alias("seq"), pay({c: F.col(c) for c in ("entry_price", "exit_price")}).alias("pnl"))


def _path(method: str, r: np.ndarray, profits: np.ndarray, cash: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float]:
    """An equity path, its steps, and the years it stands for."""
    if method == "shuffle":
        x = rng.permutation(profits * rng.uniform(0.8, 1.2, len(profits)))
        return cash + np.cumsum(x), x, max(len(x) * 10 / 252, 0.01)
    x = rng.choice(r, len(r)) if method == "bootstrap" else rng.normal(r.mean(), max(r.std(), 0.0001), len(r))
    return cash * np.cumprod(1 + x), x, max(len(r) / 252, 0.01)


SIMULATED = "symbol string, sim long, final_equity double, max_drawdown double, sharpe double, annual_return double, win_rate double"


def monte_carlo(curves: DataFrame, pnl: DataFrame | None = None, method: str = "shuffle", sims: int = 1000, seed: int = 1, cash: float = 100_000.0, chunk: int = 100) -> DataFrame:
    """Final equity, largest drawdown, Sharpe ratio, annual return and win rate of every simulation of every symbol.

    curves: symbol, bar, equity (a sampled curve: at most about 1000 points a symbol); pnl: symbol, seq, pnl of the trades,
    for ``shuffle``.  Symbols without what a method needs give no rows.  Simulations are dealt in chunks over the cluster;
    each has its own seed.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    series = lambda df, order, value, name: df.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(name))
    work = series(curves, "bar", "equity", "equity")
    work = work.join(series(pnl, "seq", "pnl", "pnl"), "symbol", "left") if pnl is not None else work.withColumn("pnl", F.lit(None).cast("array<double>"))
    work = work.select("symbol", "equity", "pnl", F.explode(F.sequence(F.lit(0), F.lit(sims - 1), F.lit(chunk))).alias("first")).repartition("symbol", "first")

    def run(batches):
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                curve, profits = np.array(t.equity, float), np.array(t.pnl if t.pnl is not None else [], float)
                r = np.diff(curve) / np.where(curve[:-1] > 0, curve[:-1], np.inf)
                if not len(profits if method == "shuffle" else r):
                    continue
                fitted = max(r.std(), 0.0001) if method == "parametric" else None
                for i in range(t.first, min(t.first + chunk, sims)):
                    e, x, years = _path(method, r, profits, cash, np.random.default_rng([seed, i, zlib.crc32(t.symbol.encode())]))
                    peak, sd = np.maximum(np.maximum.accumulate(e), cash), x.std() if fitted is None else fitted
                    mean = x.mean() if fitted is None else r.mean()
                    grown = max(e[-1] / cash, 0.0)
                    rows.append((t.symbol, i, e[-1], min(0.0, float((e / peak - 1).min())), mean / sd * math.sqrt(252) if sd > 0 else 0.0, grown ** (1 / years) - 1, float((x > 0).mean())))
            yield pd.DataFrame(rows, columns=["symbol", "sim", "final_equity", "max_drawdown", "sharpe", "annual_return", "win_rate"])

    return work.mapInPandas(run, SIMULATED)


def monte_carlo_summary(sims: DataFrame, confidence: float = 0.95) -> DataFrame:
    """By symbol: mean and median annual return, the confidence interval of return, drawdown and Sharpe ratio (floor-rank
    percentiles), value at risk at 5 % and the mean of what is not above it, and the shares that profit and that are ruined
    (a drawdown beyond 50 %)."""
    from pyspark.sql import Window as W

    w, tail = W.partitionBy("symbol"), (1 - confidence) / 2
    of = {"return": "annual_return", "dd": "max_drawdown", "sharpe": "sharpe"}
    n = sims.withColumns({f"_{k}": F.row_number().over(w.orderBy(c, "sim")) - 1 for k, c in of.items()} | {"_n": F.count("*").over(w) - 1})
    at = lambda k, q: F.max(F.when(F.col(f"_{k}") == F.floor(F.col("_n") * q + 1e-9), F.col(of[k])))
    g = n.withColumn("_var", F.max(F.when(F.col("_return") == F.floor(F.col("_n") * 0.05 + 1e-9), F.col("annual_return"))).over(w)).groupBy("symbol").agg(
        F.count("*").alias("sims"), F.avg("annual_return").alias("mean_return"), *[at(k, 0.5).alias(f"median_{k}") for k in of],
        *[at(k, q).alias(f"ci_{side}_{k}") for k in of for side, q in (("lower", tail), ("upper", 1 - tail))],
        F.max("_var").alias("var_95"), F.avg(F.when(F.col("annual_return") <= F.col("_var"), F.col("annual_return"))).alias("cvar_95"),
        F.avg((F.col("annual_return") > 0).cast("double")).alias("prob_profit"), F.avg((F.col("max_drawdown") < -0.5).cast("double")).alias("prob_ruin"),
    )
    return g


def with_config(config: Config, **changes) -> Config:
    return replace(config, **changes)


def config_row(config: Config) -> dict:
    return asdict(config)
