"""Portfolio and risk measures.  Series are joined on their dates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels

YEAR, RISK_FREE, CHUNK = 252, 0.02, 4096


def returns(bars: DataFrame, log: bool = True) -> DataFrame:
    """symbol, trade_date, r; 0 after a price that is not above 0."""
    before = F.lag("close").over(W.partitionBy("symbol").orderBy("trade_date"))
    ratio = F.col("close") / F.nullif(before, F.lit(0.0))
    r = F.when(before > 0, F.ln(ratio) if log else ratio - 1).when(before.isNotNull(), 0.0)
    return bars.select("symbol", "trade_date", r.alias("r")).filter("r IS NOT NULL")


def metrics(r: DataFrame) -> DataFrame:
    """Of each symbol: n, total (compounded) and annual return, volatility, Sharpe and Sortino (over all n) ratios above 2 %,
    additive drawdown, value at risk (floor rank) and the mean of the returns of lower rank at 5 and 1 %, Calmar ratio, days
    up and down, best and worst day."""
    w = W.partitionBy("symbol")
    day = w.orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    x = r.withColumns({"i": F.row_number().over(w.orderBy("r", "trade_date")) - 1, "n": F.count("*").over(w), "sum": F.sum("r").over(day)})
    x = x.withColumn("fall", F.greatest(F.max("sum").over(day), F.lit(0.0)) - F.col("sum"))
    cut = lambda q: F.floor(F.col("n") * q)
    value = lambda q: F.max(F.when(F.col("i") == cut(q), F.col("r")))
    tail = lambda q: F.coalesce(F.avg(F.when(F.col("i") < cut(q), F.col("r"))), value(q))
    #: A product that may hold factors of 0 or below, which a sum of logarithms could not.
    size, sign = F.exp(F.sum(F.ln(F.nullif(F.abs(1 + F.col("r")), F.lit(0.0))))), F.when(F.min(F.abs(1 + F.col("r"))) == 0, 0).when(F.count_if(F.col("r") < -1) % 2 == 1, -1).otherwise(1)
    g = x.groupBy("symbol").agg(
        F.count("*").alias("n"), (sign * F.coalesce(size, F.lit(0.0)) - 1).alias("total_return"), (F.avg("r") * YEAR).alias("annual_return"), (F.stddev_pop("r") * YEAR**0.5).alias("volatility"),
        F.max("fall").alias("max_drawdown"), (F.sqrt(F.avg(F.pow(F.least(F.col("r") - RISK_FREE / YEAR, F.lit(0.0)), 2))) * YEAR**0.5).alias("down"),
        value(0.05).alias("var_95"), tail(0.05).alias("cvar_95"), value(0.01).alias("var_99"), tail(0.01).alias("cvar_99"),
        F.count_if(F.col("r") > 0).alias("positive_days"), F.count_if(F.col("r") < 0).alias("negative_days"), F.max("r").alias("best_day"), F.min("r").alias("worst_day"),
    )
    extra, zero = F.col("annual_return") - RISK_FREE, F.lit(0.0)
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, zero), zero)
    return g.withColumns({"sharpe": ratio(extra, F.col("volatility")), "sortino": ratio(extra, F.col("down")), "calmar": ratio(F.col("annual_return"), F.col("max_drawdown"))}).drop("down")


def market(r: DataFrame) -> DataFrame:
    """The equally weighted portfolio: trade_date, m."""
    return r.groupBy("trade_date").agg(F.avg("r").alias("m"))


def weighted(r: DataFrame, weights: DataFrame) -> DataFrame:
    """The weighted portfolio's returns, trade_date and r, on the dates that all its symbols have.  weights: symbol, weight;
    of a symbol's several weights the sum; they need not add up to 1.  ``metrics`` of it, as a symbol, are the portfolio's."""
    w = weights.groupBy("symbol").agg(F.sum("weight").alias("_w"))
    day = r.join(w, "symbol").groupBy("trade_date").agg(F.sum(F.col("r") * F.col("_w")).alias("r"), F.count("*").alias("_k"))
    return day.crossJoin(w.agg(F.count("*").alias("_all"))).filter("_k = _all").select("trade_date", "r")


def portfolio_metrics(r: DataFrame, weights: DataFrame, name: str = "portfolio") -> DataFrame:
    return metrics(weighted(r, weights).select(F.lit(name).alias("symbol"), "trade_date", "r"))


def beta_alpha(r: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Population beta (1 without any spread) and daily Jensen alpha against benchmark (trade_date, m)."""
    g = r.join(benchmark, "trade_date").groupBy("symbol").agg(F.covar_pop("r", "m").alias("c"), F.var_pop("m").alias("v"), F.avg("r").alias("a"), F.avg("m").alias("b"))
    beta, rf = F.coalesce(F.col("c") / F.nullif("v", F.lit(0.0)), F.lit(1.0)), RISK_FREE / YEAR
    return g.select("symbol", beta.alias("beta"), (F.col("a") - rf - beta * (F.col("b") - rf)).alias("alpha"))


MOST_SYMBOLS = 2000


def pairs(x: DataFrame, symbols: list[str], value: str = "r") -> DataFrame:
    """Correlation and covariance of every pair of the listed symbols on common dates, each pair once: a, b, corr, cov, n.
    Degenerate correlations are 0, or 1 of a symbol with itself.

    The result is quadratic in the list, which MOST_SYMBOLS bounds; dates are spread by a hash over ranges of them, sums of
    products are added up within each range by matrix products, and only these sums are shuffled.
    """
    if len(symbols) > MOST_SYMBOLS:
        raise ValueError(f"{len(symbols)} symbols; {MOST_SYMBOLS} at most")
    names = sorted(symbols)
    rows = x.filter(F.col("symbol").isin(names) & F.col(value).isNotNull()).select("symbol", F.col("trade_date"), F.col(value).cast("double").alias("v"))
    #: A value far from 0 is shifted by the symbol's mean, so that sums of squares keep their digits.
    means = {r["symbol"]: r["m"] for r in rows.groupBy("symbol").agg(F.avg("v").alias("m")).collect()}

    def add(total: list | None, part: pd.DataFrame) -> list:
        """n, sums and products of both sides of every pair, over whole dates."""
        wide = part.pivot_table(index="trade_date", columns="symbol", values="v", aggfunc="first").reindex(columns=names)
        v = wide.to_numpy(float) - np.array([means.get(s, 0.0) for s in names])
        there = (~np.isnan(v)).astype(float)
        v = np.nan_to_num(v)
        now = [there.T @ there, v.T @ there, there.T @ v, (v * v).T @ there, there.T @ (v * v), v.T @ v]
        return now if total is None else [a + b for a, b in zip(total, now, strict=True)]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf])
            if len(pdf):
                last = pdf["trade_date"] == pdf["trade_date"].iloc[-1]
                held = pdf[last]
                total = total if last.all() else add(total, pdf[~last])
        if held is not None:
            total = add(total, held)
            i, j = np.nonzero(np.triu(total[0]))
            yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": total[0][i, j].astype(np.int64), **{k: t[i, j] for k, t in zip(("sx", "sy", "sxx", "syy", "sxy"), total[1:], strict=True)}})

    spread = rows.repartition("trade_date").sortWithinPartitions("trade_date")
    found = spread.mapInPandas(sums, "i int, j int, n long, sx double, sy double, sxx double, syy double, sxy double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n").cast("double")
    vx, vy, cxy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n, F.col("sxy") - F.col("sx") * F.col("sy") / n
    flat = (F.sqrt(F.greatest(vx, F.lit(0.0)) / n) < 1e-12) | (F.sqrt(F.greatest(vy, F.lit(0.0)) / n) < 1e-12)
    corr = F.when(flat, (F.col("i") == F.col("j")).cast("double")).otherwise(cxy / F.sqrt(F.when(~flat, vx * vy)))
    name = lambda c: F.element_at(F.array(*[F.lit(s) for s in names]), F.col(c) + 1)
    return found.select(name("i").alias("a"), name("j").alias("b"), corr.alias("corr"), (cxy / F.nullif(n - 1, F.lit(0.0))).alias("cov"), "n")


def price_correlation(bars: DataFrame, symbols: list[str], least: int = 20) -> DataFrame:
    return pairs(bars, symbols, "close").filter(F.col("n") >= least)


def portfolio_var(r: DataFrame, weights: dict[str, float], level: float = 0.95) -> DataFrame:
    """Historical value at risk of a weighted portfolio, on dates that all its symbols have; ceil rank.  The weights are a
    driver's dictionary, at most MOST_SYMBOLS of them."""
    if len(weights) > MOST_SYMBOLS:
        raise ValueError(f"{len(weights)} weights; {MOST_SYMBOLS} at most")
    weight = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))])[F.col("symbol")]
    day = r.filter(F.col("symbol").isin(list(weights))).groupBy("trade_date").agg(F.sum(F.col("r") * weight).alias("p"), F.count("*").alias("k")).filter(F.col("k") == len(weights))
    #: One row a date.
    ranked = day.select("p", F.row_number().over(W.orderBy("p", "trade_date")).alias("i"), F.count("*").over(W.partitionBy()).alias("days"))
    return ranked.filter(F.col("i") == F.greatest(F.ceil(F.col("days") * (1 - level) - 1e-9), F.lit(1))).select("days", (-F.col("p")).alias("var"))


def concentration(holdings: DataFrame, group: str = "industry") -> DataFrame:
    """Share of value by group, in per cent with two places.  The total is one row, joined to the groups."""
    g = holdings.groupBy(group).agg(F.sum("value").alias("value"))
    return g.crossJoin(g.agg(F.sum("value").alias("_all"))).withColumn("weight", F.round(100 * F.col("value") / F.col("_all"), 2)).drop("_all")


def attribution(pnl: DataFrame) -> DataFrame:
    """pnl with ``share``, each row's part of the total (0 if that is 0)."""
    whole = pnl.agg(F.sum("pnl").alias("_all"))
    return pnl.crossJoin(whole).withColumn("share", F.coalesce(F.col("pnl") / F.nullif("_all", F.lit(0.0)), F.lit(0.0))).drop("_all")


def replay_score(bars: DataFrame, decisions: DataFrame) -> DataFrame:
    """How often a decision (symbol, trade_date, bull) foresaw the next close, equal ones counting as up: symbol, total, correct."""
    ahead = bars.select("symbol", "trade_date", (F.lead("close").over(W.partitionBy("symbol").orderBy("trade_date")) >= F.col("close")).alias("up")).filter("up IS NOT NULL")
    return decisions.join(ahead, ["symbol", "trade_date"]).filter("bull IS NOT NULL").groupBy("symbol").agg(F.count("*").alias("total"), F.count_if(F.col("bull") == F.col("up")).alias("correct"))


_ROLLED = ("total_return", "annual_return", "volatility", "sharpe", "sortino", "max_drawdown", "var_95", "cvar_95", "var_99", "cvar_99", "calmar")


def rolling(r: DataFrame, n: int = 60) -> DataFrame:
    """The measures of ``metrics`` over the last n returns, where there are n.  Ranks come from a window that is kept sorted; what
    follows the path is worked out on slices of CHUNK windows at once."""
    cut = lambda q: min(int(n * q), n - 1)

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=b != 0)

    def ranked(w: list[float]) -> tuple[float, ...]:
        tail = lambda q: sum(w[: cut(q)]) / cut(q) if int(n * q) else w[0]
        return w[cut(0.05)], tail(0.05), w[cut(0.01)], tail(0.01), w[-1], w[0]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("trade_date")
        x = rows.column("r").to_numpy()
        at = rows.slice(n - 1).select(["symbol", "trade_date"])
        if len(x) < n:
            return pa.table({"symbol": at.column(0), "trade_date": at.column(1)} | {c: pa.array([], pa.float64()) for c in _ROLLED} | {c: pa.array([], pa.int32()) for c in ("positive_days", "negative_days")} | {c: pa.array([], pa.float64()) for c in ("best_day", "worst_day")})
        by_rank, parts = kernels.sorted_window(x, n, ranked).T, []
        windows = np.lib.stride_tricks.sliding_window_view(x, n)
        for first in range(0, len(windows), CHUNK):
            w = windows[first : first + CHUNK]
            path = np.cumsum(w, axis=1)
            fall = (np.maximum(np.maximum.accumulate(path, axis=1), 0.0) - path).max(axis=1)
            down = np.sqrt((np.minimum(w - RISK_FREE / YEAR, 0.0) ** 2).mean(axis=1)) * YEAR**0.5
            parts.append((np.prod(1 + w, axis=1) - 1, w.mean(axis=1), w.std(axis=1), down, np.maximum(fall, 0.0), (w > 0).sum(axis=1), (w < 0).sum(axis=1)))
        total, mean, sd, down, fall, up, under = (np.concatenate(c) for c in zip(*parts, strict=True))
        year, risk = mean * YEAR, sd * YEAR**0.5
        values = (total, year, risk, ratio(year - RISK_FREE, risk), ratio(year - RISK_FREE, down), fall, *by_rank[:4], ratio(year, fall))
        return pa.table({"symbol": at.column(0), "trade_date": at.column(1)} | dict(zip(_ROLLED, values, strict=True)) | {"positive_days": pa.array(up, pa.int32()), "negative_days": pa.array(under, pa.int32()), "best_day": by_rank[4], "worst_day": by_rank[5]})

    kind = r.schema["trade_date"].dataType.simpleString()
    schema = f"symbol string, trade_date {kind}, " + ", ".join(f"{c} double" for c in _ROLLED) + ", positive_days int, negative_days int, best_day double, worst_day double"
    return r.select("symbol", "trade_date", F.col("r").cast("double").alias("r")).groupBy("symbol").applyInArrow(run, schema)


def rolling_beta(r: DataFrame, benchmark: DataFrame, n: int = 60) -> DataFrame:
    w = W.partitionBy("symbol").orderBy("trade_date").rowsBetween(1 - n, 0)
    x = r.join(benchmark, "trade_date")
    return x.select("symbol", "trade_date", F.when(F.count("r").over(w) == n, F.coalesce(F.covar_pop("r", "m").over(w) / F.nullif(F.var_pop("m").over(w), F.lit(0.0)), F.lit(1.0))).alias("beta"))


def max_drawdown(bars: DataFrame) -> DataFrame:
    """The largest fall of the close from its peak, as a positive share."""
    peak = F.max("close").over(W.partitionBy("symbol").orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0))
    return bars.select("symbol", (1 - F.col("close") / F.nullif(peak, F.lit(0.0))).alias("fall")).groupBy("symbol").agg(F.max("fall").alias("max_drawdown"))


def two_assets(r: DataFrame, a: str, b: str) -> DataFrame:
    """Means, sample variances and the covariance of two symbols on common dates: one row."""
    x, y = (r.filter(F.col("symbol") == k).select("trade_date", F.col("r").alias(n)) for k, n in ((a, "x"), (b, "y")))
    return x.join(y, "trade_date").agg(F.count("*").alias("n"), F.avg("x").alias("m1"), F.avg("y").alias("m2"), F.var_samp("x").alias("v1"), F.var_samp("y").alias("v2"), F.covar_samp("x", "y").alias("c"))


def min_variance(r: DataFrame, a: str, b: str) -> DataFrame:
    """Weights w1 and w2 of least variance, within 0 and 1; halves where there are fewer than two common dates."""
    x = two_assets(r, a, b)
    w1 = F.when(F.col("n") < 2, 0.5).otherwise(F.least(F.greatest(F.coalesce((F.col("v2") - F.col("c")) / F.nullif(F.col("v1") + F.col("v2") - 2 * F.col("c"), F.lit(0.0)), F.lit(0.5)), F.lit(0.0)), F.lit(1.0)))
    return x.select(w1.alias("w1"), (1 - w1).alias("w2"))


def frontier(r: DataFrame, a: str, b: str, points: int = 20) -> DataFrame:
    """risk, return and weight of the first of two symbols, at points + 1 weights from 0 to 1."""
    w1 = F.col("i") / float(points)
    x = two_assets(r, a, b).filter("n >= 2").select("*", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("i"))
    variance = w1 * w1 * F.col("v1") + (1 - w1) * (1 - w1) * F.col("v2") + 2 * w1 * (1 - w1) * F.col("c")
    return x.select(w1.alias("weight"), (w1 * F.col("m1") + (1 - w1) * F.col("m2")).alias("return"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("risk"))
