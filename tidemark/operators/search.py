"""Portfolio search over a matrix of returns (days x assets).  Assets of a pool are few; their matrix is made on the cluster by
``matrix`` and is bounded by ``MOST_ASSETS``; the search itself is driver arithmetic with a seed.  Regime features are made of
all symbols, on the cluster."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_ASSETS, YEAR = 500, 252
WEIGHTS = ("risk_parity", "min_variance", "hierarchical_rp", "vol_targeting", "etf_rotation", "defensive_rotation", "equal_weight")


def matrix(returns: DataFrame, symbols: list[str]) -> np.ndarray:
    """Returns (symbol, trade_date, r) of a stated pool as a days x assets array over the dates that all of it have.  A pool
    is MOST_ASSETS at most; a day is one row of that many numbers, so a century of days is some 100 MB at the bound."""
    if len(symbols) > MOST_ASSETS:
        raise ValueError(f"{len(symbols)} assets; {MOST_ASSETS} at most")
    day = returns.filter(F.col("symbol").isin(symbols)).groupBy("trade_date").pivot("symbol", symbols).agg(F.first("r")).dropna()
    return day.orderBy("trade_date").select(*[F.col(f"`{s}`") for s in symbols]).toPandas().to_numpy(float)


def inverse(m: np.ndarray) -> np.ndarray | None:
    try:
        return np.linalg.inv(m)
    except np.linalg.LinAlgError:
        return None


def loewdin(m: np.ndarray) -> np.ndarray:
    """Symmetric orthogonalisation S^(-1/2) S of a symmetric matrix."""
    values, vectors = np.linalg.eigh(m)
    root = np.where(values > 1e-12, 1 / np.sqrt(np.maximum(values, 1e-12)), 0.0)
    return vectors @ np.diag(root) @ vectors.T @ m


def correlation(r: np.ndarray) -> np.ndarray:
    """Pearson correlations; 0 where a side has no spread."""
    x = r - r.mean(axis=0)
    size = np.sqrt((x * x).sum(axis=0))
    both = np.outer(size, size)
    return np.where(both > 1e-10, x.T @ x / np.where(both > 1e-10, both, 1.0), 0.0)


def weights(cov: np.ndarray, mean: np.ndarray, strategy: str, top: int = 3) -> np.ndarray:
    """Weights from a covariance matrix and mean returns.  Scaling all to a target volatility and back to 1 is equal weights;
    least variance is clipped at 0 and not brought back to 1."""
    n = len(mean)
    sd, w = np.maximum(np.sqrt(np.diag(cov)), 1e-10), np.zeros(n)
    if strategy in ("risk_parity", "hierarchical_rp"):
        return (1 / sd) / (1 / sd).sum()
    if strategy == "min_variance" and (inv := inverse(cov)) is not None and inv.sum() > 1e-10:
        return np.maximum(inv.sum(axis=1) / inv.sum(), 0)
    if strategy == "etf_rotation":
        w[np.argsort(-mean, kind="stable")[:top]] = 1 / top
        return w
    if strategy == "defensive_rotation":
        few = max(2, n // 2)
        w[np.argsort(sd, kind="stable")[:few]] = 1 / few
        return w
    return np.full(n, 1 / n)


def projected_sharpe(r: np.ndarray, strategy: str) -> float | None:
    """Of a weighting fitted to the first 70 % of the days, on these; None for one asset, fewer than 60 days or no spread."""
    days, n = r.shape
    if n < 2 or days < 60:
        return None
    part = r[: int(0.7 * days)]
    mean, cov = part.mean(axis=0), np.cov(part.T)
    w = weights(cov, mean, strategy)
    risk = math.sqrt(max(float(w @ cov @ w), 0.0) * YEAR)
    return float(w @ mean) * YEAR / risk if risk > 1e-10 else None


def caps(pools: dict[str, np.ndarray], strategies: tuple[str, ...] = WEIGHTS) -> list[tuple[str, str, float, int]]:
    """(pool, strategy, projected Sharpe ratio, assets), best first."""
    found = [(name, s, v, r.shape[1]) for name, r in pools.items() for s in strategies if (v := projected_sharpe(r, s)) is not None]
    return sorted(found, key=lambda x: -x[2])


def quality(r: np.ndarray) -> np.ndarray:
    """Annual Sharpe ratio of each asset, with the population's deviation; 0 for fewer than five days or no spread."""
    sd = r.std(axis=0) * math.sqrt(YEAR)
    return np.where((sd > 1e-10) & (len(r) >= 5), r.mean(axis=0) * YEAR / np.where(sd > 1e-10, sd, 1.0), 0.0)


def pool(r: np.ndarray, size: int, alpha: float = 2.0, least: float = -1.0, most: float = 0.95, among: list[int] | None = None) -> list[int]:
    """Greedy, of assets above the least quality: the best quality first, then the best of quality less alpha times the mean
    absolute correlation with those chosen, leaving out what is correlated more than ``most`` with one of them.  All of them
    if they are no more than ``size``."""
    q, c = quality(r), np.abs(correlation(r))
    left = [i for i in (range(r.shape[1]) if among is None else among) if q[i] > least]
    if len(left) <= size or size == 0:
        return left
    out = [max(left, key=lambda i: q[i])]
    left.remove(out[0])
    while left and len(out) < size:
        ok = [i for i in left if c[i, out].max() <= most]
        if not ok:
            break
        out.append(max(ok, key=lambda i: q[i] - alpha * c[i, out].mean()))
        left.remove(out[-1])
    return out


def diverse_pools(r: np.ndarray, pools: int, size: int) -> list[tuple[list[int], float, float]]:
    """Pools of assets that no earlier pool has, of a quality above -0.5: (assets, mean quality, mean absolute correlation)."""
    q, c, out = quality(r), np.abs(correlation(r)), []
    left = [i for i in range(r.shape[1]) if q[i] > -0.5]
    while len(out) < pools and len(left) >= size:
        p = pool(r, size, among=left)
        within = [c[a, b] for k, a in enumerate(p) for b in p[k + 1 :]]
        out.append((p, float(np.mean(q[p])) if p else 0.0, float(np.mean(within)) if within else 0.0))
        if not p:
            break
        left = [i for i in left if i not in p]
    return out


FEATURES = ("cs_vol", "mean_corr", "trend", "drawdown", "vol_ratio", "dispersion")


def regime_features(returns: DataFrame, vol_days: int = 20, trend_days: int = 60, fall_days: int = 252) -> DataFrame:
    """For each day that all symbols have, and the mean return m of that day:

    * cs_vol: the symbols' mean deviation over the last vol_days, a year's; vol_ratio: over its mean so far;
    * mean_corr: the mean correlation of all pairs over the last vol_days;
    * trend: the annual Sharpe ratio of m over trend_days (0 before); drawdown: of its compounded value within fall_days;
    * dispersion: the mean spread over the symbols of a day, over the last vol_days.

    No pair is formed: with u the centred returns of a symbol in a window, scaled to length 1, the correlations of all pairs
    add up to |sum of u|^2, so it takes the sum over the symbols of each of the window's vol_days components.
    """
    symbols = returns.select("symbol").distinct().count()
    days = returns.groupBy("trade_date").agg(F.count("*").alias("k"), F.avg("r").alias("m"), F.stddev_pop("r").alias("spread")).filter(F.col("k") == symbols)
    whole = returns.join(days.select("trade_date"), "trade_date", "left_semi")
    recent = W.partitionBy("symbol").orderBy("trade_date").rowsBetween(1 - vol_days, 0)
    x = whole.select("trade_date", F.collect_list("r").over(recent).alias("rs"), F.avg("r").over(recent).alias("mean"), F.stddev_pop("r").over(recent).alias("sd"))
    size = F.sqrt(F.col("sd") * F.col("sd") * F.size("rs"))
    some = size > 1e-8
    units = F.transform("rs", lambda v: F.when(some, (v - F.col("mean")) / F.nullif(size, F.lit(0.0))).otherwise(0.0))
    parts = x.select("trade_date", "sd", some.cast("int").alias("some"), F.posexplode(units).alias("at", "u"))
    parts = parts.groupBy("trade_date", "at").agg(F.sum("u").alias("u"), F.sum("some").alias("some"), F.avg("sd").alias("sd"))
    g = parts.groupBy("trade_date").agg(F.sum(F.col("u") * F.col("u")).alias("square"), F.max("some").alias("some"), (F.avg("sd") * YEAR**0.5).alias("cs_vol"))
    corr = (F.col("square") - F.col("some")) / (symbols * (symbols - 1)) if symbols > 1 else F.lit(0.0)
    w = W.orderBy("trade_date")  # one row a day from here on
    back = lambda n: w.rowsBetween(1 - n, 0)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    d = g.select("trade_date", "cs_vol", corr.alias("mean_corr")).join(days.select("trade_date", "m", "spread"), "trade_date")
    d = d.withColumns({"i": F.row_number().over(w), "value": F.product(1 + F.col("m")).over(so_far), "usual": F.avg("cs_vol").over(so_far), "sd": F.stddev_pop("m").over(back(trend_days)) * YEAR**0.5})
    trend = F.when((F.col("i") > trend_days) & (F.col("sd") > 1e-10), F.avg("m").over(back(trend_days)) * YEAR / F.nullif("sd", F.lit(0.0))).otherwise(0.0)
    d = d.withColumn("peak", F.max("value").over(back(fall_days)))
    return d.select(
        "trade_date", "m", "cs_vol", F.when(F.col("usual") > 1e-10, F.col("cs_vol") / F.nullif("usual", F.lit(0.0))).otherwise(1.0).alias("vol_ratio"), "mean_corr",
        trend.alias("trend"), F.when(F.col("peak") > 0, F.col("value") / F.nullif("peak", F.lit(0.0)) - 1).otherwise(0.0).alias("drawdown"), F.avg("spread").over(back(vol_days)).alias("dispersion"),
    )


def regimes(features: DataFrame, k: int = 3, seed: int = 1) -> DataFrame:
    """Days labelled by k-means over the features as they are."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features)
    return KMeans(k=k, seed=seed, maxIter=50).fit(x).transform(x).select("trade_date", "m", *FEATURES, F.col("prediction").alias("regime"))


def mars(labels: np.ndarray, strategies: dict[str, np.ndarray]) -> tuple[int, dict[int, str], dict[int, int]]:
    """The last day's regime, the strategy (name to daily returns) of the best Sharpe ratio on each regime's days, and how many
    days each regime has."""
    best, sizes = {}, {}
    for k in sorted(set(labels.tolist())):
        own = labels == k
        sizes[int(k)] = int(own.sum())
        score = lambda s: s[own].mean() / max(s[own].std(ddof=1) if own.sum() > 1 else 0.0, 0.001) * math.sqrt(YEAR)  # noqa: B023, E731
        best[int(k)] = max(sorted(strategies), key=lambda n: score(strategies[n]))  # noqa: B023
    return int(labels[-1]), best, sizes


#: The dimensions of the meta search and their values (fixed values).
DIMENSIONS = {
    "alpha_tier": ("quality", "balanced", "diversity"),
    "objective": ("sharpe", "sortino", "calmar", "min_dd", "omega", "return_dd"),
    "ensemble": ("equal_top3", "weighted_mars", "regime_specific"),
    "factor_subset": ("trend_only", "reversal_only", "momentum_vol", "top20_ic", "all48"),
}
#: How much a difference in a dimension counts as distance (fixed values).
DISTANCE = {"alpha_tier": 0.4, "objective": 0.3, "ensemble": 0.3}
SUCCESS, EXPLORE, IN_ORDER = 1.5, 0.3, 10


class MetaSearch:
    """Chooses among all 270 combinations, none twice: ten in order, then with probability 0.3 at random, else the best of 0.7
    times a draw for its values' records (a Kumaraswamy stand-in for a beta distribution of successes, which are Sharpe ratios
    above 1.5, and failures) and 0.3 times its distance to what was tried."""

    def __init__(self, seed: int = 1):
        self.nodes = [dict(zip(DIMENSIONS, v, strict=True)) for v in itertools.product(*DIMENSIONS.values())]
        self.tried: list[tuple[dict[str, str], float]] = []
        self.rng = random.Random(seed)

    def _draw(self, wins: float, losses: float) -> float:
        a, b = min(wins + 1, 10.0), min(losses + 1, 10.0)
        return (1 - (1 - self.rng.random()) ** (1 / b)) ** (1 / a)

    def select(self) -> dict[str, str] | None:
        done = [n for n, _ in self.tried]
        left = [n for n in self.nodes if n not in done]
        if not left or len(done) < IN_ORDER:
            return left[0] if left else None
        if self.rng.random() < EXPLORE:
            return self.rng.choice(left)
        record: dict[str, list[float]] = {}
        for node, score in self.tried:
            for v in node.values():
                record.setdefault(v, [0.0, 0.0])[score <= SUCCESS] += 1

        def value(node: dict[str, str]) -> float:
            draws = [self._draw(*record[v]) for v in node.values() if v in record]
            apart = min(sum(x for d, x in DISTANCE.items() if node[d] != other[d]) for other in done)
            return 0.7 * (sum(draws) / len(draws) if draws else 0.5) + 0.3 * apart

        return max(left, key=value)

    def record(self, node: dict[str, str], score: float) -> None:
        self.tried.append((node, score))

    def best(self) -> tuple[dict[str, str], float] | None:
        return max(self.tried, key=lambda x: x[1], default=None)
