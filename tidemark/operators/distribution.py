"""Volume profile and cost distribution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS, LEVELS, DEFAULT_TURNOVER, VALUE_AREA = 100, 100, 0.02, 0.7


def volume_profile(bars: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """symbol, level (its bucket), price (volume-weighted in the bucket), volume, is_poc, in_value_area, of the buckets that
    have any volume.  The value area grows from the bucket of the most volume (the lowest of equal ones) by the larger
    neighbour, the lower of equal ones, until it holds 70 %; its ends are the area's low and high.  A symbol of one price has
    no profile.  A symbol has ``buckets`` rows at most, so growing the area is a kernel."""
    edge = bars.groupBy("symbol").agg(F.min("close").alias("lo"), F.max("close").alias("hi")).filter("hi - lo >= 1e-12")
    width = (F.col("hi") - F.col("lo")) / buckets
    level = F.least(F.floor((F.col("close") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(buckets - 1)).cast("int")
    g = bars.join(edge, "symbol").select("symbol", level.alias("level"), "close", "volume").groupBy("symbol", "level").agg(F.sum(F.col("close") * F.col("volume")).alias("value"), F.sum("volume").alias("volume"))
    g = g.filter("volume > 0").select("symbol", "level", (F.col("value") / F.col("volume")).alias("price"), "volume")

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("price", kind="stable").reset_index(drop=True)
        v = pdf["volume"].to_numpy(float)
        poc = lo = hi = int(np.argmax(v))
        inside, wanted = v[poc], VALUE_AREA * v.sum()
        while inside < wanted and hi - lo < len(v) - 1:
            below, above = v[lo - 1] if lo else -1.0, v[hi + 1] if hi + 1 < len(v) else -1.0
            if below >= above:
                lo -= 1
            else:
                hi += 1
            inside += max(below, above)
        pdf["is_poc"], pdf["in_value_area"] = pdf.index == poc, (pdf.index >= lo) & (pdf.index <= hi)
        return pdf

    return g.groupBy("symbol").applyInPandas(area, "symbol string, level int, price double, volume double, is_poc boolean, in_value_area boolean")


def value_area(profile: DataFrame) -> DataFrame:
    """symbol, poc, val and vah: the price of the most volume and the ends of the value area."""
    inside = F.when(F.col("in_value_area"), F.col("price"))
    return profile.groupBy("symbol").agg(F.max(F.when(F.col("is_poc"), F.col("price"))).alias("poc"), F.min(inside).alias("val"), F.max(inside).alias("vah"))


def sr_levels(profile: DataFrame, bars: DataFrame, factor: float = 1.5) -> DataFrame:
    """symbol, price, volume and kind: buckets of more than 1.5 times the mean volume, as resistance above the last close and
    support below it, and the one of the most volume as poc."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "trade_date").alias("last"))
    x = profile.withColumn("mean", F.avg("volume").over(W.partitionBy("symbol"))).join(last, "symbol")
    side = F.when(F.col("volume") > factor * F.col("mean"), F.when(F.col("price") > F.col("last"), "resistance").otherwise("support"))
    kinds = F.explode(F.filter(F.array(side, F.when(F.col("is_poc"), F.lit("poc"))), lambda k: k.isNotNull()))
    return x.select("symbol", "price", "volume", kinds.alias("kind"))


def _turnover():
    return F.least(F.greatest(F.coalesce("turnover", F.lit(DEFAULT_TURNOVER)), F.lit(0.0)), F.lit(1.0))


def cost_distribution(bars: DataFrame, levels: int = LEVELS) -> DataFrame:
    """symbol, level, price (the level's middle) and chips (per cent of all), of every level between the lowest low and the
    highest high.  A bar's volume at its close's level stays by the product of (1 - turnover) of all later bars: a running
    sum of logarithms in reversed order, with whole turnovers counted apart."""
    w = W.partitionBy("symbol")
    later = w.orderBy(F.desc("trade_date")).rowsBetween(W.unboundedPreceding, -1)
    b = bars.select("symbol", "trade_date", "close", "volume", _turnover().alias("t"), F.min("low").over(w).alias("lo"), F.max("high").over(w).alias("hi"))
    gone, worn = F.sum((F.col("t") >= 1).cast("int")).over(later), F.sum(F.when(F.col("t") < 1, F.ln(1 - F.col("t")))).over(later)
    kept = F.when(F.coalesce(gone, F.lit(0)) > 0, 0.0).otherwise(F.exp(F.coalesce(worn, F.lit(0.0))))
    step = (F.col("hi") - F.col("lo")) / levels
    level = F.when(step > 0, F.least(F.floor((F.col("close") - F.col("lo")) / F.nullif(step, F.lit(0.0))), F.lit(levels - 1))).otherwise(0).cast("int")
    chips = b.select("symbol", "lo", "hi", level.alias("level"), (F.col("volume") * kept).alias("chips")).groupBy("symbol", "level").agg(F.sum("chips").alias("chips"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    whole = chips.groupBy("symbol").agg(F.sum("chips").alias("all"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    every = whole.select("symbol", "all", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    share = F.coalesce(100 * F.col("chips") / F.nullif("all", F.lit(0.0)), F.lit(0.0))
    return every.join(chips.select("symbol", "level", "chips"), ["symbol", "level"], "left").select("symbol", "level", (F.col("lo") + step * (F.col("level") + 0.5)).alias("price"), share.alias("chips"))


def average_cost(bars: DataFrame) -> DataFrame:
    """symbol, avg_cost: the mean close, each bar weighing its volume less its own turnover (the last close without such)."""
    weight = F.col("volume") * (1 - F.col("t"))
    g = bars.withColumn("t", _turnover()).groupBy("symbol").agg(F.sum(F.col("close") * weight).alias("value"), F.sum(weight).alias("weight"), F.max_by("close", "trade_date").alias("last"))
    return g.select("symbol", F.when(F.col("weight") > 0, F.col("value") / F.nullif("weight", F.lit(0.0))).otherwise(F.col("last")).alias("avg_cost"))


def concentration(chips: DataFrame) -> DataFrame:
    """cr5, cr10 and cr20, the per cent in the 5, 10 and 20 largest levels; trend, the sum of squared shares in per cent; and
    its description."""
    w = W.partitionBy("symbol")
    x = chips.withColumns({"k": F.row_number().over(w.orderBy(F.desc("chips"), "level")), "s": F.col("chips") / F.nullif(F.sum("chips").over(w), F.lit(0.0))})
    top = [F.coalesce(F.sum(F.when(F.col("k") <= n, 100 * F.col("s"))), F.lit(0.0)).alias(f"cr{n}") for n in (5, 10, 20)]
    g = x.groupBy("symbol").agg(*top, F.least(F.coalesce(100 * F.sum(F.col("s") * F.col("s")), F.lit(0.0)), F.lit(100.0)).alias("trend"))
    words = F.when(F.col("trend") > 60, "high").when(F.col("trend") > 35, "medium").when(F.col("trend") > 15, "low").otherwise("scattered")
    return g.withColumn("description", words)


def profit_ratio(chips: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, profit_pct and loss_pct (chips below the last close, and the rest), avg_cost, weighted_avg_cost, last_price."""
    last = average_cost(bars).join(bars.groupBy("symbol").agg(F.max_by("close", "trade_date").alias("last_price")), "symbol")
    g = chips.join(last, "symbol").groupBy("symbol", "avg_cost", "last_price").agg(
        F.sum(F.when(F.col("price") < F.col("last_price"), F.col("chips")).otherwise(0.0)).alias("below"), F.sum("chips").alias("all"), F.sum(F.col("price") * F.col("chips")).alias("value"),
    )
    pct = F.coalesce(100 * F.col("below") / F.nullif("all", F.lit(0.0)), F.lit(50.0))
    return g.select("symbol", pct.alias("profit_pct"), (100 - pct).alias("loss_pct"), "avg_cost", F.coalesce(F.col("value") / F.nullif("all", F.lit(0.0)), F.col("avg_cost")).alias("weighted_avg_cost"), "last_price")


def _prefixes(pdf: pd.DataFrame, ends: list[int], levels: int):
    """For each number of bars in ``ends``, ascending: that number, the prices of the levels over these bars, the chips (per
    cent) and the average cost.  What is left of each bar is carried on; levels move with the range, so they are made anew."""
    close, volume, t = (pdf[c].to_numpy(float) for c in ("close", "volume", "t"))
    low, high = np.minimum.accumulate(pdf["low"].to_numpy(float)), np.maximum.accumulate(pdf["high"].to_numpy(float))
    value, weight = np.cumsum(close * volume * (1 - t)), np.cumsum(volume * (1 - t))
    left, at = np.zeros(len(close)), 0
    for end in ends:
        for i in range(at, end):
            left[:i] *= 1 - t[i]
            left[i] = volume[i]
        at = end
        lo, step = low[end - 1], (high[end - 1] - low[end - 1]) / levels
        level = np.minimum(((close[:end] - lo) / step).astype(np.int64), levels - 1) if step > 0 else np.zeros(end, np.int64)
        chips = np.bincount(level, left[:end], levels)
        total = chips.sum()
        cost = value[end - 1] / weight[end - 1] if weight[end - 1] > 0 else close[end - 1]
        yield end, lo + step * (np.arange(levels) + 0.5), 100 * chips / total if total > 0 else chips, cost


def _per_symbol(bars: DataFrame, run, schema: str) -> DataFrame:
    b = bars.select("symbol", "trade_date", "low", "high", "close", "volume", _turnover().alias("t"))
    return b.groupBy("symbol").applyInPandas(lambda pdf: run(pdf.sort_values("trade_date", kind="stable")), schema)


def moving_distribution(bars: DataFrame, window: int = 60, levels: int = LEVELS) -> DataFrame:
    """symbol, trade_date, avg_cost and weighted_avg_cost of the distribution up to each of the last ``window`` bars."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        rows = [(end - 1, cost, float(prices @ chips / chips.sum()) if chips.sum() > 0 else cost) for end, prices, chips, cost in _prefixes(pdf, list(range(max(0, n - window) + 1, n + 1)), levels)]
        at, cost, weighted = zip(*rows, strict=True)
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "trade_date": pdf["trade_date"].iloc[list(at)].to_list(), "avg_cost": cost, "weighted_avg_cost": weighted})

    return _per_symbol(bars, run, "symbol string, trade_date date, avg_cost double, weighted_avg_cost double")


def historical_frames(bars: DataFrame, frames: int = 30, levels: int = LEVELS) -> DataFrame:
    """Distributions of growing parts of the history, ``frames`` of them, of symbols of 20 bars or more: symbol, frame,
    trade_date (of the last bar), ago (bars after it), avg_cost, profit_pct, loss_pct, level, price, chips."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, out = len(pdf), []
        ends = [min((f + 1) * max(n // frames, 1), n) for f in range(frames)] if n >= 20 else []
        days, close = pdf["trade_date"].to_list(), pdf["close"].to_numpy(float)
        made = {end: rest for end, *rest in _prefixes(pdf, sorted(set(ends)), levels)}
        for f, end in enumerate(ends):
            prices, chips, cost = made[end]
            total = chips.sum()
            profit = 100 * chips[prices < close[end - 1]].sum() / total if total > 0 else 50.0
            out.append(pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "frame": f, "trade_date": days[end - 1], "ago": n - end, "avg_cost": cost, "profit_pct": profit, "loss_pct": 100 - profit, "level": np.arange(levels), "price": prices, "chips": chips}))
        return pd.concat(out) if out else pd.DataFrame(columns=["symbol", "frame", "trade_date", "ago", "avg_cost", "profit_pct", "loss_pct", "level", "price", "chips"])

    return _per_symbol(bars, run, "symbol string, frame int, trade_date date, ago int, avg_cost double, profit_pct double, loss_pct double, level int, price double, chips double")
