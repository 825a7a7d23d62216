"""Relational operators around bars: summaries, ingest, trade matching, alerts, data quality, statistics, exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staged import Plan
from . import blocks


def summary(stocks: DataFrame, bars: DataFrame) -> DataFrame:
    """Every stock with its number of bars and date range; stocks without bars stay.  Bars are aggregated before the join."""
    g = bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    return stocks.join(g, "symbol", "left").withColumn("bars", F.coalesce("bars", F.lit(0).cast("long")))


def in_range(bars: DataFrame, symbol: str, start: str, end: str, most: int | None = None) -> DataFrame:
    df = bars.filter((F.col("symbol") == symbol) & F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy("trade_date")
    return df.limit(most) if most else df


def latest(bars: DataFrame, k: int, until: str | None = None) -> DataFrame:
    """The last k bars of each symbol."""
    if until:
        bars = bars.filter(F.col("trade_date") <= F.lit(until).cast("date"))
    return bars.withColumn("_k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("trade_date")))).filter(F.col("_k") <= k).drop("_k")


def first_of(df: DataFrame, key: list[str]) -> DataFrame:
    """Of rows of equal key the one whose other values come first, so that reruns agree."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    return df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def insert_or_ignore(target: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows of new to append: the first of each key, by ``order``, that target does not have."""
    if order:
        new = new.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_k = 1").drop("_k")
    else:
        new = first_of(new, key)
    return new.join(target.select(*key), key, "left_anti")


def upsert(target: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """new replaces target by key; columns in ``keep`` keep the old value where the new one is null."""
    old = target.select(*key, *[F.col(c).alias(f"_old_{c}") for c in target.columns if c not in key], F.lit(True).alias("_had"))
    fresh = new.withColumn("_new", F.lit(True))
    df = old.join(fresh, key, "full_outer")
    value = lambda c: F.when(F.col("_new"), F.coalesce(c, f"_old_{c}") if c in keep else F.col(c)).otherwise(F.col(f"_old_{c}"))
    return df.select(*key, *[value(c).alias(c) for c in target.columns if c not in key])


def quality(bars: DataFrame) -> DataFrame:
    """One row a broken rule: ohlc (inconsistent prices), duplicate, gap (more than 10 days), negative."""
    w = W.partitionBy("symbol").orderBy("trade_date")
    d = bars.withColumns({"before": F.lag("trade_date").over(w), "copies": F.count("*").over(W.partitionBy("symbol", "trade_date"))})
    rules = {
        "ohlc": (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close")),
        "duplicate": F.col("copies") > 1, "gap": F.datediff("trade_date", "before") > 10, "negative": (F.least("open", "high", "low", "close") <= 0) | (F.col("volume") < 0),
    }
    return d.select("symbol", "trade_date", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))


def heikin_ashi(bars: DataFrame) -> DataFrame:
    """open is the mean of the bar before's open and close (the raw open on the first bar)."""
    return heikin_ashi_plan().spark(bars)


def heikin_ashi_plan() -> Plan:
    p = Plan()
    close = p.c("(open + high + low + close) / 4")
    x = p.c(f"CASE WHEN rn = 1 THEN open ELSE {p.lag(close)} END")
    o = p.recur(x, "0.5", "0.5", "first")
    p.out(ha_open=o, ha_close=close, ha_high=p.c(f"greatest(high, {o}, {close})"), ha_low=p.c(f"least(low, {o}, {close})"))
    return p


# --- trades

def fifo(trades: DataFrame, key: str = "symbol") -> DataFrame:
    """Sells matched to earlier buys, first in first out, per key: a row for each matched piece with its profit.

    trades: key, seq (order), direction (buy or sell), price, quantity, and, where there are such columns, commission and
    stamp_tax, of which a sale's piece bears its share.  What a sale sells beyond the holdings is dropped, so the holdings
    after each trade are the running sum of all quantities less its running minimum below zero.  The cumulated quantities of
    the buys and of what the sales really sold are intervals; a piece is an overlap of two.  The overlaps are found by a
    merge of both sides' breakpoints (windows over the union), so no side is joined with the other.
    """
    run = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    cost = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("commission", "stamp_tax") if c in trades.columns), F.lit(0.0))
    t = trades.filter("quantity > 0").select(key, "seq", "direction", "price", "quantity", (cost / F.col("quantity")).alias("cost"))
    t = t.withColumn("sum", F.sum(F.when(F.col("direction") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))).over(run))
    t = t.withColumn("held", F.col("sum") - F.least(F.min("sum").over(run), F.lit(0.0)))
    before = F.coalesce(F.lag("held").over(W.partitionBy(key).orderBy("seq")), F.lit(0.0))
    t = t.withColumn("moved", F.when(F.col("direction") == "buy", F.col("quantity")).otherwise(before - F.col("held"))).filter("moved > 0")
    side = W.partitionBy(key, "direction").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    points = t.select(key, "direction", "price", "cost", "seq", F.sum("moved").over(side).alias("at"))
    #: The next breakpoint of each side; in reversed order, where the frame only grows.
    back = W.partitionBy(key).orderBy(F.desc("at"), "direction", F.desc("seq"))
    ahead = lambda d, c: F.last(F.when(F.col("direction") == d, F.col(c)), ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0))
    cut = points.withColumns({
        "from": F.coalesce(F.lead("at").over(back), F.lit(0.0)), **{f"{d}_{c}": ahead(d, c) for d in ("buy", "sell") for c in ("price", "seq")}, "sell_cost": ahead("sell", "cost"),
    })
    cut = cut.withColumn("quantity", F.col("at") - F.col("from")).filter("quantity > 0 AND buy_seq IS NOT NULL AND sell_seq IS NOT NULL")
    return cut.select(key, "buy_seq", "sell_seq", "quantity", "buy_price", "sell_price", ((F.col("sell_price") - F.col("buy_price") - F.col("sell_cost")) * F.col("quantity")).alias("pnl"))


def fifo_summary(trades: DataFrame, key: str = "symbol") -> DataFrame:
    """Of each key: trades, sells, wins, losses, win_rate (per cent of all sells, unmatched ones too), pnl, avg_win, avg_loss,
    max_win, max_loss and profit_factor; what there is none of is 0."""
    per_sell = fifo(trades, key).groupBy(key, "sell_seq").agg(F.sum("pnl").alias("p"))
    p, zero = F.col("p"), F.lit(0.0)
    done = per_sell.groupBy(key).agg(
        F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.sum("p").alias("pnl"), F.sum(F.when(p > 0, p)).alias("gain"), F.sum(F.when(p < 0, p)).alias("loss"),
        F.greatest(F.max("p"), zero).alias("max_win"), F.least(F.min("p"), zero).alias("max_loss"),
    )
    all_ = trades.groupBy(key).agg(F.count("*").alias("trades"), F.count_if(F.col("direction") != "buy").alias("sells"))
    whole = all_.join(done, key, "left").na.fill(0)
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b).cast("double"), zero), zero)
    return whole.select(
        key, "trades", "sells", "wins", "losses", (100 * share("wins", "sells")).alias("win_rate"), "pnl", share("gain", "wins").alias("avg_win"), share("loss", "losses").alias("avg_loss"),
        "max_win", "max_loss", F.when(F.abs("loss") > 1e-9, F.abs(F.col("gain") / F.col("loss"))).otherwise(0.0).alias("profit_factor"),
    )


def with_stock(rows: DataFrame, stocks: DataFrame, key: str = "symbol") -> DataFrame:
    """Trades or alert rules with the columns of their stock; rows of unknown stocks stay."""
    return rows.join(stocks, key, "left")


def members(items: DataFrame, stocks: DataFrame, bars: DataFrame) -> DataFrame:
    """The stocks of watchlists (items: list, symbol) with their number of bars and date range.  Bars are looked at only of
    stocks that are on a list, and aggregated before the join."""
    wanted = items.select("symbol").distinct()
    return items.join(summary(stocks.join(wanted, "symbol", "left_semi"), bars.join(wanted, "symbol", "left_semi")), "symbol")


def lists(watchlists: DataFrame, items: DataFrame) -> DataFrame:
    """Watchlists (list, name) with their number of members."""
    return watchlists.join(items.groupBy("list").agg(F.count("*").alias("members")), "list", "left").withColumn("members", F.coalesce("members", F.lit(0).cast("long")))


def counts(**tables: DataFrame) -> DataFrame:
    """The number of rows of each table: name, rows."""
    parts = [t.groupBy().agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- alerts

def price_hit(params: Column, close: Column) -> Column:
    way = F.coalesce(F.get_json_object(params, "$.direction"), F.lit("above"))
    level = F.get_json_object(params, "$.price").try_cast("double")
    return F.when(way == "above", close > level).when(way == "below", close < level)


LOOK_BACK = 100


def _fired(b: Column) -> Column:
    """Whether a rule (condition_type, params) fires on the last of the bars b (trade_date, close, volume, in order)."""
    n = F.size(b)
    close, volume = F.element_at(b, -1)["close"], F.element_at(b, -1)["volume"]
    number = lambda k, default: F.coalesce(F.get_json_object("params", f"$.{k}").try_cast("int"), F.lit(default))

    def mean(field: str, k: Column, back: int) -> Column:
        part = F.transform(F.slice(b, F.greatest(n - back - k + 1, F.lit(1)), F.greatest(k, F.lit(0))), lambda x: x[field])
        return F.when((n >= k + back) & (k > 0), F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / k)

    short, long, look = number("short_period", 5), number("long_period", 20), number("lookback", 20)
    now, before = mean("close", short, 0) - mean("close", long, 0), mean("close", short, 1) - mean("close", long, 1)
    way = F.coalesce(F.get_json_object("params", "$.direction"), F.lit("golden"))
    cross = (short < long) & F.when(way == "golden", (before <= 0) & (now > 0)).when(way == "dead", (before >= 0) & (now < 0))
    usual = mean("volume", look, 1)
    spike = (usual > 0) & (volume > F.coalesce(F.get_json_object("params", "$.multiplier").try_cast("double"), F.lit(2.0)) * usual)
    kind = F.col("condition_type")
    return F.coalesce(F.when(kind == "price_breakout", price_hit(F.col("params"), close)).when(kind == "ma_cross", cross).when(kind == "volume_spike", spike), F.lit(False))


def check_alerts(rules: DataFrame, bars: DataFrame, day: str) -> DataFrame:
    """Rules that fire on ``day``: price_breakout, ma_cross, volume_spike; at most once a day (last_triggered).

    rules: rule_id, symbol, condition_type, params (JSON), enabled, last_triggered.  Only the last LOOK_BACK bars until the day
    of the symbols with enabled rules are looked at.
    """
    live = rules.filter(F.col("enabled") & ~F.col("last_triggered").eqNullSafe(F.lit(day).cast("date")))
    recent = latest(bars.join(live.select("symbol").distinct(), "symbol", "left_semi"), LOOK_BACK, day)
    series = recent.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("trade_date", "close", "volume"))).alias("b"))
    last = F.element_at("b", -1)
    return live.join(series, "symbol").filter(_fired(F.col("b"))).select("rule_id", "symbol", "condition_type", last["trade_date"].alias("trade_date"), last["close"].alias("close"))


def replay_alerts(rules: DataFrame, bars: DataFrame) -> DataFrame:
    """What polling after every bar gives: each rule's first bar of a day on which it fires, but on its last_triggered day."""
    live = rules.filter("enabled")
    recent = W.partitionBy("symbol").orderBy("trade_date").rowsBetween(1 - LOOK_BACK, 0)
    series = bars.join(live.select("symbol").distinct(), "symbol", "left_semi").select("symbol", F.collect_list(F.struct("trade_date", "close", "volume")).over(recent).alias("b"))
    last = F.element_at("b", -1)
    hit = live.join(series, "symbol").filter(_fired(F.col("b"))).select("rule_id", "symbol", "condition_type", last["trade_date"].alias("trade_date"), last["close"].alias("close"), F.to_date(last["trade_date"]).alias("_day"), "last_triggered")
    first = F.row_number().over(W.partitionBy("rule_id", "_day").orderBy("trade_date"))
    return hit.filter(~F.col("_day").eqNullSafe(F.col("last_triggered"))).withColumn("_k", first).filter("_k = 1").drop("_k", "_day", "last_triggered")


# --- statistics of one column, by key

def statistics(df: DataFrame, x: str, key: str = "symbol") -> DataFrame:
    """mean, sample deviation and variance, bias-adjusted skew and excess kurtosis, nearest-rank quartiles."""
    g = df.groupBy(key).agg(
        F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("variance"),
        F.skewness(x).alias("s"), F.kurtosis(x).alias("k"),
    )
    n = F.col("n").cast("double")
    skew = F.when((n > 2) & (F.col("std") > 0), F.col("s") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    kurt = F.when((n > 3) & (F.col("std") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6)).otherwise(0.0)
    g = g.select(key, "n", "mean", "std", "variance", skew.alias("skew"), kurt.alias("kurtosis"))
    return g.join(blocks.quantiles(df, x, {f"q{round(100 * q)}": blocks.nearest(q) for q in (0.25, 0.5, 0.75)}, key).drop("n"), key)


def standardized(df: DataFrame, x: str, key: str = "symbol") -> DataFrame:
    """zscore over the whole series (0 without spread)."""
    w = W.partitionBy(key)
    return df.withColumn("zscore", F.coalesce((F.col(x) - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0)), F.lit(0.0)))


def winsorized(df: DataFrame, x: str, low: float = 0.05, high: float = 0.95, key: str = "symbol") -> DataFrame:
    """x clamped to its nearest-rank quantiles; nulls stay."""
    edge = blocks.quantiles(df, x, {"_lo": blocks.nearest(low), "_hi": blocks.nearest(high)}, key).select(F.col(key).alias("_key"), "_lo", "_hi")
    clamped = F.when(F.col(x).isNotNull(), F.greatest(F.least(F.col(x), F.col("_hi")), F.col("_lo")))
    return df.join(edge, F.col(key).eqNullSafe(F.col("_key")), "left").select(*df.columns, clamped.alias("winsorized"))


def spearman(df: DataFrame, x: str, y: str, key: str = "symbol") -> DataFrame:
    """Rank correlation; ties get their average rank.  Rows of equal values are counted before they meet their ranks."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key, x, y).agg(F.count("*").cast("double").alias("_w"))
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rank = lambda c, name: blocks.ranks(rows, c, key).select(key, c, (F.col("below") + (F.col("count") + 1) / 2).alias(name))
    r = pairs.join(rank(x, "a"), [key, x]).join(rank(y, "b"), [key, y])
    #: Ranks are counted from their mean, (n + 1) / 2, so that the sums keep their digits.
    n = r.groupBy(key).agg(F.sum("_w").alias("_n"))
    r = r.join(n, key).withColumns({"a": F.col("a") - (F.col("_n") + 1) / 2, "b": F.col("b") - (F.col("_n") + 1) / 2})
    s = lambda e: F.sum(F.col("_w") * e)
    g = r.groupBy(key).agg(s(F.col("a") * F.col("b")).alias("c"), s(F.col("a") * F.col("a")).alias("va"), s(F.col("b") * F.col("b")).alias("vb"))
    return g.select(key, F.coalesce(F.col("c") / F.nullif(F.sqrt(F.col("va") * F.col("vb")), F.lit(0.0)), F.lit(0.0)).alias("spearman"))


# --- exports

def to_csv(df: DataFrame, path: str) -> None:
    """Delimited text; every file has a header that starts with a byte order mark, for spreadsheets."""
    head = [F.col(c).alias(("\ufeff" if i == 0 else "") + c) for i, c in enumerate(df.columns)]
    df.select(*head).write.mode("overwrite").option("header", True).csv(path)


def backup(path: str, **tables: DataFrame) -> None:
    """Every table as Parquet below a folder."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def report(rows: pd.DataFrame, title: str) -> str:
    """A Markdown table of a small result."""
    head = list(rows.columns)
    body = ["| " + " | ".join("" if pd.isna(v) else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows.itertuples(index=False)]
    return "\n".join([f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *body, ""])
