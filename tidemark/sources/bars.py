"""Bars: schema, derivation from the driver's tables, cleaning, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double, turnover double"
VALUES = ("open", "high", "low", "close", "volume", "amount", "turnover")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: symbol is the order priority; turnover is volume / 20, a stand-in for the traded fraction."""
    o = table(spark, sf_dir, "orders")
    return _bars(o.select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("trade_date"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("place")))


def bars_customers(spark: SparkSession, sf_dir: str, buckets: int = 64) -> DataFrame:
    """A wider universe: symbol is a bucket of the customer key."""
    o = table(spark, sf_dir, "orders")
    symbol = F.concat(F.lit("C"), F.lpad((F.col("o_custkey") % buckets).cast("string"), 3, "0"))
    return _bars(o.select(symbol.alias("symbol"), F.to_date("o_orderdate").alias("trade_date"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("place")))


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars: symbol is the event type; trade_date is the hour."""
    e = table(spark, sf_dir, "events")
    return _bars(e.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("trade_date"), F.col("value").alias("price"), F.struct("ts", "event_id").alias("place")))


def bars_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series: every order is a bar of the prices of its lines, an hour after the order before it by key."""
    line = table(spark, sf_dir, "lineitem")
    hour = F.timestamp_seconds(F.col("l_orderkey") * 3600)
    return _bars(line.select(F.lit("lines").alias("symbol"), hour.alias("trade_date"), F.col("l_extendedprice").alias("price"), F.col("l_linenumber").alias("place")))


def _bars(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol", "trade_date").agg(
        F.min_by("price", "place").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "place").alias("close"),
        F.count("*").cast("double").alias("volume"), F.sum("price").alias("amount"), (F.count("*") / F.lit(20.0)).alias("turnover"),
    )


SQL_ORDERS = """SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS trade_date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(o_totalprice) AS amount, count(*) / 20.0::DOUBLE AS turnover FROM orders GROUP BY 1, 2"""
SQL_CUSTOMERS = """SELECT 'C' || lpad(CAST(o_custkey % 64 AS VARCHAR), 3, '0') AS symbol, CAST(o_orderdate AS DATE) AS trade_date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(o_totalprice) AS amount, count(*) / 20.0::DOUBLE AS turnover FROM orders GROUP BY 1, 2"""
SQL_EVENTS = """SELECT event_type AS symbol, date_trunc('hour', ts) AS trade_date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount, count(*) / 20.0::DOUBLE AS turnover FROM events GROUP BY 1, 2"""


def clean(bars: DataFrame) -> DataFrame:
    """NaN becomes NULL; one row a key is kept, the first by its values."""
    from ..operators.relational import first_of

    values = {c: F.when(~F.isnan(c), F.col(c)) for c in VALUES if c in bars.columns}
    return first_of(bars.withColumns(values), ["symbol", "trade_date"])


def resample(bars: DataFrame, to: str) -> DataFrame:
    """Weekly (ISO) or monthly bars, labelled by their last day; turnover is that of the last bar."""
    if to not in ("week", "month"):
        raise ValueError(f"unknown period {to!r}")
    return bars.groupBy("symbol", F.date_trunc(to, "trade_date").alias("period")).agg(
        F.max("trade_date").alias("trade_date"), F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "trade_date").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.max_by("turnover", "trade_date").alias("turnover"),
    ).drop("period")
