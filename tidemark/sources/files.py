"""Bars from files: delimited text, 32-byte binary day records, and feed lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of header names that mark a column, in both languages (fixed values).
HEADER = {"date": ("date", "日期"), "open": ("open", "开盘"), "high": ("high", "最高"), "low": ("low", "最低"), "close": ("close", "收盘"), "volume": ("vol", "成交量"), "amount": ("amount", "成交额")}
DAY_RECORD = np.dtype([("date", "<i4"), ("open", "<i4"), ("high", "<i4"), ("low", "<i4"), ("close", "<i4"), ("amount", "<f4"), ("volume", "<i4"), ("rest", "<i4")])
FIRST_DAY = 19900101
FEED = "date string, open double, close double, high double, low double, volume double, amount double, amplitude double, pct double, change double, turnover double"


def columns_of(header: str) -> dict[str, int]:
    """Places of the columns in a header line; without one, date, open, high, low, close, volume, amount in order."""
    names = [h.strip().strip('"').lower() for h in header.split(",")]
    found: dict[str, int] = {}
    for key, marks in HEADER.items():
        at = next((i for i, n in enumerate(names) if any(m in n for m in marks) and i not in found.values()), None)
        if at is not None:
            found[key] = at
    if not {"date", "open", "high", "low", "close"} <= set(found):
        return {k: i for i, k in enumerate(HEADER)}
    return {"volume": 5, "amount": 6} | found


def day(x: Column) -> Column:
    """``Y-M-D`` or ``YYYYMMDD`` as a date, else null."""
    parts = F.split(x, "-")
    dashed = F.concat_ws("-", F.lpad(F.get(parts, F.lit(0)), 4, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(2)), 2, "0"))
    text = F.when(x.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))).when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), dashed)
    return text.try_cast("date")


def read_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars of delimited files with one kind of header; symbol is the file's name unless given.  Lines of fewer than six
    fields, or without a date (the header), are left out; a number that cannot be read is 0."""
    lines = spark.read.text(path)
    first = lines.first()
    name = F.lit(symbol) if symbol else F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    return csv_lines(lines.select(name.alias("symbol"), "value"), first["value"] if first else "")


def csv_lines(lines: DataFrame, header: str) -> DataFrame:
    """Bars of lines (symbol, value) under a header."""
    at = columns_of(header)
    fields = lines.select("symbol", F.transform(F.split("value", ","), lambda x: F.btrim(x, F.lit(' "\r'))).alias("f")).filter(F.size("f") >= 6)
    number = lambda k: F.coalesce(F.get("f", F.lit(at[k])).try_cast("double"), F.lit(0.0))
    rows = fields.select("symbol", day(F.get("f", F.lit(at["date"]))).alias("trade_date"), *[number(k).alias(k) for k in ("open", "high", "low", "close", "volume", "amount")], F.lit(None).cast("double").alias("turnover"))
    return rows.filter("trade_date IS NOT NULL")


def read_day_files(spark: SparkSession, path: str) -> DataFrame:
    """Bars of binary day files (``sh600519.day``) below a folder: symbol is exchange and code; prices are stored x 100.  A
    file whose size is no multiple of 32 is an error; records before 1990 are left out."""
    return day_records(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.day").load(path).select("path", "content"))


def to_day_records(bars: DataFrame) -> DataFrame:
    """path and content of a binary day file for each symbol, as ``day_records`` reads them; prices keep two places.  A file
    holds one symbol's whole history, so a symbol is written by one task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date")
        r = np.zeros(len(pdf), DAY_RECORD)
        r["date"] = pd.to_datetime(pdf["trade_date"]).dt.strftime("%Y%m%d").astype(int)
        for k in ("open", "high", "low", "close"):
            r[k] = (pdf[k] * 100).round()
        r["amount"], r["volume"] = pdf["amount"], pdf["volume"]
        return pd.DataFrame({"path": [f"{pdf['symbol'].iloc[0].lower()}.day"], "content": [r.tobytes()]})

    return bars.groupBy("symbol").applyInPandas(one, "path string, content binary")


def day_records(files: DataFrame) -> DataFrame:
    """Bars of binary day files, given as path and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(raw) % DAY_RECORD.itemsize:
                    raise ValueError(f"{name}: {len(raw)} bytes are no whole number of records")
                r = np.frombuffer(raw, DAY_RECORD)
                r = r[r["date"] >= FIRST_DAY]
                cols = [pa.array([name] * len(r)), pa.array(r["date"].astype(np.int32)), *[pa.array(r[k] / 100.0) for k in ("open", "high", "low", "close")], pa.array(r["volume"].astype(float)), pa.array(r["amount"].astype(float))]
                yield pa.RecordBatch.from_arrays(cols, names=["path", "day", "open", "high", "low", "close", "volume", "amount"])

    rows = files.mapInArrow(run, "path string, day int, open double, high double, low double, close double, volume double, amount double")
    code = F.upper(F.regexp_extract("path", r"(?i)(sh|sz|bj)(\d{6})\.day$", 1))
    return rows.select(F.concat(code, F.regexp_extract("path", r"(\d{6})\.day$", 1)).alias("symbol"), day(F.col("day").cast("string")).alias("trade_date"), "open", "high", "low", "close", "volume", "amount", F.lit(None).cast("double").alias("turnover"))


def feed_lines(df: DataFrame, line: str = "line", symbol: str = "symbol") -> DataFrame:
    """Bars of lines ``date,open,close,high,low,volume,amount,amplitude,pct,change,turnover``; turnover there is in per cent."""
    x = df.select(symbol, F.from_csv(line, FEED).alias("r"))
    return x.select(F.col(symbol).alias("symbol"), day(F.substring("r.date", 1, 10)).alias("trade_date"), "r.open", "r.high", "r.low", "r.close", "r.volume", "r.amount", (F.col("r.turnover") / 100).alias("turnover")).filter("trade_date IS NOT NULL")
