"""Day files as a data source: ranges of records, pushed symbols, streams."""

import datetime as dt

import numpy as np
import pytest

from tidemark.sources import bars as B
from tidemark.sources import day, files
from tidemark.streaming import bars as S


def some(spark, symbols, n, start=0):
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=start + i), 10.0 + i % 7, 20.25 + i % 5, 5.5, 11.75 + k, float(100 + i), 1000.0, None) for k, s in enumerate(symbols) for i in range(n)]
    return spark.createDataFrame(rows, B.SCHEMA)


def key(df):
    return sorted(tuple(r)[:8] for r in df.select(*B.SCHEMA.replace(" string", "").replace(" date", "").replace(" double", "").split(", ")).collect())


def test_read(spark, tmp_path):
    day.register(spark)
    bars = some(spark, ["sh600000", "sz000001", "bj830000"], 100)
    assert day.write(bars, str(tmp_path / "d")) == 3
    (tmp_path / "d/readme.txt").write_text("no day file")
    df = spark.read.format("dayfile").option("records", 32).load(str(tmp_path / "d"))
    assert df.rdd.getNumPartitions() == 3 * 4
    want = [(s.upper(), *r) for s, *r in key(bars)]
    assert key(df) == sorted(want)
    one = df.filter("symbol = 'SZ000001'")
    assert key(one) == sorted(r for r in want if r[0] == "SZ000001") and one.rdd.getNumPartitions() == 4
    assert key(df.filter("symbol IN ('SZ000001', 'XX')").filter("close > 11")) == key(one.filter("close > 11")) and df.filter("symbol = 'none'").count() == 0
    single = spark.read.format("dayfile").load(str(tmp_path / "d/sh600000.day"))
    assert single.count() == 100
    assert key(files.read_day_files(spark, str(tmp_path / "d"))) == sorted(want)
    (tmp_path / "d/sh600009.day").write_bytes(b"x" * 33)
    with pytest.raises(Exception, match="no whole number"):
        spark.read.format("dayfile").load(str(tmp_path / "d")).count()


def test_odd_records(spark, tmp_path):
    day.register(spark)
    r = np.zeros(4, files.DAY_RECORD)
    r["date"], r["close"] = [19891231, 20200230, 20200229, 0], 1234
    (tmp_path / "sh600001.day").write_bytes(r.tobytes())
    (tmp_path / "sh600002.day").write_bytes(b"")
    got = spark.read.format("dayfile").load(str(tmp_path)).collect()
    assert [(x["symbol"], x["trade_date"], x["close"]) for x in got] == [("SH600001", dt.date(2020, 2, 29), 12.34)]


def test_stream(spark, tmp_path):
    day.register(spark)
    at = str(tmp_path / "d")
    day.write(some(spark, ["sh600000"], 50), at)
    stream = lambda: spark.readStream.format("dayfile").option("records", 20).load(at)
    S.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    day.write(some(spark, ["sz000001"], 30), at)
    S.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["symbol"]: r["count"] for r in got.groupBy("symbol").count().collect()} == {"SH600000": 50, "SZ000001": 30}
