import datetime as dt

import numpy as np
import pytest

from tidemark.sources import files


def test_csv(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text('日期,开盘,收盘,最高,最低,成交量\n2020-1-2,1,2,3,0.5,10\n"20200103","1","x","3","1","5"\n2020-01-04,1,2\nbad,1,2,3,4,5\n')
    rows = files.read_csv(spark, str(tmp_path / "AAA.csv")).orderBy("trade_date").collect()
    assert [(r["symbol"], r["trade_date"], r["close"], r["high"]) for r in rows] == [("AAA", dt.date(2020, 1, 2), 2.0, 3.0), ("AAA", dt.date(2020, 1, 3), 0.0, 3.0)]
    assert files.columns_of("a,b,c")["amount"] == 6


def test_day_files(spark, tmp_path):
    r = np.zeros(3, files.DAY_RECORD)
    r["date"], r["open"], r["close"], r["volume"], r["amount"] = [19800101, 20200102, 20200103], 1000, 1234, 7, 5.5
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "sh600519.day").write_bytes(r.tobytes())
    rows = files.read_day_files(spark, str(tmp_path)).orderBy("trade_date").collect()
    assert [(x["symbol"], x["trade_date"], x["close"]) for x in rows] == [("SH600519", dt.date(2020, 1, 2), 12.34), ("SH600519", dt.date(2020, 1, 3), 12.34)]
    (tmp_path / "sz000001.day").write_bytes(b"123")
    with pytest.raises(Exception, match="no whole number"):
        files.read_day_files(spark, str(tmp_path)).collect()


def test_feed_lines(spark):
    d = spark.createDataFrame([("A", "2020-01-02,1,2,3,0.5,10,20,0,0,0,1.5"), ("A", "x")], "symbol string, line string")
    rows = files.feed_lines(d).collect()
    assert len(rows) == 1 and rows[0]["close"] == 2.0 and rows[0]["high"] == 3.0 and rows[0]["turnover"] == 0.015
