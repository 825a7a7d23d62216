"""Streams against the batch: rules polled at every bar, indicators with state, late bars, tables that are written to."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators, relational
from tidemark.plans.resume import INPUTS, Resumable
from tidemark.sources import bars as B
from tidemark.sources.tables import KeyedTable
from tidemark.streaming import bars as S
from tidemark.streaming import late
from tidemark.streaming import state as live

DAY = dt.date(2026, 1, 1)


def series(n, seed):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return pd.DataFrame({"open": close * 0.99, "high": close * 1.02, "low": close * 0.97, "close": close, "volume": rng.integers(1, 9, n) * 100.0, "amount": close * 50, "turnover": 0.05})


def rows_of(symbol, d, start=0):
    return [(symbol, DAY + dt.timedelta(days=start + i), *map(float, r)) for i, r in enumerate(d.itertuples(index=False))]


@pytest.mark.parametrize("name", ["sma", "ema", "rsi", "macd", "atr", "kdj", "bb", "obv", "vwap", "adx", "aroon", "median", "kama", "vidya", "dema", "cci", "ichimoku", "kvo"])
def test_resumed_plans_equal_the_whole(name):
    r, d = Resumable(indicators.plan([name])), series(260, 3)
    d.loc[[40, 41, 90], "close"] = np.nan
    columns = {c: d[c].to_numpy(float) for c in INPUTS}
    whole, _ = r.advance(r.start(), columns)
    for cuts in ([0, 1, 2, 3, 30, 41, 42, 100, 260], list(range(0, 261, 26))):
        state, parts = r.start(), []
        for a, b in zip(cuts, cuts[1:]):
            out, state = r.advance(state, {c: v[a:b] for c, v in columns.items()})
            parts.append(out)
        for k in whole:
            assert np.allclose(np.concatenate([p[k] for p in parts]), whole[k], rtol=1e-9, atol=1e-9, equal_nan=True), (name, k)


def test_what_cannot_be_resumed():
    for name in ("supertrend", "fractals", "seasonal", "fib_retracement", "sr_detect"):
        with pytest.raises(ValueError):
            Resumable(indicators.plan([name]))


def test_indicators_as_a_stream(spark, tmp_path):
    live.use_rocksdb(spark)
    frames = {"A": series(90, 1), "B": series(70, 2)}
    rows = [(s, dt.datetime.combine(d, dt.time()), *v) for s, f in frames.items() for s, d, *v in rows_of(s, f)]
    schema = B.SCHEMA.replace("trade_date date", "ts timestamp")
    plan = indicators.plan(["ema", "rsi", "macd", "atr", "sma", "obv"])
    for i, (a, b) in enumerate(((0, 25), (25, 26), (26, 90))):
        part = [r for r in rows if a <= (r[1].date() - DAY).days < b]
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        #: Each round is a query of its own that goes on from the checkpoint.
        S.run_available(live.indicators(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), plan), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("symbol", "ts").toPandas()
    want = plan.spark(spark.createDataFrame([(r[0], r[1].date(), *r[2:]) for r in rows], B.SCHEMA)).orderBy("symbol", "trade_date").toPandas()
    assert len(got) == len(rows) and list(got["symbol"]) == list(want["symbol"])
    for c in plan.outputs:
        assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), c


def test_rules_as_a_stream(spark, tmp_path):
    """The three kinds of rules, several bars a day, a rule that is changed later, and a restart."""
    live.use_rocksdb(spark)
    frames = {"A": series(120, 5), "B": series(100, 6)}
    rows = [(s, dt.datetime(2026, 1, 1) + dt.timedelta(hours=8 * i), float(c), float(v)) for s, f in frames.items() for i, (c, v) in enumerate(zip(f["close"], f["volume"], strict=True))]
    mid = float(frames["A"]["close"].median())
    rules = [(1, "A", "price_breakout", f'{{"direction":"above","price":{mid}}}', True, None), (2, "A", "price_breakout", f'{{"direction":"below","price":{mid}}}', True, dt.date(2026, 1, 3)), (3, "A", "ma_cross", '{"short_period":3,"long_period":8,"direction":"golden"}', True, None), (4, "B", "ma_cross", '{"direction":"dead"}', True, None), (5, "B", "volume_spike", '{"multiplier":1.3,"lookback":5}', True, None), (6, "B", "price_breakout", "no json", True, None), (7, "B", "volume_spike", '{"multiplier":0.1}', False, None), (8, "C", "volume_spike", "{}", True, None), (9, "A", "other", "{}", True, None)]
    schema = "symbol string, ts timestamp, close double, volume double"
    spark.createDataFrame(rules, live.RULES).coalesce(1).write.parquet(str(tmp_path / "rules"))
    cut = dt.datetime(2026, 1, 20, 8)
    for part in ([r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut]):
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "bars"))
        stream = live.poll_rules(spark.readStream.schema(schema).parquet(str(tmp_path / "bars")), spark.readStream.schema(live.RULES).parquet(str(tmp_path / "rules")))
        S.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    bars = spark.createDataFrame(rows, schema).withColumnRenamed("ts", "trade_date")
    want = relational.replay_alerts(spark.createDataFrame(rules, live.RULES), bars)
    got = spark.read.parquet(str(tmp_path / "out"))
    key = lambda df: sorted(tuple(r) for r in df.select("rule_id", "symbol", "condition_type", "trade_date", "close").collect())
    assert key(got) == key(want) and {r[0] for r in key(got)} == {1, 2, 3, 4, 5}
    #: Rule 1 is silenced, and a new one comes, between two runs; nothing earlier is repeated.
    n = got.count()
    spark.createDataFrame([(1, "A", "price_breakout", "{}", False, None), (10, "A", "price_breakout", '{"price":0}', True, None)], live.RULES).coalesce(1).write.mode("append").parquet(str(tmp_path / "rules"))
    more = [("A", dt.datetime(2026, 3, 1, h), 1e9, 1.0) for h in (9, 12)] + [("A", dt.datetime(2026, 1, 2), 1e9, 1.0)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "bars"))
    stream = live.poll_rules(spark.readStream.schema(schema).parquet(str(tmp_path / "bars")), spark.readStream.schema(live.RULES).parquet(str(tmp_path / "rules")))
    S.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    new = [r for r in key(spark.read.parquet(str(tmp_path / "out"))) if r[3] >= dt.datetime(2026, 3, 1)]
    assert (10, 9) in [(r[0], r[3].hour) for r in new] and {r[0] for r in new} <= {3, 10} and len(new) == len({r[0] for r in new})
    assert spark.read.parquet(str(tmp_path / "out")).count() == n + len(new)


def test_state_that_expires(spark, tmp_path):
    """With a time to live the query goes on; what it gives is the same while the state lasts."""
    live.use_rocksdb(spark)
    schema = B.SCHEMA.replace("trade_date date", "ts timestamp")
    rows = [("A", dt.datetime.combine(d, dt.time()), *v) for _, d, *v in rows_of("A", series(30, 1))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    plan = indicators.plan(["ema"])
    q = live.indicators(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), plan, ttl=3_600_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(120):  # it never has nothing to do, so it is watched
            time.sleep(0.5)
            if any(p["numInputRows"] for p in q.recentProgress):
                break
    finally:
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).filter("ema IS NOT NULL").count() == plan.spark(spark.createDataFrame([(r[0], r[1].date(), *r[2:]) for r in rows], B.SCHEMA)).filter("ema IS NOT NULL").count()


def test_replay_is_the_daily_check(spark):
    """Daily bars: polling at every bar is checking every day that has one."""
    f = {"A": series(60, 8), "B": series(60, 9)}
    bars = spark.createDataFrame([r for s, d in f.items() for r in rows_of(s, d)], B.SCHEMA)
    rules = spark.createDataFrame([(1, "A", "ma_cross", '{"short_period":3,"long_period":8}', True, None), (2, "B", "volume_spike", '{"multiplier":1.2,"lookback":4}', True, None), (3, "A", "price_breakout", '{"direction":"below","price":100}', True, None)], live.RULES)
    got = sorted((r["rule_id"], r["trade_date"]) for r in relational.replay_alerts(rules, bars).collect())
    want = sorted((r["rule_id"], r["trade_date"]) for i in range(0, 60, 7) for r in relational.check_alerts(rules, bars, str(DAY + dt.timedelta(days=i))).collect())
    assert want and want == [x for x in got if (x[1] - DAY).days % 7 == 0]


def test_late_bars(spark, tmp_path):
    """Bars that come late, twice or out of order change what a recomputation changes, and little is read for it."""
    plan = indicators.plan(["ema", "rsi", "macd", "atr", "obv", "sma"])
    table = late.LiveIndicators(spark, str(tmp_path / "live"), plan)
    every = rows_of("A", series(300, 1)) + rows_of("B", series(200, 2)) + rows_of("C", series(40, 4), start=200)
    held = [r for r in every if (r[0], (r[1] - DAY).days) in {("A", 230), ("B", 5), ("B", 199), ("C", 200), ("A", 0)}]
    frame = lambda rows: spark.createDataFrame(rows, B.SCHEMA)

    def right(rows):
        want = plan.spark(frame(rows)).orderBy("symbol", "trade_date").toPandas()
        got = table.values.read().orderBy("symbol", "trade_date").toPandas()
        assert list(zip(got["symbol"], got["trade_date"])) == list(zip(want["symbol"], want["trade_date"]))
        for c in plan.outputs:
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), c

    there = [r for r in every if r not in held]
    first = table.apply(frame(there), 0)
    assert first.bars.inserted == len(there) == first.recomputed
    right(there)
    done = table.apply(frame([r for r in held if r[0] == "A" and r[1] != DAY] * 2), 1)
    assert (done.bars.inserted, done.bars.skipped) == (1, 1) and 70 <= done.recomputed <= 70 + 31
    again = table.apply(frame(held), 1)
    assert again == done and table.values.read().count() == len(there) + 1  # a batch of that number was there
    some = table.apply(frame([r for r in held if r[0] == "B"]), 2)
    assert some.recomputed == 200  # of B alone
    assert table.apply(frame([r for r in held if r[0] == "C"]), 3).recomputed == 40
    assert table.apply(frame(held), 4).bars.inserted == 1
    right(every)
    assert table.apply(frame(every).limit(0), 5).recomputed == 0


def test_late_bars_in_a_stream(spark, tmp_path):
    plan = indicators.plan(["ema", "rsi"])
    table = late.LiveIndicators(spark, str(tmp_path / "live"), plan, "timestamp", "date_format(trade_date, 'yyyy-MM-dd')")
    every = [(s, dt.datetime(2026, 1, 1) + dt.timedelta(hours=i), *v) for s, f in (("A", series(80, 1)), ("B", series(60, 2))) for i, v in enumerate(f.to_numpy().tolist())]
    schema = B.SCHEMA.replace("date date", "date timestamp")
    for part in (every[1::2], every[::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(table.sink()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = plan.spark(spark.createDataFrame(every, schema)).orderBy("symbol", "trade_date").toPandas()
    got = table.values.read().orderBy("symbol", "trade_date").toPandas()
    assert len(got) == 140
    for c in plan.outputs:
        assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, equal_nan=True)


def test_keyed_tables(spark, tmp_path):
    import os

    t = KeyedTable(spark, str(tmp_path / "t"), "symbol string, trade_date date, close double, note string", ("symbol", "trade_date"))
    row = lambda s, m, d, c, n=None: (s, dt.date(2026, m, d), c, n)
    frame = lambda rows: spark.createDataFrame(rows, t.schema)
    files = lambda m: {f: os.stat(tmp_path / f"t/data/p=2026-0{m}/{f}").st_mtime_ns for f in os.listdir(tmp_path / f"t/data/p=2026-0{m}") if f.endswith(".parquet")}
    assert t.read().count() == 0
    first = [row("A", 1, 1, 1.0), row("A", 2, 1, 2.0), row("B", 2, 1, 3.0, "x"), row("B", 2, 1, 9.0), row(None, 3, 1, 4.0)]
    got = t.insert_or_ignore(frame(first), batch=0)
    assert (got.inserted, got.skipped, got.partitions) == (4, 1, 3)
    assert t.insert_or_ignore(frame(first[:1]), batch=0) == got and t.read().count() == 4
    again = t.insert_or_ignore(frame(first + [row("C", 2, 5, 7.0)]))
    assert (again.inserted, again.skipped) == (1, 5) and t.read().count() == 5
    before = files(1), files(3)
    up = t.upsert(frame([row("B", 2, 1, None, None), row("A", 2, 1, 5.0, "y"), row("D", 2, 9, 6.0)]), batch="u", keep=("close",))
    assert (up.inserted, up.updated, up.skipped, up.partitions) == (1, 2, 0, 1)
    assert before == (files(1), files(3))  # partitions that no row falls into keep their files
    assert t.upsert(frame([row("B", 2, 1, 77.0)]), batch="u") == up
    have = {(r["symbol"], r["trade_date"].month, r["trade_date"].day): (r["close"], r["note"]) for r in t.read().collect()}
    assert have == {("A", 1, 1): (1.0, None), ("A", 2, 1): (5.0, "y"), ("B", 2, 1): (3.0, None), ("C", 2, 5): (7.0, None), ("D", 2, 9): (6.0, None), (None, 3, 1): (4.0, None)}
    assert t.insert_or_ignore(frame([row(None, 3, 1, 8.0)])).inserted == 0 and t.insert_or_ignore(frame([])).partitions == 0
    assert t.read(["2026-02"]).count() == 4 and t.read(since="2026-03").count() == 1
    with pytest.raises(ValueError):
        t.insert_or_ignore(frame(first).withColumn("extra", F.lit(1)))
