"""Per-symbol state of streams: rules that are polled at every bar, and indicators that go on bar by bar.

Both keep their state in the state store (``transformWithStateInPandas``, which wants RocksDB: ``use_rocksdb``), so a query that
is started again from its checkpoint neither repeats nor loses an output.  With ``ttl`` (milliseconds) the state of a symbol that
gets no rows for so long goes; such a query runs batches without data to that end, so it wants a trigger that goes on, not
``availableNow``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.relational import LOOK_BACK
from ..plans.resume import INPUTS, Resumable, State
from ..plans.staged import Plan

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RULES = "rule_id long, symbol string, condition_type string, params string, enabled boolean, last_triggered date"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# --- rules

def _number(params: dict, name: str, default):
    """A whole number of the parameters, as the batch reads it."""
    try:
        return int(params[name]) if params.get(name) is not None else default
    except (TypeError, ValueError):
        return default


def _real(params: dict, name: str, default):
    try:
        return float(params[name]) if params.get(name) is not None else default
    except (TypeError, ValueError):
        return default


def fires(kind: str, params: dict, close: list[float], volume: list[float]) -> bool:
    """Whether a rule fires on the last of these bars."""
    if kind == "price_breakout":
        level, way = _real(params, "price", None), params.get("direction") or "above"
        return level is not None and (close[-1] > level if way == "above" else way == "below" and close[-1] < level)
    if kind == "ma_cross":
        short, long, way = _number(params, "short_period", 5), _number(params, "long_period", 20), params.get("direction") or "golden"
        if not 0 < short < long or len(close) < long + 1:
            return False
        mean = lambda k, back: sum(close[len(close) - back - k : len(close) - back]) / k
        now, before = mean(short, 0) - mean(long, 0), mean(short, 1) - mean(long, 1)
        return before <= 0 < now if way == "golden" else way == "dead" and now < 0 <= before
    if kind == "volume_spike":
        look = _number(params, "lookback", 20)
        if look < 1 or len(volume) < look + 1:
            return False
        usual = sum(volume[-look - 1 : -1]) / look
        return usual > 0 and volume[-1] > _real(params, "multiplier", 2.0) * usual
    return False


class _Rules(StatefulProcessor):
    """The last LOOK_BACK bars as one value, the rules as a map from their id."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getValueState("bars", "last timestamp, close array<double>, volume array<double>", self.ttl)
        self.rules = handle.getMapState("rules", "rule_id long", "kind string, params string, enabled boolean, day string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True)
        for r in got[got["rule_id"].notna()].sort_values(["rule_id", "ts"], na_position="first").itertuples(index=False):
            known = self.rules.getValue((int(r.rule_id),)) if self.rules.containsKey((int(r.rule_id),)) else None
            days = [d for d in (known[3] if known else "", str(r.last_triggered)[:10] if pd.notna(r.last_triggered) else "") if d]
            self.rules.updateValue((int(r.rule_id),), (r.condition_type or "", r.params or "", bool(r.enabled), max(days, default="")))
        bars = got[got["rule_id"].isna()].sort_values("ts").drop_duplicates("ts")
        out = []
        if len(bars):
            state = self.bars.get() if self.bars.exists() else (None, [], [])
            last, close, volume = state[0], list(state[1]), list(state[2])
            live = []
            for (i,), (kind, params, enabled, day) in self.rules.iterator():
                try:
                    read = json.loads(params)
                except ValueError:
                    read = {}
                live.append([i, kind, read if isinstance(read, dict) else {}, day, enabled, params])
            live.sort(key=lambda x: x[0])
            fired = set()
            for ts, c, v in zip(bars["ts"], bars["close"], bars["volume"], strict=True):
                if last is not None and ts <= pd.Timestamp(last):
                    continue
                last = ts
                close, volume = (close + [float(c)])[-LOOK_BACK:], (volume + [float(v)])[-LOOK_BACK:]
                for rule in live:
                    i, kind, params, day, enabled, _ = rule
                    if enabled and day != (today := str(ts.date())) and fires(kind, params, close, volume):
                        out.append((i, kind, ts, float(c)))
                        rule[3] = today
                        fired.add(i)
            self.bars.update((pd.Timestamp(last).to_pydatetime(), close, volume))
            for i, kind, _, day, enabled, raw in live:
                if i in fired:
                    self.rules.updateValue((i,), (kind, raw, enabled, day))
        ids, kinds, stamps, prices = zip(*out, strict=True) if out else ((), (), (), ())
        yield pd.DataFrame({"rule_id": pd.Series(ids, dtype="int64"), "symbol": pd.Series([key[0]] * len(ids), dtype="object"), "condition_type": pd.Series(kinds, dtype="object"), "trade_date": pd.Series(stamps, dtype="datetime64[ns]"), "close": pd.Series(prices, dtype="float64")})


def poll_rules(bars: DataFrame, rules: DataFrame, ttl: int | None = None) -> DataFrame:
    """rule_id, symbol, condition_type, trade_date and close of each rule's first firing of a day, polled at every bar.

    bars: symbol, ts, close, volume; rules: as ``RULES``; both are streams.  A later row of a rule replaces it (``enabled`` false
    silences it), keeping the day on which it last fired.  A rule applies to the bars of the micro-batch that it comes with and
    to later ones.  Bars of a symbol that are not later than its last are dropped.  What is held of a symbol is LOOK_BACK bars
    and its rules.
    """
    none = lambda kind: F.lit(None).cast(kind)
    tagged = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"), *[none(k).alias(n) for n, k in (("rule_id", "long"), ("condition_type", "string"), ("params", "string"), ("enabled", "boolean"), ("last_triggered", "date"))])
    both = tagged.unionByName(rules.select("symbol", none("timestamp").alias("ts"), none("double").alias("close"), none("double").alias("volume"), F.col("rule_id").cast("long").alias("rule_id"), "condition_type", "params", "enabled", "last_triggered"))
    out = "rule_id long, symbol string, condition_type string, trade_date timestamp, close double"
    return both.groupBy("symbol").transformWithStateInPandas(_Rules(ttl), out, "Append", "ProcessingTime" if ttl else "None")


# --- indicators

class _Indicators(StatefulProcessor):
    def __init__(self, plan: Resumable, ttl: int | None):
        self.plan, self.ttl = plan, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "n long, last timestamp, sums array<double>, carries array<double>, tail array<double>", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable").drop_duplicates("ts")
        state, last = self.plan.start(), None
        if self.at.exists():
            n, last, sums, carries, tail = self.at.get()
            state = State(n, list(sums), list(carries), list(tail))
            got = got[got["ts"] > pd.Timestamp(last)]
        values, state = self.plan.advance(state, {c: got[c].to_numpy(float) for c in INPUTS})
        if len(got):
            self.at.update((int(state.n), got["ts"].iloc[-1].to_pydatetime(), [float(v) for v in state.sums], [float(v) for v in state.carries], state.tail))
        yield pd.DataFrame({"symbol": [key[0]] * len(got), "ts": got["ts"].to_numpy("datetime64[ns]")} | {k: np.where(np.isnan(v), None, v) for k, v in values.items()})


def indicators(bars: DataFrame, plan: Plan, ttl: int | None = None) -> DataFrame:
    """symbol, ts and the outputs of the plan for every bar of a stream, as the batch gives them for the whole series.

    bars: symbol, ts and the values of a bar (``INPUTS``; columns that are not there are missing).  A symbol's state is bounded
    by the plan's longest window.  Bars that are not later than their symbol's last are dropped; ``streaming.late`` takes them.
    """
    have = [F.col(c).cast("double").alias(c) if c in bars.columns else F.lit(None).cast("double").alias(c) for c in INPUTS]
    out = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), *[T.StructField(n, T.DoubleType()) for n in plan.outputs]])
    return bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), *have).groupBy("symbol").transformWithStateInPandas(_Indicators(Resumable(plan), ttl), out, "Append", "ProcessingTime" if ttl else "None")
