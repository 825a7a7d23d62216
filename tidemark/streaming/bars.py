"""Streaming bars from a tick stream (event_id, ts, event_type, value), and stateful alerts.

Late ticks are taken until the watermark passes; a tick that arrives twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def ticks(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bars(events: DataFrame, period: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling bars; with a watermark a bar is complete, and appended, when no tick can reach it any more."""
    e = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    place = F.struct("ts", "event_id")
    g = e.groupBy(F.window("ts", period).alias("w"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", place).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", place).alias("close"),
        F.count("*").cast("double").alias("volume"), F.sum("value").alias("amount"),
    )
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "amount")


def first_wins(rows: DataFrame, key: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def spikes(rows: DataFrame, look_back: int = 20, factor: float = 3.0) -> DataFrame:
    """Bars whose volume exceeds ``factor`` times the mean of the ``look_back`` before; once a symbol and day.  The state of a
    symbol is its last volumes and the day of its last alert."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        volumes, day = state.get if state.exists else ("", "")
        past = [float(v) for v in volumes.split(",") if v]
        out = []
        for row in pd.concat(list(batches)).sort_values("ts").itertuples(index=False):
            mean = sum(past[-look_back:]) / look_back if len(past) >= look_back else None
            today = str(row.ts.date())
            if mean is not None and row.volume > factor * mean and today != day:
                out.append((key[0], row.ts, float(row.volume), mean))
                day = today
            past = (past + [float(row.volume)])[-look_back:]
        state.update((",".join(map(repr, past)), day))
        yield pd.DataFrame(out, columns=["symbol", "ts", "volume", "mean"])

    return rows.groupBy("symbol").applyInPandasWithState(run, "symbol string, ts timestamp, volume double, mean double", "volumes string, day string", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; exactly once, by the checkpoint."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
