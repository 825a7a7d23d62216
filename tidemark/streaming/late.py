"""Indicators of a table of bars that late bars still reach.

Bars, the plan's values and, for each symbol, the state at the end of each partition (a month, unless told otherwise) are keyed
tables.  A batch of bars is inserted; for each of its symbols the state before its earliest bar's partition is fetched, and
only the bars from that partition on are read and run again, so what a batch costs is bounded by the suffix that it changes.
Bars in order touch the last partition alone.  ``sink`` is for ``foreachBatch``: batches are noted by number, a repeated one does
nothing, and one that was cut off is done again with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.resume import INPUTS, Resumable, State
from ..plans.staged import Plan
from ..sources.shared import checkpointed
from ..sources.tables import MONTH, Counts, KeyedTable

_STATE = "symbol string, block string, n long, sums array<double>, carries array<double>, tail array<double>"


@dataclass(frozen=True)
class Done:
    """bars: what the insert did; recomputed: rows read and run again."""

    bars: Counts
    recomputed: int


class LiveIndicators:
    def __init__(self, spark: SparkSession, path: str, plan: Plan, kind: str = "date", part: str = MONTH):
        """kind: of trade_date, ``date`` or ``timestamp``; part: SQL of a bar's partition, ascending with its date."""
        self.plan, self.names, self.kind = Resumable(plan), list(plan.outputs), kind
        key = ("symbol", "trade_date")
        self.bars = KeyedTable(spark, f"{path}/bars", f"symbol string, trade_date {kind}, " + ", ".join(f"{c} double" for c in INPUTS), key, part)
        self.values = KeyedTable(spark, f"{path}/values", f"symbol string, trade_date {kind}, " + ", ".join(f"{n} double" for n in self.names), key, part)
        self.states = KeyedTable(spark, f"{path}/states", _STATE, ("symbol", "block"), "block")

    def sink(self):
        return lambda df, number: self.apply(df, number) and None

    def apply(self, new: DataFrame, batch: int | str | None = None) -> Done:
        """new: symbol, trade_date and values of bars; of those that are there already the old ones stay."""
        if batch is not None and (before := self.values.done(batch)):
            return Done(self.bars.done(batch), before.skipped)
        new = new.select("symbol", F.col("trade_date").cast(self.kind).alias("trade_date"), *[(F.col(c) if c in new.columns else F.lit(None)).cast("double").alias(c) for c in INPUTS])
        counts = self.bars.insert_or_ignore(new, batch)
        first = new.select("symbol", F.expr(self.bars.part).alias("p")).groupBy("symbol").agg(F.min("p").alias("_p0"))
        since = first.agg(F.min("_p0")).first()[0]
        if since is None:
            return Done(counts, 0)
        #: Names of states alone, to find each symbol's last one before; then these states.
        wanted = self.states.read().select("symbol", "p").join(first, "symbol").filter("p < _p0").groupBy("symbol").agg(F.max("p").alias("p"))
        blocks = [r["p"] for r in wanted.select("p").distinct().collect()]
        start = self.states.read(blocks).join(wanted, ["symbol", "p"], "left_semi")
        seen = Observation()
        suffix = self.bars.read(since=since).join(first, "symbol").filter("p >= _p0").drop("_p0").observe(seen, F.count("*").alias("rows"))
        plan, names = self.plan, self.names

        def run(bars: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            symbol = bars["symbol"].iloc[0] if len(bars) else None
            at = plan.start()
            if len(state):
                s = state.iloc[0]
                at = State(int(s["n"]), list(s["sums"]), list(s["carries"]), list(s["tail"]))
            out = []
            for p, part in bars.sort_values("trade_date").groupby("p", sort=True):
                values, at = plan.advance(at, {c: part[c].to_numpy(float) for c in INPUTS})
                out.append(pd.DataFrame({"symbol": symbol, "trade_date": part["trade_date"].to_numpy(), "p": p} | {n: np.where(np.isnan(v), None, v) for n, v in values.items()}))
                out.append(pd.DataFrame({"symbol": [symbol], "p": [p], "n": [at.n], "sums": [[float(v) for v in at.sums]], "carries": [[float(v) for v in at.carries]], "tail": [at.tail]}))
            columns = ["symbol", "trade_date", "p", *names, "n", "sums", "carries", "tail"]
            both = pd.concat(out, ignore_index=True).reindex(columns=columns) if out else pd.DataFrame(columns=columns)
            for c in ("sums", "carries", "tail"):
                both[c] = [v if isinstance(v, list) else None for v in both[c]]
            return both

        schema = f"symbol string, trade_date {self.kind}, p string, " + ", ".join(f"{n} double" for n in names) + ", n long, sums array<double>, carries array<double>, tail array<double>"
        #: Written before it goes into the tables that it was read from.
        found = checkpointed(suffix.groupBy("symbol").cogroup(start.groupBy("symbol")).applyInPandas(run, schema))
        self.values.upsert(found.filter("n IS NULL").select("symbol", "trade_date", *names))
        self.states.upsert(found.filter("n IS NOT NULL").select("symbol", F.col("p").alias("block"), "n", "sums", "carries", "tail"))
        rows = seen.get["rows"]
        self.values._note(batch, Counts(0, 0, rows, 0))
        return Done(counts, rows)
