"""Series of any length without one task a series: recurrences by an associative scan, and ranks and quantiles by prefix counts.

Rows are dealt by range of (key, order), so a key that holds all rows lies in many blocks, each small.  What must be known of the
blocks before is a few numbers a block and key; these alone meet in one place.  The dealt rows are written once (checkpoint), so
that the numbers of the blocks stay.  ``spark.checkpoint.dir`` names the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staged import Recurrence, recurrence_on
from ..sources.shared import checkpointed


def dealt(df: DataFrame, *order: str, blocks: int | None = None) -> DataFrame:
    """df by range of the columns, with ``_block``, ascending with them; rows that are equal in all of them share a block."""
    ranged = df.repartitionByRange(blocks, *order) if blocks else df.repartitionByRange(*order)
    return checkpointed(ranged.withColumn("_block", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[str], blocks: int | None = None) -> DataFrame:
    """df with ``_row``, from 0, its place in the order of the columns; rows equal in all of them are numbered in any order."""
    rows = dealt(df, *order, blocks=blocks)
    sizes = rows.groupBy("_block").agg(F.count("*").alias("_c"))
    sizes = sizes.select(F.col("_block").alias("_b"), F.coalesce(F.sum("_c").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_block").orderBy(*order)) - 1
    return rows.withColumn("_in", inside).join(F.broadcast(sizes), F.col("_block") == F.col("_b")).select(*df.columns, (F.col("_in") + F.col("_before")).alias("_row"))


# --- recurrences

def recurrences(df: DataFrame, wanted: dict[str, Recurrence], key: str = "symbol", order: str = "trade_date", blocks: int | None = None) -> DataFrame:
    """df with a column for each recurrence over its columns, as the kernel of a plan gives for a whole series.

    y[t] = a x[t] + b y[t-1] makes of the y before a block the y after it by a map y -> A + B y, and maps compose.  One pass
    gives each block's maps, and what it adds to a seed; per key these few rows are gone through in order; a second pass starts
    every block from what came before it.  Blocks run in parallel in both passes.  Rows equal in key and order are in no
    particular order.
    """
    rows = dealt(df, key, order, blocks=blocks)
    names = list(wanted)
    inputs = sorted({v for r in wanted.values() for v in r.inputs()})
    heads = {n: r.n if r.seed == "sma" else 1 if r.seed == "first" else 0 for n, r in wanted.items()}
    kind = rows.schema[key].dataType.simpleString()

    def arrays(t: pa.Table) -> dict[str, np.ndarray]:
        return {c: t.column(c).cast(pa.float64()).to_numpy().astype(float) for c in inputs}

    def factor(v, at: dict[str, np.ndarray], there: np.ndarray):
        return at[v][there] if isinstance(v, str) else v

    #: NaN is no value, as in the kernel.
    there = lambda c: F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    counts = rows.groupBy(F.col(key).alias("_key"), "_block").agg(*[there(wanted[n].x).alias(f"k{i}") for i, n in enumerate(names)])
    before = W.partitionBy("_key").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    counts = checkpointed(counts.select("_key", "_block", *[F.coalesce(F.sum(f"k{i}").over(before), F.lit(0)).alias(f"k{i}") for i in range(len(names))]))
    slim = rows.select(key, order, "_block", *[c for c in inputs if c not in (key, order)])

    def composed(t: pa.Table, seen: pa.Table) -> pa.Table:
        """The map of the values from the seed on, and what the block adds to the seed."""
        t = t.sort_by(order)
        at, out = arrays(t), {}
        for i, n in enumerate(names):
            r = wanted[n]
            x = at[r.x]
            there = x == x
            v, k0 = x[there], seen.column(f"k{i}")[0].as_py()
            need = min(max(heads[n] - k0, 0), len(v))
            a, b = factor(r.a, at, there), factor(r.b, at, there)
            rest = np.full(len(v) - need, 1.0)
            cut = lambda c: c[need:] if isinstance(c, np.ndarray) else c * rest  # noqa: B023, E731
            part = np.full(len(rest), np.nan)
            if len(rest):
                part, _ = recurrence_on(v[need:], cut(a), b[need:] if isinstance(b, np.ndarray) else b, 0.0, 0, [0.0, 1.0, 0.0])
            out |= {f"a{i}": [float(part[-1]) if len(rest) else 0.0], f"b{i}": [float(np.prod(cut(b)))], f"s{i}": [float(v[:need].sum())], f"n{i}": [len(v)]}
        return pa.table({"_key": t.column(key).slice(0, 1), "_block": t.column("_block").slice(0, 1)} | {c: pa.array(v, pa.int64() if c[0] == "n" else pa.float64()) for c, v in out.items()})

    maps = slim.groupBy(key, "_block").cogroup(counts.groupBy("_key", "_block")).applyInArrow(composed, f"_key {kind}, _block int, " + ", ".join(f"a{i} double, b{i} double, s{i} double, n{i} long" for i in range(len(names))))

    def carried(t: pa.Table) -> pa.Table:
        """What each block of one key starts from: the last value, the values seen and their sum."""
        t = t.sort_by("_block")
        out = {"_key": t.column("_key"), "_block": t.column("_block")}
        for i, n in enumerate(names):
            y, seen, total, head, rows_ = np.nan, 0, 0.0, heads[n], []
            if not isinstance(wanted[n].seed, str):
                y = float(wanted[n].seed)
            for a, b, s, k in zip(*[t.column(f"{c}{i}").to_pylist() for c in "absn"], strict=True):
                rows_.append((y, float(seen), total))
                total += s
                if k:
                    if seen < head <= seen + k:
                        y = total / head
                    if seen + k >= head:
                        y = a + b * y
                    seen += k
            for j, c in enumerate(("y", "k", "t")):
                out[f"{c}{i}"] = pa.array([r[j] for r in rows_], pa.float64())
        return pa.table(out)

    carry_type = ", ".join(f"y{i} double, k{i} double, t{i} double" for i in range(len(names)))
    carries = maps.groupBy("_key").applyInArrow(carried, f"_key {kind}, _block int, {carry_type}")

    def finished(t: pa.Table, start: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        at = arrays(t)
        for i, n in enumerate(names):
            r = wanted[n]
            get = lambda v: at[v] if isinstance(v, str) else v  # noqa: B023, E731
            y, _ = recurrence_on(get(r.x), get(r.a), get(r.b), r.seed, r.n, [start.column(f"{c}{i}")[0].as_py() for c in "ykt"])
            t = t.append_column(n, pa.array(y, pa.float64(), from_pandas=True))
        return t.drop_columns("_block")

    schema = T.StructType([*df.schema, *[T.StructField(n, T.DoubleType()) for n in names]])
    return rows.groupBy(key, "_block").cogroup(carries.groupBy("_key", "_block")).applyInArrow(finished, schema)


# --- ranks and quantiles

def ranks(df: DataFrame, x: str, key: str = "symbol", blocks: int | None = None) -> DataFrame:
    """key, x, count, below and n: of each value of x that a key has, how often, how many of the key's values are below it and
    how many there are.  Equal values are counted before they are dealt, so no value is hot; nulls are left out."""
    values = df.filter(F.col(x).isNotNull()).groupBy(key, x).agg(F.count("*").alias("count"))
    rows = dealt(values, key, x, blocks=blocks)
    inside = W.partitionBy("_block", key).orderBy(x).rowsBetween(W.unboundedPreceding, -1)
    of = rows.groupBy("_block", key).agg(F.sum("count").alias("_c"))
    earlier = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    of = of.select(F.col("_block").alias("_b"), F.col(key).alias("_k"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"), F.sum("_c").over(W.partitionBy(key)).alias("n"))
    own = rows.withColumn("_in", F.coalesce(F.sum("count").over(inside), F.lit(0)))
    return own.join(of, (F.col("_block") == F.col("_b")) & F.col(key).eqNullSafe(F.col("_k"))).select(key, x, "count", (F.col("_in") + F.col("_before")).alias("below"), "n")


def quantiles(df: DataFrame, x: str, places: dict[str, object], key: str = "symbol", blocks: int | None = None) -> DataFrame:
    """key, n and for each name the value at a place of the sorted values, from 0; a place is a column of n."""
    r = ranks(df, x, key, blocks)
    at = lambda c: F.max(F.when((F.col("below") <= c) & (c < F.col("below") + F.col("count")), F.col(x)))
    return r.groupBy(key).agg(F.max("n").alias("n"), *[at(c).alias(name) for name, c in places.items()])


def nearest(q: float):
    """The nearest rank."""
    return F.floor(q * (F.col("n") - 1) + 0.5)


def tail(df: DataFrame, x: str, q: float, key: str = "symbol", blocks: int | None = None) -> DataFrame:
    """key, n, var (the value of floor rank n q) and cvar (the mean of the values of lower ranks, or var where there are none)."""
    r = ranks(df, x, key, blocks)
    cut = F.floor(F.col("n") * q)
    under = F.greatest(F.least(cut - F.col("below"), F.col("count")), F.lit(0))
    var = F.max(F.when((F.col("below") <= cut) & (cut < F.col("below") + F.col("count")), F.col(x)))
    g = r.groupBy(key).agg(F.max("n").alias("n"), var.alias("var"), F.sum(F.col(x) * under).alias("_s"), F.sum(under).alias("_c"))
    return g.select(key, "n", "var", F.when(F.col("_c") > 0, F.col("_s") / F.col("_c")).otherwise(F.col("var")).alias("cvar"))
