"""Correlations of very many symbols, and pools chosen by them, without a matrix in one place.

``correlated`` multiplies tiles: symbols are dealt into tiles of ``TILE``, dates into blocks of ``DATES``; a tile's values on a
block of dates are one packed row.  Every two tiles meet in a task of their own, which adds up their products block by block and
gives only the pairs that are asked for: those of at least a correlation, or each symbol's ``top`` ones.  ``greedy`` chooses a pool
by one pass over the returns a pick, with running sums a symbol.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

TILE, DATES, YEAR = 256, 512, 252
FLAT = 1e-12


def _packed(x: DataFrame, value: str, tile: int) -> DataFrame:
    """tile, block, names and the values of a tile's symbols on a block of dates, names x dates, NaN where there is none.  Values
    are counted from the symbol's mean, so that sums of squares keep their digits."""
    rows = x.filter(F.col(value).isNotNull() & F.col("symbol").isNotNull()).select("symbol", "trade_date", F.col(value).cast("double").alias("v"))
    means = rows.groupBy("symbol").agg(F.avg("v").alias("_m"))
    ordered = checkpointed(means.repartitionByRange("symbol").withColumn("_p", F.spark_partition_id()))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_c"))
    sizes = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.row_number().over(W.partitionBy("_p").orderBy("symbol")) - 1
    tiles = ordered.withColumn("_i", number).join(F.broadcast(sizes), F.col("_p") == F.col("_q")).select("symbol", "_m", F.floor((F.col("_i") + F.col("_before")) / tile).cast("int").alias("tile"))
    #: One row a date.
    days = rows.select("trade_date").distinct().select("trade_date", (F.row_number().over(W.orderBy("trade_date")) - 1).alias("day"))
    placed = rows.join(tiles, "symbol").join(days, "trade_date").select("tile", F.floor(F.col("day") / DATES).cast("int").alias("block"), "symbol", (F.col("day") % DATES).cast("int").alias("at"), (F.col("v") - F.col("_m")).alias("v"))

    def pack(t: pa.Table) -> pa.Table:
        names, code = np.unique(np.array(t.column("symbol").to_pylist(), object), return_inverse=True)
        m = np.full((len(names), DATES), np.nan)
        m[code, t.column("at").to_numpy()] = t.column("v").to_numpy()
        return pa.table({"tile": t.column("tile").slice(0, 1), "block": t.column("block").slice(0, 1), "names": pa.array([list(names)], pa.list_(pa.string())), "m": pa.array([m.tobytes()], pa.binary())})

    return placed.groupBy("tile", "block").applyInArrow(pack, "tile int, block int, names array<string>, m binary")


def correlated(x: DataFrame, value: str = "r", least: float | None = None, top: int | None = None, days: int = 2, tile: int = TILE) -> DataFrame:
    """a, b (a before b), corr, cov and n of the pairs of different symbols with at least ``days`` common dates: all, or those
    of an absolute correlation of ``least`` or more, and of these, with ``top``, the pairs among the ``top`` strongest of one of
    the two.  A side without spread has correlation 0.  Ties go by name.  A symbol's values on a date are one."""
    packed = checkpointed(_packed(x, value, tile))
    last = packed.agg(F.max("tile")).first()[0]
    if last is None:
        return x.sparkSession.createDataFrame([], "a string, b string, corr double, cov double, n long")
    t = F.col("tile")
    #: Every tile goes to the pairs (i, j), i <= j, that it is in.
    sides = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda o: F.struct(F.least(t, o).alias("i"), F.greatest(t, o).alias("j")))
    met = packed.select("tile", "block", "names", "m", F.explode(sides).alias("p")).select("p.i", "p.j", "tile", "block", "names", "m")

    def strongest(size: np.ndarray, k: int) -> np.ndarray:
        """Marks each row's k largest, and all equal to the last of them."""
        if size.shape[1] <= k:
            return np.ones(size.shape, bool)
        return size >= np.partition(size, size.shape[1] - k, axis=1)[:, -k][:, None]

    def multiply(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        tiles = t.column("tile").to_pylist()
        names = {k: sorted({n for r, own in zip(tiles, t.column("names").to_pylist(), strict=True) if r == k for n in own}) for k in {i, j}}
        place = {k: {n: at for at, n in enumerate(v)} for k, v in names.items()}
        blocks: dict[tuple[int, int], np.ndarray] = {}
        for row, (r, block) in enumerate(zip(tiles, t.column("block").to_pylist(), strict=True)):
            own = t.column("names")[row].as_py()
            whole = np.full((len(names[r]), DATES), np.nan)
            whole[[place[r][n] for n in own]] = np.frombuffer(t.column("m")[row].as_py(), float).reshape(len(own), DATES)
            blocks[r, block] = whole
        sums = None
        for block in {b for _, b in blocks}:
            if (i, block) not in blocks or (j, block) not in blocks:
                continue
            a, b = blocks[i, block], blocks[j, block]
            ha, hb = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
            a, b = np.nan_to_num(a), np.nan_to_num(b)
            now = [ha @ hb.T, a @ hb.T, ha @ b.T, (a * a) @ hb.T, ha @ (b * b).T, a @ b.T]
            sums = now if sums is None else [p + q for p, q in zip(sums, now, strict=True)]
        if sums is None:
            sums = [np.zeros((len(names[i]), len(names[j])))] * 6
        n, sa, sb, saa, sbb, sab = sums
        with np.errstate(divide="ignore", invalid="ignore"):
            va, vb, c = saa - sa * sa / n, sbb - sb * sb / n, sab - sa * sb / n
            flat = (np.sqrt(np.maximum(va, 0) / n) < FLAT) | (np.sqrt(np.maximum(vb, 0) / n) < FLAT)
            corr, cov = np.where(flat, 0.0, c / np.sqrt(np.where(flat, 1.0, va * vb))), c / (n - 1)
        keep = (n >= max(days, 2)) & ~np.isnan(corr)
        if i == j:
            keep &= np.triu(np.ones(keep.shape, bool), 1)
        if least is not None:
            keep &= np.abs(corr) >= least
        if top is not None:
            size = np.where(keep | (keep.T if i == j else False), np.abs(np.where(np.isnan(corr), 0, corr)), -1.0)
            near = strongest(size, top) | strongest(size.T, top).T
            keep &= near
        p, q = np.nonzero(keep)
        left, right = np.array(names[i], object)[p], np.array(names[j], object)[q]
        return pa.table({"a": pa.array(left, pa.string()), "b": pa.array(right, pa.string()), "corr": corr[p, q], "cov": cov[p, q], "n": n[p, q].astype(np.int64)})

    found = met.groupBy("i", "j").applyInArrow(multiply, "a string, b string, corr double, cov double, n long")
    if top is None:
        return found
    both = found.select("*", F.explode(F.array("a", "b")).alias("_of"))
    rank = F.row_number().over(W.partitionBy("_of").orderBy(F.desc(F.abs("corr")), "a", "b"))
    return both.withColumn("_k", rank).filter(F.col("_k") <= top).select("a", "b", "corr", "cov", "n").distinct()


# --- pools

def quality(returns: DataFrame) -> DataFrame:
    """symbol and its annual Sharpe ratio, with the population's deviation; 0 for fewer than five days or no spread."""
    sd = F.col("sd") * YEAR**0.5
    g = returns.groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"))
    return g.select("symbol", F.when((sd > 1e-10) & (F.col("n") >= 5), F.col("mean") * YEAR / sd).otherwise(0.0).alias("quality"))


def greedy(returns: DataFrame, size: int, alpha: float = 2.0, least: float = -1.0, most: float = 0.95, among: DataFrame | None = None) -> list[tuple[str, float, float]]:
    """(symbol, quality, sum of absolute correlations with those before it) of a pool, in the order of choice.

    Of the symbols above the least quality the best comes first, then the best of quality less alpha times the mean absolute
    correlation with those chosen, leaving out what is correlated more than ``most`` with one of them; all if they are no more
    than ``size``.  A pick is one pass: the chosen symbol's returns, a row a date, are broadcast and every other symbol's
    correlation with it, on common dates, is added to its sums.  What comes to the driver is one row a pick (all of them where
    they are no more than ``size``).  Ties go by name.
    """
    q = quality(returns).filter(F.col("quality") > least)
    if among is not None:
        q = q.join(among.select("symbol"), "symbol", "left_semi")
    state = checkpointed(q.withColumns({"s": F.lit(0.0), "m": F.lit(0.0)}))
    if size == 0 or state.count() <= size:
        chosen = [(r["symbol"], r["quality"]) for r in state.orderBy("symbol").collect()] if size else []
        return [(s, v, float("nan")) for s, v in chosen]
    rows, out = returns.join(state.select("symbol"), "symbol", "left_semi"), []
    while len(out) < size:
        score = F.col("quality") - (alpha * F.col("s") / len(out) if out else F.lit(0.0))
        best = state.filter(F.col("m") <= most).orderBy(F.desc(score), "symbol").first()
        if best is None:
            break
        out.append((best["symbol"], best["quality"], best["s"]))
        own = F.broadcast(returns.filter(F.col("symbol") == best["symbol"]).select("trade_date", F.col("r").alias("_o")))
        n = F.count("*").cast("double")
        c, v, w = F.covar_pop("r", "_o") * n, F.var_pop("r") * n, F.var_pop("_o") * n
        corr = F.abs(F.coalesce(F.when(F.sqrt(v * w) > 1e-10, c / F.nullif(F.sqrt(v * w), F.lit(0.0))), F.lit(0.0)))
        each = rows.join(own, "trade_date").groupBy("symbol").agg(corr.alias("_c"))
        state = state.filter(F.col("symbol") != best["symbol"]).join(each, "symbol", "left").select("symbol", "quality", (F.col("s") + F.coalesce("_c", F.lit(0.0))).alias("s"), F.greatest("m", F.coalesce("_c", F.lit(0.0))).alias("m"))
        state = checkpointed(state)
    return out


def diverse_pools(returns: DataFrame, pools: int, size: int, least: float = -0.5) -> DataFrame:
    """pool, symbols, quality (mean) and correlation (mean absolute, of the pairs) of pools that share no symbol, of symbols
    above a quality; as many as asked for and can be filled."""
    spark, rows = returns.sparkSession, []
    left = checkpointed(quality(returns).filter(F.col("quality") > least).select("symbol"))
    while len(rows) < pools and left.count() >= max(size, 1):
        pool = greedy(returns, size, least=-1.0, among=left)
        if not pool:
            break
        names = [s for s, _, _ in pool]
        pairs = len(names) * (len(names) - 1) / 2
        inside = sum(x for _, _, x in pool)
        if inside != inside:  # all that were left: their pairs were not gone through
            got = correlated(returns.filter(F.col("symbol").isin(names))).agg(F.sum(F.abs("corr"))).first()[0]
            inside = got or 0.0
        rows.append((len(rows) + 1, names, float(np.mean([v for _, v, _ in pool])), inside / pairs if pairs else 0.0))
        left = checkpointed(left.filter(~F.col("symbol").isin(names)))
    return spark.createDataFrame(rows, "pool int, symbols array<string>, quality double, correlation double")
