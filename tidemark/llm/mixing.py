"""Mixing sources to target weights by weighted fair queueing.

A source's target is its share, by weight, of all words; a target stops at ``MOST_EPOCHS`` times its source's size and the
excess is shared again by weight until none is above.  Documents are shuffled by a hash of their id.  The virtual finish
time of a document's copy in epoch e is the source's words up to and with that copy, divided by the source's target; all
copies in order of finish time (then hash, id, size, epoch) are the mix, cut where its words reach the total budget.

Nothing is sorted in one task.  The words ahead of a document in its source are a sum over whole hash buckets plus a
window inside its own bucket, so a hot source is spread over as many tasks as it has buckets.  The cut is found from the
sums of finish-time buckets and an exact sort of the one bucket it falls in; afterwards each row decides for itself.

Edge cases: null text has size 0 and is never taken; null source is a source of its own, after all others; repeated rows
are separate documents; a null id is shuffled as the text ``null``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import frames

MOST_EPOCHS = 3
BUCKET_ROWS = 20_000


def targets(sized: DataFrame, weights: Column | None = None) -> DataFrame:
    """A row for each source: source, source_size, target.  weights: of the source's place (column ``place``, from 0)."""
    weights = F.col("place") % 3 + 1 if weights is None else weights
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    #: One row a source from here on, so that one task for the running sums is enough.
    s = s.withColumn("place", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1).withColumn("weight", weights.cast("double"))
    cap = F.col("source_size") * MOST_EPOCHS
    order = W.orderBy("ratio", "place")
    s = s.withColumn("ratio", cap / F.col("weight"))
    whole = W.partitionBy()
    ahead = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(whole), "all_weight": F.sum("weight").over(whole),
        "capped": F.coalesce(F.sum("source_size").over(ahead), F.lit(0)) * MOST_EPOCHS, "used": F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)),
    })
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("used")))
    s = s.withColumn("free", F.min(F.when(F.col("ratio") > F.col("level"), F.col("ratio"))).over(whole))
    s = s.withColumn("level", F.min(F.when(F.col("ratio") == F.col("free"), F.struct("place", "level"))).over(whole)["level"])
    target = F.when(F.col("ratio") < F.col("free"), cap.cast("double")).when(F.col("free").isNull(), cap.cast("double")).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def placed(sized: DataFrame, epochs_of: DataFrame, rows: int) -> DataFrame:
    """sized with source_size, target and ``upto``: the words of the source up to and with the row, in shuffled order."""
    digits = max(1, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)) + 1)
    named = sized.withColumns({"_source": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), "_bucket": F.substring("draw", 1, digits)})
    sums = named.groupBy("_source", "_bucket").agg(F.first("source").alias("source"), F.sum("size").alias("_in"))
    before = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    t = epochs_of.withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    sums = sums.join(t, "_source").select("_source", "_bucket", "_before", "source_size", "target")
    inside = W.partitionBy("_source", "_bucket").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    return named.join(sums, ["_source", "_bucket"]).withColumn("upto", F.col("_before") + F.sum("size").over(inside)).drop("_source", "_bucket", "_before")


def mix(docs: DataFrame, text: str = "text", weights: Column | None = None, seed: str = "mix") -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (the words of its copies in the mix)."""
    sized = frames.cut(docs.select(
        F.col("doc_id"), F.col("source"), frames.n_words(text).alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":" + seed)).cast("binary")).alias("draw"),
    ))
    rows = sized.count()
    at = frames.cut(placed(sized, targets(sized, weights), rows))
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    finish = lambda e: (F.col("source_size") * e + F.col("upto")) / F.col("target")
    steps = max(16, math.ceil(rows / BUCKET_ROWS) * 8)
    copies = at.filter("size > 0").select("draw", "doc_id", "size", F.explode(F.array(*[F.struct(finish(e).alias("finish"), F.lit(e).alias("epoch")) for e in range(MOST_EPOCHS)])).alias("x"))
    copies = copies.select("x.finish", "draw", "doc_id", "size", "x.epoch", F.least(F.floor(F.col("x.finish") * steps), F.lit(2 * steps)).alias("step"))
    #: One row a step: at most 2 * steps + 1.
    sums = copies.groupBy("step").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(W.orderBy("step")))
    cut = sums.filter(F.col("upto") > budget).orderBy("step").select("step", (F.col("upto") - F.col("n")).alias("before")).first()
    out = [F.col("doc_id"), F.col("source"), F.col("size"), F.col("source_size"), F.col("target")]
    if cut is None:
        return at.select(*out, (F.col("size") * MOST_EPOCHS).alias("taken"))
    order = ["finish", "draw", "doc_id", "size", "epoch"]
    edge = copies.filter(F.col("step") == cut["step"]).withColumn("upto", cut["before"] + F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    last = edge.filter(F.col("upto") <= budget).agg(F.max(F.struct(*order)).alias("x")).first()["x"]
    taken = F.lit(0).cast("long")
    for e in range(MOST_EPOCHS):
        inside = F.floor(finish(e) * steps) < cut["step"]
        if last is not None:
            row = F.struct(finish(e).alias("finish"), F.col("draw"), F.col("doc_id"), F.col("size"), F.lit(e).alias("epoch"))
            inside |= row <= F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["draw"]).alias("draw"), F.lit(last["doc_id"]).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(last["size"]).cast("long").alias("size"), F.lit(last["epoch"]).alias("epoch"))
        taken += F.when((F.col("size") > 0) & inside, F.col("size")).otherwise(0)
    return at.select(*out, taken.alias("taken"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(frames.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL6 = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR || ':mix') AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
p AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS place FROM s),
w AS (SELECT *, (place % 3 + 1)::DOUBLE AS weight, (source_size * 3) / (place % 3 + 1)::DOUBLE AS ratio FROM p),
c AS (SELECT *, coalesce(sum(source_size * 3) OVER f, 0)::BIGINT AS capped, coalesce(sum(weight) OVER f, 0) AS used, (sum(source_size) OVER ())::BIGINT AS total, sum(weight) OVER () AS all_weight
  FROM w WINDOW f AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - capped)::DOUBLE / (all_weight - used) AS level FROM c),
pick AS (SELECT ratio AS free, level FROM l WHERE ratio > level ORDER BY ratio, place LIMIT 1),
t AS (SELECT source, source_size, total, CASE WHEN pick.free IS NULL OR ratio < pick.free THEN (source_size * 3)::DOUBLE ELSE pick.level * weight END AS target FROM l LEFT JOIN pick ON true),
d AS (SELECT doc_id, size, draw, source_size, target, total, (sum(size) OVER (PARTITION BY sized.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, (e * source_size + upto)::DOUBLE / target AS finish FROM d, (VALUES (0), (1), (2)) v(e) WHERE size > 0),
y AS (SELECT doc_id, draw, size, total, (sum(size) OVER (ORDER BY finish, draw, doc_id, size, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS n FROM x),
z AS (SELECT doc_id, draw, sum(size)::BIGINT AS taken FROM y WHERE n <= total GROUP BY doc_id, draw)
SELECT d.doc_id, d.size, d.source_size, d.target, coalesce(z.taken, 0)::BIGINT AS taken FROM d LEFT JOIN z ON d.doc_id = z.doc_id AND d.draw = z.draw
"""
