"""Keyed tables on a shared file system: insert-or-ignore and upsert that write, with counts, idempotent by batch.

A table is Parquet below ``path/data``, partitioned by an expression of its key columns (``p``), so that a row of a key never
changes its partition.  A write reads and rewrites only the partitions that its rows fall into; the others keep their files.
What a batch did is noted below ``path/log`` once its rows are there, so a batch that is repeated, after a restart of a stream
or a lost driver, does nothing and returns the counts of the first time; one that was cut off before its note finds its rows,
or replaces them by themselves.  One writer at a time.

Edge cases: of rows of one key in a batch the first by ``order`` counts (by their values without one), the others are skipped;
a null in a key equals another null; an empty batch writes nothing; columns that the table does not have are refused.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import exists

MONTH = "date_format(trade_date, 'yyyy-MM')"


@dataclass(frozen=True)
class Counts:
    """skipped: rows of a known key, or further ones of a new key (for an upsert only the latter)."""

    inserted: int
    updated: int
    skipped: int
    partitions: int


@dataclass
class KeyedTable:
    spark: SparkSession
    path: str
    schema: str
    key: tuple[str, ...]
    part: str = MONTH
    _type: T.StructType = field(init=False, repr=False)

    def __post_init__(self):
        self._type = T.StructType.fromDDL(self.schema)
        if "p" in self._type.names:
            raise ValueError("p is the partition's column")
        self._data, self._log = f"{self.path}/data", f"{self.path}/log"

    def read(self, parts: list[str] | None = None, since: str | None = None) -> DataFrame:
        """The rows, with their partition p; of the listed partitions, or those from one on, which are the only ones looked at."""
        whole = T.StructType([*self._type, T.StructField("p", T.StringType())])
        found = self.spark.read.schema(whole).parquet(self._data) if exists(self.spark, self._data) else self.spark.createDataFrame([], whole)
        found = found if parts is None else found.filter(F.col("p").isin(parts))
        return found if since is None else found.filter(F.col("p") >= since)

    def done(self, batch: int | str) -> Counts | None:
        if not exists(self.spark, f"{self._log}/batch={batch}"):
            return None
        row = self.spark.read.schema("inserted long, updated long, skipped long, partitions long").json(f"{self._log}/batch={batch}").first()
        return Counts(**row.asDict()) if row else None

    def _note(self, batch: int | str | None, counts: Counts) -> Counts:
        if batch is not None:
            row = self.spark.createDataFrame([(counts.inserted, counts.updated, counts.skipped, counts.partitions)], "inserted long, updated long, skipped long, partitions long")
            row.coalesce(1).write.mode("overwrite").json(f"{self._log}/batch={batch}")
        return counts

    def _ranked(self, new: DataFrame, order: list[str] | None) -> tuple[DataFrame, list[str], int]:
        """new with p and ``_at``, a row's place within its key; the partitions that it touches, and its number of rows."""
        if set(new.columns) != set(self._type.names):
            raise ValueError(f"columns {sorted(set(new.columns) ^ set(self._type.names))}")
        typed = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._type]).withColumn("p", F.expr(self.part))
        by = order or [c for c in self._type.names if c not in self.key]
        at = F.row_number().over(W.partitionBy(*self.key).orderBy(*(by or self.key)))
        parts = {r["p"]: r["count"] for r in typed.groupBy("p").count().collect()}
        return typed.withColumn("_at", at), list(parts), sum(parts.values())

    def insert_or_ignore(self, new: DataFrame, batch: int | str | None = None, order: list[str] | None = None) -> Counts:
        """Appends the rows whose key is not there; existing files stay as they are."""
        if batch is not None and (before := self.done(batch)):
            return before
        ranked, parts, rows = self._ranked(new, order)
        if not parts:
            return self._note(batch, Counts(0, 0, 0, 0))
        have = self.read(parts).select(*[F.col(k).alias(f"_{k}") for k in self.key], F.lit(True).alias("_had"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key]
        fresh = F.col("_had").isNull() & (F.col("_at") == 1)
        seen = Observation()
        flagged = ranked.join(have, same, "left").withColumn("_fresh", fresh).observe(seen, F.count_if("_fresh").alias("inserted"))
        #: A row's partition is decided before, so the files are as many as the tasks that write to it.
        flagged.filter("_fresh").select(*self._type.names, "p").repartition("p").write.mode("append").partitionBy("p").parquet(self._data)
        try:
            inserted = seen.get["inserted"]
        except Py4JJavaError:  # adaptive execution leaves out what it found empty, the observation with it: no row was new
            inserted = 0
        return self._note(batch, Counts(inserted, 0, rows - inserted, len(parts)))

    def upsert(self, new: DataFrame, batch: int | str | None = None, order: list[str] | None = None, keep: tuple[str, ...] = ()) -> Counts:
        """Rows replace those of their key; columns in ``keep`` keep the old value where the new one is null.  Partitions that
        rows fall into are rewritten, whole, in one step at the end."""
        if batch is not None and (before := self.done(batch)):
            return before
        ranked, parts, rows = self._ranked(new, order)
        if not parts:
            return self._note(batch, Counts(0, 0, 0, 0))
        values = [c for c in self._type.names if c not in self.key]
        old = self.read(parts).select(*[F.col(k).alias(f"_k_{k}") for k in self.key], *[F.col(c).alias(f"_o_{c}") for c in values], F.col("p").alias("_p"), F.lit(True).alias("_had"))
        seen = Observation()
        fresh = ranked.filter("_at = 1").withColumn("_new", F.lit(True))
        df = fresh.join(old, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.key], "full_outer")
        value = lambda c: F.when(F.col("_new"), F.coalesce(c, f"_o_{c}") if c in keep else F.col(c)).otherwise(F.col(f"_o_{c}"))
        df = df.observe(seen, F.count_if(F.col("_new") & F.col("_had").isNull()).alias("inserted"), F.count_if(F.col("_new") & F.col("_had")).alias("updated"))
        out = df.select(*[F.when(F.col("_new"), F.col(k)).otherwise(F.col(f"_k_{k}")).alias(k) for k in self.key], *[value(c).alias(c) for c in values], F.coalesce("p", "_p").alias("p"))
        out.select(*self._type.names, "p").repartition("p").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("p").parquet(self._data)
        got = seen.get
        return self._note(batch, Counts(got["inserted"], got["updated"], rows - got["inserted"] - got["updated"], len(parts)))

    def sink(self, how: str = "insert_or_ignore", **options):
        """For ``foreachBatch``: each micro-batch is a batch of its number."""
        write = {"insert_or_ignore": self.insert_or_ignore, "upsert": self.upsert}[how]
        return lambda df, number: write(df, batch=number, **options) and None
