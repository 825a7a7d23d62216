"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every five-word shingle is hashed once; the top bits of its hash choose one of ``BINS`` bins and the bin keeps its smallest
hash.  An empty bin takes the value of a bin drawn by a fixed sequence of probes until one with a value is met (optimal
densification).  A fingerprint stores ``BITS`` low-order bits of each bin; two unrelated bins agree in those with
probability 2**-BITS, which ``likeness`` corrects for.

Edge cases: null texts count as empty; a text of fewer than five words is one shingle; a text without words has the empty
fingerprint, alike (1.0) only to another empty one; equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, kernel

BINS, BITS, WORDS = 256, 8, 5


def _sketch(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A row of packed bins for each text, and whether the text has any word."""
    data, offs = kernel.buffers(texts)
    starts, ends, first = kernel.words(data, offs)
    h, doc = kernel.shingles(kernel.word_hashes(data, starts, ends), first, words)
    n = len(offs) - 1
    low = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    np.minimum.at(low, doc * BINS + (h >> shift).astype(np.int64), h)
    filled = np.zeros(n * BINS, bool)
    filled[doc * BINS + (h >> shift).astype(np.int64)] = True
    some = np.diff(first) > 0
    value = low.copy()
    todo = np.flatnonzero(~filled & np.repeat(some, BINS))
    probe = 0
    while len(todo):
        probe += 1
        draw = kernel.mix((todo % BINS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(probe))
        at = todo - todo % BINS + (draw % np.uint64(BINS)).astype(np.int64)
        hit = filled[at]
        value[todo[hit]] = low[at[hit]]
        todo = todo[~hit]
    return (kernel.mix(value) & np.uint64((1 << BITS) - 1)).astype(np.uint8).reshape(n, BINS), some


def sketches(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``_sketch`` over any number of texts, in pieces of bounded size."""
    piece = pa.RecordBatch.from_arrays([texts], ["text"])
    got = [_sketch(p.column(0), words) for p in kernel.slices(piece)]
    if not got:
        return np.empty((0, BINS), np.uint8), np.empty(0, bool)
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets, row by row, corrected for chance agreement of the stored bits."""
    chance = 2.0**-BITS
    est = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, est, (some_a == some_b).astype(float))


def _hex(rows: np.ndarray, some: np.ndarray) -> list[str]:
    """Packs BITS bits a bin; texts without words give the empty string."""
    return [r.tobytes().hex() if s else "" for r, s in zip(rows, some, strict=True)]


def fingerprint(df: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """df with a column ``fingerprint`` (hex) added; one Arrow pass, no shuffle.  A column of that name is replaced."""
    out = df.drop("fingerprint")
    schema = out.select("*", F.lit("").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, some = sketches(batch.column(text), words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_hex(rows, some), pa.string())], [*batch.schema.names, "fingerprint"])

    return out.mapInArrow(run, schema)


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """doc_id and text in descending doc_id (null ids last, equal ids by the hash of the text), dealt over ``blocks``
    ranges of about equal row counts.  Each range ends with a copy (``extra``) of the row that follows it, the last with
    the very first row, so that every row's successor is in its own partition."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    splits = ids.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 100 * blocks).alias("q")).first()["q"] if blocks > 1 else []
    splits = np.unique(np.array(splits or [], np.int64))
    last = len(splits)

    @F.pandas_udf("int")
    def block_of(s: pd.Series) -> pd.Series:
        known = s.notna().to_numpy()
        out = np.full(len(s), last, np.int32)
        out[known] = last - np.searchsorted(splits, s[known].to_numpy(np.int64), side="left")
        return pd.Series(out)

    heads = {r["block"]: r["head"] for r in ids.select("doc_id", block_of("doc_id").alias("block")).groupBy("block").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    #: The first id of each range goes once more to the end of the range before it.
    again = {heads[b]: order[i - 1] for i, b in enumerate(order)}
    spark_again = F.create_map(*[F.lit(x) for k, v in again.items() if k is not None for x in (k, v)]) if any(k is not None for k in again) else None
    if spark_again is None:
        more = F.lit(again.get(None))
    else:
        more = F.when(F.col("doc_id").isNull(), F.lit(again.get(None))).otherwise(spark_again[F.col("doc_id")])
    dealt = docs.select("doc_id", "text", F.explode(F.filter(F.array(F.struct(block_of("doc_id").alias("block"), F.lit(False).alias("extra")), F.struct(more.cast("int").alias("block"), F.lit(True).alias("extra"))), lambda x: x["block"].isNotNull())).alias("x"))
    dealt = dealt.select("doc_id", "text", "x.block", "x.extra")
    return dealt.repartitionById(last + 1, F.col("block")).sortWithinPartitions("block", "extra", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.RecordBatch | None = None
    for whole in batches:
        for batch in kernel.slices(whole, most=4 * kernel.SLICE_BYTES):
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            held = rows.slice(rows.num_rows - 1)
            if rows.num_rows > 1:
                yield _pairs(rows)


def _pairs(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Results for all rows but the last, each against the one after it; rows marked extra give none."""
    texts = rows.column("text").to_pylist()
    extra = rows.column("extra").to_pylist()
    block = rows.column("block").to_pylist()
    real = np.array([i for i in range(len(texts) - 1) if not extra[i]], np.int64)
    edited = []
    for i in real:
        assert block[i] == block[i + 1]
        n = len(texts[i]) // 3
        edited.append(texts[i][: len(texts[i]) - n] + texts[i + 1][:n])
    own, some = sketches(rows.column("text"))
    other, some_other = sketches(pa.array(edited, pa.string()))
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    a, s = own[real], some[real]
    return pa.RecordBatch.from_arrays(
        [
            rows.column("doc_id").take(pa.array(real)), pa.array([len(texts[i]) for i in real], pa.int64()), pa.array(sha, pa.string()),
            pa.array(_hex(a, s), pa.string()), pa.array(_hex(other, some_other), pa.string()),
            pa.array(likeness(a, s, other, some_other)), pa.array(likeness(a, s, own[real + 1], some[real + 1])),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def edit_report(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document in descending doc_id.

    Null ids come last; rows of equal id follow each other by the hash of their text; a single document is its own next.
    Text is shuffled once, into ranges of doc_id; a task holds a few texts at a time.
    """
    return in_blocks(docs, frames.parts(docs.sparkSession)).mapInArrow(_compare, SCHEMA)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(frames.table(spark, sf_dir, "documents"))
