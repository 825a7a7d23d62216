"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with a temperature.

A word's vector has three parts: a context vector (the sum of the sparse random index vectors of its neighbours in the
sampled texts, plus its own index vector; hashed to ``VOCABULARY`` rows), the index vector of its ending, and the index
vector of its form (letter case, digits, symbols, length, and whether it repeats one of the two words before it).  A
document's features are the means over all its words, and the logarithm of their number.  The network (one hidden layer)
is trained with numpy on the driver, on the features of at most ``MOST_LABELLED`` labelled documents of each class, whole
texts of any length, taken in the order of a hash of their id; a fifth of them is kept for fitting the temperature.  Context
vectors and features of the sample are made in tasks; the driver gets a table of fixed size and a row of features a document,
never a text.  Scores are corrected from the balanced sample to the labels' own proportion.

Labels are read only for rows whose crc32(doc_id) mod 3 is not 1.  Edge cases: null text counts as empty and an empty text
gets a score too (features zero); a null doc_id is never held out and has no label; with labels of one class only, or
none, every score is the smoothed share of that class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, kernel

VOCABULARY, WORD_DIM = 1 << 15, 32
ENDINGS, ENDING_DIM = 1 << 12, 16
FORMS, FORM_DIM = 1 << 12, 32
WINDOW, NONZERO = 2, 4
MOST_LABELLED = 2500
HIDDEN, EPOCHS = 32, 300
WIDTH = WORD_DIM + ENDING_DIM + FORM_DIM + 1

#: Bits of a byte's kind: lower, upper, digit, end of sentence or clause, other ASCII, beyond ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 32
for _c in range(33, 127):
    if not _KIND[_c]:
        _KIND[_c] = 8 if chr(_c) in ".,;:!?" else 16


def index_vectors(rows: int, dim: int, seed: int) -> np.ndarray:
    """Sparse ternary random vectors."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, dim), np.float32)
    for _ in range(NONZERO):
        out[np.arange(rows), rng.integers(0, dim, rows)] += rng.choice(np.array([-1, 1], np.float32), rows)
    return out


def units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of each word's context vector, ending and form."""
    h = kernel.word_hashes(data, starts, ends)
    n = len(h)
    size = ends - starts
    tail = np.zeros(n, np.uint64)
    for k in (1, 2, 3):
        tail = tail * np.uint64(257) + np.where(size >= k, data[np.maximum(ends - k, starts)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    kind = np.bitwise_or.reduceat(_KIND[data], starts).astype(np.int64) if n else np.empty(0, np.int64)
    same = np.zeros(n, np.int64)
    at = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    same[1:] |= (h[1:] == h[:-1]) & (at[1:] >= 1)
    same[2:] |= 2 * ((h[2:] == h[:-2]) & (at[2:] >= 2))
    last = _KIND[data[ends - 1]] if n else np.empty(0, np.uint8)
    form = kind | (same << 6) | (np.minimum(np.log2(size), 3).astype(np.int64) << 8) | ((last >= 16).astype(np.int64) << 10)
    return (h % np.uint64(VOCABULARY)).astype(np.int64), (kernel.mix(tail) % np.uint64(ENDINGS)).astype(np.int64), form % FORMS


def means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    count = np.diff(first)
    out = np.zeros((len(count), values.shape[1]), np.float32)
    some = count > 0
    if some.any():
        out[some] = np.add.reduceat(values, first[:-1][some], axis=0) / count[some][:, None]
    return out


@dataclass
class Tables:
    words: np.ndarray
    endings: np.ndarray
    forms: np.ndarray

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """A row of features for each text."""
        out = []
        for piece in kernel.slices(pa.RecordBatch.from_arrays([texts], ["text"])):
            data, offs = kernel.buffers(piece.column(0))
            starts, ends, first = kernel.words(data, offs)
            w, e, f = units(data, starts, ends, first)
            parts = [means(t[i], first) for t, i in ((self.words, w), (self.endings, e), (self.forms, f))]
            out.append(np.hstack([*parts, np.log1p(np.diff(first))[:, None].astype(np.float32) / 8]))
        return np.concatenate(out) if out else np.empty((0, WIDTH), np.float32)


def contexts(texts: pa.Array, own: np.ndarray) -> np.ndarray:
    """For each row of the table, the sum of its words' neighbours' index vectors; whole numbers, so that sums agree however
    the texts are dealt."""
    out = np.zeros(own.shape)
    for piece in kernel.slices(pa.RecordBatch.from_arrays([texts], ["text"])):
        data, offs = kernel.buffers(piece.column(0))
        starts, ends, first = kernel.words(data, offs)
        w, _, _ = units(data, starts, ends, first)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        near = np.zeros((len(w), WORD_DIM), np.float32)
        for k in range(1, WINDOW + 1):
            ok = (doc[k:] == doc[:-k])[:, None]
            near[k:] += own[w[:-k]] * ok
            near[:-k] += own[w[k:]] * ok
        np.add.at(out, w, near)
    return out


def tables(context: np.ndarray, seed: int = 11) -> Tables:
    """Random indexing: directions of the contexts, and half of a word's own index vector."""
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return Tables((context / np.maximum(norm, 1) + index_vectors(VOCABULARY, WORD_DIM, seed) / 2).astype(np.float32), index_vectors(ENDINGS, ENDING_DIM, seed + 1), index_vectors(FORMS, FORM_DIM, seed + 2))


@dataclass
class Model:
    tables: Tables | None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.center) / self.scale @ a + b) @ c + d

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.tables is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.shift)))
        z = self.logits(self.tables.pooled(texts).astype(np.float64))[:, 0] / self.temperature + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _fit_layers(x: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """Full-batch Adam on the mean log-loss with weight decay."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for t in range(1, EPOCHS + 1):
        a, b, c, d = layers
        hidden = np.tanh(x @ a + b)
        miss = (1 / (1 + np.exp(-(hidden @ c + d))) - y[:, None]) / len(y)
        back = miss @ c.T * (1 - hidden**2)
        for i, g in enumerate((x.T @ back + 1e-4 * a, back.sum(0), hidden.T @ miss + 1e-4 * c, miss.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            layers[i] = layers[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(layers)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def learn(made: Tables, x: np.ndarray, y: np.ndarray, share: float, seed: int = 5) -> Model:
    """A model from the features and labels of documents in a random order; share: of label 1 among all labels that may be
    learned from."""
    shift = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return Model(None, shift=shift)
    kept = np.arange(len(y)) % 5 == 4
    if len(set(y[~kept].tolist())) < 2 or len(set(y[kept].tolist())) < 2:
        kept[:] = False
    center, scale = x[~kept].mean(0), x[~kept].std(0) + 1e-3
    model = Model(made, center, scale, _fit_layers((x[~kept] - center) / scale, y[~kept], seed))
    if kept.any():
        z = model.logits(x[kept])[:, 0]
        model.temperature = min(np.geomspace(0.25, 8, 41), key=lambda t: _loss(z / t, y[kept]))
    in_sample = y.mean()
    model.shift = shift - float(np.log(in_sample / (1 - in_sample)))
    return model


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """Learns from the labelled rows that are not held out."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    share = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    #: At most MOST_LABELLED ids of each class, so that they may be broadcast.
    picked = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("_key"), "_key").limit(MOST_LABELLED) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(ids, "_key").withColumn("_h", F.xxhash64("_key", F.lit(1), "_text"))
    #: Ids that stand for several rows may not exceed the bound either.
    picked = rows.select("_h", "_key").orderBy("_h", "_key").limit(2 * MOST_LABELLED).agg(F.max("_h")).first()[0]
    sample = frames.cut(rows.filter(F.col("_h") <= (picked if picked is not None else 0)).select("_h", "_y", "_text"))
    own = index_vectors(VOCABULARY, WORD_DIM, 11)
    names = [f"v{i}" for i in range(WORD_DIM)]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(own.shape)
        for batch in batches:
            total += contexts(batch.column(0), own)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *[pa.array(total[some, i]) for i in range(WORD_DIM)]], names=["row", *names])

    found = sample.select("_text").mapInArrow(neighbours, ", ".join(["row long", *[f"{n} double" for n in names]])).groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    context = np.zeros(own.shape)
    context[found["row"].to_numpy(np.int64)] = found[names].to_numpy(float)
    made = tables(context)
    sent = docs.sparkSession.sparkContext.broadcast(made)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = sent.value.pooled(batch.column(2)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["h", "y", "x"])

    #: Equal texts of equal ids are alike in all that is used, so their order does not matter.
    got = sample.mapInArrow(features, "h long, y int, x array<double>").toPandas().sort_values(["h", "y"], kind="stable")
    return learn(made, np.array(got["x"].to_list()).reshape(len(got), WIDTH), got["y"].to_numpy(float), share)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column ``out`` added (replaced if there); one Arrow pass, no shuffle.  The model's size is fixed."""
    base = docs.drop(out)
    schema = base.select("*", F.lit(0.0).alias(out)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(batch.column(text)), pa.float64())], names=schema.names)

    return base.mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, frames.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
