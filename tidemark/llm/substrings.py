"""Substring dedup: words inside a run of ``WINDOW`` words that occurs more than once are removed.

Two operators share the decision which spans go.

``against`` takes a stated reference set and is the suffix-automaton method: the reference is dealt into shards of about
``SHARD_WORDS`` words, each shard's suffix automaton is built in a task, and documents are streamed through the automata for
matching statistics, ``PASS`` broadcast automata at a time; maximal spans at or above the threshold are removed.  What is
broadcast is bounded by SHARD_WORDS and PASS; the number of passes grows with the reference, not with the documents.

``within`` removes what repeats anywhere in the corpus itself.  There the reference is the corpus: automata of all its
shards, streamed past all documents, cost documents x shards, which the README reports with figures, so the repeated runs
are found by a packed exchange of window hashes instead.  Documents are dealt into chunks; a chunk sends each hash bucket
one row, the sorted distinct hashes of its windows; a bucket returns to each of its chunks one bit per hash, whether
any other window has it.  A hash has at most one entry a chunk however hot it is, so no key can make a task large.  Two such
exchanges follow each other: the first of 40 bits beside the bucket's own, of all windows, finds what may repeat; the second,
of 64 bits of an independent hash, of these alone, decides.  A window that occurs once is removed only if another shares
both: in a corpus of n windows that is expected n * 1e-6 * 1e-13 times, whatever its size.  Hashes are not linear in the
words or bytes (see ``kernel``), so no two texts collide by their structure.

Edge cases: null texts have no words; texts shorter than the window lose nothing; repeated rows are copies of each other,
so each loses all windows; overlapping repeats inside one document count as starting elsewhere.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, kernel

WINDOW = 35
CHUNK_BYTES = 8 << 20
BUCKET_HASHES = 1_500_000
SHARD_WORDS, PASS = 100_000, 8
#: Bytes of a hash in the first and the second exchange.
FIRST, SECOND = 5, 8


# --- suffix automata of a stated reference

class SuffixAutomaton:
    """Of several word sequences; a sequence cannot match across its end."""

    def __init__(self, sequences: list[list]):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        for words in sequences:
            last = 0
            for w in words:
                last = self._add(last, w)

    def _add(self, last: int, w) -> int:
        nxt, link, size = self.next, self.link, self.size
        if w in nxt[last]:
            q = nxt[last][w]
            if size[q] == size[last] + 1:
                return q
            return self._split(last, q, w)
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._split(p, q, w)
        return cur

    def _split(self, p: int, q: int, w) -> int:
        nxt, link, size = self.next, self.link, self.size
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def statistics(self, words: list) -> list[int]:
        """For each place, the length of the longest run ending there that occurs in the reference."""
        nxt, link, size = self.next, self.link, self.size
        state = length = 0
        out = []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                length = size[state]
            if w in nxt[state]:
                state = nxt[state][w]
                length += 1
            out.append(length)
        return out


def covered(lengths: list[int], least: int) -> np.ndarray:
    """Which words lie in a span of at least ``least`` words that ends at some place with such a statistic."""
    n = len(lengths)
    edge = np.zeros(n + 1, np.int64)
    for i, m in enumerate(lengths):
        if m >= least:
            edge[i - m + 1] += 1
            edge[i + 1] -= 1
    return np.cumsum(edge)[:n] > 0


def _cut(window: int):
    """Texts as pieces of at most SHARD_WORDS words, which overlap so that no run of the window's length is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                words = (t.as_py() or b"").split()
                starts = range(0, max(1, len(words) - window + 1), max(1, SHARD_WORDS - window + 1)) if words else ()
                found = [words[a : a + SHARD_WORDS] for a in starts]
                yield pa.RecordBatch.from_arrays([pa.array([b" ".join(w) for w in found], pa.binary()), pa.array([len(w) for w in found], pa.int64())], names=["piece", "n"])

    return run


def _build(rows: pa.Table) -> pa.Table:
    automaton = SuffixAutomaton([p.split() for p in sorted(rows.column("piece").to_pylist())])
    return pa.table({"shard": rows.column("shard").slice(0, 1), "automaton": pa.array([pickle.dumps(automaton)], pa.large_binary()).cast(pa.binary())})


def against(docs: DataFrame, reference: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed and kept text of each row of docs, without the runs of at least ``window`` words that occur in
    a text of ``reference``.  Every automaton marks words on the whole document; marks of all are united, and every pass is
    written to the checkpoint folder, so that the next one starts from there."""
    spark = docs.sparkSession
    pieces = frames.cut(reference.select(F.col(text).cast("binary")).mapInArrow(_cut(window), "piece binary, n long"))
    shards = max(1, -(-(pieces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]) // SHARD_WORDS))
    dealt = pieces.select("piece", F.pmod(F.xxhash64("piece"), F.lit(shards)).cast("int").alias("shard"))
    built = frames.cut(dealt.groupBy("shard").applyInArrow(_build, "shard int, automaton binary"))
    marked = docs.select(F.col(key), F.col(text).cast("binary").alias("_text"), F.lit(b"").alias("_marks"))
    for first in range(0, shards, PASS):
        own = [r["automaton"] for r in built.filter(F.col("shard").between(first, first + PASS - 1)).orderBy("shard").collect()]
        if not own:
            continue
        sent = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automata = [pickle.loads(a) for a in sent.value]
            for b in batches:
                marks = []
                for t, m in zip(b.column(1), b.column(2), strict=True):
                    words = (t.as_py() or b"").split()
                    gone = np.unpackbits(np.frombuffer(m.as_py(), np.uint8))[: len(words)] > 0 if m.as_py() else np.zeros(len(words), bool)
                    for a in automata:
                        gone |= covered(a.statistics(words), window)
                    marks.append(np.packbits(gone).tobytes())
                yield b.set_column(2, "_marks", pa.array(marks, pa.binary()))

        marked = frames.cut(marked.mapInArrow(run, marked.schema))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, m in zip(b.column(1), b.column(2), strict=True):
                words = (t.as_py() or b"").split()
                gone = np.unpackbits(np.frombuffer(m.as_py(), np.uint8))[: len(words)] > 0 if m.as_py() else np.zeros(len(words), bool)
                rows.append((len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
            n, r, kept = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(kept, pa.string())], names=[key, "n_words", "n_removed", "kept"])

    schema = marked.select(F.col(key), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept")).schema
    return marked.mapInArrow(finish, schema)


# --- repeats within the corpus

def _windows(texts: pa.Array, window: int, seeds: tuple[int, ...] = (0,)) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For pieces of the texts: number of the first text, first word of each text, first word of each window, and the windows'
    hashes by each seed."""
    at = 0
    for piece in kernel.slices(pa.RecordBatch.from_arrays([texts], ["text"])):
        data, offs = kernel.buffers(piece.column(0))
        starts, ends, first = kernel.words(data, offs)
        n = np.maximum(np.diff(first) - window + 1, 0)
        begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
        yield at, first, begin, [kernel.rolling(kernel.word_hashes(data, starts, ends, s), window)[begin] if len(begin) else np.empty(0, np.uint64) for s in seeds]
        at += piece.num_rows


class Exchange:
    """Hashes of ``width`` bytes beside the bucket, which comes from the upper 24 bits."""

    def __init__(self, width: int, buckets: int):
        self.width, self.buckets = width, np.uint64(buckets)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(40)) * self.buckets >> np.uint64(24)

    def placed(self, h: np.ndarray) -> np.ndarray:
        """Sorts by bucket, and holds what is sent in its low bytes."""
        return h if self.width == 8 else self.bucket(h) << np.uint64(40) | h & np.uint64((1 << 40) - 1)

    def parts(self, placed: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to) of sorted ones; only buckets that have any."""
        b = self.bucket(placed) if self.width == 8 else placed >> np.uint64(40)
        cuts = np.flatnonzero(np.diff(b)) + 1
        for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
            if e > a:
                yield int(b[a]), a, e

    def rows(self, chunk: int, hashes: list[np.ndarray]) -> pa.RecordBatch:
        """The sorted distinct hashes of a chunk, by bucket, then one bit each, whether the chunk itself has it twice."""
        h, n = np.unique(self.placed(np.concatenate(hashes)), return_counts=True)
        raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width]
        found = [(b, raw[a:e].tobytes() + np.packbits(n[a:e] > 1).tobytes()) for b, a, e in self.parts(h)]
        return _table(chunk, [b for b, _ in found], [p for _, p in found])

    def read(self, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(payload) * 8 // (8 * self.width + 1)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, : self.width] = np.frombuffer(payload, np.uint8, n * self.width).reshape(n, self.width)
        return wide.view("<u8").ravel(), np.unpackbits(np.frombuffer(payload, np.uint8, offset=n * self.width))[:n] > 0

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a bucket stand together: returns to each chunk a bit for each of its hashes."""

        def close(bucket: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            hashes, twice = zip(*(self.read(raw) for _, raw in rows), strict=True)
            whole, bits = np.concatenate(hashes), np.concatenate(twice)
            order = np.argsort(whole, kind="stable")
            whole = whole[order]
            same = np.zeros(len(whole), bool)
            equal = whole[1:] == whole[:-1]
            same[1:] |= equal
            same[:-1] |= equal
            bits[order] |= same
            cuts = np.cumsum([0, *map(len, hashes)])
            out = [np.packbits(bits[cuts[i] : cuts[i + 1]]).tobytes() for i in range(len(rows))]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([bucket] * len(rows), pa.int32()), pa.array(out, pa.binary())], names=["chunk", "bucket", "payload"])

        bucket, rows = None, []
        for batch in batches:
            for c, b, p in zip(batch.column("chunk").to_pylist(), batch.column("bucket").to_pylist(), batch.column("payload"), strict=True):
                if b != bucket and rows:
                    yield close(bucket, rows)
                    rows = []
                bucket = b
                rows.append((c, p.as_py()))
        if rows:
            yield close(bucket, rows)

    def marks(self, h: np.ndarray, bits: dict[int, bytes]) -> np.ndarray:
        """Which of a chunk's hashes came back marked."""
        placed, back = np.unique(self.placed(h), return_inverse=True)
        hit = np.zeros(len(placed), bool)
        for b, a, e in self.parts(placed):
            hit[a:e] = np.unpackbits(np.frombuffer(bits[b], np.uint8))[: e - a] > 0
        return hit[back]


def _table(chunk: int, buckets: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(buckets), pa.int32()), pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())], names=["chunk", "bucket", "payload"])


def _send(first: Exchange, window: int, text: str):
    """Rows of a chunk stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts = None, []
        for batch in batches:
            ids = batch.column("chunk").to_numpy()
            cuts = np.flatnonzero(np.diff(ids)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if b == a:
                    continue
                if ids[a] != chunk and parts:
                    yield first.rows(chunk, parts)
                    parts = []
                chunk = ids[a]
                parts += [h for _, _, _, (h,) in _windows(batch.column(text).slice(a, b - a), window) if len(h)]
        if parts:
            yield first.rows(chunk, parts)

    return run


def _texts(docs: pa.Table, text: str) -> pa.Array:
    whole = docs.column(text).combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)


def _bits(rows: pa.Table, which: int) -> dict[int, bytes]:
    own = rows.filter(pc.equal(rows.column("round"), which))
    return dict(zip(own.column("bucket").to_pylist(), own.column("payload").to_pylist(), strict=True))


def _again(first: Exchange, second: Exchange, window: int, text: str):
    """The second hashes of the windows that the first exchange marked."""

    def run(docs: pa.Table, bits: pa.Table) -> pa.Table:
        back, parts = _bits(bits, 1), list(_windows(_texts(docs, text), window, (0, 1)))
        one, two = (np.concatenate([p[3][k] for p in parts]) if parts else np.empty(0, np.uint64) for k in (0, 1))
        some = two[first.marks(one, back)] if len(one) else two
        return pa.Table.from_batches([second.rows(docs.column("chunk")[0].as_py(), [some]) if len(some) else _table(0, [], [])])

    return run


def _finish(first: Exchange, second: Exchange, window: int, key: str, text: str):
    """A chunk's documents with the bits that came back from both exchanges."""

    def run(docs: pa.Table, bits: pa.Table) -> pa.Table:
        texts = _texts(docs, text)
        pieces = list(_windows(texts, window, (0, 1)))
        one, two = (np.concatenate([p[3][k] for p in pieces]) if pieces else np.empty(0, np.uint64) for k in (0, 1))
        hit = first.marks(one, _bits(bits, 1)) if len(one) else np.zeros(0, bool)
        if hit.any():
            hit[hit] = second.marks(two[hit], _bits(bits, 2))
        values, rows, at = texts.cast(pa.binary()), [], 0
        for start, first_word, begin, _ in pieces:
            gone = np.zeros(first_word[-1] + 1, np.int64)
            go = begin[hit[at : at + len(begin)]]
            at += len(begin)
            np.add.at(gone, go, 1)
            np.add.at(gone, go + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            for d in range(len(first_word) - 1):
                words = (values[start + d].as_py() or b"").split()
                g = gone[first_word[d] : first_word[d + 1]]
                kept = words if not g.any() else [w for w, x in zip(words, g.tolist(), strict=True) if not x]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, r, sha = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({key: docs.column(key), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(r, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return run


def within(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed and kept_sha256 of each row, without the words of any window that starts elsewhere too.  A
    chunk has CHUNK_BYTES of text or one text; rows that are alike in everything are dealt by their input partition too."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"]
    chunks, buckets = max(1, -(-size // CHUNK_BYTES)), max(1, -(-size // (6 * BUCKET_HASHES)))
    first, second = Exchange(FIRST, buckets), Exchange(SECOND, buckets)
    dealt = docs.select(F.col(key), F.col(text), F.pmod(F.xxhash64(key, text, F.spark_partition_id()), F.lit(chunks)).cast("int").alias("chunk")).repartition(chunks, "chunk")
    packed = "chunk int, bucket int, payload binary"

    def counted(sent: DataFrame, exchange: Exchange, number: int) -> DataFrame:
        returned = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(exchange.count, packed)
        return returned.select("chunk", "bucket", "payload", F.lit(number).alias("round"))

    #: All uses of ``dealt`` keep the same columns, so that Spark shuffles the text once for all.
    chunked = dealt.groupBy("chunk")
    back = counted(dealt.sortWithinPartitions("chunk").mapInArrow(_send(first, window, text), packed), first, 1).repartition(chunks, "chunk")
    more = counted(chunked.cogroup(back.groupBy("chunk")).applyInArrow(_again(first, second, window, text), packed), second, 2)
    schema = dealt.select(F.col(key), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_sha256")).schema
    both = back.unionByName(more).repartition(chunks, "chunk")
    return chunked.cogroup(both.groupBy("chunk")).applyInArrow(_finish(first, second, window, key, text), schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within(frames.table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
g AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS n FROM x) WHERE n > 1),
p AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS pos FROM g),
k AS (SELECT r, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d) ANTI JOIN p USING (r, pos) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
