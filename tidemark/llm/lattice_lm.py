"""Language-model scoring by the marginal probability of a subword lattice.

A document is its words and an end.  Every word is a lattice of the pieces of an existing subword vocabulary and, for code
points outside it, of the 256 bytes; its probability is the sum over all segmentations, found by forward recursion in log
space.  The vocabulary's pieces stay as they are; its ranks (a piece of rank r weighs 1 / (r + 10)) are only where their
weights start from.  Expectation-maximisation over the word counts of all training documents turns them into unigram scores:
a round adds up, in tasks, how often each piece and byte is expected in every distinct word, times the word's count.  It ends
when a round has raised the log-likelihood by less than ``GAIN`` of it, or after ``ROUNDS``.  ``score`` is the log10 of the
lattice's probability of the text, ``known_score`` its part that known tokens have; ``known_base`` is that of the base.

``mixed_score`` is of a count model that backs off to the lattice, with absolute discounting over the N tokens, V of them
distinct, of all training documents: P(w) = (max(c - D, 0) + D V L(w)) / N.

Passes: documents are encoded once into chunks of about ``CHUNK`` bytes with a vocabulary of their own; words are counted with
partial aggregation; the chunks' words join their counts and weights (a word has at most one row a chunk, however often it
occurs) and return to the chunk.  Texts are never shuffled, only encoded documents are.

Edge cases: null text counts as empty, and an empty text is the end token alone; a null doc_id is a training document;
repeated rows count each; without training documents the weights are those of the ranks; a word of any length is scored whole.
"""

from __future__ import annotations

import copy
import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, kernel

TOKENIZERS = "/opt/tokenizers"
CHUNK = 8 << 20
#: Characters of the longest piece of the default vocabulary; another one's are counted.
LONGEST = 16
END = b""
ROUNDS, GAIN = 8, 0.01
#: What the ranks' weights count for beside the expected counts, in pieces, and what each byte counts for.
PRIOR, BYTE_PRIOR = 1000.0, 1.0
_BYTE_WEIGHT = -14.0
#: Words of more characters are worked on one by one; others in blocks of about so many characters.
LONG_WORD, BLOCK = 256, 1 << 17
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
Lattice = dict[str, float]
#: The names of the bytes in a lattice: lone surrogates, which no decoded text holds.
BYTES = [chr(0xDC00 + b) for b in range(256)]


def pieces(path: str = TOKENIZERS) -> Lattice:
    """Log weights from the vocabulary's ranks, and of the bytes, to which code points outside it are left."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{path}/piece_bpe_32k.model")
    ranks = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and sp.get_score(i) > -1e8}
    total = sum(1 / (r + 10) for r in ranks.values())
    return {p: math.log(1 / (r + 10) / total) for p, r in ranks.items()} | dict.fromkeys(BYTES, _BYTE_WEIGHT)


def _sum(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    top = max(values)
    return top + math.log(sum([math.exp(v - top) for v in values]))


def _spelt(point: str, lattice: Lattice) -> float:
    return sum(lattice.get(BYTES[b], _BYTE_WEIGHT) for b in point.encode("utf8", "replace"))


def _utf8(points: np.ndarray) -> np.ndarray:
    """The UTF-8 bytes of code points, four columns, -1 where there are fewer."""
    p = points.astype(np.int64)
    size, out = 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF), np.full((len(p), 4), -1)
    for k, lead in enumerate((0, 0xC0, 0xE0, 0xF0), 1):
        own = size == k
        for j in range(k):
            v = p[own] >> (6 * (k - 1 - j))
            out[own, j] = lead | v if j == 0 else 0x80 | (v & 0x3F)
    return out


def forward(text: str, lattice: Lattice, longest: int = LONGEST) -> list[float]:
    """Log of the total weight of all segmentations of each prefix."""
    ahead = [0.0]
    get = lattice.get
    for j in range(1, len(text) + 1):
        ways = [ahead[i] + v for i in range(max(0, j - longest), j) if (v := get(text[i:j])) is not None]
        if text[j - 1] not in lattice:
            ways.append(ahead[j - 1] + _spelt(text[j - 1], lattice))
        ahead.append(_sum(ways))
    return ahead


def backward(text: str, lattice: Lattice, longest: int = LONGEST) -> list[float]:
    """The same of each suffix."""
    n = len(text)
    behind = [0.0] * (n + 1)
    get = lattice.get
    for i in range(n - 1, -1, -1):
        ways = [behind[j] + v for j in range(i + 1, min(n, i + longest) + 1) if (v := get(text[i:j])) is not None]
        if text[i] not in lattice:
            ways.append(behind[i + 1] + _spelt(text[i], lattice))
        behind[i] = _sum(ways)
    return behind


def _join(stack: list[np.ndarray]) -> np.ndarray:
    """Log of the sum of exponentials over the first axis; one of them is finite."""
    whole = np.array(stack)
    top = whole.max(axis=0)
    return top + np.log(np.exp(whole - top).sum(axis=0))


class Vocabulary:
    """The pieces and their beginnings, by a hash of their code points, and the pieces' log weights, the end token's last."""

    def __init__(self, lattice: Lattice, end: float = -14.0):
        self.names = list(lattice)
        place, spelt = {p: i for i, p in enumerate(self.names)}, set(BYTES)
        self.bytes = np.array([place.get(b, -1) for b in BYTES])
        texts = [p for p in self.names if p not in spelt]
        self.longest = max(map(len, texts), default=1)
        own: dict[int, int] = {}
        more: set[int] = set()
        sizes = np.array([len(p) for p in texts], np.int64)
        for size in np.unique(sizes).tolist():
            some = [p for p in texts if len(p) == size]
            points = np.frombuffer("".join(some).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(-1, size).T
            run = np.zeros(len(some), np.uint64)
            for k in range(size):
                run = self._longer(run, points[k])
                if k < size - 1:
                    more.update(run.tolist())
            own |= zip(run.tolist(), (place[p] for p in some), strict=True)
        every = np.array(sorted(more | own.keys()), np.uint64)
        #: The last entry, above all hashes, is nobody's.
        self.hashes = np.append(every, np.uint64((1 << 64) - 1))
        self.ids = np.array([own.get(h, -1) for h in every.tolist()] + [-1], np.int32)
        self.more = np.array([h in more for h in every.tolist()] + [False])
        #: Where the hashes with these highest bits begin.
        self.first = np.searchsorted(every, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int32)
        self._weigh(np.array([*lattice.values(), end]))

    def _weigh(self, weights: np.ndarray) -> None:
        self.weights, self.lattice = weights, dict(zip(self.names, weights.tolist(), strict=False))
        #: The last entry is what a byte that is not there weighs.
        self.single = np.append(np.where(self.bytes >= 0, weights[self.bytes], _BYTE_WEIGHT), 0.0)

    def reweighted(self, weights: np.ndarray) -> Vocabulary:
        new = copy.copy(self)
        new._weigh(weights)
        return new

    @staticmethod
    def _longer(run: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Hashes of runs that are one code point longer."""
        return kernel.mix((run ^ (points * _C)) * _A + _B)

    def _place(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these hashes are of pieces or their beginnings, and their places."""
        place = self.first[run >> np.uint64(46)]
        todo = np.flatnonzero(self.hashes[place] < run)
        while len(todo):
            place[todo] += 1
            todo = todo[self.hashes[place[todo]] < run[todo]]
        found = np.flatnonzero(self.hashes[place] == run)
        return found, place[found]

    def edges(self, points: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each length from 1 on, where the pieces of that length start, and which they are; and the code points that are no
        piece.  Words of equal length are columns, and places count along the rows.  A place is left as soon as no piece goes on."""
        size, n = points.shape
        flat, out = points.ravel(), []
        at, run = np.arange(size * n), np.zeros(size * n, np.uint64)
        other = np.ones(size * n, bool)
        for k in range(1, min(self.longest, size) + 1):
            inside = np.searchsorted(at, (size - k + 1) * n)
            at = at[:inside]
            run = self._longer(run[:inside], flat[at + (k - 1) * n])
            found, place = self._place(run)
            ids, start = self.ids[place], at[found]
            piece = np.flatnonzero(ids >= 0)
            out.append((start[piece], ids[piece]))
            if k == 1:
                other[start[piece]] = False
            goes_on = self.more[place]
            at, run = start[goes_on], run[found[goes_on]]
            if not len(at):
                break
        return out, np.flatnonzero(other)

    def spans(self, points: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, list[np.ndarray]]:
        """The same, and the log weights of the edges of each length, at the places where they start."""
        edges, other = self.edges(points)
        weights = [np.full(points.shape, -np.inf) for _ in edges]
        for w, (at, ids) in zip(weights, edges, strict=True):
            w.ravel()[at] = self.weights[ids]
        weights[0].ravel()[other] = self.single[_utf8(points.ravel()[other])].sum(axis=1)
        return edges, other, weights

    @staticmethod
    def _points(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The code points of all words, the word mark before each, and where each starts and how many it has.  A word holds no
        line break, which stands for the mark until all are decoded at once."""
        whole = np.frombuffer(b"\n".join([b"", *words]).decode("utf8", "replace").encode("utf-32-le"), "<u4").copy()
        starts = np.flatnonzero(whole == 10)
        whole[starts] = 0x2581
        return whole, starts, np.diff(starts, append=len(whole))

    @staticmethod
    def blocks(whole: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words of equal length, and their code points, a column a word."""
        for size in np.unique(sizes[sizes <= LONG_WORD]).tolist():
            own = np.flatnonzero(sizes == size)
            for a in range(0, len(own), max(1, BLOCK // size)):
                some = own[a : a + max(1, BLOCK // size)]
                yield some, whole[np.arange(size)[:, None] + starts[some]].astype(np.uint64)

    @staticmethod
    def _ahead(weights: list[np.ndarray]) -> np.ndarray:
        size, n = weights[0].shape
        ahead = np.zeros((size + 1, n))
        for j in range(1, size + 1):
            ahead[j] = _join([ahead[j - k] + weights[k - 1][j - k] for k in range(1, min(len(weights), j) + 1)])
        return ahead

    @staticmethod
    def _behind(weights: list[np.ndarray]) -> np.ndarray:
        size, n = weights[0].shape
        behind = np.zeros((size + 1, n))
        for i in range(size - 1, -1, -1):
            behind[i] = _join([behind[i + k] + weights[k - 1][i] for k in range(1, min(len(weights), size - i) + 1)])
        return behind

    def log_weights(self, words: list[bytes]) -> np.ndarray:
        """Log of the total weight of all segmentations of each word; the end token has its own."""
        out, (whole, starts, sizes) = np.empty(len(words)), self._points(words)
        for some, points in self.blocks(whole, starts, sizes):
            out[some] = self._ahead(self.spans(points)[2])[-1]
        for i in np.flatnonzero(sizes > LONG_WORD):
            out[i] = forward("\u2581" + words[i].decode("utf8", "replace"), self.lattice, self.longest)[-1]
        out[sizes == 1] = self.weights[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece, and the end last, is expected in words that occur so often."""
        return self.expectation(words, counts)[0]

    def expectation(self, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, float]:
        """The same, and the log-likelihood of the words."""
        whole, starts, sizes = self._points(words)
        #: The end token has the word mark alone.
        total, ends = np.zeros(len(self.weights)), int(counts[sizes == 1].sum())
        total[-1], likelihood = ends, float(ends * self.weights[-1])
        for some, points in self.blocks(whole, starts, np.where(sizes > 1, sizes, LONG_WORD + 1)):
            edges, other, weights = self.spans(points)
            ahead, behind = self._ahead(weights), self._behind(weights)
            c, n = counts[some], len(some)
            likelihood += float(c @ ahead[-1])

            def times(at: np.ndarray, k: int, ahead=ahead, behind=behind, weights=weights, c=c, n=n) -> np.ndarray:
                row = at % n
                return np.exp(ahead.ravel()[at] + weights[k - 1].ravel()[at] + behind.ravel()[at + k * n] - ahead[-1, row]) * c[row]

            for k, (at, ids) in enumerate(edges, 1):
                total += np.bincount(ids, times(at, k), len(total))
            spelt = _utf8(points.ravel()[other])
            own = np.where(spelt >= 0, self.bytes[spelt], -1)
            total += np.bincount(own[own >= 0], np.broadcast_to(times(other, 1)[:, None], own.shape)[own >= 0], len(total))
        place = None
        for i in np.flatnonzero(sizes > LONG_WORD):
            text = "\u2581" + words[i].decode("utf8", "replace")
            place = place or {p: k for k, p in enumerate(self.names)}
            ahead, behind = forward(text, self.lattice, self.longest), backward(text, self.lattice, self.longest)
            likelihood += float(counts[i] * ahead[-1])
            for a in range(len(text)):
                if text[a] not in self.lattice:
                    share = counts[i] * math.exp(ahead[a] + _spelt(text[a], self.lattice) + behind[a + 1] - ahead[-1])
                    for x in text[a].encode("utf8", "replace"):
                        if BYTES[x] in place:
                            total[place[BYTES[x]]] += share
                for b in range(a + 1, min(len(text), a + self.longest) + 1):
                    if (v := self.lattice.get(text[a:b])) is not None:
                        total[place[text[a:b]]] += counts[i] * math.exp(ahead[a] + v + behind[b] - ahead[-1])
        return total, likelihood


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of words joined until there are so many rows or bytes, so that blocks of equal length fill."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def learn(totals: DataFrame, lattice: Lattice, rounds: int = ROUNDS, gain: float = GAIN) -> Vocabulary:
    """Unigram scores from words and their counts (word, c).  What returns to the driver is a number for each piece, and the
    log-likelihood, as that of piece -1."""
    vocabulary = Vocabulary(lattice)
    prior = np.append(np.exp(vocabulary.weights[:-1]), 1 / (len(lattice) + 1)) * PRIOR
    prior[vocabulary.bytes[vocabulary.bytes >= 0]] = BYTE_PRIOR
    before = -math.inf
    for _ in range(rounds):
        sent = totals.sparkSession.sparkContext.broadcast(vocabulary)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, likelihood = np.zeros(len(sent.value.weights)), 0.0
            for batch in _gathered(batches):
                more, log = sent.value.expectation(batch.column("word").to_pylist(), batch.column("c").to_numpy())
                own, likelihood = own + more, likelihood + log
            some = np.flatnonzero(own)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(own[some], likelihood))], names=["piece", "n"])

        counts = totals.filter("c > 0").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        if counts.empty:
            break
        now, own = float(counts.loc[counts["piece"] < 0, "n"].sum()), counts[counts["piece"] >= 0]
        whole = prior.copy()
        whole[own["piece"].to_numpy()] += own["n"].to_numpy()
        vocabulary = vocabulary.reweighted(np.log(whole / whole.sum()))
        if now - before < gain * abs(now):
            break
        before = now
    return vocabulary


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


ENCODED = "chunk long, doc_id long, held_out boolean, n_tokens long, places binary, word binary, place int, n long"


def _encode() -> object:
    """Documents as chunks: rows with ``word`` are the chunk's vocabulary, with training counts; rows with
    ``places`` are its documents (distinct places as differences, then how often each occurs)."""

    def close(chunk: int, docs: list, vocabulary: dict, counts: list) -> Iterator[pa.RecordBatch]:
        names = list(vocabulary)
        count = np.bincount(np.concatenate(counts) if counts else np.empty(0, np.int64), minlength=len(names))
        for at in range(0, len(names), 50_000):
            q = np.arange(at, min(at + 50_000, len(names)))
            yield _batch(chunk, len(q), word=pa.array(names[at : at + 50_000], pa.binary()), place=pa.array(q, pa.int32()), n=pa.array(count[q], pa.int64()))
        ids, held, sizes, rows = zip(*docs, strict=True)
        yield _batch(chunk, len(docs), doc_id=pa.array(ids, pa.int64()), held_out=pa.array(held, pa.bool_()), n_tokens=pa.array(sizes, pa.int64()), places=pa.array(rows, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, size = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        vocabulary: dict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        counts: list[np.ndarray] = []
        for batch in batches:
            for doc_id, text, held in zip(*(c.to_pylist() if i != 1 else c for i, c in enumerate(batch.columns)), strict=True):
                raw = (text.as_py() or b"").lower()
                ws = raw.split()
                at = np.fromiter(map(vocabulary.__getitem__, ws), np.int64, len(ws))
                at = np.append(at, vocabulary[END])
                distinct, often = np.unique(at, return_counts=True)
                if not held:
                    counts.append(at)
                docs.append((doc_id, held, len(at), np.concatenate([np.diff(distinct, prepend=0), often]).astype(np.uint32).tobytes()))
                size += len(raw) + 64
                if size >= CHUNK:
                    yield from close(part << 24 | chunk, docs, vocabulary, counts)
                    docs, counts, size, chunk = [], [], 0, chunk + 1
                    vocabulary.clear()
        if docs:
            yield from close(part << 24 | chunk, docs, vocabulary, counts)

    return run


_ENCODED = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("places", pa.binary()), ("word", pa.binary()), ("place", pa.int32()), ("n", pa.int64())])


def _batch(chunk: int, rows: int, **cols: pa.Array) -> pa.RecordBatch:
    cols["chunk"] = pa.array(np.full(rows, chunk), pa.int64())
    return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(rows, f.type)) for f in _ENCODED], schema=_ENCODED)


@dataclass
class Totals:
    n: int
    v: int
    discount: float

    def logs(self, c: np.ndarray, lw: np.ndarray) -> np.ndarray:
        """log10 of P for words of these counts."""
        low = np.exp(np.maximum(lw, -700))
        p, unseen = low, 1.0
        if self.n:
            unseen = self.discount * self.v / self.n
            p = np.maximum(c - self.discount, 0) / self.n + unseen * low
        #: A new word whose weight is below what a double holds keeps its logarithm.
        return np.where(c == 0, (lw + math.log(unseen)) / math.log(10), np.log10(np.maximum(p, 1e-300)))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixed_score double, known_base double, known_score double"


def _score(totals: Totals) -> object:
    """Rows of one chunk stand together, its words before its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, gathered, table = None, [], np.zeros((6, 0))
        base_all = math.log10(totals.n + 0.5 * (totals.v + 1))
        for batch in batches:
            ids, is_doc = batch.column("chunk").to_numpy(), batch.column("is_doc").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(is_doc.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if b == a:
                    continue
                if ids[a] != chunk:
                    chunk, gathered = ids[a], []
                rows = batch.slice(a, b - a)
                if not is_doc[a]:
                    gathered.append([rows.column(x).to_numpy() for x in ("place", "c", "lw")])
                    continue
                if gathered:
                    place, c, lw = (np.concatenate(x) for x in zip(*gathered, strict=True))
                    base, own = np.log10(c + 0.5) - base_all, lw / math.log(10)
                    table = np.zeros((6, place.max() + 1))
                    table[:, place] = base, own, totals.logs(c, lw), c > 0, base * (c > 0), own * (c > 0)
                    gathered = []
                out = []
                for raw in rows.column("places"):
                    v = np.frombuffer(raw.as_py(), np.uint32).astype(np.int64)
                    place, often = np.cumsum(v[: len(v) // 2]), v[len(v) // 2 :]
                    out.append(table[:, place] @ often)
                base, own, mixed, known, known_base, known_own = np.array(out).T
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), rows.column("n_tokens"), pa.array(np.rint(known).astype(np.int64)), pa.array(np.full(b - a, totals.n)), pa.array(base), pa.array(own), pa.array(mixed), pa.array(known_base), pa.array(known_own)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixed_score", "known_base", "known_score"])

    return run


def _written(df: DataFrame, at: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.parquet(at)


def score(docs: DataFrame, path: str = TOKENIZERS) -> DataFrame:
    """One row a document; docs has doc_id and text."""
    spark = docs.sparkSession
    shared = f"{frames.checkpoint_dir(spark)}/lattice-{uuid.uuid4().hex}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = _written(docs.select("doc_id", F.col("text").cast("binary"), held_out().alias("held_out")).mapInArrow(_encode(), ENCODED), f"{shared}/encoded")
    words = encoded.filter("word is not null")
    totals = _written(words.groupBy("word").agg(F.sum("n").alias("c")), f"{shared}/totals")
    sent = spark.sparkContext.broadcast(learn(totals, pieces(path)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.log_weights(batch.column("word").to_pylist()))], names=["word", "c", "lw"])

    weighed = totals.select("word", "c").mapInArrow(weigh, "word binary, c long, lw double")
    all_ = totals.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    discount = min(0.95, max(0.05, all_["n1"] / max(1, all_["n1"] + 2 * all_["n2"])))
    known = Totals(all_["n"], all_["v"], discount)
    documents = encoded.filter("places is not null")
    chunks = documents.select("chunk").distinct().count()
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    #: A word that is in every chunk has a row a chunk here, which an adaptive plan splits.
    counted = words.select("chunk", "word", "place").join(weighed, "word")
    left = counted.select("chunk", F.lit(False).alias("is_doc"), "place", "c", "lw", none("long", "doc_id"), none("boolean", "held_out"), none("long", "n_tokens"), none("binary", "places"))
    right = documents.select("chunk", F.lit(True).alias("is_doc"), none("int", "place"), none("long", "c"), none("double", "lw"), "doc_id", "held_out", "n_tokens", "places")
    return left.unionByName(right).repartition(max(1, chunks), "chunk").sortWithinPartitions("chunk", "is_doc").mapInArrow(_score(known), SCORED)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(frames.table(spark, sf_dir, "documents"))
