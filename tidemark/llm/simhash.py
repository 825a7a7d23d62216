"""SimHash near-duplicates by tiled exact comparison.

A fingerprint's bit is set where more than half of a text's shingle hashes have it set.  Distinct fingerprints are compared
in tiles with numpy exclusive-or and bit counts; a tile is skipped where its population counts differ from the other's by
more than the radius, which no linked pair's can.

For a small radius (``link``) the comparison is confined, without losing a pair, to fingerprints that agree in two of five
bit blocks: of ``RADIUS`` = 3 differing bits at least two blocks are free.  Groups larger than ``HOT_GROUP`` are dealt over
several tasks by pairs of tiles.  For a similarity of 0.8 (``near_copies``), every pair of tiles whose shingle counts can
reach that similarity is compared with a wide radius, and the shingle sets of what is found decide.  A task passes on a spanning forest of the links it found, not
the pairs; components are then found by distributed star contraction.  Equal fingerprints are one node throughout.

Edge cases: null texts count as empty; a text of fewer words than a shingle is one shingle; without words the fingerprint
is zero, linked like any other; a component's id is its smallest non-null doc_id (null if it has none).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, kernel
from .components import components

RADIUS, SEED, WORDS = 3, 42, 3
HOT_GROUP = 20_000
TILE = 1024
#: Five blocks of the 64 bits: first bit and width.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; A-Z count as a-z."""
    ws = text.lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    joined = b" ".join(ws)
    if len(ws) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(ws) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(h: np.ndarray) -> np.ndarray:
    """The set bits, as 0 and 1, of 64 bits a column of h (n, or n x columns)."""
    h = h.reshape(len(h), -1)
    total = np.zeros(64 * h.shape[1], np.int64)
    for at in range(0, len(h), 8192):
        piece = np.ascontiguousarray(h[at : at + 8192])
        total += np.unpackbits(piece.view(np.uint8).reshape(len(piece), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * total > len(h)


def fingerprint_of(text: bytes, words: int = WORDS) -> int:
    h = shingle_hashes(text, words)
    return int(np.packbits(majority(h), bitorder="little").view(np.int64)[0]) if len(h) else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """key and ``fp`` (64 bits as a signed long) of each row; one Arrow pass, no shuffle."""
    cols = docs.select(F.col(key), F.col(text).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint_of(t.as_py() or b"", words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=[key, "fp"])

    return cols.mapInArrow(run, cols.select(F.col(key), F.lit(0).cast("long").alias("fp")).schema)


class Union:
    """Disjoint sets over 0 .. n - 1, joined by arrays of pairs; the root is the smallest."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (place, place of its component's first) that connect what the links among ``fp`` connect.

    fp: n, or n x columns, unsigned.  In the order of their population counts, every tile meets the tiles from itself on that
    its counts can reach, all pairs at once by exclusive-or and bit counts.
    """
    fp = fp.reshape(len(fp), -1)
    ones = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    fp, ones = fp[order], ones[order]
    sets = Union(len(fp))
    for a in range(0, len(fp), TILE):
        to = min(a + TILE, len(fp))
        for b in range(a, int(np.searchsorted(ones, ones[to - 1] + radius, side="right")), TILE):
            apart = np.bitwise_count(fp[a:to, None, 0] ^ fp[None, b : b + TILE, 0])
            for c in range(1, fp.shape[1]):
                apart = apart + np.bitwise_count(fp[a:to, None, c] ^ fp[None, b : b + TILE, c]).astype(np.uint16)
            x, y = np.nonzero(apart <= radius)
            own = x + a < y + b
            sets.join(x[own] + a, y[own] + b)
    root = sets.find(np.arange(len(fp)))
    return [(int(order[i]), int(order[root[i]])) for i in np.flatnonzero(root != np.arange(len(fp)))]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
    """Values of the last column of runs of rows that agree in the first ``keys`` columns; rows come sorted by these."""
    held: list[np.ndarray] = []
    last = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys + 1)]
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in cols[:-1]:
            new[1:] |= c[1:] != c[:-1]
        now = tuple(int(c[0]) for c in cols[:-1])
        new[0] = last is not None and now != last
        cuts = np.flatnonzero(new)
        pieces = np.split(cols[-1], cuts)
        for i, piece in enumerate(pieces):
            if i or new[0]:
                if held:
                    yield np.concatenate(held)
                held = []
            if len(piece):
                held.append(piece)
        last = tuple(int(c[-1]) for c in cols[:-1])
    if held:
        yield np.concatenate(held)


def link(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT_GROUP) -> DataFrame:
    """Edges (u, v) that connect what the links among the distinct longs ``fp`` connect."""
    if radius > 3:
        raise ValueError("two of five blocks are sure to agree up to a radius of 3")
    part = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in BLOCKS]
    pairs = [(i, j) for i in range(len(BLOCKS)) for j in range(i)]
    key = F.array(*[F.struct(F.lit(n).alias("k"), (F.shiftleft(part[i], 13) + part[j]).alias("x")) for n, (i, j) in enumerate(pairs)])
    rows = nodes.select("fp", F.explode(key).alias("g")).select(F.col("g.k").alias("k"), F.col("g.x").alias("x"), "fp")
    large = rows.groupBy("k", "x").agg(F.count("*").alias("n")).filter(F.col("n") > hot).withColumn("tiles", F.ceil(F.col("n") / hot).cast("int")).drop("n")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 4):
            if len(group) > 1 and (edges := forest(group.astype(np.int64).view(np.uint64), radius)):
                a = group[np.array(edges)]
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0], pa.int64()), pa.array(a[:, 1], pa.int64())], names=["u", "v"])

    large = frames.cut(large)
    if large.isEmpty():
        dealt = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        own = F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1)).cast("long")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))
        dealt = rows.join(large, ["k", "x"], "left").select("k", "x", "fp", own.alias("t"), other.alias("o")).select("k", "x", "fp", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"))
    dealt = dealt.select("k", "x", "i", "j", "fp").repartition(frames.parts(nodes.sparkSession), "k", "x", "i", "j").sortWithinPartitions("k", "x", "i", "j")
    return dealt.mapInArrow(compare, "u long, v long")


def label(prints: DataFrame, edges: DataFrame, key: str = "doc_id") -> DataFrame:
    """prints (key, fp) with component_id, the smallest key of those that the edges connect.  The rows of a fingerprint that
    very many share are split by the adaptive plan when they join its one row."""
    nodes = prints.groupBy("fp").agg(F.min(key).alias("first"))
    roots = components(edges)
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = frames.cut(fingerprints(frames.table(spark, sf_dir, "documents")))
    found = label(prints, link(prints.select("fp").distinct()))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near copies of a similarity of 0.8 or more

#: 1024 bits; PRE_COLUMNS of the COLUMNS are compared first.
COLUMNS, PRE_COLUMNS = 16, 2
#: Two shingle sets are near if |A and B| / |A or B| >= NUM / DEN, compared in integers.
NUM, DEN = 4, 5
#: Standard errors by which a candidate's fingerprints may exceed what is expected of a pair of the least similarity.
SIGMAS, SMALL = 7.0, 64
NEAR_WORDS, TILE_ROWS, MOST_TILES = 5, 8192, 256
#: Shingles that a verifying task holds of each of its two pieces, and pairs of shingles that it looks up at once.
PIECE, LOOKED_UP = 2_000_000, 4_000_000
MOST_BROADCAST = 500_000
_SALTS = np.random.default_rng(17).integers(1, 1 << 63, COLUMNS, dtype=np.uint64)


def differing(both: int, a: int, b: int) -> float:
    """The probability that a bit differs between two sets that share ``both`` shingles and have ``a`` and ``b`` more."""

    def sums(n: int) -> np.ndarray:
        return np.array([math.comb(n, i) for i in range(n + 1)], float) / 2.0**n

    def above(n: int) -> np.ndarray:
        """That n signs add up to more than -s, for each sum s of the shared ones."""
        tail = np.append(np.cumsum(sums(n)[::-1])[::-1], 0.0)
        return tail[np.clip((n - s) // 2 + 1, 0, n + 1)]

    s = 2 * np.arange(both + 1) - both
    x, y = above(a), above(b)
    return float(sums(both) @ (x * (1 - y) + y * (1 - x)))


@functools.cache
def limits() -> np.ndarray:
    """Rows: the most differing bits of a candidate in all COLUMNS and in PRE_COLUMNS; columns: the lesser shingle count,
    those from SMALL on together.  Bits are independent, so their number is binomial, with the exact probability of sets of
    these counts (few shingles and ties included), the greatest of all counts and overlaps that make a near pair."""
    p = np.zeros(SMALL + 1)
    for n in range(1, SMALL + 1):
        for m in range(n, n * DEN // NUM + 1):
            for both in range(-(-NUM * (n + m) // (NUM + DEN)), n + 1):
                p[n] = max(p[n], differing(both, n - both, m - both))
    p[SMALL] = p[SMALL // 2 :].max()
    bits = 64 * np.array([[COLUMNS], [PRE_COLUMNS]])
    return np.ceil(bits * p + SIGMAS * np.sqrt(bits * p * (1 - p))).astype(np.int64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct five-word shingles of all texts, and where each text's begin (one entry more)."""
    data, offs = kernel.buffers(texts)
    lower = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    starts, ends, first = kernel.words(lower, offs)
    h, doc = kernel.shingles(kernel.word_hashes(lower, starts, ends), first, NEAR_WORDS)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def wide_prints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_k (a hash of key and text), key, id (of the shingle set), n (distinct shingles) and fp (1024 bits) of each row."""
    cols = docs.select(F.xxhash64(key, text).alias("_k"), F.col(key).alias("_key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in kernel.slices(whole):
                h, cuts = shingle_sets(batch.column(2))
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(kernel.mix(h ^ ~_SALTS[0]), out=total[1:])
                own = kernel.mix(total[cuts[1:]] - total[cuts[:-1]] + np.diff(cuts).astype(np.uint64))
                prints = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    total = np.zeros(64 * COLUMNS, np.int64)
                    for at in range(a, b, 4096):
                        piece = kernel.mix(h[at : min(b, at + 4096), None] ^ _SALTS[None, :])
                        total += np.add.reduce(np.unpackbits(piece.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
                    prints.append(np.packbits(2 * total > b - a, bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.view(np.int64)), pa.array(np.diff(cuts), pa.int64()), pa.array(prints, pa.binary())], names=["_k", "_key", "id", "n", "fp"])

    return cols.mapInArrow(run, cols.select("_k", "_key", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("fp")).schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and text to id and the sorted shingle hashes."""
    for whole in batches:
        for batch in kernel.slices(whole):
            h, cuts = shingle_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["id", "shingles"])


def candidates(fp: np.ndarray, n: np.ndarray, tile: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y), in runs of x, of fingerprints within the limits ``most``, between two tiles (or within one, if there
    is only one).  fp: rows x COLUMNS, sorted by tile and n.  Blocks whose shingle counts, or population counts, cannot
    reach the similarity are skipped."""
    full, pre = most[:, np.minimum(n, SMALL)]
    ones = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    cut = int(np.searchsorted(tile, tile[0], side="right"))
    left, right = (0, cut), (cut, len(fp)) if cut < len(fp) else (0, cut)
    other_n = n[right[0] : right[1]]
    for a in range(*left, 256):
        a_to = min(a + 256, left[1])
        lo = right[0] + int(np.searchsorted(other_n * DEN, n[a] * NUM))
        hi = right[0] + int(np.searchsorted(other_n * NUM, n[a_to - 1] * DEN, side="right"))
        mine = ones[a:a_to]
        for b in range(lo if right[0] else max(lo, a), hi, 2048):
            b_to = min(b + 2048, hi)
            theirs, widest = ones[b:b_to], max(full[a:a_to].max(), full[b:b_to].max())
            if theirs.min() - mine.max() > widest or mine.min() - theirs.max() > widest:
                continue
            apart = np.bitwise_count(fp[a:a_to, None, 0] ^ fp[None, b:b_to, 0])
            for c in range(1, PRE_COLUMNS):
                apart += np.bitwise_count(fp[a:a_to, None, c] ^ fp[None, b:b_to, c])
            x, y = np.nonzero(apart <= max(pre[a:a_to].max(), pre[b:b_to].max()))
            x, y = x + a, y + b
            keep = (x < y) & (n[x] * DEN >= n[y] * NUM) & (n[y] * DEN >= n[x] * NUM)
            x, y = x[keep], y[keep]
            for at in range(0, len(x), 1 << 16):
                p, q = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                near = np.bitwise_count(fp[p] ^ fp[q]).sum(axis=1, dtype=np.int64) <= np.where(n[p] < n[q], full[p], full[q])
                yield p[near], q[near]


def flagged(fp: np.ndarray, n: np.ndarray, tile: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that are in a candidate pair, and the two pieces, of about PIECE shingles each, that the pair lies in."""
    hit = np.zeros(len(fp), bool)
    for x, y in candidates(fp, n, tile, most):
        hit[x] = hit[y] = True
    rows = np.flatnonzero(hit)
    _, piece = np.unique(np.cumsum(n[rows]) // PIECE, return_inverse=True)
    if not len(rows) or piece[-1] == 0:
        return rows, piece, piece
    beside = np.zeros((len(rows), piece[-1] + 1), bool)
    for x, y in candidates(fp[rows], n[rows], tile[rows], most):
        beside[x, piece[y]] = beside[y, piece[x]] = True
    at, other = np.nonzero(beside)
    return rows[at], np.minimum(piece[at], other), np.maximum(piece[at], other)


def verified(fp: np.ndarray, n: np.ndarray, tile: np.ndarray, shingles: list[np.ndarray], most: np.ndarray) -> Union:
    """Joins the candidates whose shingle sets are near; pairs that are connected already are not looked up."""
    joined = Union(len(fp))
    distinct, dense = np.unique(np.concatenate(shingles), return_inverse=True)
    ends = np.cumsum(n)
    starts, mark = ends - n, np.zeros(len(distinct), bool)
    for x, y in candidates(fp, n, tile, most):
        for run in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1):
            if not len(run):
                continue
            one, others = x[run[0]], y[run]
            others = others[joined.find(others) != joined.find(np.array([one]))]
            mark[dense[starts[one] : ends[one]]] = True
            for some in np.split(others, np.flatnonzero(np.diff(np.cumsum(n[others]) // LOOKED_UP)) + 1):
                if len(some):
                    size = n[some]
                    begin = np.cumsum(size) - size
                    at = np.arange(size.sum()) - np.repeat(begin - starts[some], size)
                    both = np.add.reduceat(mark[dense[at]], begin, dtype=np.int64)
                    near = some[both * DEN >= (n[one] + size - both) * NUM]
                    joined.join(np.full(len(near), one), near)
            mark[dense[starts[one] : ends[one]]] = False
    return joined


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows that agree in ``keys``, which stand together."""
    last, parts = None, []
    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in cols:
            new |= np.diff(c) != 0
        cuts = np.flatnonzero(new) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b == a:
                continue
            now = tuple(int(c[a]) for c in cols)
            if now != last and parts:
                yield last, pa.Table.from_batches(parts)
                parts = []
            last = now
            parts.append(batch.slice(a, b - a))
    if parts:
        yield last, pa.Table.from_batches(parts)


def _columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    fp = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(-1, COLUMNS)
    return rows.column("id").to_numpy(), fp, rows.column("n").to_numpy(), rows.column("tile").to_numpy()


def _flag(most: np.ndarray):
    """Rows i, j, tile, n, id, fp; those of one (i, j) stand together, sorted by tile and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (i, j), rows in _runs(batches, ["i", "j"]):
            ids, *cols = _columns(rows)
            at, p, q = flagged(*cols, most)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int32()), pa.array([j] * len(at), pa.int32()), pa.array(p, pa.int32()), pa.array(q, pa.int32()), pa.array(ids[at], pa.int64())], names=["i", "j", "p", "q", "id"])

    return run


def _verify(most: np.ndarray):
    """Rows i, j, p, q, tile, n, id, fp, shingles; those of one (i, j, p, q) stand together, sorted by tile and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, ["i", "j", "p", "q"]):
            ids, *cols = _columns(rows)
            joined = verified(*cols, [np.frombuffer(s.as_py(), np.uint64) for s in rows.column("shingles")], most)
            root = joined.find(np.arange(len(ids)))
            linked = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[root[linked]])], names=["u", "v"])

    return run


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs less all but one row (the smallest key, nulls last, then by a hash) of every group of near copies.

    Rows of equal shingle sets count as copies.  Fingerprints are compared by tiles in the order of their shingle counts,
    each tile with those whose counts can reach the similarity; there are MOST_TILES tiles at most, so that a fingerprint
    goes to a bounded number of tasks.  What is within the wide limits is a candidate only: the shingle sets of the rows
    that have one are dealt to the same pairs of tiles, where a pair is linked if the sets themselves are near.  There are
    as many partitions as pairs of tiles, or of pieces, if these are more than the session's.
    """
    prints = frames.cut(wide_prints(docs, key, text))
    mine = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_k").alias("k"))
    nodes = frames.cut(prints.groupBy("id", "n", "fp").agg(F.min(mine).alias("first")))
    count = nodes.count()
    tiles = min(MOST_TILES, max(1, -(-count // TILE_ROWS)))
    place = F.col("n") + F.pmod("id", F.lit(1 << 20)) / float(1 << 20)
    splits = list(dict.fromkeys(nodes.agg(F.percentile_approx(place, [t / tiles for t in range(1, tiles)], 100 * tiles).alias("q")).first()["q"] or [])) if tiles > 1 else []
    low, high = [0.0, *splits], [*splits, float("inf")]
    partners = [[u for u in range(len(low)) if int(max(low[t], low[u])) * NUM <= min(high[t], high[u]) * DEN] for t in range(len(low))]
    tile = F.size(F.filter(F.array(*[F.lit(s) for s in splits]).cast("array<double>"), lambda s: s <= place))
    tiled = nodes.select("id", "n", "fp", tile.alias("tile"))
    dealt = tiled.select("*", F.explode(F.element_at(F.array(*[F.array(*[F.lit(u) for u in p]) for p in partners]), F.col("tile") + 1)).alias("o"))
    dealt = dealt.select(F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "tile", "n", "id", "fp")
    parts = frames.parts(docs.sparkSession)
    met = sum(u >= t for t, p in enumerate(partners) for u in p)
    flags = frames.cut(dealt.repartition(max(parts, met), "i", "j").sortWithinPartitions("i", "j", "tile", "n").mapInArrow(_flag(limits()), "i int, j int, p int, q int, id long"))
    some = frames.cut(nodes.join(flags.select("id").distinct(), "id").select("id", F.col("first.k").alias("_k")))
    some = F.broadcast(some) if some.count() <= MOST_BROADCAST else some
    texts = docs.select(F.xxhash64(key, text).alias("_k"), F.col(text).alias("text")).join(some, "_k").select("id", "text")
    sets = texts.mapInArrow(_sets, "id long, shingles binary").dropDuplicates(["id"])
    pairs = flags.join(tiled, "id").join(sets, "id").select("i", "j", "p", "q", "tile", "n", "id", "fp", "shingles")
    groups = flags.select("i", "j", "p", "q").distinct().count()
    edges = pairs.repartition(max(parts, groups), "i", "j", "p", "q").sortWithinPartitions("i", "j", "p", "q", "tile", "n").mapInArrow(_verify(limits()), "u long, v long")
    roots = components(edges)
    first = nodes.join(roots, nodes["id"] == roots["node"], "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first"))
    winners = first.select(F.col("first.k").alias("_k")).join(prints.groupBy("_k").agg(F.count("*").alias("_copies")), "_k")
    winners = frames.cut(winners)
    mark, copies = frames.apart(docs, "_k"), frames.apart(docs, "_copies")
    winners = winners.select(F.col("_k").alias(mark), F.col("_copies").alias(copies))
    kept = docs.withColumn(mark, F.xxhash64(key, text)).join(winners, mark)
    out = [F.col(c) for c in docs.columns]
    if winners.filter(F.col(copies) > 1).isEmpty():
        return kept.select(*out)
    return kept.filter(F.col(copies) == 1).select(*out).unionByName(kept.filter(F.col(copies) > 1).dropDuplicates([mark]).select(*out))
