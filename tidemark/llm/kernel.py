"""Vectorised text kernels shared by the Python-side operators.

Texts are handled as UTF-8 bytes.  A word is a run of bytes outside ``\\x20 \\x09-\\x0D``, which is exactly the run of
code points outside that set, because no byte of a multi-byte code point is below 0x80.  Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P, _Q, _R = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
#: The low k bytes of eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; nulls are empty."""
    a = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and offs[-1] > offs[0] else np.empty(0, np.uint8)
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a piece holds at most ``most`` bytes of text, or a single row."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (one more entry at the end)."""
    n = len(data)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = offs[1:-1]
    a, b = cut[cut < n], cut[cut > 0] - 1
    first[a] = solid[a]
    last[b] = solid[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words, equal for equal bytes wherever they stand.  Eight bytes at a time go through a mixing that
    is not linear, so that no two words collide by their structure."""
    size = (ends - starts).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    out = mix((size.astype(np.uint64) + _U(seed)) * _P + _R)
    todo, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(todo):
        lane = lanes[starts[todo] + at] & _LOW[np.minimum(size[todo] - at, 8)]
        out[todo] = mix((out[todo] ^ lane) * _P + _Q)
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _P + ((b << _U(29)) | (b >> _U(35))) * _Q + _R)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive entries; len(hashes) - k + 1 of them, none if that is below 1.  Runs of powers of two
    are joined from halves, and the run of k from those its binary digits name."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    run, size, at, out = hashes, 1, 0, None
    while True:
        if k & size:
            part = run[at : at + n]
            out = part if out is None else _joined(out, part)
            at += size
        size *= 2
        if size > k:
            return mix(out + _R)
        run = _joined(run[: len(run) - size // 2], run[size // 2 :])


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and the text each belongs to; a text of fewer words gives one shingle
    of all its words, one without words none."""
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, 0)
    doc = np.repeat(np.arange(len(count)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    h = rolling(hashes, k)[start] if len(start) else np.empty(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = [int(mix(rolling(hashes[first[d] : first[d + 1]], int(count[d])) + _U(count[d]))[0]) for d in short]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, np.array(own, np.uint64)])
    return h, doc
