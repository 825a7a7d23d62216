"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole; each token's byte length gives its character span, and the spans are joined with
the document's sections, which are disjoint character intervals in ascending order.  A token that lies in one section
counts there.  One that crosses a boundary is allocated by a rule:

* ``most``  the section it overlaps in most characters, the earlier one if equal (the default);
* ``start`` the section of its first character;
* ``share`` each section, by its part of the token's characters.

A token outside all sections counts as outside.  Counts of sections and outside add up to the document's tokens.

Long texts are encoded in pieces, cut where the pre-tokeniser always ends a token; where there is no such place for long (a
run of blanks, digits or symbols, script without blanks, one long word) its pattern is applied match by match and every match
is encoded by itself, so that no run is too long for it.

Edge cases: null text counts as empty: no tokens, one empty section; a token that is part of one character spans that
character; ``special token`` strings are ordinary text; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, kernel

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-tokeniser of this vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 1 << 16
RULES = ("most", "start", "share")
#: The pattern always ends a token before a single blank between two others.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: The same pattern for matching one token at a time; white space as that library's classes have it.
_TOKEN = regex.compile(PATTERN.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
_encoders: dict[str, tuple] = {}


def encoder(path: str = f"{TOKENIZERS}/{VOCABULARY}"):
    """The encoding and the byte length of each token; made once a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders[path] = tiktoken.Encoding("tidemark", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[path]


def encode(text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> list[int]:
    """The tokens of a text, however long it and its words are."""
    enc, _ = encoder(path)
    out: list[int] = []
    at = 0
    while len(text) - at > 2 * PIECE:
        cut = _CUT.search(text, at + PIECE, at + 2 * PIECE)
        if cut:
            out += enc.encode_ordinary(text[at : cut.start()])
            at = cut.start()
            continue
        for m in _TOKEN.finditer(text, at):
            out += enc._encode_single_piece(m.group().encode())
            if m.end() - at >= PIECE:
                break
        at = m.end()
    return out + enc.encode_ordinary(text[at:])


def spans(text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> tuple[np.ndarray, np.ndarray]:
    """First character and character after the last of each token."""
    _, lengths = encoder(path)
    ids = np.array(encode(text, path), np.int64)
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if text.isascii():
        return starts, ends
    lead = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
    return lead[starts] - 1, lead[ends - 1]


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str = "most") -> tuple[np.ndarray, float, int]:
    """Tokens of each section, tokens outside all, and the number of tokens that meet more than one section, or a section
    and what is outside.  sections: n x 2, disjoint, ascending."""
    counts = np.zeros(len(sections))
    if not len(starts):
        return counts, 0.0, 0
    if not len(sections):
        return counts, float(len(starts)), 0
    lo, hi = sections[:, 0], sections[:, 1]
    a, b = np.searchsorted(hi, starts, side="right"), np.searchsorted(lo, ends, side="left")  # sections a .. b - 1
    inside = (b - a == 1) & (lo[np.minimum(a, len(lo) - 1)] <= starts) & (ends <= hi[np.minimum(a, len(lo) - 1)])
    np.add.at(counts, a[inside], 1)
    crossing = np.flatnonzero(~inside & (b > a))
    outside = float((b <= a).sum())
    for t in crossing:
        over = np.minimum(hi[a[t] : b[t]], ends[t]) - np.maximum(lo[a[t] : b[t]], starts[t])
        if rule == "share":
            counts[a[t] : b[t]] += over / (ends[t] - starts[t])
            outside += 1 - over.sum() / (ends[t] - starts[t])
        elif rule == "most":
            counts[a[t] + int(np.argmax(over))] += 1
        elif lo[a[t]] <= starts[t]:
            counts[a[t]] += 1
        else:
            outside += 1
    return counts, outside, len(crossing)


def lines(text: str) -> np.ndarray:
    """A section for each line, with its line feed, so that sections cover the text; one empty section for an empty text."""
    points = np.frombuffer(text.encode() if text.isascii() else text.encode("utf-32-le"), np.uint8 if text.isascii() else "<u4")
    ends = np.flatnonzero(points == 10) + 1
    if not len(ends) or ends[-1] < len(text):
        ends = np.append(ends, len(text))
    return np.column_stack([np.append(0, ends[:-1]), ends])


def joined(df: DataFrame, fields: list[str], separator: str = "\n") -> DataFrame:
    """df with ``text``, the fields joined (null ones as empty), and ``sections``, the interval of each field in it."""
    start = F.lit(0)
    parts, out = [], []
    for i, f in enumerate(fields):
        value = F.coalesce(F.col(f).cast("string"), F.lit(""))
        out.append(F.struct(start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end")))
        start = start + F.length(value) + len(separator)
        parts += [value, F.lit(separator)] if i < len(fields) - 1 else [value]
    return df.withColumns({"text": F.concat(*parts), "sections": F.array(*out)})


def count(docs: DataFrame, rule: str = "most", path: str = f"{TOKENIZERS}/{VOCABULARY}", key: str = "doc_id", text: str = "text", sections: str | None = None) -> DataFrame:
    """key, n_chars, n_tokens, n_sections, n_crossing, n_outside and section_tokens of each row; no shuffle.

    sections: a column of arrays of (start, end); without it, a document's lines are its sections.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    cols = [F.col(key), F.col(text).alias("_text")] + ([F.col(sections).alias("_sections")] if sections else [])
    base = docs.select(*cols)
    schema = base.select(F.col(key), *[F.lit(0).cast("long").alias(n) for n in ("n_chars", "n_tokens", "n_sections", "n_crossing")], F.lit(0.0).alias("n_outside"), F.array(F.lit(0.0)).alias("section_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in kernel.slices(whole, "_text", 16 * kernel.SLICE_BYTES):
                rows, tokens = [], [np.zeros(0)]
                for i, t in enumerate(batch.column(1)):
                    t = t.as_py() or ""
                    own = np.array([(s["start"], s["end"]) for s in batch.column(2)[i].as_py() or ()], np.int64).reshape(-1, 2) if sections else lines(t)
                    starts, ends = spans(t, path)
                    counts, outside, crossing = allocate(starts, ends, own, rule)
                    tokens.append(counts)
                    rows.append((len(t), len(starts), len(own), crossing, outside))
                c = list(zip(*rows, strict=True))
                per = pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in tokens]), pa.int32()), pa.array(np.concatenate(tokens)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in c[:4]], pa.array(c[4], pa.float64()), per], names=schema.names)

    return base.mapInArrow(run, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(frames.table(spark, sf_dir, "documents"))
