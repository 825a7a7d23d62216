"""Byte-level BPE encoding and decoding, with long unsplit text put together from parts by tree concatenation.

The pre-tokeniser splits a text into words, which BPE encodes one by one.  A text of up to ``PIECE`` characters is encoded where
it is.  A longer one is cut: before a blank between two others, where the pre-tokeniser always begins a word; where there is no
such place, at the ends of the words that the library's own pre-tokeniser finds; and a word that is itself longer is halved
until its parts fit.  The pieces are dealt over the cluster and encoded there.  Parts of one word are then joined pairwise, up
the tree: the last k tokens of the left and the first k of the right are encoded again as one, with k doubled until the first
and the last token come out as they were.  A sequence of tokens is the encoding of its bytes exactly if every two neighbours
are that of theirs (merges of a trained BPE are in order of their rank, and a part's rank is below the whole's; ``tokenizer``
checks it), so the rest of both sides stays.

Pieces are keyed by a hash of their text, so equal long texts are encoded once; what is kept between the two steps is the
digests of the short texts and the pieces of the long ones.

Edge cases: a null text counts as empty, which has no tokens; strings of added tokens in a text become these tokens, as the
library has it; repeated rows give repeated results; other columns are not looked at.  Vocabularies that are not plain
byte-level BPE (a normaliser, prefix blanks, added tokens that strip) are refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, kernel

VOCABULARY = "byte_bpe_50k.json"
PIECE = 1 << 15
#: Bytes of text that are encoded at once.
AT_ONCE = 1 << 20
#: The pre-tokeniser looks this far ahead at most (a contraction).
AHEAD = 3
#: Words of code points below this are found by ``re``, whose classes are read off the library's own pre-tokeniser.
PLAIN = 0x3000
#: Words that a process keeps the tokens of, and their length at most.
KEPT_WORDS, KEPT_CHARS = 1 << 18, 64
_CUT = re.compile(r"(?<=\S)(?= \S)")
_made: dict[str, "Coder"] = {}


def alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself where it is printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in shown else next(spare)) for b in range(256)}


class _Words(dict):
    """The tokens of words, made when first asked for."""

    def __init__(self, coder: "Coder"):
        self.coder = coder

    def __missing__(self, word: str) -> list[int]:
        ids = self.coder.part(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Coder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self._check(spec)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        size = self.library.get_vocab_size()
        self.token = [self.library.id_to_token(i) or "" for i in range(size)]
        self.decimal = [str(i) for i in range(size)]
        self.shown = {ord(bytes([b]).decode("latin-1")): c for b, c in alphabet().items()}
        self.beyond = re.compile(f"[^\\0-{chr(PLAIN - 1)}]")
        self.split, self.words = self._split(), _Words(self)

    @staticmethod
    def _check(spec: dict) -> None:
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = not spec["normalizer"] and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("not a plain byte-level BPE")
        made = set()
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if any(len(x) > 1 and x not in made for x in (a, b)) or a + b in made:
                raise ValueError("merges are not in order of their parts")
            made.add(a + b)

    def _split(self):
        """The pre-tokeniser's pattern for code points below PLAIN, each put into the class that the library has it in."""
        classes: dict[str, list[str]] = {"letter": [], "number": [], "space": [], "other": []}
        for c in map(chr, range(PLAIN)):
            spans = [x for _, x in self.library.pre_tokenizer.pre_tokenize_str(f"a{c}1{c}!{c}")]
            kind = "letter" if spans[0] == (0, 2) else "number" if (1, 4) in spans else "other" if (3, 6) in spans else "space"
            classes[kind].append("\\" + c if c in "[]\\^-&~|" else c)
        some = {k: "".join(v) for k, v in classes.items()}
        return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{some['letter']}]+| ?[{some['number']}]+| ?[{some['other']}]+|[{some['space']}]+(?![^{some['space']}])|[{some['space']}]+").findall

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Plain texts word by word, with the words' tokens kept; the others, and those with added tokens, by the library."""
        found, rest = [], []
        for i, t in enumerate(texts):
            plain = not self.beyond.search(t) and not (self.special and self.special.search(t))
            found.append(list(chain.from_iterable(map(self.words.__getitem__, self.split(t)))) if plain else None)
            if not plain:
                rest.append(i)
        for i, e in zip(rest, self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        return found

    def part(self, text: str) -> list[int]:
        """A part of one word, without pre-tokenising."""
        return self._word(text.encode().decode("latin-1").translate(self.shown))

    def _word(self, shown: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(shown)] if shown else []

    def join(self, left: list[int], right: list[int], k: int = 4) -> list[int]:
        if not left or not right:
            return left or right
        while True:
            a, b = left[-k:], right[:k]
            again = self._word("".join([self.token[i] for i in a + b]))
            if (len(a) == len(left) or again[0] == a[0]) and (len(b) == len(right) or again[-1] == b[-1]):
                return left[:-k] + again + right[k:]
            k *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def pieces(self, text: str, most: int = PIECE) -> Iterator[tuple[int, int, bool, str]]:
        """(run, part, unsplit, text), in order; the parts of a run that is unsplit are of one word."""
        run = 0
        for whole, words in self._stretches(text, most):
            if whole or len(words) <= most:
                yield run, 0, False, words
            else:
                n = 1 << (-(-len(words) // most) - 1).bit_length()
                for i in range(n):
                    yield run, i, True, words[i * len(words) // n : (i + 1) * len(words) // n]
            run += 1

    def _stretches(self, text: str, most: int) -> Iterator[tuple[bool, str]]:
        """Texts whose words are words of the whole, each of ``most`` characters at most or (False) one word."""
        ends = [(m.start(), m.end()) for m in self.special.finditer(text)] if self.special else []
        at = 0
        for a, b in [*ends, (len(text), len(text))]:
            yield from self._words(text[at:a], most)
            if b > a:
                yield True, text[a:b]
            at = b

    def _words(self, text: str, most: int) -> Iterator[tuple[bool, str]]:
        at, look = 0, most
        while len(text) - at > most:
            if look == most and (cut := _CUT.search(text, at + most // 2, at + most)):
                yield True, text[at : cut.start()]
                at = cut.start()
                continue
            near = text[at : at + look]
            sure = len(near) if at + look >= len(text) else len(near) - AHEAD
            found = [e for _, (_, e) in self.library.pre_tokenizer.pre_tokenize_str(near) if e <= sure]
            fit = [e for e in found if e <= most]
            if fit:
                yield True, near[: fit[-1]]
                at += fit[-1]
            elif found:
                yield False, near[: found[0]]
                at += found[0]
            else:
                look *= 2
                continue
            look = most
        if at < len(text):
            yield True, text[at:]


def tokenizer(path: str) -> Coder:
    """Made once a process."""
    if path not in _made:
        _made[path] = Coder(path)
    return _made[path]


def encode(text: str, path: str, most: int = PIECE) -> list[int]:
    """The tokens of one text, by the same cuts and joins."""
    coder, runs = tokenizer(path), {}
    for run, _, unsplit, part in coder.pieces(text, most):
        runs.setdefault(run, []).append(coder.part(part) if unsplit else coder.whole([part])[0])
    return [i for parts in runs.values() for i in coder.tree(parts)]


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(coder: Coder, ids: list[list[int]], keep: bool) -> list[pa.Array]:
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    decimal = coder.decimal
    out = [
        pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(",".join([decimal[i] for i in x])) for x in ids], pa.string()),
        pa.array([sha(t) for t in coder.library.decode_batch(ids, skip_special_tokens=False)], pa.string()),
    ]
    return [*out, pa.array(ids, pa.list_(pa.int32()))] if keep else out


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: bool = False, most: int = PIECE) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each row, and, if keep, the ``ids`` themselves.  Texts and words of more than
    ``most`` characters are cut."""
    base = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    digests = DIGESTS + (", ids array<int>" if keep else "")
    key_type = base.schema["_key"].dataType.simpleString()
    key_arrow = lambda batch: batch.column(0)
    names = ["_key", "_hash", "_run", "_part", "_unsplit", "_piece"]
    values = [d.split()[0] for d in digests.split(", ")]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of short texts with their digests; of long ones a row with the hash alone, and one for each piece."""
        coder = tokenizer(path)
        for whole in batches:
            for batch in kernel.slices(whole, "_text", AT_ONCE):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                short = [i for i, t in enumerate(texts) if len(t) <= most]
                if short:
                    own, nothing = key_arrow(batch).take(pa.array(short)), lambda kind, n=len(short): pa.nulls(n, kind)
                    yield pa.RecordBatch.from_arrays([own, nothing(pa.string()), nothing(pa.int32()), nothing(pa.int32()), nothing(pa.bool_()), nothing(pa.string()), *_digests(coder, coder.whole([texts[i] for i in short]), keep)], names=names + values)
                for i in sorted(set(range(len(texts))) - set(short)):
                    rows = [(None, None, None, None), *coder.pieces(texts[i], most)]
                    n, mark = len(rows), hashlib.sha256(texts[i].encode()).hexdigest()
                    own = pa.concat_arrays([key_arrow(batch).slice(i, 1), pa.nulls(n - 1, key_arrow(batch).type)])
                    run, part, unsplit, piece = zip(*rows, strict=True)
                    blank = [pa.nulls(n, k) for k in (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))][: len(values)]
                    yield pa.RecordBatch.from_arrays([own, pa.array([mark] * n), pa.array(run, pa.int32()), pa.array(part, pa.int32()), pa.array(unsplit, pa.bool_()), pa.array(piece, pa.string()), *blank], names=names + values)

    first = frames.cut(base.mapInArrow(begin, f"_key {key_type}, _hash string, _run int, _part int, _unsplit boolean, _piece string, {digests}"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for whole in batches:
            for batch in kernel.slices(whole, "_piece", AT_ONCE):
                ids = [coder.part(t) if alone else coder.whole([t])[0] for alone, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))], names=["_hash", "_run", "_part", "_ids"])

    def together(rows: pa.Table) -> pa.Table:
        """One long text: its runs in order, the parts of each joined up the tree."""
        coder, rows = tokenizer(path), rows.sort_by([("_run", "ascending"), ("_part", "ascending")])
        runs: dict[int, list[list[int]]] = {}
        for run, ids in zip(rows.column("_run").to_pylist(), rows.column("_ids"), strict=True):
            runs.setdefault(run, []).append(ids.values.to_numpy().tolist())
        ids = [i for parts in runs.values() for i in coder.tree(parts)]
        return pa.Table.from_arrays([rows.column("_hash").slice(0, 1), *_digests(coder, [ids], keep)], names=["_hash", *values])

    pieces = first.filter("_run IS NOT NULL").groupBy("_hash", "_run", "_part").agg(F.first("_unsplit").alias("_unsplit"), F.first("_piece").alias("_piece"))
    parts = pieces.mapInArrow(each, "_hash string, _run int, _part int, _ids array<int>")
    long = parts.groupBy("_hash").applyInArrow(together, f"_hash string, {digests}")
    done = first.filter("_hash IS NULL").select("_key", *values)
    waiting = first.filter("_hash IS NOT NULL AND _run IS NULL").select("_key", "_hash")
    return done.unionByName(waiting.join(long, "_hash").select("_key", *values)).withColumnRenamed("_key", key)


def decoded(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and ``text`` of rows of token ids; null ids give a null text, bytes that are no UTF-8 the replacement character."""
    base = tokens.select(F.col(key), F.col(ids).alias("_ids"))
    schema = base.select(F.col(key), F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            texts = [None if x is None else coder.library.decode(x, skip_special_tokens=False) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return base.mapInArrow(run, schema)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(frames.table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
