"""Personal data: fixed rules plus a semi-Markov conditional random field over whole spans.

The rules (``base_spans``) find e-mail addresses, IPv4 addresses, payment cards and international phone numbers; what they
find always stays.  The model scores whole candidate segments of a small region around digits, ``@`` or a bracketed "at":
a segment of at most ``MOST_TOKENS`` tokens and ``MOST_CHARS`` characters gets features of the entire span (digit count, check digit, grouping,
separators, neighbours, cue words before it) and a weight vector for each kind; every token outside a segment scores 0.
Dynamic programming over the region then chooses boundaries and kinds together.  The model is trained by gradient ascent on
the conditional log-likelihood, on generated examples (written forms that the rules miss, and look-alikes) and on a bounded
sample of the corpus's own snippets labelled by the rules (``SAMPLE`` snippets of at most ``SNIPPET`` characters).

What is longer than a segment may be is not cut: a chosen span is extended to the run of address characters, or of digits, that it
lies in, so that no part of an address or a number stays behind when it is redacted.

Offsets are code points, end exclusive.  Edge cases: null text counts as empty and has no spans; a text without digits,
``@`` or bracketed "at" is not looked at further; repeated rows give repeated results.  Spans of the model never overlap a
rule's span.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS, MOST_CHARS, REACH, GAP = 18, 80, 40, 24
SAMPLE, SNIPPET = 300, 300

_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT = r"[\[(]\s?(?:at|AT|At)\s?[\])]"
_TRIGGER = re.compile(rf"[0-9@]|{_AT}")
_SOME = re.compile(r"[0-9@]|[\[(]\s?[aA][tT]\s?[\])]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place in KINDS) of what the rules find, by start, then kind."""
    out = []
    if "@" in text:
        free = 0
        for m in _TAIL.finditer(text):
            at = s = m.start()
            while s > free and text[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                out.append((s, m.end(), 0))
                free = m.end()
    if _DIGIT.search(text):
        out += [(*m.span(), 1) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m.group())) <= 15]
    out.sort(key=lambda x: (x[0], x[2]))
    return out


# --- the model: regions, candidate segments and their features

_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
_SEPARATORS = frozenset(" ().-+/[]")
_FULL = re.compile(r"[^\s@()\[\]<>,;:]+@[\w-]+(?:\.[\w-]+)+")
_SPELT = re.compile(rf"[\w.+-]+\s?{_AT}\s?[\w-]+(?:\s?(?:[\[(]\s?(?:dot|DOT|Dot)\s?[\])]|\.)\s?[\w-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:(?:\.|\[\.\]|\(\.\))[0-9]+){3}")
_CUES = (re.compile(r"(?i)mail\W*$"), re.compile(r"(?i)(?:\bip|addr|address|host|server)\W*$"), re.compile(r"(?i)(?:card|visa|credit|\bcc)\W*(?:no|number)?\W*$"), re.compile(r"(?i)(?:phone|tel|call|mobile|fax|cell)\W*$"))
_SHAPES = ("3 3 4", "4 4 4 4", "4 6 5", "1 3 3 4", "2 2 2 2 2")
_COUNTS = (7, 8, 10, 11, 14, 16, 17, 20)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around triggers that stand at most GAP apart, with REACH characters to both sides, merged."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        if start < 0:
            start, end = m.span()
        elif m.start() - end <= GAP + 2 * REACH:
            end = m.end()
        else:
            yield max(0, start - REACH), min(len(text), end + REACH)
            start, end = m.span()
    if start >= 0:
        yield max(0, start - REACH), min(len(text), end + REACH)


def features(text: str, s: int, e: int) -> list[int]:
    """Numbers of the features that hold for the span text[s:e]."""
    seg = text[s:e]
    digits = "".join(_DIGIT.findall(seg))
    n = len(digits)
    out = [0]
    add = out.append
    if "@" in seg:
        add(1 if _FULL.fullmatch(seg) else 2)
        if seg[-1] in ".-_":
            add(3)
    elif n < len(seg) and any(c.isalpha() for c in seg):
        add(4 if _SPELT.fullmatch(seg) else 5)
    else:
        if _DOTTED.fullmatch(seg):
            add(6 if all(map(_small, re.findall("[0-9]+", seg))) else 7)
        add(8 + sum(n >= c for c in _COUNTS))  # 8 to 16
        if 14 <= n <= 19:
            add(17 if luhn(digits) else 18)
        if seg[0] == "+":
            add(19)
        if seg[0] == "(":
            add(20)
        add(21 if seg.count("(") == seg.count(")") and seg.count("[") == seg.count("]") else 22)
        groups = " ".join(str(len(g)) for g in re.findall("[0-9]+", seg))
        add(23 + _SHAPES.index(groups) if groups in _SHAPES else 28 if " " in groups else 29)
    before, after = text[max(0, s - 1) : s], text[e : e + 2]
    if before.isalnum() or before in ("_", "+", "@"):
        add(30)
    if after[:1].isalnum() or after[:1] in ("_", "@"):
        add(31)
    if len(after) == 2 and after[0] in " .-/" and after[1].isdigit() or s > 1 and before in (" ", ".", "-", "/") and text[s - 2].isdigit():
        add(32)
    out += [33 + k for k, c in enumerate(_CUES) if c.search(text[max(0, s - 16) : s])]
    return out


WIDTH = 33 + len(_CUES)


def tokens_of(text: str, lo: int, hi: int) -> tuple[array, array]:
    """Starts and ends of the region's tokens."""
    starts, ends = array("q"), array("q")
    for m in _TOKEN.finditer(text, lo, hi):
        starts.append(m.start())
        ends.append(m.end())
    return starts, ends


def candidates(text: str, starts: array, ends: array, i: int) -> Iterator[tuple[int, list[int]]]:
    """The candidate segments that start at token i: the token after, and the features."""
    s = starts[i]
    if text[s].isspace() or text[s] in ")-./]":
        return
    letters = mark = False
    n = 0
    for j in range(i, min(len(starts), i + MOST_TOKENS)):
        a, b = starts[j], ends[j]
        c = text[a]
        if c == "\n" or b - s > MOST_CHARS:
            return
        if c.isdigit() and c.isascii():
            n += b - a
        elif c == "@":
            mark = True
        elif c not in _SEPARATORS:
            letters = True
            mark = mark or text[a:b] in ("at", "AT", "At") and text[a - 1 : a] in ("(", "[", " ")
        if letters and not mark and c == " " and text[b : b + 1] not in ("(", "["):
            return
        if c.isspace() or c in "(-./[,;:":
            continue
        if mark or not letters and (n >= 7 or n >= 4 and text.count(".", s, b) >= 3):
            on = features(text, s, b)
            if not mark or {1, 4} & set(on):
                yield j + 1, on


def segments(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """Tokens of the region, the candidate segments as token ranges, and a 0/1 row of features for each."""
    starts, ends = tokens_of(text, lo, hi)
    found, rows = [], []
    for i in range(len(starts)):
        for j, on in candidates(text, starts, ends, i):
            row = np.zeros(WIDTH)
            row[on] = 1
            found.append((i, j))
            rows.append(row)
    return list(zip(starts, ends, strict=True)), found, np.array(rows).reshape(len(rows), WIDTH)


def decode(text: str, lo: int, hi: int, weights: list[list[float]]) -> list[tuple[int, int, int]]:
    """The best segmentation of the region: (start, end, kind) of the chosen segments.  A token is settled when it is reached,
    and a segment hands its score on to the token after it, so only a few numbers a token are kept however long the region."""
    starts, ends = tokens_of(text, lo, hi)
    n, kinds = len(starts), range(len(KINDS))
    best, origin, kind = array("d", bytes(8 * (n + 1))), array("q", [-1]) * (n + 1), bytearray(n + 1)
    for i in range(n):
        here = best[i]
        for j, on in candidates(text, starts, ends, i):
            scores = [sum([weights[f][k] for f in on]) for k in kinds]
            top = max(scores)
            if here + top > best[j]:
                best[j], origin[j], kind[j] = here + top, i, scores.index(top)
        if best[i + 1] < here or origin[i + 1] < 0:
            best[i + 1], origin[i + 1] = here, -1
    out, t = [], n
    while t > 0:
        if origin[t] < 0:
            t -= 1
        else:
            out.append((starts[origin[t]], ends[t - 1], kind[t]))
            t = origin[t]
    return out[::-1]


def _sum_log(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if len(values) > 1 and top > -math.inf else top


def gradient(found: np.ndarray, rows: np.ndarray, weights: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """Gradient of the conditional log-likelihood: observed less expected features.

    found: boundary numbers of the segments' starts and ends, in which tokens at which none starts or ends are left out;
    gold: the segments' true kinds, -1 for none.
    """
    scores = rows @ weights
    n = int(found.max())
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    total = np.logaddexp.reduce(scores, axis=1).tolist()
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    by_start: list[list[int]] = [[] for _ in range(n + 1)]
    pairs = found.tolist()
    for k, (i, j) in enumerate(pairs):
        by_end[j].append(k)
        by_start[i].append(k)
    for t in range(1, n + 1):
        ahead[t] = _sum_log([ahead[t - 1], *(ahead[pairs[k][0]] + total[k] for k in by_end[t])])
    for t in range(n - 1, -1, -1):
        behind[t] = _sum_log([behind[t + 1], *(behind[pairs[k][1]] + total[k] for k in by_start[t])])
    i, j = found.T
    p = np.exp(np.array(ahead)[i] + np.array(behind)[j] - ahead[n])[:, None] * np.exp(scores)
    seen = np.zeros_like(p)
    seen[gold >= 0, gold[gold >= 0]] = 1
    return rows.T @ (seen - p)


# --- training data

def _made(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """One generated text with its true spans."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "la", "de", "ou", "st"]) for _ in range(rng.randint(1, 4)))

    def card(good: bool) -> str:
        while True:
            c = rng.choice("3456") + d(15)
            if luhn(c) == good:
                sep = rng.choice(["", "", " ", "-", ".", "/"])
                return sep.join(c[i : i + 4] for i in range(0, 16, 4))

    def ip(most: int) -> str:
        return rng.choice([".", ".", "[.]", "(.)"]).join(str(rng.randint(0, most)) for _ in range(4))

    area, mid, end = str(rng.randint(200, 989)), str(rng.randint(200, 999)), d(4)
    kind = rng.choice([0, 0, 1, 1, 2, 2, 3, 3, 3, None, None, None, None])
    cue = ""
    if kind == 0:
        span = rng.choice([f"{word()}.{d(2)}@{word()}.com", f"{word()} [at] {word()} [dot] com", f"{word()}(at){word()}.net", f"{word()} (at) {word()} (dot) org", f"{word()}é@{word()}.fr"])
        cue = rng.choice(["", "", "mail: "])
    elif kind == 1:
        span = ip(255)
        cue = rng.choice(["", "", "ip ", "host "])
    elif kind == 2:
        span = card(True)
        cue = rng.choice(["", "", "card: ", "visa "])
    elif kind == 3:
        span = rng.choice([f"+1 ({area}) {mid}-{end}", f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"+44 20 {d(4)} {d(4)}", f"1-{area}-{mid}-{end}"])
        cue = rng.choice(["", "", "phone: ", "tel ", "call "])
    else:
        span = rng.choice([f"20{d(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"{d(1)}.{d(1)}.{d(2)}", card(False), d(rng.randint(5, 13)), d(20), "0x" + d(16), f"{d(4)}e{d(12)}", f"{word()}{d(10)}", f"{d(3)}.{d(3)}.{d(3)}", ".".join(str(rng.randint(256, 999)) for _ in range(4)), f"{word()} at {word()} dot", f"{word()}@{word()}", f"{d(4)}-{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(5)} {d(5)}", f"{d(8)}-{d(4)}-{d(4)}-{d(4)}", f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(2)}:{d(2)}:{d(2)} {d(4)}", f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(2)}"])
    head = " ".join(word() for _ in range(rng.randint(1, 5))) + " " + cue
    tail = rng.choice([" ", ". ", ", "]) + " ".join(word() for _ in range(rng.randint(1, 4)))
    return head + span + tail, [] if kind is None else [(len(head), len(head) + len(span), kind)]


def train(snippets: list[str] = (), made: int = 500, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Weights (features x kinds) from generated texts and from snippets labelled by the rules."""
    rng = random.Random(seed)
    work = []
    for text, spans in [_made(rng) for _ in range(made)] + [(t, base_spans(t)) for t in snippets]:
        for lo, hi in regions(text):
            tokens, found, rows = segments(text, lo, hi)
            if found:
                at = {s: i for i, (s, _) in enumerate(tokens)} | {tokens[-1][1]: len(tokens)}
                gold: dict[tuple[int, int], int] = {}
                free = 0
                for s, e, k in spans:
                    if s >= free and s in at and e in at:
                        gold[at[s], at[e]] = k
                        free = e
                edges = np.unique(found, return_inverse=True)[1].reshape(-1, 2)
                work.append((edges, rows, np.array([gold.get(x, -1) for x in found])))
    weights = np.zeros((WIDTH, len(KINDS)))
    step = np.full_like(weights, 1e-6)
    for _ in range(rounds):
        rng.shuffle(work)
        for one in work:
            g = gradient(*one[:2], weights, one[2]) - 1e-3 * weights
            step += g * g
            weights += 0.5 * g / np.sqrt(step)
    return weights


_BEFORE = re.compile(r"[\w.%+-]")
_MORE = re.compile(r"[\w-]*(?:\.[\w-]+|\s?[\[(]\s?(?:dot|DOT|Dot)\s?[\])]\s?[\w-]+)*")


def extended(text: str, s: int, e: int, kind: int) -> tuple[int, int]:
    """The run that a chosen span is a part of."""
    if kind == 0:
        while s > 0 and _BEFORE.match(text[s - 1]):
            s -= 1
        while text[s] in ".%+-" and s < e - 1:
            s += 1
        return s, _MORE.match(text, e).end()
    while s > 0 and text[s].isdigit() and text[s - 1] in "0123456789":
        s -= 1
    while e < len(text) and text[e - 1].isdigit() and text[e] in "0123456789":
        e += 1
    return s, e


def model_spans(text: str, weights: list[list[float]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the model finds besides the rules' spans, both in ascending order."""
    out: list[tuple[int, int, int]] = []
    at, reach = 0, -1
    for lo, hi in regions(text):
        for s, e, k in decode(text, lo, hi, weights):
            if out and e <= out[-1][1]:
                continue
            s, e = extended(text, s, e, k)
            #: Rules' spans that start before the end of this one; the furthest of them tells whether any meets it.
            while at < len(base) and base[at][0] < e:
                reach = max(reach, base[at][1])
                at += 1
            if reach > s:
                continue
            if out and s < out[-1][1]:
                if e > out[-1][1]:
                    out[-1] = (out[-1][0], e, out[-1][2])
                continue
            out.append((s, e, k))
    return out


def all_spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The rules' spans, and these with the model's."""
    if not _SOME.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + model_spans(text, weights.tolist(), base), key=lambda x: (x[0], x[2], x[1]))


def fit(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trains on SAMPLE snippets of the corpus, chosen by a hash of the text, and on generated ones."""
    ahead = F.length(F.regexp_extract(F.col(text), r"\A[^0-9@]*+", 0))
    snippet = F.substring(F.col(text), F.greatest(ahead - SNIPPET // 2, F.lit(0)) + 1, F.lit(SNIPPET))
    some = docs.filter(F.col(text).rlike("[0-9@]")).select(F.xxhash64(text).alias("h"), snippet.alias("t"))
    most = some.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    taken = some.filter(F.col("h") <= most).orderBy("h").limit(SAMPLE).collect() if most is not None else []
    return train(sorted({r["t"] for r in taken}))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_<kind> and base_sha256 of the rules' spans, and ``spans``: all, the model's with them.  No shuffle."""
    cols = docs.select(F.col(key), F.col(text).alias("_text"))
    schema = cols.select(F.col(key), *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS], F.lit("").alias("base_sha256"), F.lit("").alias("spans")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t.as_py() or "", weights) for t in batch.column(1)]
            counts = [pa.array([sum(x[2] == k for x in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))]
            sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([joined(a) for _, a in found], pa.string())], names=schema.names)

    return cols.mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs with every span in ``text`` replaced by its kind in brackets; null texts stay null.  No shuffle."""
    at, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if (t := x.as_py()) is None else redacted(t, all_spans(t, weights)[1]) for x in batch.column(at)]
            yield batch.set_column(at, text, pa.array(new, batch.column(at).type))

    return docs.mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
