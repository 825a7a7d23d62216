"""BPE, fill-in-the-middle and whitening against the library itself, plain Python and NumPy."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, fill_in_middle, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def odd_texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n, a=letters: "".join(rng.choice(a) for _ in range(n))
    return [
        None, "", " ", "one", "a  b   c\n\n d", "it's we're I'll don't", "x" * 900, "7" * 1000, "ab" * 700, "漢字" * 300, " " * 800, "\n" * 500 + "x", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoft" * 20, "aaa'r" + "'re" * 200, "é̀" * 200,
        "\U0001f600\U0001f468‍\U0001f469" * 150, "the " * 400, word(1200), " ".join(word(rng.randint(1, 12)) for _ in range(300)), word(700) + " " + word(900) + "  " + word(500, "01"), "\x00\x01\x85\xa0 " * 120, "=" * 333 + "-" * 444, "".join(chr(rng.randint(33, 0x2FFF)) for _ in range(1500)),
        "'" * 600, "'s" * 600, "".join(rng.choice(["'", "r", "e", "'re", " ", "1", "\t"]) for _ in range(1500)), "՘࢏" * 400,
    ]


@pytest.mark.parametrize("piece", [7, 32, 100, 1 << 15])
def test_op11_cuts_and_joins(library, piece):
    coder = bpe.tokenizer(PATH)
    for t in odd_texts():
        t = t or ""
        assert "".join(p for *_, p in coder.pieces(t, piece)) == t
        assert bpe.encode(t, PATH, piece) == library.encode(t, add_special_tokens=False).ids, (piece, t[:40])


def test_op11_joins_of_words(library):
    """Any word, cut anywhere: also where merges reach far across the cut."""
    rng, coder = random.Random(3), bpe.tokenizer(PATH)
    vocabulary = [t for t in coder.token if t.isascii() and t.isalpha()]
    for _ in range(3000):
        a = rng.choice(["ab", "a", "the", "abcdefghij", "etaoinshr"])
        w = "".join(rng.choice(vocabulary if rng.random() < 0.5 else a) for _ in range(rng.randint(1, 60)))
        cuts = sorted(rng.randint(0, len(w)) for _ in range(rng.randint(1, 6)))
        parts = [coder.part(w[i:j]) for i, j in zip([0, *cuts], [*cuts, len(w)], strict=True)]
        assert coder.tree(parts) == coder.part(w) == library.encode(w, add_special_tokens=False).ids


def brute11(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


@pytest.mark.parametrize("piece", [40, 1 << 15])
def test_op11_table(spark, library, piece):
    """Rows with null and repeated ids, copies of long texts and columns of the names used inside."""
    rows = list(enumerate(odd_texts()))
    rows += [(None, "x" * 900), (None, None), (3, rows[3][1]), (7, rows[7][1]), (100, rows[7][1])] * 2
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumns({n: F.lit("x") for n in ("_hash", "_run", "_key", "_text", "n_tokens", "ids")}).repartition(3)
    got = bpe.encoded(d, PATH, keep=True, most=piece)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    found = got.collect()
    assert sorted([tuple(r)[:4] for r in found], key=str) == brute11(library, rows)
    back = {(r["doc_id"], r["text"]) for r in bpe.decoded(got, PATH).collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert bpe.encoded(d.limit(0), PATH).collect() == []


def test_op11_long_texts_on_the_cluster(spark, library):
    """Texts beyond PIECE: pieces dealt out, parts of one word joined up the tree; copies under several ids."""
    rng = random.Random(1)
    long = ["x" * 200_000, "".join(rng.choice("abcdefgh") for _ in range(150_000)), "some words " * 9_000, "7" * 70_000 + " and " + "漢" * 40_000 + "<|endoftext|>" + " " * 50_000 + "end"]
    rows = [(i, t) for i, t in enumerate(long)] + [(10, long[0]), (None, long[1]), (0, long[0]), (11, "short"), (12, None)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    assert sorted([tuple(r) for r in bpe.encoded(d, PATH).collect()], key=str) == brute11(library, rows)


def test_op11_refuses_other_kinds():
    with pytest.raises(ValueError):
        bpe.Coder(public_tokenizers.path("word_bpe_49k.json"))


def brute12(i, text, seed=1, plain=10, spm=20):
    t, h = text or "", hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - plain:
        return len(t), "plain", None, None, t
    if h4 % 100 < spm:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_op12(spark):
    rng = random.Random(2)
    texts = odd_texts() + ["<P> in a text", "almost <S", "<", "<<<S", "P>", "<M", "x<P"] + ["".join(rng.choice("ab<>PSM\né\U0001f600") for _ in range(n)) for n in (*range(1, 140), 1000, 4096)]
    rows = list(enumerate(texts)) * 2 + [(None, "no id here"), (None, None), (2**62, "big"), (-5, "negative")]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumns({n: F.lit("x") for n in ("seq", "id", "keep_key", "form", "output")}).repartition(3)
    want = sorted([(i, *brute12(i, t)) for i, t in rows], key=str)
    out = fill_in_middle.transform(d)
    assert sorted([tuple(r) for r in out.collect()], key=str) == want
    assert {"plain", "psm", "spm"} == {r[2] for r in want}
    assert sorted([tuple(r) for r in fill_in_middle.restore(out).collect()], key=str) == sorted([(i, t or "") for i, t in rows], key=str)
    got = fill_in_middle.transform(d, digests=True)
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted([(*r[:5], sha(r[5]), sha(t or "")) for r, t in ((((i, *brute12(i, t))), t) for i, t in rows)], key=str)
    assert got.filter("false").count() == 0 and fill_in_middle.transform(d.limit(0)).collect() == []
    other = fill_in_middle.transform(d, seed=7, plain=50, spm=90)
    assert sorted([tuple(r) for r in other.collect()], key=str) == sorted([(i, *brute12(i, t, 7, 50, 90)) for i, t in rows], key=str)


def test_op12_very_long_text(spark):
    long = "déjà vu \U0001f600 " * 400_000
    d = spark.createDataFrame([(1, long), (3, "short"), (4, "x" * 3_000_000)], "doc_id long, text string").repartition(1)
    texts = {1: long, 3: "short", 4: "x" * 3_000_000}
    for r in fill_in_middle.transform(d, digests=True).collect():
        n, form, a, b, out = brute12(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r)[1:] == (n, form, a, b, sha(out), sha(texts[r["doc_id"]]))


def brute13(rows, most=8):
    """By NumPy's solver of symmetric matrices; deviations in whole numbers of any size."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in good], dtype=object)
    n, s = len(x), x.sum(axis=0)
    dev = ((n * x - s) ** 2).sum(axis=1)
    means = np.array([int(t) / n for t in s])
    centred = x.astype(float) - means
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    total = float(sum(dev)) / n**3
    return [i for i, _ in good], n, dev, centred @ v / np.sqrt(e), e / total


def test_op13(spark):
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(300, 12)) * np.array([9, 7, 5, 4, 3, 2.5, 2, 1.5, 1, 0.7, 0.5, 0.2]) @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + 3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]
    rows += [(1, rows[1][1]), (None, rows[2][1]), (900, None), (901, [1.0] * 11 + [None]), (902, [1.0] * 11 + [math.nan]), (903, [1.0] * 11 + [math.inf]), (904, [-math.inf] + [1.0] * 11)]
    d = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("x", "n", "component", "_key", "w")}).repartition(4)
    found = whitening.whiten(d)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = found.collect()
    ids, n, dev, w, explained = brute13(rows)
    assert len(got) == 8 * n == 8 * 302 and {r["n"] for r in got} == {n}
    want = {}
    for k, i in enumerate(ids):
        want.setdefault(i, []).append((int(dev[k]), w[k]))
    for c in range(8):
        mine = [r for r in got if r["component"] == c + 1]
        some = next(r for r in mine if r["vec_id"] == 0)
        sign = np.sign(some["whitened"] * want[0][0][1][c])
        for r in mine:
            assert r["deviation"] == want[r["vec_id"]][0][0] and abs(r["whitened"] - sign * want[r["vec_id"]][0][1][c]) < 1e-9
            assert abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_op13_edges(spark):
    schema = "vec_id long, embedding array<float>"
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert make([]) == [] and make([(1, None)]) == [] and make([(1, [1.0, 2.0])]) == [] and make([(1, [1.0, 2.0])] * 5) == [] and make([(1, [])]) == []
    two = make([(1, [1.0, 5.0]), (2, [3.0, 5.0]), (3, [5.0]), (4, []), (5, [1e30, 1.0])])
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 12), round(r["explained"], 12)) for r in two] == [(1, 1, 2, 2048**2, 1.0, 1.0), (2, 1, 2, 2048**2, 1.0, 1.0)]
    #: A deviation beyond a long is null, and the shares are right all the same.
    wide = make([(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0])])
    assert {r["deviation"] for r in wide if r["vec_id"] == 1} == {None} and abs(max(r["explained"] for r in wide) - 1) < 1e-9 and len(wide) in (4, 8)
