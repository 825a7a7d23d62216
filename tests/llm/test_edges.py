"""The pipeline and operators on tables that hold nothing, or the same row many times, or no ids."""

import pytest

from tidemark.llm import fingerprints, mixing, simhash, substrings

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, at, rows):
    """A data folder with the given documents, and labels and benchmark of the smallest scale."""
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline as cp

    got = cp.run(spark, folder(spark, tmp_path / "none", []))
    assert got.count() == 0 and {"doc_id", "size", "taken"} <= set(got.columns)


def test_pipeline_of_nulls_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline as cp

    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text, None, None, None)] * 5 + [(7, text, "en", "a", 1)] * 5 + [(8, None, None, "b", None), (9, "", "en", "b", 0), (None, None, None, None, None)]
    at = folder(spark, tmp_path / "odd", rows)
    kept = [r["doc_id"] for r in cp.distinct(spark, spark.read.parquet(f"{at}/documents.parquet"), at).collect()]
    assert sorted(kept) == [7, 8]  # one of the text, the least id; one of the texts without words
    assert {r["doc_id"] for r in cp.run(spark, at).collect()} <= {7}


@pytest.mark.parametrize("partitions", [1, 7])
def test_identical_rows_of_one_or_many_partitions(spark, partitions):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "en", "a", 0)] * 300 + [(2, text + " end", "en", "a", 0)], SCHEMA).repartition(partitions)
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.within(docs.select("doc_id", "text")).collect()} == {(1, 40, 40), (2, 41, 40)}
    prints = {(r["doc_id"], r["fingerprint"]) for r in fingerprints.edit_report(docs).collect()}
    assert len(prints) == 2 and fingerprints.edit_report(docs).count() == 301
    p = simhash.fingerprints(docs)
    assert {(r["doc_id"], r["component_id"]) for r in simhash.label(p, simhash.link(p.select("fp").distinct())).filter("doc_id = 1").collect()} == {(1, 1)}
    assert mixing.mix(docs).count() == 301


def test_rows_without_ids(spark):
    rows = [(None, f"t{i % 3} of the words here", None, None, None) for i in range(60)] + [(4, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = fingerprints.edit_report(docs).collect()
    assert len(got) == 61 and len({r["fingerprint"] for r in got if r["doc_id"] is None}) == 3
    assert mixing.mix(docs).count() == 61 and simhash.near_copies(docs).count() == 4


def test_likenesses_of_the_query(spark):
    """near_edited and near_next of every document against the exact similarity of the shingle sets."""
    import re

    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: -r["doc_id"])
    texts = [r["text"] or "" for r in rows]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def alike(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    got = {r["doc_id"]: r for r in fingerprints.op3(spark, SF).collect()}
    apart = []
    for k, r in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(rows)]
        n, own = len(t) // 3, shingles(t)
        apart.append(got[r["doc_id"]]["near_edited"] - alike(own, shingles(t[: len(t) - n] + after[:n])))
        apart.append(got[r["doc_id"]]["near_next"] - alike(own, shingles(after)))
    #: 256 bins: a standard error of at most 0.032.
    assert len(got) == len(rows) and max(map(abs, apart)) < 0.16 and abs(sum(apart) / len(apart)) < 0.02
