"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item is cut into windows of ``WINDOW`` consecutive words (one window of all its words if it has fewer).  The tokens of the
join are shingles of ``SHINGLE`` words (of all words, in a shorter window).  A document contains a window only if it contains
all of the window's shingles, so with these ordered by rarity in the whole corpus a prefix of one is necessary: the rarest.
The places of the benchmark's shingles in the documents are found once; they give the counts and, joined with the rarest
shingles, the candidates.  The positional bound puts the window's start at the shingle's place less its offset, the length
bound asks that the window fits into the document from there, and the words of that item-sized window are then compared
exactly.

What is shuffled is (document, window number, starts): a window's text meets a document once, however often it occurs, and its
items only after the comparison, once for each set of windows that occur together.  So a window of common words costs its
occurrences, and one that many items share costs the same as any other.

Words are runs of ``[0-9A-Za-z]`` and code points from 0x80, with A-Z lower-cased.  Shingles are hashed in full lower case
(with one form of the sigma, whose lower case depends on what follows), which can only add candidates; the comparison uses A-Z
alone.  Documents are matched by the SHA-256 of id and text.  A side is broadcast if it has no more than ``MOST_BYTES``, else
joined by shuffle; where few documents have candidates no text is shuffled at all.

Edge cases: null texts have no words; an item without words has no window; a null item_id is the item ``null``; repeated
rows, of either side, give repeated results or the same items; columns other than id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames

WINDOW, SHINGLE = 10, 5
MOST_BYTES = 8 << 20
#: What separates words, before A-Z are lower-cased.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HITS = "array<struct<window:bigint,n:int,starts:array<int>>>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), APART), "")


def folded(text: Column) -> Column:
    """Full lower case that is the same for a text and for its words."""
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def shingled(rows: DataFrame, w: str, size: int, *keep: str) -> DataFrame:
    """keep, ``at`` and ``token``, the hash of ``size`` words from there on, of every place of the array of words w."""
    last = F.size(w) - size + 1
    runs = F.arrays_zip(*[F.slice(w, i + 1, F.greatest(last, F.lit(0))).alias(f"w{i}") for i in range(size)])
    return rows.filter(last > 0).select(*keep, F.posexplode(runs).alias("at", "run")).select(*keep, "at", F.xxhash64(F.lit(size), *[F.col(f"run.w{i}") for i in range(size)]).alias("token"))


def windows(items: DataFrame, size: int = WINDOW, key: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows of all items (window, win: exact words, space-joined, n), and the items of each (window, item)."""
    named = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), words(F.translate(F.col(text), UPPER, LOWER)).alias("w"))
    named = named.filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(size)))
    cut = named.select("item", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda s: F.concat_ws(" ", F.slice("w", s, F.col("n"))))).alias("win"))
    pairs = frames.cut(cut.distinct())
    #: Numbers that a rerun would give otherwise, so they are written before they are used.
    numbered = frames.cut(pairs.select("win", "n").distinct().withColumn("window", F.monotonically_increasing_id()))
    return numbered, pairs.join(numbered, ["win", "n"]).select("window", "item")


def _fits(df: DataFrame, text: str | None = None) -> bool:
    """Rows count 64 bytes, and the text in one column as long as it is."""
    return (df.agg(F.sum(F.lit(64) + (F.length(text) if text else 0))).first()[0] or 0) <= MOST_BYTES


def _small(df: DataFrame, text: str | None = None) -> DataFrame:
    """A broadcast hint where the size allows it."""
    return F.broadcast(df) if _fits(df, text) else df


def candidates(docs: DataFrame, found: DataFrame, key: Column, text: str = "text") -> DataFrame:
    """_k, window, n and starts of every window whose rarest shingle stands where the window would fit."""
    w = found.withColumn("w", F.split(folded(F.col("win")), " "))
    sizes = [r["s"] for r in w.select(F.least("n", F.lit(SHINGLE)).alias("s")).distinct().collect()]
    if not sizes:
        return docs.sparkSession.createDataFrame([], "_k string, window long, n int, starts array<int>")
    base = docs.select(key.alias("_k"), words(folded(F.col(text))).alias("_w")).withColumn("_n", F.size("_w"))
    whole = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(whole(parts[1:]))
    tokens = frames.cut(whole([shingled(w.filter(F.least("n", F.lit(SHINGLE)) == s), "w", s, "window", "n") for s in sizes]))
    vocabulary = frames.cut(tokens.select("token").distinct())
    places = frames.cut(whole([shingled(base, "_w", s, "_k", "_n") for s in sizes]).join(_small(vocabulary), "token"))
    counts = places.groupBy("token").count()
    #: A window with a shingle that no document has occurs nowhere.
    ranked = tokens.join(counts, "token", "left").groupBy("window", "n").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token", F.col("at").alias("place"))).alias("x")).filter("x.count > 0")
    first = frames.cut(ranked.select("window", "n", "x.token", "x.place"))
    at = places.join(_small(first), "token").withColumn("start", F.col("at") - F.col("place")).filter("start >= 0 AND start + n <= _n")
    return at.groupBy("_k", "window", "n").agg(F.collect_set("start").alias("starts"))


def located(docs: DataFrame, found: DataFrame, text: str = "text", id: str = "doc_id", n_words: str = "n_words", hits: str = "hits") -> DataFrame:
    """docs with ``n_words`` and ``hits``: (window, n, starts) of each window that occurs.  found: as ``windows`` gives."""
    base = docs.drop(n_words, hits)
    mark, kept = frames.apart(base, "_k"), frames.apart(base, "_found")
    key = F.sha2(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))), 256)
    some = candidates(docs, found, key, text).join(_small(found, "win"), ["window", "n"])
    some = frames.cut(some.groupBy(F.col("_k").alias(mark)).agg(F.collect_list(F.struct("window", "n", "win", "starts")).alias(kept)))
    size = some.select(F.aggregate(kept, F.lit(128), lambda a, c: a + F.length(c["win"]) + 32 + 4 * F.size(c["starts"])).cast("long").alias("b")).agg(F.sum("b")).first()[0] or 0
    keyed, names = base.withColumn(mark, key), some.select(mark)
    if size <= MOST_BYTES:
        whole = keyed.join(F.broadcast(some), mark, "left")
    elif _fits(names):
        #: Only texts with candidates are shuffled; the others meet their keys alone.
        clean = keyed.join(F.broadcast(names), mark, "left_anti").withColumn(kept, F.lit(None).cast(some.schema[kept].dataType))
        whole = clean.unionByName(keyed.join(F.broadcast(names), mark, "left_semi").join(some, mark))
    else:
        whole = keyed.join(some, mark, "left")

    def verified(w: Column) -> Column:
        """w is bound once a row; as a column it would be split again for every candidate."""
        same = lambda c: F.filter(c["starts"], lambda s: F.concat_ws(" ", F.slice(w, s + 1, c["n"])) == c["win"])
        return F.filter(F.transform(F.col(kept), lambda c: F.struct(c["window"].alias("window"), c["n"].alias("n"), F.array_sort(same(c)).alias("starts"))), lambda c: F.size(c["starts"]) > 0)

    exact = words(F.translate(F.col(text), UPPER, LOWER))
    verdict = F.when(F.col(kept).isNotNull(), F.get(F.transform(F.array(exact), verified), F.lit(0))).otherwise(F.array().cast(HITS))
    return whole.select(*[F.col(c) for c in base.columns], F.size(words(F.col(text))).cast("long").alias(n_words), verdict.alias(hits))


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, text: str = "text", id: str = "doc_id", n_words: str = "n_words", hits: str = "hits") -> DataFrame:
    """docs with ``n_words`` and ``hits``; columns of these names, which the caller may choose, are replaced."""
    return located(docs, windows(items, size)[0], text, id, n_words, hits)


def report(docs: DataFrame, items: DataFrame, size: int = WINDOW, id: str = "doc_id") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    found, members = windows(items, size)
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.flatten(F.transform(h["starts"], lambda s: F.sequence(s, s + h["n"] - 1))))))
    own = located(docs.select(id, "text"), found, id=id).select(id, "n_words", F.size(places).cast("long").alias("n_hit"), F.array_sort(F.transform("hits", lambda h: h["window"])).alias("_windows"))
    own = frames.cut(own)
    clean = own.filter("n_hit = 0").select(id, "n_words", "n_hit", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    #: Documents of the same windows share their items.
    hit = own.filter("n_hit > 0")
    listed = hit.select("_windows").distinct().select("_windows", F.explode("_windows").alias("window")).join(_small(members), "window").groupBy("_windows").agg(F.array_sort(F.collect_set("item")).alias("i"))
    listed = frames.cut(listed.select("_windows", F.size("i").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "i"), 256).alias("items_sha256")))
    size_ = listed.select((F.size("_windows") * 8 + 128).cast("long").alias("b")).agg(F.sum("b")).first()[0] or 0
    named = hit.join(F.broadcast(listed) if size_ <= MOST_BYTES else listed, "_windows")
    return clean.unionByName(named.select(id, "n_words", "n_hit", "n_items", "items_sha256", F.lit(True).alias("contaminated")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "benchmark"))


SQL10 = r"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM bn)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, s, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT r, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM h) GROUP BY r),
i AS (SELECT r, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN i USING (r)
"""
