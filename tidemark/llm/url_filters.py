"""URL filters: a cascade of Bloom filters that is exact over the corpus's own keys.

A rule is a host and a path prefix.  A url's candidate keys are the last k labels of its host for each label count k that
occurs in the rules, each followed by its path's first m characters for each path length m that occurs: every rule that
fits the url is among them, and there are no more than (label counts x path lengths) of them however long the url is.
The key universe is the set of all candidate keys of the corpus.  Level 1 of a cascade encodes the listed keys, level 2
the keys of the universe that level 1 passes wrongly, level 3 the listed keys that level 2 passes, and so on until a
level passes nothing wrongly; the first level that rejects a key decides.  Membership of every key of the corpus is then
exact, and judging a url is arithmetic on two small literals, with no join and no shuffle.

Level 1 lets through about as many wrong keys as are listed, later levels half of what they see, so the levels together
stay within some ten bits a listed key, and what returns to the driver is bounded by the rule list: the number of wrong keys
is checked before they are fetched.  The levels are literals of the plan; for more than ``MOST_RULES`` rules, where that
would not do, ``judge`` joins the distinct hosts and paths' candidate keys with the rules instead, with the same result.

Edge cases: a null url, or one without ``://``, has empty host and path and no rule; repeated rows give repeated results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames

MOST_RULES = 100_000
#: The contract's rules: verdict and host followed by path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def candidates(rules: Iterable[str], host: Column, path: Column) -> Column:
    """The candidate keys of a url, longest first; of equal length the one with the longer host first."""
    hosts, tails = zip(*((r[: r.index("/")], r[r.index("/") :]) for r in rules), strict=True)
    labels = F.size(F.split(host, r"\.", -1))
    keys = [
        F.when((labels >= k) & (F.length(path) >= m), F.struct((F.length(s := F.substring_index(host, ".", -k)) + m).alias("n"), F.length(s).alias("h"), F.concat(s, F.substring(path, 1, m)).alias("key")))
        for k in sorted({h.count(".") + 1 for h in hosts}) for m in sorted({len(t) for t in tails})
    ]
    return F.transform(F.reverse(F.array_sort(F.filter(F.array(*keys), lambda x: x.isNotNull()))), lambda x: x["key"])


class Cascade:
    """Levels of (bits, hashes, words of 64 bits)."""

    def __init__(self, listed: Iterable[str], universe: DataFrame, size: int, salt: str):
        """universe: distinct keys in column ``key``; size: their number."""
        self.salt, self.levels = salt, []
        inside = sorted(set(listed))
        if not inside:
            return
        own = universe.sparkSession.createDataFrame([(k,) for k in inside], "key string")
        most, rate = 10 * len(inside) + 1000, min(0.5, 0.7 * len(inside) / max(1, size))
        while True:
            self.levels = [self._level(inside, 0, rate)]
            wrong = universe.filter(self._passes(0, F.col("key"))).join(own, "key", "left_anti")
            found = [r["key"] for r in wrong.limit(most).collect()]
            if len(found) < most:
                break
            rate /= 1000
        encode, other = found, inside
        while encode:
            self.levels.append(self._level(encode, len(self.levels), 0.5))
            encode, other = [k for k in other if self._has(len(self.levels) - 1, k)], encode

    def _level(self, keys: list[str], at: int, rate: float) -> tuple[int, int, list[int]]:
        bits = max(64, 64 * math.ceil(1.44 * len(keys) * math.log2(1 / rate) / 64))
        hashes = max(1, round(math.log2(1 / rate)))
        words = [0] * (bits // 64)
        for k in keys:
            for j in range(hashes):
                p = self._place(at, j, k) % bits
                words[p // 64] |= 1 << (p % 64)
        return bits, hashes, [w - (1 << 64) if w >> 63 else w for w in words]

    def _place(self, at: int, j: int, key: str) -> int:
        h = xxhash.xxh64_intdigest(f"{self.salt}{at}:{j}:{key}".encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    def _has(self, at: int, key: str) -> bool:
        bits, hashes, words = self.levels[at]
        places = (self._place(at, j, key) % bits for j in range(hashes))
        return all(words[p // 64] >> (p % 64) & 1 for p in places)

    def _passes(self, at: int, key: Column) -> Column:
        bits, hashes, words = self.levels[at]
        table = F.lit(words) if len(words) > 1 else F.array(F.lit(words[0]).cast("long"))
        def one(j: int) -> Column:
            p = F.pmod(F.xxhash64(F.concat(F.lit(f"{self.salt}{at}:{j}:"), key)), F.lit(bits).cast("long"))
            return F.call_function("shiftright", F.element_at(table.cast("array<bigint>"), (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

        return reduce(lambda a, b: a & b, [one(j) for j in range(hashes)])

    def __contains__(self, key: str) -> bool:
        """For keys of the universe."""
        for at in range(len(self.levels)):
            if not self._has(at, key):
                return at % 2 == 1
        return len(self.levels) % 2 == 1

    def contains(self, key: Column) -> Column:
        """For keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for at in reversed(range(len(self.levels))):
            out = F.when(self._passes(at, key), out).otherwise(at % 2 == 1)
        return out


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (the longest fitting, else null) and verdict (the rule's, else ``default``) added;
    columns of those names are replaced.  Reads the url column once to learn the key universe, which is kept in the checkpoint
    folder, and once to judge."""
    rules = list(rules)
    base = pages.drop("host", "path", "rule", "verdict")
    host, path = parse(url)
    named = base.withColumns({"host": host, "path": path})
    if not rules:
        return named.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = candidates([r for _, r in rules], F.col("host"), F.col("path"))
    if len(rules) > MOST_RULES:
        return _joined(named, keys, rules, default)
    universe = frames.cut(named.select(F.explode(keys).alias("key")).distinct())
    size = universe.count()
    lists = {v: Cascade([r for w, r in rules if w == v], universe, size, v) for v in ("block", "allow")}
    judged = F.transform(keys, lambda k: F.struct(k.alias("rule"), F.when(lists["block"].contains(k), "block").when(lists["allow"].contains(k), "allow").alias("verdict")))
    hit = F.get(F.filter(judged, lambda x: x["verdict"].isNotNull()), F.lit(0))
    name = frames.apart(named, "_hit")
    return named.withColumn(name, hit).withColumns({"rule": F.col(f"{name}.rule"), "verdict": F.coalesce(f"{name}.verdict", F.lit(default))}).drop(name)


def _joined(named: DataFrame, keys: Column, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """The same by joins: of a host and path's candidate keys that are rules, the first.  A rule on both lists blocks."""
    listed = named.sparkSession.createDataFrame(sorted({(r, v) for v, r in rules}), "key string, verdict string").groupBy("key").agg(F.max("verdict").alias("verdict"))
    found = named.select("host", "path").distinct().select("host", "path", F.posexplode(keys).alias("at", "key")).join(listed, "key")
    first = found.groupBy("host", "path").agg(F.min(F.struct("at", F.col("key").alias("rule"), "verdict")).alias("x"))
    first = first.select("host", "path", F.col("x.rule").alias("rule"), F.col("x.verdict").alias("verdict"))
    return named.join(first, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default))).select(*named.columns, "rule", "verdict")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(frames.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


SQL7 = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM cut),
named AS (SELECT page_id, host, path, CASE
  WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM named
"""
