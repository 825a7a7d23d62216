"""Fill-in-the-middle transformation by DuckDB SQL over Arrow batches, inside ``mapInArrow``.

A text is cut at two places into prefix, middle and suffix, which are put in the order prefix, suffix, middle (``psm``) or
suffix, prefix, middle (``spm``) behind their marks, or left as it is (``plain``).  Which, and where, is read from the SHA-256
of ``1:`` and the row's id, so reruns agree and rows of one id are cut alike.  Each batch is registered as a table of an
in-memory DuckDB of one thread; ``regexp_extract_all`` takes the text apart into runs of ``RUN`` code points (the last one
shorter), ``list_slice`` and ``array_to_string`` put whole runs together and the run that a cut falls into is cut.  No row is
touched by Python.  Batches are registered in slices of ``AT_ONCE`` bytes of text or one row, which bounds the memory.

Edge cases: a null text is empty, and an empty one plain; a null id counts as the empty string, so those rows are cut at the
same shares; repeated rows give repeated results; texts that hold a mark are plain, so what is restored is exact; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, kernel

RUN = 64
AT_ONCE = 1 << 21
SEED = 1
PLAIN, SPM = 10, 20

_SQL = """
WITH t AS (SELECT id, seq, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(id, '')) AS h FROM batch),
c AS (SELECT *, regexp_extract_all(text, '(?s).{{1,{run}}}') AS runs, length(text) AS n FROM t),
k AS (SELECT *, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM c),
p AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 - {plain} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM k),
d AS (SELECT id, seq, text, form, n, a, b, a // {run} AS i, b // {run} AS j, runs FROM p),
s AS (SELECT id, seq, text, form, n, a, b,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(runs, 1, i), '') || left(coalesce(runs[i + 1], ''), a % {run}) END AS prefix,
  CASE WHEN form <> 'plain' THEN CASE WHEN i = j THEN substring(coalesce(runs[i + 1], ''), a % {run} + 1, b - a) ELSE substring(coalesce(runs[i + 1], ''), a % {run} + 1) || array_to_string(list_slice(runs, i + 2, j), '') || left(coalesce(runs[j + 1], ''), b % {run}) END END AS middle,
  CASE WHEN form <> 'plain' THEN substring(coalesce(runs[j + 1], ''), b % {run} + 1) || array_to_string(list_slice(runs, j + 2, len(runs)), '') END AS suffix FROM d),
o AS (SELECT seq, form, n, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM s)
"""
#: The pieces of an output between its marks, in the order of the text.
RESTORED = "CASE form WHEN 'plain' THEN {output} WHEN 'psm' THEN string_split_regex({output}, '<[PSM]>')[2] || string_split_regex({output}, '<[PSM]>')[4] || string_split_regex({output}, '<[PSM]>')[3] ELSE string_split_regex({output}, '<[PSM]>')[3] || string_split_regex({output}, '<[PSM]>')[4] || string_split_regex({output}, '<[PSM]>')[2] END"


def _batches(df: DataFrame, schema: str, select: str, text_column: str) -> DataFrame:
    """select over every slice of df's batches, as table ``batch``, in the order of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as db:
            for whole in batches:
                for batch in kernel.slices(whole, text_column, AT_ONCE):
                    numbered = pa.Table.from_batches([batch]).append_column("seq", pa.array(range(batch.num_rows), pa.int64()))
                    db.register("batch", numbered)
                    found = db.sql(select).to_arrow_table()
                    db.unregister("batch")
                    out = numbered.select([c for c in numbered.column_names if c.startswith("keep_")])
                    for name in found.column_names:
                        out = out.append_column(name, found.column(name))
                    yield from out.combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def transform(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, spm: int = SPM, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars and ``output``; if digests, output_sha256 and restored_sha256 (of the text
    rebuilt from the output) instead of the output.  plain and spm: how many of a hundred rows are left plain, and how many of
    the rest are spm."""
    base = docs.select(F.col(key).alias("keep_key"), F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    kind = base.schema["keep_key"].dataType.simpleString()
    last = f"sha256(output) AS output_sha256, sha256({RESTORED.format(output='output')}) AS restored_sha256" if digests else "output"
    select = _SQL.format(seed=int(seed), run=RUN, plain=int(plain), spm=int(spm)) + f"SELECT n::BIGINT AS n, form, prefix_chars::BIGINT AS prefix_chars, middle_chars::BIGINT AS middle_chars, {last} FROM o ORDER BY seq"
    schema = f"keep_key {kind}, n long, form string, prefix_chars long, middle_chars long, " + ("output_sha256 string, restored_sha256 string" if digests else "output string")
    return _batches(base, schema, select, "text").withColumnRenamed("keep_key", key)


def restore(outputs: DataFrame, key: str = "doc_id", output: str = "output", form: str = "form") -> DataFrame:
    """key and ``text``, rebuilt from output and form; null where one of them is."""
    base = outputs.select(F.col(key).alias("keep_key"), F.col(output).alias("output"), F.col(form).alias("form"))
    kind = base.schema["keep_key"].dataType.simpleString()
    return _batches(base, f"keep_key {kind}, text string", f"SELECT {RESTORED.format(output='output')} AS text FROM batch ORDER BY seq", "output").withColumnRenamed("keep_key", key)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(frames.table(spark, sf_dir, "documents"), digests=True)


SQL12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::UBIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::UBIGINT % (n + 1) AS y, ('0x' || substr(h, 17, 8))::UBIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(x, y)::BIGINT AS a, greatest(x, y)::BIGINT AS b, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a) ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256 FROM f
"""
