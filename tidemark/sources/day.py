"""Binary day files as a data source, ``spark.read.format("dayfile")`` and ``spark.readStream.format("dayfile")``.

    day.register(spark)
    spark.read.format("dayfile").load("/shared/vipdoc").filter("symbol = 'SH600519'")

A file is read by many tasks, a range of whole records each (option ``records``, 262144 by default); conditions on the symbol, equal
to one or one of a list, leave out the files of others.  As a stream, files are taken in the order of their time and name; one
that appears with an earlier time than the last that was taken is not seen, and a file must be there whole.  Files are reached
through Arrow's file systems (a path, ``file://``, ``hdfs://``, ``s3://``), not through the machine's own.  A file whose size is
no multiple of 32 bytes is an error, names that are no day file's are left out, and so are records before 1990.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from .files import DAY_RECORD, FIRST_DAY, to_day_records

SCHEMA = "symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double, turnover double"
RECORDS = 1 << 18
_NAME = re.compile(r"(?i)(?:^|/)(sh|sz|bj)(\d{6})\.day$")


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    path: str
    symbol: str
    start: int
    size: int


def _files(folder: str) -> list[tuple[int, str, str, int]]:
    """(time, path, symbol, bytes) of the day files below a folder, or of one file."""
    from pyarrow import fs

    system, at = _at(folder)
    info = system.get_file_info(at)
    found = system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
    return sorted((f.mtime_ns or 0, f.path, (m[1] + m[2]).upper(), f.size) for f in found if f.type == fs.FileType.File and (m := _NAME.search(f.path)))


def _parts(files: list[tuple[int, str, str, int]], records: int) -> list[Part]:
    step, out = records * DAY_RECORD.itemsize, []
    for _, path, symbol, size in files:
        if size % DAY_RECORD.itemsize:
            raise ValueError(f"{path}: {size} bytes are no whole number of records")
        out += [Part(path, symbol, a, min(step, size - a)) for a in range(0, size, step)]
    return out


def _batch(folder: str, part: Part) -> pa.RecordBatch:
    with _at(folder)[0].open_input_file(part.path) as f:
        f.seek(part.start)
        r = np.frombuffer(f.read(part.size), DAY_RECORD)
    r = r[r["date"] >= FIRST_DAY]
    y, m, d = (r["date"] // 10000).astype("int64"), (r["date"] // 100 % 100).astype("int64"), (r["date"] % 100).astype("int64")
    first = ((y - 1970) * 12 + m - 1).astype("datetime64[M]")
    days = first.astype("datetime64[D]") + (d - 1)
    good = (m >= 1) & (m <= 12) & (d >= 1) & (days.astype("datetime64[M]") == first)
    r, days = r[good], days[good]
    values = [pa.array(r[k] / 100.0) for k in ("open", "high", "low", "close")] + [pa.array(r[k].astype(float)) for k in ("volume", "amount")]
    return pa.RecordBatch.from_arrays([pa.array([part.symbol] * len(r), pa.string()), pa.array(days, pa.date32()), *values, pa.nulls(len(r), pa.float64())], names=["symbol", "trade_date", "open", "high", "low", "close", "volume", "amount", "turnover"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.records, self.symbols = options["path"], int(options.get("records", RECORDS)), None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = own if self.symbols is None else self.symbols & own
            else:
                yield f

    def partitions(self) -> list[Part]:
        return _parts([f for f in _files(self.folder) if self.symbols is None or f[2] in self.symbols], self.records)

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition:  # None where there are no files
            yield _batch(self.folder, partition)


class _StreamReader(DataSourceStreamReader):
    """An offset is the time and path of the last file."""

    def __init__(self, options: dict):
        self.folder, self.records = options["path"], int(options.get("records", RECORDS))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _files(self.folder)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        lo, hi = ((o["time"], o["path"]) for o in (start, end))
        return _parts([f for f in _files(self.folder) if lo < f[:2] <= hi], self.records)

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition:  # None where there are no files
            yield _batch(self.folder, partition)


class DayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dayfile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DayFiles)


def write(bars: DataFrame, folder: str) -> int:
    """A day file for each symbol (``sh600519``) below a shared folder, written by the tasks; the number of files."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = _at(folder)
                system.create_dir(at, recursive=True)
                with system.open_output_stream(f"{at}/.{name}.part") as f:
                    f.write(content)
                system.move(f"{at}/.{name}.part", f"{at}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return to_day_records(bars).mapInArrow(put, "n long").agg({"n": "sum"}).first()[0] or 0
