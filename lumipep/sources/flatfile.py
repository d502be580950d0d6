"""Flat files of fixed-size little-endian numbers as a Spark data source, `flatfile`.

A table is one file or several side by side, each a column: row n of the table is entry n of each file. The option
`columns` says which (JSON, see `Column`). A reader's partition is a range of rows, of about PART_BYTES in all
columns: a file of any size is read by many tasks, and the first rows of a table are read without the others.

A writer's task puts its rows where their number says (row x bytes a row), so tasks write to one file at a time and a
task that is repeated writes the same bytes again. Files get a temporary name until all tasks are done; then their
rows are counted (every number from 0 on, once) and they are renamed. This takes a file system that can write
anywhere in a file, at a path that all executors share.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a reader's partition, and rows of an Arrow batch.
PART_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Types of numbers, and Spark's for them: unsigned ones are read as long.
KINDS = {"f4": "float", "f8": "double", "u4": "long", "i4": "int", "i8": "long"}


@dataclass(frozen=True)
class Column:
    """A file as a column: `width` numbers a row, as an array; with width 0 one number, by itself. When writing, {part} in the path stands for the value of the column that `by` names."""

    name: str
    path: str
    dtype: str
    width: int = 0

    @property
    def row_bytes(self) -> int:
        return np.dtype("<" + self.dtype).itemsize * max(1, self.width)

    @property
    def ddl(self) -> str:
        kind = KINDS[self.dtype]
        return f"`{self.name}` " + (f"array<{kind}>" if self.width else kind)

    def arrow(self, raw: bytes) -> pa.Array:
        a = np.frombuffer(raw, "<" + self.dtype)
        values = pa.array(a.astype(np.int64) if self.dtype == "u4" else a)
        if not self.width:
            return values
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(a) + 1, self.width, dtype=np.int32)), values)

    def raw(self, values: pa.Array) -> np.ndarray:
        """The bytes of a column, a row of the result for each of its rows."""
        if self.width:
            ends = values.offsets.to_numpy()
            if len(values) and (values.null_count or (np.diff(ends) != self.width).any()):
                raise ValueError(f"{self.name}: a row without {self.width} numbers")
            values = values.flatten()
        if values.null_count:
            raise ValueError(f"{self.name}: null has no form in a flat file")
        a = values.to_numpy(zero_copy_only=False)
        if self.dtype == "u4" and len(a) and (a.min() < 0 or a.max() >= 1 << 32):
            raise ValueError(f"{self.name}: {a.min()} to {a.max()} do not fit 32 bits without a sign")
        return np.ascontiguousarray(a.astype("<" + self.dtype)).view(np.uint8).reshape(-1, self.row_bytes)


def local(path: str) -> str | None:
    """The path in the mounted file system; None if it is in another one."""
    at = urlparse(path)
    return at.path if at.scheme == "file" else path if not at.scheme else None


def _source(path: str):
    """An open file with size(), seek() and read()."""
    from pyarrow import fs

    if (here := local(path)) is not None:
        return fs.LocalFileSystem().open_input_file(here)
    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


@dataclass
class Rows(InputPartition):
    first: int
    end: int


class FlatReader(DataSourceReader):
    def __init__(self, columns: list[Column], limit: int | None, part_bytes: int):
        self.columns, self.limit, self.part_bytes = columns, limit, part_bytes

    def rows(self) -> int:
        held = {}
        for c in self.columns:
            with _source(c.path) as f:
                n, rest = divmod(f.size(), c.row_bytes)
            if rest:
                raise ValueError(f"{c.path}: {n * c.row_bytes + rest} bytes are no whole rows of {max(1, c.width)} numbers")
            held[c.path] = n
        if len(set(held.values())) > 1:
            raise ValueError(f"files side by side differ in rows: {held}")
        n = next(iter(held.values()))
        return n if self.limit is None else min(n, self.limit)

    def partitions(self) -> list[Rows]:
        n, step = self.rows(), max(1, self.part_bytes // sum(c.row_bytes for c in self.columns))
        return [Rows(lo, min(lo + step, n)) for lo in range(0, n, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_BYTES // sum(c.row_bytes for c in self.columns))
        files = [_source(c.path) for c in self.columns]
        try:
            for f, c in zip(files, self.columns, strict=True):
                f.seek(partition.first * c.row_bytes)
            for lo in range(partition.first, partition.end, step):
                n = min(step, partition.end - lo)
                read = [c.arrow(f.read(n * c.row_bytes)) for f, c in zip(files, self.columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + n)), *read], ["row", *[c.name for c in self.columns]])
        finally:
            for f in files:
                f.close()


@dataclass
class Written(WriterCommitMessage):
    #: For each part: rows, and the lowest and highest number of one, and the sum of the numbers.
    parts: dict[str, tuple[int, int, int, int]]


class FlatWriter(DataSourceArrowWriter):
    def __init__(self, columns: list[Column], by: str | None, token: str):
        self.columns, self.by, self.token = columns, by, token
        for c in columns:
            if local(c.path) is None:
                raise ValueError(f"{c.path}: a flat file is written in a mounted file system only")

    def _paths(self, c: Column, part: str) -> tuple[str, str]:
        final = local(c.path).replace("{part}", part)
        return f"{os.path.dirname(final)}/.{os.path.basename(final)}.{self.token}", final

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        parts: dict[str, tuple[int, int, int, int]] = {}
        open_: dict[str, int] = {}
        try:
            for b in iterator:
                rows = b.column("row").to_numpy()
                labels = np.array(b.column(self.by).cast(pa.string()).to_pylist()) if self.by else np.full(len(rows), "")
                for part in dict.fromkeys(labels.tolist()):
                    mine = np.flatnonzero(labels == part)
                    order = mine[np.argsort(rows[mine], kind="stable")]
                    at = rows[order]
                    for c in self.columns:
                        path = self._paths(c, part)[0]
                        if path not in open_:
                            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                            open_[path] = os.open(path, os.O_WRONLY | os.O_CREAT, 0o644)
                        raw = c.raw(b.column(c.name))[order]
                        # Runs of consecutive rows are written at once.
                        edges = np.r_[0, np.flatnonzero(np.diff(at) != 1) + 1, len(at)]
                        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                            if hi > lo:
                                _put(open_[path], memoryview(raw[lo:hi].reshape(-1)), int(at[lo]) * c.row_bytes)
                    n, least, most, total = parts.get(part, (0, 1 << 62, -1, 0))
                    parts[part] = (n + len(at), min(least, int(at[0])), max(most, int(at[-1])), total + sum(at.tolist()))
            for fd in open_.values():
                os.fsync(fd)
        finally:
            for fd in open_.values():
                os.close(fd)
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        sums: dict[str, list[int]] = {}
        for m in messages:
            for part, (n, least, most, total) in (m.parts if m else {}).items():
                s = sums.setdefault(part, [0, 1 << 62, -1, 0])
                s[:] = [s[0] + n, min(s[1], least), max(s[2], most), s[3] + total]
        for part, (n, least, most, total) in sums.items():
            if least != 0 or most != n - 1 or total != n * (n - 1) // 2:
                raise ValueError(f"rows {part} are not numbered 0 to {n - 1}, each once")
        if not sums and not self.by:
            sums[""] = [0]
            for c in self.columns:
                os.makedirs(os.path.dirname(self._paths(c, "")[0]) or ".", exist_ok=True)
                open(self._paths(c, "")[0], "wb").close()
        for part in sums:
            for c in self.columns:
                hidden, final = self._paths(c, part)
                os.replace(hidden, final)

    def abort(self, messages: list[Written | None]) -> None:
        for c in self.columns:
            folder = os.path.dirname(local(c.path)) or "."
            for name in os.listdir(folder) if os.path.isdir(folder) else []:
                if name.endswith(f".{self.token}"):
                    os.unlink(f"{folder}/{name}")


def _put(fd: int, data: memoryview, at: int) -> None:
    while len(data):
        n = os.pwrite(fd, data, at)
        data, at = data[n:], at + n


class FlatFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flatfile"

    def _columns(self) -> list[Column]:
        return [Column(**c) for c in json.loads(self.options["columns"])]

    def schema(self) -> str:
        return ", ".join(["row long", *[c.ddl for c in self._columns()]])

    def reader(self, schema: StructType) -> FlatReader:
        limit = self.options.get("rows")
        return FlatReader(self._columns(), int(limit) if limit is not None else None, int(self.options.get("partBytes", PART_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> FlatWriter:
        return FlatWriter(self._columns(), self.options.get("by") or None, self.options["token"])


def _options(columns: list[Column]) -> str:
    return json.dumps([asdict(c) for c in columns])


def read_flat(spark: SparkSession, columns: list[Column], rows: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """row, and each file as a column; only the first `rows` rows if that is given."""
    spark.dataSource.register(FlatFiles)
    reader = spark.read.format("flatfile").option("columns", _options(columns)).option("partBytes", part_bytes)
    return (reader if rows is None else reader.option("rows", rows)).load()


def write_flat(df: DataFrame, columns: list[Column], by: str | None = None) -> None:
    """Writes df's columns of these names to their files, each row where its `row` (0, 1, 2 ...) says; with `by`, to the files of its value, numbered from 0 in each."""
    import uuid

    df.sparkSession.dataSource.register(FlatFiles)
    order = [*([by] if by else []), "row"]
    rows = df.select(*order, *[c.name for c in columns]).withColumn("row", F.col("row").cast("long"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.format("flatfile").mode("append").option("columns", _options(columns)).option("by", by or "").option("token", uuid.uuid4().hex).save()
