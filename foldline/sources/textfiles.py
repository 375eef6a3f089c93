"""One text file of a table's lines in an order, written by many tasks at their lines' places.

Lines are sorted by ranges, and a line starts where the bytes of those before it in its range end; a range starts where
the ranges before it end, which is a number for each. Tasks write into one file of the whole size, which takes its name when
all bytes are there; a task that runs again writes the same bytes to the same places.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from foldline.sources.opened import mounted
from foldline.sources.scratch import cut, drop, shared_folder

FORMAT = "foldline_lines"


@dataclass
class Written(WriterCommitMessage):
    size: int


class Lines(DataSource):
    """Write: rows of at (a line's first byte) and line make the file at path; options size, and header as bytes in hex."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> LineWriter:
        return LineWriter(mounted(self.options["path"]), int(self.options["size"]), bytes.fromhex(self.options["header"]))


class LineWriter(DataSourceArrowWriter):
    def __init__(self, path: str, size: int, header: bytes):
        self.path, self.size, self.begin = path, size, len(header)
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        self.part = f"{os.path.dirname(path) or '.'}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
        with open(self.part, "wb") as f:
            f.write(header)
            f.truncate(size)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, end = 0, -1
        with open(self.part, "r+b") as f:
            for batch in iterator:
                for at, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                    data = line.as_py().encode() + b"\n"
                    if at != end:
                        f.seek(at)
                    f.write(data)
                    done, end = done + len(data), at + len(data)
            f.flush()
            os.fsync(f.fileno())
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        if (done := sum(m.size for m in messages if m is not None)) != self.size - self.begin:
            self.abort(messages)
            raise ValueError(f"{done} of {self.size - self.begin} bytes were written")
        os.replace(self.part, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's lines in order, each with the bytes of those before it."""
    before = 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = before + np.cumsum(sizes)
        before = int(ends[-1]) if len(ends) else before
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - sizes), batch.column(1)], ["range", "at", "line"])


def write_lines(rows: DataFrame, line: Column, order: list[Column], path: str, header: str | None = None) -> int:
    """Writes a line of text for each row to one file at path, in the order given, after the header's; returns the file's bytes.

    A null line is written as an empty one. Lines that tie in the order come in the order of their text. The path is on a file
    system that all executors mount; without rows there is the header alone, or an empty file.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Lines)
    name = "_line"
    while name in rows.columns:
        name = f"_{name}"
    by = [*order, F.col(name)]
    split = rows.withColumn(name, F.coalesce(line.cast("string"), F.lit(""))).repartitionByRange(*by).sortWithinPartitions(*by)
    split = split.select(F.spark_partition_id().alias("range"), F.col(name).alias("line"))
    folder = shared_folder(spark, "lines")
    placed = cut(split.mapInArrow(_places, "range int, at long, line string"), folder)
    first = (header + "\n").encode() if header is not None else b""
    starts, size = [], len(first)
    for r in sorted(placed.groupBy("range").agg(F.max(F.col("at") + F.octet_length("line") + 1).alias("n")).collect()):  # a row per range
        starts.append((r["range"], size))
        size += r["n"]
    starts = spark.createDataFrame(starts, "range int, start long")
    out = placed.join(F.broadcast(starts), "range").select((F.col("start") + F.col("at")).alias("at"), "line")
    out.write.format(FORMAT).options(size=size, header=first.hex()).mode("append").save(path)
    drop(spark, folder)
    return size
