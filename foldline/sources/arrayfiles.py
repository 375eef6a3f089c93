"""Rows of .npy files as a data source: tasks read ranges of rows, and write rows at their own places of one file.

The driver reads and writes headers only, and a task holds one piece of its range at a time. A task that runs again
writes the same bytes at the same places.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from foldline.operators.ranks import numbered
from foldline.sources.opened import mounted, opened
from foldline.sources.scratch import drop, shared_folder

FORMAT = "npy_rows"
#: Bytes of a task's range, and of the piece of it that is in memory at a time.
RANGE, PIECE = 64 << 20, 4 << 20


@dataclass
class Header:
    """What a .npy file says of itself; width is a row's number of values, start the first row's place."""

    shape: tuple
    dtype: np.dtype
    start: int

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))

    @classmethod
    def of(cls, path: str) -> Header:
        with opened(path) as f:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, columns_first, dtype = read(f)
            if not shape or columns_first and len(shape) > 1 or dtype.kind not in "fiub":
                raise ValueError(f"{path}: rows of numbers in row order are read, not shape {shape} of {dtype}{' by columns' if columns_first else ''}")
            return cls(shape, dtype, f.tell())


@dataclass
class Rows(InputPartition):
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    rows: int


class ArrayRows(DataSource):
    """Reads with the option files, JSON of column -> path, files of one length; writes with path, rows, width and dtype."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(["row long", *(f"`{c}` array<double>" for c in json.loads(self.options["files"]))])

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(json.loads(self.options["files"]))

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        o = self.options
        return ArrayWriter(mounted(o["path"]), int(o["rows"]), int(o["width"]), np.dtype(o["dtype"]))


class ArrayReader(DataSourceReader):
    def __init__(self, files: dict[str, str]):
        self.files = {c: (path, Header.of(path)) for c, path in files.items()}
        lengths = {path: h.shape[0] for path, h in self.files.values()}
        if len(set(lengths.values())) > 1:
            raise ValueError(f"files of one length are read together, not {lengths}")
        self.n = next(iter(lengths.values()))

    def row_bytes(self) -> int:
        return max(1, sum(h.width * max(8, h.dtype.itemsize) for _, h in self.files.values()))

    def partitions(self) -> list[Rows]:
        step = max(1, RANGE // self.row_bytes())
        return [Rows(k, min(self.n, k + step)) for k in range(0, self.n, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a file without rows has no ranges
            return
        step = max(1, PIECE // self.row_bytes())
        sources = {c: opened(path) for c, (path, _) in self.files.items()}
        for first in range(partition.first, partition.last, step):
            last = min(partition.last, first + step)
            columns = [pa.array(np.arange(first, last))]
            for c, (path, h) in self.files.items():
                sources[c].seek(h.start + first * h.width * h.dtype.itemsize)
                want = (last - first) * h.width * h.dtype.itemsize
                if len(got := sources[c].read(want)) != want:
                    raise ValueError(f"{path} ends before row {last}")
                values = np.frombuffer(got, h.dtype).astype(np.float64)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1) * h.width, pa.int32()), pa.array(values)))
            yield pa.RecordBatch.from_arrays(columns, ["row", *self.files])
        for f in sources.values():
            f.close()


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int, width: int, dtype: np.dtype):
        self.path, self.rows, self.width, self.dtype = path, rows, width, dtype
        self.part = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
        with open(self.part, "wb") as f:
            np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": False, "shape": (rows, width)})
            self.start = f.tell()
            f.truncate(self.start + rows * width * dtype.itemsize)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = 0
        with open(self.part, "r+b") as f:
            for batch in iterator:
                values = batch.column(1).flatten()
                if values.null_count or len(values) != len(batch) * self.width:
                    raise ValueError(f"a row is {self.width} numbers, none of them null")
                places = batch.column(0).to_numpy(zero_copy_only=False)
                block = values.to_numpy(zero_copy_only=False).astype(self.dtype).reshape(len(batch), self.width)
                cuts = np.flatnonzero(np.diff(places) != 1) + 1
                for run, at in zip(np.split(block, cuts), np.split(places, cuts)):
                    if len(at):
                        f.seek(self.start + int(at[0]) * self.width * self.dtype.itemsize)
                        f.write(run.tobytes())
                done += len(batch)
            f.flush()
            os.fsync(f.fileno())
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        if (done := sum(m.rows for m in messages if m is not None)) != self.rows:
            self.abort(messages)
            raise ValueError(f"{done} of {self.rows} rows were written")
        os.replace(self.part, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


def array_rows(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """row (from 0) and an array<double> column for each of files (column -> path or URI of a .npy file).

    The first axis is rows, the others are one after the other in a row's array. Files are of one length. No rows give an empty
    table; arrays by columns, of one value or of other than numbers are an error.
    """
    spark.dataSource.register(ArrayRows)
    return spark.read.format(FORMAT).option("files", json.dumps(files)).load()


def write_array(rows: DataFrame, column: str, order: list[Column], path: str, width: int | None = None, dtype: str = "<f4") -> int:
    """Writes a column of arrays to one .npy file, in the order given; returns the number of rows.

    Rows that tie in the order come in no certain order. Nulls, in a row's place or in it, and rows that are not of one width, are
    an error. width is needed only where there may be no rows. All columns of rows are sorted with them, so rows should have few. The path is on a file system that all executors mount; the file
    takes its name when it is whole.
    """
    spark = rows.sparkSession
    spark.dataSource.register(ArrayRows)
    folder = shared_folder(spark, "array")
    placed = numbered(rows.withColumn("_values", F.col(column).cast("array<double>")), order, folder, "_row").select(F.col("_row").alias("row"), F.col("_values").alias("values"))
    size = F.coalesce(F.size("values"), F.lit(-1))
    n, least, most = placed.agg(F.count("*"), F.min(size), F.max(size)).first()
    if n and (least != most or least < 0 or width not in (None, least)):
        raise ValueError(f"rows of {least} to {most} values (-1 is null) do not make one array{'' if width is None else f' of width {width}'}")
    placed.select("row", "values").write.format(FORMAT).options(rows=n, width=least if n else width or 0, dtype=dtype).mode("append").save(path)
    drop(spark, folder)
    return n


def examples(spark: SparkSession, folder: str) -> DataFrame:
    """id, split, x, y of a folder of arrays in either layout, as training.train_table takes them; validation ids are below zero.

    The layouts are {train,val}_{x,y}_raw.npy, and data.npy with val/data.npy of shape (rows, features, 2).
    """
    apart = os.path.exists(f"{mounted(folder)}/train_x_raw.npy")

    def side(split: str) -> DataFrame:
        if apart:
            rows = array_rows(spark, {c: f"{folder}/{split}_{c}_raw.npy" for c in "xy"})
        else:
            path = f"{folder}/data.npy" if split == "train" else f"{folder}/val/data.npy"
            if (shape := Header.of(path).shape)[2:] != (2,):
                raise ValueError(f"{path}: rows of features in pairs are read, not shape {shape}")
            rows = array_rows(spark, {"both": path}).select("row", F.filter("both", lambda v, i: i % 2 == 0).alias("x"), F.filter("both", lambda v, i: i % 2 == 1).alias("y"))
        return rows.select((F.col("row") if split == "train" else -1 - F.col("row")).alias("id"), F.lit(split).alias("split"), "x", "y")

    return side("train").union(side("val"))
