"""What several operators need: shared folders, cut lineage, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.sources.scratch import cut, drop, shared_folder

#: Folders that work_dir() has given in this process, for those who clear up.
MADE: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh shared folder for one run, noted in MADE."""
    MADE.append(shared_folder(spark, name))
    return MADE[-1]


#: Rows of a batch that goes to Python, at most: texts may be long.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """From now on the session hands Python at most BATCH_ROWS rows at a time, which changes no result."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(name: str, taken: list[str]) -> str:
    """name with as many underscores before it as make it unlike all that are taken, in any case of letters."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stretches(batch: pa.RecordBatch, column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most so many rows, and of at most so many bytes of a string column, or of one row."""
    width = batch.column(column).cast(pa.large_string())
    ends = np.frombuffer(width.buffers()[1], np.int64)[width.offset : width.offset + len(width) + 1]
    at = 0
    while at < len(width):
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1))
        yield batch.slice(at, min(to, len(width)) - at)
        at = to


#: Edges of a node from which on it counts as hot, or a thousandth of all edges if that is more.
HOT = 1000


def components(edges: DataFrame, folder: str, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    edges: columns a, b, of one type that has an order. Returns node, component (the smallest node that it reaches).
    Alternates large-star and small-star steps: a node's smallest neighbour is an aggregate with map-side
    combining, and its edges meet it by a join, or, for the few nodes that have very many, by a broadcast.
    Every round is written to the shared folder, and the round before goes.
    """
    step = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        f"{folder}/cc-0",
    )

    def state() -> tuple:
        return tuple(step.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    def met(rows: DataFrame, key: str, low: DataFrame, many: int) -> DataFrame:
        """rows with low's m of their key; hot keys are at most 2000, as each has a thousandth of the edges' ends."""
        hot = F.broadcast(low.where(F.col("degree") > many).select(key, "m"))
        return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(low.where(F.col("degree") <= many).select(key, "m"), key))

    before = state()
    for k in range(1, rounds + 1):
        many = max(HOT, before[0] // 1000)
        # Large star: each neighbour above a node points to the node's smallest neighbour.
        both = step.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(step.select("lo", "hi"))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree")), f"{folder}/cc-low-{k}")
        large = met(both.where("v > u"), "u", low, many).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = cut(large.where("hi <> lo").distinct(), f"{folder}/cc-large-{k}")
        # Small star: each neighbour below a node, and the node, point to the smallest of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("degree"))
        small = met(large, "hi", least, many).select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo")
        step = cut(small.where("hi <> lo").distinct(), f"{folder}/cc-{k}")
        for name in (f"cc-{k - 1}", f"cc-low-{k}", f"cc-large-{k}"):
            drop(edges.sparkSession, f"{folder}/{name}")
        now = state()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return step.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(step.select(F.col("lo"), F.col("lo"))).distinct()
