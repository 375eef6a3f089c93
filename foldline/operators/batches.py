"""Batches of examples as a table: which rows make up which batch of an epoch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.operators.ranks import numbered
from foldline.operators.splits import hash_order
from foldline.sources.scratch import cut, shared_folder

#: Rows of an alignment that are dealt at once.
PIECE = 4096


def batch_plan(examples: DataFrame, batch_size: int, seed: int, epoch: int = 0, folder: str | None = None) -> DataFrame:
    """examples (alignment_id, k and more) with batch, from 0: n // batch_size batches of batch_size rows each.

    Alignments and the rows of each are shuffled by a hash of seed and epoch, which any engine agrees on, and the rows are dealt
    to the batches in turn. An alignment of s rows has at most ceil(s / batches) of them in a batch, so a batch spans as many alignments as
    it can; what is left over after the last turn waits for another epoch. Fewer rows than batch_size give no batch.
    """
    shuffled = lambda *key: F.unhex(hash_order(F.concat_ws(":", F.lit(epoch), *key), seed))
    keys = {"_alignment": shuffled("alignment_id"), "_row": shuffled("alignment_id", "k")}
    order = ["_alignment", F.col("alignment_id"), "_row", F.col("k")]
    placed = numbered(examples, order, folder or shared_folder(examples.sparkSession, "batches"), "_place", keys)
    batches = placed.count() // batch_size
    return placed.where(F.col("_place") < batches * batch_size).withColumn("batch", F.pmod("_place", F.lit(max(batches, 1)))).drop("_place")


def spans(plan: DataFrame) -> DataFrame:
    """batch, rows, alignments: how many rows a batch of batch_plan() has and how many alignments it spans.

    Rows are dealt in turn, so only an alignment of more rows than there are batches is in one more than once; only such
    alignments' rows are told apart.
    """
    batches = plan.agg((F.max("batch") + 1).alias("batches"))
    sizes = plan.groupBy("alignment_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(batches))
    large = sizes.where("n > batches").select("alignment_id")
    again = plan.join(F.broadcast(large), "alignment_id").groupBy("batch", "alignment_id").agg((F.count("*") - 1).alias("more"))
    again = again.groupBy("batch").agg(F.sum("more").alias("more"))
    counts = plan.groupBy("batch").agg(F.count("*").alias("rows"))
    return counts.join(again, "batch", "left").select("batch", "rows", (F.col("rows") - F.coalesce("more", F.lit(0))).alias("alignments"))


def sized_spans(sizes: DataFrame, batch_size: int, seed: int, epoch: int = 0, folder: str | None = None) -> DataFrame:
    """spans() of the batch_plan() of alignments with n rows each (alignment_id, n, each alignment once), without its rows' order.

    An alignment's rows have neighbouring places in the plan, so a batch spans what it does whichever of them comes first: only
    alignments are put in order, and their rows are dealt to the batches by their places. The driver sees a number for each range.
    """
    folder = folder or shared_folder(sizes.sparkSession, "spans")
    whole = hash_order(F.concat_ws(":", F.lit(epoch), "alignment_id"), seed)
    # The hash's beginning orders nearly all, as a number; the rest is made only where beginnings are alike. A filter on n waits
    # for the table, as it would count the pairs again.
    rows = cut(sizes.select("alignment_id", F.col("n").cast("long").alias("n"), F.conv(F.substring(whole, 1, 15), 16, 10).cast("long").alias("_first")), f"{folder}/sizes").where("n > 0")
    ordered = rows.repartitionByRange("_first").sortWithinPartitions("_first", whole, "alignment_id").select(F.spark_partition_id().alias("part"), "n")

    def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for one in parts:
            n = one["n"].to_numpy()
            ends = before + np.cumsum(n)
            before = int(ends[-1]) if len(n) else before
            yield pa.RecordBatch.from_arrays([one["part"], one["n"], pa.array(ends - n)], ["part", "n", "at"])

    kept = cut(ordered.mapInArrow(placed, "part int, n long, at long"), f"{folder}/places")
    starts, total = [], 0
    for part, n in sorted(tuple(r) for r in kept.groupBy("part").agg(F.sum("n")).collect()):
        starts.append((part, total))
        total += n
    batches = total // batch_size
    kept = kept.join(F.broadcast(sizes.sparkSession.createDataFrame(starts, "part int, start long")), "part").select((F.col("start") + F.col("at")).alias("at"), "n")
    kept = kept.select("at", F.least("n", F.lit(batches * batch_size) - F.col("at")).alias("n")).where("n > 0").withColumn("most", F.least("n", F.lit(batches)))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - 1, F.lit(PIECE).cast("long")))
    dealt = kept.select("*", first.alias("t")).select("at", "n", F.explode(F.sequence("t", F.least(F.col("t") + PIECE, F.col("most")) - 1)).alias("t"))
    dealt = dealt.select(F.pmod(F.col("at") + F.col("t"), F.lit(max(batches, 1))).alias("batch"), F.expr(f"1 + (n - 1 - t) div {max(batches, 1)}").alias("n"))
    # A range's places are neighbours, so there is nothing to combine before the shuffle.
    return dealt.repartition("batch").groupBy("batch").agg(F.sum("n").alias("rows"), F.count("*").alias("alignments"))
