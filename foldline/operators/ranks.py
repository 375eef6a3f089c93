"""Places in an order and running totals over whole tables or keys of any size, without a window that one task holds.

Places come from a range partition: rows are sorted within their range, and a range starts where the rows of
those before it end. Running totals are made within pieces of a bounded number of places; the pieces' own
totals are summed the same way, a level up, until one piece is left.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.sources.scratch import cut

#: Places of one piece of a running total.
PIECE = 4096
#: Bits of monotonically_increasing_id that count rows; the others number the partition.
_ROW_BITS = 33
#: Aggregates that running() can carry from piece to piece.
_CARRY = {"sum": lambda before, own: before + own, "bit_xor": lambda before, own: before.bitwiseXOR(own)}


def numbered(rows: DataFrame, order: Sequence[Column | str], folder: str, name: str = "number", keys: dict[str, Column] | None = None) -> DataFrame:
    """rows with the place of each, from 0, in the order given; the sorted rows are written to folder.

    Equal rows of the order get places in no certain order, and stay in one partition: an order that
    many rows tie in needs a further column. The driver sees one number for each partition. keys: what the order
    calls by a name, for keys that take long; they are made once for a sort, not for each comparison, and are neither shuffled nor kept.
    """
    keys = keys or {}
    split = rows.repartitionByRange(*(keys[o] if isinstance(o, str) else o for o in order))
    split = split.withColumns(keys).sortWithinPartitions(*order).drop(*keys).withColumn("_at", F.monotonically_increasing_id())
    kept = cut(split, folder).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    sizes = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _start long")  # a row per partition
    return kept.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_part", "_start", "_at")


def running(rows: DataFrame, keys: Sequence[str], at: str, totals: dict[str, tuple[str, str]], piece: int = PIECE) -> DataFrame:
    """rows with columns name: (how, source), the sum or bit_xor of source over the rows of the key up to and with its own.

    at: a key's places, from 0 and without gaps. rows are read several times, so they should be a written table.
    Keys are not null.
    """
    here = "_piece"
    while here in rows.columns:
        here = f"_{here}"
    held = rows.withColumn(here, F.expr(f"`{at}` div {piece}"))
    upto = Window.partitionBy(*keys, here).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = held.withColumns({name: getattr(F, how)(source).over(upto) for name, (how, source) in totals.items()})
    if (rows.agg(F.max(at)).first()[0] or 0) < piece:
        return out.drop(here)
    own = held.groupBy(*keys, here).agg(*(getattr(F, how)(source).alias(name) for name, (how, source) in totals.items()))
    # The pieces' own totals, summed up a level higher; a piece takes that of the one before it.
    before = running(own, keys, here, {f"_before_{name}": (how, name) for name, (how, _) in totals.items()}, piece)
    before = before.select(*(F.col(k).alias(f"_key_{k}") for k in keys), (F.col(here) + 1).alias("_next"), *(f"_before_{n}" for n in totals))
    joined = out.join(before, reduce(and_, [F.col(k) == F.col(f"_key_{k}") for k in keys] + [F.col(here) == F.col("_next")]), "left")
    return joined.select(*rows.columns, *(F.coalesce(_CARRY[how](F.col(f"_before_{n}"), F.col(n)), F.col(n)).alias(n) for n, (how, _) in totals.items()))
