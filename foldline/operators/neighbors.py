"""Nearest residues within a chain, and residues' neighbours along it.

A chain's box is cut into cubic cells, 2**level along each side, and a residue is compared with those of its own and the 26
cells around. What lies outside is at least as far away as that cube's nearest face, so a partner nearer than this is proven. Residues
that are not proven look again in cells of twice the edge, until one cube holds the chain. The join is
on chain and cell, so that a chain of any length is spread; a place that many residues share offers only as many of
them, lowest numbers first, as an answer can need.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions import geometry as g
from foldline.sources.scratch import cut, shared_folder

#: Residues of a cell, on average, at the finest level; levels at most.
CELL, DEEPEST = 8, 20
#: Residues of a task, on average, where residues meet: few, as each makes up to some hundred pairs there.
TASK = 8192
_BOX = ["_low0", "_low1", "_low2", "_size", "_level"]
_AT = ["_p0", "_p1", "_p2"]


def _interior(residues: DataFrame, xyz: list[str]) -> DataFrame:
    """Valid residues with finite coordinates, but the first and last of the chain, which are neither sources nor partners; with their chain's box."""
    at = [F.col(c).cast("double") for c in xyz]
    usable = F.col("valid") & at[0].isNotNull() & at[1].isNotNull() & at[2].isNotNull()
    for c in at:
        usable &= ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = residues.select("chain", "idx", F.coalesce(usable, F.lit(False)).alias("_usable"), *(c.alias(name) for c, name in zip(at, _AT)))
    held = [F.when(F.col("_usable"), F.col(c)) for c in _AT]
    size = F.greatest(*(F.max(c) - F.min(c) for c in held))
    level = F.ceil(F.log(F.count_if("_usable") / CELL) / F.log(F.lit(8.0)))
    boxes = rows.groupBy("chain").agg(F.max("idx").alias("_last"), *(F.min(c).alias(f"_low{k}") for k, c in enumerate(held)), size.alias("_size"), F.when(size > 0, F.greatest(F.lit(0), F.least(F.lit(DEEPEST), level))).otherwise(0).cast("int").alias("_level"))
    return rows.where("_usable").join(boxes, "chain").where("idx > 0 and idx < _last").select("chain", "idx", *_AT, *_BOX)


def _side(up: int) -> Column:
    return F.expr(f"shiftleft(1, greatest(0, _level - {up}))")


def _cells(up: int) -> list[Column]:
    """The residue's cell, with the edge doubled `up` times."""
    per_side = _side(up)
    return [F.coalesce(F.least(F.floor((F.col(f"_p{k}") - F.col(f"_low{k}")) * per_side / F.nullif(F.col("_size"), F.lit(0.0))), per_side - 1), F.lit(0)).cast("int") for k in range(3)]


def _asking(points: DataFrame, up: int) -> DataFrame:
    """points with cells c0 to c2, the cells of a side, and bound2: the square of the distance to what lies outside the 27 cells (null: nothing does)."""
    rows = points.withColumns({**{f"c{k}": c for k, c in enumerate(_cells(up))}, "side": _side(up)})
    edge = F.col("_size") / F.col("side")
    faces = []
    for k in range(3):
        inside, c = F.col(f"_p{k}") - F.col(f"_low{k}"), F.col(f"c{k}")
        faces += [F.when(c > 1, inside - (c - 1) * edge), F.when(c + 1 < F.col("side") - 1, (c + 2) * edge - inside)]
    bound = F.greatest(F.lit(0.0), F.least(*faces)) * (1 - 1e-9)  # least() passes over nulls
    return rows.withColumn("bound2", F.when(F.coalesce(*faces).isNotNull(), bound * bound))


def _proven(residues: DataFrame, xyz: list[str], most: int, digits: int | None, reduced: Callable[[DataFrame], DataFrame], reach: Column, folder: str) -> DataFrame:
    """chain, idx and what reduced() makes of the pairs (chain, i, j, d2) of each i, from as many cells as it takes to prove it.

    reach: the d2 above which no further pair changes the result, null if any may. most: how many residues of one place can matter.
    """
    place = F.row_number().over(Window.partitionBy("chain", *_AT).orderBy("idx"))
    points = cut(_interior(residues, xyz), f"{folder}/points")
    others = cut(points.withColumn("_place", place).where(F.col("_place") <= most).drop("_place"), f"{folder}/others")
    around = F.explode(F.array(*(F.struct(*(F.lit(o).alias(f"o{k}") for k, o in enumerate(cell))) for cell in product((-1, 0, 1), repeat=3)))).alias("o")
    d2 = g.distance2(tuple(F.col(f"a{k}") for k in range(3)), tuple(F.col(f"b{k}") for k in range(3)))
    exact = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    waiting, done = points, []
    # Tables are small beside the pairs they make, so Spark would merge partitions by the wrong size; a stated number stays.
    dealt = lambda rows: rows.repartition(max(1, -(-count // TASK)), "chain", "c0", "c1", "c2")
    count = points.count()
    for up in range(DEEPEST + 1):
        asked = _asking(waiting, up)
        probes = asked.select("chain", F.col("idx").alias("i"), *(F.col(c).alias(f"a{k}") for k, c in enumerate(_AT)), "side", "c0", "c1", "c2", around)
        probes = probes.select("chain", "i", "a0", "a1", "a2", "side", *((F.col(f"c{k}") + F.col(f"o.o{k}")).alias(f"c{k}") for k in range(3)))
        probes = probes.where(" and ".join(f"c{k} >= 0 and c{k} < side" for k in range(3))).drop("side")
        met = others.select("chain", F.col("idx").alias("j"), *(F.col(c).alias(f"b{k}") for k, c in enumerate(_AT)), *(c.alias(f"c{k}") for k, c in enumerate(_cells(up))))
        near = dealt(probes).join(dealt(met), ["chain", "c0", "c1", "c2"]).where("i <> j").select("chain", "i", "j", exact(d2).alias("d2"))
        found = asked.select("chain", "idx", "bound2").join(reduced(near).withColumnRenamed("i", "idx"), ["chain", "idx"], "left")
        found = cut(found.withColumn("proven", F.col("bound2").isNull() | F.coalesce(reach < exact(F.col("bound2")), F.lit(False))), f"{folder}/round-{up}")
        done.append(found.where("proven").drop("proven", "bound2"))
        open_ = found.where("not proven").select("chain", "idx")
        if open_.isEmpty():
            break
        waiting = points.join(open_, ["chain", "idx"], "left_semi")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def nearest(residues: DataFrame, xyz: list[str], min_separation: int = 1, fall_back: float | None = None, digits: int | None = None, folder: str | None = None) -> DataFrame:
    """chain, idx, partner (null if there is none), d2; ties go to the lowest number.

    residues: chain, idx, valid and the coordinates; those without finite coordinates have no partner and are none. With min_separation over
    1 the nearest residue at least so far along the chain is taken, unless it is fall_back or further away: then the
    nearest of all. digits: places to which squared distances are rounded before they are compared. Tables are written below folder, by
    default a new shared one.
    """
    best = lambda rows: F.min(F.when(rows, F.struct("d2", "j")))
    reduced = lambda pairs: pairs.groupBy("chain", "i").agg(best(F.lit(True)).alias("any"), best(F.abs(F.col("i") - F.col("j")) >= min_separation).alias("far"))
    chosen, reach = F.col("any"), F.col("any.d2")
    if min_separation > 1:
        limit = F.lit(True) if fall_back is None else F.col("far.d2") < float(fall_back) ** 2
        chosen = F.when(F.col("far").isNotNull() & limit, F.col("far")).otherwise(F.col("any"))
        # A residue far along the chain matters up to fall_back; where there is none yet, and no such limit, the search goes on.
        far = F.col("far.d2") if fall_back is None else F.least(F.col("far.d2"), F.lit(float(fall_back) ** 2))
        reach = F.when(F.col("any").isNotNull() & far.isNotNull(), F.greatest(F.col("any.d2"), far))
    found = _proven(residues, xyz, max(2, 2 * min_separation), digits, reduced, reach, folder or shared_folder(residues.sparkSession, "cells"))
    found = found.select("chain", "idx", chosen.alias("c"))
    return residues.select("chain", "idx").join(found, ["chain", "idx"], "left").select("chain", "idx", F.col("c.j").alias("partner"), F.col("c.d2").alias("d2"))


def kth_nearest(residues: DataFrame, xyz: list[str], k: int, digits: int | None = None, folder: str | None = None) -> DataFrame:
    """chain, idx, partner: the k-th nearest residue, where there are k; as nearest() otherwise."""
    place = F.row_number().over(Window.partitionBy("chain", "i").orderBy("d2", "j"))

    def reduced(pairs: DataFrame) -> DataFrame:
        first = pairs.withColumn("_k", place).where(F.col("_k") <= k)
        return first.groupBy("chain", "i").agg(F.max(F.when(F.col("_k") == k, F.struct("d2", "j"))).alias("last"))

    found = _proven(residues, xyz, k + 1, digits, reduced, F.col("last.d2"), folder or shared_folder(residues.sparkSession, "cells"))
    return found.where("last is not null").select("chain", "idx", F.col("last.j").alias("partner"))


def descriptors(residues: DataFrame, partners: DataFrame) -> DataFrame:
    """chain, idx, partner, f0..f9 of residues whose own and partner's neighbourhoods are whole.

    residues: chain, idx, valid, ca (array<double>); partners: chain, idx, partner.
    """
    order = Window.partitionBy("chain").orderBy("idx")
    around = residues.select(
        "chain", "idx", F.col("ca").alias("at"), F.lag("ca").over(order).alias("before"), F.lead("ca").over(order).alias("after"),
        (F.col("valid") & F.coalesce(F.lag("valid").over(order), F.lit(False)) & F.coalesce(F.lead("valid").over(order), F.lit(False))).alias("whole"),
        (F.coalesce(F.lag("valid").over(order), F.lit(False)) & F.coalesce(F.lead("valid").over(order), F.lit(False))).alias("sides"),
    )
    own = around.where("whole").join(partners.where("partner is not null").select("chain", "idx", "partner"), ["chain", "idx"])
    other = around.where("sides").select("chain", F.col("idx").alias("partner"), F.col("before").alias("p_before"), F.col("at").alias("p_at"), F.col("after").alias("p_after"))
    rows = own.join(other, ["chain", "partner"])
    features = g.descriptor(*(g.vector(c) for c in ("before", "at", "after", "p_before", "p_at", "p_after")), F.col("partner") - F.col("idx"))
    out = rows.select("chain", "idx", "partner", *(f.alias(f"f{k}") for k, f in enumerate(features)))
    return out.where(" and ".join(f"f{k} is not null" for k in range(10)))
