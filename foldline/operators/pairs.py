"""From alignments and residues to training pairs: join, superpose, cap, mirror.

The expansion and the joins are one declarative plan, and so is the superposition: an alignment's rotation comes from
its sums of products, in columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldline.functions import cigar, hierarchy, rotation
from foldline.functions.geometry import distance, vector
from foldline.sources.scratch import cut, shared_folder

#: Why an alignment has no superposition.
TOO_FEW, NOT_FINITE, RANK = "too_few_pairs", "nonfinite_coordinates", "rank_deficient_coordinates"
#: Spread beside a line, as the root of a sum of squares, below which points have no rotation of their own.
RANK_LIMIT = 1e-6


def expand(alignments: DataFrame) -> DataFrame:
    """A row per residue pair: the alignment's columns but cigar, and k, i, j."""
    keep = [c for c in alignments.columns if c != "cigar"]
    runs = alignments.select(*keep, F.explode_outer(cigar.runs("cigar")).alias("r")).where("r is not null")
    return runs.select(*keep, "r", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("r.n") - 1)).alias("t")).select(*keep, *((F.col(f"r.{c}") + F.col("t")).cast("int").alias(c) for c in "kij"))


def sizes(alignments: DataFrame) -> DataFrame:
    """alignment_id and n: how many rows expand() has for each, null without a cigar."""
    return alignments.select("alignment_id", cigar.run_total("cigar").alias("n"))


def with_residues(pairs: DataFrame, residues: DataFrame) -> DataFrame:
    """pairs with both residues' columns, x_ and y_ before their names; pairs without one of the two are dropped.

    residues: sid, idx, valid and more. Only valid ones match.
    """
    side = lambda p, sid, k: residues.where("valid").select(F.col("sid").alias(sid), F.col("idx").alias(k), *(F.col(c).alias(f"{p}_{c}") for c in residues.columns if c not in ("sid", "idx", "valid")))
    return pairs.join(side("x", "sid1", "i"), ["sid1", "i"]).join(side("y", "sid2", "j"), ["sid2", "j"])


def superposed(pairs: DataFrame, key: str = "alignment_id", folder: str | None = None) -> DataFrame:
    """pairs (key, x_ca, y_ca and more) with ca_dist (float, null where there is no superposition) and status (null if all is well).

    ca_dist is the distance of a pair after the best proper rotation of the alignment's y_ca onto its x_ca. The pairs
    are written once below folder, by default a new shared one; alignments meet their own sums by joins, which Spark can split.
    """
    columns = pairs.columns
    finite = F.lit(True)
    for c in ("x_ca", "y_ca"):
        for v in vector(c):
            finite &= v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    parts = {f"_{p}{k}": v.cast("double") for p in "xy" for k, v in enumerate(vector(f"{p}_ca"))}
    rows = cut(pairs.withColumns({**parts, "_finite": F.coalesce(finite, F.lit(False)), "_key": F.col(key)}), f"{folder or shared_folder(pairs.sparkSession, 'superposed')}/pairs")
    turns = rotation.turns(rows.groupBy("_key").agg(F.count("*").alias("_n"), F.every("_finite").alias("_all_finite"), *rotation.moments()))
    held = rows.join(turns, rows["_key"].eqNullSafe(turns["_key"])).drop(turns["_key"])
    # A set of points on one line is found by what is left of it beside the line, not by differences of large sums.
    beside = held.groupBy("_key").agg(F.sum(rotation.beside("x")).alias("_beside_x"), F.sum(rotation.beside("y")).alias("_beside_y"))
    held = held.join(beside, held["_key"].eqNullSafe(beside["_key"])).drop(beside["_key"])
    flat = F.least(*(F.sqrt(F.coalesce(f"_beside_{p}", F.lit(0.0))) for p in "xy")) < RANK_LIMIT
    status = F.when(F.col("_n") < 3, TOO_FEW).when(~F.col("_all_finite"), NOT_FINITE).when(flat, RANK)
    out = held.withColumn("status", status).withColumn("ca_dist", F.when(F.col("status").isNull(), rotation.distance().cast("float")))
    return out.select(*columns, "ca_dist", "status")


def within(pairs: DataFrame, limit: float | None) -> DataFrame:
    """Pairs of well-determined alignments whose distance is at most the limit, compared as float."""
    kept = pairs.where("status is null")
    return kept if limit is None else kept.where(F.col("ca_dist") <= F.lit(limit).cast("float"))


def cap_seed(sid1: Column, sid2: Column, text: Column, seed: int) -> Column:
    """The 32-bit seed of an alignment's sample."""
    digest = F.sha2(F.concat_ws(":", sid1, sid2, F.sha2(text, 256), F.lit(seed)), 256)
    return F.conv(F.right(digest, F.lit(8)), 16, 10).cast("long")


def capped(pairs: DataFrame, most: int | None, seed: int, key: str = "alignment_id") -> DataFrame:
    """At most most // 2 pairs of each alignment, before mirroring, in the order of a hash of seed, alignment and k."""
    if most is None:
        return pairs
    order = F.unhex(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key), F.col("k")), 256))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_order", "k"))
    # The hash is made behind the shuffle: before it, it would travel with every pair.
    return pairs.repartition(key).withColumn("_order", order).withColumn("_place", place).where(F.col("_place") <= most // 2).drop("_order", "_place")


def capped_exactly(pairs: DataFrame, most: int, key: str = "alignment_id") -> DataFrame:
    """capped() with numpy's generator, seeded by the column cap_seed; keeps the generator's order in column place."""

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k", kind="stable")
        keep = most // 2
        chosen = np.random.default_rng(int(group["cap_seed"].iloc[0])).choice(len(group), keep, replace=False) if len(group) > keep else np.arange(len(group))
        return group.iloc[chosen].assign(place=np.arange(len(chosen), dtype="int32"))

    return pairs.groupBy(key).applyInPandas(kernel, T.StructType([*pairs.schema.fields, T.StructField("place", T.IntegerType())]))


def seed_of(sid1: str, sid2: str, text: str, seed: int) -> int:
    own = hashlib.sha256(text.encode()).hexdigest()
    return int(hashlib.sha256(f"{sid1}:{sid2}:{own}:{seed}".encode()).hexdigest(), 16) % (1 << 32)


def mirrored(pairs: DataFrame, swaps: list[tuple[str, str]]) -> DataFrame:
    """Each row and its mirror image (columns of each pair exchanged), with dir 0 and 1; one pass, no union."""
    other = {a: b for a, b in swaps} | {b: a for a, b in swaps}
    as_is = F.struct(F.lit(0).alias("dir"), *(F.col(c) for c in pairs.columns))
    swapped = F.struct(F.lit(1).alias("dir"), *(F.col(other.get(c, c)).alias(c) for c in pairs.columns))
    return pairs.select(F.explode(F.array(as_is, swapped)).alias("e")).select("e.*")


def raw_distance(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("ca_dist_raw", distance(vector("x_ca"), vector("y_ca")))


def with_levels(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """rows (sid1, sid2, and more) with each side's fold and superfamily; unknown ids have nulls. lookup: sid, class."""
    # Ids are few beside rows: the lookup is cut down to those that occur, so that it can be sent to the rows where it is small.
    seen = rows.select(F.explode(F.array("sid1", "sid2")).alias("sid")).distinct()
    levels = lookup.join(seen, "sid", "left_semi").select("sid", hierarchy.fold("class").alias("fold"), hierarchy.superfamily("class").alias("superfamily"))
    side = lambda sid, name: levels.select(F.col("sid").alias(sid), F.col("fold").alias(f"fold_{name}"), F.col("superfamily").alias(f"superfamily_{name}"))
    return rows.join(side("sid1", "source"), "sid1", "left").join(side("sid2", "target"), "sid2", "left")


def metadata(pairs: DataFrame) -> DataFrame:
    """The pair table, of pairs (alignment_id, sid1, sid2, i, j, ca_dist_raw, ca_dist) with_levels()."""
    return pairs.select(
        "alignment_id", F.col("sid1").alias("sid_source"), F.col("sid2").alias("sid_target"), F.col("i").alias("idx_source"), F.col("j").alias("idx_target"),
        hierarchy.group_id("sid1").alias("split_group_source"), hierarchy.group_id("sid2").alias("split_group_target"),
        "fold_source", "fold_target", "superfamily_source", "superfamily_target", "ca_dist_raw", F.col("ca_dist").cast("double").alias("ca_dist_superposed"),
    )


def pair_metadata(pairs: DataFrame, lookup: DataFrame) -> DataFrame:
    """metadata() of pairs whose levels are not yet there."""
    return metadata(with_levels(pairs, lookup))
