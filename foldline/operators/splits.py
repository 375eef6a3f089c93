"""Splits by group, folds and their complements, manifests."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.functions import hierarchy
from foldline.operators.ranks import numbered
from foldline.sources.scratch import shared_folder

LEVELS = ("fold", "superfamily", "family", "pdb")


def groups(sids: DataFrame, lookup: DataFrame, level: str = "superfamily") -> DataFrame:
    """sid, group_id: the class at a level, or the id's own group where the class is unknown."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")
    if level == "pdb":
        return sids.select("sid", hierarchy.group_id("sid").alias("group_id"))
    part = {"fold": hierarchy.fold, "superfamily": hierarchy.superfamily, "family": hierarchy.family}[level]("class")
    return sids.join(lookup, "sid", "left").select("sid", F.coalesce(part, hierarchy.group_id("sid")).alias("group_id"))


def hash_order(group: str | Column, seed: int) -> Column:
    """A place in a shuffled order that any engine and cluster agrees on."""
    return F.sha2(F.concat_ws(":", F.lit(seed), group), 256)


def split_by_hash(rows: DataFrame, share: float, seed: int, folder: str | None = None) -> DataFrame:
    """rows (sid, group_id) with split: the first int(n * share) groups in hash order are val. Groups are placed in ranges, by any number of tasks."""
    order = [hash_order("group_id", seed), F.col("group_id")]
    ranked = numbered(rows.select("group_id").distinct(), order, folder or shared_folder(rows.sparkSession, "groups"), "place")
    val = int(ranked.count() * share)
    named = ranked.select("group_id", F.when(F.col("place") < val, "val").otherwise("train").alias("split"))
    return rows.join(named, "group_id").select("sid", "group_id", "split")


def split_by_shuffle(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """split_by_hash with the Mersenne shuffle of group ids in order of first appearance (rows have position); groups are few."""
    first = [r["group_id"] for r in rows.groupBy("group_id").agg(F.min("position").alias("p")).orderBy("p").collect()]
    random.Random(seed).shuffle(first)
    val = set(first[: int(len(first) * share)])
    named = rows.sparkSession.createDataFrame([(g, "val" if g in val else "train") for g in first], "group_id string, split string")
    return rows.join(named, "group_id").select("sid", "group_id", "split")


def fold_chunks(folds: DataFrame, k: int, order: Column, folder: str | None = None) -> DataFrame:
    """fold, fold_id (from 1): k runs of folds in the given order, the first ones longer by the remainder; ties in it go by fold."""
    placed = numbered(folds.select("fold"), [order, F.col("fold")], folder or shared_folder(folds.sparkSession, "chunks"), "place")
    size, rest = divmod(placed.count(), k)
    longer = rest * (size + 1)
    chunk = F.when(F.col("place") < longer, F.floor(F.col("place") / (size + 1))).otherwise(rest + F.floor((F.col("place") - longer) / max(size, 1)))
    return placed.select("fold", (chunk + 1).cast("int").alias("fold_id"))


def shuffled_chunks(folds: list[str], k: int, seed: int) -> list[list[str]]:
    """The same with the Mersenne shuffle."""
    shuffled = list(folds)
    random.Random(seed).shuffle(shuffled)
    size, rest = divmod(len(shuffled), k)
    out, at = [], 0
    for n in range(k):
        stop = at + size + (n < rest)
        out.append(shuffled[at:stop])
        at = stop
    return out


def complements(rows: DataFrame, k: int) -> DataFrame:
    """Each row once for each of k experiments: val where its fold_id is the experiment's, else train."""
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("experiment")).withColumn("split", F.when(F.col("fold_id") == F.col("experiment"), "val").otherwise("train"))


def missing_ids(requested: DataFrame, manifest: DataFrame, most: int = 20) -> DataFrame:
    """The first requested ids, in order, that the manifest lacks."""
    return requested.select("sid").distinct().join(manifest.select("sid"), "sid", "left_anti").orderBy("sid").limit(most)
