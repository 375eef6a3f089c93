"""Experiments over whole runs: two quantizers, folds, alphabet sizes and seeds.

A run trains on one machine; runs follow one another on the driver, and what each reads and
evaluates is Spark's.
"""

from __future__ import annotations

import copy
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.operators import search
from foldline.plans import alphabet, dataset, reporting
from foldline.plans.settings import Settings
from foldline.sources import readers
from foldline.sources.textfiles import write_lines


def changed(base: Settings, **values) -> Settings:
    """A copy of settings with section__name=value put in."""
    out = copy.deepcopy(base)
    for dotted, value in values.items():
        section, _, name = dotted.partition("__")
        setattr(getattr(out, section), name, value)
    return out


def run(spark: SparkSession, settings: Settings, pdb_dir: str, pairfile: str, center: list[float] | None = None) -> dict:
    """Trains, and evaluates into eval/ below the run's folder; returns the report."""
    alphabet.train(spark, settings)
    out = settings.outputs.out_dir
    return alphabet.evaluate(spark, out, pdb_dir, pairfile, f"{out}/eval", center)


def compare_quantizers(spark: SparkSession, base: Settings, pdb_dir: str, pairfile: str, out: str, quantizers: tuple[str, ...] = ("vq", "fsq"), levels: tuple[int, ...] = (5, 4)) -> dict:
    """The same run with each quantizer, side by side in comparison_report.json and comparison.md."""
    for name in quantizers:
        run(spark, changed(base, model__quantizer=name, model__levels=list(levels) if name == "fsq" else None, outputs__out_dir=f"{out}/{name}"), pdb_dir, pairfile)
    return reporting.compare({name: f"{out}/{name}" for name in quantizers}, out)


def size_grid(spark: SparkSession, base: Settings, pdb_dir: str, pairfile: str, out: str, sizes: range = range(4, 41, 4)) -> DataFrame:
    """n_states, mi, mi_tot of a run for each number of states."""
    rows = []
    for n in sizes:
        report = run(spark, changed(base, model__n_states=n, outputs__out_dir=f"{out}/k{n}"), pdb_dir, pairfile)
        rows.append((n, report["mi"], report["mi_tot"]))
    return spark.createDataFrame(rows, "n_states int, mi double, mi_tot double")


def best_of_seeds(spark: SparkSession, base: Settings, seeds: list[int], out: str, sensitivities) -> int:
    """The seed whose run has the best sensitivities(model) -> (family, superfamily, fold) over their normalisers."""
    rows = [(seed, *sensitivities(alphabet.train(spark, changed(base, train__seed=seed, outputs__out_dir=f"{out}/seed{seed}")))) for seed in seeds]
    return search.best_seed(spark.createDataFrame(rows, "seed long, fam double, sfam double, fold double")).first()["seed"]


def cross_validate(spark: SparkSession, data: Settings, train: Settings, pairfile: str, folds: list[list[str]], out: str) -> DataFrame:
    """fold_id, mi, mi_tot: for each fold a dataset, a run and an evaluation whose alignments have both ids outside, or both within it."""
    rows = readers.pairfile(spark, pairfile)
    known = spark.createDataFrame([(sid, k) for k, ids in enumerate(folds, 1) for sid in ids], "sid string, fold_id int")
    found = []
    for k in range(1, len(folds) + 1):
        folder, files = f"{out}/fold{k}", {}
        os.makedirs(folder, exist_ok=True)
        for side, listed in (("train", F.col("fold_id") != k), ("val", F.col("fold_id") == k)):
            files[side] = f"{folder}/{side}_pairs.out"
            kept = readers.both_listed(rows, known.where(listed))
            write_lines(kept, F.concat_ws(" ", "sid1", "sid2", "cigar"), [F.col(c) for c in ("sid1", "sid2", "cigar", "source_row")], files[side])
        dataset.build(spark, changed(data, dataset__train_pairfile=files["train"], dataset__val_pairfile=files["val"], outputs__out_dir=f"{folder}/data"))
        report = run(spark, changed(train, data__processed_dir=f"{folder}/data", outputs__out_dir=f"{folder}/model"), data.dataset.pdb_dir, files["val"])
        found.append((k, report["mi"], report["mi_tot"]))
    return spark.createDataFrame(found, "fold_id int, mi double, mi_tot double")
