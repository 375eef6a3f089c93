"""Writers: tables, reports, manifests, sequences, matrices, splits. Reports go to the driver's disk; tables and text of any length are written by many tasks."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.sources.arrayfiles import write_array
from foldline.sources.opened import place
from foldline.sources.textfiles import write_lines

ARTEFACTS = ("descriptors", "examples", "pair_metadata", "structures", "skipped_alignments.tsv", "report.json", "report.md", "manifest.json", "DATACARD.md", "scaler.json")


def prepare_folder(folder: str, force: bool = False) -> None:
    """Refuses a folder that holds anything, unless force, which removes the known artefacts of an earlier run and nothing else."""
    if os.path.isdir(folder) and os.listdir(folder):
        if not force:
            raise FileExistsError(f"{folder} is not empty; use force to overwrite")
        import shutil

        for name in ARTEFACTS:
            path = f"{folder}/{name}"
            shutil.rmtree(path) if os.path.isdir(path) else os.path.exists(path) and os.remove(path)
    os.makedirs(folder, exist_ok=True)


def table(rows: DataFrame, path: str, partition: str | None = None) -> None:
    writer = rows.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def tsv(rows: DataFrame, order: list[Column], path: str) -> None:
    """One file of tabs with a header, in the order given; with no rows, the header alone. Nulls are empty; fields with tabs, quotes or line ends are quoted."""
    options = {"sep": "\t", "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    write_lines(rows, F.to_csv(F.struct(*rows.columns), options), order, path, "\t".join(rows.columns))


def made_folder(folder: str) -> None:
    """Makes a folder, given by a path or a URI, and those above it."""
    system, at = place(folder)
    system.create_dir(at, recursive=True)


def append_run(rows: DataFrame, run: str, path: str) -> None:
    """Adds rows to the log at path under the name of their run; a run that is there already is replaced, others stay."""
    named = rows.withColumn("run", F.lit(run))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("run").parquet(path)


def json_file(value: dict, path: str) -> None:
    """Strict JSON: NaN is an error."""
    with open(path, "w") as f:
        json.dump(value, f, indent=2, allow_nan=False)
        f.write("\n")


def sequences(rows: DataFrame, path: str) -> None:
    """sid and seq, sorted by sid."""
    write_lines(rows, F.concat_ws(" ", "sid", "seq"), [F.col("sid")], path)


def fasta(rows: DataFrame, path: str, parts: int = 30) -> None:
    """Records dealt over part files; none is cut."""
    rows.repartition(parts, "sid").select(F.concat(F.lit(">"), "sid", F.lit("\n"), "seq").alias("value")).write.text(path)


def matrix(scores: DataFrame, path: str) -> None:
    from foldline.operators.submat import matrix_lines

    write_lines(matrix_lines(scores), F.col("value"), [F.col("line_no")], path)


def with_invalid_letter(scores: DataFrame, letter: str = "X") -> DataFrame:
    """scores with a row and column of zeros for a letter more, whatever the number of letters."""
    others = scores.select(F.col("a").alias("l")).distinct()
    row = others.select(F.lit(letter).alias("a"), F.col("l").alias("b"), F.lit(0).alias("score"))
    column = others.select(F.col("l").alias("a"), F.lit(letter).alias("b"), F.lit(0).alias("score"))
    corner = scores.sparkSession.createDataFrame([(letter, letter, 0)], "a string, b string, score int")
    return scores.select("a", "b", "score").union(row).union(column).union(corner)


def split_manifests(rows: DataFrame, folder: str) -> None:
    """structure_id, group_id, split: a CSV folder for each split."""
    for split in ("train", "val"):
        rows.where(F.col("split") == split).select(F.col("sid").alias("structure_id"), "group_id", "split").write.option("header", True).csv(f"{folder}/{split}_manifest")


def fold_files(folds: list[list[str]], folder: str) -> None:
    """fold_1.txt and on: ids by line, without a line end after the last."""
    os.makedirs(folder, exist_ok=True)
    for k, ids in enumerate(folds, 1):
        with open(f"{folder}/fold_{k}.txt", "w") as f:
            f.write("\n".join(ids))


def arrays(examples: DataFrame, folder: str) -> None:
    """{split}_{x,y}_raw.npy from examples (split, alignment_id, dir, k, x, y), forward rows of an alignment before mirrored ones; written by the tasks."""
    keys = ("alignment_id", "dir", "k")
    for split in ("train", "val"):
        for name in ("x", "y"):
            write_array(examples.where(F.col("split") == split).select(*keys, name), name, [F.col(c) for c in keys], f"{folder}/{split}_{name}_raw.npy")


def file_hash(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def array_hash(a: np.ndarray) -> str:
    return hashlib.sha256(f"{a.dtype.str}{a.shape}".encode() + np.ascontiguousarray(a).tobytes()).hexdigest()


def git_state(folder: str = ".") -> dict:
    """Commit and whether there are changes; None and False where git does not tell."""

    def ask(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True).stdout.strip()
        except (OSError, subprocess.CalledProcessError):
            return None

    return {"git_commit": ask("rev-parse", "HEAD"), "git_dirty": bool(ask("status", "--porcelain"))}


def archive_manifest(rows: DataFrame, folder: str) -> dict:
    """manifest.tsv and summary.json of discovered structure files; returns the summary."""
    tsv(rows.select("sid", "path", "size_bytes", "sha256"), [F.col("sid")], f"{folder}/manifest.tsv")
    total = rows.agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).first()
    summary = {"n_structures": total["n"], "total_structure_bytes": total["bytes"] or 0, "sid_examples": [r["sid"] for r in rows.orderBy("sid").limit(10).collect()]}
    json_file(summary, f"{folder}/summary.json")
    return summary
