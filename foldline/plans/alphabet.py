"""Training an alphabet, encoding structures with it, and evaluating it on alignments."""

from __future__ import annotations

import csv
import json
import os
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.operators import network, submat
from foldline.operators.network import Model
from foldline.plans import dataset
from foldline.plans.settings import Settings
from foldline.sources import readers, writers


def training_arrays(spark: SparkSession, folder: str) -> dict[str, np.ndarray]:
    """train_x .. val_y, from a built dataset's examples or from arrays in either layout."""
    if not os.path.isdir(f"{folder}/examples"):
        return readers.training_arrays(folder)
    rows, found = spark.read.parquet(f"{folder}/examples"), {}
    for split in ("train", "val"):
        part = rows.where(F.col("split") == split).orderBy("alignment_id", "dir", "k").select("x", "y").toArrow()
        for name in "xy":
            found[f"{split}_{name}"] = np.array(part[name].to_pylist(), dtype=np.float64).reshape(-1, network.FEATURES)
    return found


def scaler(folder: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The dataset's scaler if there is one (both of mean and std), else fitted on the training rows."""
    if os.path.exists(f"{folder}/scaler.json"):
        with open(f"{folder}/scaler.json") as f:
            found = json.load(f)
    elif os.path.exists(f"{folder}/scaler.npz"):
        found = dict(np.load(f"{folder}/scaler.npz"))
    else:
        return x.mean(0), np.maximum(x.std(0), 1e-6)
    if ("mean" in found) != ("std" in found):
        raise ValueError("a scaler needs both mean and std")
    return np.asarray(found["mean"], float), np.asarray(found["std"], float)


def kmeans_codes(spark: SparkSession, model: Model, x: np.ndarray, settings: Settings) -> np.ndarray:
    from foldline.operators.codebook import kmeans

    rows = x[: settings.train.kmeans_init_batches * settings.train.batch_size]
    z = model.encoder.forward((rows - model.mean) / model.std)
    frame = spark.createDataFrame([(v.tolist(),) for v in z], "z array<double>")
    return np.array([r["vec"] for r in kmeans(frame, model.config["n_states"], settings.train.kmeans_seed, cosine=settings.model.l2_normalize).orderBy("state").collect()])


def train(spark: SparkSession, settings: Settings) -> Model:
    """Trains on a processed folder and writes model, resolved settings and log below outputs.out_dir."""
    folder, out = settings.data.processed_dir, settings.outputs.out_dir
    data = training_arrays(spark, folder)
    kind = {"vq": "ema_vq"}.get(settings.model.quantizer, settings.model.quantizer)
    model = Model.fresh(settings.train.seed, kind, settings.model.levels, settings.model.n_states, settings.model.z_dim, dataset.provenance(folder), settings.model.hidden_dim, settings.model.input_dim, settings.model.l2_normalize)
    model.mean, model.std = scaler(folder, data["train_x"])
    if model.codes is not None and settings.train.kmeans_init:
        model.codes = kmeans_codes(spark, model, data["train_x"], settings)
    t = settings.train
    log = network.train(model, (data["train_x"], data["train_y"]), (data["val_x"], data["val_y"]), epochs=t.max_epochs, batch=t.batch_size, lr=t.lr, decay=t.weight_decay, loss=settings.model.loss, scheduler=t.scheduler, patience=t.patience, commitment=settings.model.commitment_cost, seed=t.seed, clip_norm=t.clip_grad_norm, ema_decay=settings.model.decay, min_count=settings.model.min_count, warm_up=settings.model.replacement_warmup_steps)
    model.save(out)
    writers.json_file(settings.as_dict() | {"config_hash": settings.hash()}, f"{out}/run_config.resolved.json")
    with open(f"{out}/train_log.csv", "w", newline="") as f:
        table = csv.DictWriter(f, list(log[-1]))
        table.writeheader()
        table.writerows(log)
    return model


def encode(files: DataFrame, model: Model, center: list[float]) -> DataFrame:
    """sid, seq of structure files (sid, content)."""
    described = dataset.descriptors(readers.residues(files), center)
    return network.sequences(network.encode_states(described.select("sid", "idx", "feat"), model))


def center_of(model: Model, given: list[float] | None) -> list[float]:
    center = given or model.config.get("virtual_center")
    if not center:
        raise ValueError("the model does not record a virtual center; give one")
    return [float(x) for x in center]


def evaluate(spark: SparkSession, model_dir: str, pdb_dir: str, pairfile: str, out: str, center: list[float] | None = None, max_failure_rate: float = 1.0) -> dict:
    """Writes sequences.txt, submat.txt and evaluation_report.json; returns the report."""
    model = Model.load(model_dir)
    rows = readers.pairfile(spark, pairfile).withColumn("alignment_id", F.col("source_row").cast("string"))
    wanted = rows.select(F.col("sid1").alias("sid")).union(rows.select("sid2")).distinct()
    files = readers.structure_files(spark, pdb_dir).join(wanted, "sid", "left_semi")
    os.makedirs(out, exist_ok=True)
    encoded = encode(files, model, center_of(model, center)).cache()
    n, made = wanted.count(), encoded.count()
    if n and (n - made) / n > max_failure_rate:
        raise RuntimeError(f"{n - made} of {n} structures could not be encoded, more than {max_failure_rate:.2%}")
    writers.sequences(encoded, f"{out}/sequences.txt")
    for r in missing_sequences(rows, encoded).collect():
        print(f"no sequence for {r['sid1']} or {r['sid2']}; the alignment is left out", file=sys.stderr)
    report = score(spark, rows, encoded, model.config["letters"], f"{out}/submat.txt")
    writers.json_file(report, f"{out}/evaluation_report.json")
    return report


def score(spark: SparkSession, alignments: DataFrame, sequences: DataFrame, letters: str, matrix_path: str | None = None) -> dict:
    """The figures of an alphabet from alignments (alignment_id, sid1, sid2, cigar) and sequences (sid, seq)."""
    pairs = submat.aligned_letters(alignments, sequences)
    by_kind = submat.counts_by_kind(pairs, letters).cache()
    counts = by_kind.where("kind = 'aligned'").drop("kind")
    alphabet = spark.createDataFrame([(c,) for c in letters], "letter string")
    if matrix_path:
        writers.matrix(submat.scores(counts, alphabet), matrix_path)
    mi = submat.adjusted_information(by_kind).first()
    used = {r["letter"]: r["n"] for r in submat.usage(sequences, alphabet).collect()}
    facts = submat.diagnostics(spark.createDataFrame(list(used.items()), "letter string, n long")).first()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return {
        "n_sequences": sequences.count(), "total_counts": total, "mi": mi["mi"], "mi_tot": mi["mi_adjusted"] if total else 0.0, "n_letters": len(letters), "letters": letters,
        "state_usage": [used[c] for c in letters], "dead_state_fraction": facts["dead_fraction"], "normalized_entropy": facts["normalized_entropy"],
    }


def missing_sequences(alignments: DataFrame, sequences: DataFrame, most: int = 100) -> DataFrame:
    """The first alignments whose sequences are not both there."""
    known = sequences.where("seq <> ''")
    lacks = lambda sid: alignments.join(known.select(F.col("sid").alias(sid)), sid, "left_anti").select(*alignments.columns)
    return lacks("sid1").union(lacks("sid2")).distinct().orderBy("sid1", "sid2", *alignments.columns).limit(most)


def grid(spark: SparkSession, settings: list[Settings], assess) -> DataFrame:
    """Trains a run for each settings (folds, alphabet sizes, seeds) and collects assess(model) -> figures, a row each."""
    rows = []
    for k, one in enumerate(settings):
        model = train(spark, one)
        rows.append({"run": k, "seed": one.train.seed, "n_states": model.config["n_states"]} | assess(model))
    return spark.createDataFrame(rows)


__all__ = ["center_of", "encode", "evaluate", "grid", "missing_sequences", "score", "train", "training_arrays"]
