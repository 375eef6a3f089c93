"""Reports as dictionaries of small aggregates, and their Markdown."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.functions.geometry import separation_of
from foldline.operators import stats


def build(counts: dict, flat: DataFrame, meta: DataFrame, features: list[str], full: bool = False) -> dict:
    """One split's report: stage counts, feature statistics, examples by fold, superfamily and alignment."""
    found = {r["feature"]: r for r in stats.feature_stats(flat, features).collect()}
    some = found[features[0]]["mean"] is not None
    levels = lambda c: {r["level"]: r["n"] for r in stats.level_counts(meta, c).orderBy(F.desc("n"), "level").collect()}
    sizes = stats.group_size_quantiles(meta, "alignment_id").first().asDict()
    sizes["median"] = sizes.pop("p50")
    report = {
        "stage_counts": counts,
        "feature_stats": {name: [found[f][name] for f in features] if some else [] for name in ("mean", "std", "min", "max")},
        "examples_per_fold": levels("fold_source"),
        "examples_per_superfamily": levels("superfamily_source"),
        "examples_per_alignment": sizes if sizes["count"] else {},
    }
    if full:
        as_dict = lambda rows: {r["bin"]: r["n"] for r in rows.collect()}
        report["sequence_separation_histogram"] = as_dict(stats.separation_histogram(flat, separation_of(F.col(features[9]))))
        report["ca_distance_histogram"] = {"bins": as_dict(stats.distance_histogram(meta.where("ca_dist_superposed is not null"), "ca_dist_superposed"))}
    return report


def _rows(title: str, values: dict) -> list[str]:
    return [f"### {title}", "", "| | |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in values.items()), ""]


def markdown(report: dict) -> str:
    """A report of one split, or of several by name."""
    splits = {"": report} if "stage_counts" in report else report
    lines = ["# Dataset report", ""]
    for name, part in splits.items():
        if name:
            lines += [f"## {name}", ""]
        for key, value in part.items():
            title = key.replace("_", " ").capitalize()
            if key == "feature_stats":
                lines += [f"### {title}", "", "| feature | mean | std | min | max |", "| --- | --- | --- | --- | --- |"]
                lines += [f"| {k} | " + " | ".join(f"{x:.4f}" for x in row) + " |" for k, row in enumerate(zip(*value.values()))] + [""]
            else:
                lines += _rows(title, value.get("bins", value) if isinstance(value, dict) else {key: value})
    return "\n".join(lines)


def datacard(manifest: dict, report: dict) -> str:
    lines = [f"# {manifest['dataset_name']}", "", f"Made {manifest['created_at']} from commit {manifest['git_commit'] or 'unknown'}{' with changes' if manifest['git_dirty'] else ''}.", ""]
    lines += _rows("Inputs", {k: f"{v['path']} {v.get('sha256') or ''}".strip() for k, v in manifest["inputs"].items()})
    lines += _rows("Preprocessing", manifest["preprocessing"])
    for split, part in report.items():
        lines += _rows(f"Stages, {split}", part["stage_counts"])
    return "\n".join(lines)


COMPARED = ("val_loss", "state_entropy", "dead_states", "aligned_mi", "mi_tot")


def run_figures(folder: str) -> dict:
    """A run's figures from its training log and evaluation report; the loss is the least over epochs, which is the exported model's."""
    with open(f"{folder}/eval/evaluation_report.json") as f:
        report = json.load(f)
    log, loss = f"{folder}/train_log.csv", None
    if os.path.exists(log):
        with open(log, newline="") as f:
            loss = min((float(r["val_loss"]) for r in csv.DictReader(f)), default=None)
    names = {"state_entropy": "normalized_entropy", "dead_states": "dead_state_fraction", "aligned_mi": "mi", "mi_tot": "mi_tot", "submat_total_counts": "total_counts", "n_letters": "n_letters"}
    return {"val_loss": loss} | {k: report.get(v) for k, v in names.items()}


def compare(runs: dict[str, str], folder: str | None = None) -> dict:
    """Figures of runs side by side; with a folder, written as comparison_report.json and comparison.md."""
    found = {name: run_figures(path) for name, path in runs.items()}
    if folder:
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/comparison_report.json", "w") as f:
            json.dump(found, f, indent=2)
        head = [f"| metric | {' | '.join(found)} |", "| --- " * (len(found) + 1) + "|"]
        with open(f"{folder}/comparison.md", "w") as f:
            f.write("\n".join(["# Comparison of quantizers", "", *head, *(f"| {m} | {' | '.join(str(v.get(m)) for v in found.values())} |" for m in COMPARED)]) + "\n")
    return found
