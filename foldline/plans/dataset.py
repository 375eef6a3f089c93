"""Building the training tables: one plan from alignments and structure files to mirrored pairs and metadata."""

from __future__ import annotations

import datetime
import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.functions import cigar, geometry, hierarchy
from foldline.operators import neighbors, pairs, stats
from foldline.plans import reporting
from foldline.plans.settings import Settings
from foldline.sources import readers, writers

FEATURES = [f"f{k}" for k in range(10)]


def descriptors(residues: DataFrame, center: list[float]) -> DataFrame:
    """residues with feat (array<float> of ten, null where not whole) and the partner by the moved side-chain atom.

    residues: sid, idx, valid, ca, cb, n, c.
    """
    ca, cb, n = (geometry.vector(c) for c in ("ca", "cb", "n"))
    moved = F.array(*geometry.virtual_center(ca, cb, n, *center))
    # A lambda's variable holds the moved atom, so that the long expression stands in the plan once.
    at = F.get(F.transform(F.array(moved), lambda v: F.struct(*(F.get(v, F.lit(k)).alias(f"v_{d}") for k, d in enumerate("xyz")))), F.lit(0))
    rows = residues.select("sid", F.col("sid").alias("chain"), "idx", "valid", F.transform("ca", lambda x: x.cast("double")).alias("ca"), at.alias("v")).select("*", "v.*")
    partners = neighbors.nearest(rows, ["v_x", "v_y", "v_z"])
    found = neighbors.descriptors(rows, partners).select(F.col("chain").alias("sid"), "idx", "partner", F.array(*(F.col(f).cast("float") for f in FEATURES)).alias("feat"))
    return residues.join(found, ["sid", "idx"], "left")


def aligned(alignments: DataFrame, described: DataFrame) -> DataFrame:
    """Residue pairs of alignments whose descriptors are both whole: x_feat, y_feat, x_ca, y_ca."""
    rows = described.select("sid", "idx", F.col("feat").isNotNull().alias("valid"), "feat", "ca")
    return pairs.with_residues(pairs.expand(alignments), rows)


def with_errors(alignments: DataFrame, known: DataFrame) -> DataFrame:
    """alignments with error_type and error: a structure that is not known (sid), or an operation that is not; null if all is well."""
    files = known.select("sid").distinct()
    rows = alignments.join(files.select(F.col("sid").alias("sid1"), F.lit(True).alias("has1")), "sid1", "left").join(files.select(F.col("sid").alias("sid2"), F.lit(True).alias("has2")), "sid2", "left")
    error = F.when(F.col("has1").isNull(), F.concat(F.lit("no structure file for "), "sid1")).when(F.col("has2").isNull(), F.concat(F.lit("no structure file for "), "sid2"))
    bad = F.when(~F.col("cigar").rlike(r"^[^A-Za-z]*([0-9]*[IDMP][^A-Za-z]*)*$"), F.lit("operation not supported"))
    return rows.withColumns({"error": F.coalesce(error, bad), "error_type": F.when(error.isNotNull(), "FileNotFoundError").when(bad.isNotNull(), "ValueError")}).drop("has1", "has2")


def examples(alignments: DataFrame, described: DataFrame, known: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Mirrored pairs, and a row for each alignment with its counts by stage, status and error.

    known: sid of structures that could be read. An alignment that lacks one is an error, not a failure.
    """
    rows = with_errors(alignments, known)
    met = pairs.superposed(aligned(rows.where("error is null").drop("error", "error_type"), described)).persist()
    near = pairs.within(met, settings.features.max_ca_dist)
    kept = pairs.capped(near, settings.sampling.max_pairs_per_alignment, settings.sampling.seed)
    count = lambda df, name: df.groupBy("alignment_id").agg(F.count("*").alias(name))
    valid = met.groupBy("alignment_id").agg(F.count("*").alias("after_valid"), F.first("status").alias("status"))
    per = rows.withColumn("pairs", F.when(F.col("error").isNull(), cigar.pair_count("cigar"))).join(valid, "alignment_id", "left").join(count(near, "after_distance"), "alignment_id", "left").join(count(kept, "after_cap"), "alignment_id", "left")
    per = per.na.fill(0, ["after_valid", "after_distance", "after_cap"])
    # No valid pair at all of an alignment that has pairs is degenerate too.
    per = per.withColumn("status", F.when((F.col("after_valid") == 0) & (F.col("pairs") > 0), pairs.TOO_FEW).otherwise(F.col("status")))
    raw = pairs.raw_distance(kept).select("alignment_id", "sid1", "sid2", "k", "i", "j", F.col("x_feat").alias("x"), F.col("y_feat").alias("y"), "ca_dist_raw", "ca_dist")
    return pairs.mirrored(raw, [("sid1", "sid2"), ("i", "j"), ("x", "y")]), per


def validate(spark: SparkSession, settings: Settings) -> dict:
    """Checks alignment strings against the structures' lengths; up to ten errors are raised together. Missing pairfiles are skipped."""
    found = [readers.pairfile(spark, p).withColumn("file", F.lit(p)) for p in (settings.dataset.train_pairfile, settings.dataset.val_pairfile) if os.path.exists(p)]
    if not found:
        return {"n_alignments": 0, "n_structures": 0, "n_structures_not_ok": 0, "n_cigars_checked": 0}
    rows = found[0] if len(found) == 1 else found[0].union(found[1])
    wanted = rows.select(F.col("sid1").alias("sid")).union(rows.select("sid2")).distinct()
    qc = readers.structure_qc(wanted, readers.structure_files(spark, settings.dataset.pdb_dir)).cache()
    return check_alignments(rows, qc)


def check_alignments(rows: DataFrame, qc: DataFrame) -> dict:
    """validate() on tables: alignments (file, source_row, sid1, sid2, cigar) and structure QC."""
    size = lambda sid, n: qc.select(F.col("sid").alias(sid), F.col("n_residues").alias(n))
    met = rows.join(size("sid1", "n1"), "sid1", "left").join(size("sid2", "n2"), "sid2", "left").na.fill(0, ["n1", "n2"])
    checked = met.where("n1 > 0 and n2 > 0").withColumn("problem", cigar.problem("cigar", F.col("n1"), F.col("n2")))
    bad = checked.where("problem is not null").orderBy("file", "source_row").limit(10).collect()
    if bad:
        raise ValueError("invalid alignments: " + "; ".join(f"{r['file']}:{r['source_row']} {r['sid1']} {r['sid2']} {r['problem']}" for r in bad))
    facts = qc.agg(F.count("*").alias("n"), F.count_if(F.col("parse_status") != "ok").alias("bad")).first()
    return {"n_alignments": rows.count(), "n_structures": facts["n"], "n_structures_not_ok": facts["bad"], "n_cigars_checked": checked.count()}


def fails(counts: dict, strict: bool, most: float) -> str | None:
    """Why errors end the run: any with strict, else more than the share allowed."""
    errored, total = counts["errored"], counts["alignments"]
    if strict:
        return f"{errored} of {total} alignments were skipped" if errored else None
    return f"{errored} of {total} alignments were skipped, more than {most:.2%}" if total and errored / total > most else None


def build(spark: SparkSession, settings: Settings, force: bool = False) -> dict:
    """Writes examples, metadata, structure QC, skipped alignments, scaler, report, manifest and datacard; returns the manifest.

    settings.outputs.out_dir holds the text artefacts and is a path that the driver and the executors share.
    """
    out = settings.outputs.out_dir
    writers.prepare_folder(out, force)
    paths = {"train": settings.dataset.train_pairfile, "val": settings.dataset.val_pairfile}
    for p in paths.values():
        if not os.path.exists(p):
            raise FileNotFoundError(p)
    lookup = readers.class_lookup(spark, settings.dataset.scop_lookup)
    files = readers.structure_files(spark, settings.dataset.pdb_dir)
    both = None
    for split, p in paths.items():
        stem = os.path.splitext(os.path.basename(p))[0]
        rows = readers.pairfile(spark, p).select(F.lit(split).alias("split"), F.lit(p).alias("file"), hierarchy.alignment_id(stem, F.col("source_row"), F.col("sid1"), F.col("sid2")).alias("alignment_id"), "source_row", "sid1", "sid2", "cigar")
        both = rows if both is None else both.union(rows)
    wanted = both.select(F.col("sid1").alias("sid")).union(both.select("sid2")).distinct()
    for r in readers.further_parts(files.join(wanted, "sid", "left_semi")).orderBy("sid").limit(10).collect():
        warnings.warn(f"{r['sid']}: {r['n_models']} models, {r['n_chains']} chains; only the first of each is read", stacklevel=2)
    writers.table(readers.structure_qc(wanted, files).orderBy("sid"), f"{out}/structures")
    qc = spark.read.parquet(f"{out}/structures")
    if settings.preprocessing.validate_cigars:
        check_alignments(both, qc)
    residues = readers.residues(files.join(wanted, "sid", "left_semi"))
    # A structure's descriptors are made once and read by every alignment that it is in.
    writers.table(descriptors(residues, settings.features.virtual_center), f"{out}/descriptors")
    described = spark.read.parquet(f"{out}/descriptors")
    rows, per = examples(both.drop("file"), described, qc.where("parse_status <> 'missing_file' and parse_status not like 'parse_error%'"), settings)
    rows = rows.join(both.select("alignment_id", "split"), "alignment_id")
    writers.table(rows, f"{out}/examples", partition="split")
    rows = spark.read.parquet(f"{out}/examples")
    per = per.cache()
    writers.tsv(per.where("error is not null").select("split", "source_row", "sid1", "sid2", "cigar", "error_type", "error"), [F.col(c) for c in ("split", "sid1", "sid2", "cigar", "source_row")], f"{out}/skipped_alignments.tsv")
    meta = pairs.pair_metadata(rows.select("split", "alignment_id", "sid1", "sid2", "i", "j", "ca_dist_raw", "ca_dist"), lookup)
    writers.table(meta.join(both.select("alignment_id", "split"), "alignment_id"), f"{out}/pair_metadata", partition="split")
    meta = spark.read.parquet(f"{out}/pair_metadata")
    counts = {}
    for split in paths:
        counts[split] = stats.stage_counts(per.where(F.col("split") == split)).first().asDict()
        if why := fails(counts[split], settings.preprocessing.fail_on_skipped_alignments, settings.preprocessing.max_skipped_fraction):
            raise RuntimeError(f"{split}: {why}")
    flat = rows.select("split", *(F.get("x", F.lit(k)).cast("double").alias(f) for k, f in enumerate(FEATURES)))
    scaler = {r["feature"]: r for r in stats.standardizer(flat.where("split = 'train'"), FEATURES).collect()}
    value = lambda f, name, empty: empty if scaler[f][name] is None else float(scaler[f][name])
    writers.json_file({"mean": [value(f, "mean", 0.0) for f in FEATURES], "std": [value(f, "std", 1.0) for f in FEATURES]}, f"{out}/scaler.json")
    report = {s: reporting.build(counts[s], flat.where(F.col("split") == s), meta.where(F.col("split") == s), FEATURES, settings.preprocessing.full_report) for s in paths}
    writers.json_file(report, f"{out}/report.json")
    with open(f"{out}/report.md", "w") as f:
        f.write(reporting.markdown(report))
    manifest = {
        "dataset_name": settings.dataset.name,
        "inputs": {"pdb_dir": {"path": settings.dataset.pdb_dir}} | {name: {"path": p, "sha256": writers.file_hash(p) if os.path.exists(p) else None} for name, p in (("train_pairfile", paths["train"]), ("val_pairfile", paths["val"]), ("scop_lookup", settings.dataset.scop_lookup)) if p},
        "outputs": {name: {"sha256": writers.file_hash(f"{out}/{name}")} for name in ("skipped_alignments.tsv", "report.json", "report.md", "scaler.json")} | {"examples": {"rows": rows.count(), "content": table_hash(rows)}},
        "preprocessing": {"virtual_center": settings.features.virtual_center, "sequence_delta_convention": settings.features.sequence_delta_convention, "max_ca_dist": settings.features.max_ca_dist, "max_pairs_per_alignment": settings.sampling.max_pairs_per_alignment, "seed": settings.sampling.seed, "standardization": "zscore_train_fit", "fail_on_skipped_alignments": settings.preprocessing.fail_on_skipped_alignments, "max_skipped_fraction": settings.preprocessing.max_skipped_fraction},
        "config_hash": settings.hash(), "created_at": datetime.datetime.now(datetime.UTC).isoformat(),
    } | writers.git_state()
    writers.json_file(manifest, f"{out}/manifest.json")
    with open(f"{out}/DATACARD.md", "w") as f:
        f.write(reporting.datacard(manifest, report))
    return manifest


def table_hash(rows: DataFrame) -> str:
    """A hash of a table's rows in any order."""
    return str(rows.select(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)").alias("h")).agg(F.sum("h")).first()[0])


def provenance(folder: str) -> dict:
    """virtual_center and max_ca_dist of a built dataset, from its manifest."""
    import json

    path = f"{folder}/manifest.json"
    if not os.path.exists(path):
        return {}
    with open(path) as f:
        made = json.load(f).get("preprocessing", {})
    return {k: made.get(k) for k in ("virtual_center", "max_ca_dist")}
