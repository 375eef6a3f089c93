"""Readers: pairfiles, structure files, class lookups, id lists, sequences, matrices, arrays."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.functions.hierarchy import sid_of_path


def line_tokens(value: str | Column) -> Column:
    """Words of a line, at any white space."""
    v = F.col(value) if isinstance(value, str) else value
    return F.split(F.regexp_replace(v, r"^\s+|\s+$", ""), r"\s+")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """source_row, value: every line of a file with its place from 0, empty ones too; of several files, each from 0.

    A file is read in its splits. Rows of one split stand one after the other, so a line's place is its split's first place, from a
    row per split, and its distance from the split's first row.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    splits = rows.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(splits, ["file", "block"]).select((F.col("base") + F.col("row") - F.col("first")).alias("source_row"), F.regexp_replace("value", "\r$", "").alias("value"))


def pairfile(spark: SparkSession, path: str) -> DataFrame:
    """source_row, sid1, sid2, cigar of lines with at least three words, of which the last is the alignment; sort by sid1, sid2, cigar, source_row for the fixed order."""
    rows = numbered_lines(spark, path).select("source_row", line_tokens("value").alias("t")).where(F.size("t") >= 3)
    return rows.select("source_row", F.element_at("t", 1).alias("sid1"), F.element_at("t", 2).alias("sid2"), F.element_at("t", -1).alias("cigar"))


def class_lookup(spark: SparkSession, path: str | None) -> DataFrame:
    """sid, class; the last line of an id counts; no path or file gives no rows."""
    if not path or "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], "sid string, class string")
    rows = numbered_lines(spark, path).select("source_row", line_tokens("value").alias("t")).where(F.size("t") >= 2)
    return rows.groupBy(F.element_at("t", 1).alias("sid")).agg(F.max_by(F.element_at("t", 2), "source_row").alias("class"))


def class_list(spark: SparkSession, path: str) -> DataFrame:
    """position, sid, class in the file's order."""
    rows = numbered_lines(spark, path).select("source_row", line_tokens("value").alias("t")).where(F.size("t") >= 2)
    return rows.select(F.col("source_row").alias("position"), F.element_at("t", 1).alias("sid"), F.element_at("t", 2).alias("class"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """position, sid: the first word of each line; blank and # lines are left out."""
    rows = numbered_lines(spark, path).where(r"value rlike '\\S' and not value rlike '^\\s*#'")
    return rows.select(F.col("source_row").alias("position"), F.element_at(line_tokens("value"), 1).alias("sid"))


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """sid, seq; the last line of an id counts."""
    rows = numbered_lines(spark, path).select("source_row", line_tokens("value").alias("t")).where(F.size("t") >= 2)
    return rows.groupBy(F.element_at("t", 1).alias("sid")).agg(F.max_by(F.element_at("t", 2), "source_row").alias("seq"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """sid, seq of every record of one or more files: the name line's first word, and the lines below it as one; a file is read in its splits."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where("value <> ''")
    name, body = F.regexp_extract("value", r"^[^\n]*", 0), F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1)
    return records.select(F.element_at(line_tokens(name), 1).alias("sid"), F.regexp_replace(body, r"\s+", "").alias("seq"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """a, b, score of a matrix in text: a line of letters, then a letter and its scores; # lines are left out. Letters keep their case."""
    rows = numbered_lines(spark, path).where(r"value rlike '\\S' and not value rlike '^#'").select("source_row", line_tokens("value").alias("t"))
    head = rows.orderBy("source_row").limit(1).select(F.col("source_row").alias("h"), F.col("t").alias("letters"))
    body = rows.crossJoin(F.broadcast(head)).where("source_row > h")
    return body.select(F.element_at("t", 1).alias("a"), F.explode(F.arrays_zip("letters", F.slice("t", 2, 10_000).alias("scores"))).alias("c")).select("a", F.col("c.letters").alias("b"), F.col("c.scores").cast("int").alias("score"))


def both_listed(alignments: DataFrame, listed: DataFrame) -> DataFrame:
    """Alignments of which both ids are listed (sid)."""
    return alignments.join(listed.select(F.col("sid").alias("sid1")), "sid1", "left_semi").join(listed.select(F.col("sid").alias("sid2")), "sid2", "left_semi").select(*alignments.columns)


def structure_files(spark: SparkSession, folder: str) -> DataFrame:
    """sid, path, content, length: files named by id or id.pdb; of both, the one without extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.withColumns({"name": F.regexp_extract("path", r"([^/]+)$", 1)}).where("not name like '.%'").withColumn("sid", F.regexp_replace("name", r"\.pdb$", ""))
    place = F.row_number().over(Window.partitionBy("sid").orderBy(F.length("name"), "path"))
    return files.select("sid", "path", "content", "length", "name").withColumn("_p", place).where("_p = 1").drop("_p", "name")


def looks_like_domain(path: str | Column) -> Column:
    """The file's name begins with d or ends with .pdb or .ent, and not with a dot."""
    name = F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"([^/]+)$", 1)
    return name.rlike(r"^d|\.(pdb|ent)$") & ~name.startswith(".")


def concatenated(spark: SparkSession, path: str, header: str) -> DataFrame:
    """value: the lines of all files at path but those that match the header."""
    return spark.read.text(path).where(~F.col("value").rlike(header))


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    """sid, path, size_bytes, sha256 of files below folder that look like domains; an id twice, or none at all, is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = files.where(looks_like_domain("path")).select(sid_of_path("path").alias("sid"), "path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    twice = rows.groupBy("sid").count().where("count > 1").orderBy("sid").limit(10).collect()
    if twice:
        raise ValueError(f"more than one file for {', '.join(r['sid'] for r in twice)}")
    if rows.limit(1).count() == 0:
        raise ValueError(f"no structure files below {folder}")
    return rows


ATOMS = ("N", "CA", "C", "CB")


def parse_structure(content: bytes | str) -> tuple[list[dict], dict]:
    """Residues of the first chain of the first model, in order, and facts (chains, chain).

    A residue is known by hetero flag, number and insertion code. Of alternate locations the one of highest
    occupancy counts, the first of equals. A residue's atoms are name -> list of positions.
    """
    text = content.decode("ascii", "replace") if isinstance(content, bytes | bytearray) else content
    chains: dict[str, dict[tuple, dict]] = {}
    models = 0
    for line in text.splitlines():
        kind = line[:6]
        if kind == "MODEL ":
            models += 1
            if models > 1:
                break
        if kind not in ("ATOM  ", "HETATM"):
            if kind == "ENDMDL":
                break
            continue
        name, alt, chain = line[12:16].strip(), line[16:17].strip(), line[21:22]
        key = (kind == "HETATM", int(line[22:26]), line[26:27].strip())
        residue = chains.setdefault(chain, {}).setdefault(key, {"resname": line[17:20].strip(), "is_het": key[0], "resseq": key[1], "icode": key[2], "atoms": {}, "best": {}})
        position = (float(line[30:38]), float(line[38:46]), float(line[46:54]))
        occupancy = float(line[54:60]) if line[54:60].strip() else 1.0
        if alt:
            if occupancy > residue["best"].get(name, -1.0):
                residue["best"][name] = occupancy
                residue["atoms"][name] = [position]
        elif name in residue["best"] or name not in residue["atoms"]:
            residue["atoms"].setdefault(name, [position])
    first = next(iter(chains), None)
    return list(chains.get(first, {}).values()), {"n_chains": len(chains), "chain": first, "models": max(models, int(bool(chains)))}


def place_cb(ca: np.ndarray, n: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The NumPy twin of functions.geometry.approx_cb."""
    with np.errstate(all="ignore"):
        v1, v2 = (c - ca) / np.linalg.norm(c - ca), (n - ca) / np.linalg.norm(n - ca)
        b1 = v2 + v1 / 3
        b2 = np.cross(v1, b1)
        u1, u2 = b1 / np.linalg.norm(b1), b2 / np.linalg.norm(b2)
        return ca + 1.5336 * (-v1 / 3 + np.sqrt(8) / 3 * np.linalg.norm(v1) * (-u1 / 2 - np.sqrt(3) / 2 * u2))


def residue_row(residue: dict, full: bool = True) -> dict:
    """ca, cb, n, c (None where missing) and valid. Hetero residues keep their place without coordinates."""
    atoms = {} if residue["is_het"] else residue["atoms"]
    one = lambda name: np.array(atoms[name][0]) if len(atoms.get(name, ())) == 1 else None
    ca, n, c = one("CA"), one("N"), one("C")
    cb = np.array(atoms["CB"][0]) if atoms.get("CB") and residue["resname"] != "GLY" else None
    if cb is None and ca is not None and n is not None and c is not None:
        cb = place_cb(ca, n, c)
    if n is None or c is None:
        n = c = None
    found = {"ca": ca, "cb": cb, "n": n, "c": c}
    needed = found if full else {"ca": ca, "cb": cb}
    rows = {k: None if v is None or not np.isfinite(v).all() else [float(np.float32(x)) for x in v] for k, v in found.items()}
    return rows | {"valid": all(rows[k] is not None for k in needed)}


RESIDUES = "sid string, idx int, resname string, is_het boolean, ca array<float>, cb array<float>, n array<float>, c array<float>, valid boolean"
QC = "sid string, path string, n_residues int, n_valid_residues int, valid_fraction double, n_chains int, selected_chain string, has_missing_ca boolean, has_missing_backbone boolean, sha256 string, parse_status string"


def residues(files: DataFrame, full: bool = True) -> DataFrame:
    """A row per residue of each file (sid, content) that can be parsed; a file is small, and files are dealt over tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESIDUES.split(", ")]
        for batch in batches:
            rows = []
            for sid, content in zip(batch["sid"], batch["content"]):
                try:
                    found, _ = parse_structure(content)
                except ValueError:
                    continue
                rows += [{"sid": sid, "idx": k, "resname": r["resname"], "is_het": r["is_het"]} | residue_row(r, full) for k, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("sid", "content").mapInPandas(run, RESIDUES)


def structure_qc(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each wanted sid: counts, completeness and status, never an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in QC.split(", ")]
        for batch in batches:
            rows = []
            for sid, path, content, digest in zip(batch["sid"], batch["path"], batch["content"], batch["sha256"]):
                row = dict.fromkeys(names) | {"sid": sid, "path": path, "n_residues": 0, "n_valid_residues": 0, "valid_fraction": 0.0, "n_chains": 0, "has_missing_ca": True, "has_missing_backbone": True, "sha256": digest}
                if path is None:
                    rows.append(row | {"parse_status": "missing_file"})
                    continue
                try:
                    found, facts = parse_structure(content)
                except ValueError as e:
                    rows.append(row | {"parse_status": f"parse_error: {type(e).__name__}"})
                    continue
                if not facts["n_chains"]:
                    rows.append(row | {"parse_status": "no_chains"})
                    continue
                coords = [residue_row(r) for r in found]
                standard = [c for c, r in zip(coords, found) if not r["is_het"]]
                valid = sum(c["valid"] for c in coords)
                rows.append(row | {
                    "n_residues": len(found), "n_valid_residues": valid, "valid_fraction": valid / len(found) if found else 0.0, "n_chains": facts["n_chains"], "selected_chain": facts["chain"],
                    "has_missing_ca": any(c["ca"] is None for c in standard) or not standard,
                    "has_missing_backbone": any(c[k] is None for c in standard for k in ("ca", "n", "c")) or not standard,
                    "parse_status": "ok" if valid else "no_valid_residues",
                })
            yield pd.DataFrame(rows, columns=names).astype({"n_residues": "int32", "n_valid_residues": "int32", "n_chains": "int32"})

    found = wanted.select("sid").distinct().join(files.select("sid", "path", "content"), "sid", "left")
    return found.withColumn("sha256", F.sha2("content", 256)).mapInPandas(run, QC)


def further_parts(files: DataFrame) -> DataFrame:
    """sid, n_models, n_chains of files with more than one model or chain, of which only the first is read."""
    text = F.col("content").cast("string")
    chain = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^(?:ATOM  |HETATM).{15}(.)"), F.lit(1)), lambda c: c))
    found = files.select("sid", F.size(F.regexp_extract_all(text, F.lit(r"(?m)^(MODEL )"), F.lit(1))).alias("n_models"), F.size(chain).alias("n_chains"))
    return found.where("n_models > 1 or n_chains > 1")


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """name, row, values of .npy and .npz files at path, first axis as rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                loaded = np.load(io.BytesIO(content))
                stem = re.sub(r"\.np[yz]$", "", file.rsplit("/", 1)[-1])
                for name, a in loaded.items() if hasattr(loaded, "items") else [(stem, loaded)]:
                    flat = np.atleast_1d(a).astype(np.float64)
                    flat = flat.reshape(len(flat), -1) if flat.ndim > 1 else flat.reshape(1, -1)
                    yield pd.DataFrame({"name": name, "row": np.arange(len(flat)), "values": list(flat)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "name string, row long, values array<double>")


def training_arrays(folder: str) -> dict[str, np.ndarray]:
    """train_x, train_y, val_x, val_y of a directory on the driver, in either layout; validation data is never taken from training."""
    if os.path.exists(f"{folder}/train_x_raw.npy"):
        return {f"{s}_{a}": np.load(f"{folder}/{s}_{a}_raw.npy") for s in ("train", "val") for a in "xy"}
    train, val = np.load(f"{folder}/data.npy"), np.load(f"{folder}/val/data.npy")
    return {"train_x": train[:, :, 0], "train_y": train[:, :, 1], "val_x": val[:, :, 0], "val_y": val[:, :, 1]}
