import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.cli import main
from foldline.plans import alphabet, archive, dataset, reporting, settings
from foldline.sources import readers, writers
from foldline.streaming import letters


def pdb(seed: int, n: int = 24) -> str:
    rng = np.random.default_rng(seed)
    ca, lines, serial = np.cumsum(rng.standard_normal((n, 3)) * 3, axis=0), [], 0
    for k, p in enumerate(ca):
        side = rng.standard_normal(3)
        for name, at in (("N", p + [-1, 1, 0]), ("CA", p), ("C", p + [1, 1, 0]), ("O", p + [1, 2, 0]), ("CB", p + 1.5 * side / np.linalg.norm(side))):
            serial += 1
            lines.append(f"ATOM  {serial:5d}  {name:<3s} ALA A{k + 1:4d}    {at[0]:8.3f}{at[1]:8.3f}{at[2]:8.3f}  1.00  0.00          {name[0]:>2s}")
    return "\n".join([*lines, "TER", ""])


@pytest.fixture
def inputs(tmp_path):
    folder = tmp_path / "pdb"
    folder.mkdir()
    for sid, seed in (("d1aaaa_", 1), ("d1bbbb_", 2)):
        (folder / sid).write_text(pdb(seed))
    (tmp_path / "train_pairs.out").write_text("d1aaaa_ d1bbbb_ 24P\nd1aaaa_\td1aaaa_ 0.7 24P\nbad line\n")
    (tmp_path / "val_pairs.out").write_text("d1bbbb_ d1aaaa_ 24P\n")
    (tmp_path / "lookup.tsv").write_text("d1aaaa_\ta.3.1.2\nd1bbbb_\tb.1.1.1\n")
    given = {
        "dataset": {"name": "t", "pdb_dir": str(folder), "train_pairfile": str(tmp_path / "train_pairs.out"), "val_pairfile": str(tmp_path / "val_pairs.out"), "scop_lookup": str(tmp_path / "lookup.tsv")},
        "features": {"virtual_center": [270.0, 0.0, 2.0], "max_ca_dist": 100.0}, "outputs": {"out_dir": str(tmp_path / "out")},
    }
    return tmp_path, given


def test_build_train_evaluate(spark, inputs):
    folder, given = inputs
    made = dataset.build(spark, settings.resolve(settings.DATA, given))
    out = given["outputs"]["out_dir"]
    assert set(os.listdir(out)) >= {"examples", "pair_metadata", "structures", "skipped_alignments.tsv", "report.json", "report.md", "manifest.json", "DATACARD.md", "scaler.json"}
    report = json.load(open(f"{out}/report.json"))
    counts = report["train"]["stage_counts"]
    assert counts["alignments"] == 2 and counts["errored"] == 0 and counts["examples"] == 2 * counts["after_cap"] > 0
    rows = spark.read.parquet(f"{out}/examples")
    assert rows.where("split = 'train'").count() == counts["examples"]
    meta = spark.read.parquet(f"{out}/pair_metadata").where("alignment_id = 'train_pairs:0:d1aaaa_:d1bbbb_' and sid_source = 'd1aaaa_'").first()
    assert (meta.superfamily_source, meta.fold_target) == ("a.3.1", "b.1")
    same = rows.where("sid1 = sid2").select(F.max("ca_dist")).first()[0]
    assert same < 1e-3
    with pytest.raises(FileExistsError):
        dataset.build(spark, settings.resolve(settings.DATA, given))
    given["outputs"]["out_dir"] = str(folder / "again")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert dataset.build(spark, settings.resolve(settings.DATA, given))["outputs"]["examples"] == made["outputs"]["examples"]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "Stages, train" in open(f"{out}/DATACARD.md").read() and reporting.markdown(report) == open(f"{out}/report.md").read()

    run = settings.resolve(settings.TRAIN, {"model": {"quantizer": "fsq", "levels": [2, 2]}, "train": {"batch_size": 16, "max_epochs": 2}, "data": {"processed_dir": out}, "outputs": {"out_dir": str(folder / "model")}})
    model = alphabet.train(spark, run)
    assert model.config["virtual_center"] == [270.0, 0.0, 2.0] and os.path.exists(folder / "model/train_log.csv")
    found = alphabet.evaluate(spark, str(folder / "model"), given["dataset"]["pdb_dir"], given["dataset"]["val_pairfile"], str(folder / "model/eval"))
    lines = open(folder / "model/eval/sequences.txt").read().split("\n")
    assert [x.split()[0] for x in lines[:2]] == ["d1aaaa_", "d1bbbb_"] and len(lines[0].split()[1]) == 24
    assert found["total_counts"] > 0 and found["n_letters"] == 4 and 0 <= found["normalized_entropy"] <= 1
    assert {r.sid: r.seq for r in readers.sequences(spark, str(folder / "model/eval/sequences.txt")).collect()}["d1bbbb_"] == lines[1].split()[1]
    assert readers.matrix(spark, str(folder / "model/eval/submat.txt")).count() == 16
    assert reporting.compare({"a": str(folder / "model")}, str(folder / "cmp"))["a"]["val_loss"] is not None
    assert main(["report", "--out-dir", out]) == 0 and main(["report", "--out-dir", "/nowhere"]) == 1


def test_skips_and_degenerate(spark, inputs):
    folder, given = inputs
    (folder / "train_pairs.out").write_text("d1aaaa_ d1bbbb_ 8M2P\nd1aaaa_ dgone_ 24P\n")
    given["preprocessing"] = {"max_skipped_fraction": 0.6}
    dataset.build(spark, settings.resolve(settings.DATA, given))
    out = given["outputs"]["out_dir"]
    counts = json.load(open(f"{out}/report.json"))["train"]["stage_counts"]
    assert counts["degenerate"] == 1 and counts["dropped_degenerate"] == 2 and counts["empty"] == 1 and counts["errored"] == 1
    assert "FileNotFoundError" in open(f"{out}/skipped_alignments.tsv").read()
    qc = {r.sid: r for r in spark.read.parquet(f"{out}/structures").collect()}
    assert qc["dgone_"].parse_status == "missing_file" and qc["d1aaaa_"].parse_status == "ok" and qc["d1aaaa_"].n_residues == 24
    given["preprocessing"] = {"fail_on_skipped_alignments": True}
    with pytest.raises(RuntimeError, match="1 of 2"):
        dataset.build(spark, settings.resolve(settings.DATA, given), force=True)
    (folder / "train_pairs.out").write_text("d1aaaa_ d1bbbb_ 999M\n")
    with pytest.raises(ValueError, match="ref_overrun"):
        dataset.validate(spark, settings.resolve(settings.DATA, given))


def test_settings(tmp_path):
    with pytest.raises(ValueError, match="missing"):
        settings.resolve(settings.DATA, {"outputs": {"out_dir": "x"}})
    with pytest.raises(ValueError, match="unknown"):
        settings.resolve(settings.TRAIN, {"model": {"depth": 3}})
    found = settings.resolve(settings.TRAIN, None, settings.parse_overrides(["--train.lr", "0.5", "--model.levels=[3, 3]"]) | {"train.seed": None})
    assert (found.train.lr, found.model.levels, found.train.seed) == (0.5, [3, 3], 1)
    assert found.hash() != settings.resolve(settings.TRAIN, None).hash()


def test_parser():
    atom = lambda kind, name, alt, res, seq, x, occ: f"{kind:<6s}    1 {name:^4s}{alt:1s}{res:3s} A{seq:4d}    {x:8.3f}{0:8.3f}{0:8.3f}{occ:6.2f}  0.00           C"
    text = "\n".join([
        "MODEL        1", atom("ATOM", "CA", "A", "ALA", 1, 1, 0.3), atom("ATOM", "CA", "B", "ALA", 1, 2, 0.7), atom("ATOM", "CB", "", "ALA", 1, 3, 1), atom("ATOM", "N", "", "ALA", 1, 4, 1), atom("ATOM", "C", "", "ALA", 1, 5, 1),
        atom("HETATM", "CA", "", "MSE", 2, 1, 1), atom("ATOM", "CB", "", "VAL", 3, 1, 1), "ENDMDL", "MODEL        2", atom("ATOM", "CA", "", "ALA", 9, 1, 1),
    ])
    found, facts = readers.parse_structure(text)
    assert [r["resseq"] for r in found] == [1, 2, 3] and facts["n_chains"] == 1 and found[0]["atoms"]["CA"][0][0] == 2
    assert [readers.residue_row(r)["valid"] for r in found] == [True, False, False]


def test_readers(spark, tmp_path):
    (tmp_path / "p").write_text("a b 3P\n\nx  y\t\t0.5 2M1P \r\nshort one\n")
    rows = [(r.source_row, r.sid1, r.cigar) for r in readers.pairfile(spark, str(tmp_path / "p")).orderBy("source_row").collect()]
    assert rows == [(0, "a", "3P"), (2, "x", "2M1P")]
    (tmp_path / "l").write_text("# c\nd1 a.1\nd1 b.2\n\n")
    assert readers.class_lookup(spark, str(tmp_path / "l")).where("sid = 'd1'").first()["class"] == "b.2"
    assert readers.class_lookup(spark, None).count() == 0 and [r.sid for r in readers.id_list(spark, str(tmp_path / "l")).collect()] == ["d1", "d1"]
    np.savez(tmp_path / "a.npz", mean=np.arange(3.0), m=np.ones((2, 2)))
    assert readers.arrays(spark, str(tmp_path / "a.npz")).count() == 3
    scores = spark.createDataFrame([("A", "A", 4)], "a string, b string, score int")
    assert writers.with_invalid_letter(scores).count() == 4
    source = tmp_path / "in"
    source.mkdir()
    (source / "d1x.ent").write_text("x")
    assert archive.wrangle(str(source), str(tmp_path / "by_sid"), "hardlink") == {"d1x": f"{source}/d1x.ent"}
    assert [r.sid for r in readers.discovered(spark, str(source)).collect()] == ["d1x"]
    (source / "d1x.pdb").write_text("y")
    for f in (lambda: archive.wrangle(str(source), str(tmp_path / "o")), lambda: readers.discovered(spark, str(source))):
        with pytest.raises(ValueError, match="d1x"):
            f()


def test_streams(spark, tmp_path):
    source = tmp_path / "s"
    spark.createDataFrame([("A", "B"), ("A", "B"), ("B", "B")], "a string, b string").write.parquet(str(source))
    q = letters.running_counts(spark.readStream.schema("a string, b string").parquet(str(source))).writeStream.outputMode("complete").format("memory").queryName("pairs").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.a, r.b, r.n) for r in spark.table("pairs").collect()} == {("A", "B", 2), ("B", "A", 2), ("B", "B", 2)}
