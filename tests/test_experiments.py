import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.facade import StructuralAlphabet, register
from foldline.operators import network, search
from foldline.operators.network import Mlp, Model
from foldline.plans import alphabet, dataset, experiments, files, settings
from foldline.sources import readers, scratch, writers
from tests.test_dataset import inputs, pdb  # noqa: F401


def test_cigar_pairs_in_sql(spark):
    register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM cigar_pairs('2M3P')").collect()] == [(0, 2, 2), (1, 3, 3), (2, 4, 4)]
    rows = spark.sql("SELECT c, k, i, j FROM VALUES ('1P1D2P'), ('3I') AS t(c), LATERAL cigar_pairs(c)").collect()
    assert [tuple(r) for r in rows] == [("1P1D2P", 0, 0, 0), ("1P1D2P", 1, 2, 1), ("1P1D2P", 2, 3, 2)]


def test_runs_side_by_side(spark, inputs, monkeypatch):  # noqa: F811
    folder, given = inputs
    own = StructuralAlphabet(spark)
    with warnings.catch_warnings(record=True) as heard:
        warnings.simplefilter("always")
        (folder / "pdb/d1bbbb_").write_text("MODEL        1\n" + pdb(2) + "ENDMDL\nMODEL        2\n" + pdb(3))
        own.build_features(given)
    assert any("d1bbbb_: 2 models" in str(w.message) for w in heard)
    out = given["outputs"]["out_dir"]
    base = settings.resolve(settings.TRAIN, {"model": {"n_states": 4, "z_dim": 2, "hidden_dim": 8, "l2_normalize": False}, "train": {"batch_size": 16, "max_epochs": 1, "clip_grad_norm": 0.5, "kmeans_init": False}, "data": {"processed_dir": out}, "outputs": {"out_dir": str(folder / "m")}})
    pairfile = given["dataset"]["val_pairfile"]
    found = experiments.compare_quantizers(spark, base, given["dataset"]["pdb_dir"], pairfile, str(folder / "both"), ("vq",))
    assert set(found) == {"vq"} and all(v["val_loss"] is not None for v in found.values())
    model = Model.load(str(folder / "both/vq"))
    assert model.encoder.weights[0].shape == (10, 8) and not model.config["l2_normalize"]
    assert {r.sid for r in own.encode(given["dataset"]["pdb_dir"], model).collect()} == {"d1aaaa_", "d1bbbb_"}
    # The loops over runs, without the runs.
    made = []
    monkeypatch.setattr(experiments, "run", lambda spark, run, *_: made.append(run) or {"mi": run.model.n_states / 10, "mi_tot": 0.5})
    monkeypatch.setattr(experiments.dataset, "build", lambda spark, data: made.append(data))
    monkeypatch.setattr(experiments.alphabet, "train", lambda spark, run: made.append(run) or run)
    grid = experiments.size_grid(spark, base, "", pairfile, str(folder / "grid"), range(2, 4)).collect()
    assert [tuple(r) for r in grid] == [(2, 0.2, 0.5), (3, 0.3, 0.5)] and made[1].outputs.out_dir.endswith("grid/k3")
    assert experiments.best_of_seeds(spark, base, [5, 6], "", lambda run: (run.train.seed / 10, 0.1, 0.1)) == 6
    (folder / "all.out").write_text("d1bbbb_ d1bbbb_ 24P\nd1aaaa_ d1aaaa_ 24P\nd1aaaa_ d1bbbb_ 24P\n")
    folds = experiments.cross_validate(spark, settings.resolve(settings.DATA, given), base, str(folder / "all.out"), [["d1aaaa_"], ["d1bbbb_"]], str(folder / "cv")).collect()
    assert [r.fold_id for r in folds] == [1, 2] and made[-1].data.processed_dir.endswith("cv/fold2/data")
    assert [(folder / f"cv/fold{k}/{side}_pairs.out").read_text().split()[0] for k in (1, 2) for side in ("train", "val")] == ["d1bbbb_", "d1aaaa_", "d1aaaa_", "d1bbbb_"]


def test_settings_reach_the_quantizer():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((64, 10))
    logs = []
    for values in ({}, {"ema_decay": 0.5}, {"clip_norm": 1e-6}, {"min_count": 50.0, "warm_up": 0}):
        model = Model.fresh(1, "ema_vq", n_states=4, z_dim=2)
        logs.append(network.train(model, (x, x), (x, x), epochs=2, batch=16, **values)[-1]["val_loss"])
    assert len(set(logs)) == 4


def test_bare_encoder_and_noise(spark):
    net, x = Mlp(10, 8, 2, 1, np.random.default_rng(1)), np.random.default_rng(2).standard_normal((20, 10))
    with pytest.raises(ValueError, match="centroids"):
        network.discretize(net, x)
    centroids = np.array([[0.0, 0], [1, 1], [-1, 2]])
    want = ((net.forward(x)[:, None] - centroids) ** 2).sum(2).argmin(1)
    assert network.discretize(net, x, centroids).tolist() == want.tolist()
    rows = spark.createDataFrame([(k, k % 2 == 0, [0.0, 0.0, 0.0]) for k in range(400)], "k int, valid boolean, ca array<double>")
    assert network.jittered(rows, ["ca"], 0, 1) is rows
    got = network.jittered(rows, ["ca"], 2.0, 1).agg(F.stddev(F.when(F.col("valid"), F.col("ca")[1])).alias("s"), F.max(F.when(~F.col("valid"), F.abs(F.col("ca")[1]))).alias("z")).first()
    assert 1.6 < got.s < 2.4 and got.z == 0


def test_lines_of_split_files(spark, tmp_path):
    lines = [f"line {k}" * (k % 5) for k in range(5000)]
    for name, end in (("a.txt", "\n"), ("b.txt", "\r\n")):
        (tmp_path / name).write_bytes(end.join(lines).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        for name in ("a.txt", "b.txt"):
            rows = readers.numbered_lines(spark, str(tmp_path / name))
            assert rows.rdd.getNumPartitions() > 1
            assert [r.value for r in rows.orderBy("source_row").collect()] == lines and rows.agg(F.max("source_row")).first()[0] == 4999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_curves_files_and_lists(spark, tmp_path):
    points = spark.createDataFrame([(f, x / 4, y) for f, ys in ((1, [0.8, 0.4, 0.2, 0.0]), (2, [1.0, 1.0, 0.0, 0.0])) for x, y in enumerate(ys, 1)], "fold_id int, x double, y double")
    weights = spark.createDataFrame([(1, 0.25), (2, 0.75)], "fold_id int, weight double")
    got = {round(r.x, 2): r.mean for r in search.fold_curves(points, weights, 4).collect()}
    assert got == pytest.approx({0.25: 0.95, 0.5: 0.85, 0.75: 0.05, 1.0: 0.0})
    writers.fold_files([["a", "b"], ["c"]], str(tmp_path / "f"))
    assert (tmp_path / "f/fold_1.txt").read_text() == "a\nb" and (tmp_path / "f/fold_2.txt").read_text() == "c"
    (tmp_path / "src").mkdir()
    (tmp_path / "src/d1.pdb").write_text("x" * 10)
    assert writers.archive_manifest(readers.discovered(spark, str(tmp_path / "src")), str(tmp_path))["total_structure_bytes"] == 10
    assert (tmp_path / "manifest.tsv").read_text().startswith("sid\tpath\tsize_bytes\tsha256\nd1\t")
    assert scratch.shared_folder(spark, "x") != scratch.shared_folder(spark, "x")
    run = settings.resolve(settings.TRAIN, {"train": {"seed": 4}})
    assert experiments.changed(run, train__seed=9).train.seed == 9 and run.train.seed == 4
    assert dataset.fails({"alignments": 100, "errored": 2}, False, 0.01) and not dataset.fails({"alignments": 100, "errored": 1}, False, 0.01)
    assert callable(alphabet.grid)
