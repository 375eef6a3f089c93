import io
import tarfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foldline.operators import training
from foldline.operators.network import Model
from foldline.sources import archives, arrayfiles, readers, writers


def rows_of(frame, column):
    return np.array([r[column] for r in frame.orderBy("row").collect()])


def test_ranges_of_one_file(spark, tmp_path, monkeypatch):
    """A file of several ranges and pieces is read as the table it is."""
    monkeypatch.setattr(arrayfiles, "RANGE", 4_000)
    a = np.random.default_rng(1).standard_normal((501, 3, 2))
    for k, dtype in enumerate(("<f8", ">f4", "<i2", "u1")):
        np.save(tmp_path / f"{k}.npy", (a * 50).astype(dtype))
        for path in (f"{tmp_path}/{k}.npy", f"file:{tmp_path}/{k}.npy", f"file://{tmp_path}/{k}.npy"):
            found = arrayfiles.array_rows(spark, {"a": path})
            np.testing.assert_array_equal(rows_of(found, "a"), (a * 50).astype(dtype).reshape(501, 6).astype(float))
    assert arrayfiles.ArrayReader({"a": f"{tmp_path}/0.npy"}).partitions()[1].first > 0
    np.save(tmp_path / "flat.npy", np.arange(4))
    assert [r.a for r in arrayfiles.array_rows(spark, {"a": f"{tmp_path}/flat.npy"}).orderBy("row").collect()] == [[0.0], [1.0], [2.0], [3.0]]
    np.save(tmp_path / "none.npy", np.empty((0, 5)))
    assert arrayfiles.array_rows(spark, {"a": f"{tmp_path}/none.npy"}).count() == 0


def test_refused_files(spark, tmp_path):
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.ones((3, 2))))
    np.save(tmp_path / "one.npy", np.float64(3))
    np.save(tmp_path / "words.npy", np.array(["a", "b"]))
    np.save(tmp_path / "short.npy", np.ones((2, 2)))
    for name in ("columns", "one", "words"):
        with pytest.raises(ValueError):
            arrayfiles.Header.of(f"{tmp_path}/{name}.npy")
    np.save(tmp_path / "long.npy", np.ones((3, 2)))
    with pytest.raises(ValueError, match="one length"):
        arrayfiles.ArrayReader({"a": f"{tmp_path}/short.npy", "b": f"{tmp_path}/long.npy"})


def test_written_array(spark, tmp_path):
    """Rows dealt over many partitions are written at their places of the order."""
    rng = np.random.default_rng(2)
    a = rng.standard_normal((700, 4)).astype(np.float32)
    rows = spark.createDataFrame([(k, a[k].tolist()) for k in rng.permutation(700).tolist()], "k long, v array<float>").repartition(5)
    assert arrayfiles.write_array(rows, "v", [F.col("k")], f"{tmp_path}/v.npy") == 700
    np.testing.assert_array_equal(np.load(tmp_path / "v.npy"), a)
    assert arrayfiles.write_array(rows, "v", [F.col("k").desc()], f"file://{tmp_path}/w.npy", dtype="<f8") == 700
    np.testing.assert_array_equal(np.load(tmp_path / "w.npy"), a[::-1].astype(float))
    assert arrayfiles.write_array(rows.limit(0), "v", [F.col("k")], f"{tmp_path}/none.npy", width=4) == 0 and np.load(tmp_path / "none.npy").shape == (0, 4)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none.npy", "v.npy", "w.npy"]


@pytest.mark.parametrize("bad", [None, [1.0], [1.0, None]])
def test_rows_that_make_no_array(spark, tmp_path, bad):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, bad)], "k long, v array<double>")
    with pytest.raises((ValueError, PySparkException)):
        arrayfiles.write_array(rows, "v", [F.col("k")], f"{tmp_path}/v.npy")
    assert not list(tmp_path.iterdir())


def test_arrays_of_examples_train_a_model(spark, tmp_path):
    """Both layouts give the same examples, which a barrier stage trains on."""
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((2, 120, 10)).astype(np.float32)
    made = [("val" if k >= 90 else "train", "a", 0, k, x[k].tolist(), y[k].tolist()) for k in range(120)]
    writers.arrays(spark.createDataFrame(made, "split string, alignment_id string, dir int, k int, x array<float>, y array<float>"), str(tmp_path))
    np.testing.assert_array_equal(readers.training_arrays(str(tmp_path))["val_y"], y[90:])
    (tmp_path / "both" / "val").mkdir(parents=True)
    np.save(tmp_path / "both" / "data.npy", np.stack([x[:90], y[:90]], 2))
    np.save(tmp_path / "both" / "val" / "data.npy", np.stack([x[90:], y[90:]], 2))
    one, other = (arrayfiles.examples(spark, f) for f in (str(tmp_path), f"{tmp_path}/both"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) and one.where("split = 'val' and id < 0").count() == 30
    assert training.train_table(Model.fresh(seed=1), one, 2, epochs=1, batch=30)[0]["val_loss"] > 0


def archive(path, named, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, content in named:
            head = tarfile.TarInfo(name)
            head.size = len(content)
            tar.addfile(head, io.BytesIO(content))


@pytest.mark.parametrize("ending, mode", [("tar", "w"), ("tar.gz", "w:gz"), ("tar.bz2", "w:bz2")])
def test_members(spark, tmp_path, monkeypatch, ending, mode):
    monkeypatch.setattr(archives, "RANGE", 2_000)
    named = [(f"./in/{'x' * (120 if k % 9 == 0 else 3)}{k}", bytes([k]) * (k * 7 % 900)) for k in range(60)] + [("empty", b""), ("empty", b"two")]
    archive(tmp_path / f"a.{ending}", named, mode)
    archive(tmp_path / f"none.{ending}", [], mode)
    found = archives.members(spark, str(tmp_path)).collect()
    assert sorted((r.member, bytes(r.content)) for r in found) == sorted(named) and all(r.size == len(r.content) for r in found)


@pytest.mark.parametrize("ending, mode", [("tar", "w"), ("tgz", "w:gz")])
@pytest.mark.parametrize("name", ["../x", "/x", "a/../../x", "a/./../..//x"])
def test_unsafe_members(spark, tmp_path, name, ending, mode):
    archive(tmp_path / f"a.{ending}", [("ok", b"1"), ("b/../ok", b"1"), (name, b"2")], mode)
    with pytest.raises(PySparkException, match="leaves its folder"):
        archives.members(spark, str(tmp_path)).select("member").collect()


def test_links_are_refused(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        head = tarfile.TarInfo("d1")
        head.type, head.linkname = tarfile.SYMTYPE, "/etc/passwd"
        tar.addfile(head)
    with pytest.raises(PySparkException, match="link"):
        archives.members(spark, str(tmp_path)).collect()


def test_structures_of_archives(spark, tmp_path):
    archive(tmp_path / "a.tar", [("pdb/d1x.ent", b"one"), ("pdb/README", b"no"), ("pdb/.d9", b"no")])
    archive(tmp_path / "b.tgz", [("d2x.pdb", b"two")], "w:gz")
    assert sorted((r.sid, bytes(r.content), r.length) for r in archives.structures(spark, str(tmp_path)).collect()) == [("d1x", b"one", 3), ("d2x", b"two", 3)]
    assert archives.structures(spark, f"{tmp_path}/b.tgz").count() == 1
    archive(tmp_path / "c.tar", [("other/d1x", b"again")])
    with pytest.raises(ValueError, match="d1x"):
        archives.structures(spark, str(tmp_path))
    (tmp_path / "e").mkdir()
    archive(tmp_path / "e" / "e.tar", [("README", b"no")])
    with pytest.raises(ValueError, match="no structure files"):
        archives.structures(spark, f"{tmp_path}/e")


def test_written_archives(spark, tmp_path):
    rows = spark.createDataFrame([(f"a/{k}", None if k == 3 else bytearray([k]) * k) for k in range(20)], "member string, content binary").repartition(3)
    for compressed in (False, True):
        folder = f"file://{tmp_path}/{compressed}"
        assert archives.write_archives(rows, folder, compressed) == 20
        assert {r.member: bytes(r.content) for r in archives.members(spark, folder).collect()} == {f"a/{k}": b"" if k == 3 else bytes([k]) * k for k in range(20)}
    assert archives.write_archives(rows.limit(0), f"{tmp_path}/none") == 0
