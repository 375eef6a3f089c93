import csv
import os

import pytest
from pyspark.sql import functions as F

from foldline.sources import readers, writers
from foldline.sources.textfiles import write_lines


def test_lines_in_order(spark, tmp_path):
    """One file, the same as sorted lines; long, empty, null and tied ones."""
    rows = [(k * 7919 % 1000, None if k % 50 == 7 else "" if k % 50 == 9 else f"é{k}" * (k % 13 * 40)) for k in range(3000)]
    frame = spark.createDataFrame(rows, "k long, _line string").repartition(7)
    path = f"{tmp_path}/deep/lines.txt"
    size = write_lines(frame, F.col("_line"), [F.desc("k")], path, "top")
    want = "".join(x + "\n" for x in ["top", *(t for _, t in sorted(((-k, t or "") for k, t in rows)))])
    assert open(path, encoding="utf-8", newline="").read() == want and size == os.path.getsize(path)
    assert os.listdir(f"{tmp_path}/deep") == ["lines.txt"]
    # A file that is there is replaced, and without rows there is the header alone.
    assert write_lines(frame.where("k < 0"), F.col("_line"), [F.col("k")], path, "top") == 4
    assert open(path).read() == "top\n"
    assert write_lines(frame.where("k < 0"), F.col("_line"), [F.col("k")], path) == 0 == os.path.getsize(path)


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    frame = spark.range(100).select("id", F.when(F.col("id") == 50, F.raise_error(F.lit("broken"))).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="broken"):
        write_lines(frame, F.col("v"), [F.col("id")], f"{tmp_path}/x.txt")
    assert os.listdir(tmp_path) == []


def test_only_mounted_storage(spark):
    with pytest.raises(Exception, match="mounted"):
        write_lines(spark.range(2), F.col("id"), [F.col("id")], "s3://bucket/x.txt")


def test_tsv_as_the_csv_module_writes_it(spark, tmp_path):
    rows = [("a", 1, None), (' b ', 2, "tab\there"), ('quote "q"', 3, "two\nlines"), ("", 4, "x")]
    writers.tsv(spark.createDataFrame(rows, "a string, n long, t string"), [F.col("n")], f"{tmp_path}/x.tsv")
    with open(f"{tmp_path}/want.tsv", "w", newline="") as f:
        out = csv.writer(f, delimiter="\t", lineterminator="\n")
        out.writerows([("a", "n", "t"), *rows])
    assert open(f"{tmp_path}/x.tsv").read() == open(f"{tmp_path}/want.tsv").read()


def test_sequence_records(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">d1 first of all\nABC\nDE\n>d2\n\n>d3\nX>Y\n")
    (tmp_path / "b.fa").write_text(">d4\r\nAB\r\nC")
    assert {tuple(r) for r in readers.fasta(spark, str(tmp_path)).collect()} == {("d1", "ABCDE"), ("d2", ""), ("d3", "X>Y"), ("d4", "ABC")}
