import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.functions import cigar, geometry, hierarchy, quantize


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("text, want", [("2M3P", [(2, 2), (3, 3), (4, 4)]), ("10M5I3D", []), ("3P5M", [(0, 0), (1, 1), (2, 2)]), ("", []), ("0P", []), ("PIP", [(0, 0), (1, 2)]), ("1D?2P", [(1, 0), (2, 1)])])
def test_pairs(spark, text, want):
    assert [(p.i, p.j) for p in one(spark, cigar.pairs(F.lit(text)).alias("p")).p] == want


def test_unknown_operation(spark):
    with pytest.raises(Exception, match="not supported"):
        one(spark, cigar.pairs(F.lit("3P2X")).alias("p"))


@pytest.mark.parametrize("text, n, m, want", [("5P", 5, 5, None), ("5P", 3, 5, "ref_overrun"), ("5P", 5, 3, "query_overrun"), ("10M5I3D", 13, 15, None), ("10P_BAD_TRAILING_TEXT", 20, 20, "malformed"), ("1P1X", 9, 9, "malformed"), ("0P", 9, 9, "zero_length"), ("0M", 9, 9, "zero_length"), ("", 9, 9, "malformed"), ("999M", 20, 20, "ref_overrun")])
def test_problem(spark, text, n, m, want):
    assert one(spark, cigar.problem(F.lit(text), F.lit(n), F.lit(m)).alias("p")).p == want


def test_hierarchy(spark):
    c = F.lit("a.3.1.2")
    r = one(spark, hierarchy.fold(c).alias("a"), hierarchy.superfamily(c).alias("b"), hierarchy.family(c).alias("c"), hierarchy.parent(c).alias("d"), hierarchy.superfamily(F.lit("a.3")).alias("e"), hierarchy.group_id(F.lit("d1qksa1")).alias("f"), hierarchy.group_id(F.lit("x1")).alias("g"), hierarchy.mebibytes(F.lit(1572864)).alias("h"))
    assert tuple(r) == ("a.3", "a.3.1", "a.3.1.2", "a.3.1", None, "1qks", "x1", "1.5 MiB")


def v(*x):
    return tuple(F.lit(float(c)) for c in x)


def test_geometry(spark):
    cb = geometry.approx_cb(v(0, 0, 0), v(1, 0, 0), v(-1 / 3, np.sqrt(8) / 3, 0))
    assert one(spark, geometry.norm(cb).alias("n")).n == pytest.approx(1.5336)
    moved = geometry.virtual_center(v(0, 0, 0), v(0, 0, 1), v(1, 0, 0), 0, 0, 1.5)
    assert one(spark, *(c.alias(d) for c, d in zip(moved, "xyz"))) == pytest.approx((0, 0, 1.5))
    assert one(spark, geometry.scaled_cb(v(0, 0, 0), v(0, 0, 1), 2)[2].alias("z")).z == 2
    assert one(spark, geometry.unit(v(0, 0, 0))[0].alias("u")).u is None
    assert one(spark, geometry.separation_of(geometry.signed_log(F.lit(-17))).alias("s")).s == 17


def test_quantizers(spark):
    assert quantize.fsq_grid(3) == [-1, 0, 1] and quantize.fsq_grid(4) == [-0.75, -0.25, 0.25, 0.75]
    book = quantize.fsq_codebook(spark, [5, 4]).orderBy("state").collect()
    assert len(book) == 20 and book[5].vec == [-0.5, -0.25]
    for n in (2, 3, 4, 5):
        grid = [float(np.arctanh(min(max(x, -0.999999), 0.999999))) for x in quantize.fsq_grid(n)]
        assert [one(spark, quantize.fsq_digit(F.lit(z), n, corrected=True).alias("d")).d for z in grid] == list(range(n))
    assert [one(spark, quantize.fsq_digit(F.lit(float(np.arctanh(z))), 4).alias("d")).d for z in quantize.fsq_grid(4)] == [0, 1, 2, 2]
    assert one(spark, quantize.letter(F.lit(3)).alias("a"), quantize.letter(F.lit(None).cast("int")).alias("b")) == ("D", "X")
    assert len(quantize.LETTERS) == 50 and "X" not in quantize.LETTERS.upper()
