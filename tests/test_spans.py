"""What batches span, from the sizes of alignments, is what the plan's rows say."""

import pytest

from foldline.operators import batches, pairs
from foldline.plans.catalog import QUERIES
from tests.test_queries import SF, compare


@pytest.mark.parametrize(("sizes", "batch", "piece"), [((90, 30, 7, 1, 1, 40), 16, 4096), ((90, 30, 7, 1, 1, 40), 16, 3), ((500, 3, 2), 64, 2), ((1,) * 50, 7, 4096), ((5, 4), 10, 4096)])
def test_spans_of_sizes(spark, monkeypatch, sizes, batch, piece):
    monkeypatch.setattr(batches, "PIECE", piece)
    rows = [(f"a{a}", k) for a, n in enumerate(sizes) for k in range(n)]
    want = batches.spans(batches.batch_plan(spark.createDataFrame(rows, "alignment_id string, k int"), batch, seed=1, epoch=3))
    frame = spark.createDataFrame([*((f"a{a}", n) for a, n in enumerate(sizes)), ("none", 0), ("null", None)], "alignment_id string, n long").repartition(3)
    read = lambda df: sorted((r.batch, r.rows, r.alignments) for r in df.collect())
    assert read(batches.sized_spans(frame, batch, seed=1, epoch=3)) == read(want)


def test_sizes_are_those_of_the_expansion(spark):
    rows = spark.createDataFrame([("x", "P2D3P"), ("y", "3I"), ("z", None), ("w", "0P4P")], "alignment_id string, cigar string")
    assert {r.alignment_id: r.n for r in pairs.sizes(rows).collect()} == {"x": 4, "y": 0, "z": None, "w": 4}
    assert pairs.expand(rows).count() == 8


def test_rows_are_not_put_in_order(spark, monkeypatch):
    monkeypatch.setattr(batches, "numbered", None)
    compare(QUERIES["batch_spans"](spark, SF), "batch_spans", SF)
